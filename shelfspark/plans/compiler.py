"""Trees of the search language as Spark columns. Literals are read on the driver; a leaf that is null counts as false."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import glob_match, has_wildcard, has_words
from ..functions.values import date_range, number
from . import query as q

#: What a value of format: also stands for.
_FORMATS = {"jpg": "jpeg", "webm": "mkv"}
#: Beyond it doubles aren't exact and no column's value reaches.
_WHOLE = 2.0**62
_CHEAP = {"width": 0, "height": 0, "size": 0, "tag_count": 0, "created_at": 0, "tagged_at": 0, "kind": 1, "format": 1, "id": 1, "source": 2, "path": 3, "similar": 4, "text": 5}


def _compare(col: Column, op: str, value: float) -> Column:
    """A whole-number column against a value, as a comparison with a whole literal, which a Parquet scan can take."""
    if math.isnan(value):
        return F.lit(False)
    if op == "eq":
        return col == F.lit(round(value)) if abs(value) < _WHOLE and abs(value - round(value)) < 1e-9 else F.lit(False)
    if abs(value) >= _WHOLE:
        return col.isNotNull() if (op in ("lt", "lte")) == (value > 0) else F.lit(False)
    low, high = math.floor(value), math.ceil(value)
    return {"gt": col > low, "gte": col >= high, "lt": col < high, "lte": col <= low}.get(op, F.lit(False))


def _dimension(name: str, op: str, value: str) -> Column:
    n = number(value)
    if n is None:
        return F.lit(False)
    test = _compare(F.col(name), op, n)
    return test if n == 0 else (F.col(name) > 0) & test


def _dated(name: str, op: str, value: str) -> Column:
    got = date_range(value)
    if got is None:
        return F.lit(False)
    t, (lo, hi) = F.col(name), got
    return {"eq": (t >= lo) & (t < hi), "gt": t >= hi, "gte": t >= lo, "lt": t < lo, "lte": t < hi}.get(op, F.lit(False))


def text_test(leaf: q.Field, text: Column) -> Column:
    """Whether a text passes a text: leaf."""
    if leaf.op == "word":
        return has_words(text, leaf.value)
    flat = F.translate(text, "\n", " ")
    if has_wildcard(leaf.value):
        return glob_match(flat, leaf.value)
    return F.lower(flat).contains(leaf.value.lower()) if leaf.value else F.lit(True)


def _field(leaf: q.Field, similar: Mapping[str, Column]) -> Column:
    name, op, value = leaf.name, leaf.op, leaf.value
    if name == "format":
        low = value.lower()
        return F.col("format").isin(*{low, _FORMATS.get(low, low)})
    if name == "kind":
        return F.col("kind") == value.lower()
    if name == "id":
        return F.col("id").startswith(value)
    if name == "source":
        return F.lower(F.substring_index("path", "/", 1)) == value.lower()
    if name == "path":
        return glob_match(F.col("path"), f"*{value}*")
    if name == "text":
        return text_test(leaf, F.col("text"))
    if name in ("width", "height"):
        return _dimension(name, op, value)
    if name in ("size", "tag_count"):
        n = number(value)
        return F.lit(False) if n is None else _compare(F.col("xmp_tag_count" if name == "tag_count" else name), op, n)
    if name in ("created_at", "tagged_at"):
        return _dated(name, op, value)
    image, bits = q.similar_spec(value)
    return similar[image] <= bits if image in similar else F.lit(False)


def tag_test(leaf: q.Tag | q.ExactTag, canon: Callable[[str], str], tag: Column) -> Column:
    """Whether a single tag is one that the leaf asks for."""
    name = canon(leaf.name)
    return glob_match(tag, name) if isinstance(leaf, q.Tag) and has_wildcard(name) else tag == name


def to_column(tree, canon: Callable[[str], str] = lambda t: t, similar: Mapping[str, Column] | None = None, known: Mapping[object, Column] | None = None) -> Column:
    """The tree as a predicate over a files view, for a filter: null counts as false.

    canon maps tags to their canonical form; similar maps images to distance columns (null: no distance). known has
    columns for leaves that were settled before; tags and texts are else tested on columns `tags` and `text`. Only
    below a NOT are nulls replaced, so that other leaves reach the scan as they are.
    """
    known = known or {}

    def leaf(t) -> Column:
        if t in known:
            return known[t]
        return _field(t, similar or {}) if isinstance(t, q.Field) else F.exists("tags", lambda x: tag_test(t, canon, x))

    def build(t, negated: bool) -> Column:
        if isinstance(t, q.All):
            return F.lit(True)
        if isinstance(t, q.Not):
            return ~build(t.item, True)
        if isinstance(t, (q.And, q.Or)):
            left, right = (build(x, negated) for x in sorted((t.left, t.right), key=_cost))
            return left & right if isinstance(t, q.And) else left | right
        return F.coalesce(leaf(t), F.lit(False)) if negated else leaf(t)

    return build(tree, False)


def _cost(tree) -> int:
    """Cheap operands are tested first."""
    return max((_CHEAP.get(x.name, 2) if isinstance(x, q.Field) else 2 for x in q.walk(tree)), default=0)


def needs(tree) -> set[str]:
    """The satellites a search has to join: tags, text, hashes."""
    out = set()
    for x in q.walk(tree):
        if isinstance(x, (q.Tag, q.ExactTag)):
            out.add("tags")
        elif isinstance(x, q.Field) and x.name in ("text", "similar"):
            out.add("text" if x.name == "text" else "hashes")
    return out

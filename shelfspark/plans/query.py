"""The search language: text to a tree. Nothing here needs Spark.

NOT binds closest, then AND, then OR. `,` and `&&` are AND, `||` is OR, a `-` or `!` at the start of a term is NOT; AND, OR
and NOT are also words when they stand alone. Two operands side by side are an AND, but plain spaces stay within a term.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

FIELDS = frozenset("format kind id source path text width height size tag_count created_at tagged_at similar".split())
ORDERED = frozenset("width height size tag_count created_at tagged_at".split())
_OPS = {"gt": "gt", "gte": "gte", "lt": "lt", "lte": "lte", "word": "word", "w": "word"}


class QuerySyntaxError(ValueError):
    """The query can't be read."""


@dataclass(frozen=True)
class All:
    """Matches every row."""


@dataclass(frozen=True)
class Tag:
    name: str


@dataclass(frozen=True)
class ExactTag:
    name: str


@dataclass(frozen=True)
class Field:
    name: str
    op: str
    value: str


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


_QUOTED = r'"(?:\\["\\]|[^"])*"'
_WORD_OP = r"(?<![^\s(),!|&])(?i:AND|OR|NOT)(?![^\s(),])"
_SCAN = re.compile(rf"(?P<word>{_WORD_OP})|(?P<two>\|\||&&)|(?P<one>[,()])|(?P<quoted>{_QUOTED})|(?P<open>\")|(?P<sign>[-!])|(?P<char>.)", re.S)
_KINDS = {"AND": "and", "OR": "or", "NOT": "not", "||": "or", "&&": "and", ",": "and", "(": "(", ")": ")"}


def _plain(text: str) -> str:
    """Text with quotes dropped and escaped quotes and backslashes resolved."""
    return re.sub(r'\\(["\\])|"', lambda m: m[1] or "", text)


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tokens(query: str) -> list[tuple[str, str]]:
    """(kind, text) of each token; kinds: term, quoted, and, or, not, (, )."""
    out: list[tuple[str, str]] = []
    held, exact = "", False

    def close():
        nonlocal held, exact
        if held.strip():
            out.append(("quoted" if exact else "term", held.strip()))
        held, exact = "", False

    for m in _SCAN.finditer(query):
        kind, text = m.lastgroup, m.group()
        if kind == "open":
            raise QuerySyntaxError("unclosed quote")
        if kind in ("word", "two", "one"):
            close()
            out.append((_KINDS[text.upper()], text))
        elif kind == "sign" and not held.strip():
            out.append(("not", text))
        elif kind == "quoted":
            exact = exact or not held.strip()
            held += _plain(text[1:-1])
            after = query[m.end() : m.end() + 1]
            if not after or after.isspace() or after in '(),"':
                close()
        else:
            held += text
    close()
    return out


def term(text: str):
    """An unquoted term: a field with its operator, or a tag."""
    head, colon, value = text.partition(":")
    if colon:
        name, dot, suffix = head.rpartition(".")
        op = _OPS.get(ascii_lower(suffix)) if dot else None
        name = ascii_lower(name if op else head)
        name = "text" if name == "t" else name
        if name in FIELDS and (op != "word" or name == "text"):
            return Field(name, op or "eq", value.strip())
    return Tag(ascii_lower(text))


def parse(query: str):
    """The query's tree; blank queries match all. Raises QuerySyntaxError."""
    toks = tokens(query)
    if not toks:
        return All()
    at = 0

    def kind() -> str | None:
        return toks[at][0] if at < len(toks) else None

    def either():
        nonlocal at
        left = both()
        while kind() == "or":
            at += 1
            left = Or(left, both())
        return left

    def both():
        nonlocal at
        left = single()
        while kind() in ("and", "term", "quoted", "not", "("):
            at += kind() == "and"
            left = And(left, single())
        return left

    def single():
        nonlocal at
        if at == len(toks):
            raise QuerySyntaxError("an operand is missing")
        k, text = toks[at]
        at += 1
        if k == "not":
            return Not(single())
        if k == "(":
            inner = either()
            if kind() != ")":
                raise QuerySyntaxError("a ) is missing")
            at += 1
            return inner
        if k == "term":
            return term(text)
        if k == "quoted":
            return ExactTag(ascii_lower(text))
        raise QuerySyntaxError(f"an operand is missing before {text}")

    tree = either()
    if at < len(toks):
        raise QuerySyntaxError(f"{toks[at][1]} comes without an operand")
    return tree


def quote_tag(tag: str) -> str:
    """The tag as a term that matches it alone, whatever it holds."""
    return '"' + tag.replace("\\", "\\\\").replace('"', '\\"') + '"'


def walk(tree):
    """The leaves, in order."""
    if isinstance(tree, Not):
        yield from walk(tree.item)
    elif isinstance(tree, (And, Or)):
        yield from walk(tree.left)
        yield from walk(tree.right)
    else:
        yield tree


def similar_spec(value: str, default: int = 20) -> tuple[str, int]:
    """(image, bits): a trailing @digits is the distance."""
    m = re.fullmatch(r"(.*)@([0-9]+)", value, re.S)
    return (m[1], int(m[2])) if m else (value, default)


def similar_operands(tree) -> list[str]:
    """The distinct images of the similar: terms, in order."""
    return list(dict.fromkeys(similar_spec(x.value)[0] for x in walk(tree) if isinstance(x, Field) and x.name == "similar"))


def resolve_sources(tree, sources: dict[str, str]):
    """source: values as ids; sources maps ids to names. An id wins over a name, both without regard to case; unknown ones raise."""
    if isinstance(tree, Not):
        return Not(resolve_sources(tree.item, sources))
    if isinstance(tree, (And, Or)):
        return type(tree)(resolve_sources(tree.left, sources), resolve_sources(tree.right, sources))
    if not (isinstance(tree, Field) and tree.name == "source"):
        return tree
    wanted = tree.value.lower()
    for key in (lambda i: i, sources.get):
        for i in sources:
            if key(i).lower() == wanted:
                return Field("source", tree.op, i)
    raise QuerySyntaxError(f"unknown source {tree.value}")


def tier_query(query: str, tier: str, thin: int = 3) -> str:
    """The query narrowed to untagged, thin or tagged files."""
    more = {"untagged": "tag_count:0", "thin": f"tag_count.gt:0, tag_count.lt:{thin}", "tagged": f"tag_count.gte:{thin}"}[tier]
    return f"({query}), {more}" if query.strip() else more


_STOP = re.compile(rf"(?P<quoted>{_QUOTED}|\".*\Z)|(?P<stop>{_WORD_OP}|\|\||&&|[,()])|(?P<sign>[-!])", re.S)


def completion(query: str, caret: int) -> tuple[int, int, str] | None:
    """(start, end, what is typed up to the caret) of the tag under the caret, in characters; None within operators, field values and blanks."""
    if caret > len(query):
        return None
    spans, start = [], 0
    for m in _STOP.finditer(query):
        if m.lastgroup == "stop" or m.lastgroup == "sign" and not query[start : m.start()].strip():
            spans.append((start, m.start()))
            start = m.end()
    spans.append((start, len(query)))
    for s, e in spans:
        raw = query[s:e]
        e = s + len(raw.rstrip())
        s += len(raw) - len(raw.lstrip())
        if s >= e or not s <= caret <= e:
            continue
        raw = query[s:e]
        if not raw.startswith('"') and isinstance(term(raw), Field):
            return None
        typed = _plain(query[s:caret])
        return (s, e, typed) if typed.strip() else None
    return None

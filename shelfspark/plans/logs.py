"""Logs of queries as tables: what each row's query asks for, by the parser, in batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import query as q

_PARTS = "valid boolean, similar array<struct<image: string, bits: int>>, typed string"


def _parts(text: str | None):
    if text is None:
        return None, None, None
    try:
        tree = q.parse(text)
    except q.QuerySyntaxError:
        valid, similar = False, []
    else:
        specs = {}
        for x in q.walk(tree) if tree is not None else ():
            if isinstance(x, q.Field) and x.name == "similar":
                image, bits = q.similar_spec(x.value)
                specs.setdefault(image, bits)
        valid, similar = True, [{"image": i, "bits": min(b, 2**31 - 1)} for i, b in specs.items()]
    found = q.completion(text, len(text))
    return valid, similar, found and found[2]


def query_parts(text: Column) -> Column:
    """struct(valid, similar, typed) of a query: whether it parses, its distinct images with the first bound of each, and the tag at its end; nulls of null."""

    def read(texts: pd.Series) -> pd.DataFrame:
        known = {t: _parts(t) for t in texts.unique()}  # logs repeat themselves
        return pd.DataFrame([known[t] for t in texts], columns=["valid", "similar", "typed"])

    return F.pandas_udf(read, _PARTS)(text)

"""Pages and positions in an ordered view."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tagging import tier


def page(ordered: DataFrame, number: int, size: int = 60, total: int | None = None) -> tuple[DataFrame, int, int]:
    """(rows, page, pages); the page is held within 1 and the last."""
    pages = max(1, math.ceil((ordered.count() if total is None else total) / size))
    at = min(max(1, number), pages)
    return ordered.offset((at - 1) * size).limit(size), at, pages


def tier_counts(files: DataFrame, thin: int = 3) -> DataFrame:
    """(untagged, thin, tagged) of the files."""
    t = tier(thin=thin)
    return files.agg(*[F.count_if(t == k).alias(k) for k in ("untagged", "thin", "tagged")])


def next_thin(view: DataFrame, position: int, thin: int = 3) -> DataFrame:
    """The first row below the threshold after the position in newest-first order, from the start again if there is none."""
    at = view.orderBy(F.desc("created_at"), "path").offset(position).limit(1).select(F.col("created_at").alias("__c"), F.col("path").alias("__p"))
    left = view.where(F.col("xmp_tag_count") < thin).join(F.broadcast(at), F.lit(True), "left")
    after = F.coalesce((F.col("created_at") < F.col("__c")) | ((F.col("created_at") == F.col("__c")) & (F.col("path") > F.col("__p"))), F.lit(False))
    return left.orderBy(F.desc(after), F.desc("created_at"), "path").limit(1).drop("__c", "__p")


def assistant_order(view: DataFrame) -> DataFrame:
    """Fewest hand-written tags first, then newest."""
    return view.orderBy("xmp_tag_count", F.desc("created_at"), "path")

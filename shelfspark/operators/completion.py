"""Completion of tags: the vocabulary with its counts, and the best matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import Vocabulary


def completion_values(tags: DataFrame, history: DataFrame, vocabulary: Vocabulary, requests=(), foreign: DataFrame | None = None) -> DataFrame:
    """(tag, count, own): live counts plus uses in the history; tags of rules, aliases and requests at 0; foreign (tag, count) where no own one is."""
    spark = tags.sparkSession
    live = tags.where(~F.col("tag").startswith("folder:")).groupBy("tag").agg(F.countDistinct("path").alias("count"))
    used = history.select("tag", F.greatest("uses", F.lit(0)).alias("count"))
    named = spark.createDataFrame([[t] for t in sorted(vocabulary.known_tags() | set(requests))], "tag string").select("tag", F.lit(0).cast("bigint").alias("count"))
    own = live.union(used).union(named).groupBy("tag").agg(F.sum("count").alias("count")).withColumn("own", F.lit(True))
    if foreign is None:
        return own
    other = foreign.groupBy("tag").agg(F.max("count").alias("count")).join(own, "tag", "left_anti").select("tag", "count", F.lit(False).alias("own"))
    return own.union(other)


def remembered_counts(tags: DataFrame, remembered: DataFrame) -> DataFrame:
    """(tag, count): live counts, at least what is remembered."""
    live = tags.groupBy("tag").agg(F.countDistinct("path").alias("live"))
    kept = remembered.groupBy("tag").agg(F.max("count").alias("kept"))
    return live.join(kept, "tag", "full").select("tag", F.greatest(F.coalesce("live", F.lit(0)), F.coalesce("kept", F.lit(0))).alias("count"))


def matches(values: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    """Tags that hold what is typed: own before foreign, beginnings before others, more before less, then by name. Nothing typed, nothing found."""
    q = typed.strip().lower()
    low = F.lower("tag")
    found = values.where(low.contains(q) if q else F.lit(False))
    return found.orderBy(F.desc("own"), F.desc(low.startswith(q)), F.desc("count"), "tag").limit(limit).select("tag")

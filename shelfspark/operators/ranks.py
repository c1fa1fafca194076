"""Places in an order over a whole table, found without gathering it: no row goes through a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import checkpointed


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "number") -> DataFrame:
    """df with gapless places from 0 in the order (a total one for places that hold on a rerun).

    Rows are sorted by ranges; a row's place is its place within its range plus the rows of the ranges before, of which
    there are as many as shuffle partitions. The sorted rows are checkpointed, so the places are settled.
    """
    width = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = checkpointed(placed)
    part = F.shiftright("__at", 33)
    sums = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = F.broadcast(sums.select("__part", ahead.alias("__ahead")))  # a row for each range
    return placed.join(sums, part == F.col("__part")).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__ahead")).alias(name))

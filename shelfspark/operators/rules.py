"""Rules as tables of (kind, name, target): merged, compared and renamed by joins, so a rule set may be as large as its tags.

Kinds: alias (name stands for target; one target a name), implies and suggests (any number), category and colour (one a
name). Rows with a null are no rules; repeated rows count once; of several targets where there may be one, the least holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SINGLE, MANY = ("alias", "category", "colour"), ("implies", "suggests")


def clean(rules: DataFrame) -> DataFrame:
    """Each rule once."""
    rows = rules.select("kind", "name", "target").where("kind IS NOT NULL AND name IS NOT NULL AND target IS NOT NULL")
    slot = F.when(F.col("kind").isin(*MANY), F.col("target")).otherwise("")
    return rows.groupBy("kind", "name", slot.alias("slot")).agg(F.min("target").alias("target")).select("kind", "name", "target")


def _sides(mine: DataFrame, other: DataFrame) -> DataFrame:
    """(kind, name, slot, mine, other): the rules of both by what can hold one target."""
    slot = F.when(F.col("kind").isin(*MANY), F.col("target")).otherwise("").alias("slot")
    a = clean(mine).select("kind", "name", slot, F.col("target").alias("mine"))
    b = clean(other).select("kind", "name", slot, F.col("target").alias("other"))
    return a.join(b, ["kind", "name", "slot"], "full")


def merged(mine: DataFrame, other: DataFrame) -> DataFrame:
    """(kind, name, target, clash): the rules of both; where only one can hold it is mine, and clash is the other's target if that is another alias."""
    clash = F.when((F.col("kind") == "alias") & (F.col("mine") != F.col("other")), F.col("other"))
    return _sides(mine, other).select("kind", "name", F.coalesce("mine", "other").alias("target"), clash.alias("clash"))


def compared(mine: DataFrame, other: DataFrame) -> DataFrame:
    """(side, kind, name, target): what only one of them has."""
    sides = _sides(mine, other).where(~F.col("mine").eqNullSafe(F.col("other")))
    rows = sides.select("kind", "name", F.explode(F.array(F.struct(F.lit("mine").alias("side"), F.col("mine").alias("target")), F.struct(F.lit("other").alias("side"), F.col("other").alias("target")))).alias("s"))
    return rows.where("s.target IS NOT NULL").select("s.side", "kind", "name", "s.target")


def renamed(rules: DataFrame, old: str, new: str) -> DataFrame:
    """The rules of a tag under its new name.

    If aliases or rules of other tags know the new name, the old one's implications are dropped instead of moved; so are
    rules that would lead from a tag to itself. A category that the new name has stays. Aliases keep their names.
    """
    rows = clean(rules)
    if old == new:
        return rows
    has = (F.col("name") == new) | (F.col("target") == new)
    known = rows.where(has & ((F.col("kind") == "alias") | ((F.col("kind") == "implies") & (F.col("name") != old))))
    rows = rows.withColumn("_known", F.lit(not known.isEmpty()))
    to = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c))
    rows = rows.where(~(F.col("_known") & (F.col("kind") == "implies") & (F.col("name") == old)))
    name = F.when(F.col("kind").isin(*MANY, "category"), to("name")).otherwise(F.col("name"))
    target = F.when(F.col("kind").isin(*MANY, "alias"), to("target")).otherwise(F.col("target"))
    moved = rows.select("kind", name.alias("name"), target.alias("target"), (F.col("name") == old).alias("moved")).where(~(F.col("kind").isin(*MANY) & (F.col("name") == F.col("target"))))
    slot = F.when(F.col("kind").isin(*MANY), F.col("target")).otherwise("")
    return moved.groupBy("kind", "name", slot.alias("slot")).agg(F.min_by("target", F.struct("moved", "target")).alias("target")).select("kind", "name", "target")

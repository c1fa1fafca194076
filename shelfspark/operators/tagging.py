"""Tags of files: counts, implied tags, edits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import settled
from .vocabulary import DENIAL, Vocabulary, relation


def folder_tags(path="path") -> Column:
    """folder:<name> of each folder above a file, without the source."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda c: F.concat(F.lit("folder:"), F.lower(c)))


_RELATION = r"(?s)^([^<]*)<([^<>]*)>$"


def _stripped(col) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def canon_column(col, vocabulary: Vocabulary) -> Column:
    """Canonical form of tags: trimmed, lower case, one alias hop; the parts of modifier<target> each on their own."""
    t = F.lower(_stripped(col))
    one = lambda x: x
    if vocabulary.aliases:
        table = F.create_map(*[F.lit(x) for k, v in sorted(vocabulary.aliases.items()) for x in (k, v.strip().lower())])
        one = lambda x: F.coalesce(F.try_element_at(table, x), x)
    modifier, target = (_stripped(F.regexp_extract(t, _RELATION, k)) for k in (1, 2))
    return F.when((modifier != "") & (target != ""), F.concat(one(modifier), F.lit("<"), one(target), F.lit(">"))).otherwise(one(t))


def tag_counts(tags: DataFrame) -> DataFrame:
    """(tag, n): files of each tag, most first."""
    return tags.groupBy("tag").agg(F.countDistinct("path").alias("n")).orderBy(F.desc("n"), "tag")


def hand_tag_counts(tags: DataFrame) -> DataFrame:
    """(tag, n) of hand-written tags, by name."""
    return tags.where("source = 'xmp'").groupBy("tag").agg(F.countDistinct("path").alias("n")).orderBy("tag")


def selection_counts(tags: DataFrame, paths: DataFrame) -> DataFrame:
    """(tag, n, shared) over the selected paths; shared: every selected file has it."""
    chosen = paths.select("path").distinct()
    total = chosen.agg(F.count("*").alias("total"))
    counts = tags.join(chosen, "path", "left_semi").groupBy("tag").agg(F.countDistinct("path").alias("n"))
    return counts.join(F.broadcast(total)).select("tag", "n", (F.col("n") == F.col("total")).alias("shared")).orderBy(F.desc("n"), "tag")


def rule_counts(tags: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(tag, n) of every tag of an implication, 0 for those that no file has."""
    spark = tags.sparkSession
    known = spark.createDataFrame([[t] for t in sorted({x for p in vocabulary.implications for x in p})], "tag string")
    counts = tags.groupBy("tag").agg(F.countDistinct("path").alias("n"))
    return known.join(counts, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def closure(edges: DataFrame) -> DataFrame:
    """(tag, implied): everything that each tag of the rules (tag, to) leads to, through any number of rules; a tag doesn't imply itself.

    Only pairs that the last round has found are taken a rule further, and only those not known yet stay, so cycles end;
    a round costs as much as it finds. Null ends are left out.
    """
    rules = settled(edges.where("tag IS NOT NULL AND to IS NOT NULL AND tag <> to").select("tag", "to").distinct())
    known = fresh = rules.select("tag", F.col("to").alias("implied"))
    while not fresh.isEmpty():
        further = fresh.join(rules.select(F.col("tag").alias("implied"), "to"), "implied").select("tag", F.col("to").alias("implied")).where("tag <> implied").distinct()
        fresh = settled(further.join(known, ["tag", "implied"], "left_anti"))
        known = settled(known.union(fresh))
    return known


def category_of(tag_names: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(tag, category) of the distinct tags; denials and relational tags go by what they are about."""
    table = vocabulary.to_frames(tag_names.sparkSession)["categories"]
    base = tag_names.select("tag").distinct()
    bare = F.regexp_replace("tag", f"^(?:{DENIAL})+", "")
    target = F.trim(F.regexp_extract("bare", "^[^<]+<([^<>]+)>$", 1))
    found = base.withColumn("bare", bare).withColumn("target", F.when(target != "", target).otherwise(F.col("bare")))
    for c in ("tag", "bare", "target"):
        found = found.join(F.broadcast(table.select(F.col("tag").alias(c), F.col("category").alias(f"of_{c}"))), c, "left")
    prefix = F.when(F.col("target").startswith("artist:"), "artist").when(F.col("target").startswith("oc:"), "character")
    return found.select("tag", F.coalesce("of_tag", "of_bare", "of_target", prefix, F.lit("other")).alias("category"))


def category_counts(tag_names: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(category, n): tags of each category in the categories' order, zeros too."""
    spark = tag_names.sparkSession
    order = spark.createDataFrame(list(enumerate(vocabulary.category_order())), "place int, category string")
    found = category_of(tag_names, vocabulary).groupBy("category").agg(F.count("*").alias("n"))
    return order.join(found, "category", "left").select("place", "category", F.coalesce("n", F.lit(0)).alias("n")).orderBy("place").drop("place")


def tier(count="xmp_tag_count", thin: int = 3) -> Column:
    c = F.col(count)
    return F.when(c == 0, "untagged").when(c < thin, "thin").otherwise("tagged")


def own_tags(tags: DataFrame) -> DataFrame:
    """(path, own): the hand-written and folder tags."""
    return tags.where("source <> 'implied'").groupBy("path").agg(F.sort_array(F.collect_set("tag")).alias("own"))


def implied_tags(tags: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(path, tag): what each file's own tags imply and it doesn't carry itself. The closure is found on the vocabulary, so one join does."""
    spark = tags.sparkSession
    own = tags.where("source <> 'implied'").select("path", canon_column(F.col("tag"), vocabulary).alias("tag")).distinct()
    halves = [_stripped(F.regexp_extract("tag", _RELATION, k)) for k in (1, 2)]
    parts = own.select("path", *[h.alias(n) for h, n in zip(halves, "mt")]).where("m <> '' AND t <> ''").select("path", F.explode(F.array("m", "t")).alias("tag"))
    closure = F.broadcast(vocabulary.to_frames(spark)["closure"])
    seeds = own.union(parts).distinct()
    reached = seeds.join(closure, "tag").select("path", F.col("implied").alias("tag")).union(parts).distinct()
    return reached.join(own, ["path", "tag"], "left_anti")


def reimply(tags: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(path, tags): files whose implied tags change under the vocabulary, with their full set of tags."""
    new = implied_tags(tags, vocabulary).groupBy("path").agg(F.sort_array(F.collect_set("tag")).alias("new"))
    old = tags.where("source = 'implied'").groupBy("path").agg(F.sort_array(F.collect_set("tag")).alias("old"))
    none = F.array().cast("array<string>")
    both = own_tags(tags).join(new, "path", "full").join(old, "path", "full")
    both = both.select("path", *[F.coalesce(c, none).alias(c) for c in ("own", "new", "old")]).where("new <> old")
    return both.select("path", F.sort_array(F.array_union("own", "new")).alias("tags"))


def offered(tags: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(path, tag): suggestions for each file that it neither carries nor has denied."""
    rules = F.broadcast(vocabulary.to_frames(tags.sparkSession)["suggestions"])
    have = tags.select("path", "tag").distinct()
    out = have.join(rules, "tag").select("path", F.col("to").alias("tag")).where(F.col("tag").startswith(DENIAL) == F.lit(False)).where("tag <> ''").distinct()
    out = out.join(have, ["path", "tag"], "left_anti")
    refused = have.where(F.col("tag").startswith(DENIAL)).select("path", F.expr(f"substring(tag, {len(DENIAL) + 1})").alias("tag"))
    return out.join(refused, ["path", "tag"], "left_anti")


def edit(tags_col, changes: Iterable[str], vocabulary: Vocabulary) -> Column:
    """A tag list after edits: +t or t adds, -t removes, the last word on a tag counts; blanks are left out. Tags are canonical."""
    out = F.array_distinct(F.transform(F.col(tags_col) if isinstance(tags_col, str) else tags_col, lambda t: canon_column(t, vocabulary)))
    for change in changes:
        sign, name = (change[0], change[1:]) if change[:1] in "+-" and change else ("+", change)
        name = vocabulary.canon(name)
        if name:
            out = F.array_remove(out, name) if sign == "-" else F.array_union(out, F.array(F.lit(name)))
    return F.sort_array(out)


def batch_edit(rows: DataFrame, add: Iterable[str], remove: Iterable[str], vocabulary: Vocabulary) -> DataFrame:
    """rows (path, tags) with new_tags and changed. A tag that is both added and removed raises ValueError."""
    adds, removes = {vocabulary.canon(t) for t in add} - {""}, {vocabulary.canon(t) for t in remove} - {""}
    if adds & removes:
        raise ValueError(f"added and removed: {', '.join(sorted(adds & removes))}")
    new = edit("tags", [*(f"+{t}" for t in sorted(adds)), *(f"-{t}" for t in sorted(removes))], vocabulary)
    have = F.transform("tags", lambda t: canon_column(t, vocabulary))
    lit = lambda names: F.array(*[F.lit(t) for t in sorted(names)]).cast("array<string>")
    missing, carried = F.array_except(lit(adds), have), F.array_intersect(lit(removes), have)
    return rows.withColumn("new_tags", new).withColumn("changed", F.size(missing) + F.size(carried) > 0)


def answer_suggestion(tags_col, tag: str, accept: bool) -> Column:
    """Accepting adds the tag and takes its denial off; refusing does the reverse."""
    yes, no = F.lit(tag), F.lit(DENIAL + tag)
    add, drop = (yes, no) if accept else (no, yes)
    return F.sort_array(F.array_union(F.array_remove(tags_col, drop), F.array(add)))


def rename_tag(tags: DataFrame, old: str, new: str | None) -> DataFrame:
    """Hand-written tags with `old` replaced, or deleted if new is None."""
    hand = tags.source == "xmp"
    changed = tags.where(~(hand & (F.col("tag") == old)) if new is None else F.lit(True))
    if new is not None:
        changed = changed.withColumn("tag", F.when((F.col("source") == "xmp") & (F.col("tag") == old), new).otherwise(F.col("tag")))
    return changed.dropDuplicates(["path", "tag", "source"])


def relational_offers(tags_col, modifier: str) -> Column:
    """modifier<t> for each own tag that is neither relational nor a denial nor the modifier."""
    plain = F.filter(tags_col, lambda t: ~t.startswith(DENIAL) & ~t.rlike("<.*>$") & (t != modifier))
    return F.transform(plain, lambda t: F.concat(F.lit(modifier + "<"), t, F.lit(">")))


def act_on_requests(tags: DataFrame, requests: dict[str, str]) -> DataFrame:
    """(path, request, done): action tags that wait, and the tag that replaces each when its pass has run."""
    pairs = tags.sparkSession.createDataFrame([list(x) for x in sorted(requests.items())], "tag string, done string")
    return tags.join(F.broadcast(pairs), "tag").select("path", F.col("tag").alias("request"), "done").distinct()


def is_relational(tag: str) -> bool:
    return relation(tag) is not None

"""Threshold-scaled sketches: of a text's shingle hashes those below a fixed share of all values are kept.

Which hashes are kept doesn't depend on the text, so sketches merge by union and tell how much of one text another
holds, however unequal the two are in length. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import plain_names, shuffle_width, table

WORDS = 5
#: One hash in 8 is kept.
SCALE_BITS = 3
#: Neighbouring rows are brought together in so many runs for each shuffle partition.
_RUNS = 4


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, words: int = WORDS, scale_bits: int = SCALE_BITS) -> Column:
    """struct(n, whole, kept): shingles, a hash of the whole sequence of words, and the distinct hashes kept, ascending.

    Words are runs without white space, lower case. A shingle's hash is xxhash64 over its words' xxhash64. A text of
    fewer words has one shingle, all of it; null or a text without words has none.
    """
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), "")

    def of(w: Column) -> Column:
        last = F.size(w) - words + 1
        many = F.transform(F.slice(w, 1, F.greatest(last, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, words)]))
        shingles = F.when(last > 0, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        kept = F.filter(shingles, lambda h: F.shiftrightunsigned(h, 64 - scale_bits) == 0) if scale_bits else shingles
        n = F.greatest(last, F.least(F.size(w), F.lit(1)))
        return F.struct(n.alias("n"), F.xxhash64(w).alias("whole"), F.sort_array(F.array_distinct(kept)).alias("kept"))

    return let(F.transform(found, lambda x: F.xxhash64(x)), of)


def merged(a: Column, b: Column) -> Column:
    """The kept hashes of two texts together."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """The share of text a's shingles that text b has, by their sketches, 0 to 1. Where nothing of a was kept: 1 if their words are the same, else 0."""
    same = F.when(a["whole"] == b["whole"], 1.0).otherwise(0.0)
    return F.when(F.size(a["kept"]) > 0, F.size(F.array_intersect(a["kept"], b["kept"])) / F.size(a["kept"])).otherwise(same)


def jaccard(a: Column, b: Column) -> Column:
    """The share of the shingles of both texts that both have; without any kept as in containment."""
    same = F.when(a["whole"] == b["whole"], 1.0).otherwise(0.0)
    both = F.size(F.array_intersect(a["kept"], b["kept"]))
    either = F.size(a["kept"]) + F.size(b["kept"]) - both
    return F.when(either > 0, both / either).otherwise(same)


def fingerprint(s: Column) -> Column:
    """The sketch as text: shingles, whole and kept hashes in 16 hex digits each."""
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat_ws(":", s["n"].cast("string"), digits(s["whole"]), F.array_join(F.transform(s["kept"], digits), ""))


def _run_of(value: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending bounds aren't above the value (0 for null), looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, isqrt(len(bounds)))
    rows = [list(bounds[i : i + step]) for i in range(0, len(bounds), step)]
    row = F.size(F.filter(F.lit([r[0] for r in rows]), lambda b: b <= value)) - 1
    row = F.coalesce(F.greatest(row, F.lit(0)), F.lit(0))
    return row * step + F.size(F.filter(F.get(F.array(*[F.lit(r) for r in rows]), row), lambda b: b <= value))


def with_next(df: DataFrame, order: str, ties: str, take: Sequence[str]) -> DataFrame:
    """df with next_<c> of the row that comes next by (order, ties), nulls first; the last row's next is the first.

    Rows are dealt out in runs of the number `order`, cut at its quantiles, so each goes through one shuffle. A run's
    last row finds its next in a copy of the first rows of the run after it. To the driver come the cuts and each run's
    first number, as many as there are runs. Rows that share a number stay in one run.
    """
    spark = df.sparkSession
    runs = _RUNS * shuffle_width(spark)
    value = F.col(order).cast("double")
    cuts = df.select(value.alias("v")).approxQuantile("v", [i / runs for i in range(1, runs)], 1 / (4 * runs))
    run = _run_of(value, sorted({c for c in cuts if c is not None}))
    heads = df.select(F.col(order).alias("v"), run.alias("run")).groupBy("run").agg(F.min("v").alias("v"), F.count_if(F.col("v").isNull()).alias("nulls")).orderBy("run").collect()
    firsts = [None if h["nulls"] else h["v"] for h in heads]
    before = [(firsts[k], heads[k - 1]["run"]) for k in range(len(heads))]
    kind = df.schema[order].dataType.simpleString()
    guests = spark.createDataFrame(before, f"__first {kind}, __to int")
    rows = df.withColumn("__run", run).join(F.broadcast(guests), F.col(order).eqNullSafe(F.col("__first")), "left")
    places = F.array_compact(F.array(F.struct(F.lit(False).alias("guest"), F.col("__run").alias("run")), F.when(F.col("__to").isNotNull(), F.struct(F.lit(True).alias("guest"), F.col("__to").alias("run")))))
    rows = rows.select(*df.columns, F.explode(places).alias("__p")).select(*df.columns, "__p.*")
    along = Window.partitionBy("run").orderBy("guest", F.asc_nulls_first(order), F.asc_nulls_first(ties))
    return rows.select("guest", *df.columns, *[F.lead(c).over(along).alias(f"next_{c}") for c in take]).where("NOT guest").drop("guest")


def edited_documents(docs: DataFrame, words: int = WORDS, scale_bits: int = SCALE_BITS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, jaccard_edited, jaccard_next) of (doc_id, text).

    The edited text has its last half replaced by as much of the beginning of the next document's. near: containment of
    the text in the other. A null text is empty; rows that share a doc_id are neighbours, ordered by text; null ids come
    first; one row alone is its own next; no rows give no rows; other columns are left out.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("s", sketch(F.col("text"), words, scale_bits)), "doc_id", "text", ["text", "s"])
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.col("n_chars").cast("int") - F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), half), F.substr("next_text", F.lit(1), F.col("n_chars").cast("int") - half))
    rows = rows.select("doc_id", "n_chars", "s", F.col("next_s").alias("x"), edited.alias("edited"))
    s, x = F.col("s"), F.col("x")
    told = let(sketch(F.col("edited"), words, scale_bits), lambda e: F.struct(fingerprint(e).alias("f"), containment(s, e).alias("near"), jaccard(s, e).alias("jaccard")))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "s", "x", told.alias("e"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(s).alias("fingerprint"), F.col("e.f").alias("edited_fingerprint"), F.col("e.near").alias("near_edited"), containment(s, x).alias("near_next"),
        F.col("e.jaccard").alias("jaccard_edited"), jaccard(s, x).alias("jaccard_next"),
    )


def op11_scaled_sketch(spark, sf_dir: str) -> DataFrame:
    """All documents and their edited texts."""
    return edited_documents(plain_names(table(spark, sf_dir, "documents"), ["doc_id", "text"]))

"""A bitmap index of tags: files have numbers, and a tag's files are words of 64 bits, combined by AND, OR and NOT."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from . import query as q
from .catalog import Catalog
from .compiler import tag_test, to_column

#: Files a word; longs rather than the longer bitmaps of bitmap_construct_agg, since only they have a NOT and combine within a row.
WORD = 64


def words_of(rows: DataFrame, *by: str) -> DataFrame:
    """(by, word, bits) of rows (by, number): a bit for each number."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("number") % WORD).cast("int"))
    return rows.groupBy(*by, F.expr(f"number div {WORD}").alias("word")).agg(F.bit_or(bit).alias("bits"))


def numbers_of(words: DataFrame) -> DataFrame:
    """(number) of (word, bits)."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftrightunsigned", F.col("bits"), i).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return words.select("word", "bits", F.explode(places).alias("at")).select((F.col("word") * WORD + F.col("at")).alias("number"))


class Postings:
    """numbers (path, number) and words (tag, word, bits); the rows without a tag say which numbers there are."""

    def __init__(self, numbers: DataFrame, words: DataFrame):
        self.numbers, self.words = numbers, words

    @classmethod
    def build(cls, catalog: Catalog) -> Postings:
        """Files are numbered by path, so that a folder's files share words; numbering and each tag's words are spread over all tasks."""
        numbers = numbered(catalog.files().select("path"), ["path"])
        rows = catalog.table("tags").select("path", "tag").join(numbers, "path").select("tag", "number")
        return cls(numbers, words_of(rows, "tag").unionByName(words_of(numbers.withColumn("tag", F.lit(None).cast("string")), "tag")))

    def write(self, folder: str) -> None:
        """As Parquet, sorted by tag, so that a search reads the row groups of its tags."""
        self.numbers.write.parquet(f"{folder}/numbers")
        width = int(self.words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.words.repartitionByRange(width, "tag", "word").sortWithinPartitions("tag", "word").write.parquet(f"{folder}/words")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Postings:
        return cls(spark.read.parquet(f"{folder}/numbers"), spark.read.parquet(f"{folder}/words"))

    def hits(self, tree, canon: Callable[[str], str] = lambda t: t, files: DataFrame | None = None) -> DataFrame:
        """(word, bits) of the files that a tree of tags matches; leaves on fields need files, whose matches become bits.

        One pass over the words of the tags asked for: an aggregate for each leaf by word, then the tree as bitwise
        operations. Texts and likeness aren't in files' rows and raise ValueError.
        """
        leaves = {t: f"b{k}" for k, t in enumerate(dict.fromkeys(q.walk(tree))) if not isinstance(t, q.All)}
        tags = {t: tag_test(t, canon, F.col("tag")) for t in leaves if not isinstance(t, q.Field)}
        rows = self.words.where(reduce(or_, tags.values(), F.col("tag").isNull()))
        sums = [F.bit_or(F.when(F.col("tag").isNull(), F.col("bits"))).alias("every"), *[F.bit_or(F.when(test, F.col("bits"))).alias(leaves[t]) for t, test in tags.items()]]
        out = rows.groupBy("word").agg(*sums)
        fields = [t for t in leaves if isinstance(t, q.Field)]
        if any(t.name in ("text", "similar") for t in fields) or fields and files is None:
            raise ValueError("the index answers for tags and, given files, for their fields")
        if fields:
            found = files.select("path", *[F.coalesce(to_column(t), F.lit(False)).alias(leaves[t]) for t in fields])
            found = found.where(reduce(or_, [F.col(leaves[t]) for t in fields])).join(self.numbers, "path")
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("number") % WORD).cast("int"))
            found = found.groupBy(F.expr(f"number div {WORD}").alias("word")).agg(*[F.bit_or(F.when(F.col(leaves[t]), bit)).alias(leaves[t]) for t in fields])
            out = out.join(found, "word", "left")

        def build(t) -> Column:
            if isinstance(t, q.All):
                return F.col("every")
            if isinstance(t, q.Not):
                return F.col("every").bitwiseAND(F.bitwise_not(build(t.item)))
            if isinstance(t, q.And):
                return build(t.left).bitwiseAND(build(t.right))
            if isinstance(t, q.Or):
                return build(t.left).bitwiseOR(build(t.right))
            return F.coalesce(leaves[t], F.lit(0).cast("bigint"))

        return out.where("every IS NOT NULL").select("word", build(tree).alias("bits")).where("bits <> 0")

    def search(self, text: str, canon: Callable[[str], str] = lambda t: t, files: DataFrame | None = None) -> DataFrame:
        """(path) of the files that a query matches."""
        return numbers_of(self.hits(q.parse(text), canon, files)).join(self.numbers, "number").select("path")

    def count(self, text: str, canon: Callable[[str], str] = lambda t: t, files: DataFrame | None = None) -> DataFrame:
        """(n): how many files a query matches, from the bits alone."""
        return self.hits(q.parse(text), canon, files).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("n"))

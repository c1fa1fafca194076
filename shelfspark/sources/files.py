"""Folders of files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import dimensions
from ..functions.names import animated_png, content_id, sniff
from ..operators.tagging import folder_tags
from ..operators.vocabulary import Vocabulary


def _relative(root: str):
    """The path below root, whatever scheme the reader writes before it."""
    bare = root.split(":", 1)[-1].rstrip("/").lstrip("/")
    return F.expr(f"substring(path, locate('{bare}/', path) + {len(bare) + 1})")


def binary(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def listing(spark: SparkSession, root: str, source: str = "main") -> DataFrame:
    """(path, size, mtime); the contents aren't read."""
    raw = binary(spark, root).select("path", "modificationTime", "length")
    return raw.select(F.concat(F.lit(source + "/"), _relative(root)).alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def scan(spark: SparkSession, root: str, source: str = "main") -> DataFrame:
    """Rows of the files table with folder tags, from bytes alone: dimensions by the headers of images (0 for AVIF), embedded metadata is for the caller to join."""
    raw = binary(spark, root)
    path = F.concat(F.lit(source + "/"), _relative(root))
    made = F.unix_micros("modificationTime") / 1e6
    kind = F.col("format")
    rows = raw.select(path.alias("path"), made.alias("mtime"), F.col("length").alias("size"), F.when(animated_png(F.col("content")), "apng").otherwise(sniff(F.col("content"))).alias("format"), content_id(F.col("content"), "b").alias("id"), dimensions(F.col("content")).alias("dims"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)\z", 1))
    rows = rows.withColumn("format", F.when((kind == "other") & (ext != ""), ext).otherwise(kind))
    what = F.when(F.col("format").isin("jpeg", "png", "webp", "gif", "avif", "apng"), "image").when(F.col("format").isin("mp4", "mkv"), "video").otherwise("other")
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    return rows.select(
        "id", "path", "format", what.alias("kind"), F.col("dims.width").alias("width"), F.col("dims.height").alias("height"), "size", "mtime", F.col("mtime").alias("created_at"), F.lit(0.0).alias("tagged_at"),
        zero.alias("xmp_tag_count"), F.col("mtime").alias("indexed_at"), F.lit(False).alias("text_in_file"), none.alias("xmp_tags"), folder_tags().alias("folder_tags"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("manual"),
    )


def vocabulary(path: str) -> Vocabulary:
    """A rule file of the driver; a missing one is empty."""
    try:
        with open(path, encoding="utf-8") as f:
            return Vocabulary.loads(f.read())
    except FileNotFoundError:
        return Vocabulary()


def foreign_tags(spark: SparkSession, path: str) -> DataFrame:
    """(tag, count) of a cached JSON list of {name, images}; names over 200 bytes are left out."""
    raw = spark.read.schema("name string, images bigint").option("multiLine", True).json(path)
    return raw.where((F.octet_length("name") <= 200) & F.col("name").isNotNull()).select(F.col("name").alias("tag"), F.coalesce("images", F.lit(0)).alias("count"))


def _swapped(hexed):
    """Eight hex digits with their four bytes in reverse order."""
    return F.concat(*[F.substr(hexed, F.lit(at), F.lit(2)) for at in (7, 5, 3, 1)])


def vectors_from_bytes(blobs: DataFrame, dim: int = 512) -> DataFrame:
    """(path, vector) of (path, blob): little-endian floats; blobs of another length are left out."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(_swapped(F.hex(F.substr("blob", i * 4 + 1, F.lit(4)))), 16, 10).cast("bigint"))

    def number(b):
        sign = F.when(F.shiftright(b, 31) == 1, -1.0).otherwise(1.0)
        power, part = F.shiftright(b, 23).bitwiseAND(F.lit(255)), b.bitwiseAND(F.lit((1 << 23) - 1))
        normal = (part / float(1 << 23) + 1.0) * F.pow(F.lit(2.0), power - 127)
        return (sign * F.when(power == 0, part * 2.0**-149).otherwise(normal)).cast("float")

    return blobs.where(F.octet_length("blob") == 4 * dim).select("path", F.transform(bits, number).alias("vector"))

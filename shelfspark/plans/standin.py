"""The collection that the star-schema tables stand for: documents as files, labels as tags, embeddings as hashes and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog

DAY = 86400.0
START = 1546300800.0


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def path_col():
    return F.concat_ws("/", F.lit("main"), "lang", "source", F.concat(F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".txt")))


def kind_col():
    return F.when(F.col("doc_id") % 10 == 0, "video").when(F.col("doc_id") % 10 == 1, "other").otherwise("image")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.lit(True).alias("labelled"), (F.lit(1) + F.col("toxic")).alias("n_tags"))
    image = F.col("kind") == "image"
    made = F.lit(START) + F.col("doc_id") * DAY
    return (
        docs(spark, sf_dir)
        .join(labels, "doc_id", "left")
        .withColumn("kind", kind_col())
        .select(
            "doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("id"), path_col().alias("path"), F.col("lang").alias("format"), "kind",
            F.when(image, F.col("n_chars") % 3000 + 1).otherwise(0).cast("bigint").alias("width"), F.when(image, F.col("n_chars") % 2000 + 1).otherwise(0).cast("bigint").alias("height"),
            F.col("n_chars").alias("size"), made.alias("mtime"), made.alias("created_at"), F.when(F.col("labelled"), made + 3600).otherwise(0.0).alias("tagged_at"),
            F.coalesce("n_tags", F.lit(0)).cast("bigint").alias("xmp_tag_count"), made.alias("indexed_at"), F.lit(False).alias("text_in_file"),
        )
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-written tags from labels, folder tags from the path, implied ones from fixed rules."""
    base = docs(spark, sf_dir).select("doc_id", path_col().alias("path"), "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    named = base.join(labels, "doc_id")
    own = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality:good").when(F.col("quality") == 0, "quality:poor"), F.when(F.col("toxic") == 1, "toxic")))
    xmp = named.select("path", F.explode(own).alias("tag"), F.lit("xmp").alias("source"))
    folder = base.select("path", F.explode(F.array(F.concat(F.lit("folder:"), "lang"), F.concat(F.lit("folder:"), "source"))).alias("tag"), F.lit("folder").alias("source"))
    implied = named.where("toxic = 1").select("path", F.explode(F.array(F.lit("flagged"), F.lit("review"))).alias("tag"), F.lit("implied").alias("source"))
    english = base.where("lang = 'en'").select("path", F.lit("lang:english").alias("tag"), F.lit("implied").alias("source"))
    return xmp.union(folder).union(implied).union(english)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(path_col().alias("path"), F.when(F.col("doc_id") % 37 == 0, "").otherwise(F.col("text")).alias("body"))


def manual_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where("doc_id % 50 IN (0, 25)")
    return d.select(path_col().alias("path"), F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.concat(F.lit("REVIEWED "), "text")).alias("body"))


def text_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where("doc_id % 4 <> 0")
    return d.select(path_col().alias("path"), F.concat(F.lit("e"), (F.col("doc_id") % 3).cast("string")).alias("engine"), (F.lit(1700000000.0) + F.col("doc_id")).alias("read_at"), ((F.col("n_chars") % 100) / 10.0).alias("secs"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """63 sign bits of each embedding in h0; the other words are zero."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("bigint"), lambda a, i: a + F.when(F.get("embedding", i) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    zero = F.lit(0).cast("bigint")
    return e.select("vec_id", F.concat(F.lit("main/v/"), F.lpad(F.col("vec_id").cast("string"), 7, "0")).alias("path"), bits.alias("h0"), zero.alias("h1"), zero.alias("h2"), zero.alias("h3"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", "label", F.concat(F.lit("main/v/"), F.lpad(F.col("vec_id").cast("string"), 7, "0")).alias("path"), F.col("embedding").alias("vector"))


def catalog(spark: SparkSession, sf_dir: str, scope=None) -> Catalog:
    tables = {"files": files, "tags": tags, "text": texts, "manual_text": manual_texts, "text_meta": text_meta, "hashes": hashes, "vectors": vectors}
    return Catalog(spark, {k: f(spark, sf_dir) for k, f in tables.items()}, scope)

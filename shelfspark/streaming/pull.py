"""Ingestion as a stream: listings and tag uses that arrive as files are merged in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import add_counts, guards, upsert
from ..schema import TABLES, empty
from ..sources.store import read_tables, write_tables


def latest(batch: DataFrame) -> DataFrame:
    """(path, size, mtime, deleted): of each path the last row by (arrival, mtime), whatever order rows come in; a deletion without a time comes after the rows it arrives with."""
    when = F.coalesce("mtime", F.when(F.coalesce("deleted", F.lit(False)), F.lit(float("inf"))))
    last = F.max_by(F.struct("size", "mtime", "deleted"), F.struct("arrival", when, F.coalesce("deleted", F.lit(False)), "size"))
    return batch.groupBy("path").agg(last.alias("r")).select("path", "r.*")


def merged_listing(files: DataFrame, batch: DataFrame, force: bool = False) -> DataFrame:
    """files after a batch of (path, size, mtime, deleted, arrival). A mass deletion (over 50 files and over a twentieth) deletes nothing unless forced."""
    rows = latest(batch)
    fresh = rows.where("NOT coalesce(deleted, false)")
    gone = rows.where("coalesce(deleted, false)").select("path")
    known = files.select("path", *[c for c in files.columns if c not in ("path", "size", "mtime")])
    out = upsert(files, fresh.join(known, "path", "left").select(*files.columns))
    total, lost = files.count(), files.join(gone, "path", "left_semi").count()
    return out.join(gone, "path", "left_anti") if guards(total, lost, max(1, total), force=force).delete else out


def stream_listing(spark: SparkSession, incoming: str, folder: str, checkpoint: str, force: bool = False) -> StreamingQuery:
    """Parquet files of (path, size, mtime, deleted) under incoming, merged into the files table of the store at folder; what is there is taken once and the query ends.

    A batch that is run again after a failure merges to the same tables, since a row replaces what its path had.
    """
    rows = spark.readStream.schema("path string, size bigint, mtime double, deleted boolean").parquet(incoming)
    rows = rows.select("*", F.col("_metadata.file_modification_time").alias("arrival"))

    def merge(batch: DataFrame, _: int) -> None:
        tables = read_tables(spark, folder)
        files = tables.get("files")
        write_tables(spark, folder, tables | {"files": merged_listing(empty(spark, "files") if files is None else files, batch, force)}, touched=batch.select("path"))

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_tag_history(spark: SparkSession, incoming: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of (tag) under incoming counted into the tag history of the store at folder.

    The batch number is kept in a table of its own beside the counts, in the same version of the store, so a batch that
    is run again is not counted twice.
    """
    rows = spark.readStream.schema("tag string").parquet(incoming)

    def count(batch: DataFrame, number: int) -> None:
        tables = read_tables(spark, folder)
        seen, old = tables.get("batches"), tables.get("tag_history")
        if seen is not None and not seen.where((F.col("stream") == "tag_history") & (F.col("batch") >= number)).isEmpty():
            return
        used = batch.groupBy("tag").agg(F.count("*").alias("uses"))
        mark = spark.createDataFrame([["tag_history", number]], TABLES["batches"])
        others = mark if seen is None else upsert(seen, mark, ["stream"])
        write_tables(spark, folder, tables | {"tag_history": used if old is None else add_counts(old, used), "batches": others})

    return rows.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tag_history(spark: SparkSession, folder: str) -> DataFrame:
    return read_tables(spark, folder)["tag_history"]

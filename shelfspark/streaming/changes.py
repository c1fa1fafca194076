"""Ingestion as a stream of changes: what is known of a path or tag is kept in Spark's keyed state, and a batch writes only the rows that it changed.

A log is a folder of Parquet: changes/batch=N has the changes of micro-batch N, held/batch=N deletions that the guard kept
back, released/batch=N those let through afterwards, base/upto=N the rows as of batch N. A batch that runs again after a
failure starts from the state before it and replaces its own folder, so it leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.ingest import guards
from ..sources.store import _fs

_LISTED = "path string, size bigint, mtime double, deleted boolean"
_CHANGES = "path string, change string, size bigint, mtime double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _null(x):
    """A cell of pandas as Python has it, missing ones as None."""
    return None if x is None or x is pd.NaT or x != x else x


class Listed(StatefulProcessor):
    """Of one path the last row by (arrival, mtime, deleted, size); says new, changed (size or mtime not exactly equal) or gone where that differs from what was known."""

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "arrival bigint, time double, gone boolean, size bigint, mtime double")

    @staticmethod
    def order(row):
        arrival, time, gone, size, _ = row
        least = lambda x: (x is not None, x or 0)
        return least(arrival), least(time), gone, least(size)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(map(_null, self.known.get())) if self.known.exists() else None
        last = old
        for part in rows:
            for arrival, mtime, gone, size in zip(part["arrival"], part["mtime"], part["deleted"], part["size"]):
                gone, mtime, size = bool(_null(gone)), _null(mtime), _null(size)
                time = float("inf") if mtime is None and gone else mtime
                row = (int(arrival), time, gone, None if size is None else int(size), mtime)
                if last is None or self.order(row) > self.order(last):
                    last = row
        if last == old:
            return
        self.known.update(last)
        before, after = old is not None and not old[2], not last[2]
        if before and after and old[3:] == last[3:] or not before and not after:
            return
        change = "gone" if not after else "changed" if before else "new"
        yield pd.DataFrame({"path": [key[0]], "change": [change], "size": pd.array([last[3] if after else None], dtype="Int64"), "mtime": [last[4] if after else None]})

    def close(self) -> None:
        pass


def listing_changes(rows: DataFrame) -> DataFrame:
    """(path, change, size, mtime) of a stream of (path, size, mtime, deleted, arrival), in update mode; needs RocksDB as the session's state store."""
    keyed = rows.where("path IS NOT NULL").groupBy("path")
    return keyed.transformWithStateInPandas(Listed(), _CHANGES, "Update", "None")


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the finished parts of a log, ascending."""
    fs, _, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    whole = [n for n in names if n.startswith(prefix) and fs.exists(_fs(spark, f"{folder}/{n}/_SUCCESS")[2])]
    return sorted(int(n[len(prefix) :]) for n in whole)


def _rows(spark: SparkSession, log: str, schema: str) -> tuple[DataFrame, int]:
    """The rows of a log that are still to be folded, with their batch, and the newest batch."""
    schema = schema + ", batch bigint"
    upto = max(_numbers(spark, f"{log}/base", "upto="), default=-1)
    fresh = _numbers(spark, f"{log}/changes", "batch=")
    parts = [f"{log}/base/upto={upto}"] if upto >= 0 else []
    parts += [f"{log}/changes/batch={n}" for n in fresh if n > upto] + [f"{log}/released/batch={n}" for n in _numbers(spark, f"{log}/released", "batch=")]
    rows = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return rows, max([upto, *fresh])


def _write(rows: DataFrame, path: str, batch: int) -> None:
    rows.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(path)


def _folded_listing(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("path").agg(F.max_by(F.struct("change", "size", "mtime", "batch"), F.struct("batch", F.col("change") == "gone")).alias("r"))
    return last.select("path", "r.*").where("change <> 'gone'")


def listed(spark: SparkSession, log: str) -> DataFrame:
    """(path, size, mtime) of the files there, by one aggregate over the rows since the last base."""
    return _folded_listing(_rows(spark, log, _CHANGES)[0]).select("path", "size", "mtime")


def _start(spark: SparkSession, changes: DataFrame, mode: str, checkpoint: str, put) -> StreamingQuery:
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps the setting that it was started with
    try:
        return changes.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def stream_listing(spark: SparkSession, incoming: str, log: str, checkpoint: str, force: bool = False) -> StreamingQuery:
    """Parquet files of (path, size, mtime, deleted) under incoming as changes of the log; what is there is taken once and the query ends.

    A batch that would delete over 50 files and over a twentieth of them has its deletions held back unless forced
    (release lets them through); only then are the log's rows counted.
    """
    rows = spark.readStream.schema(_LISTED).parquet(incoming).select("*", F.unix_micros(F.col("_metadata.file_modification_time")).alias("arrival"))

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            gone = batch.where("change = 'gone'")
            lost, held = gone.count(), False
            if lost > 50:
                # of a batch that runs again, its own earlier rows don't count
                total = _folded_listing(_rows(spark, log, _CHANGES)[0].where(F.col("batch") < number)).count()
                held = not guards(total, lost, max(1, total), force=force).delete
            if held:
                _write(gone, f"{log}/held/batch={number}", number)
            _write(batch.where("change <> 'gone'") if held else batch, f"{log}/changes/batch={number}", number)
        finally:
            batch.unpersist()

    return _start(spark, listing_changes(rows), "update", checkpoint, put)


def held(spark: SparkSession, log: str) -> list[int]:
    """Batches whose deletions wait for release."""
    return [n for n in _numbers(spark, f"{log}/held", "batch=") if n not in _numbers(spark, f"{log}/released", "batch=")]


def release(spark: SparkSession, log: str, batch: int) -> None:
    """Lets a batch's deletions through; paths that came back after it stay."""
    spark.read.schema(_CHANGES + ", batch bigint").parquet(f"{log}/held/batch={batch}").write.mode("overwrite").parquet(f"{log}/released/batch={batch}")


def compact(spark: SparkSession, log: str) -> None:
    """A base of the rows so far, between runs of the stream; later reads skip the changes before it."""
    rows, newest = _rows(spark, log, _CHANGES)
    if newest >= 0 and newest not in _numbers(spark, f"{log}/base", "upto="):
        _folded_listing(rows).select("path", "change", "size", "mtime", "batch").write.mode("overwrite").parquet(f"{log}/base/upto={newest}")


def tag_totals(rows: DataFrame) -> DataFrame:
    """(tag, uses) of a stream of (tag): in update mode, the totals of the tags in each batch. A built-in aggregate whose state is one number a tag."""
    return rows.where("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("uses"))


def stream_tag_uses(spark: SparkSession, incoming: str, log: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of (tag) under incoming, counted; a batch writes the new totals of its own tags."""
    rows = spark.readStream.schema("tag string").parquet(incoming)
    return _start(spark, tag_totals(rows), "update", checkpoint, lambda batch, number: _write(batch, f"{log}/changes/batch={number}", number))


def tag_uses(spark: SparkSession, log: str) -> DataFrame:
    """(tag, uses): of each tag the newest total."""
    return _rows(spark, log, "tag string, uses bigint")[0].groupBy("tag").agg(F.max_by("uses", "batch").alias("uses"))

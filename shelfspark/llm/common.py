"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names its shared folder in spark.checkpoint.dir; only a session within one machine may do without and gets a folder that goes with it."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="shelfspark-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: lineage ends there and any executor can read it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(col) -> "F.Column":
    """Text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def crc_of_id(col: str = "doc_id"):
    """crc32 of an id written as decimal text, the fold of the labelled splits; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def plain_names(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Only the wanted columns, so that extra columns can't clash with those an operator adds."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def give_back() -> None:
    """Returns the memory that a worker has freed to the machine, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of an Arrow batch between Spark and a worker, unless the session sets its own; by default Spark takes 64 MB.
_BATCH = "4194304b"


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with small batches and workers that give memory back; for DataFrame.transform."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == "67108864b":
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH)

    def tidy(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def sliced(batches, text_at: int, most_bytes: int = 4 << 20):
    """Record batches cut so that the binary column at text_at holds about most_bytes (one longer text alone): bounds what a Python worker holds."""
    for batch in batches:
        col = batch.column(text_at)
        size = np.fromiter((len(t.as_buffer()) if t.is_valid else 0 for t in col), dtype=np.int64, count=len(col))
        bucket = np.cumsum(size) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(col)]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield batch.slice(s, e - s)


def blobs(column):
    """The values of a binary column as bytes; null is empty."""
    for t in column:
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


class IdFilter:
    """A Bloom filter (two probes) over bigint ids: says of an id "perhaps" or "not there".

    It has 16 bits or more for each id, up to _MOST (8 MB). It only thins what is shuffled before an exact join; when
    very many ids fill it, it lets all through.
    """

    _LEAST, _MOST = 1 << 16, 1 << 26
    _SLICES = 8

    def __init__(self, shared):
        self.shared = shared

    @classmethod
    def of(cls, df: DataFrame, col: str) -> IdFilter:
        size = min(cls._MOST, max(cls._LEAST, 1 << (16 * df.count()).bit_length()))
        width, slices = size // 8, cls._SLICES

        def mark(batches):
            bits = np.zeros(size, dtype=bool)
            for batch in batches:
                for probe in _probes(batch.column(0).drop_null().to_numpy(zero_copy_only=False), size):
                    bits[probe] = True
            yield _packed_slices(np.packbits(bits), slices)

        def either(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    part = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8)
                    sums[k] = sums[k] | part if k in sums else part
            for k, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress(v.tobytes(), 1)], pa.binary())], names=["slice", "bits"])

        kind = "slice int, bits binary"
        rows = df.select(F.col(col).cast("bigint")).transform(arrow_map, mark, kind).repartition(slices, "slice").transform(arrow_map, either, kind).collect()
        bits = np.zeros(width, dtype=np.uint8)
        for r in rows:
            bits[r["slice"] * (width // slices) : (r["slice"] + 1) * (width // slices)] = np.frombuffer(zstandard.decompress(bytes(r["bits"])), dtype=np.uint8)
        return cls(df.sparkSession.sparkContext.broadcast(bits))

    def holds(self, ids: np.ndarray) -> np.ndarray:
        bits, out = self.shared.value, np.ones(len(ids), dtype=bool)
        for probe in _probes(ids, 8 * len(bits)):
            out &= (bits[probe >> 3] >> (7 - (probe & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def _probes(ids: np.ndarray, size: int):
    x, shift = ids.astype(np.int64).view(np.uint64), np.uint64(64 - (size.bit_length() - 1))
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = (x ^ (x >> np.uint64(31))) * np.uint64(salt)
        yield ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift).astype(np.int64)


def _packed_slices(total: np.ndarray, slices: int) -> pa.RecordBatch:
    parts = total.reshape(slices, -1)
    return pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["slice", "bits"])


def maybe_in(df: DataFrame, ids: IdFilter, col: str, there: bool = True) -> DataFrame:
    """Rows of df whose id may be in the filter; there=False: the others, which are surely not in it (null ids too)."""

    @F.arrow_udf("boolean")
    def held(x: pa.Array) -> pa.Array:
        return pa.array(ids.holds(x.to_numpy(zero_copy_only=False)))

    value = F.col(f"`{col}`").cast("bigint")
    test = held(F.coalesce(value, F.lit(0).cast("bigint"))) & value.isNotNull()
    return df.where(test if there else ~test)

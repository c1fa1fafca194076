"""K-d tree sharding: nodes are split at exact weighted medians along their widest metadata dimension.

All open nodes of a level are split at once: rows are range-partitioned and sorted by (node, value of the node's widest
dimension, id), each partition adds up its weights as it goes, and the sums of the partitions, a row for each partition
and node, say where in its node every row stands. Values are compared as they are, whatever their type. A level ends in
a checkpoint; the driver sees one row for each node and one for each partition.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, checkpointed, plain_names, shuffle_width, table

#: Tables of nodes and partitions up to so many rows are broadcast.
_SMALL = 100_000


def _places(df: DataFrame, group: str, order: list[str], weight: str) -> tuple[DataFrame, list]:
    """df with __pid and __cum, the weight of its group so far in its partition, checkpointed; and (partition, group, weight) of all partitions."""
    ranged = df.repartitionByRange(shuffle_width(df.sparkSession), group, *order).sortWithinPartitions(group, *order)
    at, by = df.columns.index(weight), df.columns.index(group)

    def run(batches):
        from pyspark import TaskContext

        pid, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g, w = batch.column(by).to_numpy(), batch.column(at).to_numpy()
            cum, first = np.cumsum(w), np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            before = cum[first] - w[first]
            if g[0] == last:
                before[0] = -total
            cum = cum - np.repeat(before, np.diff(np.append(first, len(g))))
            last, total = g[-1], cum[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(g), pid, np.int32)), pa.array(cum)], names=[*batch.schema.names, "__pid", "__cum"])

    out = checkpointed(ranged.transform(arrow_map, run, T.StructType([*df.schema.fields, T.StructField("__pid", T.IntegerType()), T.StructField("__cum", T.LongType())])))
    sums = out.groupBy("__pid", group).agg(F.max("__cum").alias("w")).collect()
    return out, sorted(((r["__pid"], r[group], r["w"]) for r in sums), key=lambda x: (x[1], x[0]))


def _joined(df: DataFrame, rows: dict[str, list], on: list[str]) -> DataFrame:
    """df with the columns of a table of integers, broadcast while that is small."""
    small = df.sparkSession.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in rows.items()}))
    small = small.select(*[F.col(c).cast(df.schema[c].dataType) if c in on else F.col(c) for c in rows])
    return df.join(F.broadcast(small) if len(rows[on[0]]) <= _SMALL else small, on)


def _ahead(sums: list) -> list[int]:
    """Of each (partition, group, weight), in order, the weight of the group in earlier partitions."""
    out, last, run = [], None, 0
    for _, g, w in sums:
        run = run if g == last else 0
        out.append(run)
        last, run = g, run + w
    return out


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _spreads(df: DataFrame, dims: list[str]) -> list:
    """Aggregates that say how far a node reaches along each dimension: greatest and least of numbers, distinct values of all else."""
    out = [F.sum("__w").alias("w")]
    for i, d in enumerate(dims):
        if _is_number(df, d):
            x = F.col(d).cast("double")
            x = F.when(F.abs(x) < F.lit(math.inf), x)
            out += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        else:
            out += [F.lit(1.0).alias(f"lo{i}"), F.approx_count_distinct(d).cast("double").alias(f"hi{i}")]
    return out


def kd_tree(df: DataFrame, dims: list[str], id_col: str = "doc_id", weight_col: str = "weight", shards: int | None = None, target_bytes: int | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(all rows of df with column `shard`, the splits as (first leaf, leaves, number of the dimension) from the root on).

    shards, or the total weight over target_bytes, gives the number of leaves. A node with k leaves is split at the
    weighted quantile k//2 / k of its widest dimension, the first named on ties. Width is a node's share of the whole
    table's spread: greatest less least of numbers, approximate distinct values of other types. Nulls come first; rows
    of equal value are split by id, then by all that tells them apart, and equal rows anywhere, so weights come out
    near equal whatever the ties: a shard's boundary is off by half a row at most. Null weights are 0. An empty table
    gives an empty result. Other columns come back as they are, but travel at every level, so large ones are better
    joined on afterwards; `shard` replaces a column of that name; names that start with __ are kept free.
    """
    names = df.columns
    keys = [f"__d{i}" for i in range(len(dims))]
    numbers = [f"__k{i}" for i in range(len(dims))]
    work = df.select("*", *[F.col(f"`{c}`").alias(k) for c, k in zip(dims, keys)], F.col(f"`{id_col}`").alias("__tie"), F.coalesce(F.col(f"`{weight_col}`"), F.lit(0)).cast("bigint").alias("__w"), F.lit(0).alias("__node"))
    plain = [f"`{f.name}`" for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    work = checkpointed(work.withColumn("__any", F.xxhash64(*plain) if plain else F.lit(0).cast("bigint")))
    slim = work.columns
    nodes, splits, whole = [(0, shards or 0)], [], None
    while whole is None or any(k > 1 for _, k in nodes):
        stats = {r["__node"]: r for r in work.groupBy("__node").agg(*_spreads(work, keys)).collect()}
        if whole is None:
            if not stats:
                break
            whole = stats[0]
            if not shards:
                nodes = [(0, max(1, -(-int(whole["w"]) // int(target_bytes or whole["w"] or 1))))]
            spread = [(whole[f"hi{i}"] or 0.0) - (whole[f"lo{i}"] or 0.0) or 1.0 for i in range(len(dims))]
            if nodes[0][1] < 2:
                break
        widest, first_child, children = [], [], []
        for at, (first, k) in enumerate(nodes):
            s = stats.get(at)
            wide = [((s[f"hi{i}"] or 0.0) - (s[f"lo{i}"] or 0.0)) / spread[i] if s else 0.0 for i in range(len(dims))]
            widest.append(max(range(len(dims)), key=lambda i: (wide[i], -i)) if dims else -1)
            first_child.append(len(children))
            children += [(first, k // 2), (first + k // 2, k - k // 2)] if k > 1 else [(first, 1)]
            if k > 1:
                splits.append((first, k, widest[-1]))
        keyed = _joined(work, {"__node": list(range(len(nodes))), "__wide": widest}, ["__node"])
        keyed = keyed.select(*slim, *[F.when(F.col("__wide") == i, F.col(c)).alias(n) for i, (c, n) in enumerate(zip(keys, numbers))])
        placed, sums = _places(keyed, "__node", [*numbers, "__tie", "__w", "__any"], "__w")
        # A row goes left if its middle stands before the wanted quantile.
        wanted = [int(stats[g]["w"]) * (nodes[g][1] // 2) // nodes[g][1] if nodes[g][1] > 1 else int(stats[g]["w"]) + 1 for _, g, _ in sums]
        at = {"__pid": [p for p, _, _ in sums], "__node": [g for _, g, _ in sums], "__base": _ahead(sums), "__want": wanted, "__child": [first_child[g] for _, g, _ in sums]}
        right = 2 * (F.col("__base") + F.col("__cum")) - F.col("__w") >= 2 * F.col("__want")
        work = _joined(placed, at, ["__pid", "__node"])
        work = work.withColumn("__node", (F.col("__child") + right.cast("int")).cast("int")).select(*slim)
        nodes = children
    if whole is None or len(nodes) == 1:
        return work.withColumn("shard", F.lit(0)).select(*[f"`{c}`" for c in names if c != "shard"], "shard"), splits
    leaves = _joined(work.drop("shard"), {"__node": list(range(len(nodes))), "shard": [f for f, _ in nodes]}, ["__node"])
    return leaves.withColumn("shard", F.col("shard").cast("int")).select(*[f"`{c}`" for c in names if c != "shard"], "shard"), splits


def kd_shards(df: DataFrame, dims: list[str], id_col: str = "doc_id", weight_col: str = "weight", shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """The rows of kd_tree."""
    return kd_tree(df, dims, id_col, weight_col, shards, target_bytes)[0]


def with_slots(df: DataFrame, shard_col: str = "shard", order_col: str = "doc_id") -> DataFrame:
    """Column `slot`, gapless from 0 in each shard in the order of order_col, without gathering a shard; it replaces a column of that name."""
    names = [c for c in df.columns if c != "slot"]
    placed, sums = _places(df.select(*[f"`{c}`" for c in names], F.lit(1).cast("bigint").alias("__w")), shard_col, [order_col], "__w")
    at = {"__pid": [p for p, _, _ in sums], shard_col: [g for _, g, _ in sums], "__base": _ahead(sums)}
    return _joined(placed, at, ["__pid", shard_col]).select(*[f"`{c}`" for c in names], (F.col("__base") + F.col("__cum") - 1).alias("slot"))


def op2_kd_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, split by source, language, length and id."""
    docs = plain_names(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")
    slim = docs.select("doc_id", "source", "lang", "n_chars", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = kd_shards(slim, ["source", "lang", "n_chars", "doc_id"], weight_col="size", shards=16)
    return with_slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

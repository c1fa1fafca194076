"""Embedding near-duplicates by collision counting: vectors are sorted along many one-dimensional projections, windows centred on each vector are counted as collisions, and pairs with enough of them are verified by cosine."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, plain_names, shuffle_width, table
from .components import components

#: Wanted share of pairs just at the threshold that reach the count.
RECALL = 0.99
#: Vectors that a cell should hold on average; more vectors add sign bits, not larger cells.
CELL = 256
#: Cells above this are dealt out as pairs of blocks.
BLOCK = 1 << 11
_SEED = 20_240_229


def calibrate(dim: int, threshold: float, rows: int, recall: float = RECALL, cell: int = CELL) -> tuple[int, int, float, int]:
    """(projections, sign bits of a cell, half width of a window, least count).

    A projection is a random direction within the cell of `bits` random hyperplanes of its own. A pair at cosine c
    shares a cell with probability (1 - angle / pi) ** bits and lies within the window with that of a normal
    difference of deviation sqrt(2 - 2c); the count is the largest that as many projections reach with the recall.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows) / cell)))
    apart = math.sqrt(2 - 2 * threshold)
    width = 1.5 * apart
    p = (1 - math.acos(threshold) / math.pi) ** bits * math.erf(1.5 / math.sqrt(2))
    count, n = 2, 2
    while 1 - sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(count)) < recall:
        n += 1
    return n, bits, width, count


class Projections:
    """Directions and hyperplanes from a fixed seed, the same in every task."""

    def __init__(self, dim: int, n: int, bits: int):
        rng = np.random.default_rng(_SEED + dim)
        self.n, self.bits = n, bits
        self.lines = rng.standard_normal((dim, n)).astype(np.float32)
        self.planes = rng.standard_normal((dim, n * bits)).astype(np.float32)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places on the lines, cells), each rows x projections, of unit vectors."""
        x = x.astype(np.float32)
        signs = (x @ self.planes > 0).reshape(len(x), self.n, self.bits) if self.bits else np.zeros((len(x), self.n, 0), bool)
        return x @ self.lines, signs @ (1 << np.arange(self.bits, dtype=np.int64)) if self.bits else np.zeros((len(x), self.n), np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cell_links(x: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, table_no: int, make: Projections, width: float, count: int, threshold: float):
    """(links of each row, forest edges) of the pairs (left row, right row) of a cell that first collide at this projection.

    Rows are in order of their place on the projection's line, so a window is a run of rows. A pair is taken up at the
    first projection where it collides and only there, so no pair is verified or counted twice.
    """
    places, cells = make(x)
    line = places[:, table_no]
    found = np.zeros(len(x), dtype=np.int64)
    root, edges = list(range(len(x))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    upto = np.searchsorted(line, line + np.float32(width), "right")
    span = upto - np.arange(len(x)) - 1
    ends = np.cumsum(span)
    start = 0
    while start < len(x):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + (1 << 16), "right")))
        n = span[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        ok = (left[i] & right[j]) | (left[j] & right[i])
        i, j = i[ok], j[ok]
        if len(i):
            hits = (cells[i] == cells[j]) & (np.abs(places[i] - places[j]) <= width)
            ok = ~hits[:, :table_no].any(axis=1) & (hits.sum(axis=1) >= count)
            i, j = i[ok], j[ok]
            alike = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[alike], j[alike]
            np.add.at(found, i, weight[j])
            np.add.at(found, j, weight[i])
            for a, b in zip(i.tolist(), j.tolist()):
                p, q = find(a), find(b)
                if p != q:
                    root[p] = q
                    edges.append((a, b))
        start = stop
    return found, edges


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component, kept) of every row; rows are compared only if their labels are equal and not null.

    Equal vectors of a label are one class with a weight, and are linked to each other; n_links counts rows. A vector
    that is null, zero, or has a null or non-finite component links with nothing and is its own component, as is a row
    with a null label; so does a row whose id is null (component null, kept false). Vectors of different lengths are
    not compared. A repeated id with one vector is one row for each time it comes; it counts as linked to its twins.
    The pairs found depend on the fixed directions; every pair found is verified in double precision.
    """
    spark = vectors.sparkSession
    parts = shuffle_width(spark)
    base = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").alias("label"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("v", lambda e: e != 0), F.lit(False))
    base = base.withColumn("sound", sound)
    classes = checkpointed(base.where("sound").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")))
    shape = classes.groupBy("label", F.size("v").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    plans = {r["dim"]: calibrate(r["dim"], threshold, r["n"], recall) for r in shape}
    if not plans:
        return base.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"), F.col("id").isNotNull().alias("kept"))

    def cells(batches):
        made = {d: Projections(d, n, b) for d, (n, b, _, _) in plans.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, size = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.diff(batch.column(1).offsets.to_numpy())
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                x = flat[starts[rows][:, None] + np.arange(d)]
                _, cell = made[d](_unit(x))
                n = cell.shape[1]
                take = pa.array(np.repeat(rows, n))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(take), d, dtype=np.int32)), batch.column(0).take(take), pa.array(np.tile(np.arange(n, dtype=np.int32), len(rows))), pa.array(cell.ravel()),
                        batch.column(2).take(take), batch.column(3).take(take), batch.column(1).take(take),
                    ],
                    names=["dim", "label", "line", "cell", "rep", "weight", "v"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    key = ["dim", "label", "line", "cell"]
    placed = classes.select("label", "v", "rep", "weight").transform(arrow_map, cells, f"dim int, label {kinds['label']}, line int, cell bigint, rep {kinds['rep']}, weight bigint, v array<double>")
    # A large cell's rows are dealt to blocks; each pair of blocks is a task of its own.
    hot = placed.drop("v").groupBy(*key).count().where(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("p"), F.greatest(b, F.col("own")).alias("q")))
    placed = placed.withColumn("own", own).withColumn("pq", F.explode(pairs)).select(*key, "rep", "weight", "v", "own", "pq.p", "pq.q")
    group = [*key, "p", "q"]
    placed = placed.repartition(parts, *group).sortWithinPartitions(*group)

    def count_up(batches):
        made = {d: Projections(d, n, b) for d, (n, b, _, _) in plans.items()}
        held, held_key = [], None

        def done():
            rows = pa.Table.from_batches(held).combine_chunks()
            d, _, no, _, p, q = held_key
            if rows.num_rows < 2:
                return None
            x = _unit(rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            line = (x.astype(np.float32) @ made[d].lines)[:, no]
            rep = rows.column("rep").to_numpy()
            order = np.lexsort((rep, line))
            x, rep, weight, own = x[order], rep[order], rows.column("weight").to_numpy()[order], rows.column("own").to_numpy()[order]
            _, _, width, least = plans[d]
            found, edges = cell_links(x, weight, own == p, own == q, no, made[d], width, least, threshold)
            some = np.flatnonzero(found)
            if not len(some):
                return None
            a = np.concatenate((rep[some], rep[[i for i, _ in edges]] if edges else rep[:0]))
            b = np.concatenate((rep[some], rep[[j for _, j in edges]] if edges else rep[:0]))
            n = np.concatenate((found[some], np.zeros(len(edges), dtype=np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.names.index(c)) for c in group]
            change = np.ones(batch.num_rows, dtype=bool)
            change[1:] = False
            for c in cols:
                v = c.to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
            cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                k = tuple(c[s].as_py() for c in cols)
                if k != held_key:
                    if held and (out := done()) is not None:
                        yield out
                    held, held_key = [], k
                held.append(batch.slice(s, e - s))
        if held and (out := done()) is not None:
            yield out

    counted = checkpointed(placed.transform(arrow_map, count_up, "a bigint, b bigint, n bigint"))
    links = counted.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comps = components(counted.where("a <> b"))
    of_class = classes.join(links, "rep", "left").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = of_class.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    # -0.0 and 0.0 group as one value, so rows meet their class by the same normal form.
    good = base.where("sound").join(of_class, ["label", "v"]).select("id", "n_links", "component")
    rest = base.where("NOT sound").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return good.union(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))


def op9_collision_projections(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings within a label at cosine 0.93."""
    rows = near_groups(plain_names(table(spark, sf_dir, "embeddings"), ["vec_id", "embedding", "label"]))
    return rows.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")

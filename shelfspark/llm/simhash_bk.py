"""SimHash near-duplicates: fingerprints of word shingles, linked by BK-trees over shards that agree on a band of bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, plain_names, shuffle_width, table
from .components import components

_WHITE = bytes(32 if c in b" \t\n\r\x0b\x0c" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], dtype=np.int64)
_BLOCK = 1 << 16


def normal(data: bytes) -> bytes:
    """A-Z lowered, words joined by single spaces; words are runs without ASCII white space."""
    a = np.frombuffer(data.translate(_WHITE), dtype=np.uint8)
    white = a == 32
    keep = ~white
    keep[1:] |= white[1:] & ~white[:-1]
    return a[keep].tobytes().strip(b" ")


def fingerprint(data: bytes, words: int = 3, bits: int = 64) -> int:
    """64-bit SimHash of the word shingles, repeats included; a text with no word has fingerprint 0."""
    text = normal(data)
    if not text:
        return 0
    gaps = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(text)]))
    if len(starts) >= words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    lanes = np.arange(8, dtype=np.uint16) * 256
    for at in range(0, len(starts), _BLOCK):
        h = np.array([digest(text[s:e], 42) for s, e in zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())], dtype="<u8")
        seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + lanes).ravel(), minlength=2048).reshape(8, 256)
        ones += (seen @ _BITS).ravel()
    on = np.flatnonzero(ones * 2 > len(starts))
    return sum(1 << int(b) for b in on)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed bigint."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).transform(arrow_map, run, f"id {kind}, fp bigint")


class BKTree:
    """Children keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.value: list[int] = []
        self.kids: list[dict[int, int]] = []

    def within(self, x: int, radius: int) -> list[int]:
        """Numbers of the nodes within the radius; only edges from d - radius to d + radius are followed."""
        found, todo = [], [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (self.value[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.kids[at]
            if kids:
                todo += [k for e, k in kids.items() if d - radius <= e <= d + radius]
        return found

    def add(self, x: int) -> int:
        new = len(self.value)
        self.value.append(x)
        self.kids.append({})
        at = 0
        while new:
            d = (self.value[at] ^ x).bit_count()
            child = self.kids[at].get(d)
            if child is None:
                self.kids[at][d] = new
                break
            at = child
        return new


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the values of a shard, as pairs of places."""
    tree, root, out = BKTree(), list(range(len(values))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in tree.within(x, radius):
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((i, j))
        tree.add(x)
    return out


def bands(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of so many bands of the low `bits` bits."""
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _banded(df: DataFrame, radius: int) -> DataFrame:
    """A row for each band: values that differ in at most `radius` bits agree on one of radius + 1 bands."""
    cuts = bands(64, radius + 1)
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("part")) for i, (s, w) in enumerate(cuts)])
    return df.select("fp", "rep", F.explode(keys).alias("k")).select("fp", "rep", "k.band", "k.part")


def _refined(df: DataFrame, radius: int) -> DataFrame:
    """Rows of large shards go to sub-shards: the bits outside the band are cut into bands again, so no link is lost."""
    subs = []
    for i, (s, w) in enumerate(bands(64, radius + 1)):
        rest = F.shiftrightunsigned("fp", s + w) if s + w < 64 else F.lit(0).cast("bigint")
        rest = F.shiftleft(rest, s).bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << s) - 1)))
        subs.append((i, F.array(*[F.struct(F.lit(j).alias("sub"), F.shiftrightunsigned(rest, a).bitwiseAND(F.lit((1 << b) - 1)).alias("more")) for j, (a, b) in enumerate(bands(64 - w, radius + 1))])))
    pick = F.coalesce(*[F.when(F.col("band") == i, x) for i, x in subs])
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("bigint").alias("more")))
    return df.withColumn("s", F.explode(F.when(F.col("large"), pick).otherwise(whole))).select("fp", "rep", "band", "part", "s.sub", "s.more")


def links(reps: DataFrame, radius: int = 2, shard_rows: int = 2048) -> DataFrame:
    """(a, b): links among the rows (fp, rep) of distinct fingerprints, enough to connect all that lie within the radius.

    A shard is the rows that agree on one band; a shard above shard_rows is cut again by bands of its other bits. Each
    shard builds its own tree, searches it for each value and sends the links that join two trees of its forest, so
    neither a shard nor its links grow with the square of a group of near copies.
    """
    rows = _banded(reps, radius)
    hot = rows.groupBy("band", "part").count().where(F.col("count") > shard_rows).select("band", "part", F.lit(True).alias("large"))
    rows = rows.join(hot, ["band", "part"], "left").withColumn("large", F.coalesce("large", F.lit(False)))
    rows = _refined(rows, radius)
    key = ["band", "part", "sub", "more"]
    rows = rows.repartition(shuffle_width(reps.sparkSession), *key).sortWithinPartitions(*key, "fp")

    def run(batches):
        held_key, fps, reps_ = None, [], []

        def done():
            if len(fps) > 1:
                return [(reps_[i], reps_[j]) for i, j in shard_links(fps, radius)]
            return []

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(batch.schema.names.index(n)).to_numpy(zero_copy_only=False) for n in ("fp", "rep", *key)}
            change = np.ones(batch.num_rows, dtype=bool)
            change[1:] = False
            for n in key:
                change[1:] |= cols[n][1:] != cols[n][:-1]
            cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
            out = []
            values, owners = cols["fp"].view(np.uint64), cols["rep"]
            for s, e in zip(cuts, cuts[1:]):
                k = tuple(cols[n][s].item() for n in key)
                if k != held_key:
                    out += done()
                    held_key, fps, reps_ = k, [], []
                fps += values[s:e].tolist()
                reps_ += owners[s:e].tolist()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])
        out = done()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    return rows.transform(arrow_map, run, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component): component is the least id that a row reaches by links of at most `radius` differing bits.

    Rows of one fingerprint are one class, linked through its least id. Null texts count as empty; texts without a
    word have fingerprint zero and link like others. A repeated id keeps its rows. Rows with a null id get a component
    only from rows with an id (else null). No rows give no rows.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, words))
    reps = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    comps = components(links(reps.where("rep IS NOT NULL"), radius))
    of_fp = reps.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return fps.join(of_fp, "fp").select("id", "fp", "component")


def op4_simhash_bk(spark, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: 3-word shingles, links at 2 or fewer differing bits."""
    docs = plain_names(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return simhash_groups(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

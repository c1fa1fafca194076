"""Merkle manifest: a ternary hash tree for each source and over the sources, with every leaf's proof.

Leaves are numbered within their source without gathering it, and dealt out in aligned blocks of 3^7. A first pass brings
each block to its root by a treehash stack, and the block roots are the leaves of the next round, until one node is left.
On the way back a block's task walks its leaves in order: treehash stacks build the next run of every level while the
present one is in use, so the path of a leaf is at hand with logarithmic memory; the path above the block is shared by
all its leaves and comes by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, crc_of_id, plain_names, shuffle_width, table
from .dimension_merge import CRC_SQL, crc_sql

ARITY = 3
#: Levels of a block; it has ARITY ** HEIGHT leaves.
HEIGHT = 7
_STEP = "array<struct<left: string, right: string>>"
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height_of(leaves: int, total: int, most: int = HEIGHT) -> int:
    """Levels that a block of so many leaves goes up: all, or where it is its tree's only one until one node is left."""
    if total > leaves:
        return most
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


class Stack:
    """Treehash: takes leaves one by one and holds at most ARITY - 1 nodes of each level."""

    def __init__(self, height: int):
        self.nodes: list[list[str]] = [[] for _ in range(height + 1)]

    def push(self, node: str) -> None:
        level = 0
        while level < len(self.nodes) - 1:
            self.nodes[level].append(node)
            if len(self.nodes[level]) < ARITY:
                return
            node = digest(*self.nodes[level])
            self.nodes[level] = []
            level += 1
        self.nodes[level].append(node)

    def close(self) -> list[str]:
        """Ends the input: shorter runs are hashed as they are. The nodes of the top level."""
        for level in range(len(self.nodes) - 1):
            if self.nodes[level]:  # at most ARITY nodes: the rest of the input and what closing the level below has added
                self.nodes[level + 1].append(digest(*self.nodes[level]))
                self.nodes[level] = []
        return self.nodes[-1]


def root_of(leaves: Sequence[str], height: int) -> str:
    stack = Stack(height)
    for x in leaves:
        stack.push(x)
    return stack.close()[0]


class _Level:
    """The runs of one level: that in use, and the next, which a treehash stack builds a leaf at a time."""

    def __init__(self, level: int, leaves: Sequence[str]):
        self.level, self.leaves, self.span = level, leaves, ARITY ** (level + 1)
        self.read, self.next = 0, Stack(level)
        for _ in range(self.span):
            self.feed()
        self.turn()

    def feed(self) -> None:
        if self.read < len(self.leaves):
            self.next.push(self.leaves[self.read])
            self.read += 1

    def turn(self) -> None:
        self.run, self.next = list(self.next.close()), Stack(self.level)


def paths(leaves: Sequence[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in turn its path: by level, from the bottom, what stands left and right of it in its run.

    Each step feeds one leaf to the stack of every level, so a run is ready just when the run before it ends.
    """
    levels = [_Level(h, leaves) for h in range(height)]
    for at in range(len(leaves)):
        out = []
        for h, level in enumerate(levels):
            if at and at % level.span == 0:
                level.turn()
            place = at // ARITY**h % ARITY
            out.append(("".join(level.run[:place]), "".join(level.run[place + 1 :])))
            level.feed()
        yield out


def fold(node: str, path: Sequence[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left, node, right)
    return node


def leaf_digest(columns: Sequence[Column]) -> Column:
    """H of the values, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def ranked(nodes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """nodes with rank (gapless from 0 within the key, in the order of the columns, nulls first) and total, the key's rows.

    Sorted by ranges and numbered within each; how many rows of a key the ranges before have comes by a join. The
    result is checkpointed, so numbers stay as they are.
    """
    spark = nodes.sparkSession
    by = [F.asc_nulls_first(c) for c in (key, *order)]
    placed = nodes.repartitionByRange(max(2, shuffle_width(spark)), *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = checkpointed(placed).withColumn("__part", F.shiftright("__at", 33))
    sums = placed.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy("__key")
    before = F.coalesce(F.sum("__n").over(own.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__key", "__p", (before - F.col("__first")).alias("__base"), F.sum("__n").over(own).alias("total"))
    out = placed.join(sums, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")))
    return out.select(*nodes.columns, (F.col("__at") + F.col("__base")).alias("rank"), "total")


def _blocks(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"rank div {ARITY**most}"))


def _sorted(group: pa.Table, most: int) -> tuple[pa.Table, int]:
    group = group.sort_by("rank")
    return group, height_of(group.num_rows, group.column("total")[0].as_py(), most)


def roots(nodes: DataFrame, key: str, most: int = HEIGHT) -> DataFrame:
    """(key, node, rank, total) of the blocks of nodes (key, node, rank, total): the nodes of the next round."""
    kind = nodes.schema[key].dataType.simpleString()

    def climb(group: pa.Table) -> pa.Table:
        group, height = _sorted(group, most)
        node = root_of(group.column("node").to_pylist(), height)
        size = ARITY**most
        total = group.column("total")[0].as_py()
        return pa.table({key: group.column(key)[:1], "node": [node], "rank": pa.array([group.column("rank")[0].as_py() // size], pa.int64()), "total": pa.array([-(-total // size)], pa.int64())})

    return _blocks(nodes.select(key, "node", "rank", "total"), most).groupBy(key, "block").applyInArrow(climb, f"{key} {kind}, node string, rank bigint, total bigint")


def walk(nodes: DataFrame, above: DataFrame, key: str, keep: Sequence[str], visit: Callable, schema: str, most: int = HEIGHT) -> DataFrame:
    """visit(rows of a block in order, path of each, the block's subroot) over all blocks. above: (key, block, path, subroot)."""

    def run(group: pa.Table) -> pa.Table:
        group, height = _sorted(group, most)
        upper = [(s["left"], s["right"]) for s in group.column("path")[0].as_py()]
        own = paths(group.column("node").to_pylist(), height)
        return visit(group, (p + upper for p in own), group.column("subroot")[0].as_py())

    up = above.select(F.col(key).alias("__key"), F.col("block").alias("__block"), "path", "subroot")
    rows = _blocks(nodes.select(*dict.fromkeys([key, "node", "rank", "total", *keep])), most)
    rows = rows.join(up, F.col(key).eqNullSafe(F.col("__key")) & (F.col("block") == F.col("__block"))).drop("__key", "__block")
    return rows.groupBy(key, "block").applyInArrow(run, schema)


def _inner(nodes: DataFrame, above: DataFrame, key: str, most: int) -> DataFrame:
    """(key, block, path, subroot) for the round below: the path of each node, whose rank is the block's number there."""
    kind = nodes.schema[key].dataType.simpleString()

    def visit(group: pa.Table, found, subroot: str) -> pa.Table:
        steps = [[{"left": a, "right": b} for a, b in p] for p in found]
        return pa.table({key: group.column(key), "block": group.column("rank"), "path": pa.array(steps, _STEPS), "subroot": pa.array([subroot] * group.num_rows, pa.string())})

    return walk(nodes, above, key, [], visit, f"{key} {kind}, block bigint, path {_STEP}, subroot string", most)


def _up(nodes: DataFrame, key: str, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of nodes below the top, and the top: one node for each key."""
    rounds = []
    while True:
        rounds.append(nodes)
        nodes = checkpointed(roots(nodes, key, most))
        if nodes.where("total > 1").isEmpty():
            return rounds, nodes


def manifest(leaves: DataFrame, key: str, order: Sequence[str], keep: Sequence[str], visit: Callable, schema: str, height: int = HEIGHT) -> tuple[DataFrame, str | None]:
    """(rows of visit over all leaves, the root) of leaves (key, node, order, keep); an empty table has no root.

    A key's leaves are in the order of the columns, ties by digest; equal leaves count each. A null key is a key of its own
    and the first. Only the root comes to the driver.
    """
    low, subroots = _up(ranked(leaves, key, [*order, "node"]), key, height)
    tops = subroots.select(F.lit(0).alias("__all"), F.col(key).alias("__of"), "node")
    high, root = _up(ranked(tops, "__all", ["__of"]), "__all", height)
    first = root.first()
    none = F.array().cast(_STEP)
    above = root.select("__all", F.lit(0).cast("bigint").alias("block"), none.alias("path"), F.lit("").alias("subroot"))
    for nodes in reversed(high[1:]):
        above = checkpointed(_inner(nodes, above, "__all", height))

    kind = leaves.schema[key].dataType.simpleString()

    def each(group: pa.Table, found, _: str) -> pa.Table:
        steps = [[{"left": a, "right": b} for a, b in p] for p in found]
        return pa.table({"__of": group.column("__of"), "block": pa.array([0] * group.num_rows, pa.int64()), "path": pa.array(steps, _STEPS), "subroot": group.column("node")})

    above = checkpointed(walk(high[0], above, "__all", ["__of"], each, f"__of {kind}, block bigint, path {_STEP}, subroot string", height).withColumnRenamed("__of", key))
    for nodes in reversed(low[1:]):
        above = checkpointed(_inner(nodes, above, key, height))
    return walk(low[0], above, key, keep, visit, schema, height), first["node"] if first else None


def checked_documents(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents, whose trees go by source.

    Where the crc32 of doc_id is even, the leaf that is folded is that of the text without its line feeds. Nulls are `-` in
    a leaf; null ids come first; rows that share an id are leaves of their own, ordered by digest; no rows give no rows.
    """
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = plain_names(docs, names)
    bare = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    harmed = (crc_of_id() % 2 == 0) & F.contains("text", F.lit("\n"))
    leaves = docs.select("doc_id", "source", leaf_digest([F.col(c) for c in names]).alias("node"), F.when(harmed, leaf_digest([*[F.col(c) for c in names[:-1]], bare])).alias("tampered"))

    def visit(group: pa.Table, found, subroot: str) -> pa.Table:
        proof, folded = [], []
        nodes = group.column("node").to_pylist()
        for node, tampered, path in zip(nodes, group.column("tampered").to_pylist(), found):
            proof.append(digest(*[x for step in path for x in step]))
            folded.append(fold(tampered or node, path))
        return pa.table({"doc_id": group.column("doc_id"), "leaf": nodes, "subroot": pa.array([subroot] * len(nodes), pa.string()), "proof_sha256": proof, "folded_root": folded})

    rows, root = manifest(leaves, "source", ["doc_id"], ["doc_id", "tampered"], visit, "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string", height)
    root = F.lit(root).cast("string")
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents by source, with proofs; every second document is checked without its line feeds."""
    return checked_documents(table(spark, sf_dir, "documents"))


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


# A proof is kept as text: by level what stands left and right of the node.
SQL = f"""WITH RECURSIVE {CRC_SQL},
docs AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS tampered FROM documents, crc_table
),
low AS (
  SELECT 0 AS lvl, source, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM docs
  UNION ALL SELECT lvl + 1, source, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY lvl, source, pos // 3
),
subroots AS (SELECT source, node AS subroot FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, subroot AS node, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY lvl, pos // 3
),
low_runs AS (SELECT lvl, source, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM low WHERE n > 1 GROUP BY ALL),
high_runs AS (SELECT lvl, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM high WHERE n > 1 GROUP BY ALL),
up_high AS (
  SELECT 0 AS lvl, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, '' AS sibs, [] :: VARCHAR[] AS path FROM subroots
  UNION ALL
  SELECT u.lvl + 1, u.source, u.pos // 3, u.sibs || array_to_string(list_concat(r.nodes[:u.pos % 3], r.nodes[u.pos % 3 + 2:]), ''),
    list_concat(u.path, [array_to_string(r.nodes[:u.pos % 3], ''), array_to_string(r.nodes[u.pos % 3 + 2:], '')])
  FROM up_high u JOIN high_runs r ON r.lvl = u.lvl AND r.run = u.pos // 3
),
up_low AS (
  SELECT 0 AS lvl, doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, leaf, tampered, '' AS sibs, [] :: VARCHAR[] AS path FROM docs
  UNION ALL
  SELECT u.lvl + 1, u.doc_id, u.source, u.pos // 3, u.leaf, u.tampered, u.sibs || array_to_string(list_concat(r.nodes[:u.pos % 3], r.nodes[u.pos % 3 + 2:]), ''),
    list_concat(u.path, [array_to_string(r.nodes[:u.pos % 3], ''), array_to_string(r.nodes[u.pos % 3 + 2:], '')])
  FROM up_low u JOIN low_runs r ON r.lvl = u.lvl AND r.source IS NOT DISTINCT FROM u.source AND r.run = u.pos // 3
),
top_high AS (SELECT * FROM up_high QUALIFY lvl = max(lvl) OVER ()),
top_low AS (SELECT * FROM up_low QUALIFY lvl = max(lvl) OVER (PARTITION BY source)),
proofs AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT node FROM high WHERE n = 1) AS root, sha256(l.sibs || h.sibs) AS proof_sha256,
    list_reduce(range(len(l.path || h.path) // 2), lambda x, k: sha256((l.path || h.path)[2 * k + 1] || x || (l.path || h.path)[2 * k + 2]), l.tampered) AS folded_root
  FROM top_low l JOIN top_high h ON h.source IS NOT DISTINCT FROM l.source JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
)
SELECT *, folded_root = root AS verified FROM proofs"""

"""Sketches, the Merkle manifest and the dimension merge against brute force."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F
from tests_llm_support import corpus

from shelfspark.llm import dimension_merge, merkle_manifest, scaled_sketch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, s int, x string, run int, guest int, node string, rank int, total int, block int, path string"


def documents(spark, rows, parts=3):
    """rows (doc_id, source, lang, n_chars, text) with columns whose names operators use."""
    return spark.createDataFrame([(i, t, lang, src, n, 1, "x", 2, 3, "n", 4, 5, 6, "p") for i, src, lang, n, t in rows], SCHEMA).repartition(parts)


def mixed(seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "a", "b", "b", "b", "é"]), rng.choice(["en", None]), None if i % 7 == 0 else len(t or ""), t) for i, t in corpus()]
    return rows + [rows[4], (rows[5][0], "b", "en", 1, "another text\nunder the same id"), (None, "a", None, None, "no id\n"), (9_000, "b", "de", 5, "ab cd\n" * 60_000)]


# ---- 11


def _hash(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def _chain(words):
    seed = 42
    for w in words:
        seed = _hash(w.to_bytes(8, "little"), seed)
    return seed


def sketch_by_brute_force(text, words=5, bits=3):
    w = [_hash(x.encode()) for x in re.split(r"[ \t-\r]+", text.lower()) if x]
    shingles = [_chain(w[i : i + words]) for i in range(len(w) - words + 1)] or ([_chain(w)] if w else [])
    return len(shingles), _chain(w), sorted({h for h in shingles if h >> (64 - bits) == 0}, key=lambda h: h - (1 << 64) if h >> 63 else h)


def contained(a, b):
    return len({*a[2]} & {*b[2]}) / len(a[2]) if a[2] else float(a[1] == b[1])


def edits_by_brute_force(rows, bits):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (sketch_by_brute_force(x, bits=bits) for x in (t, edited, after))
        prints = [f"{n}:{whole:016x}:" + "".join(f"{h:016x}" for h in kept) for n, whole, kept in (a, b)]
        yield (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints, contained(a, b), contained(a, c))


@pytest.mark.parametrize("bits", [0, 3])
def test_sketches(spark, bits):
    rows = mixed()
    got = scaled_sketch.edited_documents(documents(spark, rows), scale_bits=bits).drop("jaccard_edited", "jaccard_next")
    order = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(edits_by_brute_force([(r[0], r[4]) for r in rows], bits), key=order)


def test_sketches_of_few_rows(spark):
    assert scaled_sketch.edited_documents(documents(spark, [])).count() == 0
    one = scaled_sketch.edited_documents(documents(spark, [(4, None, None, None, "a b c d e f")])).collect()
    assert [(r["n_chars"], r["near_next"], r["edited_sha256"]) for r in one] == [(11, 1.0, hashlib.sha256(b"a b c a b c").hexdigest())]
    same = scaled_sketch.edited_documents(documents(spark, [(i, None, None, None, None) for i in range(5)])).collect()
    assert {(r["near_edited"], r["near_next"], r["fingerprint"]) for r in same} == {(1.0, 1.0, same[0]["fingerprint"])}


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    rows = [(" ".join(words[:30_000]), " ".join(words[30_000:]), " ".join(words), " ".join(words[1_000:3_000] + [f"v{k}" for k in range(2_000)]))]
    df = spark.createDataFrame(rows, "a string, b string, whole string, part string")
    s = {c: scaled_sketch.sketch(F.col(c)) for c in df.columns}
    r = df.select(F.size(scaled_sketch.merged(s["a"]["kept"], s["b"]["kept"])).alias("both"), F.size(s["whole"]["kept"]).alias("whole"), scaled_sketch.containment(s["part"], s["whole"]).alias("part"), scaled_sketch.jaccard(s["a"], s["whole"]).alias("j")).first()
    assert 0 <= r["whole"] - r["both"] <= 4  # the shingles over the cut
    assert abs(r["part"] - 0.5) < 0.08 and abs(r["j"] - 0.75) < 0.03



@pytest.mark.parametrize("n", [0, 1, 2, 5, 30])
def test_run_lookup(spark, n):
    bounds = sorted(random.Random(n).sample(range(100), n))
    got = spark.range(-2, 103).select("id", scaled_sketch._run_of(F.col("id").cast("double"), [float(b) for b in bounds]).alias("run")).collect()
    assert [r["run"] for r in got] == [sum(b <= r["id"] for b in bounds) for r in got]


# ---- 12


def manifest_by_brute_force(rows):
    sha = lambda *p: hashlib.sha256("".join(p).encode()).hexdigest()
    leaf = lambda r, t: sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], t)])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            yield "".join(run[: i % 3]), "".join(run[i % 3 + 1 :])
            i //= 3

    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))):
        by.setdefault(r[1], []).append(r)
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([leaf(r, r[4]) for r in by[k]]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    for n, k in enumerate(keys):
        for i, r in enumerate(by[k]):
            steps = [*path(trees[k], i), *path(top, n)]
            tampered = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0 and r[4] is not None
            node = leaf(r, r[4].replace("\n", "") if tampered else r[4])
            for a, b in steps:
                node = sha(a, node, b)
            yield (r[0], leaf(r, r[4]), trees[k][-1][0], top[-1][0], sha(*[x for s in steps for x in s]), node, node == top[-1][0])


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(spark, height):
    rows = mixed()
    got = merkle_manifest.checked_documents(documents(spark, rows), height).collect()
    assert sorted(map(tuple, got), key=str) == sorted(manifest_by_brute_force(rows), key=str)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    assert merkle_manifest.checked_documents(documents(spark, [])).count() == 0
    for rows in ([(1, None, None, None, None)], [(i, "s", "en", 1, "t\n") for i in range(4)], [(i, f"s{i}", "en", 1, "t\n") for i in range(11)]):
        assert sorted(map(tuple, merkle_manifest.checked_documents(documents(spark, rows), 2).collect())) == sorted(manifest_by_brute_force(rows))


def test_treehash():
    sha = merkle_manifest.digest
    for n in [*range(1, 31), 80, 81, 82]:
        leaves = [str(i) for i in range(n)]
        for height in {merkle_manifest.height_of(n, n), 4, 5}:
            nodes = leaves
            for _ in range(height):
                nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
            assert merkle_manifest.root_of(leaves, height) == nodes[0]
            if len(nodes) == 1:
                assert {merkle_manifest.fold(x, p) for x, p in zip(leaves, merkle_manifest.paths(leaves, height))} == {nodes[0]}


def test_treehash_memory():
    """No level holds more than its run and what is being built: leaves aside, memory is a few nodes for each level."""
    levels = [merkle_manifest._Level(h, [str(i) for i in range(3**6)]) for h in range(6)]
    for at in range(3**6):
        for level in levels:
            if at and at % level.span == 0:
                level.turn()
            level.feed()
            assert sum(map(len, level.next.nodes)) + len(level.run) <= 3 + 2 * level.level + 3


# ---- 13


def versions_by_brute_force(rows, inherit):
    """rows (key, change_id, seq, op, at, attributes)."""
    out = []
    rows = {r for r in rows if r[4] is not None}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        known = sorted((r for r in mine if r[3] in ("D", "I", "U")), key=lambda r: (r[1] is None, r[1] or 0))
        one, seen = [], set()
        for r in known:
            if r[2] is None or r[2] not in seen:
                one.append(r)
            seen.add(r[2])
        at = {}
        for r in sorted(one, key=lambda r: (r[2] is not None, r[2] or 0, r[1] is not None, -(r[1] or 0))):
            at[r[4]] = r
        state, spans = None, []
        for t, (_, _, seq, op, _, values) in sorted(at.items()):
            old = state[1:] if state and inherit and op == "U" and not state[0] else (None,) * len(values)
            new = (True, *[None] * len(values)) if op == "D" else (False, *[o if v is None else v for v, o in zip(values, old)])
            if new != state:
                spans.append((t, new, seq))
            state = new
        for k, (t, new, seq) in enumerate(spans):
            end = spans[k + 1][0] if k + 1 < len(spans) else None
            n = len({r[1] for r in mine if r[1] is not None and r[4] >= t and (end is None or r[4] < end)})
            out.append((key, k + 1, t, end, *new, seq, n))
    return out


def changes(seed, n=700, nulls=True):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        key = rng.choice([1, 1, 1, 1, 2, 3, 4, None if nulls else 5])
        seq = None if nulls and rng.random() < 0.03 else c + rng.choice([0, 0, 0, 1, -1])
        op = rng.choice("UUUUUID") if not nulls or rng.random() > 0.03 else rng.choice([None, "X"])
        time = None if rng.random() < 0.02 else rng.randint(-30, 90) * 3_600_000_000 + rng.choice([0, 0, 1])
        rows.append((key, None if nulls and rng.random() < 0.02 else c, seq, op, time, (rng.choice(["a", "b", None]), rng.choice([1, None]))))
        if rng.random() < 0.1:
            rows.append(rows[-1])
        if nulls and rng.random() < 0.05:  # the same change at another time
            rows.append((*rows[-1][:2], None, "U", rng.randint(-30, 90) * 3_600_000_000, ("a", None)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("inherit", "part_rows", "width"), [(True, 3, 24), (False, 1_000, 24), (True, 1_000, 7), (True, 1_000, 10_000)])
def test_versions(spark, monkeypatch, inherit, part_rows, width):
    monkeypatch.setattr(dimension_merge, "PART_ROWS", part_rows)
    rows = changes(width + inherit)
    df = spark.createDataFrame([(k, c, s, o, t, *a, "x", 1, 2) for k, c, s, o, t, a in rows], "client bigint, change_id bigint, seq bigint, op string, at bigint, city string, money int, version string, z int, k int").repartition(3)
    got = dimension_merge.versions(df, "client", ["city", "money"], inherit, width * 3_600_000_000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(versions_by_brute_force(rows, inherit), key=str)


def test_versions_of_nothing(spark):
    kind = "client bigint, change_id bigint, seq bigint, op string, at bigint, city string"
    assert dimension_merge.versions(spark.createDataFrame([], kind), "client", ["city"]).count() == 0
    rows = [(1, 1, 1, "U", None, "a"), (1, 2, 2, None, 5, "a")]
    assert dimension_merge.versions(spark.createDataFrame(rows, kind), "client", ["city"]).count() == 0


def test_a_deletion_ends_what_updates_inherit(spark):
    rows = [(1, 1, 1, "I", 0, "a"), (1, 2, 2, "D", 10, "b"), (1, 3, 3, "U", dimension_merge.WEEK * 3, None), (1, 4, 4, "U", dimension_merge.WEEK * 5, "c"), (1, 5, 5, "U", dimension_merge.WEEK * 9, None)]
    df = spark.createDataFrame(rows, "client bigint, change_id bigint, seq bigint, op string, at bigint, city string")
    got = {inherit: [(r["is_deleted"], r["city"], r["n_changes"]) for r in dimension_merge.versions(df, "client", ["city"], inherit).orderBy("version").collect()] for inherit in (True, False)}
    assert got == {True: [(False, "a", 1), (True, None, 1), (False, None, 1), (False, "c", 2)], False: [(False, "a", 1), (True, None, 1), (False, None, 1), (False, "c", 1), (False, None, 1)]}


def test_times_without_a_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00.5' AS a, TIMESTAMP'2024-01-01 00:00:00Z' AS b, TIMESTAMP_NTZ'1969-12-31 23:59:59' AS c")
    assert tuple(df.select(*[dimension_merge.micros(df, c) for c in df.columns]).first()) == (1_704_067_200_500_000, 1_704_067_200_000_000, -1_000_000)

"""Passes over a log, closures of edge tables and hold-outs, against brute force."""

import random

import pytest

from shelfspark.operators import ranking, reading, tagging


def passes_by_brute_force(log, run, limit):
    out = {}
    for by in {r[0] for r in log}:
        row = attempts = errors = 0
        stopped = False
        for _, _, outcome in sorted(r for r in log if r[0] == by):
            attempts += outcome in ("ok", "error")
            errors += outcome == "error"
            row = row + 1 if outcome == "error" else 0
            stopped = row == run
            if stopped or limit and attempts == limit:
                break
        out[by] = (attempts, errors, stopped)
    return out


@pytest.mark.parametrize("run, limit, chunk", [(3, 0, 7), (3, 12, 7), (2, 5, 1000), (1, 0, 4), (20, 0, 32), (4, 9, 4)])
def test_passes(spark, monkeypatch, run, limit, chunk):
    """Chunks shorter than a pass: runs that cross them are found once, and never across two passes."""
    monkeypatch.setattr(reading, "_CHUNK", chunk)
    rng = random.Random(run + limit)
    odds = {e: rng.choice([0.1, 0.5, 0.95]) for e in "abcdef"}
    log = [(e, k, "error" if rng.random() < odds[e] else rng.choice(["ok", "skip", None])) for e in odds for k in range(rng.randint(1, 60))]
    log += [("only skips", 1, "skip")]
    rng.shuffle(log)
    got = reading.passes(spark.createDataFrame(log, "engine string, k int, outcome string"), "engine", ["k"], run, limit).collect()
    want = passes_by_brute_force([(e, k, o or "skip") for e, k, o in log], run, limit)
    assert {r["engine"]: (r["attempts"], r["errors"], r["stopped"]) for r in got} == want and len(got) == len(want)


def test_no_log(spark):
    assert reading.passes(spark.createDataFrame([], "engine string, k int, outcome string"), "engine", ["k"]).count() == 0


@pytest.mark.parametrize("n, edges", [(1, 0), (6, 4), (9, 14), (14, 20)])
def test_closure(spark, n, edges):
    """Warshall's algorithm gives the same; loops, cycles, repeats and nulls end."""
    rng = random.Random(n)
    pairs = [(f"t{rng.randrange(n)}", f"t{rng.randrange(n)}") for _ in range(edges)] + [("t0", None), (None, "t0")]
    reach = {p for p in pairs if None not in p}
    for k in [f"t{i}" for i in range(n)]:
        reach |= {(a, b) for a, c in reach if c == k for d, b in reach if d == k}
    got = [tuple(r) for r in tagging.closure(spark.createDataFrame(pairs, "tag string, to string")).collect()]
    assert sorted(got) == sorted((a, b) for a, b in reach if a != b)


def test_feedback(spark):
    """Rejected offers are gone from the second round, and what is like them has fallen."""
    rng = random.Random(4)
    rows = [(f"v{k:02}", [1.0, rng.random(), 0.0] if k < 12 else [0.9, 0.0, rng.random() * 2]) for k in range(40)]
    vectors = spark.createDataFrame(rows, "path string, vector array<float>")
    members = spark.createDataFrame([(f"v{k:02}",) for k in range(12)] * 2, "path string")
    parts = {r["path"]: r["hidden"] for r in ranking.hide_third(members, 3).collect()}
    assert len(parts) == 12 and sum(parts.values()) == 4 and parts != {r["path"]: r["hidden"] for r in ranking.hide_third(members, 4).collect()}
    assert not any(r["hidden"] for r in ranking.hide_third(members.where("path < 'v02'")).collect())
    shown, hidden = (spark.createDataFrame([(p,) for p, h in parts.items() if h == x], "path string") for x in (False, True))
    one, two = (r.collect() for r in ranking.feedback(vectors, shown, hidden, 5, vectors=vectors, mode="image"))
    wrong = [r["path"] for r in one if not parts.get(r["path"])][:5]
    assert len(one) == 32 and {r["path"] for r in one} - {r["path"] for r in two} == set(wrong)
    place = lambda rows: sum(k for k, r in enumerate(rows) if parts.get(r["path"]))
    assert place(two) <= place(one)


def test_rejects_and_modes(spark):
    rejects = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p")], "tag string, path string")
    assert sorted(tuple(r) for r in ranking.unreject(rejects, "a", spark.createDataFrame([("p",), ("p",), ("z",)], "path string")).collect()) == [("a", "q"), ("b", "p")]
    modes = ranking.remember_mode(spark.createDataFrame([("a", "text")], "tag string, mode string"), "b", "both")
    assert sorted(tuple(r) for r in ranking.remember_mode(modes, "a", "image").collect()) == [("a", "image"), ("b", "both")]
    with pytest.raises(ValueError):
        ranking.remember_mode(modes, "a", "other")


def test_tag_only_import(spark):
    from shelfspark.operators import ingest
    from shelfspark.schema import TABLES, empty

    kind = TABLES["files"] + ", xmp_tags array<string>, folder_tags array<string>, text string, manual boolean"
    scan = lambda tags, text, manual: spark.createDataFrame([("1" * 16, "main/p", "png", "image", 1, 1, 1, 1.0, 1.0, 0.0, len(tags), 1.0, None, tags, [], text, manual)], kind)
    tables = {k: empty(spark, k) for k in TABLES} | {"text": spark.createDataFrame([("main/p", "read by a machine")], TABLES["text"])}
    none = lambda tags: tags.where("false").select("path", "tag")
    out = ingest.import_tags(tables, scan(["cat"], "of the file", False), none)
    assert [tuple(r) for r in out["text"].collect()] == [("main/p", "read by a machine")] and out["files"].first()["text_in_file"] is True
    assert [tuple(r) for r in out["tags"].collect()] == [("main/p", "cat", "xmp")]
    out = ingest.import_tags(tables, scan(["cat"], "reviewed", True), none)
    assert [tuple(r) for r in out["manual_text"].collect()] == [("main/p", "reviewed")]

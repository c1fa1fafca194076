import random

import pytest

from shelfspark.functions.hashes import blob_of, signed, words_of
from shelfspark.operators import ranking, rules, similarity
from shelfspark.operators.vocabulary import Vocabulary, diff, merge
from shelfspark.schema import TABLES, empty

RULES = "kind string, name string, target string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(v):
    return [("alias", a, b) for a, b in v.aliases.items()] + [("implies", a, b) for a, b in v.implications] + [("suggests", a, b) for a, b in v.suggestions] + [("category", t, c) for t, c in v.categories.items()] + [("colour", c, h) for c, h in v.colors.items()]


def lines(found):
    words = {"alias": "{} = {}", "implies": "{} ⇒ {}", "suggests": "{} suggests {}", "category": "{} is a {}", "colour": "{} is tinted {}"}
    return sorted(words[k].format(a, b) for k, a, b in found)


def made(rng):
    few = lambda n: rng.sample("abcdefgh", n)
    return Vocabulary.of(
        aliases=dict(zip(few(2), few(2))), implications={x: few(2) for x in few(3)}, suggestions={x: few(1) for x in few(2)},
        categories={"one": few(1), "two": few(1)}, colors={rng.choice(["one", "two"]): rng.choice(["#101010", "#202020"])},
    )


@pytest.mark.parametrize("seed", range(4))
def test_against_the_vocabulary(spark, seed):
    rng = random.Random(seed)
    mine, other = made(rng), made(rng)
    a, b = spark.createDataFrame(table(mine), RULES), spark.createDataFrame(table(other) * 2, RULES)
    both, clashes = merge(mine, other)
    got = rules.merged(a, b).collect()
    assert lines(tuple(r)[:3] for r in got) == sorted(both.lines())
    assert sorted((r["name"], r["target"], r["clash"]) for r in got if r["clash"]) == clashes
    got = rules.compared(a, b).collect()
    assert tuple(lines(tuple(r)[1:] for r in got if r["side"] == s) for s in ("mine", "other")) == diff(mine, other)
    for old, new in (("a", "b"), ("b", "zz"), ("c", "c"), ("none", "d")):
        assert lines(tuple(r) for r in rules.renamed(a, old, new).collect()) == sorted(mine.rename(old, new).vocabulary.lines())


def test_nulls_repeats_and_nothing(spark):
    some = spark.createDataFrame([("alias", "a", "y"), ("alias", "a", "x"), ("alias", None, "x"), (None, "a", "x"), ("implies", "a", None)], RULES)
    none = spark.createDataFrame([], RULES)
    assert rows(rules.clean(some)) == [("alias", "a", "x")] and rows(rules.merged(some, none)) == [("alias", "a", "x", None)]
    assert rows(rules.compared(none, some)) == [("other", "alias", "a", "x")] and rows(rules.renamed(none, "a", "b")) == []


def test_blobs_and_words(spark):
    words = [[signed(x) for x in w] for w in ([0, 1, 2, 3], [(1 << 64) - 1, 1 << 63, 255, 1 << 40])]
    df = spark.createDataFrame([(str(k), *w) for k, w in enumerate(words)], TABLES["hashes"])
    back = df.select("path", words_of(blob_of()).alias("w")).select("path", "w.*")
    assert rows(back) == rows(df)
    assert spark.createDataFrame([[b"short"], [None]], "b binary").select(words_of("b").alias("w")).where("w IS NOT NULL").count() == 0


def test_the_closest_beyond_the_bound(spark):
    df = spark.createDataFrame([(p, h, 0, 0, 0) for p, h in (("a", 0), ("b", 1), ("d", 7), ("c", 14), ("e", None))], TABLES["hashes"])
    report = lambda n: tuple(similarity.nearest_report(df, (0, 0, 0, 0), n).first())
    assert report(1) == (2, 4, "c", 3) and report(3) == (4, 4, None, None)
    assert tuple(similarity.nearest_report(df.limit(0), (0, 0, 0, 0)).first()) == (0, 0, None, None)


def test_modes(spark):
    modes = ranking.remember_mode(empty(spark, "modes"), "cat", "both")
    assert [ranking.mode_of(modes, t) for t in ("cat", "dog")] == ["both", "image"]
    tags = spark.createDataFrame([("a", "cat", "xmp"), ("b", "cat", "folder"), ("t", "dog", "xmp")], TABLES["tags"])
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], TABLES["vectors"])
    texts = spark.createDataFrame([("a", "red sun"), ("b", "blue sea"), ("c", "red sun"), ("t", "blue sea")], "path string, text string")
    files = texts.select("path")
    go = lambda tag, rejects=(), **more: [r["path"] for r in ranking.propose_for(tag, tags, files, vectors, texts, spark.createDataFrame(list(rejects), TABLES["rejects"]), modes, **more).collect()]
    assert go("cat", mode="image") == ["b", "c"] and go("cat", mode="text")[0] == "c" and set(go("cat")) == {"b", "c", "t"}
    assert go("cat", [("cat", "b"), ("dog", "c")], mode="image") == ["c"]
    assert go("dog", mode="text")[0] == "b"
    for tag, more in (("none", {}), ("dog", {}), ("dog", {"mode": "text", "need_vector": True}), ("cat", {"mode": "smell"})):
        with pytest.raises(ValueError):
            go(tag, **more)


def test_parts_of_queries(spark):
    from shelfspark.plans.logs import query_parts

    texts = ["similar:a@5 || (similar:b, -similar:a@9)", "(cat", "", None, "cat, -bi", "similar:x@99999999999"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n int, t string")
    got = [(r["valid"], [tuple(s) for s in r["similar"]] if r["similar"] is not None else None, r["typed"]) for r in df.orderBy("n").select(query_parts(df["t"]).alias("q")).select("q.*").collect()]
    assert got == [(True, [("a", 5), ("b", 20)], None), (False, [], "cat"), (True, [], None), (None, None, None), (True, [], "bi"), (True, [("x", 2**31 - 1)], None)]
    assert df.limit(0).select(query_parts(df["t"])).collect() == []


def test_texts_to_write(spark):
    from shelfspark.operators.reading import embed_work

    files = spark.createDataFrame([(f"main/{p}", "image") for p in "abcde"] + [("other/x", "image"), ("main/v", "video")], "path string, kind string")
    text = spark.createDataFrame([(p, "t") for p in ("main/a", "main/b", "main/c", "main/d", "other/x", "main/v", "main/gone")] + [("main/e", "")], TABLES["text"])
    held = spark.createDataFrame([("main/a", True, "x"), ("main/b", False, "t"), ("main/c", None, None)], "path string, reviewed boolean, file_text string")
    go = lambda *a: [r["path"] for r in embed_work(files, text, held, *a).collect()]
    assert go() == ["main/c", "main/d", "other/x"] and go("main") == ["main/c", "main/d"] and go("main", 1) == ["main/c"] and go("oth") == []

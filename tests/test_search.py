import pytest

from shelfspark.operators.vocabulary import Vocabulary
from shelfspark.plans.catalog import Catalog, in_scope
from shelfspark.schema import TABLES


def file_row(path, **kw):
    row = dict(id="0" * 16, path=path, format="png", kind="image", width=10, height=10, size=100, mtime=1.0, created_at=1.0, tagged_at=0.0, xmp_tag_count=0, indexed_at=1.0, text_in_file=False) | kw
    return tuple(row[c.split()[0]] for c in TABLES["files"].split(", "))


@pytest.fixture(scope="module")
def words(spark):
    rows = [
        ("instead of coffee", "tea", 0), ("the team", "tea", 0), ("Tea", "tea", 1), ("cup of tea.", "tea", 1), ("TEA\nPARTY", "tea", 1), ("", "tea", 0),
        ("green\ntea, please", "green tea", 1), ("green, tea", "green tea", 1), ("green teapot", "green tea", 0), ("don't panic", "don't", 1), ("don't panic", "dont", 0),
        ("tea and team", "te*", 1), ("instead", "te*", 0), ("instead", "*tea*", 1), ("green tea", "gr* t?a", 1), ("green teapot", "gr* t?a", 0), ("tea", "", 0), ("tea", " . ", 0),
        ("ЧАЙ ÉTÉ", "чай", 1), ("ЧАЙ ÉTÉ", "été", 1), ("ЧАЙ ÉTÉ", "чай été", 1),
    ]
    return rows


def test_whole_words(spark, words):
    for k, (text, value, want) in enumerate(words):
        c = Catalog(spark, {"files": spark.createDataFrame([file_row("main/a")], TABLES["files"]), "text": spark.createDataFrame([("main/a", text)], TABLES["text"])})
        words[k] = (c.search(f"text.word:{value}", columns=["path"]), want, (text, value))
    out = None
    from pyspark.sql import functions as F

    for k, (df, _, _) in enumerate(words):
        row = df.select(F.lit(k).alias("k"))
        out = row if out is None else out.union(row)
    got = {r["k"] for r in out.collect()}
    assert [w[2] for k, w in enumerate(words) if (k in got) != bool(w[1])] == []


@pytest.fixture(scope="module")
def catalog(spark):
    files = [
        file_row("main/golden/a.png", width=0, height=0, size=1_600_000, created_at=1546300800.0),
        file_row("main/b.webm", format="mkv", kind="video", width=640, created_at=1577836800.0, xmp_tag_count=2, id="ab" + "0" * 14),
        file_row("disk/old/c.jpeg", format="jpeg", width=1920, created_at=5.0, tagged_at=10.0),
    ]
    tags = [("main/b.webm", "toxic", "xmp"), ("main/b.webm", "big cat", "xmp"), ("disk/old/c.jpeg", "folder:old", "folder")]
    text = [("main/golden/a.png", "machine words"), ("main/b.webm", "Some\nTEXT here"), ("disk/old/c.jpeg", "kept")]
    manual = [("main/golden/a.png", "")]
    hashes = [("main/golden/a.png", 0, 0, 0, 0), ("main/b.webm", 7, 0, 0, 0), ("disk/old/c.jpeg", -1, -1, -1, 0)]
    frame = lambda name, rows: spark.createDataFrame(rows, TABLES[name])
    return Catalog(spark, {"files": frame("files", files), "tags": frame("tags", tags), "text": frame("text", text), "manual_text": frame("manual_text", manual), "hashes": frame("hashes", hashes)})


A, B, C = "main/golden/a.png", "main/b.webm", "disk/old/c.jpeg"


@pytest.mark.parametrize("query, want", [
    ("", {A, B, C}), ("width.lt:500", set()), ("width:0", {A}), ("width.lt:700", {B}), ("width.gte:1.92k", {C}), ("NOT folder:old", {A, B}), ("path:*old*", {A, C}), ("path:OLD/", {C}),
    ("format:webm", {B}), ("format:jpg", {C}), ("kind:VIDEO", {B}), ("id:ab", {B}), ("id:AB", set()), ("source:DISK", {C}), ("size.gt:1.5m", {A}), ("size.gt:1.5mb", {A}), ("size.gt:2m", set()),
    ("size.gt:x", set()), ("-size.gt:x", {A, B, C}), ("tag_count.gte:2", {B}), ("big c*", {B}), ('"big c*"', set()), ("poison", {B}), ("text:some text", {B}), ("text:", {A, B, C}), ("text:machine", set()),
    ("text:some*here", {B}), ("text:*text", set()), ("created_at:2019", {A}), ("created_at.gte:2020", {B}), ("tagged_at.lt:1971", {A, B, C}), ("similar:main/golden/a.png@3", {A, B}),
    ("similar:main/golden/a.png@2", {A}), ("-similar:main/golden/a.png", {C}), ("format.gt:png", {A}), ("nofield:x", set()),
])
def test_predicates(catalog, query, want):
    v = Vocabulary.of(aliases={"poison": "toxic"})
    assert {r["path"] for r in catalog.search(query, v.canon, columns=["path"]).collect()} == want


def test_order_and_precedence(catalog):
    assert [r["path"] for r in catalog.all().select("path").collect()] == [B, A, C]
    assert {r["path"]: r["text"] for r in catalog.all().collect()} == {A: "", B: "Some\nTEXT here", C: "kept"}
    near = catalog.search("similar:main/b.webm@9", columns=["path"], by_similarity=True)
    assert [r["path"] for r in near.collect()] == [B, A]
    with pytest.raises(ValueError):
        catalog.search("similar:disk/old/c.jpeg")  # a flat hash says nothing


def test_only_needed_tables_are_read(catalog):
    plan = catalog.search("kind:video", columns=["path"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_scope(spark):
    rows = spark.createDataFrame([("photos/cats/a.png",), ("photos/cats2/a.png",), ("photos/cats/private/x.png",), ("photos/dogs/a.png",), ("z.png",)], "path string")
    inside = lambda inc, exc=(): {r[0] for r in rows.where(in_scope("path", inc, list(exc))).collect()}
    assert inside(["photos/cats"], ["photos/cats/private"]) == {"photos/cats/a.png"}
    assert inside([]) == set()
    assert inside([".", "photos/cats"], ["photos"]) == {"photos/cats/a.png", "photos/cats/private/x.png", "z.png"}

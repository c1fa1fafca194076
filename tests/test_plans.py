"""What searches read and move, and the bitmap index against the catalogue."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_search import file_row

from shelfspark.operators.ranks import numbered
from shelfspark.plans import query as q
from shelfspark.plans.catalog import Catalog
from shelfspark.plans.compiler import to_column
from shelfspark.plans.postings import Postings
from shelfspark.schema import TABLES
from shelfspark.sources import store


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(5)
    paths = [f"main/{rng.choice('abc')}/{k:04}.png" for k in range(400)]
    files = [file_row(p, size=rng.randrange(5000), width=rng.randrange(900), xmp_tag_count=rng.randrange(4), id=f"{rng.getrandbits(64):016x}", kind=rng.choice(["image", "video"]), created_at=1546300800.0 + rng.randrange(10**8)) for p in paths]
    tags = [(p, t, "xmp") for p in paths for t in ("cat", "dog", "big cat", "red") if rng.random() < 0.3]
    texts = [(p, rng.choice(["", "tea time", "the team\nplays", "Tea"])) for p in paths if rng.random() < 0.7]
    manual = [(p, rng.choice(["", "tea again"])) for p in paths if rng.random() < 0.2]
    folder = str(tmp_path_factory.mktemp("plans") / "store")
    frame = lambda name, rows: spark.createDataFrame(rows, TABLES[name])
    store.write_tables(spark, folder, {"files": frame("files", files), "tags": frame("tags", tags), "text": frame("text", texts), "manual_text": frame("manual_text", manual)})
    return Catalog.read(spark, folder), [dict(zip([c.split()[0] for c in TABLES["files"].split(", ")], f)) for f in files], tags, dict(texts), dict(manual)


@pytest.mark.parametrize("query, pushed", [
    ("created_at:2019", "GreaterThanOrEqual(created_at"), ("size.gt:1.5kb", "GreaterThan(size,1500)"), ("size.lte:1.0005k", "LessThanOrEqual(size,1000)"), ("kind:Video", "EqualTo(kind,video)"),
    ("id:ab", "StringStartsWith(id,ab)"), ("tag_count:0", "EqualTo(xmp_tag_count,0)"), ("width.lt:500 || width:0", "Or("), ("format:webm", "In(format"), ("cat", "EqualTo(tag,cat)"), ("cat || dog", "EqualTo(tag,dog)"),
    ("size.gt:10, text:tea, red", "GreaterThan(size,10)"),
])
def test_filters_reach_the_scan(stored, query, pushed):
    assert any(pushed in x for x in re.findall(r"PushedFilters: \[.*?\], ReadSchema", plan(stored[0].search(query, columns=["path"]))))


@pytest.mark.parametrize("query", ["cat, -dog", "text:tea", "text.word:tea || cat", "-(text:tea*, red)"])
def test_only_flags_travel(stored, query):
    """No tag lists, and no exchange of texts."""
    found = plan(stored[0].search(query, columns=["path"]))
    assert "collect_set" not in found and "body" not in "".join(re.findall(r"Exchange.*", found))


def expected(stored, query):
    _, files, tags, texts, manual = stored
    by = {}
    for p, t, _ in tags:
        by.setdefault(p, set()).add(t)

    def holds(t, f):
        if isinstance(t, q.All):
            return True
        if isinstance(t, q.Not):
            return not holds(t.item, f)
        if isinstance(t, q.And):
            return holds(t.left, f) and holds(t.right, f)
        if isinstance(t, q.Or):
            return holds(t.left, f) or holds(t.right, f)
        if isinstance(t, q.Field):
            if t.name == "text":
                text = manual.get(f["path"], texts.get(f["path"], "")).lower()
                return bool(re.search(rf"\b{t.value}\b", text)) if t.op == "word" else t.value in text
            return {"gt": f[t.name] > float(t.value), "eq": f[t.name] == float(t.value)}[t.op]
        return any(re.fullmatch(re.escape(t.name).replace(r"\*", ".*"), x) for x in by.get(f["path"], ()))

    tree = q.parse(query)
    return sorted(f["path"] for f in files if holds(tree, f))


TAGGED = [
    "cat", "-cat", "cat, dog", "cat || -dog", "*cat, -(red || dog)", "-(-(cat || -red), dog) || -(cat, -(dog || red))", "", "nothing", "-nothing", "cat, -cat", "cat || -cat", "-(cat || (dog, -(cat || -red)))",
]


@pytest.mark.parametrize("query", [*TAGGED, "text:tea, -cat", "-text.word:tea || red", "text:tea || size.gt:3000", "-(text:tea, size.gt:1000), -red"])
def test_searches_by_brute_force(stored, query):
    assert sorted(r[0] for r in stored[0].search(query, columns=["path"]).collect()) == expected(stored, query)


def test_bitmaps(spark, stored, tmp_path):
    """The index written and read again, on AND, OR and NOT nested both ways."""
    made = Postings.build(stored[0])
    made.write(str(tmp_path / "index"))
    index = Postings.read(spark, str(tmp_path / "index"))
    for query in TAGGED:
        assert sorted(r[0] for r in index.search(query).collect()) == expected(stored, query), query
        assert index.count(query).first()["n"] == len(expected(stored, query))
    mixed = "-(cat, size.gt:1000) || (width.gt:500, dog)"
    assert sorted(r[0] for r in index.search(mixed, files=stored[0].files()).collect()) == expected(stored, mixed)
    with pytest.raises(ValueError):
        index.search("text:tea", files=stored[0].files())
    found = plan(index.search("cat, -dog"))
    assert "In(tag" in found or "EqualTo(tag,cat)" in found


def test_bitmaps_of_nothing(spark):
    index = Postings.build(Catalog(spark, {}))
    assert index.search("-cat").count() == 0 and index.count("cat").first()["n"] == 0


def test_numbers_beyond_the_range(spark):
    rows = spark.createDataFrame([file_row("a", size=5), file_row("b", size=None)], TABLES["files"])
    found = lambda text: sorted(r["path"] for r in rows.where(to_column(q.parse(text))).collect())
    assert found("size.lt:1e30") == ["a"] and found("size.gt:1e30") == [] and found("size.gt:-inf") == ["a"] and found("size:5.0000000001") == ["a"] and found("size:5.5") == []
    assert found("-size.gt:9") == ["a", "b"] and found("size.lt:nan") == [] and found("size.gte:4.5") == ["a"] and found("size.gt:4.5, size.lt:5.5") == ["a"]


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_places(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 1009).alias("x"), (F.col("id") % 3).alias("y")).repartition(5)
    got = [(r["y"], r["x"], r["number"]) for r in numbered(df, [F.desc("y"), "x"]).collect()]
    assert [k for _, _, k in sorted(got, key=lambda r: (-r[0], r[1]))] == list(range(n))

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import names, text
from shelfspark.operators import audit, completion, ingest, paging, ranking, reading, similarity, tagging
from shelfspark.operators.vocabulary import Vocabulary
from shelfspark.schema import TABLES
from shelfspark.sources import files as file_source
from shelfspark.sources import store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(col).first()[0]


def test_cleaning(spark):
    clean = lambda s: one(spark, text.clean_model_text(F.col("t")), t=s)
    assert clean("NONE") == "" and clean("None.") == "" and clean("1. 2. 3. 4. 5. 6. 7.") == ""
    assert clean("same line\nsame line\n same  line ") == "same line"
    assert clean("i <3 cats\nso much") == "i <3 cats\nso much"
    assert clean("<td>ONE</td><td>TWO</td>") == "ONE TWO"
    assert clean("aaa aaa aaa aaa aaa aaa aaa aaa") == "" and clean("CategoryValueTop100Bottom100") == "" and clean("open <b word") == "open <b word"
    assert clean("é" * 3 + " word " + "é" * 4000).encode().__len__() <= 4000
    scanned = one(spark, text.clean_scanned_text(F.col("t")), t="A  good line\n|||\n~ x\n..ab..")
    assert scanned == "A good line"


def test_blocks(spark):
    t = "own text\n\nEnglish (machine):\nhello\n\nSpeech (machine):\nbye"
    assert tuple(one(spark, text.split_blocks(F.col("t")), t=t)) == ("own text", "English (machine):\nhello\n\nSpeech (machine):\nbye")
    assert tuple(one(spark, text.split_blocks(F.col("t")), t="plain  ")) == ("plain", "")
    assert one(spark, text.with_block(F.col("t"), "English (machine):", F.lit(" new ")), t=t) == "own text\n\nSpeech (machine):\nbye\n\nEnglish (machine):\nnew"
    assert one(spark, text.with_block(F.col("t"), "Speech (machine):", F.lit("x")), t="") == "Speech (machine):\nx"


def test_names(spark):
    assert [one(spark, names.utc_minute(F.lit(s))) for s in (0.0, 1700000000.0, 1582934400.0)] == ["1970-01-01 00:00Z", "2023-11-14 22:13Z", "2020-02-29 00:00Z"]
    assert one(spark, names.percent_encode(F.col("t")), t="a b/ü+~") == "a%20b/%C3%BC%2B~" and one(spark, names.percent_decode(F.col("t")), t="a%20b+") == "a b+"
    assert one(spark, names.html_escape(F.col("t")), t="<a&'\">") == "&lt;a&amp;&#39;&quot;&gt;"
    assert one(spark, names.media_type(F.col("t")), t="x/Y.JPG") == "image/jpeg" and one(spark, names.basename(F.col("t")), t="a/b.c") == "b.c"
    for head, want in ((b"\xff\xd8\xff\xe0", "jpeg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"RIFF0000WEBP", "webp"), (b"GIF89a", "gif"), (b"0000ftypavif", "avif"), (b"0000ftypisom", "mp4"), (b"\x1a\x45\xdf\xa3", "mkv"), (b"", "other")):
        assert one(spark, names.sniff(F.lit(bytearray(head)))) == want


TAGS = [("a", "twitter post", "xmp"), ("a", "folder:old", "folder"), ("b", "cat", "xmp"), ("c", "twitter collage", "xmp"), ("c", "stale", "implied")]


def test_reimply(spark):
    tags = spark.createDataFrame(TAGS, TABLES["tags"])
    v = Vocabulary.of(implications={"twitter post": ["twitter"], "twitter": ["social media"]})
    assert rows(tagging.reimply(tags, v)) == [("a", ["folder:old", "social media", "twitter", "twitter post"]), ("c", ["twitter collage"])]
    settled = tags.where("source <> 'implied'").union(tagging.implied_tags(tags, v).select("path", "tag", F.lit("implied")))
    assert rows(tagging.reimply(settled, v)) == [] and len(rows(tagging.reimply(settled, v.without_rule("twitter post", "twitter")))) == 1
    related = spark.createDataFrame([("p", "chibi<twitter>", "xmp")], TABLES["tags"])
    assert {r[1] for r in rows(tagging.implied_tags(related, v))} == {"chibi", "twitter", "social media"}


def test_counts_and_edits(spark):
    tags = spark.createDataFrame([*TAGS, ("b", "folder:old", "folder")], TABLES["tags"])
    assert [tuple(r) for r in tagging.tag_counts(tags).limit(1).collect()] == [("folder:old", 2)]
    shared = tagging.selection_counts(tags, spark.createDataFrame([("a",), ("b",)], "path string"))
    assert ("folder:old", 2, True) in rows(shared) and ("cat", 1, False) in rows(shared)
    v = Vocabulary.of(aliases={"kitty": "cat"}, categories={"subject": ["cat"]})
    assert one(spark, tagging.edit(F.split(F.col("t"), ","), ["dog", "-kitty", "+ ", "-dog", "+dog"], v), t="Cat,bird") == ["bird", "dog"]
    with pytest.raises(ValueError):
        tagging.batch_edit(tags, ["kitty"], ["cat"], v)
    changed = tagging.batch_edit(spark.createDataFrame([("a", ["cat"]), ("b", ["dog"])], "path string, tags array<string>"), [], ["kitty"], v)
    assert [(r["path"], r["changed"]) for r in changed.orderBy("path").collect()] == [("a", True), ("b", False)]
    names_ = spark.createDataFrame([("cat",), ("not:cat",), ("big<cat>",), ("artist:me",), ("zz",)], "tag string")
    got = dict(rows(tagging.category_counts(names_, v)))
    assert (got["subject"], got["artist"], got["other"], got["series"]) == (3, 1, 1, 0)
    assert one(spark, tagging.answer_suggestion(F.split(F.col("t"), ","), "x", True), t="not:x,y") == ["x", "y"]
    assert one(spark, tagging.relational_offers(F.split(F.col("t"), ","), "big"), t="cat,not:a,b<c>,big") == ["big<cat>"]
    assert rows(tagging.rename_tag(spark.createDataFrame(TAGS[:3], TABLES["tags"]), "cat", "lynx"))[-1] == ("b", "lynx", "xmp")


def test_completion(spark):
    values = spark.createDataFrame([("cat", 999999, False), ("my cat tag", 1, True), ("category", 2, True)], "tag string, count bigint, own boolean")
    assert [r[0] for r in completion.matches(values, " CAT ").collect()] == ["category", "my cat tag", "cat"]
    assert completion.matches(values, " ").count() == 0


def hash_rows(spark, hashes):
    signed = lambda b: tuple(int.from_bytes(b[k : k + 8], "little", signed=True) for k in range(0, 32, 8))
    return spark.createDataFrame([(n, *signed(h)) for n, h in hashes.items()], TABLES["hashes"])


def test_groups(spark):
    def made(**at):
        h = bytearray(32)
        for k, v in at.items():
            h[int(k[1:])] = v
        return bytes(h)

    b = made(_0=0xFF, _1=3)
    hashes = {"a": made(), "b": b, "c": made(_5=0xFF, _6=3), "d": made(_0=0xFF, _1=3, _2=1), "e": b"\xff" * 32}
    got = similarity.duplicate_groups(hash_rows(spark, hashes), 12).orderBy("place").collect()
    assert [r["id"] for r in got] == ["b", "d", "a"]
    two = similarity.duplicate_groups(hash_rows(spark, {k: hashes[k] for k in "ac"}), 12).orderBy("place").collect()
    assert [r["id"] for r in two] == ["a", "c"]


def test_pairs_against_all(spark):
    rng = random.Random(3)
    centre = [rng.getrandbits(256) & rng.getrandbits(256) for _ in range(12)]
    every = {}
    for k in range(150):
        h = centre[k % 12]
        for _ in range(rng.randint(0, 14)):
            h ^= 1 << rng.randrange(256)
        every[f"p{k:03}"] = h.to_bytes(32, "little")
    value = {k: int.from_bytes(h, "little") for k, h in every.items()}
    sound = [k for k in sorted(value) if value[k].bit_count() <= 144]
    want = sorted((a, b, (value[a] ^ value[b]).bit_count()) for a in sound for b in sound if a < b and (value[a] ^ value[b]).bit_count() <= 20)
    pairs = similarity.close_pairs(hash_rows(spark, every), 20)
    assert rows(pairs) == want and len(want) > 100
    near = {frozenset(p[:2]) for p in want}
    groups: dict = {}
    for r in similarity.duplicate_groups(hash_rows(spark, every), 20).collect():
        groups.setdefault((r["began_at"], r["began_a"], r["began_b"]), []).append(r["id"])
    members = [m for g in groups.values() for m in g]
    assert len(members) == len(set(members)) and all(frozenset((x, y)) in near for g in groups.values() for x in g for y in g if x != y)


def test_ranking(spark):
    vec = {"a": [1.0, 0.0, 0.0], "b": [2.0, 0.0, 0.0], "near": [1.0, 0.5, 0.0], "far": [0.0, 0.0, 1.0]}
    vectors = spark.createDataFrame(list(vec.items()), "path string, vector array<float>")
    pos = spark.createDataFrame([("a",), ("b",)], "path string")
    got = [tuple(r) for r in ranking.propose(vectors, pos, vectors=vectors).collect()]
    assert got == [("near", 0.894427), ("far", 0.0)]
    rejected = dict(rows(ranking.rank(vectors, pos, vectors=vectors, rejects=spark.createDataFrame([("near",)], "path string"))))
    assert rejected["near"] == pytest.approx(0.894427 - 0.5, abs=1e-5) and rejected["far"] == 0
    texts = spark.createDataFrame([("a", "tea party tonight"), ("b", "tea party again"), ("c", "a tea party"), ("d", "nothing shared here"), ("e", " ")], "path string, text string")
    got = [r[0] for r in ranking.propose(texts, pos, texts=texts, mode="text").collect()]
    assert got == ["c", "d"]
    both = dict(rows(ranking.rank(vectors, pos, vectors=vectors, texts=texts, mode="both")))
    assert both["near"] == 0.894427
    none = spark.createDataFrame([], "path string")
    assert ranking.rank(vectors, none, vectors=vectors).count() == 0


def test_holdout(spark):
    hidden, shown = ranking.split_hidden([f"f{k}" for k in range(10)], 7)
    assert len(hidden) == 3 and sorted(hidden + shown) == sorted(f"f{k}" for k in range(10)) and ranking.split_hidden([f"f{k}" for k in range(10)], 7) == (hidden, shown)
    ranked = spark.createDataFrame([(f"p{k}", 1.0 - k / 100) for k in range(60)], "path string, score double")
    row = ranking.holdout(ranked, spark.createDataFrame([("p0",), ("p9",), ("p55",), ("x",)], "path string"), top=10).first()
    assert (row["scored"], row["found_50"], row["found_100"], row["found_top"], row["median_rank"], row["chance"]) == (60, 2, 3, 2, 10, round(200 / 60, 6))


def test_listing(spark):
    local = spark.createDataFrame([("a", 10, 1.5), ("b", 20, 2.5), ("c", 30, 3.5), ("d", 40, 4.5)], "path string, size bigint, mtime double")
    listed = spark.createDataFrame([("a", 10, 1.5), ("b", 21, 2.5), ("c", 30, 3.500001), ("e", 50, 5.5)], "path string, size bigint, mtime double")
    assert rows(ingest.listing_diff(local, listed)) == [("b", "changed"), ("c", "changed"), ("d", "gone"), ("e", "new")]
    assert ingest.guards(100, 51, 49).delete is False and ingest.guards(100, 51, 49, force=True).delete and ingest.guards(2000, 51, 1949).delete
    assert not ingest.guards(5, 5, 0).delete and not ingest.guards(5, 1, 4, failed_scans=1).delete
    gone = spark.createDataFrame([("o1", "x"), ("o2", "y"), ("o3", "y")], "path string, id string")
    fresh = spark.createDataFrame([("n1", "x"), ("n2", "y")], "path string, id string")
    moved = ingest.renames(gone, fresh)
    assert rows(moved) == [("o1", "n1")]
    assert rows(ingest.carry(spark.createDataFrame([("o1", "t")], TABLES["text"]), moved)) == [("n1", "t")]
    assert rows(ingest.carry(spark.createDataFrame([("o1", "t"), ("n1", "u")], TABLES["text"]), moved)) == [("n1", "u"), ("o1", "t")]


def test_cache_rule(spark):
    old = spark.createDataFrame([("p", "b" + "0" * 16), ("q", "0" * 16), ("r", "1" * 16), ("s", "b" + "2" * 15)], "path string, id string")
    new = spark.createDataFrame([("p", "1" * 16), ("q", "2" * 16), ("r", "b" + "1" * 16), ("s", "3" * 16)], "path string, id string")
    assert rows(ingest.stale(old, new)) == [("q",), ("s",)]


def test_reading(spark):
    files = spark.createDataFrame([(f"i{k}", "image", 100.0 + 100 * k, False) for k in range(4)], "path string, kind string, indexed_at double, text_in_file boolean")
    meta = spark.createDataFrame([("i0", "e", 200.0, 1.5)], TABLES["text_meta"])
    manual = spark.createDataFrame([("i1", "x")], TABLES["manual_text"])
    assert rows(reading.unread(files, meta, manual, "e")) == [(2, 2)] and rows(reading.unread(files, meta, manual, "other")) == [(3, 3)]
    assert [r[0] for r in reading.queue(files, meta, manual, "e").collect()] == ["i2", "i3"]
    assert rows(reading.engine_stats(files, meta)) == [("e", 1, 1.5, 200.0, 3)]
    assert reading.awaiting(files, meta, manual).count() == 2


def test_audit_and_pages(spark):
    index = spark.createDataFrame([(p, "id", "image", 10.0, ["t"], 1, 1.0) for p in "abcdef"], "path string, id string, kind string, mtime double, xmp_tags array<string>, xmp_tag_count bigint, created_at double")
    scan = spark.createDataFrame([("a", True, True, "id", 10.2, ["t", "t"], "id"), ("b", False, None, None, None, None, None), ("c", True, False, None, None, None, None), ("d", True, True, "zz", 12.0, ["u"], None), ("e", True, True, "id", None, ["t"], "px")], "path string, readable boolean, sound boolean, id string, original_mtime double, tags array<string>, pixel_id string")
    assert audit.verify(index, scan, deep=True).first().asDict() == {"files": 6, "missing": 1, "unreadable": 1, "bad_metadata": 1, "id_drift": 1, "mtime_moved": 1, "tag_drift": 1, "pixels_changed": 1, "undecodable": 1}
    page, at, pages = paging.page(index.orderBy("path"), 99, 4)
    assert ([r["path"] for r in page.collect()], at, pages) == (["e", "f"], 2, 2)
    assert paging.page(index.limit(0), 1)[1:] == (1, 1)
    assert paging.next_thin(index, 2).first()["path"] == "d" and paging.next_thin(index, 5).first()["path"] == "a"


def test_files_and_store(spark, tmp_path):
    root = tmp_path / "lib"
    (root / "Cats").mkdir(parents=True)
    (root / "Cats" / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n....")
    (root / "b.txt").write_bytes(b"hello")
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + b"\0" * 17
    for name, chunks in (("moving", b"acTL....IDAT"), ("still", b"IDAT....acTL")):
        (root / "Cats" / f"{name}.png").write_bytes(png + chunks)
    got = {r["path"]: r for r in file_source.scan(spark, str(root)).collect()}
    assert got.pop("main/Cats/moving.png")["format"] == "apng" and got.pop("main/Cats/still.png")["format"] == "png"
    assert set(got) == {"main/Cats/a.png", "main/b.txt"} and got["main/Cats/a.png"]["format"] == "png" and got["main/b.txt"]["format"] == "txt"
    assert got["main/Cats/a.png"]["folder_tags"] == ["folder:cats"] and got["main/b.txt"]["id"] == "b2cf24dba5fb0a30e" and got["main/b.txt"]["size"] == 5
    assert {r["path"]: r["size"] for r in file_source.listing(spark, str(root)).collect() if "ing.png" not in r["path"] and "still" not in r["path"]} == {"main/Cats/a.png": 12, "main/b.txt": 5}
    import struct

    blob = spark.createDataFrame([("p", bytearray(struct.pack("<3f", 1.5, -2.25, 0.0))), ("q", bytearray(b"xx"))], "path string, blob binary")
    assert rows(file_source.vectors_from_bytes(blob, 3)) == [("p", [1.5, -2.25, 0.0])]
    folder = str(tmp_path / "store")
    assert store.read_tables(spark, folder) == {}
    store.write_tables(spark, folder, {"text": spark.createDataFrame([("p", "x")], TABLES["text"])})
    first = store.read_tables(spark, folder)["text"]
    store.write_tables(spark, folder, {"text": ingest.upsert(first, spark.createDataFrame([("p", "y")], TABLES["text"]))})
    assert rows(store.read_tables(spark, folder)["text"]) == [("p", "y")] and rows(first) == [("p", "x")]


def test_merge_scans(spark):
    from shelfspark.schema import empty

    tables = {k: empty(spark, k) for k in TABLES}
    scan_schema = TABLES["files"] + ", xmp_tags array<string>, folder_tags array<string>, text string, manual boolean"
    scan = lambda i, own, t, manual: spark.createDataFrame([(i, "main/p", "png", "image", 1, 1, 1, 1.0, 1.0, 0.0, len(own), 1.0, None, own, ["folder:f"], t, manual)], scan_schema)
    v = Vocabulary.of(implications={"cat": ["animal"]})
    expand = lambda tags: tagging.implied_tags(tags, v)
    one_ = ingest.merge_scans(tables, scan("1" * 16, ["cat"], "own", False), expand)
    assert rows(one_["tags"]) == [("main/p", "animal", "implied"), ("main/p", "cat", "xmp"), ("main/p", "folder:f", "folder")]
    assert rows(one_["text"]) == [("main/p", "own")] and one_["files"].first()["text_in_file"] is True
    one_ = {k: t.checkpoint() for k, t in one_.items()}
    two = ingest.merge_scans(one_, scan("2" * 16, ["dog"], None, False), expand)
    assert rows(two["text"]) == [] and rows(two["tags"]) == [("main/p", "dog", "xmp"), ("main/p", "folder:f", "folder")]
    three = ingest.merge_scans(one_, scan("1" * 16, ["dog"], "seen", True), expand)
    assert rows(three["manual_text"]) == [("main/p", "seen")] and rows(three["text"]) == [("main/p", "own")]


def test_streams(spark, tmp_path):
    from shelfspark.streaming import pull

    folder, incoming = str(tmp_path / "s"), str(tmp_path / "in")
    batch = lambda rows_: spark.createDataFrame(rows_, "path string, size bigint, mtime double, deleted boolean").write.mode("append").parquet(incoming)
    batch([("a", 1, 1.0, False), ("b", 2, 1.0, False)])
    pull.stream_listing(spark, incoming, folder, str(tmp_path / "c1")).awaitTermination()
    batch([("a", 5, 2.0, False), ("b", 2, 3.0, True), ("c", 1, 1.0, None)])
    pull.stream_listing(spark, incoming, folder, str(tmp_path / "c1")).awaitTermination()
    assert rows(store.read_tables(spark, folder)["files"].select("path", "size")) == [("a", 5), ("c", 1)]
    uses, told = str(tmp_path / "h"), str(tmp_path / "tags")
    for tags in (["x", "y", "x"], ["y"]):
        spark.createDataFrame([(t,) for t in tags], "tag string").write.mode("append").parquet(told)
        pull.stream_tag_history(spark, told, uses, str(tmp_path / "c2")).awaitTermination()
    assert rows(pull.tag_history(spark, uses)) == [("x", 2), ("y", 2)]


def test_store_survives_crashes(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "s")
    table = lambda x: {"text": spark.createDataFrame([("p", x)], TABLES["text"])}
    store.write_tables(spark, folder, table("one"))
    (tmp_path / "s" / "v-half" / "text").mkdir(parents=True)  # died while it wrote tables
    (tmp_path / "s" / "_new-v-half").write_text("v-half")  # died before the rename
    assert rows(store.read_tables(spark, folder)["text"]) == [("p", "one")]
    seen = store._newest(spark, folder)
    store.write_tables(spark, folder, table("two"))
    assert rows(store.read_tables(spark, folder)["text"]) == [("p", "two")]
    monkeypatch.setattr(store, "_newest", lambda *_: seen)  # a writer that began before
    with pytest.raises(RuntimeError):
        store.write_tables(spark, folder, table("late"))
    monkeypatch.undo()
    assert rows(store.read_tables(spark, folder)["text"]) == [("p", "two")]


def test_listing_batches(spark):
    from shelfspark.schema import empty
    from shelfspark.streaming import pull

    schema = "path string, size bigint, mtime double, deleted boolean, arrival int"
    first = [("a", 1, 1.0, False, 1), ("a", 2, 1.0, False, 2), ("b", 1, 5.0, False, 1), ("b", None, None, True, 1), ("c", 1, 5.0, False, 1), ("c", None, None, True, 0)]
    turned = [pull.merged_listing(empty(spark, "files"), spark.createDataFrame(x, schema)).checkpoint() for x in (first, first[::-1])]
    assert [rows(t.select("path", "size")) for t in turned] == [[("a", 2), ("c", 1)]] * 2
    again = pull.merged_listing(turned[0], spark.createDataFrame(first, schema))
    assert rows(again.select("path", "size")) == [("a", 2), ("c", 1)]
    many = pull.merged_listing(empty(spark, "files"), spark.createDataFrame([(f"f{k}", 1, 1.0, False, 1) for k in range(100)], schema)).checkpoint()
    gone = spark.createDataFrame([(f"f{k}", None, None, True, 2) for k in range(60)], schema)
    assert pull.merged_listing(many, gone).count() == 100 and pull.merged_listing(many, gone, force=True).count() == 40


def test_relational_tags_against_the_vocabulary(spark):
    rng = random.Random(7)
    names_ = ["cat", "kitty", "big", "huge", "animal", "pet"]
    v = Vocabulary.of(aliases={"kitty": "cat", "huge": "big"}, implications={"cat": ["animal"], "animal": ["pet", "big<pet>"], "big<cat>": ["lion"], "pet": ["animal"]})
    made = lambda: rng.choice([" {} ", "{}<{}>", " {} < {}>", "<{}>", "{}<>", "{}<{}<{}>>", "\t{}"]).format(*[rng.choice([str, str.upper])(rng.choice(names_)) for _ in range(3)])
    tags = [made() for _ in range(150)]
    df = spark.createDataFrame([(str(k), t, "xmp") for k, t in enumerate(tags)], TABLES["tags"])
    assert [r[0] for r in df.select(tagging.canon_column(F.col("tag"), v)).collect()] == [v.canon(t) for t in tags]
    got = {}
    for r in tagging.implied_tags(df, v).collect():
        got.setdefault(int(r["path"]), set()).add(r["tag"])
    assert all(got.get(k, set()) == v.expand([t]) - {v.canon(t)} for k, t in enumerate(tags))


def test_groups_by_brute_force(spark):
    rng = random.Random(9)
    values = [rng.getrandbits(64) for _ in range(6)]
    values = [x ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 6))}) for x in values for _ in range(12)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(f"{k:03}", signed(x), 0, 0, 0) for k, x in enumerate(values)], "path string, h0 bigint, h1 bigint, h2 bigint, h3 bigint")
    far = lambda i, j: (values[i] ^ values[j]).bit_count()
    for within in (5, 11):
        group = {k: {k} for k in range(len(values))}
        for d, i, j in sorted((far(i, j), i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if far(i, j) <= within):
            if group[i] is not group[j] and all(far(x, y) <= within for x in group[i] for y in group[j]):
                both = group[i] | group[j]
                group.update(dict.fromkeys(both, both))
        got = {}
        for r in similarity.duplicate_groups(df, within, bits=64).collect():
            got.setdefault((r["began_at"], r["began_a"], r["began_b"]), set()).add(int(r["id"]))
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in {frozenset(g) for g in group.values()} if len(g) > 1)


def test_holdout_by_brute_force(spark):
    rng = random.Random(3)
    scores = {f"p{k}": round(rng.random(), 1) for k in range(130)}
    hidden, shown = ranking.split_hidden(sorted(scores)[:30])
    assert len(hidden) == 10 and sorted(hidden + shown) == sorted(scores)[:30] and hidden == ranking.split_hidden(sorted(scores)[:30][::-1])[0]
    ranked = sorted((p for p in scores if p not in shown), key=lambda p: (-scores[p], p))
    got = ranking.holdout(spark.createDataFrame([(p, scores[p]) for p in ranked], "path string, score double"), spark.createDataFrame([[p] for p in hidden], "path string"), top=20).first()
    places = sorted(ranked.index(p) + 1 for p in hidden)
    assert (got["scored"], got["found_50"], got["found_top"], got["median_rank"]) == (110, sum(x <= 50 for x in places), sum(x <= 20 for x in places), places[5]) and got["chance"] == round(500 / 110, 6)


def test_cleaning_computes_its_steps_once(spark):
    """The lines and the text were computed again for each line that was compared and each rule: quadratic in lines."""
    df = spark.createDataFrame([("\n".join(f"line  number {k // 2} <b>" for k in range(3000)) + "\n\n é" * 3,), ("",), (None,), ("x" * 5000 + " y zz",)], "t string")
    out = df.select(text.clean_model_text(F.col("t"), 1 << 30).alias("c"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[A-Za-z/!]") == 1 and plan.count("array_join(") <= 1
    assert [r.c for r in out.collect()] == ["\n".join(f"line number {k}" for k in range(1500)) + "\né", "", "", "x" * 5000 + " y zz"]


def test_texts_are_taken_apart_once(spark, monkeypatch):
    """Scores were planned over the texts' words for each use of the weights; rare terms, joined, count as common ones do."""
    texts = spark.createDataFrame([("a", "one two two ärger"), ("b", "two three x"), ("c", "one four four five"), ("d", "x y"), ("e", " "), ("f", "three five six")], "path string, text string")
    pos, neg = texts.where("path IN ('a', 'e')").select("path"), texts.where("path = 'c'").select("path")
    out = ranking.text_scores(texts, pos, neg)
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {r.path: round(r.words, 9) for r in out.collect()}
    assert sorted(want) == ["a", "b", "c", "d", "f"] and want["d"] == 0 and want["a"] > want["b"] > 0 > want["c"]
    monkeypatch.setattr(ranking, "_COMMON", 2)
    assert {r.path: round(r.words, 9) for r in ranking.text_scores(texts, pos, neg).collect()} == want
    assert ranking.text_scores(texts, texts.where("path = 'e'").select("path")).count() == 0

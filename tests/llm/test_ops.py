"""Each operator against brute force, on small documents with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tests_llm_support import components_by_brute_force, corpus, fingerprint_by_brute_force, lines_by_brute_force, spans_by_brute_force

from shelfspark.llm import bitmap_bpe, collision_projections, components, ecoc_lang, kd_shards, knn_toxicity, line_dedup, simhash_bk, suffix_dedup, vector_packing, webp_lossless

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp int, gone string, weight string, node int, spans int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2"][i % 3 if i % 2 else 1], None if i % 7 == 0 else len(t or ""), "clash", 1, "g", "w", 3, 4) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- 1


def test_webp_all_features():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 9), (21, 34)):
        images = [
            rng.integers(0, 2**32, (h, w), dtype=np.uint32), rng.integers(0, 3, (h, w)).astype(np.uint32) * 0x01010101, np.full((h, w), 0xFF123456, np.uint32),
            np.resize(rng.integers(0, 2**32, 37, dtype=np.uint32), (h, w)), (np.add.outer(np.arange(h), np.arange(w)) % 256).astype(np.uint32) * 0x010101 + 0xFF000000,
        ]
        for image in images:
            for green, predictor, cross, cache, meta, palette in ((0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0), (0, 2, 0, 0, 0, 0), (0, 3, 0, 0, 2, 0), (0, 0, 2, 0, 0, 0), (1, 2, 3, 0, 2, 0), (0, 0, 0, 1, 0, 0), (1, 2, 2, 5, 2, 0), (0, 0, 0, 11, 0, 0), (0, 0, 0, 0, 0, 1), (0, 2, 0, 4, 2, 1)):
                if palette and len(np.unique(image)) > 256:
                    continue
                data = webp_lossless.encode(image, bool(palette), bool(green), predictor, cross, cache, meta)
                assert (webp_lossless.decode(data) == image).all()


def test_webp_known_stream():
    """A stream put together by hand from the format's description: 2 x 1 pixels, each code of one symbol or two."""
    fields = [(0x2F, 8), (1, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)]  # size, no alpha, version, no transform, no cache, one group
    fields += [(1, 1), (1, 1), (1, 1), (10, 8), (200, 8)]  # green: 10 or 200
    for v in (1, 2, 255):
        fields += [(1, 1), (0, 1), (int(v > 1), 1), (v, 8 if v > 1 else 1)]
    fields += [(1, 1), (0, 1), (0, 1), (0, 1), (1, 1), (0, 1)]  # distance: one symbol; pixels: 200, then 10
    bits = "".join(format(v, f"0{n}b")[::-1] for v, n in fields)
    body = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
    size = len(body) + (len(body) & 1)
    data = b"RIFF" + (12 + size).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body.ljust(size, b"\0")
    assert webp_lossless.decode(data).tolist() == [[0xFF01C802, 0xFF010A02]]


@pytest.mark.parametrize("cut", [0, 11, 22, 30, -3])
def test_webp_broken(cut):
    data = webp_lossless.encode(np.arange(4000, dtype=np.uint32).reshape(40, 100))
    with pytest.raises((webp_lossless.WebpError, IndexError)):
        webp_lossless.decode(data[:cut] if cut else b"not an image at all")


def test_media(docs, none):
    got = by_id(webp_lossless.media_features(webp_lossless.to_media(docs), pixels=True))
    for i, t in corpus():
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], bytes(r["samples"])) == (len(data), len(payload), payload)
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert webp_lossless.media_features(webp_lossless.to_media(none)).count() == 0
    big = bytes(random.Random(1).choices(b"abc ", k=1_200_001))
    assert webp_lossless.load(webp_lossless.store(webp_lossless.padded(big))).tobytes() == webp_lossless.padded(big)


# ---- 2


def test_kd(spark, docs, none):
    from pyspark.sql import functions as F

    sized = docs.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    placed = kd_shards.with_slots(kd_shards.kd_shards(sized, ["source", "n_chars", "doc_id"], weight_col="bytes", shards=5)).collect()
    load, largest = {}, max(len((t or "").encode()) + 1 for _, t in corpus())
    for r in placed:
        load.setdefault(r["shard"], []).append(r)
    sums = [sum(r["bytes"] for r in v) for v in load.values()]
    assert sorted(load) == [0, 1, 2, 3, 4] and len(placed) == len(corpus()) and max(sums) - min(sums) <= 3 * largest
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in load.values()) and placed[0]["node"] == 3
    even = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(1).alias("b"))
    counts = {r["shard"]: r["count"] for r in kd_shards.kd_shards(even, ["source"], weight_col="b", target_bytes=130).groupBy("shard").count().collect()}
    assert sorted(counts.values()) == [125] * 8
    assert kd_shards.kd_shards(none.withColumn("b", F.lit(1)), ["source"], weight_col="b", shards=4).count() == 0
    same = spark.range(10).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(2).alias("b"))
    counts = {r["shard"]: r["count"] for r in kd_shards.kd_shards(same, ["doc_id"], weight_col="b", shards=5).groupBy("shard").count().collect()}
    assert counts == dict.fromkeys(range(5), 2)  # equal rows are dealt out too
    assert {r["shard"] for r in kd_shards.kd_shards(same, ["doc_id"], weight_col="b", shards=1).collect()} == {0}


def test_kd_medians_by_brute_force(spark):
    """Every split against a full sort: long common beginnings, fractions, nulls, dates and hot values."""
    import datetime

    rng = random.Random(11)
    dims = ["source", "rate", "day"]
    rows = [(k, "crawl-2023-" + rng.choice("aaab"), rng.choice([None, rng.random(), 0.25]), datetime.date(2020, 1, 1 + rng.randrange(20)), rng.choice([0, 1, 5, 90])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, rate double, day date, weight int").repartition(6)
    placed, splits = kd_shards.kd_tree(df, dims, shards=7)
    leaf = {r["doc_id"]: r["shard"] for r in placed.collect()}
    assert len(leaf) == 400 and len(splits) == 6 and {d for _, _, d in splits} == {0, 1, 2} and splits[0] == (0, 7, 0)
    for first, k, d in splits:
        own = [r for r in rows if first <= leaf[r[0]] < first + k]
        spans = [(len({r[1 + i] for r in own}) - 1) / (len({r[1 + i] for r in rows}) - 1) for i in (0, 2)]
        have = [r[2] for r in own if r[2] is not None]
        every = [r[2] for r in rows if r[2] is not None]
        spans.insert(1, (max(have) - min(have)) / (max(every) - min(every)))
        assert spans[d] == max(spans)
        own.sort(key=lambda r: (r[1 + d] is not None, r[1 + d] if r[1 + d] is not None else 0, r[0]))
        want, run = sum(r[4] for r in own) * (k // 2) // k, 0
        for r in own:
            side, run = 2 * run + r[4] >= 2 * want, run + r[4]
            if r[4]:
                assert (leaf[r[0]] >= first + k // 2) == side


# ---- 3


def test_line_dedup(spark, docs, none):
    want = lines_by_brute_force(corpus())
    got = by_id(line_dedup.line_dedup(docs))
    assert {i: r["text"] for i, r in got.items()} == want and got[-40]["gone"] == "g"
    assert sum(r["n_removed"] for r in got.values()) > 40
    few = line_dedup.removed_lines(docs.select("doc_id", "text"), most=1, reach=2).collect()
    assert len({(r["doc_id"], r["line"]) for r in few}) == sum(r["n_removed"] for r in got.values())
    assert line_dedup.line_dedup(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "c b a A")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in line_dedup.line_dedup(odd).collect()) == [(0, 0), (1, 0), (1, 0), (2, 1)]


def test_near_lines_by_brute_force(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(n)] for n in (5, 10, 30, 60, 120, 200)]
    rows = []
    for k in range(300):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(words) // 5))):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 900)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df).collect()} == lines_by_brute_force(rows)


def test_word_hashes(monkeypatch):
    """Equal hashes for equal words (A-Z as a-z), at every piece's boundary."""
    monkeypatch.setattr(line_dedup, "_PIECE", 64)
    rng, hasher = random.Random(4), line_dedup._Hasher()
    for n in (0, 1, 63, 64, 65, 700, 5000):
        data = bytes(rng.choices(b"abAB\xc3\xa9 \t\n\r\x0b\x0c", k=n)) + b"x" * (n // 2) + b"\nend"
        one, two, feeds = hasher.words(data)
        want = [(w, k) for k, line in enumerate(data.lower().split(b"\n")) for w in line.split()]
        assert len(one) == len(want) and feeds.tolist() == [k for _, k in want]
        number = {}
        for (w, _), a, b in zip(want, one.tolist(), two.tolist()):
            assert number.setdefault(w, (a, b)) == (a, b)
        assert len(set(number.values())) == len(number) == len({a for a, _ in number.values()}) == len({b for _, b in number.values()})


@pytest.mark.parametrize("n", [5, 6, 8, 10, 12])
def test_words_whose_powers_cancel(spark, n):
    """Thue-Morse words and their swaps: a sum of powers can't tell long ones apart, the line stays all the same."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))
    swap = word.translate(str.maketrans("ab", "ba"))
    one, two, _ = line_dedup._Hasher().words(f"{word} {swap} {word.upper()}".encode())
    assert one[0] == one[2] != one[1] and two[0] == two[2] != two[1]
    rows = [(1, word), (2, swap), (3, f"x\n{word}"), (4, swap.upper())]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


@pytest.mark.parametrize("blocks", [1 << 16, 20])
def test_hot_words_of_lines(monkeypatch, blocks):
    """Many near copies of one line: blocks and reach bound the comparisons of the first round, the second has the rest."""
    monkeypatch.setattr(line_dedup, "_BLOCK_LINES", blocks)
    rng = random.Random(6)
    base = [f"t{k}" for k in range(12)]
    lines = [" ".join([*base[: rng.choice([10, 11, 12])], f"n{k}" if k % 4 else "q " * 4 + f"m{k} o{k}"]) for k in range(300)]
    words, second, line = line_dedup._Hasher().words("\n".join(lines).encode())
    counts = np.bincount((words % np.uint64(line_dedup.BUCKETS)).astype(np.int64), minlength=line_dedup.BUCKETS)
    at, size, ids, words = line_dedup.line_sets(words, second, line, line_dedup.levels(counts))
    assert size.tolist() == [len(set(x.split())) for x in lines]
    sets = [set(x.split()) for x in lines]
    alike = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    want = {i for i in range(300) if any(alike(i, j) for j in range(i))}
    prefixes = np.bincount((words % np.uint64(line_dedup.BUCKETS)).astype(np.int64), minlength=line_dedup.BUCKETS)
    known = line_dedup._Order(counts, prefixes, 1000)
    assert (known.blocks.max() > 1) == (blocks == 20)
    rows = line_dedup.prefix_postings(words, size, ids[:, 0], np.zeros(300, np.int64), at, known.blocks, 4, 5)
    found, most, held = set(), 4, None
    for turn in range(6):
        (_, late, _, early, more), again = line_dedup.best_candidates(rows, 4, 5, most, None if turn else 8)
        held = again if held is None else held
        found |= {i for i, j in zip(late.tolist(), early.tolist()) if j >= 0 and alike(i, j)}
        left = {i for i, m in zip(late.tolist(), more.tolist()) if m} - found
        if not left:
            break
        most *= 8
        own = held["id"] % known.blocks[(held["token"] % np.uint64(line_dedup.BUCKETS)).astype(np.int64)].astype(np.uint64) + np.uint64(1)
        rows = line_dedup._at(held, (held["block"] == 0) | (held["block"] == own))
        search = np.isin(rows["line"], list(left))
        rows["flag"], rows["block"] = search.astype(np.uint8), np.zeros(len(search), np.uint32)
        rows = line_dedup._blocked(rows, known.blocks, search)
    assert turn and found == want and len(want) > 200


# ---- 4


def test_simhash(spark, docs, none):
    fps = {i: fingerprint_by_brute_force(t) for i, t in corpus()}
    ids = sorted(fps)
    linked = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = components_by_brute_force(ids, linked)
    got = simhash_bk.simhash_groups(docs).collect()
    assert {r["id"]: r["fp"] & (1 << 64) - 1 for r in got} == fps and {r["id"]: r["component"] for r in got} == want
    assert simhash_bk.simhash_groups(none).count() == 0 and len(set(want.values())) < len(ids) - 10


@pytest.mark.parametrize("shard_rows", [10_000, 3])
def test_bk_links(spark, shard_rows):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:12]:
        for _ in range(25):
            values.add(v ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))}))
    values = sorted(values)
    rows = [(v - (1 << 64) if v >> 63 else v, k) for k, v in enumerate(values)]
    found = simhash_bk.links(spark.createDataFrame(rows, "fp bigint, rep bigint"), 2, shard_rows).collect()
    linked = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 2]
    assert all((values[r["a"]] ^ values[r["b"]]).bit_count() <= 2 for r in found)
    assert components_by_brute_force(range(len(values)), [(r["a"], r["b"]) for r in found]) == components_by_brute_force(range(len(values)), linked)


def test_components(spark):
    rng = random.Random(8)
    for n, m in ((1, 0), (50, 30), (400, 390), (60, 59)):
        pairs = [(k, k + 1) for k in range(m)] if n == 60 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = components.components(spark.createDataFrame([*pairs, (None, 1)], "a bigint, b bigint")).collect()
        want = components_by_brute_force(range(n), pairs)
        touched = {x for a, b in pairs if a != b for x in (a, b)}
        assert sorted((r["node"], r["component"]) for r in got) == sorted((x, want[x]) for x in touched)


# ---- 5


def test_language(spark):
    stems = {"en": ["the", "and", "ing", "tion"], "fr": ["eau", "çle", "les", "ré"], "ru": ["ова", "ить", "при"]}
    rng = random.Random(1)
    rows = []
    for k in range(240):
        lang = list(stems)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang if k % 5 else None))
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 .. 3", "en"), (902, "", None), (902, "", None)], "doc_id bigint, text string, lang string")
    model = ecoc_lang.train(df.where("doc_id % 3 = 0 OR doc_id % 2 = 0"), train_rows=60)
    got = ecoc_lang.predict(df, model).collect()
    right = sum(r["lang_pred"] == list(stems)[r["doc_id"] % 3] for r in got if r["doc_id"] < 240)
    assert right >= 236 and len(got) == 244 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["lang_pred"] for r in got if r["doc_id"] >= 900] == ["und"] * 4
    blind = ecoc_lang.train(df.where("false"))
    assert {r["lang_pred"] for r in ecoc_lang.predict(df, blind).collect()} == {"und"}
    single = ecoc_lang.train(df.where("lang = 'fr'"))
    assert {r["lang_pred"] for r in ecoc_lang.predict(df.where("doc_id < 9"), single).collect()} == {"fr"}


def test_codewords():
    for n in (2, 4, 7, 30):
        w = ecoc_lang.codewords(n)
        assert len({tuple(r) for r in w}) == n and all(abs(c.sum()) < n for c in w.T)


def test_language_held_out(spark):
    df = ecoc_lang.op5_ecoc_lang(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = df.where("held_out").join(truth, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) > 300


def test_language_behind_boilerplate(spark):
    rng = random.Random(2)
    stems = {"fr": ["eau", "çle", "les", "ré"], "ru": ["ова", "ить", "при"]}
    body = lambda lang: " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(400))
    header = "the king and the nation sing " * 80
    rows = [(k, header + body(["fr", "ru"][k % 2]), ["fr", "ru"][k % 2]) for k in range(80)]
    model = ecoc_lang.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    asked = spark.createDataFrame([(k, body(["fr", "ru"][k % 2])) for k in range(40)], "doc_id bigint, text string")
    got = ecoc_lang.predict(asked, model).collect()
    right = sum(r["lang_pred"] == ["fr", "ru"][r["doc_id"] % 2] for r in got)
    assert right == 40, right


def test_most_languages_learned(spark):
    rows = [(k, "ab cd ef", lang) for k, lang in enumerate(["x"] * 3 + ["y"] * 2 + ["z"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert ecoc_lang.train(df, langs=2).langs == ["x", "y"] and ecoc_lang.train(df).langs == ["x", "y", "z"]


# ---- 6


def test_block_max_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(300):
        t = np.sort(rng.choice(50, rng.integers(0, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    index = knn_toxicity.BlockMaxIndex(vectors, 50, block=8)
    dense = np.zeros((300, 50))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(300):
        cos = dense @ dense[q]
        cos[q] = 0
        want = sorted((-round(c, 12), i) for i, c in enumerate(cos) if c > 0)[:10]
        got = index.search(*vectors[q], 10, skip=q)
        assert [s for s, _ in got] == pytest.approx([-s for s, _ in want], abs=2e-12) and all(s == pytest.approx(cos[i], abs=2e-12) for s, i in got)


def test_toxicity(spark):
    rng = random.Random(6)
    vocab = [f"word{k}" for k in range(200)]
    bad = ["nasty", "vile", "awful"]
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        if k % 5 == 0:
            words[3:3] = rng.sample(bad, 2)
        rows.append((k, " ".join(words)))
        if k % 2:
            labels.append((k, int(k % 5 == 0)))
    labels += [(7, None), (None, 1), (99_999, 1), (1, 0)]
    docs_ = spark.createDataFrame([*rows, (500, None), (501, ""), (502, "!!"), (0, rows[0][1])], "doc_id bigint, text string")
    model = knn_toxicity.train(docs_, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = knn_toxicity.score(docs_, model).collect()
    wrong = [r["doc_id"] for r in got if r["doc_id"] < 400 and r["predicted"] != int(r["doc_id"] % 5 == 0)]
    assert len(got) == 404 and len(wrong) <= 4 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] >= 500)
    toxic = next(r for r in got if r["doc_id"] == 0)
    assert len(toxic["evidence"]) == 3 and all(i % 5 == 0 for i in toxic["evidence"])
    empty = knn_toxicity.train(docs_, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r["predicted"] for r in knn_toxicity.score(docs_, empty).collect()} <= {0, 1}


def test_toxicity_of_copies(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(30))) for k in range(300)]  # no word goes with a label
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id bigint, toxic int")
    asked = spark.createDataFrame([(1000 + k, t) for k, t in rows] + [(2000, "none of these")], "doc_id bigint, text string")
    model = knn_toxicity.train(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    got = {r["doc_id"] - 1000: r for r in knn_toxicity.score(asked, model).collect()}
    assert all(got[k]["evidence"][0] == k and got[k]["evidence_cosine"][0] == pytest.approx(1) and got[k]["evidence_cosine"][1] < 0.9 for k in range(300))
    assert len({got[k]["score"] for k in range(0, 300, 3)}) == 1 and got[0]["score"] > got[1]["score"]
    assert got[1000]["evidence"] == []


def test_toxic_terms_behind_a_header():
    rng = random.Random(9)
    header = "Licensed to the readers of this collection under the terms that are printed on its back. "
    texts = [header + " ".join(rng.choice(["vile", "awful"]) if k < 40 and n == 9 else f"w{rng.randrange(900)}" for n in range(40)) for k in range(120)]
    labels = [int(k < 40) for k in range(120)]
    copies = [texts[50] + f" x{k}" for k in range(60)]  # near copies count once
    chosen = set(knn_toxicity.chosen_terms(knn_toxicity.example_words([t.encode() for t in texts + copies]), labels + [0] * 60).tolist())
    hashed = lambda w: int(knn_toxicity.hasher().words([w.encode()])[1][0])
    assert {hashed("vile"), hashed("awful")} <= chosen and not any(hashed(w) in chosen for w in texts[50].split()[16:])
    words = [set(rng.choices(texts[k % 9].split(), k=rng.randint(0, 40))) for k in range(400)]
    kept = []
    for i, s in enumerate(words):
        if not any(labels[i % 120] == labels[j % 120] and 5 * len(s & words[j]) >= 4 * len(s | words[j]) for j in kept):
            kept.append(i)
    number = {w: k for k, w in enumerate({w for s in words for w in s})}
    sets = [np.array(sorted(number[w] for w in s), dtype=np.uint64) for s in words]
    assert knn_toxicity.distinct(sets, [labels[i % 120] for i in range(400)]) == kept


def test_terms_of_texts(monkeypatch):
    """Numbers and counts of words and known beginnings against Python's own words, at every piece's boundary."""
    import re
    from collections import Counter

    monkeypatch.setattr(knn_toxicity, "_PIECE", 32)
    rng, h = random.Random(12), knn_toxicity.hasher()
    parts = ["a", "Bcd", "été", "ÉTÉS", "İx", "σας", "ΣΑΣ", "_1", "½", "日本", " ", "  ", "\n", ".", "-", "’", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))).encode() for _ in range(60)] + [b"", b"..", b"\xff\xfeab"]
    want = [Counter(re.findall(r"\w+", t.decode("utf-8", "replace").lower())) for t in texts]
    of, words, stems = h.words(texts)
    flat = [w for t in texts for w in re.findall(r"\w+", t.decode("utf-8", "replace").lower())]
    assert of.tolist() == [k for k, c in enumerate(want) for _ in range(c.total())] and len(flat) == len(words)
    number = dict(zip(flat, words.tolist()))
    assert words.tolist() == [number[w] for w in flat] and len(set(number.values())) == len(number)
    stem = {w[:n] + "*": int(x) for n, xs in zip((5, 7), stems) for w, x in zip(flat, xs) if len(w) > n}
    assert all((int(x) == 0) == (len(w) <= n) for n, xs in zip((5, 7), stems) for w, x in zip(flat, xs)) and len(set(stem.values()) | set(number.values())) == len(stem) + len(number)
    some = sorted(number)[::2]
    known = knn_toxicity.Terms(np.array(sorted([number[w] for w in some] + list(stem.values())[::2]), dtype=np.uint64))
    for c, (terms, n) in zip(want, known.of(texts)):
        got = {int(known.hashes[t]): k for t, k in zip(terms.tolist(), n.tolist()) if t < len(known)}
        expect = Counter({number[w]: k for w, k in c.items() if w in some})
        for w, k in c.items():
            expect.update({stem[w[:m] + "*"]: k for m in (5, 7) if len(w) > m and stem[w[:m] + "*"] in known.hashes})
        assert got == expect and int(n[terms >= len(known)].sum()) == sum(k for w, k in c.items() if w not in some)


def test_toxic_passage_far_on(spark):
    rng = random.Random(10)
    rows = [(k, " ".join(f"w{rng.randrange(2000)}" for _ in range(20 if k % 2 else 14_000)) + (" vile" if k % 4 < 2 else "")) for k in range(24)]
    assert all(t.find("vile") > 1 << 16 for k, t in rows if k % 4 == 0)
    docs_ = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = knn_toxicity.train(docs_, spark.createDataFrame([(k, int(k % 4 < 2)) for k in range(24)], "doc_id bigint, toxic int"))
    vile = int(model.known.numbers(knn_toxicity.hasher().words([b"vile"])[1])[0])
    assert vile >= 0 and sum(vile in v[0] for v in model.vectors([t.encode() for _, t in rows])) == 12
    held = [i for _, i in model.index.search(np.array([vile]), np.ones(1), 24)]
    assert sorted(model.ids[i] for i in held) == [k for k in range(24) if k % 4 < 2]


# ---- 7


@pytest.mark.parametrize("length", [100, 40, 33])
def test_suffixes(docs, none, length):
    want = spans_by_brute_force(corpus(), length)
    got = by_id(suffix_dedup.suffix_dedup(docs, length=length))
    assert {i: (r["n_bytes"], r["n_removed"], [list(s) for s in r["spans"]], bytes(r["kept"])) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 5000
    if length == 100:
        assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffixes_over_boundaries(spark):
    """One passage in most texts, over more buckets than grams: classes must meet across boundaries."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(160))
    rows = [(k, "".join(rng.choice("ijklmnop ") for _ in range(rng.randint(0, 90))) + (passage if k % 5 else "") + "".join(rng.choice("qrstuv") for _ in range(rng.randint(0, 90)))) for k in range(150)]
    df = spark.createDataFrame([*rows, (None, passage)], "doc_id bigint, text string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = suffix_dedup.suffix_dedup(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = spans_by_brute_force(rows, 100)
    assert {r["doc_id"]: [list(s) for s in r["spans"]] for r in got if r["doc_id"] is not None} == {i: w[2] for i, w in want.items()}
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0]


def test_multikey_classes():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    group = rng.integers(0, 4, 500)
    cls = suffix_dedup.equal_windows(group, words)
    seen = {}
    for g, w, c in zip(group.tolist(), map(tuple, words.tolist()), cls.tolist()):
        assert seen.setdefault((g, w), c) == c
    assert len(set(seen.values())) == len(seen)


# ---- 8


def test_packing(docs, none):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = vector_packing.pack(docs, tokens=256, segments=6).collect()
    texts = dict(corpus())
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(texts)
    for i, ps in pieces.items():
        ids = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        ps.sort(key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in ps) == ids.tobytes() and [p["start"] for p in ps] == np.cumsum([0, *[p["length"] for p in ps]])[:-1].tolist()
        assert all(p["doc_tokens"] == len(ids) for p in ps)
    for ps in sequences.values():
        ps.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in ps] == np.cumsum([0, *[p["length"] for p in ps]])[:-1].tolist()
        assert sum(p["length"] for p in ps) <= 256 and len(ps) <= 6
    assert vector_packing.pack(none).count() == 0


@pytest.mark.parametrize("text", [" " * 1_200_000 + "x", "\n" * 1_200_000, "ab" * 600_000, "a" * 700_000 + "\u00a0" * 700_000, "1 \n" * 400_000])
def test_texts_of_one_long_run(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    got = sorted(vector_packing.pack(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")).collect(), key=lambda r: (r["doc_id"], r["start"]))
    assert b"".join(bytes(r["ids"]) for r in got if r["doc_id"] == 1) == np.array([*want, 1], dtype="<u4").tobytes()
    assert [r["length"] for r in got if r["doc_id"] == 2] == [1]


def test_packer_limits():
    rng = np.random.default_rng(2)
    p = vector_packing.Packer((100, 5, 40))
    total = 0
    for k in range(80):
        n = int(rng.integers(1, 130))
        p.add(k, np.arange(n), rng.random(n) < 0.4)
        total += n
    by = {}
    for seq, offset, key, start, ids, loss in p.drain(0):
        by.setdefault(seq, []).append((offset, key, start, len(ids), int(loss.sum())))
    assert sum(x[3] for v in by.values() for x in v) == total and all(sum(x[3] for x in v) <= 100 and len(v) <= 5 and sum(x[4] for x in v) <= 40 for v in by.values())


def test_packer_by_brute_force():
    """Every placement against the dot products of all waiting items."""
    rng, other = np.random.default_rng(3), 0
    limits = (100, 6, 30)
    p, waiting = vector_packing.Packer(limits), []
    for k in range(120):
        n = int(rng.integers(1, 60))
        loss = np.arange(n) >= rng.integers(0, n + 1)
        p.add(k, np.arange(n), loss)
        waiting.append((k, 0, n, int(loss.sum())) if loss.sum() <= 30 else None)
    waiting = [(key, start, len(ids), int(loss.sum())) for held in p.queue.values() for key, start, ids, loss in held]
    last, left = -1, None
    for seq, _, key, start, ids, loss in p.drain(0):
        left = np.array(limits, float) if seq != last else left
        last = seq
        own = next(w for w in waiting if w[:2] == (key, start))
        worth = lambda w: np.array([w[2], 1, w[3]]) / limits @ (left / limits)  # noqa: E731, B023
        fit = [w for w in waiting if (np.array([w[2], 1, w[3]]) <= left).all()]
        assert abs(worth(own) - max(map(worth, fit or waiting))) < 1e-12 and (not fit) == (len(ids) < own[2])
        other += bool(fit) and own[2] < max(w[2] for w in fit)
        waiting.remove(own)
        if len(ids) < own[2]:
            waiting.append((key, start + len(ids), own[2] - len(ids), own[3] - int(loss.sum())))
        left -= (len(ids), 1, loss.sum())
    assert not waiting and other > 5  # the choice is often not the longest


def test_many_short_texts():
    import time

    p = vector_packing.Packer((2048, 64, 2048))
    for k in range(200_000):
        p.add(k, np.ones(1, np.uint32))
    began = time.time()
    assert sum(1 for _ in p.drain(0)) == 200_000 and time.time() - began < 60


def test_packing_of_instructions(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    asked = turns.where("role = 'user'").selectExpr("conv_id", "turn + 1 AS turn", "text AS prompt")
    pairs = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"], "left").repartition(2).checkpoint()
    got = vector_packing.pack(pairs, "conv_id", prompt_col="prompt", tokens=512, segments=8, loss_tokens=200).collect()
    sums = {}
    for r in got:
        x = sums.setdefault(r["sequence_id"], [0, 0, 0])
        x[0], x[1], x[2] = x[0] + r["length"], x[1] + 1, x[2] + r["loss_tokens"]
    assert all(a <= 512 and b <= 8 and c <= 200 for a, b, c in sums.values()) and sum(c >= 193 for _, _, c in sums.values()) > len(sums) // 2
    import public_tokenizers

    n = lambda t: len(vector_packing.encode(t or "", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rows = pairs.collect()
    assert sum(c for _, _, c in sums.values()) == sum(n(r["text"]) + 1 for r in rows) and sum(a for a, _, _ in sums.values()) == sum(n(r["text"]) + n(r["prompt"]) + 1 for r in rows)


def test_special_strings_and_both_encoders():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a<|endoftext|>b", " naïve  x\n\n y", "'s 12³ ½ 中文 😀\x85z", ""):
        ids = vector_packing.encode(text, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


# ---- 9


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 64))
    rows = []
    for k in range(900):
        v = centres[k % 30] + rng.standard_normal(64) * rng.choice([0.05, 0.2, 0.4])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 3) if k % 50 else None))
    rows += [(900, rows[1][1], rows[1][2]), (901, None, 1), (902, [0.0] * 64, 1), (903, [float("nan")] * 64, 1), (904, [1.0, None], 1), (905, [float("inf")] + [1.0] * 63, 1), (906, [], 1), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    got = {r["id"]: r for r in collision_projections.near_groups(df).collect()}
    links = {}
    sound = [(i, np.array(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    for a, x, la in sound:
        for b, y, lb in sound:
            if a < b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links.setdefault(a, set()).add(b)
                links.setdefault(b, set()).add(a)
    total = sum(map(len, links.values()))
    assert len(got) == len(rows) and all(got[i]["n_links"] <= len(links.get(i, ())) for i in got) and sum(r["n_links"] for r in got.values()) >= 0.97 * total > 1000
    assert all(got[i]["n_links"] == 0 and got[i]["component"] == i and got[i]["kept"] for i in (901, 902, 903, 904, 905, 906, 0, 50))
    assert got[900]["n_links"] == got[1]["n_links"] >= 1 and got[908]["component"] == 907
    assert collision_projections.near_groups(df.limit(0)).count() == 0


def test_hot_cells_are_split(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(64)
    rows = [(k, [float(x) for x in centre + rng.standard_normal(64) * 0.01], 0) for k in range(150)]
    monkeypatch.setattr(collision_projections, "BLOCK", 16)
    got = collision_projections.near_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert {r["n_links"] for r in got} == {149} and {r["component"] for r in got} == {0}


def test_calibration():
    for n in (100, 10_000, 1_000_000):
        lines, bits, _, count = collision_projections.calibrate(64, 0.93, n)
        assert count == 2 and lines < 60 and bits <= 12


# ---- 10


def test_bpe(docs, none):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got, sums = by_id(bitmap_bpe.bpe_tokens(docs)), by_id(bitmap_bpe.bpe_digests(docs))
    for i, t in corpus():
        ids = enc.encode_ordinary(t or "")
        assert list(got[i]["ids"]) == ids and bytes(got[i]["decoded"]) == (t or "").encode()
        assert (sums[i]["n_tokens"], sums[i]["ids_sha256"], sums[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bitmap_bpe.bpe_tokens(none).count() == 0
    bpe, rng = bitmap_bpe.load(path), random.Random(3)
    parts = ["a", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "é", "ß", "²", "½", "Ⅷ", "中", "😀", "'s", "1", "..", "!", "ª", "the", "ing", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert bpe.encode(text) == enc.encode_ordinary(text)
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))).encode() for _ in range(2000)]
    assert bpe.merge_many(words) == [tuple(bpe.merge(w)) for w in words]
    for text in ("a" * 20_000, "ab" * 9_000, "é" * 3_000):
        assert bpe.encode(text) == enc.encode_ordinary(text)


def test_rank_queue():
    q, rng, held = bitmap_bpe.RankQueue(300_000), random.Random(5), []
    for _ in range(4000):
        if held and rng.random() < 0.5:
            held.sort()
            r, at = held.pop(0)
            assert q.least() == r and q.take(r) == at
        else:
            held.append((rng.randrange(300_000), rng.randrange(1000)))
            q.push(*held[-1])
    assert (q.least() < 0) == (not held)

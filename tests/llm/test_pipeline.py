"""The pipeline's stages on small documents, each against brute force on its own input."""

import corpus_pipeline as p
import pytest

from tests_llm_support import components_by_brute_force, corpus, fingerprint_by_brute_force, lines_by_brute_force, spans_by_brute_force


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows = [(i, t, "en" if i % 4 else None, f"s{i % 3}", 1) for i, t in corpus()]
    out = [spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")]
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], "/none").write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    assert all(df.columns == p.COLUMNS for df in stages[1:5]) and p.ORACLE_SQL is None


def test_stages(stages):
    read = [texts(s) for s in stages[:5]]
    assert set(read[0]) - set(read[1]) == {i for i, t in read[0].items() if not any(c.isalpha() for c in t or "")}
    lines = lines_by_brute_force(read[1].items())
    assert read[2] == {i: t for i, t in lines.items() if t == read[1][i] or t.strip()}
    fps = {i: fingerprint_by_brute_force(t) for i, t in read[2].items()}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    groups = components_by_brute_force(fps, linked)
    assert read[3] == {i: read[2][i] for i in fps if groups[i] == i}
    cut = spans_by_brute_force(read[3].items(), 100)
    assert read[4] == {i: v[3].decode("utf-8", "ignore") for i, v in cut.items() if v[3] or not v[0]}
    packed = stages[5].collect()
    assert {r["doc_id"] for r in packed} == set(read[4])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in p.STAGES:
        assert stage(spark, none, "/none").count() == 0


def test_rows_without_an_id_stay(spark):
    rows = [(None, "first words here", "en", "s", 1), (None, "other words there", "en", "s", 1), (5, "first words here", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "/none").checkpoint()
    assert docs.count() == 3

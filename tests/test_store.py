"""The store under several writers, and what a write touches."""

import threading

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import ingest
from shelfspark.schema import TABLES
from shelfspark.sources import store


def texts(spark, pairs):
    return spark.createDataFrame(pairs, TABLES["text"])


def held(spark, folder):
    return sorted(tuple(r) for r in store.read_tables(spark, folder)["text"].collect())


def test_the_second_of_two_writers_raises(spark, tmp_path):
    folder = str(tmp_path / "s")
    store.write_tables(spark, folder, {"text": texts(spark, [("a", "1")])})
    one, two = store.read_tables(spark, folder), store.read_tables(spark, folder)
    assert one.version == two.version == 1
    store.write_tables(spark, folder, one | {"text": ingest.upsert(one["text"], texts(spark, [("b", "2")]))})
    with pytest.raises(RuntimeError):
        store.write_tables(spark, folder, two | {"text": ingest.upsert(two["text"], texts(spark, [("c", "3")]))})
    with pytest.raises(RuntimeError):
        store.write_tables(spark, folder, {"text": two["text"]}, base=1)
    assert held(spark, folder) == [("a", "1"), ("b", "2")] and store.read_tables(spark, folder).version == 2


def test_one_of_many_claims_a_version(spark, tmp_path):
    (tmp_path / "s").mkdir()
    won = []
    writers = [threading.Thread(target=lambda k=k: won.append(k) if store._claimed(spark, str(tmp_path / "s" / "CURRENT-1"), str(k)) else None) for k in range(8)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(won) == 1 and (tmp_path / "s" / "CURRENT-1").read_text() == str(won[0]) and not list((tmp_path / "s").glob("_new-*"))


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = str(tmp_path / "s")
    many = spark.range(1_000).select(F.concat(F.lit("main/"), F.col("id").cast("string")).alias("path"), F.lit("old").alias("body"))
    store.write_tables(spark, folder, {"text": many, "tag_history": spark.createDataFrame([("t", 1)], TABLES["tag_history"])})
    before = store._manifest(spark, store.current(spark, folder))["text"]
    tables, new = store.read_tables(spark, folder), many.limit(3).withColumn("body", F.lit("new"))
    gone = spark.createDataFrame([("main/999",)], "path string")
    changed = ingest.upsert(tables["text"], new).join(gone, "path", "left_anti")
    store.write_tables(spark, folder, tables | {"text": changed}, touched=new.select("path").union(gone))
    after = store._manifest(spark, store.current(spark, folder))["text"]
    moved = {b for b in before if before[b] != after.get(b)}
    assert len(before) == store.BUCKETS and 1 <= len(moved) <= 4 and set(after) == set(before)
    assert sorted(b for (b,) in new.select("path").union(gone).select(store.bucket_of()).distinct().collect()) == sorted(map(int, moved))
    got = held(spark, folder)
    assert len(got) == 999 and sum(b == "new" for _, b in got) == 3
    assert [tuple(r) for r in store.read_tables(spark, folder)["tag_history"].collect()] == [("t", 1)]


def test_a_bucket_that_empties(spark, tmp_path):
    folder = str(tmp_path / "s")
    store.write_tables(spark, folder, {"text": texts(spark, [("a", "1")])})
    tables = store.read_tables(spark, folder)
    store.write_tables(spark, folder, tables | {"text": tables["text"].where("path <> 'a'")}, touched=tables["text"].select("path"))
    assert held(spark, folder) == []

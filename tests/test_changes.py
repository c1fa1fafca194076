import random

from pyspark.sql import functions as F

from shelfspark.streaming import changes

LISTED = "path string, size bigint, mtime double, deleted boolean"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


class Feed:
    def __init__(self, spark, tmp_path, schema=LISTED):
        self.spark, self.tmp, self.schema = spark, tmp_path, schema
        self.incoming, self.log, self.checkpoint = (str(tmp_path / n) for n in ("in", "log", "c"))

    def put(self, new):
        self.spark.createDataFrame(new, self.schema).coalesce(1).write.mode("append").parquet(self.incoming)

    def listing(self, new=(), **more):
        if new:
            self.put(new)
        changes.stream_listing(self.spark, self.incoming, self.log, self.checkpoint, **more).awaitTermination()

    def again(self, batch):
        """As if the last batch had died just before it was noted as done."""
        for name in (str(batch), f".{batch}.crc"):
            (self.tmp / "c" / "commits" / name).unlink(missing_ok=True)

    def written(self, batch):
        return rows(self.spark.read.parquet(f"{self.log}/changes/batch={batch}").select("path", "change"))


def test_a_batch_writes_what_it_changed(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.listing([("a", 1, 1.0, False), ("b", 2, 1.0, False), ("c", 3, None, None), (None, 1, 1.0, False)])
    assert feed.written(0) == [("a", "new"), ("b", "new"), ("c", "new")]
    # an equal row and the deletion of an unknown path say nothing
    feed.listing([("a", 1, 1.0, False), ("b", 2, 7.0, False), ("x", None, None, True), ("c", None, None, True)])
    assert feed.written(1) == [("b", "changed"), ("c", "gone")]
    feed.listing([("c", 3, 2.0, False)])
    assert feed.written(2) == [("c", "new")] and rows(changes.listed(spark, feed.log)) == [("a", 1, 1.0), ("b", 2, 7.0), ("c", 3, 2.0)]
    before = feed.written(2)
    feed.again(2)
    feed.listing()
    assert feed.written(2) == before and rows(changes.listed(spark, feed.log)) == [("a", 1, 1.0), ("b", 2, 7.0), ("c", 3, 2.0)]
    changes.compact(spark, feed.log)
    feed.listing([("a", None, None, True)])
    assert rows(changes.listed(spark, feed.log)) == [("b", 2, 7.0), ("c", 3, 2.0)]
    assert "upto=2" in {p.name for p in (tmp_path / "log" / "base").iterdir()}


def test_mass_deletions_wait(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.listing([(f"f{k:03}", 1, 1.0, False) for k in range(100)])
    feed.listing([(f"f{k:03}", None, None, True) for k in range(60)] + [("new", 1, 1.0, False)])
    assert changes.listed(spark, feed.log).count() == 101 and changes.held(spark, feed.log) == [1]
    feed.again(1)
    feed.listing()
    assert changes.listed(spark, feed.log).count() == 101 and changes.held(spark, feed.log) == [1]
    feed.listing([("f000", 2, 9.0, False)])
    changes.compact(spark, feed.log)
    changes.release(spark, feed.log, 1)
    left = {r[0] for r in rows(changes.listed(spark, feed.log))}
    assert left == {"new", "f000"} | {f"f{k:03}" for k in range(60, 100)} and changes.held(spark, feed.log) == []
    feed.listing([(f"f{k:03}", None, None, True) for k in range(100)] + [("new", 1, 2.0, False)], force=True)
    assert rows(changes.listed(spark, feed.log)) == [("new", 1, 2.0)]


def test_totals_of_tags(spark, tmp_path):
    feed = Feed(spark, tmp_path, "tag string")
    run = lambda: changes.stream_tag_uses(spark, feed.incoming, feed.log, feed.checkpoint).awaitTermination()
    rng, want = random.Random(3), {}
    for k in range(3):
        new = [rng.choice("abcdef"[: 2 * k + 2]) for _ in range(40)] if k < 2 else ["a", None]
        feed.put([(t,) for t in new])
        run()
        for t in filter(None, new):
            want[t] = want.get(t, 0) + 1
    assert dict(rows(changes.tag_uses(spark, feed.log))) == want
    assert rows(spark.read.parquet(f"{feed.log}/changes/batch=2").select("tag")) == [("a",)]
    feed.again(2)
    run()
    assert dict(rows(changes.tag_uses(spark, feed.log))) == want
    assert spark.conf.get(changes._PROVIDER) != changes._ROCKS and changes.tag_uses(spark, str(tmp_path / "none")).agg(F.sum("uses")).first()[0] is None

"""Bookkeeping of texts read from images: work queues, status, precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import numbered


def done_paths(text_meta: DataFrame, manual: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that need no reading: read, reviewed, or with text of their own."""
    return text_meta.select("path").union(manual.select("path")).union(files.where("text_in_file").select("path")).distinct()


def awaiting(files: DataFrame, text_meta: DataFrame, manual: DataFrame) -> DataFrame:
    return files.where("kind = 'image'").join(done_paths(text_meta, manual, files), "path", "left_anti")


def queue(files: DataFrame, text_meta: DataFrame, manual: DataFrame, engine: str, limit: int = 0) -> DataFrame:
    """Images that this engine hasn't read and nobody reviewed, by path; limit 0 is all."""
    done = text_meta.where(F.col("engine") == engine).select("path").union(manual.select("path"))
    out = files.where("kind = 'image'").join(done.distinct(), "path", "left_anti").select("path").orderBy("path")
    return out.limit(limit) if limit else out


def engine_stats(files: DataFrame, text_meta: DataFrame) -> DataFrame:
    """(engine, n, avg_secs, last_read, remaining) over images."""
    images = files.where("kind = 'image'")
    total = images.agg(F.count("*").alias("images"))
    stats = text_meta.join(images.select("path"), "path").groupBy("engine").agg(F.count("*").alias("n"), F.round(F.avg("secs"), 2).alias("avg_secs"), F.max("read_at").alias("last_read"))
    return stats.join(F.broadcast(total)).select("engine", "n", "avg_secs", "last_read", (F.col("images") - F.col("n")).alias("remaining")).orderBy(F.desc("n"), "engine")


def totals(files: DataFrame, text: DataFrame) -> DataFrame:
    """(images, with_text, embed_pending): images, those with a text that isn't empty, and of those the ones whose file holds none."""
    rows = files.where("kind = 'image'").join(text, "path", "left")
    has = F.coalesce(F.col("body") != "", F.lit(False))
    return rows.agg(F.count("*").alias("images"), F.count_if(has).alias("with_text"), F.count_if(has & ~F.col("text_in_file")).alias("embed_pending"))


def unread(files: DataFrame, text_meta: DataFrame, manual: DataFrame, engine: str) -> DataFrame:
    """(unread, newer): images that the engine hasn't read and nobody reviewed, and how many of them came after its last reading."""
    mine = text_meta.where(F.col("engine") == engine)
    last = mine.agg(F.coalesce(F.max("read_at"), F.lit(0.0)).alias("last"))
    left = files.where("kind = 'image'").join(mine.select("path"), "path", "left_anti").join(manual.select("path"), "path", "left_anti")
    return left.join(F.broadcast(last)).agg(F.count("*").alias("unread"), F.count_if(F.col("indexed_at") > F.col("last")).alias("newer"))


def store(text: DataFrame, text_meta: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after readings (path, body, engine, read_at, secs)."""
    from .ingest import upsert

    return upsert(text, read.select("path", "body")), upsert(text_meta, read.select("path", "engine", "read_at", "secs"))


def already_embedded(reviewed, file_text, saved):
    """Nothing to write: the file was reviewed or holds the saved text."""
    return F.coalesce(F.col(reviewed), F.lit(False)) | F.col(file_text).eqNullSafe(F.col(saved))


def saved_texts(files: DataFrame, text: DataFrame) -> DataFrame:
    """(path, body) of the images' saved texts that aren't empty, by path."""
    images = files.where("kind = 'image'").select("path")
    return text.where("length(body) > 0").join(images, "path", "left_semi").select("path", "body").orderBy("path")


def embed_work(files: DataFrame, text: DataFrame, in_file: DataFrame, source: str | None = None, limit: int = 0) -> DataFrame:
    """(path, body) that a pass writes into files: saved texts of one source's images (None: of all), by path.

    in_file (path, reviewed, file_text) says what a file holds; files that were reviewed or hold the text are skipped and
    don't count against the limit (0: none). Files that in_file lacks hold nothing.
    """
    rows = saved_texts(files, text)
    if source is not None:
        rows = rows.where(F.col("path").startswith(source + "/"))
    rows = rows.join(in_file.select("path", "reviewed", "file_text"), "path", "left")
    rows = rows.where(~already_embedded("reviewed", "file_text", "body")).select("path", "body").orderBy("path")
    return rows.limit(limit) if limit else rows


def editor_text(reviewed, machine, file_text):
    """The text an editor starts from: the reviewed one, else the machine's if not empty, else the file's."""
    return F.coalesce(reviewed, F.when(machine != "", machine), file_text, F.lit(""))


def action_text(file_text, machine):
    """The text an action works on: the file's if not blank, else the machine's."""
    return F.when(F.trim(F.coalesce(file_text, F.lit(""))) != "", file_text).otherwise(machine)


def fresh_artefact(artefact_mtime, indexed_mtime):
    """A cached artefact holds if it isn't over a second older than the file."""
    return F.col(artefact_mtime) + 1.0 >= F.col(indexed_mtime)


#: Rows of a log that a task looks at together when it looks for runs.
_CHUNK = 1 << 16


def passes(log: DataFrame, by: str, order: list[str], run: int = 20, limit: int = 0) -> DataFrame:
    """(by, attempts, errors, stopped) of each pass over a work queue, from its log (by, order, outcome): ok, error or skip.

    A pass stops at the end of its first `run` errors in a row, which any other outcome interrupts, or with `limit`
    attempts; skips are no attempts; limit 0 is none. stopped says that it was the errors. What the log holds of a pass
    after its stop isn't counted. Runs are found in pieces of the sorted log that overlap by run - 1 rows, so a pass
    of any length is spread over tasks. Passes without an attempt have zeros; null outcomes are skips.
    """
    rows = log.select(F.col(by).alias("by"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.coalesce("outcome", F.lit("skip")).alias("outcome"))
    rows = numbered(rows, ["by", *[f"o{k}" for k in range(len(order))]]).select("by", "outcome", "number")
    chunk = F.expr(f"number div {_CHUNK}")
    near = F.when(F.col("number") % _CHUNK >= _CHUNK - run + 1, chunk + 1)
    pieces = rows.select("*", F.explode(F.array_compact(F.array(chunk, near))).alias("piece"))
    behind = Window.partitionBy("piece", "by").orderBy("number").rowsBetween(1 - run, 0)
    ends = pieces.withColumn("bad", F.count_if(F.col("outcome") == "error").over(behind)).where(F.col("bad") == run)
    ends = ends.groupBy("by").agg(F.min("number").alias("run_end"))
    tried = numbered(rows.where("outcome <> 'skip'"), ["number"], "nth")
    firsts = tried.groupBy("by").agg(F.min("nth").alias("first"))
    last = tried.join(firsts, "by").where(F.col("nth") - F.col("first") == limit - 1).select("by", F.col("number").alias("limit_end")) if limit else firsts.select("by", F.lit(None).cast("bigint").alias("limit_end"))
    known = rows.groupBy("by").agg(F.max("number").alias("end")).join(ends, "by", "left").join(last, "by", "left")
    known = known.select("by", F.least("end", "run_end", "limit_end").alias("end"), (F.col("run_end").isNotNull() & (F.col("run_end") <= F.least("end", "run_end", "limit_end"))).alias("stopped"))
    out = rows.join(known, "by").where("number <= end").groupBy("by", "stopped").agg(F.count_if(F.col("outcome") != "skip").alias("attempts"), F.count_if(F.col("outcome") == "error").alias("errors"))
    return out.select(F.col("by").alias(by), "attempts", "errors", "stopped")

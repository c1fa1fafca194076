"""Incremental ingestion: what a listing changes, and the merge of scanned files into the tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CARRIED, PER_PATH


def listing_diff(local: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, change) of (path, size, mtime) tables: new, changed (size or mtime not exactly equal) or gone."""
    a = local.select("path", F.col("size").alias("ls"), F.col("mtime").alias("lm"), F.lit(True).alias("have"))
    b = listed.select("path", F.col("size").alias("rs"), F.col("mtime").alias("rm"), F.lit(True).alias("there"))
    change = F.when(F.col("have").isNull(), "new").when(F.col("there").isNull(), "gone").when(~(F.col("ls").eqNullSafe(F.col("rs")) & F.col("lm").eqNullSafe(F.col("rm"))), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


@dataclass(frozen=True)
class Guards:
    """Whether rows of gone files may be deleted, and why not."""

    delete: bool
    reason: str = ""


def guards(local_rows: int, gone: int, listed_rows: int, failed_scans: int = 0, force: bool = False) -> Guards:
    """An empty listing and any failed scan keep all rows; so does a mass deletion (over 50 and over a twentieth) unless forced."""
    if local_rows and not listed_rows:
        return Guards(False, "the listing is empty")
    if failed_scans:
        return Guards(False, f"{failed_scans} scans failed")
    if gone > 50 and gone * 20 > local_rows and not force:
        return Guards(False, f"{gone} of {local_rows} files would go")
    return Guards(True)


def renames(gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """(old_path, new_path) of (path, id) tables where an id is unique among the gone and among the fresh."""

    def once(df, name):
        return df.groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias(name)).where("n = 1").drop("n")

    return once(gone, "old_path").join(once(fresh, "new_path"), "id").select("old_path", "new_path")


def carry(table: DataFrame, moved: DataFrame) -> DataFrame:
    """A table keyed by path after renames: rows move to the new path only if that has none yet."""
    taken = table.select(F.col("path").alias("new_path")).distinct()
    free = moved.join(taken, "new_path", "left_anti")
    out = table.join(free, table.path == free.old_path, "left")
    return out.select(*[F.coalesce("new_path", "path").alias("path") if c == "path" else F.col(c) for c in table.columns])


def forget(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of the paths."""
    return {k: t.join(paths.select("path"), "path", "left_anti") if k in PER_PATH else t for k, t in tables.items()}


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path) of files (path, id) whose caches no longer hold: the id changed and is of the same kind, 16 characters or not, as before."""
    both = old.select("path", F.col("id").alias("a")).join(new.select("path", F.col("id").alias("b")), "path")
    return both.where((F.col("a") != F.col("b")) & ((F.char_length("a") == 16) == (F.char_length("b") == 16))).select("path")


def upsert(table: DataFrame, rows: DataFrame, keys=("path",)) -> DataFrame:
    """rows replace those of equal keys."""
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows)


def insert_new(table: DataFrame, rows: DataFrame, keys) -> DataFrame:
    """rows are added where no row of equal keys is yet."""
    return table.unionByName(rows.join(table.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)))


def add_counts(history: DataFrame, used: DataFrame) -> DataFrame:
    """(tag, uses) with each use in used (tag, uses) added."""
    return history.unionByName(used.select("tag", "uses")).groupBy("tag").agg(F.sum("uses").alias("uses"))


def merge_scans(tables: dict[str, DataFrame], scans: DataFrame, expand) -> dict[str, DataFrame]:
    """The tables after scans (files' columns, xmp_tags, folder_tags, text, manual).

    Files and their tags are replaced; expand(tags) gives the implied ones. A changed id of the same kind drops the
    caches. Reviewed text goes to manual_text; without it a file loses its reviewed text, and its own text replaces the
    machine's. text_in_file says that the file itself held text.
    """
    out = dict(tables)
    paths = scans.select("path").distinct()
    drop = stale(tables["files"], scans)
    for name in CARRIED:
        if name in out:
            out[name] = out[name].join(drop, "path", "left_anti")
    columns = tables["files"].columns
    held = scans.withColumn("text_in_file", F.col("text").isNotNull())
    out["files"] = upsert(tables["files"], held.select(*columns))
    own = scans.select("path", F.explode("xmp_tags").alias("tag")).withColumn("source", F.lit("xmp")).union(scans.select("path", F.explode("folder_tags").alias("tag")).withColumn("source", F.lit("folder"))).distinct()
    implied = expand(own).select("path", "tag").withColumn("source", F.lit("implied"))
    out["tags"] = tables["tags"].join(paths, "path", "left_anti").unionByName(own).unionByName(implied)
    manual = scans.where("manual AND text IS NOT NULL").select("path", F.col("text").alias("body"))
    machine = scans.where("NOT manual AND text IS NOT NULL").select("path", F.col("text").alias("body"))
    out["manual_text"] = out["manual_text"].join(paths, "path", "left_anti").unionByName(manual)
    out["text"] = upsert(out["text"], machine)
    return out


def import_tags(tables: dict[str, DataFrame], scans: DataFrame, expand) -> dict[str, DataFrame]:
    """The tables after scans that followed an edit of tags alone: as merge_scans, but a file's own text doesn't replace the machine's; reviewed text still counts. text_in_file goes by the scan."""
    out = merge_scans(tables, scans.withColumn("text", F.when(F.col("manual"), F.col("text"))), expand)
    held = scans.select("path", F.col("text").isNotNull().alias("__held"))
    files = out["files"].join(held, "path", "left").withColumn("text_in_file", F.coalesce("__held", "text_in_file"))
    return out | {"files": files.select(*tables["files"].columns)}


def with_source_prefix(tables: dict[str, DataFrame], source: str = "main") -> dict[str, DataFrame]:
    """Tables of an older layout with every path moved under a source."""
    return {k: t.withColumn("path", F.concat(F.lit(source + "/"), "path")) if "path" in t.columns else t for k, t in tables.items()}


def folded(view: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """A loaded view after a pull: written and gone rows out, fresh ones in, newest first."""
    out = view.join(gone.select("path"), "path", "left_anti").join(fresh.select("path"), "path", "left_anti")
    return out.unionByName(fresh).orderBy(F.desc("created_at"), "path")

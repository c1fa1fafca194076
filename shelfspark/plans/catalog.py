"""A collection's tables and the views that searches run over."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import distance, informative
from ..schema import TABLES, empty
from . import query as q
from .compiler import tag_test, text_test, to_column


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.asc("path"))


def in_scope(path, include: list[str], exclude: list[str] = ()) -> Column:
    """True where the deepest included folder above the path lies below the deepest excluded one; `.` is the root."""

    def depth(folder: str) -> int:
        return 0 if folder == "." else folder.count("/") + 1

    def deepest(folders) -> Column:
        best = F.lit(-1)
        for f in folders:
            under = F.lit(True) if f == "." else (path == f) | path.startswith(f + "/")
            best = F.greatest(best, F.when(under, depth(f)).otherwise(-1))
        return best

    path = F.col(path) if isinstance(path, str) else path
    return deepest(include) > deepest(exclude)


def selection(sources: dict[str, dict]) -> Column:
    """Paths (id/relative) of enabled sources: each source has enabled, include and exclude."""
    out = F.lit(False)
    for key, s in sources.items():
        if s.get("enabled", True):
            rel = F.expr(f"substring(path, {len(key) + 2})")
            out = out | (F.col("path").startswith(key + "/") & in_scope(rel, s.get("include", ["."]), s.get("exclude", [])))
    return out


class Catalog:
    """Tables by name; those that aren't given are empty."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], scope: Column | None = None):
        self.spark, self.tables, self.scope = spark, dict(tables), scope

    @classmethod
    def read(cls, spark: SparkSession, folder: str, scope: Column | None = None) -> Catalog:
        """The Parquet tables of a folder (see sources.store for versions)."""
        from ..sources.store import read_tables

        return cls(spark, read_tables(spark, folder), scope)

    def table(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else empty(self.spark, name)

    def files(self, scoped: bool = True) -> DataFrame:
        f = self.table("files")
        return f.where(self.scope) if scoped and self.scope is not None else f

    def tag_sets(self) -> DataFrame:
        return self.table("tags").groupBy("path").agg(F.sort_array(F.collect_set("tag")).alias("tags"))

    def texts(self) -> DataFrame:
        """(path, text): the reviewed text where there is one, even an empty one, else the machine's."""
        machine = self.table("text").select("path", F.col("body").alias("machine"))
        manual = self.table("manual_text").select("path", F.col("body").alias("manual"))
        return machine.join(manual, "path", "full").select("path", F.coalesce("manual", "machine", F.lit("")).alias("text"))

    def view(self, wanted=("tags", "text"), scoped: bool = True) -> DataFrame:
        """The wide rows, with only the satellites that are wanted."""
        out = self.files(scoped)
        if "tags" in wanted:
            out = out.join(self.tag_sets(), "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        if "text" in wanted:
            out = out.join(self.texts(), "path", "left").withColumn("text", F.coalesce("text", F.lit("")))
        if "hashes" in wanted:
            out = out.join(self.table("hashes"), "path", "left")
        return out

    def all(self) -> DataFrame:
        """Every row in scope with tags and text, newest first."""
        return newest_first(self.view())

    def row(self, path: str) -> DataFrame:
        return self.view().where(F.col("path") == path)

    def path_by_id(self, prefix: str) -> DataFrame:
        return self.files(False).where(F.col("id").startswith(prefix.lower())).orderBy("path").limit(1).select("path")

    def blobs(self, alg: str) -> DataFrame:
        """(path, blob) of one algorithm, in scope."""
        rows = self.table("blobs").where(F.col("alg") == alg)
        return (rows if self.scope is None else rows.where(self.scope)).select("path", "blob")

    def hash_of(self, path: str) -> tuple[int, ...] | None:
        """The informative hash of one path, else None."""
        row = self.table("hashes").where((F.col("path") == path) & informative()).first()
        return None if row is None else (row["h0"], row["h1"], row["h2"], row["h3"])

    def search(self, text: str, canon: Callable[[str], str] = lambda t: t, sources: dict[str, str] | None = None, columns=None, by_similarity: bool = False) -> DataFrame:
        """Files that match the query, newest first, or nearest to its first similar: image first."""
        tree = q.parse(text)
        if sources is not None:
            tree = q.resolve_sources(tree, sources)
        similar = {}
        for image in q.similar_operands(tree):
            found = self.hash_of(image)
            if found is None:
                raise q.QuerySyntaxError(f"no usable hash for {image}")
            similar[image] = F.when(informative(), distance(found))
        base, known = self._settled(tree, canon)
        if similar:
            base = base.join(self.table("hashes"), "path", "left")
        hit = base.where(to_column(tree, canon, similar, known))
        for name, rows in (("tags", self.tag_sets), ("text", self.texts)):  # of the rows found only
            if name in (columns or ()):
                empty_ = F.array().cast("array<string>") if name == "tags" else F.lit("")
                hit = hit.join(rows(), "path", "left").withColumn(name, F.coalesce(name, empty_))
        if by_similarity and similar:
            first = next(iter(similar.values()))
            hit = hit.orderBy(first.asc_nulls_last(), F.desc("created_at"), F.asc("path"))
        else:
            hit = newest_first(hit)
        return hit.select(*columns) if columns else hit.select(*self.files().columns)

    def _settled(self, tree, canon) -> tuple[DataFrame, dict]:
        """Files with a flag for each distinct tag and text leaf of the tree, and the columns of those leaves.

        Tags are filtered to those that a leaf asks for before they meet the files, and texts are tested where they are
        read: only paths and flags travel, never a file's other tags or its text.
        """
        leaves = list(dict.fromkeys(q.walk(tree)))
        out, known = self.files(), {}
        asked = {t: f"__tag{k}" for k, t in enumerate(leaves) if isinstance(t, (q.Tag, q.ExactTag))}
        if asked:
            tests = {t: tag_test(t, canon, F.col("tag")) for t in asked}
            rows = self.table("tags").where(reduce(or_, tests.values()))
            flags = rows.groupBy("path").agg(*[F.bool_or(tests[t]).alias(n) for t, n in asked.items()])
            out = out.join(flags, "path", "left")
            known |= {t: F.col(n) for t, n in asked.items()}
        said = {t: k for k, t in enumerate(leaves) if isinstance(t, q.Field) and t.name == "text"}
        if said:
            body = F.col("body")
            blank = {t: text_test(t, F.lit("")) for t in said}
            told = [text_test(t, body).alias(f"__text{k}") for t, k in said.items()]
            seen = [text_test(t, body).alias(f"__seen{k}") for t, k in said.items()]
            # A text that passes no test that a blank one fails, and fails none that it passes, says nothing.
            odd = reduce(or_, [~text_test(t, body).eqNullSafe(blank[t]) for t in said])
            machine = self.table("text").where(body.isNotNull() & odd).select("path", *told)
            manual = self.table("manual_text").where(body.isNotNull()).select("path", *seen)
            out = out.join(machine, "path", "left").join(manual, "path", "left")
            known |= {t: F.coalesce(f"__seen{k}", f"__text{k}", blank[t]) for t, k in said.items()}
        return out, known


def known_tables() -> list[str]:
    return list(TABLES)

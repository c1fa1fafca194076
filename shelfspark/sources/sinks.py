"""Exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog


def export_rows(catalog: Catalog) -> DataFrame:
    """One wide row per file with its tags by source, each list sorted; one aggregate of the tags, no join for each source."""
    none = F.array().cast("array<string>")
    by = catalog.table("tags").groupBy("path").agg(*[F.sort_array(F.collect_set(F.when(F.col("source") == s, F.col("tag")))).alias(name) for s, name in (("xmp", "tags"), ("folder", "folder_tags"), ("implied", "implied_tags"))])
    rows = catalog.view(("text",)).join(by, "path", "left")
    return rows.select("id", "path", "format", "kind", "width", "height", "size", "created_at", "tagged_at", *[F.coalesce(c, none).alias(c) for c in ("tags", "folder_tags", "implied_tags")], "text")


def export_jsonl(catalog: Catalog, path: str) -> None:
    """The rows as JSON lines, newest first within each file."""
    export_rows(catalog).sortWithinPartitions(F.desc("created_at"), "path").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)

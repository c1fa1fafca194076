"""Schemas of the tables of a collection: one wide row per file and tables keyed by its path. Formats and kinds are lower case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "files": "id string, path string, format string, kind string, width bigint, height bigint, size bigint, mtime double, created_at double, tagged_at double, xmp_tag_count bigint, indexed_at double, text_in_file boolean",
    "tags": "path string, tag string, source string",
    "text": "path string, body string",
    "manual_text": "path string, body string",
    "text_meta": "path string, engine string, read_at double, secs double",
    "blobs": "path string, alg string, blob binary",
    "hashes": "path string, h0 bigint, h1 bigint, h2 bigint, h3 bigint",
    "vectors": "path string, vector array<float>",
    "tag_history": "tag string, uses bigint",
    "rejects": "tag string, path string",
    "modes": "tag string, mode string",
    "batches": "stream string, batch bigint",
}
#: Tables whose rows go with a path when it is forgotten, and those that follow a rename.
PER_PATH = ("files", "tags", "text", "manual_text", "text_meta", "blobs", "hashes", "vectors")
CARRIED = ("text", "text_meta", "blobs", "hashes", "vectors")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])

"""Checks of the index against a fresh scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify(index: DataFrame, scan: DataFrame, deep: bool = False) -> DataFrame:
    """One row of counts. index: path, id, kind, mtime, xmp_tags; scan: path, readable, sound, id, original_mtime, tags, pixel_id (null: can't be decoded).

    Files without a scan row are missing; unreadable ones and those with unsound metadata are counted as such and not
    looked at further.
    """
    s = scan.select("path", *[F.col(c).alias(f"s_{c}") for c in scan.columns if c != "path"], F.lit(True).alias("there"))
    rows = index.join(s, "path", "left")
    readable = F.coalesce(F.col("s_readable"), F.lit(False))
    sound = readable & F.coalesce(F.col("s_sound"), F.lit(False))
    count = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    out = [
        F.count("*").alias("files"), count(F.col("there").isNull(), "missing"), count(F.col("there") & ~readable, "unreadable"), count(readable & ~sound, "bad_metadata"),
        count(sound & (F.col("s_id") != F.col("id")), "id_drift"), count(sound & (F.abs(F.col("s_original_mtime") - F.col("mtime")) > 0.5), "mtime_moved"),
        count(sound & (F.sort_array(F.array_distinct("s_tags")) != F.sort_array(F.array_distinct("xmp_tags"))), "tag_drift"),
    ]
    if deep:
        image = sound & (F.col("kind") == "image")
        out += [count(image & F.col("s_pixel_id").isNotNull() & (F.col("s_id") != F.col("s_pixel_id")), "pixels_changed"), count(image & F.col("s_pixel_id").isNull(), "undecodable")]
    return rows.agg(*out)

"""Queries over the bytes of files, which are made from the documents' texts, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.headers import dimensions
from .functions.names import sniff
from .functions.pixels import perceptual_hash
from .plans import standin

#: Bytes of a text in one segment of a made JPEG, and in one row of a made picture.
SEGMENT, ROW = 1000, 64


def _hexed(number, digits: int, little: bool = False):
    out = F.lpad(F.hex(number), digits, "0")
    return F.concat(*[F.substring(out, k, 2) for k in range(digits - 1, 0, -2)]) if little else out


def _containers(spark, sf_dir):
    """(doc_id, content): a PNG, GIF, WebP or JPEG of n_chars % 3000 + 1 by n_chars % 2000 + 1; the JPEG has the whole text in segments before its frame."""
    w, h = F.col("n_chars") % 3000 + 1, F.col("n_chars") % 2000 + 1
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hexed(w, 8), _hexed(h, 8), F.lit("0806000000")))
    gif = F.unhex(F.concat(F.lit("474946383961"), _hexed(w, 4, True), _hexed(h, 4, True), F.lit("000000")))
    webp = F.unhex(F.concat(F.lit("52494646160000005745425056503858" + "0A000000" + "10000000"), _hexed(w - 1, 6, True), _hexed(h - 1, 6, True)))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    starts = F.sequence(F.lit(0), F.floor(F.octet_length(raw) / SEGMENT).cast("int"))
    segments = F.transform(starts, lambda i: F.substring(F.col("raw"), i * SEGMENT + 1, F.lit(SEGMENT)))
    body = F.aggregate(segments, F.unhex(F.lit("FFD8")), lambda a, s: F.concat(a, F.unhex(F.concat(F.lit("FFE1"), _hexed(F.octet_length(s) + 2, 4))), s))
    jpeg = F.concat(body, F.unhex(F.concat(F.lit("FFC0001108"), _hexed(h, 4), _hexed(w, 4), F.lit("03" + "00" * 9 + "FFDA"))))
    k = F.col("doc_id") % 4
    return standin.docs(spark, sf_dir).withColumn("raw", raw).select("doc_id", F.when(k == 0, png).when(k == 1, gif).when(k == 2, webp).otherwise(jpeg).alias("content"))


def header_dimensions(spark, sf_dir):
    made = _containers(spark, sf_dir)
    return made.select("doc_id", sniff(F.col("content")).alias("format"), dimensions(F.col("content")).alias("d")).select("doc_id", "format", "d.width", "d.height")


def _pictures(spark, sf_dir):
    """(doc_id, pixels, width, height): the bytes of a whole text as grey pixels in rows of 64, the last one filled up with black."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / ROW)).cast("int")
    black = F.unhex(F.repeat(F.lit("00"), rows * ROW - F.octet_length(raw)))
    return standin.docs(spark, sf_dir).select("doc_id", F.concat(raw, black).alias("pixels"), F.lit(ROW).alias("width"), rows.alias("height"))


def perceptual_hashes(spark, sf_dir):
    made = _pictures(spark, sf_dir)
    return made.select("doc_id", perceptual_hash(F.col("pixels"), F.col("width"), F.col("height")).alias("h")).select("doc_id", "h.*")


QUERIES = {f.__name__: f for f in (header_dimensions, perceptual_hashes)}

ORACLES = {
    "header_dimensions": "SELECT doc_id, ['png', 'gif', 'webp', 'jpeg'][doc_id % 4 + 1] AS format, CAST(n_chars % 3000 + 1 AS BIGINT) AS width, CAST(n_chars % 2000 + 1 AS BIGINT) AS height FROM documents",
    "perceptual_hashes": """WITH sized AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, greatest(1, ceil(octet_length(encode(coalesce(text, ''))) / 64.0))::BIGINT AS h FROM documents),
lists AS (SELECT doc_id, h, regexp_extract_all(digits || repeat('00', CAST(h * 64 - length(digits) // 2 AS INTEGER)), '..') AS l FROM sized),
px AS (SELECT doc_id, h, CAST('0x' || unnest(l) AS INTEGER) AS b, generate_subscripts(l, 1) - 1 AS i FROM lists),
halves AS (SELECT doc_id, h, i // 64 AS y, (i % 64) // 2 AS c, sum(b) / 2.0 AS x FROM px GROUP BY ALL),
shares AS (SELECT h, y, r.r, (least((r.r + 1) * h / 32.0, y + 1) - greatest(r.r * h / 32.0, y)) * 32.0 / h AS s
  FROM (SELECT DISTINCT h, y FROM halves), range(32) r(r) WHERE (r.r + 1) * h / 32.0 > y AND r.r * h / 32.0 < y + 1),
grid AS (SELECT doc_id, r, c, sum(x * s) AS x FROM halves JOIN shares USING (h, y) GROUP BY ALL),
waves AS (SELECT i.i, k.k, cos(pi() / 32 * (i.i + 0.5) * k.k) AS w FROM range(32) i(i), range(16) k(k)),
across AS (SELECT doc_id, r, k AS v, sum(x * w) AS x FROM grid JOIN waves ON i = c GROUP BY ALL),
vals AS (SELECT doc_id, k * 16 + v AS pos, round(sum(x * w), 6) AS x FROM across JOIN waves ON i = r GROUP BY ALL),
mids AS (SELECT doc_id, quantile_cont(x, 0.5) AS mid FROM vals GROUP BY doc_id),
bits AS (SELECT doc_id, pos // 64 AS word, sum(CASE WHEN x < mid THEN 0 WHEN pos % 64 = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << CAST(pos % 64 AS INTEGER) END) AS h FROM vals JOIN mids USING (doc_id) GROUP BY ALL)
SELECT doc_id, """ + ", ".join(f"CAST(max(h) FILTER (word = {k}) AS BIGINT) AS h{k}" for k in range(4)) + " FROM bits GROUP BY doc_id",
}

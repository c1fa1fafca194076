"""Queries over rules that the documents stand for, blobs by algorithm, and reports, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .functions.hashes import blob_of, words_of
from .operators import ranking, reading, rules, similarity
from .plans import standin
from .plans.catalog import Catalog
from .plans.logs import query_parts


def _rules(spark, sf_dir, part: int):
    """(kind, name, target) of the documents whose id leaves a remainder by 2."""
    d = standin.docs(spark, sf_dir).where(F.col("doc_id") % 2 == part)
    word = F.concat(F.lit("w"), (F.col("n_chars") % 50).cast("string"))
    pairs = [("alias", word, F.col("lang")), ("implies", F.col("source"), F.col("lang")), ("implies", F.col("lang"), F.lit("speech")), ("suggests", F.col("source"), word), ("suggests", F.col("lang"), F.lit("de")), ("category", F.col("lang"), F.col("source")), ("colour", F.col("source"), word)]
    return reduce(lambda a, b: a.union(b), [d.select(F.lit(k).alias("kind"), n.alias("name"), t.alias("target")).distinct() for k, n, t in pairs])


def rules_merged(spark, sf_dir):
    return rules.merged(_rules(spark, sf_dir, 0), _rules(spark, sf_dir, 1))


def rules_compared(spark, sf_dir):
    return rules.compared(_rules(spark, sf_dir, 0), _rules(spark, sf_dir, 1))


def rules_renamed(spark, sf_dir):
    """A tag under a name that is known, and under one that isn't."""
    mine = _rules(spark, sf_dir, 0)
    one, two = (rules.renamed(mine, "en", new).withColumn("new", F.lit(new)) for new in ("de", "english"))
    return one.union(two)


def similar_report(spark, sf_dir):
    c = standin.catalog(spark, sf_dir)
    out = similarity.nearest_report(c.table("hashes"), c.hash_of("main/v/0000000"), within=20)
    return out.withColumn("next_distance", F.col("next_distance").cast("bigint"))


def _mixed(spark, sf_dir):
    """A catalog whose blobs are hashes of one algorithm and vectors' texts of another."""
    hashes = standin.hashes(spark, sf_dir).select("path", F.lit("dct").alias("alg"), blob_of().alias("blob"))
    others = standin.vectors(spark, sf_dir).select("path", F.lit("vector").alias("alg"), F.encode(F.col("label").cast("string"), "UTF-8").alias("blob"))
    return Catalog(spark, {"blobs": hashes.union(others)}, ~F.col("path").endswith("7"))


def blob_words(spark, sf_dir):
    return _mixed(spark, sf_dir).blobs("dct").select("path", words_of(F.col("blob")).alias("w")).select("path", "w.*")


def proposed_by_mode(spark, sf_dir):
    """Files for a tag whose remembered mode is image, with two files in five rejected for another tag only."""
    v = standin.vectors(spark, sf_dir)
    tags = v.where("label = 3").select("path", F.lit("three").alias("tag"), F.lit("xmp").alias("source")).union(v.where("label = 5").select("path", F.lit("three"), F.lit("implied")))
    rejects = v.where("vec_id % 5 < 2").select(F.lit("four").alias("tag"), "path")
    modes = ranking.remember_mode(spark.createDataFrame([["three", "text"]], "tag string, mode string"), "three", "image")
    texts = v.select("path", F.lit("").alias("text"))
    return ranking.propose_for("three", tags, v, v, texts, rejects, modes, top=1 << 30)


def embed_work(spark, sf_dir):
    """The first 50 texts that are still to be written: a third of the files were reviewed, a third hold their text."""
    c = standin.catalog(spark, sf_dir)
    third = F.ascii(F.md5(F.col("path").cast("binary"))) % 3
    held = c.table("text").select("path", (third == 0).alias("reviewed"), F.when(third == 1, F.col("body")).alias("file_text"))
    return reading.embed_work(c.files(), c.table("text"), held, "main", 50).select("path", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def query_log(spark, sf_dir):
    """Of a query that each document stands for: whether it parses, the images it asks for and the tag at its end."""
    d = standin.docs(spark, sf_dir).where("lang IS NOT NULL AND source IS NOT NULL")
    near = F.concat(F.lit("similar:"), "source", F.lit("/p@"), (F.col("n_chars") % 30).cast("string"))
    made = F.get(F.array(F.concat(near, F.lit(" || (similar:b, -similar:b)")), F.concat(F.lit("("), "lang"), F.concat("lang", F.lit(", -"), "source"), F.lit("size.gt:1")), (F.col("doc_id") % 4).cast("int"))
    rows = d.select("doc_id", query_parts(made).alias("q"))
    images = F.array_join(F.transform("q.similar", lambda s: F.concat(s["image"], F.lit("@"), s["bits"].cast("string"))), " ")
    return rows.select("doc_id", "q.valid", images.alias("images"), "q.typed")


_FUNCTIONS = (embed_work, query_log, rules_merged, rules_compared, rules_renamed, similar_report, blob_words, proposed_by_mode)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_RULES = """d AS (SELECT doc_id % 2 AS part, lang, source, 'w' || CAST(n_chars % 50 AS VARCHAR) AS word FROM documents),
given AS (SELECT part, 'alias' AS kind, word AS name, min(lang) AS target FROM d WHERE lang IS NOT NULL AND word IS NOT NULL GROUP BY ALL
  UNION ALL SELECT part, 'category', lang, min(source) FROM d WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY part, lang
  UNION ALL SELECT part, 'colour', source, min(word) FROM d WHERE source IS NOT NULL AND word IS NOT NULL GROUP BY part, source
  UNION ALL SELECT DISTINCT part, 'implies', source, lang FROM d UNION ALL SELECT DISTINCT part, 'implies', lang, 'speech' FROM d
  UNION ALL SELECT DISTINCT part, 'suggests', source, word FROM d UNION ALL SELECT DISTINCT part, 'suggests', lang, 'de' FROM d),
rules AS (SELECT * FROM given WHERE name IS NOT NULL AND target IS NOT NULL), mine AS (SELECT * EXCLUDE (part) FROM rules WHERE part = 0), other AS (SELECT * EXCLUDE (part) FROM rules WHERE part = 1)"""
_RENAMED = """SELECT DISTINCT kind, CASE WHEN kind IN ('implies', 'suggests', 'category') AND name = 'en' THEN '{new}' ELSE name END AS name,
  CASE WHEN kind IN ('implies', 'suggests', 'alias') AND target = 'en' THEN '{new}' ELSE target END AS target, '{new}' AS new
FROM mine WHERE NOT (kind = 'implies' AND name = 'en' AND {known}) AND NOT (kind = 'category' AND name = 'en' AND EXISTS (SELECT 1 FROM mine c WHERE c.kind = 'category' AND c.name = '{new}'))"""
_LIKE = "SELECT 'main/v/' || lpad(CAST(e.vec_id AS VARCHAR), 7, '0') AS path, CAST(sum(CASE WHEN e.embedding[CAST(i.i AS INTEGER) + 1] > 0 THEN (CAST(1 AS BIGINT) << i.i) ELSE 0 END) AS BIGINT) AS h0, e.vec_id FROM embeddings e CROSS JOIN range(63) i(i) GROUP BY e.vec_id"

ORACLES = {
    "embed_work": "SELECT path, body_md5 FROM (SELECT 'main/' || lang || '/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '.txt' AS path, md5(text) AS body_md5, doc_id FROM documents WHERE doc_id % 37 <> 0 AND length(text) > 0 AND doc_id % 10 > 1) WHERE ascii(md5(path)) % 3 = 2 ORDER BY path LIMIT 50",
    "query_log": """SELECT doc_id, doc_id % 4 <> 1 AS valid, CASE doc_id % 4 WHEN 0 THEN source || '/p@' || CAST(n_chars % 30 AS VARCHAR) || ' b@20' ELSE '' END AS images, CASE doc_id % 4 WHEN 1 THEN lang WHEN 2 THEN source END AS typed
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""",
    "rules_merged": f"WITH {_RULES} SELECT coalesce(m.kind, o.kind) AS kind, coalesce(m.name, o.name) AS name, coalesce(m.target, o.target) AS target, CASE WHEN m.kind = 'alias' AND m.target <> o.target THEN o.target END AS clash FROM mine m FULL JOIN other o ON m.kind = o.kind AND m.name = o.name AND (m.kind NOT IN ('implies', 'suggests') OR m.target = o.target)",
    "rules_compared": f"WITH {_RULES} SELECT 'mine' AS side, * FROM (SELECT * FROM mine EXCEPT SELECT * FROM other) UNION ALL SELECT 'other', * FROM (SELECT * FROM other EXCEPT SELECT * FROM mine)",
    "rules_renamed": f"WITH {_RULES} SELECT * FROM (" + _RENAMED.format(new="de", known="TRUE") + " UNION ALL " + _RENAMED.format(new="english", known="FALSE") + ") WHERE NOT (kind IN ('implies', 'suggests') AND name = target)",
    "similar_report": f"WITH h AS ({_LIKE}), r AS (SELECT path, bit_count(xor(h0, (SELECT h0 FROM h WHERE vec_id = 0))) AS far FROM h), n AS (SELECT path, far FROM r WHERE far > 20 ORDER BY far, path LIMIT 1) SELECT (SELECT count(*) FROM r WHERE far <= 20) AS \"within\", (SELECT count(*) FROM r) AS images, n.path AS next_path, CAST(n.far AS BIGINT) AS next_distance FROM n",
    "blob_words": f"SELECT path, h0, CAST(0 AS BIGINT) AS h1, CAST(0 AS BIGINT) AS h2, CAST(0 AS BIGINT) AS h3 FROM ({_LIKE}) WHERE NOT ends_with(path, '7')",
    "proposed_by_mode": """WITH v AS (SELECT 'main/v/' || lpad(CAST(vec_id AS VARCHAR), 7, '0') AS path, label, embedding FROM embeddings),
c0 AS (SELECT i.i AS pos, sum(CAST(embedding[CAST(i.i AS INTEGER)] AS DOUBLE)) AS x FROM v CROSS JOIN range(1, 65) i(i) WHERE label = 3 GROUP BY i.i), c AS (SELECT pos, x / (SELECT sqrt(sum(x * x)) FROM c0) AS x FROM c0)
SELECT path, round((SELECT sum(CAST(v.embedding[CAST(pos AS INTEGER)] AS DOUBLE) * x) FROM c) / sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])), 6) AS score FROM v WHERE label <> 3 OR label IS NULL""",
}

"""The queries over the engine's own operators and their DuckDB SQL, on the stand-in collection of plans.standin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry_bytes, registry_rules
from .functions import names, text
from .operators import audit, completion, ingest, paging, ranking, reading, similarity, tagging
from .operators.vocabulary import Vocabulary, decisions, diff, merge
from .plans import query as q
from .plans import standin
from .plans.catalog import Catalog, in_scope, selection
from .plans.postings import Postings
from .sources.sinks import export_rows

RULES = Vocabulary.of(
    aliases={"poisonous": "toxic", "good": "quality:good", "deutsch": "folder:de"},
    implications={"toxic": ["flagged"], "flagged": ["review"], "review": ["flagged"], "folder:en": ["lang:english"], "quality:good": ["keep"]},
    suggestions={"quality:good": ["feature"], "folder:en": ["quality:poor", "english text"], "toxic": ["not:keep", "hide"]},
    categories={"subject": ["quality:good", "quality:poor"], "commentary": ["toxic"]},
)
WITHIN = 18

# ---------------------------------------------------------------- SQL of the stand-in collection

_PATH = "'main/' || d.lang || '/' || d.source || '/' || lpad(CAST(d.doc_id AS VARCHAR), 7, '0') || '.txt'"
_BASE = f"""
files AS (
  SELECT d.doc_id, substr(sha256(d.text), 1, 16) AS id, {_PATH} AS path, d.lang AS format,
    CASE WHEN d.doc_id % 10 = 0 THEN 'video' WHEN d.doc_id % 10 = 1 THEN 'other' ELSE 'image' END AS kind,
    CAST(CASE WHEN d.doc_id % 10 > 1 THEN d.n_chars % 3000 + 1 ELSE 0 END AS BIGINT) AS width,
    CAST(CASE WHEN d.doc_id % 10 > 1 THEN d.n_chars % 2000 + 1 ELSE 0 END AS BIGINT) AS height,
    d.n_chars AS size, CAST(1546300800 + d.doc_id * 86400 AS DOUBLE) AS created_at, CAST(1546300800 + d.doc_id * 86400 AS DOUBLE) AS mtime,
    CASE WHEN l.doc_id IS NOT NULL THEN CAST(1546300800 + d.doc_id * 86400 + 3600 AS DOUBLE) ELSE 0 END AS tagged_at,
    CAST(coalesce(1 + l.toxic, 0) AS BIGINT) AS xmp_tag_count, CAST(1546300800 + d.doc_id * 86400 AS DOUBLE) AS indexed_at
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
tags AS (
  SELECT {_PATH} AS path, CASE WHEN l.quality = 1 THEN 'quality:good' ELSE 'quality:poor' END AS tag, 'xmp' AS source FROM documents d JOIN labels l USING (doc_id)
  UNION ALL SELECT {_PATH}, 'toxic', 'xmp' FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1
  UNION ALL SELECT {_PATH}, 'folder:' || d.lang, 'folder' FROM documents d
  UNION ALL SELECT {_PATH}, 'folder:' || d.source, 'folder' FROM documents d
  UNION ALL SELECT {_PATH}, t.t, 'implied' FROM documents d JOIN labels l USING (doc_id) CROSS JOIN (VALUES ('flagged'), ('review')) t(t) WHERE l.toxic = 1
  UNION ALL SELECT {_PATH}, 'lang:english', 'implied' FROM documents d WHERE d.lang = 'en'
),
texts AS (
  SELECT {_PATH} AS path, d.doc_id,
    CASE WHEN d.doc_id % 50 = 0 THEN '' WHEN d.doc_id % 50 = 25 THEN 'REVIEWED ' || d.text WHEN d.doc_id % 37 = 0 THEN '' ELSE d.text END AS text
  FROM documents d
),
text_meta AS (
  SELECT {_PATH} AS path, 'e' || CAST(d.doc_id % 3 AS VARCHAR) AS engine, CAST(1700000000 + d.doc_id AS DOUBLE) AS read_at, (d.n_chars % 100) / 10.0 AS secs
  FROM documents d WHERE d.doc_id % 4 <> 0
)"""
_VECTORS = """
vecs AS (SELECT vec_id, label, 'main/v/' || lpad(CAST(vec_id AS VARCHAR), 7, '0') AS path, embedding FROM embeddings),
hashes AS (
  SELECT e.vec_id, 'main/v/' || lpad(CAST(e.vec_id AS VARCHAR), 7, '0') AS path,
    CAST(sum(CASE WHEN e.embedding[CAST(i.i AS INTEGER) + 1] > 0 THEN (CAST(1 AS BIGINT) << i.i) ELSE 0 END) AS BIGINT) AS h0
  FROM embeddings e CROSS JOIN range(63) i(i) GROUP BY e.vec_id
)"""


def _sql(body: str, base: str = _BASE) -> str:
    return f"WITH {base}\n{body}"


def _search(where: str) -> str:
    return _sql(f"SELECT path, id, format, kind FROM files f WHERE {where}")


def _has(tag: str) -> str:
    return f"EXISTS (SELECT 1 FROM tags t WHERE t.path = f.path AND t.tag = '{tag}')"


def _texts(test: str) -> str:
    return f"EXISTS (SELECT 1 FROM texts t WHERE t.path = f.path AND {test})"


#: Searches: the query and the condition that it stands for.
SEARCHES = {
    "search_flagship": ("text.word:the, -format:de, size.gt:1k", _texts(r"regexp_matches(lower(t.text), '(^|[^\p{L}\p{N}])the($|[^\p{L}\p{N}])')") + " AND format <> 'de' AND size > 1000"),
    "search_tag": ("toxic", _has("toxic")),
    "search_alias": ("poisonous", _has("toxic")),
    "search_tag_glob": ("qual*:?ood", _has("quality:good")),
    "search_exact_tag": ('"quality:poor"', _has("quality:poor")),
    "search_folder_tag": ("folder:de", _has("folder:de")),
    "search_bool_precedence": ("toxic || quality:good AND NOT folder:en", f"({_has('toxic')} OR ({_has('quality:good')} AND NOT {_has('folder:en')}))"),
    "search_grouping": ("(toxic OR quality:good), !folder:en", f"({_has('toxic')} OR {_has('quality:good')}) AND NOT {_has('folder:en')}"),
    "search_all": ("", "TRUE"),
    "search_format_alias": ("format:DE || format:jpg", "format IN ('de', 'jpg', 'jpeg')"),
    "search_kind": ("kind:Video", "kind = 'video'"),
    "search_id_prefix": ("id:a", "starts_with(id, 'a')"),
    "search_source": ("source:MAIN", "starts_with(path, 'main/')"),
    "search_path_glob": ("path:en/*src1?/", r"regexp_matches(lower(path), '^.*en/.*src1./.*$')"),
    "search_text_contains": ("text:then the", _texts("contains(lower(replace(t.text, chr(10), ' ')), 'then the')")),
    "search_text_glob": ("t:the*on the*", _texts("regexp_matches(lower(replace(t.text, chr(10), ' ')), '^the.*on the.*$')")),
    "search_word": ("text.word:and", _texts(r"regexp_matches(lower(t.text), '(^|[^\p{L}\p{N}])and($|[^\p{L}\p{N}])')")),
    "search_word_phrase": ("text.w:of the", _texts(r"regexp_matches(lower(t.text), '(^|[^\p{L}\p{N}])of[^\p{L}\p{N}]+the($|[^\p{L}\p{N}])')")),
    "search_word_glob": ("text.word:th?n*", _texts(r"regexp_matches(lower(t.text), '(^|[^\p{L}\p{N}])th[\p{L}\p{N}]n[\p{L}\p{N}]*($|[^\p{L}\p{N}])')")),
    "search_width_unknown": ("width.lt:500 || width:0", "(width > 0 AND width < 500) OR width = 0"),
    "search_height": ("height.gte:1.5k", "height >= 1500"),
    "search_size_suffix": ("size.gt:1.5kb", "size > 1500"),
    "search_tag_count": ("tag_count.gte:2", "xmp_tag_count >= 2"),
    "search_untagged": ("tag_count:0", "xmp_tag_count = 0"),
    "search_created_year": ("created_at:2019", "created_at >= 1546300800 AND created_at < 1577836800"),
    "search_created_month_lt": ("created_at.lt:2019-07", "created_at < 1561939200"),
    "search_tagged_day": ("tagged_at.gte:2019-03-10", "tagged_at >= 1552176000"),
    "search_not_missing": ("-width.lt:500", "NOT (width > 0 AND width < 500)"),
    "search_bad_number": ("-size.gt:lots", "TRUE"),
    "search_tier": (q.tier_query("folder:en", "thin"), f"{_has('folder:en')} AND xmp_tag_count > 0 AND xmp_tag_count < 3"),
    "search_tier_tagged": (q.tier_query("", "tagged", 2), "xmp_tag_count >= 2"),
    "search_juxtaposed": ("(folder:en) (tag_count.gte:1)", f"{_has('folder:en')} AND xmp_tag_count >= 1"),
    "search_operator_ignored": ("format.gt:de", "format = 'de'"),
    "search_quoted_tag": (q.quote_tag("quality:good"), _has("quality:good")),
}


def _searcher(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return standin.catalog(spark, sf_dir).search(query, RULES.canon, columns=["path", "id", "format", "kind"])

    return run


# ---------------------------------------------------------------- other queries


def _cat(spark, sf_dir):
    return standin.catalog(spark, sf_dir)


def all_rows(spark, sf_dir):
    v = _cat(spark, sf_dir).all()
    return v.select("path", F.array_join("tags", "|").alias("tags"), F.length("text").cast("bigint").alias("text_len"))


def point_lookup(spark, sf_dir):
    c = _cat(spark, sf_dir)
    path = c.files().where("doc_id = 7").first()["path"]
    return c.row(path).select("path", "id", F.array_join("tags", "|").alias("tags"))


def path_by_id(spark, sf_dir):
    return _cat(spark, sf_dir).path_by_id("A")


def search_scope(spark, sf_dir):
    rel = F.expr("substring(path, 6)")
    return _cat(spark, sf_dir).files().where(in_scope(rel, ["en", "de/src1"], ["en/src0"])).select("path")


def _likeness(spark, sf_dir) -> Catalog:
    """The collection with each file's hash, that of the vector of its number."""
    c = _cat(spark, sf_dir)
    own = c.table("hashes").join(c.files().select(F.col("doc_id").alias("vec_id"), F.col("path").alias("file")), "vec_id")
    return Catalog(spark, c.tables | {"hashes": own.select(F.col("file").alias("path"), "h0", "h1", "h2", "h3")})


def search_similar(spark, sf_dir):
    c = _likeness(spark, sf_dir)
    image = c.files().where("doc_id = 3").first()["path"]
    return c.search(f"similar:{image}@22", columns=["path"])


def search_similar_order(spark, sf_dir):
    """The 15 nearest of the files that an image and a tag find."""
    c = _likeness(spark, sf_dir)
    image = c.files().where("doc_id = 3").first()["path"]
    return c.search(f"similar:{image}@40, folder:en", columns=["path"], by_similarity=True).limit(15)


def page_newest(spark, sf_dir):
    rows, _, _ = paging.page(_cat(spark, sf_dir).search("folder:en", columns=["path"]), 2, 60)
    return rows


def selection_shared(spark, sf_dir):
    c = _cat(spark, sf_dir)
    return tagging.selection_counts(c.table("tags"), c.files().where("doc_id % 97 < 3").select("path"))


def implied_closure(spark, sf_dir):
    """What each client leads to, where clients point at their master and at the first client of their city."""
    c = spark.read.parquet(f"{sf_dir}/clients.parquet")
    first = c.where("city IS NOT NULL").groupBy("city").agg(F.min("client_id").alias("first"))
    masters = c.select(F.col("client_id").alias("tag"), F.col("master_id").alias("to"))
    return tagging.closure(masters.union(c.join(first, "city").select("client_id", "first")))


def pass_outcomes(spark, sf_dir):
    """Each user's events as the log of a pass: errors, skips (views) and attempts that went well; 3 errors in a row or 25 attempts end it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = e.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "skip").otherwise("ok").alias("outcome"))
    return reading.passes(log, "user_id", ["ts", "event_id"], run=3, limit=25)


#: Searches of the bitmap index.
BITMAPS = {
    "bitmap_and_not": ("qual*:*, -folder:en, -(toxic || quality:poor)", "(quality_good OR quality_poor) AND NOT folder_en AND NOT (toxic OR quality_poor)"),
    "bitmap_nested": ("-(-(toxic || -folder:en) || quality:good), -(folder:de, -(quality:poor || flagged))", "NOT (NOT (toxic OR NOT folder_en) OR quality_good) AND NOT (folder_de AND NOT (quality_poor OR flagged))"),
    "bitmap_fields": ("(toxic || size.gt:2k), -(folder:en, tag_count:0)", "(toxic OR size > 2000) AND NOT (folder_en AND xmp_tag_count = 0)"),
}


def _bitmap_search(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _cat(spark, sf_dir)
        return Postings.build(c).search(query, RULES.canon, c.files())

    return run


def bitmap_count(spark, sf_dir):
    return Postings.build(_cat(spark, sf_dir)).count("-(folder:en, -quality:good) || toxic", RULES.canon)


def hash_classes(spark, sf_dir):
    """Distinct hashes with the number of files that have them."""
    return similarity.classes(_cat(spark, sf_dir).table("hashes"), bits=64).select("h0", "rep", "n")


def _wide_hashes(spark, sf_dir):
    """256 bits of each embedding: its signs, and which of two components, 1, 7 and 20 places apart, is larger."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")

    def word(step):
        on = lambda i: F.get("embedding", i) > (F.get("embedding", (i + step) % 64) if step else F.lit(0))
        one = F.lit(1).cast("bigint")
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda a, i: a.bitwiseOR(F.when(on(i), F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("bigint"))))

    return e.select(F.concat(F.lit("main/v/"), F.lpad(F.col("vec_id").cast("string"), 7, "0")).alias("path"), *[word(s).alias(f"h{k}") for k, s in enumerate((0, 1, 7, 20))])


def hamming_pairs_wide(spark, sf_dir):
    """Pairs of 256-bit hashes within 84 bits."""
    pairs = similarity.close_pairs(_wide_hashes(spark, sf_dir), 84)
    return pairs.select("a", "b", F.col("distance").cast("bigint").alias("distance"))


def implied_rows(spark, sf_dir):
    return tagging.implied_tags(_cat(spark, sf_dir).table("tags"), RULES)


def reimply_changed(spark, sf_dir):
    out = tagging.reimply(_cat(spark, sf_dir).table("tags"), RULES)
    return out.select("path", F.array_join("tags", "|").alias("tags"))


def suggestions_offered(spark, sf_dir):
    return tagging.offered(_cat(spark, sf_dir).table("tags"), RULES)


def tag_edit(spark, sf_dir):
    rows = _cat(spark, sf_dir).tag_sets()
    out = tagging.batch_edit(rows, ["checked"], ["poisonous"], RULES)
    return out.select("path", F.array_join("new_tags", "|").alias("new_tags"), "changed")


def folder_tags_query(spark, sf_dir):
    return _cat(spark, sf_dir).files().select("path", F.array_join(tagging.folder_tags(), "|").alias("folder_tags"))


def canon_tags(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("event_type") == "click", " Good ").when(F.col("event_type") == "view", "POISONOUS").otherwise(F.col("event_type")).alias("raw"))
    return rows.select("event_id", tagging.canon_column(F.col("raw"), RULES).alias("tag"))


def tag_history_counts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("tag")).agg(F.count("*").alias("uses"))


def completion_load(spark, sf_dir):
    return completion.completion_values(_cat(spark, sf_dir).table("tags"), tag_history_counts(spark, sf_dir), RULES)


def completion_rank(spark, sf_dir):
    return completion.matches(completion_load(spark, sf_dir), "i")


def hamming_pairs(spark, sf_dir):
    pairs = similarity.close_pairs(_cat(spark, sf_dir).table("hashes"), WITHIN, bits=64)
    return pairs.select("a", "b", F.col("distance").cast("bigint").alias("distance"))


def hamming_topk(spark, sf_dir):
    c = _cat(spark, sf_dir)
    out = similarity.nearest(c.table("hashes"), c.hash_of("main/v/0000000"), within=20, limit=25)
    return out.select("path", F.col("distance").cast("bigint").alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def duplicate_groups(spark, sf_dir):
    return similarity.duplicate_groups(_cat(spark, sf_dir).table("hashes"), WITHIN, bits=64)


def shared_ids(spark, sf_dir):
    out = similarity.shared_ids(_cat(spark, sf_dir).files())
    return out.select("id", "n", F.array_join("paths", "|").alias("paths"))


def _label_rows(spark, sf_dir):
    v = standin.vectors(spark, sf_dir)
    return v, v.where("label = 3").select("path"), v.where("label = 4 AND vec_id % 5 = 0").select("path")


def centroid_rank(spark, sf_dir):
    v, pos, _ = _label_rows(spark, sf_dir)
    return ranking.propose(v, pos, top=1 << 30, vectors=v, mode="image")


def centroid_rank_rejects(spark, sf_dir):
    v, pos, neg = _label_rows(spark, sf_dir)
    return ranking.propose(v, pos, top=50, vectors=v, rejects=neg, mode="image")


def _rank_texts(spark, sf_dir):
    c = _cat(spark, sf_dir)
    return c.texts(), c.table("tags").where("tag = 'toxic'").select("path").distinct()


def tfidf_rank(spark, sf_dir):
    t, pos = _rank_texts(spark, sf_dir)
    return ranking.propose(t, pos, top=1 << 30, texts=t, mode="text")


def _parts(spark, sf_dir):
    """All vectors, and of the files of one label those that are shown and those that are hidden."""
    v, pos, _ = _label_rows(spark, sf_dir)
    parts = ranking.hide_third(pos)
    return v, parts.where("NOT hidden").select("path"), parts.where("hidden").select("path")


def holdout_measure(spark, sf_dir):
    v, shown, hidden = _parts(spark, sf_dir)
    return ranking.holdout(ranking.propose(v, shown, top=1 << 30, vectors=v, mode="image"), hidden)


def holdout_feedback(spark, sf_dir):
    """The hold-out before and after the first 10 wrong offers were rejected."""
    v, shown, hidden = _parts(spark, sf_dir)
    rounds = ranking.feedback(v, shown, hidden, 10, vectors=v, mode="image")
    one, two = (ranking.holdout(r, hidden).withColumn("round", F.lit(k)) for k, r in enumerate(rounds, 1))
    return one.union(two)


def _listing(spark, sf_dir):
    f = _cat(spark, sf_dir).files()
    local = f.where("doc_id % 7 <> 0").select("path", "size", "mtime", "id")
    listed = f.where("doc_id % 11 <> 0").select("path", F.when(F.col("doc_id") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime", "id")
    return local, listed


def listing_diff(spark, sf_dir):
    return ingest.listing_diff(*_listing(spark, sf_dir))


def rename_carry(spark, sf_dir):
    f = _cat(spark, sf_dir).files().select("path", "id", "doc_id")
    gone = f.where("doc_id % 5 = 0").select("path", "id")
    fresh = f.where("doc_id % 5 IN (0, 1)").select(F.concat(F.lit("main/moved/"), F.col("doc_id").cast("string")).alias("path"), "id")
    return ingest.renames(gone, fresh)


def forget_rows(spark, sf_dir):
    c = _cat(spark, sf_dir)
    paths = c.files().where("doc_id % 3 = 0").select("path")
    left = ingest.forget({k: c.table(k) for k in ("files", "tags", "text", "text_meta")}, paths)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in left.items()]
    out = counts[0]
    for c_ in counts[1:]:
        out = out.union(c_)
    return out


def carried_texts(spark, sf_dir):
    """Machine texts after the renames of rename_carry."""
    text_rows = ingest.carry(_cat(spark, sf_dir).table("text"), rename_carry(spark, sf_dir))
    return text_rows.select("path", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def _merged(spark, sf_dir):
    """The tables after a listing's new and changed files were scanned, and its gone ones forgotten."""
    c = _cat(spark, sf_dir)
    local, listed = _listing(spark, sf_dir)
    change = ingest.listing_diff(local, listed)
    f = c.files()
    here = f.where("doc_id % 7 <> 0").select("path")
    tables = {k: c.table(k).join(here, "path", "left_semi") for k in ("files", "tags", "text", "manual_text", "text_meta")}
    fresh = f.drop("size", "text_in_file").join(listed.select("path", "size").join(change.where("change <> 'gone'").select("path"), "path"), "path")
    own = F.array(F.when(F.col("doc_id") % 3 == 0, "toxic").otherwise("big<toxic>"))
    scans = fresh.select(*[F.col(x) for x in fresh.columns if x != "doc_id"], F.col("doc_id"), F.lit(None).cast("boolean").alias("text_in_file"), own.alias("xmp_tags"), tagging.folder_tags().alias("folder_tags"),
                         F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("scan "), F.col("doc_id").cast("string"))).alias("text"), (F.col("doc_id") % 4 == 0).alias("manual"))
    out = ingest.merge_scans(tables, scans, lambda tags: tagging.implied_tags(tags, RULES))
    return ingest.forget(out, change.where("change = 'gone'").select("path"))


def merge_result(spark, sf_dir):
    return _merged(spark, sf_dir)["files"].select("path", "size", "id")


def merge_tags(spark, sf_dir):
    return _merged(spark, sf_dir)["tags"].select("path", "tag", "source")


def merge_texts(spark, sf_dir):
    out = _merged(spark, sf_dir)
    both = [out[k].select(F.lit(k).alias("kind"), "path", F.md5(F.col("body").cast("binary")).alias("body_md5")) for k in ("text", "manual_text")]
    return both[0].union(both[1])


def cache_invalidation(spark, sf_dir):
    f = _cat(spark, sf_dir).files().select("path", "id", "doc_id")
    new = f.select("path", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("b"), "id")).when(F.col("doc_id") % 3 == 1, F.reverse("id")).otherwise(F.col("id")).alias("id"))
    return ingest.stale(f, new)


def ocr_status(spark, sf_dir):
    c = _cat(spark, sf_dir)
    return reading.engine_stats(c.files(), c.table("text_meta"))


def ocr_unread(spark, sf_dir):
    c = _cat(spark, sf_dir)
    return reading.unread(c.files(), c.table("text_meta"), c.table("manual_text"), "e1")


def ocr_queue(spark, sf_dir):
    c = _cat(spark, sf_dir)
    return reading.queue(c.files(), c.table("text_meta"), c.table("manual_text"), "e2")


def ocr_done_union(spark, sf_dir):
    c = _cat(spark, sf_dir)
    return reading.done_paths(c.table("text_meta"), c.table("manual_text"), c.files())


def ocr_embed_pending(spark, sf_dir):
    c = _cat(spark, sf_dir)
    return reading.totals(c.files(), c.table("text"))


def clean_strip_tags(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", text.strip_tags(F.col("html")).alias("text"))


def clean_scanned(spark, sf_dir):
    return standin.docs(spark, sf_dir).select("doc_id", F.md5(text.clean_scanned_text(F.col("text"), 1 << 30).cast("binary")).alias("cleaned"))


def clean_model(spark, sf_dir):
    return standin.docs(spark, sf_dir).select("doc_id", text.clean_model_text(F.col("text")).alias("cleaned"))


def page_names(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", names.basename(F.col("url")).alias("base"), names.html_escape(F.col("url")).alias("escaped"))


def file_ids(spark, sf_dir):
    d = standin.docs(spark, sf_dir)
    body = F.col("text").cast("binary")
    return d.select("doc_id", names.content_id(body, "b").alias("byte_id"), names.revision(body).alias("revision"), names.utc_minute(F.lit(1546300800.0) + F.col("doc_id") * 3661).alias("at_minute"))


def export(spark, sf_dir):
    rows = export_rows(_cat(spark, sf_dir))
    return rows.select("path", *[F.array_join(c, "|").alias(c) for c in ("tags", "folder_tags", "implied_tags")], F.md5(F.col("text").cast("binary")).alias("text_md5"))


def verify_index(spark, sf_dir):
    c = _cat(spark, sf_dir)
    own = c.table("tags").where("source = 'xmp'").groupBy("path").agg(F.sort_array(F.collect_set("tag")).alias("xmp_tags"))
    index = c.files().join(own, "path", "left").withColumn("xmp_tags", F.coalesce("xmp_tags", F.array().cast("array<string>")))
    scan = index.where("doc_id % 9 <> 0").select(
        "path", (F.col("doc_id") % 8 != 0).alias("readable"), (F.col("doc_id") % 10 != 3).alias("sound"), F.when(F.col("doc_id") % 6 == 0, F.reverse("id")).otherwise(F.col("id")).alias("id"),
        (F.col("mtime") + F.when(F.col("doc_id") % 12 == 5, 2.0).otherwise(0.25)).alias("original_mtime"), F.when(F.col("doc_id") % 14 == 1, F.array(F.lit("x"))).otherwise(F.col("xmp_tags")).alias("tags"),
    )
    return audit.verify(index, scan)


def next_thin(spark, sf_dir):
    return paging.next_thin(_cat(spark, sf_dir).files(), 40, 1).select("path")


def _related(spark, sf_dir):
    """A tag of each file, as a hand would write it."""
    tag = F.when(F.col("doc_id") % 4 == 0, "Big< Poisonous >").when(F.col("doc_id") % 4 == 1, "good<folder:en>").when(F.col("doc_id") % 4 == 2, "<toxic>").otherwise(" Deutsch")
    return standin.docs(spark, sf_dir).select(standin.path_col().alias("path"), tag.alias("tag"), F.lit("xmp").alias("source"))


def relational_canon(spark, sf_dir):
    return _related(spark, sf_dir).select("path", tagging.canon_column(F.col("tag"), RULES).alias("tag"))


def relational_implied(spark, sf_dir):
    return tagging.implied_tags(_related(spark, sf_dir), RULES)


def relational_edit(spark, sf_dir):
    rows = _related(spark, sf_dir).select("path", F.array("tag").alias("tags"))
    out = tagging.batch_edit(rows, ["Big<good>"], ["big<toxic>"], RULES)
    return out.select("path", F.array_join("new_tags", "|").alias("new_tags"), "changed")


def relational_offers(spark, sf_dir):
    own = tagging.own_tags(_cat(spark, sf_dir).table("tags"))
    return own.select("path", F.array_join(tagging.relational_offers(F.col("own"), "big"), "|").alias("offers"))


def suggestion_answers(spark, sf_dir):
    rows = _cat(spark, sf_dir).tag_sets()
    return rows.select("path", *[F.array_join(tagging.answer_suggestion(F.col("tags"), "hide", yes), "|").alias(n) for n, yes in (("accepted", True), ("refused", False))])


def renamed_tags(spark, sf_dir):
    return tagging.rename_tag(_cat(spark, sf_dir).table("tags"), "toxic", "quality:good").select("path", "tag", "source")


def deleted_tags(spark, sf_dir):
    return tagging.rename_tag(_cat(spark, sf_dir).table("tags"), "toxic", None).select("path", "tag", "source")


def action_requests(spark, sf_dir):
    return tagging.act_on_requests(_cat(spark, sf_dir).table("tags"), {"toxic": "toxic done", "quality:poor": "checked"})


def history_added(spark, sf_dir):
    return ingest.add_counts(tag_history_counts(spark, sf_dir), spark.createDataFrame([("click", 5), ("toxic", 2)], "tag string, uses bigint"))


def inserted_rejects(spark, sf_dir):
    """Rejected files of a tag, of which some were rejected before."""
    f = _cat(spark, sf_dir).files()
    had, more = (f.where(w).select(F.lit("toxic").alias("tag"), "path") for w in ("doc_id % 6 = 0", "doc_id % 4 = 0"))
    return ingest.insert_new(had, more, ["tag", "path"])


def unrejected(spark, sf_dir):
    """Rejected files after some were taken back."""
    f = _cat(spark, sf_dir).files()
    return ranking.unreject(inserted_rejects(spark, sf_dir), "toxic", f.where("doc_id % 4 = 0").select("path"))


def floor_counts(spark, sf_dir):
    kept = spark.createDataFrame([("toxic", 3), ("lost", 7), ("folder:en", 1 << 40)], "tag string, count bigint")
    return completion.remembered_counts(_cat(spark, sf_dir).table("tags"), kept)


def foreign_completion(spark, sf_dir):
    other = spark.createDataFrame([("toxic", 900), ("hidden in", 4), ("inner", 4)], "tag string, count bigint")
    return completion.completion_values(_cat(spark, sf_dir).table("tags"), tag_history_counts(spark, sf_dir), RULES, ["ask me"], other)


def assistant_page(spark, sf_dir):
    return paging.assistant_order(_cat(spark, sf_dir).files()).limit(25).select("path")


def group_page(spark, sf_dir):
    """The second page of 3 content ids that several files share."""
    rows, _, _ = paging.page(similarity.shared_ids(_cat(spark, sf_dir).files()).orderBy(F.desc("n"), "id"), 2, 3)
    return rows.select("id", "n")


def source_selection(spark, sf_dir):
    chosen = {"main": {"include": ["en", "de"], "exclude": ["en/src0"]}, "other": {}, "off": {"enabled": False}}
    return _cat(spark, sf_dir).files().where(selection(chosen)).select("path")


def awaiting_text(spark, sf_dir):
    c = _cat(spark, sf_dir)
    return reading.awaiting(c.files(), c.table("text_meta"), c.table("manual_text")).select("path")


def ocr_queue_head(spark, sf_dir):
    c = _cat(spark, sf_dir)
    return reading.queue(c.files(), c.table("text_meta"), c.table("manual_text"), "e2", limit=7)


def stored_readings(spark, sf_dir):
    c = _cat(spark, sf_dir)
    read = c.files().where("doc_id % 8 = 0").select("path", F.lit("read again").alias("body"), F.lit("e9").alias("engine"), F.lit(5.0).alias("read_at"), F.lit(0.5).alias("secs"))
    _, meta = reading.store(c.table("text"), c.table("text_meta"), read)
    return meta.groupBy("engine").agg(F.count("*").alias("n"), F.max("read_at").alias("last"))


def text_precedence(spark, sf_dir):
    """The texts that an editor, an action and an embedding pass go by."""
    c = _cat(spark, sf_dir)
    rows = c.files().select("path", F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).when(F.col("doc_id") % 3 == 1, F.lit("in file")).alias("file"))
    rows = rows.join(c.table("text").select("path", F.substring("body", 1, 9).alias("machine")), "path", "left").join(c.table("manual_text").select("path", F.substring("body", 1, 9).alias("reviewed")), "path", "left")
    return rows.select(
        "path", reading.editor_text(F.col("reviewed"), F.col("machine"), F.col("file")).alias("editor"), reading.action_text(F.col("file"), F.col("machine")).alias("action"),
        rows.reviewed.isNotNull().alias("had"),
    ).withColumn("embedded", reading.already_embedded("had", "editor", "action")).drop("had")


def fresh_artefacts(spark, sf_dir):
    rows = _cat(spark, sf_dir).files().select("path", "mtime", (F.col("mtime") - F.col("doc_id") % 4 * 0.5).alias("made"))
    return rows.where(reading.fresh_artefact("made", "mtime")).select("path")


def folded_view(spark, sf_dir):
    v = _cat(spark, sf_dir).files().select("path", "size", "created_at", "doc_id")
    fresh = v.where("doc_id % 5 = 0").withColumn("size", F.lit(1).cast("bigint"))
    return ingest.folded(v, fresh, v.where("doc_id % 7 = 0").select("path")).select("path", "size")


def prefixed_files(spark, sf_dir):
    old = _cat(spark, sf_dir).files().select(F.expr("substring(path, 6)").alias("path"), "size")
    return ingest.with_source_prefix({"files": old}, "old")["files"]


def cache_keys(spark, sf_dir):
    f = _cat(spark, sf_dir).files().select(F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("x"), "path")).alias("path"))
    return f.select("path", names.cache_key().alias("cache_key"))


def url_names(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back = names.percent_decode(names.percent_encode(F.concat(F.col("url"), F.lit("/ä b+c~(1)"))))
    return pages.select("page_id", back.alias("back"), names.media_type(F.concat(F.col("url"), F.when(F.col("page_id") % 2 == 0, ".JPG").otherwise(".tar"))).alias("media_type"))


def sniffed(spark, sf_dir):
    heads = ["FFD8FFE0", "89504E470D0A1A0A", "524946460000000057454250", "474946383961", "0000001C66747970617669660000", "0000001C6674797069736F6D", "1A45DFA3", "00"]
    d = standin.docs(spark, sf_dir).select("doc_id", F.get(F.array(*[F.lit(h) for h in heads]), (F.col("doc_id") % 8).cast("int")).alias("head"))
    return d.select("doc_id", names.sniff(F.unhex("head")).alias("format"))


def machine_blocks(spark, sf_dir):
    """Texts with a machine's block put in, and taken apart again."""
    body = F.concat(F.lit("own "), F.col("doc_id").cast("string"))
    d = standin.docs(spark, sf_dir).select("doc_id", text.with_block(body, "English (machine):", F.lit(" two ")).alias("t"))
    parts = text.split_blocks(F.col("t"))
    return d.select("doc_id", F.array_join(F.array(*[parts[n] for n in d.select(parts.alias("p")).schema["p"].dataType.names]), "|").alias("parts"))


OTHER_RULES = Vocabulary.of(aliases={"good": "fine", "old": "new"}, implications={"toxic": ["flagged", "bad"]}, categories={"Theme ": [" Keep"], "series": ["keep"]}, colors={"mood": "#102030"})


def vocabulary_merge(spark, sf_dir):
    """The rules of two vocabularies together, as lines, and the aliases on which they disagree."""
    out, clashes = merge(RULES, OTHER_RULES)
    return spark.createDataFrame([[x] for x in sorted(out.lines())] + [[f"clash {k}: {a} or {b}"] for k, a, b in clashes], "line string")


def vocabulary_diff(spark, sf_dir):
    mine, other = diff(RULES, OTHER_RULES)
    return spark.createDataFrame([["local", x] for x in mine] + [["other", x] for x in other], "side string, line string")


def vocabulary_rename(spark, sf_dir):
    done = RULES.rename("toxic", "harmful")
    return spark.createDataFrame([[x] for x in sorted(done.vocabulary.lines())], "line string")


def vocabulary_facts(spark, sf_dir):
    """Of every tag of the collection and of its denial, whether it implies another, and its category."""
    tags = _cat(spark, sf_dir).table("tags").select("tag").distinct()
    tags = tags.union(tags.select(F.concat(F.lit("not:"), "tag")))
    leads = RULES.to_frames(spark)["closure"].where("implied = 'review'").select("tag", F.lit(True).alias("leads"))
    return tagging.category_of(tags, RULES).join(F.broadcast(leads), "tag", "left").select("tag", F.coalesce("leads", F.lit(False)).alias("implies_review"), "category")


def sync_decisions(spark, sf_dir):
    """What to do with each document's rules, by fingerprints of its text, its source's first text and its language's first text."""
    d = standin.docs(spark, sf_dir).select("doc_id", "source", "lang", (F.col("n_chars") % 5).alias("local"))
    other = d.groupBy("source").agg(F.min_by("local", "doc_id").alias("other"))
    base = d.groupBy("lang").agg(F.min_by("local", "doc_id").alias("base"))
    rows = d.join(other, "source").join(base, "lang").withColumn("other", F.when(F.col("doc_id") % 11 != 0, F.col("other")))
    return rows.select("doc_id", decisions(F.col("local"), F.col("other"), F.col("base")).alias("decision"))


def query_operands(spark, sf_dir):
    """Parts of queries: similar specs and operands, the tag under the caret."""
    tree = q.parse("similar:a@5 || (similar:b, -similar:a)")
    rows = [["similar", *map(str, q.similar_spec(x))] for x in ("a/b.png@12", "a@b")] + [["operand", x, ""] for x in q.similar_operands(tree)]
    rows += [["caret", typed, str(found and found[2])] for typed in ("cat, do", "size.gt:1", "a || -bi") for found in [q.completion(typed, len(typed))]]
    return spark.createDataFrame(rows, "kind string, a string, b string")


_MORE = (
    search_similar_order, carried_texts, merge_tags, merge_texts, relational_canon, relational_implied, relational_edit, relational_offers, suggestion_answers, renamed_tags, deleted_tags, action_requests, history_added,
    inserted_rejects, floor_counts, foreign_completion, assistant_page, group_page, source_selection, awaiting_text, ocr_queue_head, stored_readings, text_precedence, fresh_artefacts, folded_view, prefixed_files, cache_keys,
    url_names, sniffed, machine_blocks, vocabulary_merge, vocabulary_diff, vocabulary_rename, vocabulary_facts, sync_decisions, query_operands,
)

QUERIES = {
    **registry_bytes.QUERIES,
    **registry_rules.QUERIES,
    **{f.__name__: f for f in _MORE},
    **{k: _searcher(q) for k, (q, _) in SEARCHES.items()},
    **{k: _bitmap_search(q) for k, (q, _) in BITMAPS.items()},
    **{f.__name__: f for f in (unrejected, bitmap_count, hash_classes, hamming_pairs_wide, holdout_feedback, pass_outcomes)},
    "all_rows": all_rows, "point_lookup": point_lookup, "path_by_id": path_by_id, "search_scope": search_scope, "search_similar": search_similar, "page_newest": page_newest, "next_thin": next_thin,
    "tag_counts": lambda s, d: tagging.tag_counts(_cat(s, d).table("tags")), "hand_tag_counts": lambda s, d: tagging.hand_tag_counts(_cat(s, d).table("tags")), "shared_tags": selection_shared,
    "rule_counts": lambda s, d: tagging.rule_counts(_cat(s, d).table("tags"), RULES), "category_counts": lambda s, d: tagging.category_counts(_cat(s, d).table("tags"), RULES),
    "tier_counts": lambda s, d: paging.tier_counts(_cat(s, d).files(), 2), "implied_closure": implied_closure, "implied_rows": implied_rows, "reimply_changed": reimply_changed,
    "suggestions_offered": suggestions_offered, "tag_edit": tag_edit, "canon_tags": canon_tags, "folder_tags": folder_tags_query, "tag_history": tag_history_counts, "completion_load": completion_load, "completion_rank": completion_rank,
    "hamming_topk": hamming_topk, "hamming_pairs": hamming_pairs, "duplicate_groups": duplicate_groups, "shared_ids": shared_ids, "centroid_rank": centroid_rank, "centroid_rank_rejects": centroid_rank_rejects,
    "tfidf_rank": tfidf_rank, "holdout_measure": holdout_measure, "listing_diff": listing_diff, "rename_carry": rename_carry, "merge_result": merge_result, "forget_rows": forget_rows, "cache_invalidation": cache_invalidation,
    "ocr_status": ocr_status, "ocr_unread": ocr_unread, "ocr_queue": ocr_queue, "ocr_done_union": ocr_done_union, "ocr_embed_pending": ocr_embed_pending,
    "clean_strip_tags": clean_strip_tags, "clean_scanned": clean_scanned, "clean_model": clean_model, "page_names": page_names, "file_ids": file_ids, "export_rows": export, "verify_index": verify_index,
}

_CLOSURE = "closure(tag, implied) AS (VALUES ('toxic', 'flagged'), ('toxic', 'review'), ('flagged', 'review'), ('review', 'flagged'), ('folder:en', 'lang:english'), ('quality:good', 'keep'))"
_IMPLIED = f"""{_BASE}, {_CLOSURE},
own AS (SELECT DISTINCT path, tag FROM tags WHERE source <> 'implied'),
implied AS (SELECT DISTINCT o.path, c.implied AS tag FROM own o JOIN closure c USING (tag) WHERE NOT EXISTS (SELECT 1 FROM own p WHERE p.path = o.path AND p.tag = c.implied))"""
_VALUES = f"""{_BASE}, seen AS (
  SELECT tag, count(DISTINCT path) AS n FROM tags WHERE NOT starts_with(tag, 'folder:') GROUP BY tag
  UNION ALL SELECT event_type, count(*) FROM events GROUP BY event_type
  UNION ALL SELECT t, 0 FROM (VALUES ('poisonous'), ('toxic'), ('good'), ('quality:good'), ('deutsch'), ('folder:de'), ('flagged'), ('review'), ('folder:en'), ('lang:english'), ('keep')) v(t)
), vals AS (SELECT tag, CAST(sum(n) AS BIGINT) AS "count", TRUE AS own FROM seen GROUP BY tag)"""


def _centroid_sql(rejects: bool, members: str, excluded: str, limit: str) -> str:
    cos = "(SELECT sum(CAST(v.embedding[CAST(p.pos AS INTEGER)] AS DOUBLE) * p.x) FROM {c} p) / sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN v.embedding]))"
    part = "{c}0 AS (SELECT i.i AS pos, sum(CAST(m.embedding[CAST(i.i AS INTEGER)] AS DOUBLE)) AS x FROM vecs m CROSS JOIN range(1, 65) i(i) WHERE {w} GROUP BY i.i), {c} AS (SELECT pos, x / (SELECT sqrt(sum(x * x)) FROM {c}0) AS x FROM {c}0)"
    ctes = part.format(c="pos_c", w=members) + (", " + part.format(c="neg_c", w="label = 4 AND vec_id % 5 = 0") if rejects else "")
    score = cos.format(c="pos_c") + (" - 0.5 * " + cos.format(c="neg_c") if rejects else "")
    return f"WITH {_VECTORS}, {ctes}, ranked AS (SELECT v.path, round({score}, 6) AS score FROM vecs v WHERE NOT ({excluded}))\nSELECT path, score FROM ranked ORDER BY score DESC, path {limit}"


_TOKENS = r"[t FOR t IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF length(t) >= 2]"
_TFIDF = f"""WITH {_BASE},
filled AS (SELECT path, text FROM texts WHERE trim(text, ' ') <> ''),
total AS (SELECT count(*) AS n FROM filled),
tok AS (SELECT path, unnest({_TOKENS}) AS term FROM filled),
tf AS (SELECT path, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT path, term, (1 + ln(tf)) * ln(n / df) AS w FROM tf JOIN df USING (term) CROSS JOIN total),
norm AS (SELECT path, sqrt(sum(w * w)) AS norm FROM raw GROUP BY path),
space AS (SELECT path, term, CASE WHEN norm > 0 THEN w / norm ELSE 0 END AS weight FROM raw JOIN norm USING (path)),
pos AS (SELECT DISTINCT path FROM tags WHERE tag = 'toxic'),
proto0 AS (SELECT term, sum(weight) AS w FROM space SEMI JOIN pos USING (path) GROUP BY term),
proto AS (SELECT term, w / (SELECT sqrt(sum(w * w)) FROM proto0) AS p FROM proto0),
like_ AS (SELECT path, sum(weight * p) AS s FROM space JOIN proto USING (term) GROUP BY path)
SELECT f.path, round(coalesce(s, 0), 6) AS score FROM filled f LEFT JOIN like_ USING (path) ANTI JOIN pos USING (path)"""
_LISTS = "local AS (SELECT * FROM files WHERE doc_id % 7 <> 0), listed AS (SELECT path, id, mtime, CASE WHEN doc_id % 13 = 0 THEN size + 1 ELSE size END AS size FROM files WHERE doc_id % 11 <> 0)"

_RELATED = f"related AS (SELECT {_PATH} AS path, d.doc_id, d.lang FROM documents d)"
_WORDS_OF = "(SELECT string_agg({e}, '|' ORDER BY {e}) FROM (SELECT DISTINCT tag FROM tags t WHERE t.path = p.path{w}))"
_FRESH = f"""{_BASE}, {_LISTS},
scanned AS (SELECT r.*, f.lang_ FROM (SELECT l.*, l.path AS p FROM listed_all l LEFT JOIN local o ON o.path = l.path WHERE o.path IS NULL OR o.size <> l.size OR o.mtime <> l.mtime) r JOIN (SELECT path, format AS lang_ FROM files) f ON f.path = r.path)"""
_FRESH = _FRESH.replace("scanned AS", "listed_all AS (SELECT f.doc_id, r.* FROM listed r JOIN files f ON f.path = r.path),\nscanned AS")
_LINES = [
    "toxic ⇒ flagged", "flagged ⇒ review", "review ⇒ flagged", "folder:en ⇒ lang:english", "quality:good ⇒ keep", "quality:good suggests feature", "folder:en suggests quality:poor", "folder:en suggests english text",
    "toxic suggests not:keep", "toxic suggests hide", "quality:good is a subject", "quality:poor is a subject", "toxic is a commentary", "poisonous = toxic", "good = quality:good", "deutsch = folder:de",
]
_OTHER_LINES = ["toxic ⇒ flagged", "toxic ⇒ bad", "keep is a series", "mood is tinted #102030", "good = fine", "old = new"]


def _values(rows, names: str) -> str:
    sql = lambda v: "NULL" if v is None else ("TRUE" if v is True else "FALSE" if v is False else "'" + str(v).replace("'", "''") + "'")
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in rows)}) v({names})"


_MORE_SQL = {
    "search_similar_order": _sql(f"SELECT path FROM (SELECT f.path, f.created_at, bit_count(xor(h0, (SELECT h0 FROM hashes WHERE vec_id = 3))) AS far FROM files f JOIN hashes h ON h.vec_id = f.doc_id WHERE {_has('folder:en')}) WHERE far <= 40 ORDER BY far, created_at DESC, path LIMIT 15", f"{_BASE}, {_VECTORS}"),
    "carried_texts": _sql(f"SELECT coalesce(m.new_path, t.path) AS path, md5(t.body) AS body_md5 FROM (SELECT {_PATH} AS path, CASE WHEN doc_id % 37 = 0 THEN '' ELSE text END AS body FROM documents d) t LEFT JOIN (SELECT g.p AS old_path, f.p AS new_path FROM (SELECT id, min(path) AS p FROM files WHERE doc_id % 5 = 0 GROUP BY id HAVING count(*) = 1) g JOIN (SELECT id, min('main/moved/' || CAST(doc_id AS VARCHAR)) AS p FROM files WHERE doc_id % 5 IN (0, 1) GROUP BY id HAVING count(*) = 1) f USING (id)) m ON m.old_path = t.path"),
    "merge_tags": _sql("SELECT t.path, t.tag, t.source FROM tags t JOIN local USING (path) WHERE path IN (SELECT path FROM listed) AND path NOT IN (SELECT path FROM scanned) UNION ALL SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'toxic' ELSE 'big<toxic>' END, 'xmp' FROM scanned UNION ALL SELECT path, 'folder:' || lower(string_split(path, '/')[k]), 'folder' FROM scanned, (VALUES (2), (3)) v(k) UNION ALL SELECT path, i, 'implied' FROM scanned, (VALUES ('flagged'), ('review')) v(i) UNION ALL SELECT path, i, 'implied' FROM scanned, (VALUES ('big'), ('toxic')) v(i) WHERE doc_id % 3 <> 0 UNION ALL SELECT path, 'lang:english', 'implied' FROM scanned WHERE lang_ = 'en'", _FRESH),
    "merge_texts": _sql("SELECT 'text' AS kind, path, md5('scan ' || CAST(doc_id AS VARCHAR)) AS body_md5 FROM scanned WHERE doc_id % 4 = 2 UNION ALL SELECT 'text', l.path, md5(CASE WHEN l.doc_id % 37 = 0 THEN '' ELSE d.text END) FROM local l JOIN documents d USING (doc_id) WHERE l.path IN (SELECT path FROM listed) AND l.path NOT IN (SELECT path FROM scanned WHERE doc_id % 4 = 2) UNION ALL SELECT 'manual_text', path, md5('scan ' || CAST(doc_id AS VARCHAR)) FROM scanned WHERE doc_id % 4 = 0 UNION ALL SELECT 'manual_text', l.path, md5(CASE WHEN l.doc_id % 50 = 0 THEN '' ELSE 'REVIEWED ' || d.text END) FROM local l JOIN documents d USING (doc_id) WHERE l.doc_id % 50 IN (0, 25) AND l.path IN (SELECT path FROM listed) AND l.path NOT IN (SELECT path FROM scanned)", _FRESH),
    "relational_canon": f"WITH {_RELATED} SELECT path, CASE doc_id % 4 WHEN 0 THEN 'big<toxic>' WHEN 1 THEN 'quality:good<folder:en>' WHEN 2 THEN '<toxic>' ELSE 'folder:de' END AS tag FROM related",
    "relational_implied": f"WITH {_RELATED} SELECT path, v.tag FROM related JOIN (VALUES (0, 'big'), (0, 'toxic'), (0, 'flagged'), (0, 'review'), (1, 'quality:good'), (1, 'keep'), (1, 'folder:en'), (1, 'lang:english')) v(k, tag) ON v.k = doc_id % 4",
    "relational_edit": f"WITH {_RELATED} SELECT path, CASE doc_id % 4 WHEN 0 THEN 'big<quality:good>' WHEN 1 THEN 'big<quality:good>|quality:good<folder:en>' WHEN 2 THEN '<toxic>|big<quality:good>' ELSE 'big<quality:good>|folder:de' END AS new_tags, TRUE AS changed FROM related",
    "relational_offers": _sql("SELECT path, " + _WORDS_OF.format(e="'big<' || tag || '>'", w=" AND source <> 'implied'") + " AS offers FROM (SELECT DISTINCT path FROM tags WHERE source <> 'implied') p"),
    "suggestion_answers": _sql("SELECT path, (SELECT string_agg(tag, '|' ORDER BY tag) FROM (SELECT tag FROM tags t WHERE t.path = p.path UNION SELECT 'hide')) AS accepted, (SELECT string_agg(tag, '|' ORDER BY tag) FROM (SELECT tag FROM tags t WHERE t.path = p.path UNION SELECT 'not:hide')) AS refused FROM (SELECT DISTINCT path FROM tags) p"),
    "renamed_tags": _sql("SELECT DISTINCT path, CASE WHEN source = 'xmp' AND tag = 'toxic' THEN 'quality:good' ELSE tag END AS tag, source FROM tags"),
    "deleted_tags": _sql("SELECT path, tag, source FROM tags WHERE NOT (source = 'xmp' AND tag = 'toxic')"),
    "action_requests": _sql("SELECT path, tag AS request, CASE tag WHEN 'toxic' THEN 'toxic done' ELSE 'checked' END AS done FROM tags WHERE tag IN ('toxic', 'quality:poor')"),
    "history_added": "SELECT tag, CAST(sum(uses) AS BIGINT) AS uses FROM (SELECT event_type AS tag, count(*) AS uses FROM events GROUP BY event_type UNION ALL SELECT 'click', 5 UNION ALL SELECT 'toxic', 2) GROUP BY tag",
    "inserted_rejects": _sql("SELECT 'toxic' AS tag, path FROM files WHERE doc_id % 6 = 0 OR doc_id % 4 = 0"),
    "unrejected": _sql("SELECT 'toxic' AS tag, path FROM files WHERE doc_id % 6 = 0 AND doc_id % 4 <> 0"),
    "floor_counts": _sql("SELECT tag, CAST(max(n) AS BIGINT) AS \"count\" FROM (SELECT tag, count(DISTINCT path) AS n FROM tags GROUP BY tag UNION ALL SELECT * FROM (VALUES ('toxic', 3), ('lost', 7), ('folder:en', 1099511627776)) v(t, n)) GROUP BY tag"),
    "foreign_completion": _sql("SELECT * FROM vals UNION ALL SELECT 'ask me', 0, TRUE UNION ALL SELECT 'hidden in', 4, FALSE UNION ALL SELECT 'inner', 4, FALSE", _VALUES),
    "assistant_page": _sql("SELECT path FROM files ORDER BY xmp_tag_count, created_at DESC, path LIMIT 25"),
    "group_page": _sql("SELECT id, count(*) AS n FROM files GROUP BY id HAVING count(*) > 1 ORDER BY n DESC, id LIMIT 3 OFFSET 3"),
    "source_selection": _sql("SELECT path FROM files WHERE starts_with(path, 'main/de/') OR (starts_with(path, 'main/en/') AND NOT starts_with(path, 'main/en/src0/'))"),
    "awaiting_text": _sql("SELECT path FROM files WHERE kind = 'image' AND doc_id % 4 = 0 AND doc_id % 50 NOT IN (0, 25)"),
    "ocr_queue_head": _sql("SELECT path FROM files f WHERE kind = 'image' AND doc_id % 50 NOT IN (0, 25) AND NOT EXISTS (SELECT 1 FROM text_meta m WHERE m.path = f.path AND engine = 'e2') ORDER BY path LIMIT 7"),
    "stored_readings": _sql("SELECT engine, count(*) AS n, max(read_at) AS last FROM (SELECT engine, read_at FROM text_meta m JOIN files f USING (path) WHERE doc_id % 8 <> 0 UNION ALL SELECT 'e9', 5.0 FROM files WHERE doc_id % 8 = 0) GROUP BY engine"),
    "text_precedence": f"""WITH rows_ AS (SELECT {_PATH} AS path, CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'in file' END AS file, CASE WHEN doc_id % 37 = 0 THEN '' ELSE substr(text, 1, 9) END AS machine, CASE doc_id % 50 WHEN 0 THEN '' WHEN 25 THEN 'REVIEWED ' END AS reviewed FROM documents d),
picked AS (SELECT path, reviewed, coalesce(reviewed, CASE WHEN machine <> '' THEN machine END, file, '') AS editor, CASE WHEN trim(coalesce(file, ''), ' ') <> '' THEN file ELSE machine END AS action FROM rows_)
SELECT path, editor, action, reviewed IS NOT NULL OR editor IS NOT DISTINCT FROM action AS embedded FROM picked""",
    "fresh_artefacts": _sql("SELECT path FROM files WHERE doc_id % 4 <= 2"),
    "folded_view": _sql("SELECT path, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE size END AS size FROM files WHERE doc_id % 5 = 0 OR doc_id % 7 <> 0"),
    "prefixed_files": _sql("SELECT 'old' || substr(path, 5) AS path, size FROM files"),
    "cache_keys": _sql("SELECT CASE WHEN doc_id % 2 = 0 THEN path ELSE 'x' || path END AS path, 'p' || substr(CASE WHEN doc_id % 2 = 0 THEN sha256(substr(path, 6)) ELSE sha256(chr(0) || 'x' || path) END, 1, 16) AS cache_key FROM files"),
    "url_names": "SELECT page_id, url || '/ä b+c~(1)' AS back, CASE WHEN page_id % 2 = 0 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS media_type FROM pages",
    "sniffed": "SELECT doc_id, ['jpeg', 'png', 'webp', 'gif', 'avif', 'mp4', 'mkv', 'other'][doc_id % 8 + 1] AS format FROM documents",
    "machine_blocks": "SELECT doc_id, 'own ' || CAST(doc_id AS VARCHAR) || '|English (machine):' || chr(10) || 'two' AS parts FROM documents",
    "vocabulary_merge": _values([[x] for x in sorted({*_LINES, *_OTHER_LINES} - {"good = fine"})] + [["clash good: quality:good or fine"]], "line"),
    "vocabulary_diff": _values([["local", x] for x in _LINES if x != "toxic ⇒ flagged"] + [["other", x] for x in _OTHER_LINES if x != "toxic ⇒ flagged"], "side, line"),
    "vocabulary_rename": _values([[x.replace("toxic", "harmful")] for x in _LINES], "line"),
    "vocabulary_facts": _sql("SELECT p || tag AS tag, p = '' AND tag IN ('toxic', 'flagged') AS implies_review, CASE WHEN tag IN ('quality:good', 'quality:poor') THEN 'subject' WHEN tag = 'toxic' THEN 'commentary' ELSE 'other' END AS category FROM (SELECT DISTINCT tag FROM tags), (VALUES (''), ('not:')) v(p)"),
    "sync_decisions": "WITH d AS (SELECT doc_id, source, lang, n_chars % 5 AS local FROM documents), r AS (SELECT doc_id, local, CASE WHEN doc_id % 11 <> 0 THEN first_value(local) OVER (PARTITION BY source ORDER BY doc_id) END AS other, first_value(local) OVER (PARTITION BY lang ORDER BY doc_id) AS base FROM d) SELECT doc_id, CASE WHEN other IS NULL THEN 'seed' WHEN local = other THEN 'in_sync' WHEN base = other THEN 'push' WHEN base = local THEN 'pull' ELSE 'conflict' END AS decision FROM r",
    "query_operands": _values([("similar", "a/b.png", "12"), ("similar", "a@b", "20"), ("operand", "a", ""), ("operand", "b", ""), ("caret", "cat, do", "do"), ("caret", "size.gt:1", "None"), ("caret", "a || -bi", "bi")], "kind, a, b"),
}


def _bitmap_sql(where: str) -> str:
    names = ("quality:good", "quality:poor", "folder:en", "folder:de", "toxic", "flagged")
    flags = ", ".join(f"{_has(n)} AS {n.replace(':', '_')}" for n in names)
    return _sql(f"SELECT path FROM (SELECT f.*, {flags} FROM files f) WHERE {where}")


def _holdout_sql() -> str:
    cos = "(SELECT sum(CAST(v.embedding[CAST(p.pos AS INTEGER)] AS DOUBLE) * p.x) FROM {c} p) / sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN v.embedding]))"
    centre = "{c}0 AS (SELECT i.i AS pos, sum(CAST(m.embedding[CAST(i.i AS INTEGER)] AS DOUBLE)) AS x FROM vecs m JOIN {m} USING (path) CROSS JOIN range(1, 65) i(i) GROUP BY i.i), {c} AS (SELECT pos, x / (SELECT sqrt(sum(x * x)) FROM {c}0) AS x FROM {c}0)"
    ctes = [
        "parts AS (SELECT path, row_number() OVER (ORDER BY md5('0:' || path), path) - 1 < greatest(1, (SELECT count(*) FROM vecs WHERE label = 3) // 3) AS hidden FROM vecs WHERE label = 3)",
        "shown AS (SELECT path FROM parts WHERE NOT hidden)", centre.format(c="pos_c", m="shown"),
        f"one AS (SELECT v.path, round({cos.format(c='pos_c')}, 6) AS score FROM vecs v ANTI JOIN shown USING (path))",
        "wrong AS (SELECT path FROM one ANTI JOIN (SELECT path FROM parts WHERE hidden) h USING (path) ORDER BY score DESC, path LIMIT 10)", centre.format(c="neg_c", m="wrong"),
        f"two AS (SELECT v.path, round({cos.format(c='pos_c')} - 0.5 * {cos.format(c='neg_c')}, 6) AS score FROM vecs v ANTI JOIN shown USING (path) ANTI JOIN wrong USING (path))",
        "ranked AS (SELECT 1 AS round, path, row_number() OVER (ORDER BY score DESC, path) AS r FROM one UNION ALL SELECT 2, path, row_number() OVER (ORDER BY score DESC, path) FROM two)",
        "hits AS (SELECT round, r, row_number() OVER (PARTITION BY round ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY round) AS n FROM ranked JOIN (SELECT path FROM parts WHERE hidden) h USING (path))",
    ]
    found = ", ".join(f"count(*) FILTER (r <= {k}) AS found_{n}" for k, n in ((50, "50"), (100, "100"), (500, "500"), (50, "top")))
    return f"WITH {_VECTORS}, {', '.join(ctes)} SELECT s.scored, h.* EXCLUDE (round), round(50.0 * (SELECT count(*) FROM parts WHERE hidden) / greatest(s.scored, 1), 6) AS chance, round FROM (SELECT round, {found}, max(r) FILTER (k = n // 2) AS median_rank FROM hits GROUP BY round) h JOIN (SELECT round, count(*) AS scored FROM ranked GROUP BY round) s USING (round)"


ORACLES = {
    **registry_bytes.ORACLES,
    **registry_rules.ORACLES,
    **_MORE_SQL,
    **{k: _bitmap_sql(w) for k, (_, w) in BITMAPS.items()},
    "bitmap_count": _sql(f"SELECT count(*) AS n FROM files f WHERE NOT ({_has('folder:en')} AND NOT {_has('quality:good')}) OR {_has('toxic')}"),
    "hash_classes": _sql("SELECT h0, min(path) AS rep, count(*) AS n FROM hashes GROUP BY h0", _VECTORS),
    "hamming_pairs_wide": """WITH bits AS (SELECT e.vec_id, 'main/v/' || lpad(CAST(e.vec_id AS VARCHAR), 7, '0') AS path, s.s,
  bit_or(CASE WHEN e.embedding[CAST(i.i AS INTEGER) + 1] > CASE WHEN s.s = 0 THEN 0 ELSE e.embedding[CAST((i.i + s.s) % 64 AS INTEGER) + 1] END THEN CAST(1 AS UBIGINT) << CAST(i.i AS UBIGINT) ELSE CAST(0 AS UBIGINT) END) AS h
  FROM embeddings e CROSS JOIN range(64) i(i) CROSS JOIN (VALUES (0), (1), (7), (20)) s(s) GROUP BY ALL),
wide AS (SELECT path, list(h ORDER BY s) AS h FROM bits GROUP BY path HAVING sum(CAST(bit_count(h) AS BIGINT)) <= 144)
SELECT a, b, distance FROM (SELECT x.path AS a, y.path AS b, CAST(list_sum(list_transform([1, 2, 3, 4], lambda k: CAST(bit_count(xor(x.h[k], y.h[k])) AS BIGINT))) AS BIGINT) AS distance FROM wide x JOIN wide y ON x.path < y.path) WHERE distance <= 84""",
    "holdout_feedback": _holdout_sql(),
    "holdout_measure": f"SELECT * EXCLUDE (round) FROM ({_holdout_sql()}) WHERE round = 1",
    "pass_outcomes": """WITH log AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skip' ELSE 'ok' END AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
seen AS (SELECT *, count(*) FILTER (outcome = 'error') OVER (PARTITION BY user_id ORDER BY k ROWS 2 PRECEDING) AS bad, count(*) FILTER (outcome <> 'skip') OVER (PARTITION BY user_id ORDER BY k) AS tried FROM log),
ends AS (SELECT user_id, min(k) FILTER (bad = 3) AS run_end, min(k) FILTER (tried = 25) AS limit_end, max(k) AS last FROM seen GROUP BY user_id)
SELECT s.user_id, count(*) FILTER (outcome <> 'skip') AS attempts, count(*) FILTER (outcome = 'error') AS errors, coalesce(run_end <= least(last, coalesce(run_end, last), coalesce(limit_end, last)), FALSE) AS stopped FROM seen s JOIN ends e USING (user_id) WHERE k <= least(last, coalesce(run_end, last), coalesce(limit_end, last)) GROUP BY ALL""",
    **{k: _search(w) for k, (_, w) in SEARCHES.items()},
    "all_rows": _sql("SELECT f.path, (SELECT string_agg(DISTINCT tag, '|' ORDER BY tag) FROM tags t WHERE t.path = f.path) AS tags, length(x.text) AS text_len FROM files f JOIN texts x USING (path)"),
    "point_lookup": _sql("SELECT f.path, f.id, (SELECT string_agg(DISTINCT tag, '|' ORDER BY tag) FROM tags t WHERE t.path = f.path) AS tags FROM files f WHERE doc_id = 7"),
    "path_by_id": _sql("SELECT path FROM files WHERE starts_with(id, 'a') ORDER BY path LIMIT 1"),
    "search_scope": _sql("SELECT path FROM files WHERE (starts_with(path, 'main/en/') AND NOT starts_with(path, 'main/en/src0/')) OR starts_with(path, 'main/de/src1/')"),
    "search_similar": _sql("SELECT f.path FROM files f JOIN hashes h ON h.vec_id = f.doc_id WHERE bit_count(xor(h0, (SELECT h0 FROM hashes WHERE vec_id = 3))) <= 22", f"{_BASE}, {_VECTORS}"),
    "page_newest": _sql(f"SELECT path FROM files f WHERE {_has('folder:en')} ORDER BY created_at DESC, path LIMIT 60 OFFSET 60"),
    "next_thin": _sql("SELECT path FROM (SELECT path, xmp_tag_count, row_number() OVER (ORDER BY created_at DESC, path) - 1 AS pos FROM files) WHERE xmp_tag_count < 1 ORDER BY pos <= 40, pos LIMIT 1"),
    "tag_counts": _sql("SELECT tag, count(DISTINCT path) AS n FROM tags GROUP BY tag"),
    "hand_tag_counts": _sql("SELECT tag, count(DISTINCT path) AS n FROM tags WHERE source = 'xmp' GROUP BY tag"),
    "shared_tags": _sql("SELECT tag, count(DISTINCT t.path) AS n, count(DISTINCT t.path) = (SELECT count(*) FROM files WHERE doc_id % 97 < 3) AS shared FROM tags t JOIN files f USING (path) WHERE doc_id % 97 < 3 GROUP BY tag"),
    "rule_counts": _sql("SELECT r.tag, count(DISTINCT t.path) AS n FROM (VALUES ('toxic'), ('flagged'), ('review'), ('folder:en'), ('lang:english'), ('quality:good'), ('keep')) r(tag) LEFT JOIN tags t USING (tag) GROUP BY r.tag"),
    "category_counts": _sql("SELECT c.category, CAST(sum(CASE WHEN k.tag IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n FROM (VALUES ('character'), ('series'), ('artist'), ('subject'), ('commentary'), ('theme'), ('format'), ('action'), ('other')) c(category) LEFT JOIN (SELECT DISTINCT tag, CASE WHEN tag IN ('quality:good', 'quality:poor') THEN 'subject' WHEN tag = 'toxic' THEN 'commentary' ELSE 'other' END AS category FROM tags) k USING (category) GROUP BY c.category"),
    "tier_counts": _sql("SELECT count(*) FILTER (xmp_tag_count = 0) AS untagged, count(*) FILTER (xmp_tag_count = 1) AS thin, count(*) FILTER (xmp_tag_count >= 2) AS tagged FROM files"),
    "implied_closure": "WITH RECURSIVE edges(tag, too) AS (SELECT client_id, master_id FROM clients WHERE master_id IS NOT NULL UNION SELECT c.client_id, f.first FROM clients c JOIN (SELECT city, min(client_id) AS first FROM clients WHERE city IS NOT NULL GROUP BY city) f USING (city)), walk(tag, implied) AS (SELECT tag, too FROM edges WHERE tag <> too UNION SELECT w.tag, e.too FROM walk w JOIN edges e ON e.tag = w.implied) SELECT tag, implied FROM walk WHERE tag <> implied",
    "implied_rows": _sql("SELECT path, tag FROM implied", _IMPLIED),
    "reimply_changed": _sql("SELECT path, (SELECT string_agg(tag, '|' ORDER BY tag) FROM (SELECT tag FROM own o WHERE o.path = p.path UNION SELECT tag FROM implied i WHERE i.path = p.path)) AS tags FROM (SELECT DISTINCT path FROM own) p WHERE coalesce((SELECT string_agg(tag, '|' ORDER BY tag) FROM implied i WHERE i.path = p.path), '') <> coalesce((SELECT string_agg(DISTINCT tag, '|' ORDER BY tag) FROM tags t WHERE t.path = p.path AND t.source = 'implied'), '')", _IMPLIED),
    "suggestions_offered": _sql("SELECT DISTINCT t.path, s.s AS tag FROM tags t JOIN (VALUES ('quality:good', 'feature'), ('folder:en', 'quality:poor'), ('folder:en', 'english text'), ('toxic', 'hide')) s(t, s) ON s.t = t.tag WHERE NOT EXISTS (SELECT 1 FROM tags h WHERE h.path = t.path AND h.tag IN (s.s, 'not:' || s.s))"),
    "tag_edit": _sql("SELECT path, (SELECT string_agg(tag, '|' ORDER BY tag) FROM (SELECT tag FROM tags t WHERE t.path = p.path AND tag <> 'toxic' UNION SELECT 'checked')) AS new_tags, TRUE AS changed FROM (SELECT DISTINCT path FROM tags) p"),
    "canon_tags": "SELECT event_id, CASE event_type WHEN 'click' THEN 'quality:good' WHEN 'view' THEN 'toxic' ELSE event_type END AS tag FROM events",
    "folder_tags": _sql(f"SELECT {_PATH} AS path, 'folder:' || lang || '|folder:' || source AS folder_tags FROM documents d"),
    "tag_history": "SELECT event_type AS tag, count(*) AS uses FROM events GROUP BY event_type",
    "completion_load": _sql("SELECT * FROM vals", _VALUES),
    "completion_rank": _sql("SELECT tag FROM vals WHERE contains(lower(tag), 'i') ORDER BY own DESC, starts_with(lower(tag), 'i') DESC, \"count\" DESC, tag LIMIT 8", _VALUES),
    "hamming_topk": _sql("SELECT path, CAST(distance AS BIGINT) AS distance, rank FROM (SELECT path, distance, row_number() OVER (ORDER BY distance, path) AS rank, count(*) FILTER (distance <= 20) OVER () AS near FROM (SELECT path, bit_count(xor(h0, (SELECT h0 FROM hashes WHERE vec_id = 0))) AS distance FROM hashes)) WHERE rank <= least(greatest(near, 1), 25)", _VECTORS),
    "hamming_pairs": _sql(f"SELECT a.path AS a, b.path AS b, CAST(bit_count(xor(a.h0, b.h0)) AS BIGINT) AS distance FROM hashes a JOIN hashes b ON a.path < b.path WHERE bit_count(xor(a.h0, b.h0)) <= {WITHIN}", _VECTORS),
    "shared_ids": _sql("SELECT id, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths FROM files GROUP BY id HAVING count(*) > 1"),
    "centroid_rank": _centroid_sql(False, "label = 3", "coalesce(label = 3, FALSE)", ""),
    "centroid_rank_rejects": _centroid_sql(True, "label = 3", "coalesce(label = 3 OR (label = 4 AND vec_id % 5 = 0), FALSE)", "LIMIT 50"),
    "tfidf_rank": _TFIDF,
    "listing_diff": _sql("SELECT path, CASE WHEN l.path IS NULL THEN 'new' WHEN r.path IS NULL THEN 'gone' ELSE 'changed' END AS change FROM local l FULL JOIN listed r USING (path) WHERE l.path IS NULL OR r.path IS NULL OR l.size <> r.size OR l.mtime <> r.mtime", f"{_BASE}, {_LISTS}"),
    "rename_carry": _sql("SELECT g.p AS old_path, f.p AS new_path FROM (SELECT id, min(path) AS p FROM files WHERE doc_id % 5 = 0 GROUP BY id HAVING count(*) = 1) g JOIN (SELECT id, min('main/moved/' || CAST(doc_id AS VARCHAR)) AS p FROM files WHERE doc_id % 5 IN (0, 1) GROUP BY id HAVING count(*) = 1) f USING (id)"),
    "merge_result": _sql("SELECT path, size, id FROM listed", f"{_BASE}, {_LISTS}"),
    "forget_rows": _sql("SELECT 'files' AS name, count(*) AS n FROM files WHERE doc_id % 3 <> 0 UNION ALL SELECT 'tags', count(*) FROM tags JOIN files USING (path) WHERE doc_id % 3 <> 0 UNION ALL SELECT 'text', count(*) FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'text_meta', count(*) FROM text_meta JOIN files USING (path) WHERE doc_id % 3 <> 0"),
    "cache_invalidation": _sql("SELECT path FROM files WHERE doc_id % 3 = 1 AND reverse(id) <> id"),
    "ocr_status": _sql("SELECT engine, count(*) AS n, round(avg(secs), 2) AS avg_secs, max(read_at) AS last_read, (SELECT count(*) FROM files WHERE kind = 'image') - count(*) AS remaining FROM text_meta JOIN files USING (path) WHERE kind = 'image' GROUP BY engine"),
    "ocr_unread": _sql("SELECT count(*) AS unread, count(*) FILTER (indexed_at > (SELECT coalesce(max(read_at), 0) FROM text_meta WHERE engine = 'e1')) AS newer FROM files f WHERE kind = 'image' AND doc_id % 50 NOT IN (0, 25) AND NOT EXISTS (SELECT 1 FROM text_meta m WHERE m.path = f.path AND engine = 'e1')"),
    "ocr_queue": _sql("SELECT path FROM files f WHERE kind = 'image' AND doc_id % 50 NOT IN (0, 25) AND NOT EXISTS (SELECT 1 FROM text_meta m WHERE m.path = f.path AND engine = 'e2')"),
    "ocr_done_union": _sql("SELECT path FROM files WHERE doc_id % 4 <> 0 OR doc_id % 50 IN (0, 25)"),
    "ocr_embed_pending": _sql("SELECT count(*) AS images, count(*) FILTER (d.text <> '' AND f.doc_id % 37 <> 0) AS with_text, count(*) FILTER (d.text <> '' AND f.doc_id % 37 <> 0) AS embed_pending FROM files f JOIN documents d USING (doc_id) WHERE kind = 'image'"),
    "clean_strip_tags": "SELECT page_id, regexp_replace(html, '<[A-Za-z/!][^>]*>', ' ', 'g') AS text FROM pages",
    "clean_scanned": r"SELECT doc_id, md5(array_to_string([y FOR y IN [trim(regexp_replace(x, '[ \t\n\v\f\r]+', ' ', 'g'), ' ') FOR x IN string_split(text, chr(10))] IF length(regexp_replace(y, '[^\p{L}\p{N}]', '', 'g')) >= 2 AND length(regexp_replace(y, '[^\p{L}\p{N}]', '', 'g')) * 2 >= length(y)], chr(10))) AS cleaned FROM documents",
    "page_names": "SELECT page_id, string_split(url, '/')[-1] AS base, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages",
    "file_ids": "SELECT doc_id, 'b' || substr(sha256(text), 1, 16) AS byte_id, sha256(text) AS revision, strftime(make_timestamp(CAST((1546300800 + doc_id * 3661) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%MZ') AS at_minute FROM documents",
    "export_rows": _sql("SELECT f.path, coalesce((SELECT string_agg(DISTINCT tag, '|' ORDER BY tag) FROM tags t WHERE t.path = f.path AND source = 'xmp'), '') AS tags, coalesce((SELECT string_agg(DISTINCT tag, '|' ORDER BY tag) FROM tags t WHERE t.path = f.path AND source = 'folder'), '') AS folder_tags, coalesce((SELECT string_agg(DISTINCT tag, '|' ORDER BY tag) FROM tags t WHERE t.path = f.path AND source = 'implied'), '') AS implied_tags, md5(x.text) AS text_md5 FROM files f JOIN texts x USING (path)"),
    "verify_index": _sql("SELECT count(*) AS files, count(*) FILTER (doc_id % 9 = 0) AS missing, count(*) FILTER (doc_id % 9 <> 0 AND doc_id % 8 = 0) AS unreadable, count(*) FILTER (ok AND doc_id % 10 = 3) AS bad_metadata, count(*) FILTER (ok AND doc_id % 10 <> 3 AND doc_id % 6 = 0 AND reverse(id) <> id) AS id_drift, count(*) FILTER (ok AND doc_id % 10 <> 3 AND doc_id % 12 = 5) AS mtime_moved, count(*) FILTER (ok AND doc_id % 10 <> 3 AND doc_id % 14 = 1) AS tag_drift FROM (SELECT *, doc_id % 9 <> 0 AND doc_id % 8 <> 0 AS ok FROM files)"),
}


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["search_flagship"](spark, "/root/testdata/sf0.001")


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

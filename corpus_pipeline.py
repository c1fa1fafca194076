"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on every row of docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import ecoc_lang, line_dedup, simhash_bk, suffix_dedup, vector_packing
from shelfspark.llm.common import IdFilter, checkpointed, crc_of_id, maybe_in

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: a null text, or one without a letter. The others get the predicted language.

    The classifier learns from the labelled rows of docs whose crc32(doc_id) mod 3 is not 1. A document whose language
    is ambiguous is kept.
    """
    model = ecoc_lang.train(docs.where(crc_of_id() % 3 != 1))
    said = ecoc_lang.predict(docs, model, keep=["text", "source", "n_chars"])
    return said.where("lang_pred <> 'und'").withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every line that an earlier line matches; a document of which only white space is left goes."""
    return _counted(line_dedup.line_dedup(docs).where("n_removed = 0 OR text RLIKE '\\\\S'"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document of least doc_id stays."""
    groups = simhash_bk.simhash_groups(docs)
    gone = checkpointed(groups.where("id <> component").select(F.col("id").alias("doc_id")).distinct())
    ids = IdFilter.of(gone, "doc_id")
    perhaps = maybe_in(docs, ids, "doc_id").join(gone, "doc_id", "left_anti")
    return maybe_in(docs, ids, "doc_id", False).select(*COLUMNS).union(perhaps.select(*COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 100 bytes that also start earlier; a document that loses all its bytes goes.

    Characters cut through by a removed run are dropped with it, so texts stay UTF-8.
    """
    kept = suffix_dedup.suffix_dedup(docs, keep=("lang", "source"))
    return _counted(kept.where("n_removed < n_bytes OR n_bytes = 0"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    packed = vector_packing.pack(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("suffix_array_dedup", passages), ("packing", packing)]

#: The stages hold a trained classifier and packing, which SQL can't express; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the checkpoint folder once and read from there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: from raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the last return the
columns of documents. Rows are told apart by a hash of id and text, so repeated or null ids do no harm; rows of one id and text
fare alike (and are one document for the near-duplicate stage). A null text counts as an empty one everywhere: it gets the prior's score, all empty texts
are one near-duplicate group, nothing is cut or found in them, and they are packed as an end token. Texts of any length are taken whole. Tables
without rows go through all stages and give no rows. Only doc_id and text are read; more columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import contamination, neargroups, packing, suffixes, wordvectors
from tessera.llm.common import forget, written
from tessera.llm.queries import _tokenizer

QUALITY_THRESHOLD = 0.3
SHINGLE_WORDS, SIMILARITY = 5, 0.8
BATCH = 4 << 20  # bytes that go to a Python worker at once: an executor holds those of all its workers, on both sides
LEAST_ITEMS = 1  # benchmark items that a document must match to be dropped

ORACLE_SQL = None  # learned scores and tokenizers are beyond SQL; tests compare each stage with brute force


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier, learned from the labels of these documents, scores below the threshold."""
    model = wordvectors.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.withColumn("_score", wordvectors.scored(F.col("text").cast("string"), model, spark))
    return scored.where(F.col("_score") >= QUALITY_THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least id, of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    keyed = docs.withColumn("_key", _key(docs))
    ids = written(neargroups.near_groups(keyed, "_key", "text", SHINGLE_WORDS, SIMILARITY).join(keyed.select(F.col("_key").alias("id"), "doc_id").distinct(), "id"), "groups")
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "id")).alias("one")).select(F.col("one.id").alias("_key"))
    kept = keyed.join(first, "_key", "left_semi")
    if not ids.groupBy("id").count().where("count > 1").isEmpty():  # identical rows: one of them
        rest = [c for c in kept.columns if c != "_key"]  # of which that with the least values, in the order of columns
        kept = kept.groupBy("_key").agg(F.min(F.struct(*rest)).alias("one")).select("_key", "one.*")
    return kept.select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 200 bytes and more that occur again out of the texts; n_chars follows."""
    return suffixes.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain an eight-word run of a benchmark item (or a whole shorter item)."""
    keyed = docs.withColumn("_key", _key(docs))
    hits = contamination.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key").where(F.size("items") >= LEAST_ITEMS)
    return keyed.join(hits.select("_key"), "_key", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences of 4096 tokens."""
    return packing.op3_packing(docs, _tokenizer("word_bpe_49k.json"))


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return of


STAGES = [(stage.__name__, _bounded(stage)) for stage in (quality, near_duplicates, repeats, decontaminate, pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        forget(before)  # what the stage before wrote
    return STAGES[-1][1](spark, docs, sf_dir)

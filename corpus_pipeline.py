"""A corpus from ``documents``: language, near-duplicates, benchmark passages, secrets, piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.decontaminate import TEXT, hits, text_keys
from sparkloom.llm.language import UNKNOWN, identify, train
from sparkloom.llm.marks import fresh, marks, parted
from sparkloom.llm.near_dup import near_duplicates
from sparkloom.llm.pieces import piece_digests
from sparkloom.llm.queries import vocabulary
from sparkloom.llm.secrets import redacted
from sparkloom.scratch import drop, saved, small_batches


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter, or without text, go."""
    return identify(docs, train(docs)).where(F.col(fresh(docs, "lang_pred")) != UNKNOWN).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: one with the least doc_id. Rows that repeat stay once, those without doc_id are in no group.

    Rows are told apart by doc_id and text, as a doc_id can be that of several texts. Only rows that may go are shuffled.
    """
    key, goes, single = fresh(docs, "key"), fresh(docs, "goes"), fresh(docs, "single")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    judged = near_duplicates(keyed.where("doc_id is not null").select(F.col(key).alias("doc_id"), "text", F.col("doc_id").alias("own")), carry="own")
    rows = judged.groupBy("component_id", "own", F.col("doc_id").alias(key)).agg(F.count("*").alias("n"))
    least = rows.groupBy("component_id").agg(F.min(F.struct("own", key)).alias("least"))
    others = rows.join(least.hint("merge"), "component_id").select(key, (F.col(key) != F.col(f"least.{key}")).alias(goes), "n")
    others = saved(others.where(F.col(goes) | (F.col("n") > 1)).drop("n"), "others")
    hit, rest = parted(keyed, [key], marks(others, [key]))
    stays = hit.join(others.hint("merge"), key, "left").where(f"doc_id is null or not coalesce({goes}, false)")
    each = F.when(F.col("doc_id").isNotNull() & F.col(goes).isNotNull(), 0).otherwise(F.monotonically_increasing_id() + 1)
    return rest.select(*docs.columns).unionAll(stays.withColumn(single, each).dropDuplicates([key, single]).select(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``. A text alone decides, so rows are judged by its hashes, whatever their doc_id; a null text holds no passage."""
    found = hits(docs.select("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = [fresh(docs, n) for n in TEXT]
    keyed = docs.withColumns(dict(zip(names, text_keys(), strict=True)))
    held = found.select(*[F.col(n).alias(own) for n, own in zip(TEXT, names, strict=True)])
    hit, rest = parted(keyed, names, marks(held, names))
    return rest.select(*docs.columns).unionAll(hit.join(held.hint("merge"), names, "left_anti").select(*docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by its kind in brackets."""
    return redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every text, and the text they decode to, as digests."""
    return piece_digests(docs, vocabulary("piece_bpe_32k.model"), keep=False)


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("decontamination", decontaminated), ("secrets", without_secrets), ("pieces", encoded)]

#: Rank-order profiles and byte-pair merging are not for SQL; tests/llm compares the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with small_batches(spark):
            docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return docs

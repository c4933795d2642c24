"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
import zlib

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.decontaminate import contamination
from sparkloom.llm.language import languages
from sparkloom.llm.main_text import extract
from sparkloom.llm.near_dup import near_duplicates
from sparkloom.llm.neighbours import nearest
from sparkloom.llm.periodic import periodic_runs, run_digests
from sparkloom.llm.pieces import piece_digests
from sparkloom.llm.repeats import remove_repeats
from sparkloom.llm.secrets import secret_digests
from sparkloom.llm.shards import byte_shards
from sparkloom.llm.spelling import spelling_groups, word_counts
from sparkloom.llm.token_files import token_table
from sparkloom.llm.url_filter import filter_urls


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file: in the folder TOKENIZERS_DIR names, or the installed one."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_table(spark, sf_dir, "documents"))


def _with_loops(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a loop put in where crc32(doc_id as text) is divisible by 10: from a word on, the block of words there again and again."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return words[:first] + (words[first : first + period] * (-(-(n - first) // period)))[: n - first]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(_table(spark, sf_dir, "documents"), rewrite=_with_loops))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(_table(spark, sf_dir, "documents"))


def _with_slips(doc_id: int | None, counts: dict[str, int]) -> dict[str, int]:
    """The counts with a letter left out of words for which 97 divides crc32(doc_id:word)."""
    if doc_id is None:
        return counts
    before, out = zlib.crc32(f"{doc_id}:".encode()), {}
    for word, n in counts.items():
        h = zlib.crc32(word.encode(), before)
        if h % 97 == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
        out[word] = out.get(word, 0) + n
    return out


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(word_counts(_table(spark, sf_dir, "documents"), alter=_with_slips))


QUERIES = {f.__name__: f for f in (op1_neighbours, op2_near_duplicates, op3_token_files, op4_languages, op5_pieces, op6_main_text, op7_url_filter, op8_contamination, op9_repeats, op10_secrets, op11_periodic_runs, op12_shards, op13_spelling_variants)}
SQL: dict[str, str] = {}

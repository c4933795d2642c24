"""Language identification by rank-order profiles of n-grams.

A text is taken as bytes: A-Z in lower case, every run of ASCII characters that are no letters as one space, other bytes
as they are; its n-grams are the runs of 1 to 3 bytes that have no space but at their ends. The RANKS most frequent ones,
in order, are its profile. A language's profile is made the same way from the counts over all its training texts. A text
gets the language with the least out-of-place distance: the sum, over the text's n-grams, of the differences in rank, or
RANKS for an n-gram that the language's profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.marks import fresh
from sparkloom.llm.text_hash import slices, utf8

RANKS = 300
PARTS = 64
UNKNOWN = "und"
_KIND = np.full(256, 32, np.uint8)
_KIND[128:] = np.arange(128, 256)
for _upper in range(65, 91):
    _KIND[_upper] = _KIND[_upper + 32] = _upper + 32


def grams(data: np.ndarray) -> np.ndarray:
    """The n-grams of a text with a space before and after, as numbers: the bytes in base 256."""
    text = np.concatenate([[32], _KIND[data], [32]]).astype(np.uint32)
    space = text == 32
    keep = np.ones(len(text), bool)
    keep[1:] &= ~(space[1:] & space[:-1])
    text = text[keep]
    space = text == 32
    two = text[:-1] << np.uint32(8) | text[1:]
    three = (two[:-1] << np.uint32(8) | text[2:])[~space[1:-1]] if len(text) > 2 else two[:0]
    return np.concatenate([text[~space], two, three])


def _ordered(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The RANKS most frequent names, equal counts by name."""
    if len(names) > RANKS:
        least = np.partition(counts, len(counts) - RANKS)[len(counts) - RANKS]
        names, counts = names[counts >= least], counts[counts >= least]
    return names[np.lexsort((names, -counts))][:RANKS]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): counts over slices of the input, texts of one language together."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for i, j in slices(offsets, 8 << 20):
            for lang in sorted(set(langs[i:j])):
                rows = i + np.flatnonzero(langs[i:j] == lang)
                joined = np.concatenate([x for r in rows.tolist() for x in (data[offsets[r] : offsets[r + 1]], [32])]).astype(np.uint8)
                names, counts = np.unique(grams(joined), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def language_profiles(labelled: DataFrame) -> dict[str, list[int]]:
    """For each lang of ``labelled`` (text, lang) its most frequent n-grams in order, counted over all rows. Rows without text or lang teach nothing."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # first within each of PARTS shares of a language's n-grams, then over RANKS of each, so that no task has all of a language
    first = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))).where(F.col("place") <= RANKS)
    ranked = first(first(counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS))), "lang", "part").drop("place"), "lang")
    out: dict[str, list[int]] = {}
    rows = ranked.select("lang", "gram", "place").collect()  # RANKS rows a language
    for lang, gram, _ in sorted(map(tuple, rows), key=lambda r: (r[0], r[2])):
        out.setdefault(lang, []).append(gram)
    return out


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """``docs`` with lang_pred and score added (with underscores before a name that ``docs`` has, see ``fresh``); only the column text is looked at.

    lang_pred is the language of least distance (the first by name of equals), ``und`` for a null text, one without a
    letter, or when no language is known.  Rows and equal texts are judged alike, an empty table gives an empty one. score is 1 less the distance's share of the greatest possible one, 0 for ``und``.
    """
    names = sorted(profiles)
    known = np.unique(np.array([g for p in profiles.values() for g in p], np.uint32))
    ranks = np.full((len(known) + 1, len(names)), -1, np.int32)
    for k, name in enumerate(names):
        ranks[np.searchsorted(known, np.array(profiles[name], np.uint32)), k] = np.arange(len(profiles[name]))
    guess, sure = fresh(docs, "lang_pred"), fresh(docs, "score")
    schema = docs.withColumns({guess: F.lit(""), sure: F.lit(0.0)}).schema
    letters, last = fresh(docs, "letters"), len(docs.columns)
    asked = docs.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            langs, scores = [], []
            for k, lettered in enumerate(batch.column(last).to_pylist()):
                if not lettered or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                own = _ordered(*np.unique(grams(data[offsets[k] : offsets[k + 1]]), return_counts=True))
                at = np.searchsorted(known, own)
                at[known[np.minimum(at, len(known) - 1)] != own] = len(known)
                theirs = ranks[at]
                away = np.where(theirs < 0, RANKS, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
                best = int(np.argmin(away))
                langs.append(names[best])
                scores.append(float(1 - away[best] / (RANKS * len(own))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return asked.mapInArrow(predict, schema)


def _held_out(df: DataFrame):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> dict[str, list[int]]:
    """Profiles from the documents (doc_id, text, lang) whose crc32(doc_id as text) mod 5 is not 0; a row without doc_id teaches nothing."""
    return language_profiles(docs.where(F.col("doc_id").isNotNull() & ~_held_out(docs)))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    A null doc_id is not held out and teaches nothing; a null text or lang teaches nothing. Rows that repeat are judged
    alike and count each time; of languages at the same distance the first by name is taken, of n-grams as frequent the
    lesser. An empty table gives an empty one, a table without labels ``und`` throughout. Texts are read whole; other columns are not looked at, whatever their names.
    """
    return identify(docs.select("doc_id", _held_out(docs).alias("held_out"), "text"), train(docs)).select("doc_id", "held_out", "lang_pred", "score")

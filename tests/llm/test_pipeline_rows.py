"""The pipeline's decisions hold for rows, also where a doc_id is null or that of several texts."""

from __future__ import annotations

import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

PASSAGE = "one two three four five six seven eight nine ten"
A = " ".join(f"alpha{i}" for i in range(60))
B = " ".join(f"beta{i}" for i in range(60))
SHAPE = "doc_id long, text string, n_chars long"


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_contaminated_rows_go_alone(spark, tmp_path):
    spark.createDataFrame([("i", PASSAGE)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = f"x {PASSAGE} y"
    docs = spark.createDataFrame([(i, t, 1) for i, t in [(1, bad), (1, A), (None, bad), (None, A), (2, bad), (2, bad), (3, B), (3, B), (4, None), (None, None), (5, "")]], SHAPE)
    kept = [(1, A), (None, A), (3, B), (3, B), (4, None), (None, None), (5, "")]
    out = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert rows(out) == sorted(kept, key=repr) and out.columns == docs.columns


def test_each_group_keeps_its_least_row(spark):
    # doc_id 5 is that of A, which stands alone but for 9, and of B, of which 3 is the least
    texts = [(5, A), (9, A + " end"), (5, B), (3, B + " end"), (3, B + " end"), (None, A), (None, B), (7, None), (7, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], SHAPE)
    kept = [(5, A), (3, B + " end"), (None, A), (None, B), (7, None), (7, ""), (None, None)]
    out = corpus_pipeline.one_of_each(spark, docs, "")
    assert rows(out) == sorted(kept, key=repr) and out.columns == docs.columns


def test_the_users_own_columns_stay(spark, tmp_path):
    """Columns named like inner ones, nulls, empty and long texts, ties, repeated rows: through the whole pipeline."""
    inner = ["score", "lang_pred", "letters", "__letters", "key", "goes", "single", "k1", "k2", "place", "piece", "bits", "blob", "n", "words", "spans", "own"]
    long = " ".join(f"word{i} and" for i in range(400_000))
    texts = [(1, A, "en"), (2, A + " end", "en"), (2, A + " end", "en"), (3, B, "de"), (4, None, "en"), (None, B, "de"), (None, None, None), (5, "", "en"), (6, "12 !!", "en"), (7, long, "en"), (8, f"{PASSAGE} {B}", "en"), (9, "token = abcdefgh1234 " + " ".join(f"gamma{i}" for i in range(30)), "en")]
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` double" for c in inner)
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), *([0.77] * len(inner))) for i, t, lang in texts], shape)
    spark.createDataFrame([("i", PASSAGE)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), shape)
        assert now.columns == docs.columns and {tuple(r)[5:] for r in now.collect()} == {(0.77,) * len(inner)}
    kept = rows(now)
    assert [(i, t[:10]) for i, t in kept] == sorted([(1, A[:10]), (3, B[:10]), (None, B[:10]), (7, long[:10]), (9, "[assign] g")], key=repr)
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == len(kept)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_stages_leave_little_in_python_workers(spark, monkeypatch):
    from sparkloom.llm import near_dup, pieces, queries

    path = queries.vocabulary("piece_bpe_32k.model")
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words here", "and some more"])], ["doc_id", "text"])
    table = pieces.piece_table(path)
    kept = pa.Table.from_batches(list(pieces._digests(path, True)(iter([docs]))))
    assert table.words and table.fits
    assert pa.Table.from_batches(list(pieces._digests(path, False)(iter([docs])))) == kept
    assert not (table.words or table.known or table.fits)
    told, plain = [], pieces._digests
    monkeypatch.setattr(pieces, "_digests", lambda model, keep: told.append(keep) or plain(model, keep))
    some = spark.createDataFrame([(1, "some words here"), (2, "some words here")], "doc_id long, text string")
    assert corpus_pipeline.encoded(spark, some, "").count() == 2 and told == [False]
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(name), near_dup.saved
    monkeypatch.setattr(near_dup, "saved", lambda df, n: seen.append(int(spark.conf.get(name))) or write(df, n))
    assert sorted(r.kept for r in near_dup.near_duplicates(some).collect()) == [False, True]
    assert seen and max(seen) <= 1000 and spark.conf.get(name) == before

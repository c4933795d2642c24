"""Suffix arrays by both kinds of scan, and passages with so many texts beside them that their groups are parted."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

repeats = pytest.importorskip("sparkloom.llm.repeats")
from sparkloom.llm import suffix_array as arrays  # noqa: E402


@pytest.mark.parametrize("bucket", [0, 1 << 40])
def test_suffix_arrays_are_the_sorted_suffixes(bucket, monkeypatch):
    monkeypatch.setattr(arrays, "BUCKET", bucket)
    rng = random.Random(3)
    for _ in range(400):
        text = np.array([rng.randint(0, rng.choice([0, 1, 2, 50])) for _ in range(rng.randint(1, 60))])
        assert arrays.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def removed(texts: list[bytes]) -> list[int]:
    counts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append(sum(gone))
    return out


@pytest.mark.parametrize(("hot", "large"), [(3, 500), (3, 1 << 20), (5000, 4 << 20)])
def test_passages_with_different_texts_beside_them(spark, monkeypatch, hot, large):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "LARGE", large)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [word(n) for n in (190, 199, 200, 230)]
    texts = [word(rng.randint(0, 150)) + passages[k % 4] + word(rng.randint(0, 150)) for k in range(80)]
    texts += ["ab" * 300, "ab" * 200, texts[0], texts[0] + "é", word(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect()}
    assert [got[k] for k in range(len(texts))] == removed([t.encode() for t in texts])


def test_tasks_hold_few_texts_at_once(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, plain = spark.conf.get(name), repeats.saved
    monkeypatch.setattr(repeats, "saved", lambda df, n: seen.append(int(spark.conf.get(name))) or plain(df, n))
    texts = [f"{k} " * 150 for k in range(8)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in repeats.remove_repeats(docs).orderBy("doc_id").collect()] == removed([t.encode() for t in texts])
    assert seen and max(seen) <= 1000 and spark.conf.get(name) == before
    n = 1200
    rows = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["some text"] * n), pa.nulls(n)], ["doc_id", "text", "spans"])
    out = list(repeats._removed(iter([rows])))
    assert max(len(b) for b in out) <= 500 and pa.Table.from_batches(out)["doc_id"].to_pylist() == list(range(n))


def test_runs_are_the_same_by_any_number_of_texts_at_once(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 900))) for _ in range(300)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([0] * 300), pa.array(texts + [], pa.string())], ["doc", "tie", "text"])
    whole = pa.Table.from_batches(list(repeats._run_rows(iter([rows]))))
    monkeypatch.setattr(repeats, "TEXTS", 2000)
    assert pa.Table.from_batches(list(repeats._run_rows(iter([rows])))).to_pylist() == whole.to_pylist()

"""Shards against their law: bytes as near equal as the rows allow, slots without gaps, all rows once."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

queries = pytest.importorskip("sparkloom.llm.queries")
from sparkloom.llm import shards  # noqa: E402
from sparkloom.llm.shards import byte_shards, write_shards  # noqa: E402

from .test_against_brute_force import SF_DIR  # noqa: E402


def balanced(rows, n, tolerance=shards.TOLERANCE):
    """Each border is as near to its share as the tolerance says, or is the nearest that rows allow."""
    total, at = sum(r["size"] for r in rows), 0
    sizes, largest = Counter(), max((r["size"] for r in rows), default=0)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    for k in range(n - 1):
        at += sizes[k]
        assert abs(at - (k + 1) * total / n) <= max(tolerance * total / n, largest / 2) + 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= k < n for k in slots)
    return sizes


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = [r.asDict() for r in queries.op12_shards(spark, SF_DIR).collect()]
    assert len(got) == len(texts) and {r["doc_id"] for r in got} == texts.keys()
    for r in got:
        text = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None)
    balanced(got, 16)


def test_many_equal_rows_are_parted_only_where_they_must(spark, monkeypatch):
    monkeypatch.setattr(shards, "PIECE_ROWS", 100)
    texts = [(i, f"text {i} " * (i % 7)) for i in range(3000)] + [(i, "one text of a third of all rows") for i in range(3000, 4500)] + [(None, "the same row")] * 600 + [(i, f"pair {i // 2}") for i in range(5000, 5400)]
    got = [r.asDict() for r in byte_shards(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), 16).collect()]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t) + 1) for i, t in texts)
    sizes = balanced(got, 16)
    assert max(sizes.values()) <= 1.02 * min(sizes.values())
    parted = defaultdict(set)
    for r in got:
        parted[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in parted.values()) < 16


def test_edges(spark, tmp_path):
    rows = [(1, None), (None, None), (2, ""), (2, ""), (3, "ü" * 50_000), (4, "x"), (None, "y")]
    docs = spark.createDataFrame([(i, t, "s", 9, 1, 2) for i, t in rows], "doc_id long, text string, shard string, size int, k1 int, part int")
    got = [r.asDict() for r in byte_shards(docs, 16, carry=tuple(docs.columns)).collect()]
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 1), (0, 2), (1, 1), (2, 1), (2, 1), (3, 100_001), (4, 2)]
    assert all((r["carried"].doc_id, r["carried"].shard, r["carried"]["size"]) == (r["doc_id"], "s", 9) for r in got)
    balanced(got, 16)
    assert byte_shards(docs.limit(0)).collect() == []
    balanced([r.asDict() for r in byte_shards(docs, 1).collect()], 1)
    write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and set(back.columns) == {*docs.columns, "_shard"}

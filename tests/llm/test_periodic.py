"""Runs of words against a plain search over all periods, whole tables against the contract, and hostile texts."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import pyarrow.parquet as pq
import pytest

queries = pytest.importorskip("sparkloom.llm.queries")
from sparkloom.llm.periodic import periodic_runs, sequence_runs, word_runs  # noqa: E402

from .test_against_brute_force import SF_DIR  # noqa: E402


def plain_runs(w, least=24, periods=3):
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        x = 0
        while x < n - q:
            if w[x] != w[x + q]:
                x += 1
                continue
            s = x
            while x < n - q and w[x] == w[x + q]:
                x += 1
            length = x - s + q
            if length >= max(least, periods * q) and not any(w[s : s + length - p] == w[s + p : s + length] for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [1, 6, 24])
def test_small_alphabets(least):
    rng = random.Random(least)
    for _ in range(700):
        letters, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 70)
        w = [rng.randrange(letters) for _ in range(n)]
        if n > 5 and rng.random() < 0.7:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert word_runs([str(x).encode() for x in w], least) == plain_runs(w, least)


def test_every_place_of_every_fibonacci_run():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert sequence_runs(b, 3) == plain_runs(b, 3)


def test_whole_table(spark):
    rows = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    looped = 0
    for d in rows:
        words = (d["text"] or "").encode().split()
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words) if n < 3000 else word_runs(words)
        looped += bool(runs)
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in dropped)))
    assert looped > 3


def test_edges(spark):
    block = [f"w{i}" for i in range(9)]
    long = " ".join(block * 20_000)  # a space that is not ASCII parts no words
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 30), (None, "a " * 30), (5, long), (6, "b a\u00a0a " * 24 + "Z"), (7, "A a " * 12), (7, "x")]
    docs = spark.createDataFrame([(i, t, "r", 0) for i, t in rows], "doc_id long, text string, runs string, collapsed int")
    found = periodic_runs(docs)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=repr)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 30, [(0, 30, 1)], "a"), (None, 30, [(0, 30, 1)], "a"), (5, 180_000, [(0, 180_000, 9)], " ".join(block))]
    want += [(6, 49, [(0, 48, 2)], "b a\u00a0a Z"), (7, 24, [(0, 24, 2)], "A a"), (7, 1, [], "x")]
    assert got == sorted(want, key=repr)
    assert periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(docs, periods=2)


def test_time_grows_with_the_length():
    began = time.perf_counter()
    assert word_runs([b"a"] * 300_000) == [(0, 300_000, 1)]
    a, b = "a", "ab"
    while len(b) < 100_000:
        a, b = b, b + a
    word_runs([c.encode() for c in b])
    assert time.perf_counter() - began < 60

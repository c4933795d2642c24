"""Spelling variants against all single edits of every word, over a whole table and over words of few letters."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

queries = pytest.importorskip("sparkloom.llm.queries")
from sparkloom.llm import spelling  # noqa: E402
from sparkloom.llm.spelling import Trie, spelling_groups, word_counts  # noqa: E402

from .test_against_brute_force import SF_DIR, lower  # noqa: E402


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    """{word: (form, root, n, n_near, form_n)} by comparing all words that share a form with one letter left out."""
    meet = defaultdict(set)
    for w in words:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            meet[k].add(w)
    near = defaultdict(set)
    for group in meet.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def rows(df):
    return {r.word: tuple(r)[1:] for r in df.collect()}


def test_tries_find_what_one_edit_makes():
    rng = random.Random(1)
    for _ in range(400):
        letters = rng.choice(["ab", "abc", "abcdeé"])
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 60))})
        trie = Trie(words, list(range(1, len(words) + 1)))
        for w in [*words, "".join(rng.choice(letters) for _ in range(5))]:
            assert sorted(trie.near(w)) == [(v, i + 1) for i, v in enumerate(words) if one_edit(w, v)]


def test_whole_table(spark):
    counts = Counter()
    for d in pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        for w in re.findall("[A-Za-zÀ-ÿ]+", d["text"] or ""):
            w = lower(w)
            h = zlib.crc32(f"{d['doc_id']}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    want = plain({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    got = rows(queries.op13_spelling_variants(spark, SF_DIR))
    assert got == want and any(v[0] for v in want.values())


def test_many_small_shards_and_passes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 40)
    monkeypatch.setattr(spelling, "PASS_WORDS", 90)
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 7))): rng.choice([3, 3, 4, 7, 20, 50]) for _ in range(500)}
    got = rows(spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    want = plain(words)
    assert got == want and any(v[0] and v[0] != v[1] for v in want.values())


def test_edges(spark):
    long = "a" * 300_000
    texts = [(1, None), (2, ""), (3, "12 ... --"), (None, "Grüße GRüßE grüße grüßee"), (None, "grüßee grüßee"), (4, f"{long} {long} {long} {long}b {long}b {long}b"), (4, "x×y÷z " * 6), (4, "x×y÷z")]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    got = rows(spelling_groups(word_counts(docs)))
    u = "grüße"
    assert got == {u: (None, u, 3, 1, None), u + "e": (None, u + "e", 3, 1, None), long: (None, long, 3, 1, None), long + "b": (None, long + "b", 3, 1, None), "x×y÷z": (None, "x×y÷z", 7, 0, None)}
    assert spelling_groups(word_counts(docs.limit(0))).collect() == []
    # ties go to the first by code points, chains to the last form; repeated and null words
    counts = [("aaaaa", 3), ("aaaab", 6), ("aaaac", 6), ("aaabc", 24), ("aabbc", 40), ("aabbc", 10), (None, 9), ("zzzzz", 5)]
    got = rows(spelling_groups(spark.createDataFrame([(w, n, w) for w, n in counts], "word string, n int, form string")))
    assert got["aaaaa"] == ("aaaab", "aaaab", 3, 2, 6) and got["aaaac"] == ("aaabc", "aabbc", 6, 3, 24) and got["zzzzz"] == (None, "zzzzz", 5, 0, None) and len(got) == 6
    with pytest.raises(ValueError):
        spelling_groups(word_counts(docs), ratio=1)

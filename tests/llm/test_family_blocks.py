"""A family of edited copies whose similarities lie on both sides of the threshold, compared in many small blocks."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

near_dup = pytest.importorskip("sparkloom.llm.near_dup")


def family(seed: int, n: int, most: int) -> list[str]:
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    out = []
    for k in range(n):
        words = list(base)
        for place in rng.sample(range(len(words)), rng.randrange(most + 1)):
            words[place] = f"e{k}x{place}"
        out.append(" ".join(words))
    return out


def shingles(text: str) -> set[tuple[str, ...]]:
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(sets: list[set]) -> list[int]:
    own = list(range(len(sets)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            low, high = sorted((root(i), root(j)))
            own[high] = low
    return [root(i) for i in range(len(sets))]


def test_family_on_both_sides_of_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 2048)
    texts = family(1, 120, 9) + family(2, 40, 14)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    want = components([shingles(t) for t in texts])
    assert [got[i] for i in range(len(texts))] == want
    assert 3 < len(set(want)) < len(texts) - 20


def test_common_counts_across_parts():
    rng = np.random.default_rng(3)
    sides = [[np.unique(rng.integers(-9000, 9000, 6000)) for _ in range(4)] for _ in range(2)]
    want = [[len(np.intersect1d(x, y)) for y in sides[1]] for x in sides[0]]
    assert near_dup._common(*sides).tolist() == want


def test_a_task_returns_links_that_join_components():
    sets = [np.arange(100), np.arange(100), np.arange(5, 105), np.arange(60, 160)]
    sigs = np.zeros((4, near_dup.COORDINATES), np.int32)
    table = pa.table({"rep": [1, 2, 3, 4], "component": [1, 1, 3, 4], "n": [100] * 4, "left": [True] * 4, "right": [True] * 4, "shingles": [s.tolist() for s in sets], "sig": [s.tolist() for s in sigs]}, pa.schema({"rep": pa.int64(), "component": pa.int64(), "n": pa.int64(), "left": pa.bool_(), "right": pa.bool_(), "shingles": pa.list_(pa.int64()), "sig": pa.list_(pa.int32())}))
    assert near_dup._block_links(table).to_pylist() == [{"a": 1, "b": 3}]

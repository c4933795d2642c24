"""Kernels on small hand-written inputs: walks that meet, break or run in rings, blocks that do not fill, and the text sources and sinks."""

from __future__ import annotations

import numpy as np
import pytest

from sparkloom.operators import assembly, blocks, matrix
from sparkloom.scratch import saved
from sparkloom.sources import files

K = 4


def chain(text: str) -> list[tuple[str, str, str]]:
    """The k-mers of a sequence, the first without one before and the last without one after."""
    n = len(text) - K + 1
    return [(text[p : p + K], text[p - 1] if p else "F", text[p + K] if p + 1 < n else "F") for p in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "kmer string, b_ext string, f_ext string")


def test_walks_that_meet_each_give_a_contig(spark):
    # the second start runs into the middle of the first chain
    rows = [*chain("AACCGGTTAC"), ("TTCC", "F", "G"), ("GACA", "F", "F"), ("GACA", "F", "F")]
    rows += [("TCCG", "T", "G")]
    got = {(r.contig, r.n_nodes) for r in assembly.contigs(frame(spark, rows), K).collect()}
    assert got == {("AACCGGTTAC", 7), ("TTCCGGTTAC", 7), ("GACA", 1)}
    assert [tuple(r) for r in assembly.repeated(frame(spark, rows)).collect()] == [("GACA", 2)]
    assert tuple(assembly.stats(assembly.contigs(frame(spark, rows), K)).first()) == (3, 15)


def test_broken_walks_are_told(spark):
    ring = [("ACGT", "T", "A"), ("CGTA", "A", "C"), ("GTAC", "C", "G"), ("TACG", "G", "T")]
    rows = [*chain("TTTTGGGG")[:3], *ring, ("CACG", "F", "T")]
    kmers = frame(spark, rows)
    assert assembly.contigs(kmers, K).collect() == []
    # one runs out at a missing k-mer, the other into the ring at ACGT
    found = {r.contig[:8]: r.next for r in assembly.broken(kmers, K).collect()}
    assert found["TTTTGGG"] == "TGGG" and found["CACGTACG"] == "ACGT" and len(found) == 2
    # a ring that no start leads to has no walk
    assert assembly.walks(frame(spark, ring), K).collect() == []
    assert assembly.walks(frame(spark, []), K).collect() == []


def sequence(k, n, seed):
    """A text of n letters in which no k-mer occurs twice."""
    rng = np.random.default_rng(seed)
    text = "".join("ACGT"[i] for i in rng.integers(0, 4, k))
    seen = {text}
    while len(text) < n:
        nxt = text[-k + 1 :] + "ACGT"[rng.integers(4)]
        if nxt not in seen:
            seen.add(nxt)
            text += nxt[-1]
    return text, seen


def test_a_long_chain(spark):
    k = 12
    text, _ = sequence(k, 700, 1)
    n = len(text) - k + 1
    rows = [(text[p : p + k], text[p - 1] if p else "F", text[p + k] if p + 1 < n else "F") for p in range(n)]
    assert [tuple(r) for r in assembly.contigs(frame(spark, rows), k).collect()] == [(text, n)]
    chunks = sorted((r.chunk, r.text) for r in assembly.contig_chunks(frame(spark, [*rows, ("A" * k, "F", "F")]), k, 50).where(f"start = '{text[:k]}' and n_nodes = {n}").collect())
    assert chunks == [(c, text[50 * c : 50 * c + 50]) for c in range(14)]
    with pytest.raises(ValueError):
        assembly.contig_chunks(frame(spark, rows), k, k)


def test_a_comb_takes_a_logarithm_of_rounds(spark):
    k, teeth = 12, 1000
    text, seen = sequence(k, k + teeth + 2, 2)
    n = len(text) - k + 1
    rows = [(text[p : p + k], text[p - 1] if p else "F", text[p + k] if p + 1 < n else "F") for p in range(n)]
    want = {text}
    for p in range(1, teeth + 1):
        tooth = next(c for c in "ACGT" if c + text[p : p + k - 1] not in seen)
        seen.add(tooth + text[p : p + k - 1])
        rows.append((tooth + text[p : p + k - 1], "F", text[p + k - 1]))
        want.add(tooth + text[p:])
    found = assembly.Walks(frame(spark, rows), k)
    got = found.texts().collect()
    assert found.rounds <= 12 and {r.contig for r in got} == want and len(got) == teeth + 1
    assert all(r.ended and r.n_nodes == len(r.contig) - k + 1 for r in got)
    found.drop()


def test_a_built_table_is_not_shuffled_again(spark):
    from sparkloom.operators.lookup import BuiltTable

    keep = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = BuiltTable(spark.range(1000).selectExpr("id as key", "id * id as square"), "key")
        for asked in (spark.range(5).selectExpr("id * 300 as n"), spark.range(3).selectExpr("id * 2 as n")):
            out = table.found(asked, "n")
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Exchange" not in plan[plan.index("Scan parquet") :]
            assert {r.n: r.square for r in out.collect()} == {r.n: r.n**2 if r.n < 1000 else None for r in asked.collect()}
        table.drop()
        assert not spark.catalog.tableExists(table.name)
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def cells(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j long, v double")


def dense(df, shape):
    got = np.full(shape, np.nan)
    for r in df.collect():
        got[r.i, r.j] = r.v
    return got


@pytest.mark.parametrize(("shape", "outer", "panel"), [((5, 7, 3), 1, 1), ((1, 1, 1), 2, 2), ((4, 8, 4), 1, 8), ((21, 50, 17), 2, 3)])
def test_blocks_of_a_side_that_does_not_divide(spark, shape, outer, panel):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal(shape[:2]), rng.standard_normal(shape[1:])
    assert np.allclose(dense(blocks.product(cells(spark, a), cells(spark, b), 4, outer, panel), (shape[0], shape[2])), a @ b)


def test_sums_of_many_panels_go_up_a_tree(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 3)
    rng = np.random.default_rng(5)
    a, b, c = rng.standard_normal((5, 90)), rng.standard_normal((90, 6)), rng.standard_normal((5, 6))
    x, y, z = (saved(blocks.blocks(cells(spark, m), 3), "blocks") for m in (a, b, c))
    out = blocks.gemm(x, y, z, -2.5, 3, 1, 2)
    assert out.count() == 4 and np.allclose(dense(blocks.cells(out, 5, 6, 3), (5, 6)), c - 2.5 * a @ b)
    # blocks that are missing are zeros, an empty factor gives nothing
    a[:3] = 0
    x = saved(blocks.blocks(cells(spark, a).where("v <> 0"), 3), "blocks")
    assert np.allclose(np.nan_to_num(dense(blocks.cells(blocks.gemm(x, y, side=3, outer=1, panel=2), 5, 6, 3), (5, 6))), a @ b)
    assert blocks.gemm(x.limit(0), y, side=3).collect() == []


def test_a_wrong_product_is_told(spark):
    a = np.arange(12.0).reshape(3, 4)
    right = a @ a.T
    wrong = right.copy()
    wrong[1, 2] += 1e-6
    told = lambda c: tuple(matrix.verify(cells(spark, c), cells(spark, a), cells(spark, a.T), 4, 2).first())
    assert told(right) == (9, 0, True) and told(wrong) == (9, 1, False)


@pytest.mark.parametrize("k", [3, 4, 31, 32, 51])
def test_lookups_are_not_broadcast_and_keep_odd_rows(spark, k):
    text = sequence(k, k + 20, 6)[0] if k > 4 else "ACGTTGCAACG"
    rows = [(text[p : p + k], "F", text[p + k] if p + k < len(text) else "F") for p in range(len(text) - k + 1)]
    rows += [("N" + text[: k - 1], "F", text[k - 1]), ("", "F", "A"), ("A", "F", "C"), (text[:k], "F", "T"), (text + "N", "F", "G"), (text[1 : k + 1], "F", None), ("A" * k, "F", ""), ("T" * k, "F", "N")]
    follow = lambda r: r[0][1:k] + r[2]
    want = []
    for r in rows:
        if r[2] not in (None, "F"):
            found = [s[2] for s in rows if s[0] == follow(r)] or [None]
            want += [(r[0], follow(r), f) for f in found]
    out = assembly.lookup(frame(spark, rows), k)
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))
    two = []
    for r in rows:
        one = follow(r) if r[2] not in (None, "F") else None
        for f in [s[2] for s in rows if one is not None and s[0] == one] or [None]:
            second = one[1:k] + f if f not in (None, "F") else None
            two += [(r[0], one, f, second, g) for g in [s[2] for s in rows if second is not None and s[0] == second] or [None]]
    assert sorted(map(repr, (tuple(r) for r in assembly.next_two(frame(spark, rows), k).collect()))) == sorted(map(repr, two))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "Broadcast" not in assembly.lookup(frame(spark, rows), k)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def walked(rows, k):
    """(contig, n_nodes, next) of every start, step by step."""
    best = {}
    for kmer, _, f in rows:
        best[kmer] = min(f, best.get(kmer, f))
    out = []
    for y, f in {(r[0], r[2]) for r in rows if r[1] == "F"}:
        text, n, seen, x = y, 1, set(), None
        while f != "F":
            text, x = text + f, y[1:k] + f
            if x not in best or x in seen:
                break
            seen.add(x)
            y, f, n, x = x, best[x], n + 1, None
        out.append((text, n, x))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "most", "held"), [(1, 100, 40), (4, 3, 40), (6, 1000, 60), (12, 5, 60)])
def test_walks_over_many_tasks(spark, monkeypatch, k, most, held):
    monkeypatch.setattr(assembly, "HELD", held)
    rng = np.random.default_rng(k + most)
    rows = []
    for _ in range(25):
        text = "".join("ACGT"[i] for i in rng.integers(0, 4, k + 11))
        own = [(text[p : p + k], text[p - 1] if p else "F", text[p + k] if p < 11 else "F") for p in range(12)]
        rows += [r for r in own if rng.random() > 0.02] + own[:3]
    rows += [("A" * k, "F", "A"), ("N" + "C" * (k - 1), "F", "N"), ("G" * (k + 2), "F", "C"), ("", "F", "A"), ("T" * k, "F", "F"), ("T" * k, "F", "G"), ("C" * k, "F", "GG")]
    found = assembly.Walks(frame(spark, rows).repartition(3), k, most)
    assert sorted(((r.contig, r.n_nodes, r.next) for r in found.texts().collect()), key=repr) == walked(rows, k)
    found.drop()


def test_kmers_are_shuffled_once_to_be_put_together(spark):
    rows = chain("AACCGGTTACGATTACA")
    plan = assembly._fragments(frame(spark, rows), K, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_a_product_of_one_panel_is_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(blocks, "saved", lambda df, name: written.append(name) or saved(df, name))
    a, b = np.arange(12.0).reshape(3, 4), np.arange(20.0).reshape(4, 5)
    out = blocks.product(cells(spark, a), cells(spark, b), 2, 1, 2)
    assert np.allclose(dense(out, (3, 5)), a @ b) and written == ["blocks", "blocks"]
    assert np.allclose(dense(blocks.product(cells(spark, a), cells(spark, b), 2, 1, 1), (3, 5)), a @ b) and written[-1] == "product"


@pytest.mark.parametrize("strip", [1, 400, 1 << 20])
def test_strips_of_tiles_are_dealt_where_one_panel_is_deep_enough(spark, monkeypatch, strip):
    monkeypatch.setattr(blocks, "STRIP", strip)
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((43, 5)), rng.standard_normal((9, 38))
    a[7:13] = b[:, :11] = 0
    a[20, 4] = a[30:, 2:4] = 0  # tiles that have other blocks
    x, y = (saved(blocks.blocks(cells(spark, m).where("v <> 0"), 2), "blocks") for m in (a, b))
    out = blocks.gemm(x, y, alpha=3.0, side=2, outer=2, panel=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # blocks were copied for each tile of the other side: work that grew with the square of the rows
    assert "FlatMapCoGroups" not in plan and plan.count("Exchange") == 1
    assert np.allclose(np.nan_to_num(dense(blocks.cells(out, 43, 38, 2), (43, 38))), 3 * a @ b[:5])
    assert out.groupBy("bi", "bj").count().where("count > 1").count() == 0
    assert blocks.gemm(x.limit(0), y, side=2, outer=2, panel=3).collect() == []


@pytest.mark.parametrize(("k", "held"), [(1, 5), (5, 9), (12, 30), (31, 40)])
def test_two_steps_ahead_take_one_shuffle_of_short_texts(spark, monkeypatch, k, held):
    monkeypatch.setattr(assembly, "HELD", held)
    rng = np.random.default_rng(k)
    rows = []
    for _ in range(20):
        text = "".join("ACGT"[i] for i in rng.integers(0, 4, k + 11))
        own = [(text[p : p + k], "F", text[p + k] if p < 11 else "F") for p in range(12)]
        rows += [r for r in own if rng.random() > 0.03] + own[4:6]
    rows += [("A" * k, "F", "A"), (rows[0][0], "F", "GT"), (rows[1][0] + "C", "F", "G"), (rows[2][0], "F", None)]
    by = {}
    for kmer, _, f in rows:
        by.setdefault(kmer, []).append(f)
    want = []
    for y, _, f in rows:
        x = None if f in (None, "F") else y[1:k] + f
        for g in by.get(x, [None]) if x else [None]:
            z = None if x is None or g in (None, "F") else x[1:k] + g
            want += [(y, x, g, z, h) for h in (by.get(z, [None]) if z else [None])]
    out = assembly.next_two(frame(spark, rows), k)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))

"""Forces where cells are crowded, running sums over any order, k-mers judged as they are written."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import assembly, partition, spatial
from sparkloom.operators.prefix import running_sums
from sparkloom.params import SimParams
from sparkloom.plans import catalogue
from sparkloom.sources import fixtures

P = SimParams()


def test_crowded_cells(spark):
    rng = np.random.default_rng(3)
    n, size = 1200, 0.2
    at = rng.uniform(0, size, (n, 2))
    at[: n // 2] = rng.uniform(0, P.cell, (n // 2, 2))  # half of all in one cell
    at[:50] = at[0]  # and some at one place
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    want = {r.id: (r.ax, r.ay) for r in spatial.forces_binned(p, size, P).collect()}
    got = {r.id: (r.ax, r.ay) for r in spatial.forces_dense(p, size, P, 40).collect()}
    strips = {r.id: (r.ax, r.ay) for r in spatial.forces_strips(p, P).collect()}
    brute = {r.id: (r.ax, r.ay) for r in spatial.forces_brute(p, P).collect()}
    assert len(got) == n
    for other in (got, strips, brute):
        assert all(np.allclose(other[i], want[i], rtol=1e-9, atol=1e-3) for i in want)
    binned = spatial.with_cells(p, size, P)
    looking, inside = spatial.looks(binned, spatial.split_cells(binned, 40))
    groups = [r["count"] for r in looking.groupBy("bx", "by", "part").count().join(inside.select("bx", "by", "part").distinct(), ["bx", "by", "part"]).collect()]
    assert max(groups) <= 2 * 40 and inside.count() < n * (n // 40)
    assert spatial.forces_dense(p.limit(0), size, P).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums(spark, parts):
    rows = [(k, k % 5, None if k % 11 == 0 else k - 30) for k in range(200)] + [(500, 3, 1)] * 300  # one key has most rows
    df = spark.createDataFrame(rows, "id long, k int, v long").repartition(5)
    out = running_sums(df, ["k", "id"], "v", parts)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in out.select("k", "id", "upto", "before").collect())
    total, want = 0, []
    for i, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        want.append((k, i, total + (v or 0), total))
        total += v or 0
    assert got == sorted(want)
    assert running_sums(df.limit(0), ["k"], "v").collect() == []


def test_rejects_are_counted_as_rows_are_written(spark):
    rows = [("ACGT", "F", "A"), ("CGTA", "A", "F"), ("ACG", "F", "A"), ("ACGN", "F", "A"), ("ACGG", "X", "A")]
    kmers = spark.createDataFrame(rows, "kmer string, b_ext string, f_ext string")
    kept, told = assembly.valid(kmers, 4, 0.6)
    assert sorted(map(tuple, kept.collect())) == rows[:2] and told == {"length": 1, "letter": 1, "extension": 1}
    assert told == {r.reason: r.n for r in assembly.faults(kmers, 4).collect()}
    with pytest.raises(ValueError, match="of 5 k-mers"):
        assembly.valid(kmers, 4)
    assert assembly.valid(kmers.where(F.length("kmer") == 0), 4)[1] == {}


def test_places_of_large_ids(spark, tmp_path):
    ids = [*range(-102, 21), -500_001, 499_999, 772_000, 6_000_000, 36_000_000, -36_000_000, 10**12, 2**63 - 1, -(2**63)]
    spark.createDataFrame([(e,) for e in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    p, size = fixtures.particles(spark, str(tmp_path))
    rest = lambda a, m: a % m if a >= 0 else -(-a % m)
    want = {e: (rest(e * e * 7919 + e * 104729, 1000003) * size / 1000003.0, rest(e * e * 15485863 + e * 32452843, 999983) * size / 999983.0, (rest(e * 48271, 2001) - 1000) / 1000.0, (rest(e * 69621, 2001) - 1000) / 1000.0) for e in ids}
    assert {r.id: (r.x, r.y, r.vx, r.vy) for r in p.collect()} == want


def test_kmers_are_judged_once(spark):
    kmers = spark.createDataFrame([("ACG\n", "F", "A"), ("ACGT", "F", "A"), ("ACGT", "A\n", "A"), (None, "F", "A"), ("AC", None, None)], "kmer string, b_ext string, f_ext string")
    out = assembly.faults(kmers, 4)
    assert sorted(map(tuple, out.collect())) == [("extension", 1), ("length", 1), ("letter", 1)]
    assert "RLIKE" not in "".join(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines(True) if "Filter" in line)
    assert assembly.faults(kmers.limit(0), 4).collect() == []


@pytest.mark.parametrize("name", ["migration_matrix", "send_displacements", "cell_changes"])
def test_moves_are_not_computed_twice(spark, name):
    out = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # a filter with the whole formula of a place grew past what Spark can compile
    assert not [line for line in plan.splitlines() if "Filter" in line and "isnotnull" in line and len(line) > 300]


def test_sent_has_zeros(spark):
    routes = spark.createDataFrame([("migrate", 0, 1), ("migrate", 0, 1), ("local", 1, 1), ("stay", 0, 0)], "route string, old_rank long, new_rank long")
    assert sorted(map(tuple, partition.sent(routes, 2).collect())) == [(0, 0, 0), (0, 1, 2), (1, 0, 0), (1, 1, 0)]
    assert sorted(map(tuple, partition.sent(routes.limit(0), 2).collect())) == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0)]

"""Forces in cells whose pairs are too many to be rows."""

from __future__ import annotations

import numpy as np
import pytest

from sparkloom.operators import crowds, spatial
from sparkloom.params import SimParams

P = SimParams()


def brute(x, y):
    dx, dy = x - x[:, None], y - y[:, None]
    r2 = dx * dx + dy * dy
    held = np.maximum(r2, P.min_r**2)
    coef = np.where(r2 <= P.cutoff**2, (1 - P.cutoff / np.sqrt(held)) / held / P.mass, 0.0)
    return (coef * dx).sum(1), (coef * dy).sum(1)


@pytest.mark.parametrize("n", [1, 255, 256, 700, 3000])
def test_tiles_give_the_sums_over_all_pairs(n):
    rng = np.random.default_rng(n)
    x, y = rng.uniform(0, P.cell, (2, n))
    x[: n // 20], y[: n // 20] = x[0], y[0]  # some at one place
    want = np.stack(brute(x, y))
    one = crowds._Part(np.arange(n), x, y)
    crowds._push(one, one, True, P)
    h = n // 3
    a, b = crowds._Part(np.arange(h), x[:h], y[:h]), crowds._Part(np.arange(h, n), x[h:], y[h:])
    for pair in ((a, a), (b, b), (a, b)):
        crowds._push(*pair, True, P)
    for parts in ((one,), (a, b)):
        got = np.full((2, n), np.nan)
        for p in parts:
            got[:, p.ids] = p.fx / P.mass, p.fy / P.mass
        assert np.allclose(got, want, rtol=1e-12, atol=1e-5)
    before = a.fx.copy(), b.fx.copy()
    crowds._push(a, b, False, P)
    assert (b.fx == before[1]).all() and (h == 0 or (a.fx != before[0]).any())


def test_every_two_parts_in_reach_meet_once():
    counts = [(5, 6, sx, sy, 150_000 if sx == sy == 0 else 10) for sx in range(4) for sy in range(4)]
    deal, n_groups = crowds._dealt(counts, {(5, 6): 70_000}, {(5, 6): 4}, P)
    groups = {}
    for *cell, sx, sy, pieces, piece, group, left in deal:
        assert cell == [5, 6] and -pieces <= piece < pieces
        groups.setdefault(group, []).append((left, sx, sy, piece))
    met = [tuple(sorted(g)) for g in groups.values()]
    assert len(set(met)) == n_groups == max(groups) + 1 and all(len(g) in (1, 2) for g in met)
    parts = {(r[2], r[3], r[5]) for r in deal if r[2] >= 0}
    assert len(parts) == 18  # one subcell in three pieces
    assert sum(g[-1][1] < 0 for g in met) == 2 * len(parts)  # two pieces look in
    gap = lambda p, q: np.hypot(*[max(0, abs(p[c] - q[c]) - 1) for c in (0, 1)]) * P.cell / 4
    assert sum(g[-1][1] >= 0 for g in met) == sum(gap(p, q) <= P.cutoff for p in parts for q in parts if p <= q) < 18 * 19 // 2


def test_pairs_of_a_crowded_cell_are_no_rows(spark, monkeypatch):
    monkeypatch.setattr(crowds, "LEAST_PART", 60)
    monkeypatch.setattr(crowds, "PART", 100)
    monkeypatch.setattr(crowds, "TASKS", 30)  # fewer than groups
    rng = np.random.default_rng(8)
    n, size = 2400, 0.2
    at = rng.uniform(0, size, (n, 2))
    at[: n // 3] = rng.uniform(3 * P.cell, 4 * P.cell, (n // 3, 2))
    at[n // 3 : n // 2] = rng.uniform(3 * P.cell, 5 * P.cell, (n // 2 - n // 3, 2))  # crowds beside each other
    at[:150] = at[0]  # more than a piece at one place
    p = spark.createDataFrame([(i - 5, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    want = {r.id: (r.ax, r.ay) for r in spatial.forces_binned(p, size, P).collect()}
    out = spatial.forces_dense(p, size, P, 40)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (r.ax, r.ay) for r in out.collect()}
    assert len(got) == n and all(np.allclose(got[i], want[i], rtol=1e-9, atol=1e-3) for i in want)
    binned = spatial.with_cells(p, size, P)
    looking, inside = spatial.looks(binned, spatial.split_cells(binned, 40), False)
    assert inside.where("bx = 3 and by = 3").count() == looking.where("bx = 3 and by = 3").count() == 0

"""Forces among the particles of crowded cells: blocks of particles meet in tasks, and no pair is ever a row.

A crowded cell is cut into parts of bounded size that lie together, and each two parts within the cutoff of each other are one
group, which is one task's: both sides get what it finds, so a pair is computed once. Particles of the cells around that
look into a crowded cell are parts too, met by each of its own. A task cuts its two parts into tiles and passes over those that are too far.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.params import SimParams

#: Particles of a tile; the fewest and the most that a part is meant to have.
TILE, LEAST_PART, PART = 256, 1 << 14, 1 << 16
#: Tasks at most; beyond that a task gets several groups, one after the other.
TASKS = 10_000
#: Tiles at least this share of the cutoff apart are compared by products of matrices.
FAR = 0.1
DEAL = "bx long, by long, sx long, sy long, pieces int, piece int, group int, left boolean"


class _Part:
    """Particles in tiles of TILE that lie together, in order of their tiles."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray):
        n = len(x)
        strip = TILE * max(1, ceil((n / TILE) ** 0.5))
        order = np.argsort(x, kind="stable")
        for s in range(0, n, strip):
            own = order[s : s + strip]
            order[s : s + strip] = own[np.argsort(y[own], kind="stable")]
        self.ids, self.x, self.y = ids[order], x[order], y[order]
        self.fx, self.fy = np.zeros(n), np.zeros(n)
        self.tiles = [slice(s, min(n, s + TILE)) for s in range(0, n, TILE)]
        at = np.arange(0, n, TILE)
        self.low = [np.minimum.reduceat(c, at) for c in (self.x, self.y)]
        self.high = [np.maximum.reduceat(c, at) for c in (self.x, self.y)]


def _near(a: _Part, s: slice, b: _Part, t: slice, both: bool, params: SimParams) -> None:
    """Adds to tile s of a, and to tile t of b if ``both``, what they do to each other."""
    dx, dy = np.subtract.outer(b.x[t], a.x[s]).T, np.subtract.outer(b.y[t], a.y[s]).T
    r2 = np.maximum(dx * dx + dy * dy, params.min_r * params.min_r)
    r = np.sqrt(r2)
    # beyond the cutoff the push is 0, as it is at the cutoff
    coef = (np.minimum(r, params.cutoff) - params.cutoff) / (r2 * r)
    for d, fa, fb in ((dx, a.fx, b.fx), (dy, a.fy, b.fy)):
        d *= coef
        fa[s] += d.sum(1)
        if both:
            fb[t] -= d.sum(0)


def _push(a: _Part, b: _Part, both: bool, params: SimParams) -> None:
    """Adds to a's particles the pushes by b's, and the other way if ``both``; a may be b, whose pairs are then taken once. Sums are without the mass."""
    cutoff = params.cutoff
    held = np.empty((TILE, TILE)), np.empty((TILE, TILE))
    for i, s in enumerate(a.tiles):
        first = i if a is b else 0
        gap = [np.maximum(np.maximum(b.low[c][first:] - a.high[c][i], a.low[c][i] - b.high[c][first:]), 0) for c in (0, 1)]
        span = [np.maximum(b.high[c][first:] - a.low[c][i], a.high[c][i] - b.low[c][first:]) for c in (0, 1)]
        least, most = np.hypot(*gap), np.hypot(*span)
        centre = [(a.low[c][i] + a.high[c][i]) / 2 for c in (0, 1)]
        radius = np.hypot(a.high[0][i] - centre[0], a.high[1][i] - centre[1])
        # seen from a's tile, b's far ones are further than a's own, so that the squares lose no digits
        far = least >= max(FAR * cutoff, radius)
        ax, ay, bx, by = a.x[s] - centre[0], a.y[s] - centre[1], b.x - centre[0], b.y - centre[1]
        left, right = np.stack([ax, ay, ax * ax + ay * ay, np.ones_like(ax)], 1), np.stack([-2 * bx, -2 * by, np.ones_like(bx), bx * bx + by * by])
        ones, total = np.ones(max(TILE, len(ax))), np.zeros((3, len(ax)))
        for j in np.flatnonzero(least <= cutoff * (1 + 1e-9)):
            t = b.tiles[first + j]
            if not far[j]:
                own = a is b and first + j == i
                _near(a, s, b, t, both and not own, params)
                continue
            shape = len(ax), t.stop - t.start
            r2, r = held if shape == (TILE, TILE) else (np.empty(shape), np.empty(shape))
            np.dot(left, right[:, t], out=r2)
            np.sqrt(r2, out=r)
            r2 *= r
            if most[j] > cutoff:
                np.minimum(r, cutoff, out=r)
            r -= cutoff
            r /= r2
            # three products with a vector cost half of one with three columns
            for k, v in enumerate((bx[t], by[t], ones[: shape[1]])):
                total[k] += r @ v
            if both:
                back = ones[: shape[0]] @ r
                b.fx[t] += ax @ r - bx[t] * back
                b.fy[t] += ay @ r - by[t] * back
        a.fx[s] += total[0] - ax * total[2]
        a.fy[s] += total[1] - ay * total[2]


def _found(rows: list[pa.RecordBatch], params: SimParams) -> Iterator[pa.RecordBatch]:
    """(id, fx, fy) of one group: of both sides, of the one there is, or of the left one alone where that looks in from outside (its pieces are numbered from -1 down)."""
    table = pa.Table.from_batches(rows)
    left = table.column("left").to_numpy()
    a, b = [_Part(*[table.column(c).to_numpy()[own] for c in ("id", "x", "y")]) for own in (left, ~left)]
    if not len(a.x) and len(b.x):
        a = b
    if not len(b.x):
        return
    both = pc.min(table.column("piece")).as_py() >= 0
    _push(a, b, both, params)
    for part in (a, b) if both and a is not b else (a,):
        yield pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(part.fx / params.mass), pa.array(part.fy / params.mass)], ["id", "fx", "fy"])


def _dealt(counts: list, lookers: dict[tuple[int, int], int], side: dict[tuple[int, int], int], params: SimParams) -> tuple[list[tuple], int]:
    """DEAL rows, which say what group a piece of a subcell goes to and on which side, and how many groups there are. ``counts`` has the particles of subcells (bx, by, sx, sy, n); subcells of ``sx`` -1 are those who look in."""
    cells: dict[tuple[int, int], list] = {}
    for bx, by, sx, sy, n in counts:
        pieces = ceil(n / PART)
        cells.setdefault((bx, by), []).extend((sx, sy, pieces, k) for k in range(pieces))
    out, group = [], 0
    for cell, parts in cells.items():
        width = params.cell / side[cell]
        apart = lambda p, q: np.hypot(*[max(0, abs(p[c] - q[c]) - 1) * width for c in (0, 1)])
        outside = ceil(lookers.get(cell, 0) / PART)
        for i, p in enumerate(parts):
            for q in parts[: i + 1]:
                if apart(p, q) > params.cutoff * (1 + 1e-6):
                    continue
                out.append((*cell, *p, group, False))
                if p is not q:
                    out.append((*cell, *q, group, True))
                group += 1
            for k in range(outside):
                out += [(*cell, *p, group, False), (*cell, -1, -1, outside, -1 - k, group, True)]
                group += 1
    return out, group


def pushes(binned: DataFrame, around: DataFrame, heavy: list[tuple[int, int, int, int]], params: SimParams) -> DataFrame:
    """(id, fx, fy): the pushes by the particles of the cells ``heavy``, (bx, by, particles, those who look in from other cells), on all who look into them; several rows an id.

    ``binned`` has the particles with bx and by; ``around`` has them once for each cell they look into, with ``own``.
    """
    spark = binned.sparkSession
    side = {(bx, by): isqrt(ceil(n / max(LEAST_PART, min(PART, n // 24))) - 1) + 1 for bx, by, n, _ in heavy}
    sides = F.broadcast(spark.createDataFrame([(*cell, n) for cell, n in side.items()], "bx long, by long, side long"))
    sub = lambda c, b: F.least(F.col("side") - 1, F.greatest(F.lit(0).cast("long"), F.floor((F.col(c) / F.lit(params.cell) - F.col(b)) * F.col("side")).cast("long")))
    inside = binned.join(sides, ["bx", "by"]).select("bx", "by", sub("x", "bx").alias("sx"), sub("y", "by").alias("sy"), "id", "x", "y")
    outside = around.where("not own").join(sides, ["bx", "by"]).select("bx", "by", F.lit(-1).cast("long").alias("sx"), F.lit(-1).cast("long").alias("sy"), "id", "x", "y")
    counts = inside.groupBy("bx", "by", "sx", "sy").agg(F.count("*").alias("n")).collect()  # some hundreds, or one for each PART particles
    deal, n_groups = _dealt(sorted(map(tuple, counts)), {(bx, by): n for bx, by, _, n in heavy}, side, params)
    tasks = max(1, min(TASKS, n_groups))
    own = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    mine = F.when(F.col("sx") < 0, -1 - own).otherwise(own)
    dealt = inside.unionAll(outside).join(F.broadcast(spark.createDataFrame(deal, DEAL)), ["bx", "by", "sx", "sy"]).where(mine == F.col("piece"))
    groups = dealt.select("group", "left", "piece", "id", "x", "y", (F.col("group") % tasks).alias("task")).repartitionById(tasks, "task").drop("task").sortWithinPartitions("group")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            column = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)]
            for s, e in pairwise(cuts):
                if s == e:
                    continue
                if column[s] != group and rows:
                    yield from _found(rows, params)
                    rows = []
                group = column[s]
                rows.append(batch.slice(s, e - s))
        if rows:
            yield from _found(rows, params)

    return groups.mapInArrow(met, "id long, fx double, fy double")

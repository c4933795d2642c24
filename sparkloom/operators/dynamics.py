"""Moving particles: integration, reflection, steps, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.spatial import forces_binned
from sparkloom.params import SimParams
from sparkloom.scratch import drop, saved


def lattice(spark, n: int, params: SimParams, seed: int = 1) -> tuple[DataFrame, float]:
    """(id, x, y, vx, vy): n particles on a lattice in a permuted order, ids from 1; velocities from a formula of seed and id.

    The permutation multiplies by a number coprime to n, so no sort is needed.
    """
    from math import ceil, gcd, sqrt

    size, sx = params.size(n), ceil(sqrt(n))
    sy = ceil(n / sx)
    factor = next(f for f in range(7919, 2 * 7919 + n) if gcd(f, n) == 1)
    k = F.col("id") * factor % n
    speed = lambda m: ((F.col("id") + 1) * m + seed) % 2001 / 1000.0 - 1.0
    at = lambda place, side: F.lit(size) * (1.0 + place) / (1.0 + side)
    return spark.range(n).select((F.col("id") + 1).alias("id"), at(k % sx, sx).alias("x"), at(F.floor(k / sx), sy).alias("y"), speed(48271).alias("vx"), speed(69621).alias("vy")), size


def moved(p: DataFrame, params: SimParams) -> DataFrame:
    """v += a * dt, then x += v * dt."""
    faster = p.withColumns({"vx": F.col("vx") + F.col("ax") * params.dt, "vy": F.col("vy") + F.col("ay") * params.dt})
    return faster.withColumns({"x": F.col("x") + F.col("vx") * params.dt, "y": F.col("y") + F.col("vy") * params.dt})


def reflection(x: Column, v: Column, size: float) -> tuple[Column, Column]:
    """Place and speed after the walls at 0 and size threw a particle back as often as needed; one bounce is exact, more are folded."""
    once = F.when((x >= 0) & (x <= size), x).when((x < 0) & (x >= -size), -x).when((x > size) & (x <= 2 * size), 2 * size - x)
    rest = x - F.floor(x / (2 * size)) * (2 * size)
    folded = F.when(rest <= size, rest).otherwise(2 * size - rest)
    flips = F.when(x < 0, F.ceil(-x / size)).when(x > size, F.ceil(x / size) - 1).otherwise(F.lit(0))
    return F.coalesce(once, folded), F.when(flips % 2 == 0, v).otherwise(-v)


def reflected(p: DataFrame, size: float) -> DataFrame:
    (x, vx), (y, vy) = (reflection(F.col(c), F.col(f"v{c}"), size) for c in "xy")
    return p.withColumns({"x": x, "y": y, "vx": vx, "vy": vy})


def step(p: DataFrame, size: float, params: SimParams) -> DataFrame:
    """(id, x, y, vx, vy) after one step: forces at the old places, then move and reflect all at once."""
    return reflected(moved(forces_binned(p, size, params), params), size).select("id", "x", "y", "vx", "vy")


def simulate(p: DataFrame, size: float, steps: int, params: SimParams) -> DataFrame:
    """The state after some steps. Each step's state is a table in the shared folder, so lineage stays short and a lost executor costs one step."""
    for k in range(steps):
        before, p = p, saved(step(p, size, params), "state")
        if k:
            drop(before)
    return p


def frames(p: DataFrame, size: float, steps: int, params: SimParams) -> DataFrame:
    """(frame, id, x, y): the places after steps 1, 1 + save_every, ..."""
    out = None
    for k in range(steps):
        before, p = p, saved(step(p, size, params), "state")
        if k and (k - 1) % params.save_every:
            drop(before)
        if k % params.save_every == 0:
            own = p.select(F.lit(k // params.save_every).alias("frame"), "id", "x", "y")
            out = own if out is None else out.unionByName(own)
    return out

"""Grid cells, bins, and short-range forces as joins on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import crowds
from sparkloom.operators.prefix import running_sums
from sparkloom.params import SimParams
from sparkloom.scratch import drop, saved

OFFSETS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
FORWARD = OFFSETS[5:]


def with_cells(p: DataFrame, size: float, params: SimParams) -> DataFrame:
    """Adds bx, by and cell = bx * dim + by."""
    axis = lambda c: F.floor(F.col(c) / F.lit(params.cell)).cast("long")
    return p.withColumns({"bx": axis("x"), "by": axis("y")}).withColumn("cell", F.col("bx") * params.dim(size) + F.col("by"))


def neighbours(cells: DataFrame, dim: int) -> DataFrame:
    """(cell, dir, neighbour): the cells of the 3 x 3 stencil within the grid; dir is 0 to 8, 4 the cell itself."""
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("dir"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(OFFSETS)])).alias("s")
    at = cells.select("cell", F.floor(F.col("cell") / dim).cast("long").alias("bx"), (F.col("cell") % dim).alias("by"), steps).selectExpr("cell", "s.dir as dir", "bx + s.dx as nx", "by + s.dy as ny")
    return at.where(f"nx between 0 and {dim - 1} and ny between 0 and {dim - 1}").selectExpr("cell", "dir", f"nx * {dim} + ny as neighbour")


def _push(dx: Column, dy: Column, params: SimParams) -> tuple[Column, Column, Column]:
    """Squared distance and the two parts of the acceleration by a particle that is dx, dy away."""
    r2 = dx * dx + dy * dy
    held = F.greatest(r2, F.lit(params.min_r * params.min_r))
    coef = (1 - F.lit(params.cutoff) / F.sqrt(held)) / held / F.lit(params.mass)
    return r2, coef * dx, coef * dy


def _summed(p: DataFrame, pushes: DataFrame) -> DataFrame:
    total = pushes.groupBy("id").agg(F.sum("fx").alias("ax"), F.sum("fy").alias("ay"))
    return p.join(total, "id", "left").withColumns({"ax": F.coalesce("ax", F.lit(0.0)), "ay": F.coalesce("ay", F.lit(0.0))})


def _pairs(left: DataFrame, right: DataFrame, on, params: SimParams, within=None) -> DataFrame:
    r2, fx, fy = _push(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"), params)
    both = left.join(right, on) if within is None else left.join(right, on).where(within)
    return both.withColumns({"r2": r2, "fx": fx, "fy": fy}).where(F.col("r2") <= params.cutoff * params.cutoff)


def _others(p: DataFrame) -> DataFrame:
    return p.select(F.col("id").alias("nid"), F.col("x").alias("nx"), F.col("y").alias("ny"), *[c for c in ("bx", "by") if c in p.columns])


def forces_brute(p: DataFrame, params: SimParams) -> DataFrame:
    """Adds ax, ay by comparing all pairs; for checks on few particles."""
    return _summed(p, _pairs(p.select("id", "x", "y"), _others(p), F.lit(True), params).select("id", "fx", "fy"))


def _around(p: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each particle once for every cell of a stencil, keyed by that cell and by whether it is its own."""
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])).alias("s")
    return p.select("id", "x", "y", "bx", "by", steps).selectExpr("id", "x", "y", "bx + s.dx as bx", "by + s.dy as by", "s.dx = 0 and s.dy = 0 as own")


def forces_binned(p: DataFrame, size: float, params: SimParams) -> DataFrame:
    """Adds ax, ay: every particle looks into the 9 cells around; an equi-join on cells with the cutoff as a further condition."""
    binned = with_cells(p, size, params)
    pushes = _pairs(_around(binned, OFFSETS), _others(binned), ["bx", "by"], params)
    return _summed(p, pushes.select("id", "fx", "fy"))


#: The width of a strip in cutoffs: more than 1, so that rounding parts no pair.
STRIP = 1.05


def forces_strips(p: DataFrame, params: SimParams) -> DataFrame:
    """Adds ax, ay: every particle is compared with all in its strip of x and the two beside it, whatever their y. Strips are little wider than the cutoff, as work grows with their width."""
    strips = p.withColumns({"bx": F.floor(F.col("x") / F.lit(STRIP * params.cutoff)).cast("long"), "by": F.lit(0).cast("long")})
    pushes = _pairs(_around(strips, [(-1, 0), (0, 0), (1, 0)]), _others(strips), ["bx", "by"], params)
    return _summed(p, pushes.select("id", "fx", "fy"))


#: Particles that look into one cell in one group, and the most cells for which these are dealt further: what is broadcast.
LOOKING, SPLIT_CELLS = 2000, 4096


def split_cells(binned: DataFrame, limit: int = LOOKING) -> DataFrame:
    """(bx, by, parts, inside, looking, crowded): the occupied cells into which more than ``limit`` particles look, or than a 9 / SPLIT_CELLS-th of all where that is more, into how many parts these are dealt, the particles in the cell and those that look into it, and whether as many are in it. A particle looks into 9 cells, so these are at most SPLIT_CELLS rows. Saved."""
    counts = saved(binned.groupBy("bx", "by").agg(F.count("*").alias("n")), "cells")
    limit = max(limit, -(-9 * counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n // SPLIT_CELLS))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in OFFSETS])).alias("s")
    looking = counts.select("bx", "by", "n", steps).selectExpr("bx + s.dx as bx", "by + s.dy as by", "n").groupBy("bx", "by").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    held = counts.select("bx", "by", F.col("n").alias("inside"))
    out = saved(looking.join(held, ["bx", "by"]).select("bx", "by", F.ceil(F.col("n") / limit).cast("int").alias("parts"), "inside", F.col("n").alias("looking"), (F.col("inside") > limit).alias("crowded")), "dense")
    drop(counts)
    return out


def looks(binned: DataFrame, dense: DataFrame, crowded: bool = True) -> tuple[DataFrame, DataFrame]:
    """The particles with the cells they look into, and those in the cells, both keyed by (bx, by, part): the ones that look are dealt between a cell's parts, and the ones in it are in each. Without crowded cells if not ``crowded``."""
    small = F.broadcast(dense.select("bx", "by", "parts", "crowded"))  # SPLIT_CELLS rows at most
    parts = F.coalesce("parts", F.lit(1))
    own = F.lit(True) if crowded else ~F.coalesce("crowded", F.lit(False))
    cells = lambda df: df.join(small, ["bx", "by"], "left").where(own)
    looking = cells(_around(binned, OFFSETS)).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts", "crowded")
    inside = cells(_others(binned)).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts", "crowded")
    return looking, inside


def forces_dense(p: DataFrame, size: float, params: SimParams, limit: int = LOOKING) -> DataFrame:
    """Adds ax, ay as ``forces_binned`` does, however many particles share a cell: no group has more than about ``limit`` of them looking into a cell, or an even share.

    Cells that hold more than that are left to ``crowds``, as their pairs are too many to be rows: there work still grows with the square of a cell, memory does not.
    """
    binned = with_cells(p, size, params)
    dense = split_cells(binned, limit)
    found = _pairs(*looks(binned, dense, False), ["bx", "by", "part"], params).select("id", "fx", "fy")
    heavy = [(r.bx, r.by, r.inside, r.looking - r.inside) for r in dense.where("crowded").collect()]  # SPLIT_CELLS / 9 at most
    return _summed(p, found.unionAll(crowds.pushes(binned, _around(binned, OFFSETS), heavy, params)) if heavy else found)


def forces_half(p: DataFrame, size: float, params: SimParams) -> DataFrame:
    """Adds ax, ay: each pair is found once, in its own cell or a forward neighbour, and pushes both ways."""
    binned = with_cells(p, size, params)
    found = _pairs(_around(binned, [(0, 0), *FORWARD]), _others(binned), ["bx", "by"], params, "not own or id < nid")
    both = F.explode(F.array(F.struct("id", "fx", "fy"), F.struct(F.col("nid").alias("id"), (-F.col("fx")).alias("fx"), (-F.col("fy")).alias("fy")))).alias("e")
    return _summed(p, found.select(both).select("e.*"))


def bin_counts(binned: DataFrame, dim: int) -> DataFrame:
    """(cell, n) for every cell of the grid, empty ones too."""
    spark = binned.sparkSession
    return spark.range(dim * dim).withColumnRenamed("id", "cell").join(binned.groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))


def bin_starts(counts: DataFrame) -> DataFrame:
    """(cell, n, first, last): exclusive and inclusive prefix sums of n in cell order."""
    return running_sums(counts.select("cell", "n"), ["cell"], "n").select("cell", "n", F.col("before").alias("first"), F.col("upto").alias("last"))


def scattered(binned: DataFrame) -> DataFrame:
    """(id, cell, slot): each particle's place in the array ordered by cell, then id: the particles before it."""
    return running_sums(binned.select("id", "cell", F.lit(1).alias("one")), ["cell", "id"], "one").select("id", "cell", F.col("before").alias("slot"))


def linked(binned: DataFrame) -> DataFrame:
    """(id, cell, next, head): the particle before each in its cell's list, and whether it is the list's head."""
    own = Window.partitionBy("cell")
    return binned.select("id", "cell", F.lag("id").over(own.orderBy("id")).alias("next"), (F.col("id") == F.max("id").over(own)).alias("head"))


def members(binned: DataFrame) -> DataFrame:
    """(cell, n, members): the ids in each occupied cell, in order."""
    return binned.groupBy("cell").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("members"))

"""Ranks over grid cells: block and strip maps, halos, migration, displacements, ordered gather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.spatial import neighbours


def block_rank(cell: Column, cells: int, ranks: int) -> Column:
    """The rank of a cell when ``cells`` are dealt in blocks, the first ones a cell larger. Ranks beyond the cells stay empty."""
    q, r = divmod(cells, ranks)
    wide = r * (q + 1)
    return F.when(cell < wide, F.floor(cell / (q + 1))).otherwise(r + F.floor((cell - wide) / max(q, 1))).cast("long")


def strip_rank(bx: Column, dim: int, ranks: int) -> Column:
    """The rank of a grid row when each has dim // ranks rows and the last the rest."""
    if ranks > dim:
        raise ValueError("more ranks than rows of cells")
    return F.least(F.floor(bx / (dim // ranks)), F.lit(ranks - 1)).cast("long")


def strip_place(bx: Column, dim: int, ranks: int, rank: int) -> Column:
    """How a rank sees a grid row: its own rows from 1 on, 0 and rows + 1 for the ghost rows beside them, -2 before and -3 behind those."""
    rows = dim // ranks
    first = rank * rows
    own = rows if rank < ranks - 1 else dim - first
    away = bx - first
    return F.when((away >= -1) & (away <= own), away + 1).when(away < -1, F.lit(-2)).otherwise(F.lit(-3)).cast("long")


def halo(dim: int, ranks: int, spark) -> DataFrame:
    """(rank, other, cell, theirs): cells with a neighbour cell (theirs) of another rank."""
    pairs = neighbours(spark.range(dim * dim).withColumnRenamed("id", "cell"), dim)
    owned = pairs.select(block_rank(F.col("cell"), dim * dim, ranks).alias("rank"), block_rank(F.col("neighbour"), dim * dim, ranks).alias("other"), "cell", F.col("neighbour").alias("theirs"))
    return owned.where("rank <> other")


def halo_send(dim: int, ranks: int, spark) -> DataFrame:
    """(rank, other, cell): the cells a rank sends to another."""
    return halo(dim, ranks, spark).select("rank", "other", "cell").distinct()


def halo_receive(dim: int, ranks: int, spark) -> DataFrame:
    """(rank, other, cell): the cells a rank gets from another."""
    return halo(dim, ranks, spark).select("rank", "other", F.col("theirs").alias("cell")).distinct()


def routed(changed: DataFrame) -> DataFrame:
    """Adds route: stay in the cell, local to another cell of the rank, or migrate."""
    return changed.withColumn("route", F.when(F.col("old_cell") == F.col("new_cell"), "stay").when(F.col("old_rank") == F.col("new_rank"), "local").otherwise("migrate"))


def sent(routes: DataFrame, ranks: int) -> DataFrame:
    """(source, target, n): particles that each rank sends to each other, zeros too."""
    spark = routes.sparkSession
    grid = spark.range(ranks * ranks).selectExpr(f"id div {ranks} as source", f"id % {ranks} as target")
    counts = routes.where("route = 'migrate'").groupBy(F.col("old_rank").alias("source"), F.col("new_rank").alias("target")).agg(F.count("*").alias("n"))
    # a left join would ask the counts' ranks not to be null, and that of each place's whole formula, before the join of the moves
    return grid.withColumn("n", F.lit(0).cast("long")).unionAll(counts).groupBy("source", "target").agg(F.sum("n").alias("n"))


def displacements(counts: DataFrame) -> DataFrame:
    """Adds displ: where a target's particles begin in the source's buffer (an exclusive prefix sum)."""
    before = F.sum("n").over(Window.partitionBy("source").orderBy("target").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("displ", F.coalesce(before, F.lit(0)))


def migrated(routes: DataFrame) -> DataFrame:
    """(rank, id, cell): the particles every rank holds afterwards, those that stayed and those it received."""
    held = routes.where("route <> 'migrate'").select(F.col("old_rank").alias("rank"), "id", F.col("new_cell").alias("cell"))
    return held.unionByName(routes.where("route = 'migrate'").select(F.col("new_rank").alias("rank"), "id", F.col("new_cell").alias("cell")))


def gathered(p: DataFrame) -> DataFrame:
    """All particles in order of id (then x)."""
    return p.orderBy("id", "x")

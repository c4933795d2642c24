"""Bins of particles kept by what changes: each move takes a particle out of one cell and puts it into another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MOVES = "step long, id long, old_cell long, new_cell long"


def deltas(moves: DataFrame) -> DataFrame:
    """(cell, n, ids) for each end of a move (id, old_cell, new_cell): n is -1 where it leaves and 1 where it arrives, ids the sum of these times id. A particle that comes in has no old cell, one that goes for good no new one, one that stays changes nothing."""
    ends = F.array(F.struct(F.col("old_cell").alias("cell"), F.lit(-1).cast("long").alias("n")), F.struct(F.col("new_cell").alias("cell"), F.lit(1).cast("long").alias("n")))
    at = moves.where("not old_cell <=> new_cell").select("id", F.explode(ends).alias("e"))
    return at.where("e.cell is not null").select("e.cell", "e.n", (F.col("id") * F.col("e.n")).alias("ids"))


def kept_bins(moves: DataFrame) -> DataFrame:
    """(cell, n, ids): how many particles each cell holds after all moves so far, and the sum of their ids; over a stream of moves the state is one row a cell that was ever held, whatever the number of moves."""
    return deltas(moves).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


def run_bins(spark: SparkSession, moves_path: str, out_path: str, state_path: str, files_a_batch: int = 1) -> StreamingQuery:
    """Reads Parquet files of moves (MOVES) as they come and writes after each batch the cells that changed to ``out_path``/batch=<n>, until no file is left. Started again with the same ``state_path`` it goes on where it ended.

    A batch that is repeated after a failure replaces its own folder, so each counts once.
    """
    moves = spark.readStream.schema(MOVES).option("maxFilesPerTrigger", files_a_batch).parquet(moves_path)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out_path}/batch={batch}")

    stream = kept_bins(moves).writeStream.outputMode("update").option("checkpointLocation", state_path).foreachBatch(write)
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest(spark: SparkSession, out_path: str) -> DataFrame:
    """(cell, n, ids) of the cells that hold a particle: what the last batch that changed a cell wrote of it."""
    rows = spark.read.schema("cell long, n long, ids long, batch long").parquet(out_path)
    last = rows.groupBy("cell").agg(F.max_by(F.struct("n", "ids"), "batch").alias("last"))
    return last.select("cell", "last.*").where("n > 0")

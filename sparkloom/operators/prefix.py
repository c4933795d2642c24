"""Running sums over any order, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import saved


def running_sums(df: DataFrame, order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """``df`` with before and upto: the sums of the whole-number column ``value`` over the rows that come before each in the order of the columns ``order``, and over these and itself.

    Rows are dealt by ranges of the order, equal ones further by their place in the input, so that no key fills a task.
    Each range is summed as it is sorted; the totals of the ranges, one number a partition, are then scanned and added. Rows
    alike in ``order`` follow each other in any way. Columns named before and upto are replaced; null values count 0; an empty table gives an empty one.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = df.drop("before", "upto")
    tie, own, part = "_tie", "_own", "_part"
    sorted_rows = kept.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    at = kept.columns.index(value)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = np.cumsum(batch.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) + total
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64()), pa.array(np.full(len(sums), number, np.int32))], [*batch.schema.names, own, part])

    schema = kept.withColumns({own: F.lit(0).cast("long"), part: F.lit(0)}).schema
    within = saved(sorted_rows.mapInArrow(summed, schema), "ranges")
    sums = within.groupBy(part).agg(F.sum(F.coalesce(value, F.lit(0))).cast("long").alias("total")).collect()  # one row a partition
    offsets, total = [], 0
    for r in sorted(sums, key=lambda r: r[part]):
        offsets.append((r[part], total))
        total += r.total
    after = F.broadcast(spark.createDataFrame(offsets, f"{part} int, offset long"))  # as many rows as partitions
    upto = F.col("offset") + F.col(own)
    return within.join(after, part).withColumns({"upto": upto, "before": upto - F.coalesce(value, F.lit(0))}).select(*kept.columns, "before", "upto")

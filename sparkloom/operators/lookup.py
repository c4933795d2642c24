"""Tables that are built once for a key and probed many times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from sparkloom.scratch import delete, new_path


class BuiltTable:
    """``df`` in buckets by ``key``, each sorted, in the shared folder. Look-ups shuffle what is asked, never the table.

    There are as many buckets as shuffle partitions, so that a join asks for no other number. A key that very many
    rows ask for is met by one bucket's task: ask for distinct keys where that may be.
    """

    def __init__(self, df: DataFrame, key: str):
        self.spark, self.key = df.sparkSession, key
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path = f"built_{uuid.uuid4().hex}", new_path(self.spark, "built")
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", self.path).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def found(self, asked: DataFrame, by: str, columns: list[str] | None = None) -> DataFrame:
        """``asked`` with the table's other columns, or those named, where its column ``by`` is a key of it; else with nulls."""
        held = self.table().select(self.key, *columns) if columns else self.table()
        return asked.join(held.withColumnRenamed(self.key, by), by, "left")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)

"""Global order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.plans.checkpoints import materialize


def dense_index(df: DataFrame, order: list[Column | str], name: str = "idx") -> DataFrame:
    """Number all rows 0, 1, 2, ... in an order, nulls last.

    Rows are dealt by ranges, sorted inside each and shifted by the rows of the ranges before; one count a partition is broadcast. The order should
    be total: give a key that splits ties last.
    """
    keys = [F.col(c).asc_nulls_last() if isinstance(c, str) else c.asc_nulls_last() for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))  # a row a partition
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inside).drop("_at", "_part", "_before")

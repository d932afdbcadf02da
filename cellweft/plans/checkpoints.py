"""Cutting lineage of iterative plans through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cellweft-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_round(df: DataFrame) -> DataFrame:
    """materialize() for rounds that join a frame with itself: estimates of size are forgotten.

    A checkpoint keeps the estimate of its plan, and a join multiplies those of its sides, so that every round would raise the number to a power
    until it fills the driver's memory.
    """
    spark, kept = df.sparkSession, materialize(df)
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.javaRDD(), kept._jdf.schema()), spark)

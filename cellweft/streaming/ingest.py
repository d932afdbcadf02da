"""Continuous ingest of finished sections: an extension that stands for polling unfinished ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_sections(spark: SparkSession, source: str, target: str, schema: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """New files of cells (with a section column) go to target, a section a partition folder; a section that comes again replaces itself, so that a repeated batch changes nothing."""

    def upsert(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    w = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")).start()


def section_counts(spark: SparkSession, source: str, schema: str, delay: str = "10 minutes") -> DataFrame:
    """Cells of each section and window of arrival time (column ts), late rows within the delay counted."""
    return spark.readStream.schema(schema).parquet(source).withWatermark("ts", delay).groupBy(F.window("ts", "5 minutes"), "section").agg(F.count(F.lit(1)).alias("n"))

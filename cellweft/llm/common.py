"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; only a local session may fall back to its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.split("[")[0] == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cellweft-checkpoint-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there."""
    require_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, rows: int, rows_per_part: int = 20_000) -> int:
    """Partitions for a table of so many narrow rows, never more than a shuffle makes."""
    return max(1, min(shuffle_partitions(spark), -(-rows // rows_per_part)))


def compact(df: DataFrame, rows_per_part: int = 20_000) -> tuple[DataFrame, int]:
    """Materialized df in as few partitions as its rows need, and their number: small tables in loops then write few shuffle files."""
    done = materialize(df)
    parts = parts_for(df.sparkSession, done.count(), rows_per_part)
    return done.coalesce(parts), parts


#: A key is hot if it holds more rows than this, and more than a quarter of an even partition.
HOT_ROWS = 1024


def hot_limit(spark: SparkSession, rows: int) -> int:
    """Rows above which a key is hot; at most four times as many keys as shuffle partitions can be."""
    return max(HOT_ROWS, rows // (4 * shuffle_partitions(spark)))


def join_unique(left: DataFrame, right: DataFrame, on: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """left with the columns of right, which holds each key once; how is inner or left.

    hot: the keys above hot_limit in left. Their rows stay where they are, and their few rows of right are broadcast; only the
    others are shuffled by the key, so that no task holds more than its share of a hot one.
    """
    keys = F.broadcast(materialize(hot.select(on)))
    few = keys.join(materialize(right.join(keys, on, "left_semi")), on, how)
    return left.join(F.broadcast(few), on).unionByName(left.join(keys, on, "left_anti").join(right, on, how))


def word_count(text: Column) -> Column:
    """Words of a text as long; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def dense_index(df: DataFrame, keys: list[str], name: str = "idx") -> DataFrame:
    """Number all rows 0, 1, 2, ... in the order of keys, without a single-task sort.

    Rows are range-partitioned by keys (give a key that splits hot values, such as an id, last), numbered inside
    each partition, and shifted by the rows of the partitions before. Only one count per partition is gathered,
    so what is broadcast is bounded by the number of shuffle partitions. Rows equal in every key are ordered
    arbitrarily.
    """
    n = shuffle_partitions(df.sparkSession)
    numbered = materialize(
        df.repartitionByRange(n, *[F.col(k).asc_nulls_last() for k in keys])
        .sortWithinPartitions(*[F.col(k).asc_nulls_last() for k in keys])
        .withColumn("_at", F.monotonically_increasing_id())
    )
    counts = numbered.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select(
        "_part",
        (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"),
    )
    return (
        numbered.withColumn("_part", F.shiftright("_at", 33))
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_before", "_at")
    )


def map_rows(df: DataFrame, key: str, columns: list[str], run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas over key and columns; the key crosses as a string, so that nulls and large numbers survive."""
    kind = df.schema[key].dataType
    out = df.select(F.col(key).cast("string").alias(key), *columns).mapInPandas(run, f"{key} string, {schema}")
    return out.withColumn(key, F.col(key).cast(kind))

"""Logical inputs bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Features of an embedding, all of them, moved to positive values.
BITS = 64
WIDTH = 40


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type_ix, section, x, y, bits, node_size."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("type_ix"), F.concat(F.lit("A_"), (F.col("vec_id") % 4).cast("string"), F.lit(".0")).alias("section"),
        (F.col("embedding")[0].cast("double") * 10).alias("x"), (F.col("embedding")[1].cast("double") * 10).alias("y"),
        F.transform(F.slice("embedding", 1, BITS), lambda v: v.cast("double") * 100 + 50).alias("bits"), F.lit(1).alias("node_size"),
    )


def grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts on a grid of a fixed width: (id, x, y, type_ix, section, node_size, value) and edges to the right and down."""
    p = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % WIDTH).cast("int").alias("x"), F.floor(F.col("p_partkey") / WIDTH).cast("int").alias("y"),
        (F.col("p_size") % 3).alias("type_ix"), F.lit("A_1.0").alias("section"), F.lit(1).alias("node_size"), F.col("p_retailprice").alias("value"),
    )
    step = p.select(F.col("id").alias("src"), "x")
    edges = step.filter(F.col("x") < WIDTH - 1).select("src", (F.col("src") + 1).alias("dst")).union(step.select("src", (F.col("src") + WIDTH).alias("dst")))
    return p, edges.join(p.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_semi").select("src", "dst")


#: The same in DuckDB: cells c, their features in long form l, grid nodes g and edges e.
C = (
    "c AS (SELECT vec_id AS id, label AS type_ix, 'A_' || (vec_id % 4)::VARCHAR || '.0' AS section, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, "
    f"list_transform(embedding[1:{BITS}], lambda v: v::DOUBLE * 100 + 50) AS bits FROM embeddings)"
)
L = C + f", l AS (SELECT id, type_ix, section, x, y, unnest(range(0, {BITS}))::INT AS bit, unnest(bits) AS v FROM c)"
G = (
    f"g AS (SELECT p_partkey AS id, (p_partkey % {WIDTH})::INT AS x, (p_partkey // {WIDTH})::INT AS y, p_size % 3 AS type_ix, p_retailprice AS value FROM part), "
    f"e AS (SELECT a.id AS src, b.id AS dst FROM g a JOIN g b ON b.id = a.id + 1 AND a.x < {WIDTH - 1} UNION ALL SELECT a.id, b.id FROM g a JOIN g b ON b.id = a.id + {WIDTH}), "
    "u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"
)

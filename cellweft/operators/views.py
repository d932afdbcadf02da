"""Tables behind plots: values clipped to quantiles, colours joined, windows cut. Nothing is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.functions import arrays as A


def basis_values(units: DataFrame, bits: str, bit: int, low: float = 0.05, high: float = 0.95, per_section: bool = False) -> DataFrame:
    """(id, section, x, y, value): one bit clipped to its quantiles over all units or each section, sorted so that large values come last."""
    v = units.select("id", "section", "x", "y", F.col(bits)[bit].alias("value"))
    keys = ["section"] if per_section else []
    q = v.groupBy(*keys).agg(F.percentile("value", low).alias("_lo"), F.percentile("value", high).alias("_hi"))
    j = v.join(q, keys) if keys else v.crossJoin(F.broadcast(q))  # one row
    return j.withColumn("value", F.greatest(F.least("value", "_hi"), "_lo")).drop("_lo", "_hi")


def colorpleth(units: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """shade: (value - low) / (high - low) clipped to [0, 1]."""
    return units.withColumn("shade", F.greatest(F.least((F.col(value) - low) / (high - low), F.lit(1.0)), F.lit(0.0)))


def type_map(units: DataFrame, taxonomy: DataFrame, geoms: DataFrame | None = None) -> DataFrame:
    """units with the colour of their type, and their outline if given."""
    out = units.join(taxonomy.select("type_ix", "type", "rgb"), "type_ix", "left")
    return out.join(geoms.select(F.col("unit_id").alias("id"), "wkt"), "id", "left") if geoms is not None else out


def type_map_with_boundaries(units: DataFrame, taxonomy: DataFrame, geoms: DataFrame, outer: DataFrame) -> DataFrame:
    """Filled units and the outlines of a second layer, one table: kind fill or boundary."""
    fill = type_map(units, taxonomy, geoms).select(F.lit("fill").alias("kind"), "rgb", "wkt")
    return fill.unionByName(outer.select(F.lit("boundary").alias("kind"), F.lit(None).cast("string").alias("rgb"), "wkt"))


def random_colours(units: DataFrame, seed: int = 0) -> DataFrame:
    """rgb by a hash of the id."""
    return units.withColumn("rgb", F.concat(F.lit("#"), F.lpad(F.hex(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 24))), 6, "0")))


def value_quantiles(units: DataFrame, value: str, probabilities: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(section, quantiles) of log10(x + 1), negatives counting as 0."""
    v = F.log10(F.greatest(F.col(value), F.lit(0.0)) + 1)
    return units.groupBy("section").agg(F.percentile(v, list(probabilities)).alias("q"))


def sum_quantiles(units: DataFrame, bits: str) -> DataFrame:
    return value_quantiles(units.withColumn("_s", A.total(F.col(bits))), "_s")


def window(units: DataFrame, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    return units.filter(F.col("x").between(*x) & F.col("y").between(*y))


def log_shares(rows: DataFrame, bits: str) -> DataFrame:
    """Row shares as log2(x + 1)."""
    return rows.withColumn(bits, A.let(F.nullif(A.total(F.col(bits)), F.lit(0.0)), lambda t: F.transform(bits, lambda x: F.log2(x / t + 1))))


def scaled(df: DataFrame, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Minimum to low, maximum to high."""
    r = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    span = (r["b"] - r["a"]) if r["a"] is not None and r["b"] != r["a"] else 1.0
    return df.withColumn(value, (F.col(value) - (r["a"] or 0.0)) / span * (high - low) + low)


def palette_order(types: DataFrame, n: int, bits: str = "bits") -> DataFrame:
    """(type, position): leaves of Ward's tree over the types' profiles, for colours along a map."""
    import numpy as np

    from cellweft.operators.classify import leaf_order, ward

    t = types.orderBy("type").toPandas()  # a taxonomy
    order = leaf_order(ward(np.array(t[bits].tolist())), len(t))
    return types.sparkSession.createDataFrame([(t["type"][i], k) for k, i in enumerate(order)], "type string, position int")


def shared_limits(units: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """units plus lo and hi of their section, for local contrast."""
    w = Window.partitionBy("section")
    return units.withColumns({"lo": F.percentile(value, low).over(w), "hi": F.percentile(value, high).over(w)})

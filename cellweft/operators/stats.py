"""Evaluation statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.functions import arrays as A


def paired_mse(df: DataFrame, truth: str, prediction: str, n: int) -> DataFrame:
    """mse and R squared over all entries of two feature arrays, and R squared per column; rows with a null are left out."""
    ok = df.filter(F.forall(truth, lambda x: x.isNotNull()) & F.forall(prediction, lambda x: x.isNotNull()))
    t, p = F.col(truth), F.col(prediction)
    err = [F.avg((t[i] - p[i]) * (t[i] - p[i])) for i in range(n)]
    var = [F.var_pop(t[i]) for i in range(n)]
    square = [F.avg(t[i] * t[i]) for i in range(n)]
    mean = lambda cols: sum(cols[1:], cols[0]) / n
    row = ok.agg(mean(err).alias("mse"), mean(square).alias("_s"), mean(var).alias("_v"), F.array(*[1 - e / F.nullif(v, F.lit(0.0)) for e, v in zip(err, var, strict=True)]).alias("r2_columns"))
    return row.select("mse", (1 - F.col("mse") / F.col("_s")).alias("explained"), (1 - F.col("mse") / F.col("_v")).alias("r2"), "r2_columns")


def paired_correlation(df: DataFrame, a: str, b: str, how: str = "pearson") -> DataFrame:
    f = A.pearson if how == "pearson" else A.spearman
    return df.withColumn("r", f(F.col(a), F.col(b)))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """ari, from the contingency table."""
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    rows = n.groupBy(a).agg(F.sum("n").alias("s")).agg(pairs("s").alias("ra"))
    cols = n.groupBy(b).agg(F.sum("n").alias("s")).agg(pairs("s").alias("rb"))
    cell = n.agg(pairs("n").alias("rc"), F.sum("n").alias("t"))
    one = cell.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.col("ra") * F.col("rb") / F.nullif(F.col("t") * (F.col("t") - 1) / 2, F.lit(0.0))
    top = (F.col("ra") + F.col("rb")) / 2
    return one.select(F.when(top == expected, 1.0).otherwise((F.col("rc") - expected) / (top - expected)).alias("ari"))


def confusion(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """(predicted, truth, n, share of the truth's rows)."""
    n = df.groupBy(predicted, truth).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def eta_squared(df: DataFrame, by: str, bits: str, n: int) -> DataFrame:
    """(bit, eta2) between the groups."""
    from cellweft.operators.normalize import anova

    return df.sparkSession.createDataFrame([(i, float(e)) for i, (_, e) in enumerate(anova(df, by, bits, n))], "bit int, eta2 double")


def reconstruction(df: DataFrame, bits: str, w: np.ndarray) -> DataFrame:
    """err = |x - W W' x|^2 summed, ss = centred squares, r2."""
    from cellweft.operators.normalize import affine

    n = w.shape[0]
    rows = df.withColumn("_r", affine(bits, w @ w.T, np.zeros(n)))
    b = F.col(bits)
    ss = [F.var_pop(b[i]) * F.count(F.lit(1)) for i in range(n)]
    out = rows.agg(F.sum(A.squared_distance(b, F.col("_r"))).alias("err"), sum(ss[1:], ss[0]).alias("ss"))
    return out.withColumn("r2", 1 - F.col("err") / F.col("ss"))


def earth_mover(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray, steps: int = 100_000) -> float:
    """Least cost of moving one share vector to another: shortest augmenting paths, exact for a small number of types."""
    a, b = supply.astype(float).copy(), demand.astype(float).copy()
    n = len(a)
    flow = np.zeros((n, n))
    for _ in range(steps):
        sources = np.flatnonzero(a > 1e-12)
        if not len(sources) or b.max() <= 1e-12:
            break
        # Bellman-Ford over both sides: forward edges at their cost, backward edges where something flows
        left, right = np.where(a > 1e-12, 0.0, np.inf), np.full(n, np.inf)
        from_left, from_right = np.full(n, -1), np.full(n, -1)
        for _ in range(2 * n):
            step = left[:, None] + cost
            best = step.min(axis=0)
            better = best < right - 1e-12
            from_left[better], right[better] = step.argmin(axis=0)[better], best[better]
            back = np.where(flow > 1e-12, right[None, :] - cost, np.inf)
            best = back.min(axis=1)
            improved = best < left - 1e-12
            from_right[improved], left[improved] = back.argmin(axis=1)[improved], best[improved]
            if not better.any() and not improved.any():
                break
        t = int(np.where(b > 1e-12, right, np.inf).argmin())
        path, j = [], t
        while True:
            i = int(from_left[j])
            path.append((i, j, 1))
            if from_right[i] < 0:
                break
            j = int(from_right[i])
            path.append((i, j, -1))
        amount = min([a[path[-1][0]], b[t], *(flow[i, j] for i, j, s in path if s < 0)])
        for i, j, s in path:
            flow[i, j] += s * amount
        a[path[-1][0]] -= amount
        b[t] -= amount
    return float((flow * cost).sum())


def emd(df: DataFrame, a: str, b: str, cost: np.ndarray) -> DataFrame:
    """df plus emd of two share arrays, row by row."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([earth_mover(np.asarray(p), np.asarray(q), cost) for p, q in zip(x, y, strict=True)])

    return df.withColumn("emd", run(a, b))


def emd_line(a: Column, b: Column) -> Column:
    """Closed form where the types lie on a line one step apart: the summed absolute difference of the running sums."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    run = F.aggregate(d, F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s")), lambda acc, x: F.struct((acc["c"] + x).alias("c"), (acc["s"] + F.abs(acc["c"] + x)).alias("s")))
    return run["s"]


def between_class_scatter(df: DataFrame, levels: list[str], bits: str, n: int, weights: list[float] | None = None) -> np.ndarray:
    """Between-class scatter over a hierarchy: at each level, the outer products of class means less the parent's mean, by class size, weighted by level and rescaled to unit trace."""
    from cellweft.operators.normalize import grouped_feature_aggregates

    out, parents = np.zeros((n, n)), {}
    for k in range(len(levels) + 1):
        by = levels[:k]
        rows = df.withColumn("_class", F.struct(F.lit(0).alias("_all"), *by))
        means = grouped_feature_aggregates(rows, "_class", bits, n, m=F.avg, c=F.count).collect()  # as many as a taxonomy has classes
        own = {tuple(r["_class"])[1:]: (r["c"][0], np.array(r["m"])) for r in means}
        if k:
            s = sum((c * np.outer(m - parents[name[:-1]][1], m - parents[name[:-1]][1]) for name, (c, m) in sorted(own.items(), key=lambda x: str(x[0]))), np.zeros((n, n)))
            out += (weights[k - 1] if weights else 1.0) * s / max(np.trace(s), 1e-12)
        parents = own
    return out / max(np.trace(out), 1e-12)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 50, log: bool = False, by: list[str] | None = None) -> DataFrame:
    """(bin from 0, n) of equal bins between two bounds, of log10 on request; the upper bound belongs to the last bin."""
    v = F.log10(value) if log else F.col(value)
    b = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    rows = df.filter((v >= low) & (v <= high)).withColumn("bin", b)
    return rows.groupBy(*(by or []), "bin").agg(F.count(F.lit(1)).alias("n"))


def log_log_fit(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """slope and intercept of log10 counts on log10 value over log-spaced bins."""
    b = df.filter(F.col(value) > 0).agg(F.min(F.log10(value)).alias("lo"), F.max(F.log10(value)).alias("hi")).first()
    width = (b["hi"] - b["lo"]) / bins or 1.0
    h = histogram(df.filter(F.col(value) > 0), value, b["lo"], b["hi"], bins, log=True).withColumn("x", F.lit(b["lo"]) + (F.col("bin") + 0.5) * width)
    return h.agg(F.regr_slope(F.log10("n"), F.col("x")).alias("slope"), F.regr_intercept(F.log10("n"), F.col("x")).alias("intercept"))


def poisson_density(distances: DataFrame, value: str = "dist", bins: int = 50) -> DataFrame:
    """Density of an even Poisson process from nearest-neighbour distances: slope of -log(1 - CDF) on pi r^2, through binned counts."""
    top = distances.agg(F.max(value)).first()[0]
    h = histogram(distances, value, 0.0, top, bins)
    total = F.sum("n").over(Window.partitionBy())
    c = h.withColumn("cdf", F.sum("n").over(Window.orderBy("bin")) / total).filter("cdf < 1").withColumn("r", (F.col("bin") + 1) * (top / bins))
    return c.agg(F.regr_slope(-F.log(1 - F.col("cdf")), F.lit(np.pi) * F.col("r") * F.col("r")).alias("density"))

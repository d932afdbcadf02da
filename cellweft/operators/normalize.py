"""Normalisation of cells x features, a feature array per row.

Statistics are aggregates of the long form (a row a feature, combined before the shuffle, so that as many rows as features and groups
remain); their result returns as a join on the group, or as constants for the whole table. Plans do not grow with the features. Medians are exact; pass exact=False for the sketch-based percentile, whose state is
bounded, on very large tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.functions import arrays as A


def _percentile(c: Column, p: float, exact: bool = True) -> Column:
    return F.percentile(c, p) if exact else F.percentile_approx(c, p, 10000)


def long_form(df: DataFrame, bits: str, n: int, *keep: str) -> DataFrame:
    """One row a feature: the kept columns, bit and v."""
    return df.select(*keep, F.posexplode(F.slice(bits, 1, n)).alias("bit", "v"))


def feature_aggregates(df: DataFrame, bits: str, n: int, *keep: str, **aggs) -> dict[str, list]:  # noqa: ANN003
    """Each named aggregate (a function of the value's column; it may use bit and the kept columns) of each of the n features: n constants a name."""
    got = long_form(df, bits, n, *keep).groupBy("bit").agg(*[f(F.col("v")).alias(f"a_{name}") for name, f in aggs.items()]).collect()
    rows = {r["bit"]: r for r in got}
    return {name: [rows[i][f"a_{name}"] if i in rows else None for i in range(n)] for name in aggs}


def grouped_feature_aggregates(df: DataFrame, by: str, bits: str, n: int, *keep: str, **aggs) -> DataFrame:  # noqa: ANN003
    """Rows (by, one array per aggregate, n long)."""
    each = long_form(df, bits, n, by, *keep).groupBy(by, "bit").agg(*[f(F.col("v")).alias(name) for name, f in aggs.items()])
    rows = each.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("bit", *aggs))).alias("_rows"))
    return rows.select(by, *[F.col("_rows")[name].alias(name) for name in aggs])


def _each(bits: str, f, *consts: list[float]) -> Column:  # noqa: ANN001
    """Array of f(x, constants of the feature)."""
    tables = [A.literal(c) for c in consts]
    return F.transform(F.col(bits), lambda x, i: f(x, *[F.element_at(t, i + 1) for t in tables]))


def zscore(df: DataFrame, bits: str, n: int, fit: DataFrame | None = None) -> DataFrame:
    """(x - median) / population standard deviation per feature, of fit if given; null where the deviation is 0."""
    s = feature_aggregates(df if fit is None else fit, bits, n, med=F.median, sd=F.stddev_pop)
    return df.withColumn(bits, _each(bits, lambda x, m, d: (x - m) / F.nullif(d, F.lit(0.0)), s["med"], s["sd"]))


def iqr_scale(df: DataFrame, bits: str, n: int, centre: bool = True) -> DataFrame:
    """(x - median) / interquartile range; 0 where the range is 0."""
    s = feature_aggregates(df, bits, n, lo=lambda c: F.percentile(c, 0.25), med=F.median, hi=lambda c: F.percentile(c, 0.75))
    wide = [h - lo for h, lo in zip(s["hi"], s["lo"], strict=True)]
    return df.withColumn(bits, _each(bits, lambda x, m, w: F.when(w == 0, F.lit(0.0)).otherwise((x - m) / w), s["med"], wide))


def robust_zscore(df: DataFrame, bits: str, n: int) -> DataFrame:
    """Lower median removed, divided by the lower median of the absolute rest; where that is 0, by the sample deviation, and else by 1."""
    low = lambda c: F.call_function("approx_percentile", c, F.lit(0.5), F.lit(10_000_000))
    med = feature_aggregates(df, bits, n, med=low)["med"]
    rest = df.withColumn(bits, _each(bits, lambda x, m: x - m, med))
    s = feature_aggregates(rest, bits, n, mad=lambda c: low(F.abs(c)), sd=F.stddev_samp)
    scale = [a or b or 1.0 for a, b in zip(s["mad"], s["sd"], strict=True)]
    return rest.withColumn(bits, _each(bits, lambda x, d: x / d, scale))


def quantile_scale(df: DataFrame, bits: str, n: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(x - q_low) / (q_high - q_low); a zero range counts as 1."""
    s = feature_aggregates(df, bits, n, lo=lambda c: F.percentile(c, low), hi=lambda c: F.percentile(c, high))
    wide = [(h - a) or 1.0 for h, a in zip(s["hi"], s["lo"], strict=True)]
    return df.withColumn(bits, _each(bits, lambda x, a, w: (x - a) / w, s["lo"], wide))


def linear_transform(df: DataFrame, reference: DataFrame, bits: str, n: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Map the quantile range of each feature on that of the reference."""
    q = {"lo": lambda c: F.percentile(c, low), "hi": lambda c: F.percentile(c, high)}
    own, ref = feature_aggregates(df, bits, n, **q), feature_aggregates(reference, bits, n, **q)
    slope = [(b - a) / ((d - c) or 1.0) for a, b, c, d in zip(ref["lo"], ref["hi"], own["lo"], own["hi"], strict=True)]
    return df.withColumn(bits, _each(bits, lambda x, c, k, a: (x - c) * k + a, own["lo"], slope, ref["lo"]))


def library_size(df: DataFrame, bits: str, scale: float | None = None) -> DataFrame:
    """Rows divided by their sum, times the median sum or a given scale."""
    size = A.total(F.col(bits))
    k = df.agg(F.median(size)).first()[0] if scale is None else scale
    return df.withColumn(bits, A.let(size, lambda t: F.transform(bits, lambda x: x / t * F.lit(float(k or 0)))))


def cell_shares(df: DataFrame, bits: str, to_mean: bool = False, log: bool = False) -> DataFrame:
    """Clipped at 0 (log10(x + 1) on request) and divided by the row sum, at least 1e-10; times the mean row sum on request."""
    pos = F.transform(bits, lambda x: F.log10(F.greatest(x, F.lit(0.0)) + 1) if log else F.greatest(x, F.lit(0.0)))
    size = F.greatest(A.total(pos), F.lit(1e-10))
    k = df.agg(F.avg(size)).first()[0] if to_mean else 1.0
    return df.withColumn(bits, A.let(size, lambda t: F.transform(pos, lambda x: x / t * F.lit(float(k or 0)))))


def log_row_median(df: DataFrame, bits: str) -> DataFrame:
    """log10(x + 1) less its row median."""
    logs = F.transform(bits, lambda x: F.log10(x + 1))
    return df.withColumn(bits, A.let(logs, lambda v: A.let(A.median(v), lambda m: F.transform(v, lambda x: x - m))))


_COVARIATES = {
    "sum": A.total, "mean": A.mean, "min": F.array_min, "max": F.array_max, "median": A.median,
}


def regress(df: DataFrame, bits: str, n: int, value: str = "sum", log: bool = True, leave_log: bool = False, to_mean: bool = False, fit: DataFrame | None = None) -> DataFrame:
    """Each feature regressed on a covariate of its row.

    With log, residuals of log10(max(x, 1)) on the log10 covariate, to_mean adding the mean prediction, then 10 to that power unless
    leave_log; without, x / prediction * mean prediction. One aggregate gives all slopes.
    """
    if value not in (*_COVARIATES, "none"):
        raise ValueError(f"unknown covariate {value}")

    def prepared(d: DataFrame) -> DataFrame:
        x = F.transform(bits, lambda v: F.greatest(v, F.lit(1.0))) if log else F.col(bits)
        cov = F.lit(0.0) if value == "none" else _COVARIATES[value](x)
        x = F.transform(x, F.log10) if log else x
        return d.withColumn("_x", x).withColumn("_c", F.log10(cov) if log and value != "none" else cov)

    rows, base = prepared(df), prepared(df if fit is None else fit)
    got = feature_aggregates(base, "_x", n, "_c", k=lambda v: F.regr_slope(v, F.col("_c")), m=F.avg)
    slope, avg = [k or 0.0 for k in got["k"]], got["m"]
    c = base.agg(F.avg("_c")).first()[0]
    predicted = lambda k, m, own: m + k * (own - F.lit(c))
    # the mean prediction of a least-squares fit is the mean
    if log:
        out = A.let(F.col("_c"), lambda own: _each("_x", lambda x, k, m: x - predicted(k, m, own) + (m if to_mean else 0.0), slope, avg))
        out = out if leave_log else F.transform(out, lambda x: F.pow(F.lit(10.0), x))
    else:
        out = A.let(F.col("_c"), lambda own: _each("_x", lambda x, k, m: x / predicted(k, m, own) * m, slope, avg))
    return rows.withColumn(bits, out).drop("_x", "_c")


#: Sums of partitions that are added up in one task.
FAN = 32


def moments(df: DataFrame, bits: str, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (population) of the features over rows without a null.

    The means are one aggregate; the sums of products about them are matrix products of Arrow batches, one matrix a partition, added up in FAN tasks.
    """
    whole = df.select(F.transform(F.slice(bits, 1, n), lambda x: x.cast("double")).alias("x")).filter(F.forall("x", lambda x: x.isNotNull()))
    count = whole.count()
    mean = np.array([m or 0.0 for m in feature_aggregates(whole, "x", n, m=F.avg)["m"]])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for batch in batches:
            x = np.array(batch["x"].tolist(), np.float64).reshape(-1, n) - mean
            total += x.T @ x
        yield pd.DataFrame({"s": [total.ravel()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [np.stack(pdf.sort_values("_at")["s"].to_numpy()).sum(axis=0)]})

    parts = whole.mapInPandas(part, "s array<double>").withColumn("_at", F.spark_partition_id())
    sums = parts.groupBy((F.col("_at") % FAN).alias("_fan")).applyInPandas(add, "s array<double>").collect()
    cov = sum((np.array(r["s"]) for r in sorted(sums, key=lambda r: r["s"])), np.zeros(n * n)).reshape(n, n)
    return count, mean, cov / max(count, 1)


def affine(bits: str, weights: np.ndarray, offset: np.ndarray) -> Column:
    """bits times weights (rows: inputs) plus offset, as one expression over a constant matrix."""
    table = F.array(*[F.struct(A.literal(w.tolist()).alias("w"), F.lit(float(o)).alias("o")) for w, o in zip(weights.T, offset, strict=True)])
    return F.transform(table, lambda t: A.dot(F.col(bits), t["w"]) + t["o"])


def cross_prediction(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares prediction of every feature from all the others: weights and offset."""
    n = len(mean)
    w = np.zeros((n, n))
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        w[rest, i] = np.linalg.lstsq(cov[np.ix_(rest, rest)], cov[rest, i], rcond=None)[0]
    return w, mean - mean @ w


def remove_shared_factor(df: DataFrame, bits: str, n: int) -> DataFrame:
    """Residual of each feature on the others, divided by its deviation."""
    _, mean, cov = moments(df, bits, n)
    w, off = cross_prediction(mean, cov)
    r = np.eye(n) - w
    sd = np.sqrt(np.maximum(np.einsum("ji,jk,ki->i", r, cov, r), 0))
    sd[sd < 1e-12] = 1
    return df.withColumn(bits, affine(bits, r / sd, -off / sd))


def remove_first_component(df: DataFrame, bits: str, n: int) -> DataFrame:
    """The first principal component of the cross prediction taken out of the features."""
    _, mean, cov = moments(df, bits, n)
    w, _ = cross_prediction(mean, cov)
    v = np.linalg.eigh(w.T @ cov @ w)[1][:, -1]
    p = np.eye(n) - np.outer(v, v)
    return df.withColumn(bits, affine(bits, p, mean - mean @ p))


def robust_regression(df: DataFrame, bits: str, n: int, rounds: int = 3) -> DataFrame:
    """Rows scaled by the mean of their robust version, in which values far from the cross prediction are replaced by it.

    The line through (prediction, value) is refitted on the values within one residual deviation, a deterministic stand-in for random
    consensus fitting; each round is one aggregate.
    """
    _, mean, cov = moments(df, bits, n)
    w, off = cross_prediction(mean, cov)
    rows = df.withColumn("_p", affine(bits, w, off))
    r = np.eye(n) - w
    limit = np.sqrt(np.maximum(np.einsum("ji,jk,ki->i", r, cov, r), 0)).tolist()
    rows = rows.withColumn("_both", F.arrays_zip(F.col(bits).alias("x"), F.col("_p").alias("p")))
    slope, inter = [1.0] * n, [0.0] * n

    def line(p: Column, i: Column) -> Column:
        return p * F.element_at(A.literal(slope), i + 1) + F.element_at(A.literal(inter), i + 1)

    def inside(v: Column, i: Column) -> Column:
        return F.abs(v["x"] - line(v["p"], i)) <= F.element_at(A.literal(limit), i + 1)

    for _ in range(rounds):
        ok = lambda v: F.when(inside(v, F.col("bit")), v["x"])
        got = feature_aggregates(rows, "_both", n, k=lambda v: F.regr_slope(ok(v), v["p"]), c=lambda v: F.regr_intercept(ok(v), v["p"]))
        slope, inter = [1.0 if k is None else k for k in got["k"]], [0.0 if c is None else c for c in got["c"]]
    robust = F.transform("_both", lambda v, i: F.when(inside(v, i), v["x"]).otherwise(line(v["p"], i)))
    rows = rows.withColumn("_m", A.mean(robust))
    grand = rows.agg(F.avg("_m")).first()[0]
    return rows.withColumn(bits, A.let(F.col("_m"), lambda m: F.transform(bits, lambda x: x / m * F.lit(grand)))).drop("_p", "_m", "_both")


def quantile_matching(df: DataFrame, reference: DataFrame, bits: str, n: int, points: int = 100) -> DataFrame:
    """Each feature mapped so that its quantiles fall on the reference's; nulls become the feature's median first."""
    med = feature_aggregates(df, bits, n, med=F.median)["med"]
    filled = df.withColumn(bits, _each(bits, lambda x, m: F.coalesce(F.nanvl(x, m), m), med))
    points = max(2, min(points, df.count()))
    at = [k / (points - 1) for k in range(points)]
    q = {"q": lambda c: F.percentile(c, at)}
    own, ref = feature_aggregates(filled, bits, n, **q)["q"], feature_aggregates(reference, bits, n, **q)["q"]
    table = A.piecewise([list(q) for q in own], [list(q) for q in ref])
    return filled.withColumn(bits, F.transform(bits, lambda x, i: A.let(F.element_at(table, i + 1), lambda t: A.mapped(x, t))))


def zscore_matching(df: DataFrame, reference: DataFrame, bits: str, n: int, least: int = 25) -> DataFrame:
    """Each feature brought to the reference's median and deviation (both inside p5..p95 there); by the median alone if few rows are inside."""
    q = {"lo": lambda c: F.percentile(c, 0.05), "hi": lambda c: F.percentile(c, 0.95), "med": F.median, "sd": F.stddev_pop}
    own, ref = feature_aggregates(df, bits, n, **q), feature_aggregates(reference, bits, n, **q)

    def inside(d: DataFrame, s: dict) -> dict:
        at = lambda name: F.element_at(A.literal(s[name]), F.col("bit") + 1)
        kept = lambda v: F.when((v > at("lo")) & (v < at("hi")), v)
        return feature_aggregates(d, bits, n, c=lambda v: F.count(kept(v)), m=lambda v: F.median(kept(v)), d=lambda v: F.stddev_pop(kept(v)))

    a, b = inside(df, own), inside(reference, ref)
    enough = [x > least and y > least for x, y in zip(a["c"], b["c"], strict=True)]
    pick = lambda yes, no: [y if ok else x for ok, y, x in zip(enough, yes, no, strict=True)]
    shift = lambda x, m, d, k, c: (x - m) / F.nullif(d, F.lit(0.0)) * k + c
    return df.withColumn(bits, _each(bits, shift, own["med"], pick(own["sd"], [1.0] * n), pick(b["d"], [1.0] * n), pick(b["m"], ref["med"])))


def batch_scaling(df: DataFrame, by: str, bits: str, n: int) -> DataFrame:
    """Each feature of each batch scaled to the median over all batches; medians of values clipped at 1."""
    clipped = lambda c: F.median(F.greatest(c, F.lit(1.0)))
    whole = feature_aggregates(df, bits, n, med=clipped)["med"]
    own = grouped_feature_aggregates(df, by, bits, n, _own=clipped)
    scaled = F.transform(F.col(bits), lambda x, i: x * F.element_at(A.literal(whole), i + 1) / F.element_at(F.col("_own"), i + 1))
    return df.join(own, by).withColumn(bits, scaled).drop("_own")


def remove_linear_pattern(df: DataFrame, bits: str, n: int, by: str | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Per batch and feature: the plane in (x, y) fitted to the values within [p1, p99], removed, its mean kept. Closed form from sums."""
    keyed = df.withColumn("_g", F.col(by) if by else F.lit(0))
    bounds = grouped_feature_aggregates(keyed, "_g", bits, n, _lo=lambda c: F.percentile(c, 0.01), _hi=lambda c: F.percentile(c, 0.99))
    rows = keyed.join(bounds, "_g")
    bound = lambda name: F.element_at(F.col(name), F.col("bit") + 1)

    def sums(v: Column) -> Column:
        ok = (v >= bound("_lo")) & (v <= bound("_hi"))
        px, py, pv = (F.when(ok, c) for c in (F.col(x), F.col(y), v))
        return F.struct(
            F.avg(px).alias("mx"), F.avg(py).alias("my"), F.avg(pv).alias("mv"), F.covar_pop(px, px).alias("xx"), F.covar_pop(py, py).alias("yy"),
            F.covar_pop(px, py).alias("xy"), F.covar_pop(px, pv).alias("xv"), F.covar_pop(py, pv).alias("yv"),
        )

    fit = grouped_feature_aggregates(rows, "_g", bits, n, "_lo", "_hi", x, y, _f=sums)

    def corrected(v: Column, i: Column) -> Column:
        f = F.element_at(F.col("_f"), i + 1)
        det = F.nullif(f["xx"] * f["yy"] - f["xy"] * f["xy"], F.lit(0.0))
        kx = F.coalesce((f["xv"] * f["yy"] - f["yv"] * f["xy"]) / det, F.lit(0.0))
        ky = F.coalesce((f["yv"] * f["xx"] - f["xv"] * f["xy"]) / det, F.lit(0.0))
        # the plane over all rows of the batch, less its mean over them
        return v - kx * (F.col(x) - F.col("_ax")) - ky * (F.col(y) - F.col("_ay"))

    centre = keyed.groupBy("_g").agg(F.avg(x).alias("_ax"), F.avg(y).alias("_ay"))
    return keyed.join(fit, "_g").join(centre, "_g").withColumn(bits, F.transform(F.col(bits), corrected)).drop("_g", "_f", "_ax", "_ay")


def rank_features(df: DataFrame, bits: str) -> DataFrame:
    """Ordinal rank of each feature within its row, from 0, ties by position."""
    return df.withColumn(bits, A.ordinal_ranks(F.col(bits)))


def anova(df: DataFrame, by: str, bits: str, n: int) -> list[tuple[float, float]]:
    """(F statistic, eta squared) of each feature over the groups, from group sums."""
    g = long_form(df, bits, n, by).groupBy(by, "bit").agg(F.count(F.lit(1)).alias("c"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    got = g.groupBy("bit").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"), F.sum(F.col("s") * F.col("s") / F.col("c")).alias("b"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    rows = {r["bit"]: r for r in got.collect()}
    out = []
    for i in range(n):
        row = rows[i]
        grand = row["s"] ** 2 / row["c"]
        between, within, whole = row["b"] - grand, row["q"] - row["b"], row["q"] - grand
        out.append(((between / max(row["k"] - 1, 1)) / (within / max(row["c"] - row["k"], 1)) if within else float("inf"), between / (whole + 1e-6)))
    return out


def scale_for_classifier(df: DataFrame, reference: DataFrame, bits: str, n: int, how: str = "per_bit_equalscale", label: str = "label") -> DataFrame:
    """per_cell, per_bit_equalscale, per_bit_refscale, per_bit_fscale or none; a single measured row becomes the reference mean."""
    if how == "none":
        return df
    if how == "per_cell":
        spread = lambda c: F.nullif(A.norm(c) / F.sqrt(F.lit(float(n))), F.lit(0.0))
        return df.withColumn(bits, A.let(A.centred(F.col(bits)), lambda c: A.let(spread(c), lambda sd: F.transform(c, lambda v: v / sd))))
    if how not in ("per_bit_equalscale", "per_bit_refscale", "per_bit_fscale"):
        raise ValueError(f"unknown normalisation {how}")
    own, ref = (feature_aggregates(d, bits, n, m=F.avg, d=F.stddev_pop) for d in (df, reference))
    weight = [1.0] * n
    if how == "per_bit_refscale":
        weight = ref["d"]
    elif how == "per_bit_fscale":
        f = [v for v, _ in anova(reference, label, bits, n)]
        weight = [v / max(f) for v in f]
    if df.limit(2).count() == 1:
        return df.withColumn(bits, A.literal(ref["m"]))
    return df.withColumn(bits, _each(bits, lambda x, m, d, w: (x - m) / F.nullif(d, F.lit(0.0)) * w, own["m"], own["d"], weight))


def positive_robust_scale(df: DataFrame, bits: str, n: int, cell: str = "polyA", bit: str = "robustZ-iqr", library: str | None = None) -> DataFrame:
    """Rows by a library column (polyA), their L1 or L2 norm or not; then features by the spread of their positive values."""
    x = F.col(bits)
    if cell == "polyA":
        x = F.transform(x, lambda v: v / F.col(library))
    elif cell in ("L1", "L2"):
        size = A.total(F.transform(x, F.abs)) if cell == "L1" else A.norm(x)
        x = A.let(F.nullif(size, F.lit(0.0)), lambda t: F.transform(F.col(bits), lambda v: v / t))
    elif cell != "none":
        raise NotImplementedError(cell)
    rows = df.withColumn(bits, x)
    if bit == "none":
        return rows
    pos = lambda c: F.when(c > 0, c)
    s = feature_aggregates(rows, bits, n, med=lambda c: F.median(pos(c)), lo=lambda c: F.percentile(pos(c), 0.25), hi=lambda c: F.percentile(pos(c), 0.75), avg=lambda c: F.avg(pos(c)), sd=lambda c: F.stddev_pop(pos(c)))
    if bit == "robustZ-iqr":
        mid, wide = s["med"], [h - lo for h, lo in zip(s["hi"], s["lo"], strict=True)]
    elif bit == "robustZ-mad":
        off = lambda v: F.median(F.abs(pos(v) - F.element_at(A.literal(s["med"]), F.col("bit") + 1)))
        mid, wide = s["med"], feature_aggregates(rows, bits, n, mad=off)["mad"]
    elif bit == "z-score":
        mid, wide = s["avg"], s["sd"]
    else:
        raise NotImplementedError(bit)
    return rows.withColumn(bits, _each(bits, lambda v, m, w: (v - m) / F.nullif(w, F.lit(0.0)), mid, wide))


def harmonise(df: DataFrame, reference: DataFrame, bits: str, n: int) -> DataFrame:
    """Feature medians scaled to the reference's, row sums to its mean row sum, then median and deviation of each feature to the reference's."""
    ref = feature_aggregates(reference, bits, n, med=F.median, sd=F.stddev_pop)
    own = feature_aggregates(df, bits, n, med=F.median)
    step = df.withColumn(bits, _each(bits, lambda x, a, b: x * b / F.nullif(a, F.lit(0.0)), own["med"], ref["med"]))
    total = reference.agg(F.avg(A.total(F.col(bits)))).first()[0]
    step = step.withColumn(bits, A.let(F.nullif(A.total(F.col(bits)), F.lit(0.0)), lambda t: F.transform(bits, lambda x: x * F.lit(total) / t)))
    now = feature_aggregates(step, bits, n, med=F.median, sd=F.stddev_pop)
    return step.withColumn(bits, _each(bits, lambda x, m, d, rm, rd: ((x - m) / F.nullif(d, F.lit(0.0)) + rm) * rd, now["med"], now["sd"], ref["med"], ref["sd"]))


def harmonise_by_group(df: DataFrame, reference: DataFrame, bits: str, n: int, label: str = "label", section: str = "section", points: int = 21) -> DataFrame:
    """Each (label, section) group's features mapped on the quantiles of the reference cells of that label; labels that the reference lacks stay as they are.

    Quantile tables of both sides are aggregates; rows are mapped by expressions, so that no group has to fit into a task.
    """
    at = [k / (points - 1) for k in range(points)]
    q = lambda v: F.percentile(v, at)
    own = grouped_feature_aggregates(df.withColumn("_ls", F.struct(label, section)), "_ls", bits, n, _own=q).select("_ls.*", "_own")
    ref = grouped_feature_aggregates(reference, label, bits, n, _ref=q)
    rows = df.join(own, [label, section]).join(ref, label, "left")

    def mapped(x: Column, i: Column) -> Column:
        a, b = F.element_at(F.col("_own"), i + 1), F.element_at(F.col("_ref"), i + 1)
        k = F.greatest(F.lit(1), F.least(F.size(F.filter(a, lambda t: t < x)), F.lit(points - 1)))
        x0, x1, y0, y1 = F.element_at(a, k), F.element_at(a, k + 1), F.element_at(b, k), F.element_at(b, k + 1)
        return F.when(F.col("_ref").isNull(), x).when(x1 == x0, x - x0 + y0).otherwise(y0 + (x - x0) * (y1 - y0) / (x1 - x0))

    return rows.withColumn(bits, F.transform(F.col(bits), mapped)).drop("_own", "_ref")


def diagonal_order(m: np.ndarray, threshold: float | None = None) -> tuple[list[int], list[int]]:
    """Row and column order that brings the largest entries of a small matrix to the diagonal, greedily."""
    left, rows, cols = m.astype(float).copy(), [], []
    for _ in range(min(m.shape)):
        i, j = np.unravel_index(np.argmax(left), left.shape)
        if threshold is not None and left[i, j] < threshold:
            break
        rows.append(int(i)), cols.append(int(j))
        left[i, :], left[:, j] = -np.inf, -np.inf
    return rows + [i for i in range(m.shape[0]) if i not in rows], cols + [j for j in range(m.shape[1]) if j not in cols]

"""Normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweft.operators import normalize as Z
from cellweft.plans.fixtures import BITS, L, cells
from cellweft.plans.registry import R, long, query, r6

WL = "WITH " + L + " "
#: The reference side of matching operators: cells of even type, as DuckDB's f.
REF = ", f AS (SELECT * FROM l WHERE type_ix % 2 = 0)"


def _reference(spark, sf):
    return cells(spark, sf).filter("type_ix % 2 = 0")


@query(WL + "SELECT id, bit, " + R("(v - m) / nullif(d, 0)") + " FROM l JOIN (SELECT bit, median(v) AS m, stddev_pop(v) AS d FROM l GROUP BY 1) USING (bit)")
def norm_zscore(spark, sf):
    return long(Z.zscore(cells(spark, sf), "bits", BITS), "id")


@query(WL + "SELECT id, bit, " + R("CASE WHEN w = 0 THEN 0 ELSE (v - m) / w END") + " FROM l JOIN (SELECT bit, median(v) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS w FROM l GROUP BY 1) USING (bit)")
def norm_iqr(spark, sf):
    return long(Z.iqr_scale(cells(spark, sf), "bits", BITS), "id")


@query(WL + ", m AS (SELECT bit, quantile_disc(v, 0.5) AS m FROM l GROUP BY 1), d AS (SELECT id, bit, v - m AS v FROM l JOIN m USING (bit)), s AS (SELECT bit, quantile_disc(abs(v), 0.5) AS s FROM d GROUP BY 1) SELECT id, bit, " + R("v / s") + " FROM d JOIN s USING (bit)")
def norm_robust_zscore(spark, sf):
    return long(Z.robust_zscore(cells(spark, sf), "bits", BITS), "id")


@query(WL + "SELECT id, bit, " + R("(v - a) / (b - a)") + " FROM l JOIN (SELECT bit, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM l GROUP BY 1) USING (bit)")
def norm_quantile_scale(spark, sf):
    return long(Z.quantile_scale(cells(spark, sf), "bits", BITS), "id")


@query(WL + REF + ", q AS (SELECT bit, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM l GROUP BY 1), p AS (SELECT bit, quantile_cont(v, 0.05) AS c, quantile_cont(v, 0.95) AS d FROM f GROUP BY 1) SELECT id, bit, " + R("(v - a) / (b - a) * (d - c) + c") + " FROM l JOIN q USING (bit) JOIN p USING (bit)")
def norm_linear_transform(spark, sf):
    return long(Z.linear_transform(cells(spark, sf), _reference(spark, sf), "bits", BITS), "id")


@query(WL + ", s AS (SELECT id, sum(v) AS s FROM l GROUP BY 1) SELECT id, bit, " + R("v / s * (SELECT median(s) FROM s)") + " FROM l JOIN s USING (id)")
def norm_library_size(spark, sf):
    return long(Z.library_size(cells(spark, sf), "bits"), "id")


@query(WL + "SELECT id, bit, " + R("greatest(v, 0) / greatest(sum(greatest(v, 0)) OVER (PARTITION BY id), 1e-10)") + " FROM l")
def norm_cell_shares(spark, sf):
    return long(Z.cell_shares(cells(spark, sf), "bits"), "id")


@query(WL + ", s AS (SELECT id, sum(greatest(v, 0)) AS s FROM l GROUP BY 1) SELECT id, bit, " + R("greatest(v, 0) / s * (SELECT avg(s) FROM s)") + " FROM l JOIN s USING (id)")
def norm_cell_to_mean(spark, sf):
    return long(Z.cell_shares(cells(spark, sf), "bits", to_mean=True), "id")


@query(WL + "SELECT id, bit, " + R("log10(greatest(v, 0) + 1) / sum(log10(greatest(v, 0) + 1)) OVER (PARTITION BY id)") + " FROM l")
def norm_cell_log(spark, sf):
    return long(Z.cell_shares(cells(spark, sf), "bits", log=True), "id")


@query(WL + "SELECT id, bit, " + R("log10(v + 1) - median(log10(v + 1)) OVER (PARTITION BY id)") + " FROM l")
def norm_log_row_median(spark, sf):
    return long(Z.log_row_median(cells(spark, sf), "bits"), "id")


_LOGS = ", s AS (SELECT id, log10(sum(greatest(v, 1))) AS c FROM l GROUP BY 1), d AS (SELECT id, bit, log10(greatest(v, 1)) AS v, c FROM l JOIN s USING (id)), k AS (SELECT bit, regr_slope(v, c) AS k, regr_intercept(v, c) AS i, avg(v) AS m FROM d GROUP BY 1) "


@query(WL + _LOGS + "SELECT id, bit, " + R("pow(10, v - (i + k * c))") + " FROM d JOIN k USING (bit)")
def norm_log_regress(spark, sf):
    return long(Z.regress(cells(spark, sf), "bits", BITS), "id")


@query(WL + _LOGS + "SELECT id, bit, " + R("pow(10, v - (i + k * c) + m)") + " FROM d JOIN k USING (bit)")
def norm_log_regress_to_mean(spark, sf):
    return long(Z.regress(cells(spark, sf), "bits", BITS, to_mean=True), "id")


@query(WL + ", d AS (SELECT id, bit, v, sum(v) OVER (PARTITION BY id) AS c FROM l), k AS (SELECT bit, regr_slope(v, c) AS k, regr_intercept(v, c) AS i, avg(v) AS m FROM d GROUP BY 1) SELECT id, bit, " + R("v / (i + k * c) * m") + " FROM d JOIN k USING (bit)")
def norm_regress_to_mean(spark, sf):
    return long(Z.regress(cells(spark, sf), "bits", BITS, log=False), "id")


@query(WL + REF + ", d AS (SELECT id, bit, log10(greatest(v, 1)) AS v, log10(median(greatest(v, 1)) OVER (PARTITION BY id)) AS c, type_ix FROM l), k AS (SELECT bit, regr_slope(v, c) AS k, regr_intercept(v, c) AS i FROM d WHERE type_ix % 2 = 0 GROUP BY 1) SELECT id, bit, " + R("v - (i + k * c)") + " FROM d JOIN k USING (bit)")
def norm_regress_fitted_on_subset(spark, sf):
    return long(Z.regress(cells(spark, sf), "bits", BITS, value="median", leave_log=True, fit=_reference(spark, sf)), "id")


@query(WL + ", g AS (SELECT bit, median(greatest(v, 1)) AS g FROM l GROUP BY 1), s AS (SELECT bit, section, median(greatest(v, 1)) AS s FROM l GROUP BY 1, 2) SELECT id, bit, " + R("v * g / s") + " FROM l JOIN g USING (bit) JOIN s USING (bit, section)")
def norm_batch_scaling(spark, sf):
    return long(Z.batch_scaling(cells(spark, sf), "section", "bits", BITS), "id")


@query(
    WL + ", q AS (SELECT bit, section, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM l GROUP BY 1, 2), i AS (SELECT * FROM l JOIN q USING (bit, section) WHERE v BETWEEN lo AND hi), "
    "m AS (SELECT bit, section, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv FROM i GROUP BY 1, 2), "
    "k AS (SELECT bit, section, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS kx, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS ky FROM m), a AS (SELECT section, avg(x) AS ax, avg(y) AS ay FROM c GROUP BY 1) "
    "SELECT id, bit, " + R("v - kx * (x - ax) - ky * (y - ay)") + " FROM l JOIN k USING (bit, section) JOIN a USING (section)"
)
def norm_linear_pattern(spark, sf):
    return long(Z.remove_linear_pattern(cells(spark, sf), "bits", BITS, "section"), "id")


@query(WL + REF + ", a AS (SELECT bit, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi, median(v) AS m, stddev_pop(v) AS d FROM l GROUP BY 1), r AS (SELECT bit, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM f GROUP BY 1), t AS (SELECT f.bit, median(v) AS rm, stddev_pop(v) AS rd FROM f JOIN r USING (bit) WHERE v > lo AND v < hi GROUP BY 1) SELECT id, bit, " + R("(v - m) / d * rd + rm") + " FROM l JOIN a USING (bit) JOIN t USING (bit)")
def norm_zscore_matching(spark, sf):
    return long(Z.zscore_matching(cells(spark, sf), _reference(spark, sf), "bits", BITS), "id")


@query()
def norm_quantile_matching(spark, sf):
    return long(Z.quantile_matching(cells(spark, sf), _reference(spark, sf), "bits", BITS), "id")


@query()
def norm_shared_factor(spark, sf):
    return long(Z.remove_shared_factor(cells(spark, sf), "bits", BITS), "id")


@query()
def norm_first_component(spark, sf):
    return long(Z.remove_first_component(cells(spark, sf), "bits", BITS), "id")


@query()
def norm_robust_regression(spark, sf):
    return long(Z.robust_regression(cells(spark, sf), "bits", BITS), "id")


@query(WL + REF + ", a AS (SELECT bit, avg(v) AS m, stddev_pop(v) AS d FROM l GROUP BY 1), b AS (SELECT bit, stddev_pop(v) AS rd FROM f GROUP BY 1) SELECT id, bit, " + R("(v - m) / d * rd") + " FROM l JOIN a USING (bit) JOIN b USING (bit)")
def norm_classifier_refscale(spark, sf):
    return long(Z.scale_for_classifier(cells(spark, sf), _reference(spark, sf), "bits", BITS, "per_bit_refscale"), "id")


@query(WL + ", a AS (SELECT bit, avg(v) AS m, stddev_pop(v) AS d FROM l GROUP BY 1), n AS (SELECT count(*) AS n, count(DISTINCT type_ix) AS k FROM c), g AS (SELECT bit, type_ix, avg(v) AS m, count(*) AS n FROM l GROUP BY 1, 2), w AS (SELECT bit, sum((v - g.m) * (v - g.m)) AS w FROM l JOIN g USING (bit, type_ix) GROUP BY 1), b AS (SELECT bit, sum(g.n * (g.m - a.m) * (g.m - a.m)) AS b FROM g JOIN a USING (bit) GROUP BY 1), f AS (SELECT bit, (b / (k - 1)) / (w / (n - k)) AS f FROM b JOIN w USING (bit), n) SELECT id, bit, " + R("(v - m) / d * f / (SELECT max(f) FROM f)") + " FROM l JOIN a USING (bit) JOIN f USING (bit)")
def norm_classifier_fscale(spark, sf):
    d = cells(spark, sf)
    return long(Z.scale_for_classifier(d, d, "bits", BITS, "per_bit_fscale", "type_ix"), "id")


@query(WL + "SELECT id, bit, " + R("(v - avg(v) OVER (PARTITION BY id)) / stddev_pop(v) OVER (PARTITION BY id)") + " FROM l")
def norm_classifier_per_cell(spark, sf):
    d = cells(spark, sf)
    return long(Z.scale_for_classifier(d, d, "bits", BITS, "per_cell"), "id")


@query(WL + ", s AS (SELECT id, bit, v / sum(abs(v)) OVER (PARTITION BY id) AS v FROM l), q AS (SELECT bit, median(v) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS w FROM s WHERE v > 0 GROUP BY 1) SELECT id, bit, " + R("(v - m) / w") + " FROM s JOIN q USING (bit)")
def norm_positive_robust(spark, sf):
    return long(Z.positive_robust_scale(cells(spark, sf), "bits", BITS, "L1", "robustZ-iqr"), "id")


@query()
def norm_harmonise(spark, sf):
    return long(Z.harmonise(cells(spark, sf), _reference(spark, sf), "bits", BITS), "id")


@query(WL + "SELECT bit, " + R("stddev_samp(v)", "sd") + ", " + R("corr(v, x)", "rx") + " FROM l GROUP BY 1")
def feature_moments(spark, sf):
    d = cells(spark, sf)
    s = d.agg(F.array(*[F.struct(F.stddev_samp(F.col("bits")[i]).alias("sd"), F.corr(F.col("bits")[i], "x").alias("rx")) for i in range(BITS)]).alias("s"))
    return s.select(F.posexplode("s").alias("bit", "s")).select("bit", r6("s.sd").alias("sd"), r6("s.rx").alias("rx"))

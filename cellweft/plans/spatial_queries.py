"""Geometry, rasters, volumes, registration, classification, design."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cellweft.operators import classify as K
from cellweft.operators import design, environments, spatial, stats
from cellweft.operators import neighbours as N
from cellweft.operators import normalize as Z
from cellweft.plans.fixtures import BITS, C, G, L, cells, grid, read
from cellweft.plans.registry import R, long, query, r6

W = "WITH " + C + " "
WL = "WITH " + L + " "


@query()
def delaunay_edges(spark, sf):
    return spatial.spatial_graph(cells(spark, sf), 3.0)


@query()
def voronoi_areas(spark, sf):
    return spatial.voronoi_polygons(cells(spark, sf), 0.95).select("section", "id", r6("area").alias("area"))


_SQUARES = [(1, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"), (2, "POLYGON ((-2 -2, 2 -2, 2 0, -2 0, -2 -2), (-1 -1.5, 1 -1.5, 1 -0.5, -1 -0.5, -1 -1.5))")]


def _geoms(spark):
    return spark.createDataFrame(_SQUARES, "unit_id int, wkt string")


@query(W + "SELECT id, 1 AS unit_id FROM c WHERE x >= 0 AND x < 1 AND y >= 0 AND y < 1 UNION ALL SELECT id, 2 FROM c WHERE x >= -2 AND x < 2 AND y >= -2 AND y < 0 AND NOT (x >= -1 AND x < 1 AND y >= -1.5 AND y < -0.5)")
def points_in_polygons(spark, sf):
    return spatial.points_in_polygons(cells(spark, sf), _geoms(spark), cell=1.0)


@query("SELECT * FROM (VALUES (1, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), (2, -2.0, 2.0, -2.0, 0.0)) t(unit_id, x0, x1, y0, y1)")
def polygon_bounds(spark, sf):
    return spatial.bounding_boxes(_geoms(spark))


@query("SELECT * FROM (VALUES (1, 0, 5::BIGINT), (2, 0, 5::BIGINT), (2, 1, 5::BIGINT)) t(unit_id, ring, n)")
def polygon_vertices(spark, sf):
    return spatial.vertices(_geoms(spark)).groupBy("unit_id", "ring").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 1 AS zone, 2.0::DOUBLE AS area")
def dissolve_polygons(spark, sf):
    g = spark.createDataFrame([(1, 1, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"), (1, 2, "POLYGON ((1 0, 2 0, 2 1, 1 1, 1 0))")], "zone int, unit_id int, wkt string")
    d = spatial.vertices(spatial.dissolve(g, "zone"))
    a = F.col("p")["x"] * F.col("q")["y"] - F.col("q")["x"] * F.col("p")["y"]
    v = d.groupBy("zone", "ring").agg(F.array_sort(F.collect_list(F.struct("ix", "x", "y"))).alias("v"))
    e = v.select("zone", F.explode(F.arrays_zip(F.slice("v", 1, F.size("v") - 1).alias("p"), F.slice("v", 2, F.size("v") - 1).alias("q"))).alias("z")).select("zone", "z.p", "z.q")
    return e.groupBy("zone").agg(F.abs(F.sum(a) / 2).alias("area"))


@query(W + "SELECT section, " + R("0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))", "angle") + " FROM c GROUP BY 1")
def principal_angle(spark, sf):
    return spatial.principal_angle(cells(spark, sf)).withColumn("angle", r6("angle"))


@query(W + ", m AS (SELECT section, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t FROM c GROUP BY 1) SELECT id, " + R("(x - mx) * cos(t) + (y - my) * sin(t)", "x") + ", " + R("(y - my) * cos(t) - (x - mx) * sin(t)", "y") + " FROM c JOIN m USING (section)")
def principal_rotation(spark, sf):
    return spatial.principal_rotation(cells(spark, sf)).select("id", r6("x").alias("x"), r6("y").alias("y"))


_RASTER = ", b AS (SELECT min(x) AS bx, min(y) AS b0 FROM c), r AS (SELECT c.*, floor((x - bx) / 0.5)::INT AS col, floor((y - b0) / 0.5)::INT AS row FROM c, b)"


@query(W + _RASTER + " SELECT row, col, count(*) AS value FROM r GROUP BY 1, 2")
def raster_count(spark, sf):
    return spatial.point_raster(cells(spark, sf), 0.5)


@query(W + _RASTER + " SELECT row, col, " + R("avg(type_ix)", "value") + " FROM r GROUP BY 1, 2")
def raster_mean(spark, sf):
    return spatial.point_raster(cells(spark, sf), 0.5, "type_ix", "avg").withColumn("value", r6("value"))


@query(W + _RASTER + ", n AS (SELECT row, col, type_ix, count(*) AS n FROM r GROUP BY 1, 2, 3) SELECT row, col, arg_min(type_ix, -n * 1000 + type_ix) AS category, max(n) AS value FROM n GROUP BY 1, 2")
def raster_category(spark, sf):
    return spatial.commonest_category(cells(spark, sf), 0.5, "type_ix")


@query(W + _RASTER + ", n AS (SELECT row, col, count(*) AS v FROM r GROUP BY 1, 2) SELECT row // 2 AS row, col // 2 AS col, " + R("avg(v)", "value") + " FROM n GROUP BY 1, 2")
def raster_blocks(spark, sf):
    d = spatial.block_aggregate(spatial.point_raster(cells(spark, sf), 0.5), 2)
    return d.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), r6("value").alias("value"))


_KERNEL = ", k AS (SELECT i, exp(-0.5 * i * i) / sum(exp(-0.5 * i * i)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS i)), n AS (SELECT row, col, count(*)::DOUBLE AS v FROM r GROUP BY 1, 2), s AS (SELECT row + p.i AS row, col + q.i AS col, sum(v * p.w * q.w) AS v, sum(p.w * q.w) AS m FROM n, k p, k q GROUP BY 1, 2)"


@query(W + _RASTER + _KERNEL + " SELECT row::INT AS row, col::INT AS col, " + R("s.v / m", "value") + " FROM s JOIN n USING (row, col)")
def raster_smooth_skipping(spark, sf):
    d = spatial.smooth(spatial.point_raster(cells(spark, sf), 0.5), 1.0)
    return d.withColumn("value", r6("value"))


@query(W + _RASTER + _KERNEL + " SELECT row::INT AS row, col::INT AS col, " + R("v", "value") + " FROM s")
def raster_kde(spark, sf):
    return spatial.smooth(spatial.point_raster(cells(spark, sf), 0.5), 1.0, normalised=False).withColumn("value", r6("value"))


@query(W + _RASTER + ", n AS (SELECT DISTINCT row, col FROM r), d AS (SELECT DISTINCT row + i AS row, col + j AS col FROM n, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) SELECT row::INT AS row, col::INT AS col FROM (SELECT d.row + i AS row, d.col + j AS col FROM d, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) GROUP BY 1, 2 HAVING count(*) = 9")
def raster_closing(spark, sf):
    return spatial.closing(spatial.point_raster(cells(spark, sf), 0.5), 1).select("row", "col")


@query()
def raster_outlines(spark, sf):
    r = spatial.commonest_category(cells(spark, sf), 1.0, "type_ix")
    return spatial.raster_outlines(r.select("row", "col", F.col("category").alias("value")))


@query()
def raster_segments(spark, sf):
    return spatial.threshold_segments(spatial.point_raster(cells(spark, sf), 0.5), 1)


@query("SELECT l_linenumber AS row, l_suppkey % 10 AS col, round(arg_min(l_extendedprice, l_partkey * 1000000 + l_suppkey), 2) AS value, min(l_partkey) AS tile FROM (SELECT l_linenumber, l_suppkey, l_partkey, min(l_extendedprice) AS l_extendedprice FROM lineitem WHERE l_discount <> 0 GROUP BY ALL) GROUP BY 1, 2")
def mosaic_first_writer(spark, sf):
    p = read(spark, sf, "lineitem").filter("l_discount <> 0").groupBy("l_linenumber", "l_suppkey", "l_partkey").agg(F.min("l_extendedprice").alias("value"))
    p = p.groupBy(F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 10).alias("col"), F.col("l_partkey").alias("tile")).agg(F.min_by("value", "l_suppkey").alias("value"))
    return spatial.first_writer_mosaic(p.withColumn("guide", F.lit(1))).withColumn("value", F.round("value", 2))


@query("SELECT o_custkey AS label, count(*) AS size, " + R("avg(o_orderkey % 100)", "y") + ", " + R("quantile_disc(o_totalprice, 0.5)", "b0") + " FROM orders WHERE o_custkey <> 0 GROUP BY 1 HAVING quantile_disc(o_totalprice, 0.5) > 100")
def cells_from_pixels(spark, sf):
    p = read(spark, sf, "orders").select(F.col("o_custkey").alias("label"), (F.col("o_orderkey") % 100).alias("row"), (F.col("o_orderkey") % 7).alias("col"), F.col("o_totalprice").alias("b"), F.lit(1.0).alias("dapi"))
    d = spatial.cells_from_pixels(p, ["b"])
    return d.select("label", "size", r6("y").alias("y"), r6(F.col("bits")[0]).alias("b0"))


def _voxels(spark, sf):
    """Cells as voxels of a small volume."""
    at = lambda c: F.floor((F.col(c) + 4) * 2).cast("int")
    z = (F.col("id") % 3).cast("int")
    return cells(spark, sf).groupBy(z.alias("zi"), at("y").alias("yi"), at("x").alias("xi")).agg(F.min("type_ix").cast("long").alias("id"))


_VOXELS = ", v AS (SELECT (id % 3)::INT AS zi, floor((y + 4) * 2)::INT AS yi, floor((x + 4) * 2)::INT AS xi, min(type_ix)::BIGINT AS id FROM c GROUP BY 1, 2, 3)"


@query(W + _VOXELS + " SELECT DISTINCT a.zi, a.yi, a.xi, a.id FROM v a JOIN v b ON abs(a.zi - b.zi) <= 1 AND abs(a.yi - b.yi) <= 1 AND abs(a.xi - b.xi) <= 1 AND b.id <> 0 AND a.id <> b.id")
def volume_borders(spark, sf):
    return spatial.border_voxels(_voxels(spark, sf))


@query(W + _VOXELS + " SELECT zi, yi, xi, CASE WHEN id > 5 THEN 0 ELSE id END AS id FROM v")
def volume_known(spark, sf):
    return spatial.known_volume(_voxels(spark, sf), spark.range(6)).select("zi", "yi", "xi", F.col("id").cast("long").alias("id"))


@query()
def volume_labels(spark, sf):
    return spatial.labelled_volume(_voxels(spark, sf))


@query(W + ", a AS (SELECT id, greatest(0, least(trunc((x + 4) * 1000 / 500)::INT, 15)) AS xi, greatest(0, least(trunc((y + 4) * 1000 / 500)::INT, 15)) AS yi FROM c), v AS (SELECT DISTINCT xi, yi, (xi + yi) % 25 AS pid FROM a) SELECT a.id, CASE WHEN pid = 0 THEN 997 ELSE pid END::BIGINT AS parcel_id, n_name AS name FROM a JOIN v USING (xi, yi) LEFT JOIN nation ON n_nationkey = CASE WHEN pid = 0 THEN 997 ELSE pid END")
def atlas_lookup(spark, sf):
    c = cells(spark, sf).select("id", (F.col("x") + 4).alias("x"), (F.col("y") + 4).alias("y"), F.lit(0.0).alias("z"))
    v = spark.range(256).select(F.lit(0).alias("zi"), F.floor(F.col("id") / 16).cast("int").alias("yi"), (F.col("id") % 16).cast("int").alias("xi")).withColumn("id", ((F.col("xi") + F.col("yi")) % 25).cast("long"))
    o = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("").alias("acronym"), F.col("n_name").alias("name"))
    return spatial.atlas_lookup(c, v, o, 500, (1, 16, 16)).select("id", "parcel_id", "name")


@query()
def spatial_prior(spark, sf):
    c = cells(spark, sf).withColumn("z", F.lit(0.0))
    p = spatial.spatial_prior(c.withColumnRenamed("type_ix", "label"), "label", 1.0, 1.0)
    return spatial.prior_of(c, p, 1.0, "label").withColumn("p", r6("p"))


@query(W + "SELECT id, " + R("((x - 1) * cos(radians(20)) - (y - 2) * sin(radians(20))) / 2 + 3", "x") + ", " + R("((x - 1) * sin(radians(20)) + (y - 2) * cos(radians(20))) / 2 + 4", "y") + " FROM c")
def register_rigid(spark, sf):
    d = spatial.rigid(cells(spark, sf), (1, 2), (3, 4), 20, 2)
    return d.select("id", r6("x").alias("x"), r6("y").alias("y"))


@query(W + "SELECT id, " + R("x * 1.1 + y * 0.2 + 3", "x") + ", " + R("x * -0.1 + y * 0.9 - 1", "y") + " FROM c")
def register_affine(spark, sf):
    return spatial.affine_points(cells(spark, sf), [[1.1, 0.2, 3], [-0.1, 0.9, -1]]).select("id", r6("x").alias("x"), r6("y").alias("y"))


@query()
def register_nonrigid(spark, sf):
    control = np.array([[0, 0], [1, 0], [0, 1], [1, 1.0], [0.5, 0.2]])
    w, eps = spatial.fit_multiquadric(control, control[:, 0] * 2 + 0.1 * control[:, 1] ** 2)
    return spatial.apply_multiquadric(cells(spark, sf), control, w, eps, "x", "y", "moved").select("id", r6("moved").alias("moved"))


@query(WL + "SELECT " + R("(xv * yy - yv * xy) / (xx * yy - xy * xy)", "a") + ", " + R("(yv * xx - xv * xy) / (xx * yy - xy * xy)", "b") + " FROM (SELECT var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv FROM l WHERE bit = 3)")
def register_plane(spark, sf):
    a, b, _ = spatial.fit_plane(cells(spark, sf).withColumn("v", F.col("bits")[3]), "x", "y", "v")
    return spark.createDataFrame([(a, b)], "a double, b double").select(r6("a").alias("a"), r6("b").alias("b"))


@query(W + ", h AS (SELECT id, x, (1 * y - 2 * x) > 0 AS h FROM c) SELECT id, CASE WHEN (SELECT avg(x) FILTER (h) < avg(x) FILTER (NOT h) FROM h) THEN NOT h ELSE h END AS hemi FROM h")
def hemispheres(spark, sf):
    return spatial.hemisphere(cells(spark, sf), (0, 0), (1, 2)).select("id", "hemi")


@query(W + ", f AS (SELECT unnest(range(-10, 10)) AS row), p AS (SELECT id, x, y, floor(x)::INT AS col, floor(y)::INT AS row FROM c) SELECT id, " + R("x + CASE WHEN col >= 0 AND col < 3 AND row >= 0 AND row < 3 THEN 0.5 ELSE 0 END", "x") + ", " + R("y - CASE WHEN col >= 0 AND col < 3 AND row >= 0 AND row < 3 THEN 0.25 ELSE 0 END", "y") + " FROM p")
def register_displacement(spark, sf):
    f = spark.range(9).select(F.floor(F.col("id") / 3).alias("row"), (F.col("id") % 3).alias("col"), F.lit(0.5).alias("dx"), F.lit(-0.25).alias("dy"))
    return spatial.displace(cells(spark, sf), f, 1.0).select("id", r6("x").alias("x"), r6("y").alias("y"))


# classification


def _labelled(spark, sf):
    return cells(spark, sf).withColumn("label", F.concat(F.lit("t"), F.col("type_ix").cast("string")))


@query()
def classify_knn(spark, sf):
    c = _labelled(spark, sf)
    return K.NearestNeighbours(5, "correlation").train(c.filter("id % 5 <> 0")).classify(c.filter("id % 5 = 0"))


@query()
def classify_logistic(spark, sf):
    c = _labelled(spark, sf)
    return K.logistic(10).train(c.filter("id % 5 <> 0")).classify(c.filter("id % 5 = 0"))


@query()
def classify_bayes_posterior(spark, sf):
    c = _labelled(spark, sf)
    p = K.gaussian_bayes().train(c.filter("id % 5 <> 0")).probabilities(c.filter("id % 5 = 0"))
    prior = c.filter("id % 5 = 0").select("id").join(F.broadcast(c.groupBy("label").count()), F.lit(True)).select("id", "label", (F.col("count") / 500.0).alias("p"))
    return K.posterior(p, prior).withColumn("p", F.round("p", 5))


@query()
def classify_iterative(spark, sf):
    c = _labelled(spark, sf).withColumn("class", (F.col("type_ix") % 2).cast("string"))
    return K.iterative_classify(c.filter("id % 5 <> 0"), c.filter("id % 5 = 0"), ["class", "label"], lambda: K.NearestNeighbours(3, "cosine"))


@query()
def classify_bagging(spark, sf):
    c = _labelled(spark, sf)
    return K.bagging(c.filter("id % 5 <> 0"), c.filter("id % 5 = 0"), lambda: K.NearestNeighbours(1, "cosine"))


@query()
def topic_model(spark, sf):
    c = cells(spark, sf)
    env = environments.environment_vector(environments.knn_environment(N.knn_plane(c, 10, include_self=True), c), 10)
    return K.topics(env, 10, np.geomspace(2, 100, 10).astype(int).tolist())[1].select("id", "topic")


@query()
def kmeans_regions(spark, sf):
    c = cells(spark, sf)
    env = environments.environment_vector(environments.knn_environment(N.knn_plane(c, 10, include_self=True), c), 10)
    return K.kmeans_regions(env, 5)


@query()
def merge_labels(spark, sf):
    return K.merge_labels(_labelled(spark, sf), BITS, groups=4)


@query("SELECT * FROM (VALUES ('n0', 1.5::DOUBLE), ('n1', 10.75::DOUBLE)) t(node, value)")
def dendrogram_average(spark, sf):
    d = spark.createDataFrame([("a", "b", "n0", 1.0), ("n0", "c", "n1", 2.0)], "A string, B string, C string, H double")
    v = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 29.25)], "leaf string, value double")
    return K.dendrogram_average(d, v)


@query("SELECT * FROM (VALUES ('a', 'n0'), ('b', 'n0'), ('c', 'c')) t(leaf, label)")
def dendrogram_cut(spark, sf):
    d = spark.createDataFrame([("a", "b", "n0", 1.0), ("n0", "c", "n1", 2.0)], "A string, B string, C string, H double")
    return K.dendrogram_cut(d, spark.createDataFrame([("a",), ("b",), ("c",)], "leaf string"), 1.5)


@query()
def projective_factors(spark, sf):
    c = cells(spark, sf)
    w = K.projective_nmf(K.second_moments(c, "bits", BITS), 3)
    return stats.reconstruction(c, "bits", w).select(F.round("r2", 4).alias("r2"))


@query()
def discriminant_factors(spark, sf):
    c = cells(spark, sf).withColumn("parent", F.col("type_ix") % 2)
    s = stats.between_class_scatter(c, ["parent", "type_ix"], "bits", BITS)
    w = K.projective_nmf(K.second_moments(c, "bits", BITS), 3, s, 10.0)
    return stats.reconstruction(c, "bits", w).select(F.round("r2", 4).alias("r2"))


@query()
def earth_mover(spark, sf):
    c = cells(spark, sf).select("id", F.transform("bits", lambda x: x / F.aggregate("bits", F.lit(0.0), lambda s, v: s + v)).alias("p"))
    cost = np.abs(np.subtract.outer(np.arange(BITS), np.arange(BITS))).astype(float)
    d = stats.emd(c.withColumn("q", F.reverse("p")), "p", "q", cost)
    return d.select("id", r6("emd").alias("emd"), r6(stats.emd_line(F.col("p"), F.col("q"))).alias("closed"))


@query()
def poisson_density(spark, sf):
    return stats.poisson_density(N.kth_distance(N.knn_plane(cells(spark, sf), 1), 1)).select(F.round("density", 4).alias("density"))


@query(
    "WITH " + L + ", s AS (SELECT id, log10(greatest(sum(v), 1)) AS l FROM l GROUP BY 1), m AS (SELECT median(l) AS m, stddev_pop(l) AS d FROM s) "
    "SELECT id, " + R("exp(-(l - m) / d * (l - m) / d / 2)", "qc_sum") + " FROM s, m"
)
def qc_score(spark, sf):
    return spatial.nuclear_score(cells(spark, sf), "bits", BITS).select("id", r6("qc_sum").alias("qc_sum"))


@query(
    "WITH " + L + ", a AS (SELECT id, bit, greatest(v, 1) / median(greatest(v, 1)) OVER (PARTITION BY bit) AS v FROM l), b AS (SELECT id, bit, v / median(v) OVER (PARTITION BY id) AS v FROM a), "
    "d AS (SELECT avg(d) AS d FROM (SELECT id, stddev_pop(v) AS d FROM b GROUP BY 1)), z AS (SELECT id, bit, (v - median(v) OVER (PARTITION BY id)) / (SELECT d FROM d) AS z FROM b) "
    "SELECT id, bit, " + R("exp(-z * z / 2)") + " FROM z"
)
def nuclear_scores(spark, sf):
    return long(spatial.nuclear_score(cells(spark, sf), "bits", BITS, "bits"), "id", bits="nuc_score")


def _image(spark, sf):  # noqa: ANN001, ANN202
    n, _ = grid(spark, sf)
    return n.select(F.lit(1).alias("image"), F.col("y").alias("row"), F.col("x").alias("col"), "value")


# pixels of the grid with 0 where its last row ends, and the values around each, borders mirrored
_IMAGE = (
    "WITH " + G + ", s AS (SELECT max(x) AS mx, max(y) AS my FROM g), i AS (SELECT r.y, c.x, coalesce(g.value, 0) AS v FROM s, (SELECT unnest(range(0, 1 + (SELECT my FROM s))) AS y) r, (SELECT unnest(range(0, 1 + (SELECT mx FROM s))) AS x) c LEFT JOIN g ON g.x = c.x AND g.y = r.y), "
    "w AS (SELECT i.y, i.x, j.v FROM i, s, (SELECT unnest([-1, 0, 1]) AS dy) a, (SELECT unnest([-1, 0, 1]) AS dx) b JOIN i j ON j.y = least(greatest(i.y + dy, 0), my) AND j.x = least(greatest(i.x + dx, 0), mx)) "
)


@query(_IMAGE + 'SELECT 1 AS image, y::INT AS "row", x::INT AS col, ' + R("quantile_disc(v, 0.5)", "value") + " FROM w GROUP BY y, x")
def image_median(spark, sf):
    return spatial.filter_images(_image(spark, sf), "median", 3).withColumn("value", r6("value"))


@query(_IMAGE + 'SELECT 1 AS image, y::INT AS "row", x::INT AS col, ' + R("min(v)", "value") + " FROM w GROUP BY y, x")
def image_minimum(spark, sf):
    return spatial.filter_images(_image(spark, sf), "minimum", 3).withColumn("value", r6("value"))


@query(_IMAGE + 'SELECT 1 AS image, y::INT AS "row", x::INT AS col, ' + R("list_sort(list(v))[7 + 1]", "value") + " FROM w GROUP BY y, x")
def image_percentile(spark, sf):
    return spatial.filter_images(_image(spark, sf), "percentile_80", 3).withColumn("value", r6("value"))


@query(_IMAGE + ', m AS (SELECT y, x, min(v) AS b FROM w GROUP BY y, x) SELECT 1 AS image, y::INT AS "row", x::INT AS col, ' + R("greatest(0, v - b)", "value") + " FROM i JOIN m USING (y, x)")
def image_background(spark, sf):
    return spatial.subtract_background(_image(spark, sf), None, ("minimum", 3)).withColumn("value", r6("value"))


# design


@query()
def melting_temperatures(spark, sf):
    from cellweft.functions.scalars import melting_temperature

    return design.random_sequences(spark, 50, 20, {"gc": (0.4, 0.6), "exclude": ["GGGG"]}, tries=2000).select("seq", F.round(melting_temperature(F.col("seq")), 4).alias("tm"))


@query()
def mutated_sequences(spark, sf):
    s = design.random_sequences(spark, 50, 20, tries=50)
    m = design.mutated(s.withColumn("old", F.col("seq")), 1)
    return m.select("id", F.levenshtein("old", "seq").alias("dist"))


@query("SELECT n_name AS seq FROM nation WHERE false")
def spaced_subset_conflicts(spark, sf):
    """Pairs of the chosen that are too close: none."""
    s = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("seq"))
    k = design.spaced_subset(s, 6)
    a, b = k.select(F.col("id").alias("a"), "seq"), k.select(F.col("id").alias("b"), F.col("seq").alias("other"))
    return a.join(b, (F.col("a") < F.col("b")) & (F.levenshtein("seq", "other") < 6)).select("seq")


@query("SELECT * FROM (VALUES (0, 'r1', 'E0xAAA'), (1, 'r1', 'E1xAAA'), (2, 'r2', 'E2xCCC')) t(ix, readout, seq)")
def allocate_readouts(spark, sf):
    e = spark.createDataFrame([(0, "E0"), (1, "E1"), (2, "E2"), (3, "E3")], "ix int, seq string")
    w = spark.createDataFrame([(0, "r1", "AAA", 2), (1, "r2", "CCC", 1)], "ix int, readout string, seq string, weight int")
    return design.allocate_readouts(e, w, "x")


@query("SELECT 0.75::DOUBLE AS precision, 0.8::DOUBLE AS usage, 0.6::DOUBLE AS recall")
def binding_summary(spark, sf):
    c = spark.createDataFrame([("r1", 1.0), ("r1+e1", 3.0), ("r1+e2", 1.0), ("e1", 2.0), ("r2+e2", 5.0)], "complex string, conc double")
    return design.binding_summary(c, "1").select(*[r6(x).alias(x) for x in ("precision", "usage", "recall")])


@query("SELECT p_brand, p_type, count(*) AS n, " + R("count(*) / sum(count(*)) OVER (PARTITION BY p_type)", "share") + " FROM part GROUP BY 1, 2")
def probe_pivot(spark, sf):
    return design.probe_pivot(read(spark, sf, "part"), "p_brand", "p_type").withColumn("share", r6("share"))


@query("SELECT p_partkey FROM part WHERE NOT regexp_matches(upper(p_name), 'AAAA|CCCC|TTTTT|GGGGG')")
def without_long_runs(spark, sf):
    return design.without_long_runs(read(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("seq"))).select("p_partkey")


@query()
def feature_covariance(spark, sf):
    n, mean, cov = Z.moments(cells(spark, sf), "bits", BITS)
    return spark.createDataFrame([(i, float(mean[i]), float(cov[i, i])) for i in range(BITS)], "bit int, mean double, var double").select("bit", r6("mean").alias("mean"), r6("var").alias("var"))

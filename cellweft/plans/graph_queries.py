"""Neighbours, environments and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweft.operators import environments as E
from cellweft.operators import graph as Gr
from cellweft.operators import neighbours as N
from cellweft.plans.fixtures import BITS, C, G, L, cells, grid
from cellweft.plans.registry import R, query, r6

W = "WITH " + C + " "
WG = "WITH RECURSIVE " + G + " "
D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def _knn(k: int, self_too: bool = False) -> str:
    other = "" if self_too else " AND a.id <> b.id"
    return f"n AS (SELECT a.id AS src, b.id AS dst, {D} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS rank FROM c a JOIN c b ON a.section = b.section{other}), k AS (SELECT * FROM n WHERE rank <= {k})"


@query(W + ", " + _knn(15, True) + ", m AS (SELECT src, t.type_ix AS nt, count(*) / 15.0::DOUBLE AS p FROM k JOIN c t ON t.id = dst GROUP BY 1, 2), h AS (SELECT src, -sum(p * log2(p)) AS h FROM m GROUP BY 1) SELECT type_ix, count(*) AS cells, " + R("avg(h)", "mean_h") + " FROM h JOIN c ON c.id = src GROUP BY 1")
def knn_composition_entropy(spark, sf):
    """The flagship: entropy of the types among each cell's 15 nearest, itself included, by type."""
    c = cells(spark, sf)
    env = E.knn_environment(N.knn_plane(c, 15, include_self=True), c)
    h = E.environment_entropy(env).join(c.select("id", "type_ix"), "id")
    return h.groupBy("type_ix").agg(F.count(F.lit(1)).alias("cells"), r6(F.avg("h")).alias("mean_h"))


@query(W + ", " + _knn(6) + " SELECT src, dst, " + R("dist", "dist") + ", rank FROM k")
def knn_plane(spark, sf):
    return N.knn_plane(cells(spark, sf), 6).select("src", "dst", r6("dist").alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(W + f"SELECT a.id AS src, b.id AS dst, {R(D, 'dist')} FROM c a JOIN c b ON a.section = b.section AND a.id <> b.id AND {D} <= 0.5 AND {D} > 0")
def radius_join(spark, sf):
    return N.radius_join(cells(spark, sf), 0.5).withColumn("dist", r6("dist"))


@query(W + ", " + _knn(6) + " SELECT src AS id, " + R("dist", "dist") + " FROM k WHERE rank = 6")
def local_density(spark, sf):
    return N.kth_distance(N.knn_plane(cells(spark, sf), 6), 6).withColumn("dist", r6("dist"))


_FEATURE = (
    "WITH " + L + ", d AS (SELECT a.id AS src, b.id AS dst, 1 - sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS dist FROM l a JOIN l b ON a.bit = b.bit AND a.id <> b.id GROUP BY 1, 2), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 12), dst) AS rank FROM d), k AS (SELECT * FROM n WHERE rank <= 5) "
)


@query(_FEATURE + "SELECT src, dst, " + R("dist", "dist") + ", rank FROM k")
def knn_features_cosine(spark, sf):
    c = cells(spark, sf)
    return N.knn_features(c, c, 5, "cosine").select("src", "dst", r6("dist").alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(_FEATURE + ", s AS (SELECT src, type_ix, count(*) AS n FROM k JOIN c ON c.id = dst GROUP BY 1, 2) SELECT src AS id, arg_min(type_ix, -n * 1000 + type_ix) AS label FROM s GROUP BY 1")
def knn_vote(spark, sf):
    c = cells(spark, sf)
    near = N.knn_features(c, c, 5, "cosine")
    return N.majority(N.vote(near, c.select("id", F.col("type_ix").alias("label"))))


@query(_FEATURE + ", m AS (SELECT k.src AS id, l.bit, avg(l.v) AS v FROM k JOIN l ON l.id = k.dst GROUP BY 1, 2) SELECT id, bit, " + R("v") + " FROM m")
def knn_imputation(spark, sf):
    c = cells(spark, sf)
    m = N.knn_mean(N.knn_features(c, c, 5, "cosine"), c, "bits", BITS)
    return m.select("id", F.posexplode("bits").alias("bit", "v")).withColumn("v", r6("v"))


@query(W + ", " + _knn(5) + " SELECT k.src AS a, k.dst AS b FROM k JOIN k j ON j.src = k.dst AND j.dst = k.src")
def mutual_neighbours(spark, sf):
    k = N.knn_plane(cells(spark, sf), 5)
    return N.mutual(k, k)


@query()
def knn_approximate(spark, sf):
    return N.knn_approximate(cells(spark, sf), 5, bucket=20.0).select("src", "dst", r6("dist").alias("dist"), "rank")


@query(W + ", " + _knn(3) + " SELECT src AS id, max(dst) FILTER (rank = 1) AS nn_1, max(dst) FILTER (rank = 2) AS nn_2, max(dst) FILTER (rank = 3) AS nn_3 FROM k GROUP BY 1")
def neighbour_columns(spark, sf):
    return N.neighbour_columns(N.knn_plane(cells(spark, sf), 3), 3)


@query(W + ", " + _knn(7, True) + ", s AS (SELECT src, dist AS d FROM k WHERE rank = 6) SELECT k.src AS id, t.type_ix, " + R("sum(exp(-(dist / d) * (dist / d)))", "n") + " FROM k JOIN s USING (src) JOIN c t ON t.id = dst GROUP BY 1, 2")
def gaussian_environment(spark, sf):
    c = cells(spark, sf)
    return E.knn_environment(N.knn_plane(c, 7, include_self=True), c, 1.0).withColumn("n", r6("n"))


# graphs on the grid of parts


@query(WG + "SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM u GROUP BY 1, 2")
def graph_simple_edges(spark, sf):
    _, e = grid(spark, sf)
    return Gr.simple_edges(Gr.both_ways(e))


_ZONE = ", s AS (SELECT u.src, u.dst FROM u JOIN g a ON a.id = u.src JOIN g b ON b.id = u.dst WHERE a.type_ix = b.type_ix), r AS (SELECT id, id AS lab FROM g UNION SELECT s.dst, r.lab FROM r JOIN s ON s.src = r.id WHERE r.lab < s.dst), z AS (SELECT id, min(lab) AS component FROM r GROUP BY 1) "


@query(WG + _ZONE + "SELECT id, component FROM z")
def graph_zones(spark, sf):
    n, e = grid(spark, sf)
    return Gr.same_type_components(e, n)


@query(WG + _ZONE + "SELECT min(component) AS first_id, count(*) AS node_size, " + R("avg(x)", "x") + ", " + R("avg(y)", "y") + ", any_value(type_ix) AS type_ix FROM z JOIN g USING (id) GROUP BY component")
def graph_contraction(spark, sf):
    n, e = grid(spark, sf)
    u, _, _ = Gr.contract_by_component(n, e)
    return u.select("first_id", "node_size", r6("x").alias("x"), r6("y").alias("y"), "type_ix")


@query(WG + _ZONE + "SELECT DISTINCT least(a.component, b.component) AS src, greatest(a.component, b.component) AS dst FROM e JOIN z a ON a.id = src JOIN z b ON b.id = dst WHERE a.component <> b.component")
def graph_quotient_edges(spark, sf):
    n, e = grid(spark, sf)
    return Gr.quotient_edges(e, Gr.same_type_components(e, n))


@query(WG + _ZONE + "SELECT id, n > 0.01 * (SELECT count(*) FROM g) AS in_large_comp FROM z JOIN (SELECT component, count(*) AS n FROM z GROUP BY 1) USING (component)")
def graph_large_components(spark, sf):
    n, e = grid(spark, sf)
    t = Gr.with_ends(e, n, "type_ix").filter("type_ix_src = type_ix_dst").select("src", "dst")
    return Gr.large_components(t, n, 0.01).select("id", "in_large_comp")


_HOPS = ", h1 AS (SELECT DISTINCT src, dst FROM u), h2 AS (SELECT a.src, b.dst FROM h1 a JOIN h1 b ON a.dst = b.src EXCEPT SELECT src, dst FROM h1 EXCEPT SELECT id, id FROM g), h AS (SELECT id AS src, id AS dst, 0 AS hop FROM g UNION ALL SELECT src, dst, 1 FROM h1 UNION ALL SELECT src, dst, 2 FROM h2) "


@query(WG + _HOPS + "SELECT src, dst, hop FROM h")
def graph_hops(spark, sf):
    n, e = grid(spark, sf)
    return Gr.hops(e, n, 2)


@query(WG + _HOPS + ", r AS (SELECT src, hop, avg(value) AS v FROM h JOIN g ON g.id = dst GROUP BY 1, 2) SELECT src AS id, " + R("sum(v * CASE hop WHEN 0 THEN 0.4 WHEN 1 THEN 0.3 ELSE 0.2 END::DOUBLE) / sum(CASE hop WHEN 0 THEN 0.4 WHEN 1 THEN 0.3 ELSE 0.2 END::DOUBLE)", "smooth") + " FROM r GROUP BY 1")
def graph_local_average(spark, sf):
    n, e = grid(spark, sf)
    return Gr.local_average(e, n, "value", 2, (0.4, 0.3, 0.2)).withColumn("smooth", r6("smooth"))


@query(WG + _HOPS + "SELECT src AS id, " + R("median(value)", "smooth") + " FROM h JOIN g ON g.id = dst GROUP BY 1")
def graph_local_median(spark, sf):
    n, e = grid(spark, sf)
    return Gr.local_median(e, n, "value", 2).withColumn("smooth", r6("smooth"))


@query(WG + _HOPS + "SELECT src AS id, type_ix, count(*) AS n FROM h JOIN g ON g.id = dst GROUP BY 1, 2")
def graph_environment(spark, sf):
    n, e = grid(spark, sf)
    return E.graph_environment(e, n, 2).select("id", "type_ix", F.col("n").cast("long").alias("n"))


@query(WG + "SELECT src AS id, type_ix, " + R("count(*) / sum(count(*)) OVER (PARTITION BY src)", "p") + " FROM u JOIN g ON g.id = dst GROUP BY 1, 2")
def graph_local_abundance(spark, sf):
    n, e = grid(spark, sf)
    return E.local_abundance(e, n).select("id", "type_ix", r6("p").alias("p"))


@query(WG + "SELECT least(a.type_ix, b.type_ix) AS a, greatest(a.type_ix, b.type_ix) AS b, count(*) AS n FROM e JOIN g a ON a.id = src JOIN g b ON b.id = dst GROUP BY 1, 2")
def graph_edge_types(spark, sf):
    n, e = grid(spark, sf)
    return Gr.edge_type_counts(e, n)


@query(WG + "SELECT src, dst FROM e JOIN g a ON a.id = src JOIN g b ON b.id = dst WHERE a.type_ix <> b.type_ix")
def graph_boundary_edges(spark, sf):
    n, e = grid(spark, sf)
    return Gr.boundary_edges(e, n, "type_ix").select("src", "dst")


@query(WG + ", d AS (SELECT src, dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM u JOIN g a ON a.id = src JOIN g b ON b.id = dst) SELECT g.id, " + R("avg(d)", "mean_length") + ", " + R("min(d)", "min_length") + " FROM g LEFT JOIN d ON d.src = g.id GROUP BY 1")
def graph_edge_lengths(spark, sf):
    n, e = grid(spark, sf)
    return Gr.edge_lengths(e, n).select("id", r6("mean_length").alias("mean_length"), r6("min_length").alias("min_length"))


_SLOPE = (
    W + f", e AS (SELECT a.id AS src, b.id AS dst, b.x - a.x AS dx, b.y - a.y AS dy, b.bits[3] - a.bits[3] AS dv FROM c a JOIN c b ON a.section = b.section AND a.id < b.id AND {D} <= 0.5 AND {D} > 0), "
    "s AS (SELECT src, dst, CASE WHEN dx = 0 OR dy = 0 THEN abs(dv) / sqrt(dx * dx + dy * dy) ELSE sqrt(pow(dv * cos(atan(dx / dy)) / dx, 2) + pow(dv * sin(atan(dx / dy)) / dy, 2)) END AS g, abs(dv) / sqrt(dx * dx + dy * dy) AS q FROM e), "
)


def _valued_cells(spark, sf):  # noqa: ANN001, ANN202
    return cells(spark, sf).withColumn("v", F.col("bits")[2])


@query(_SLOPE + "t AS (SELECT src AS id, g FROM s UNION ALL SELECT dst, g FROM s) SELECT id, round(avg(g), 4) AS gradient FROM t GROUP BY 1")
def graph_gradient(spark, sf):
    return Gr.gradient_within(_valued_cells(spark, sf), 0.5, "v").withColumn("gradient", F.round("gradient", 4))


@query(_SLOPE + "t AS (SELECT src AS id, g FROM s UNION ALL SELECT dst, -g FROM s) SELECT id, round(avg(g), 4) + 0.0 AS gradient FROM t GROUP BY 1")
def graph_gradient_signed(spark, sf):
    return Gr.gradient_within(_valued_cells(spark, sf), 0.5, "v", signed=True).withColumn("gradient", F.round("gradient", 4) + F.lit(0.0))


@query(_SLOPE + "t AS (SELECT src AS id, q FROM s UNION ALL SELECT dst, q FROM s) SELECT id, " + R("avg(q)", "gradient") + " FROM t GROUP BY 1")
def graph_gradient_along(spark, sf):
    return Gr.gradient_within(_valued_cells(spark, sf), 0.5, "v", slope="along").withColumn("gradient", r6("gradient"))


_PEAK = ", w AS (SELECT id, (id * 7919) % 1009 AS v FROM g), p AS (SELECT src AS id FROM u JOIN w a ON a.id = src JOIN w b ON b.id = dst GROUP BY 1 HAVING any_value(a.v) > max(b.v)) "


@query(WG + _PEAK + "SELECT id FROM p")
def graph_peaks(spark, sf):
    n, e = grid(spark, sf)
    return Gr.peaks(e, n.withColumn("v", F.col("id") * 7919 % 1009), "v")


@query(WG + _PEAK + ", b AS (SELECT id, id AS peak, 0 AS d FROM p UNION SELECT u.dst, b.peak, b.d + 1 FROM b JOIN u ON u.src = b.id WHERE b.d < 12) SELECT id, arg_min(peak, d * 100000000 + peak) AS peak, min(d) AS distance FROM b GROUP BY 1")
def graph_watershed(spark, sf):
    n, e = grid(spark, sf)
    return Gr.watershed(e, n.withColumn("v", F.col("id") * 7919 % 1009), "v").select("id", "peak", "distance")


@query(WG + _ZONE + ", n AS (SELECT component, count(*) AS n FROM z GROUP BY 1), q AS (SELECT DISTINCT a.component AS a, b.component AS b FROM u JOIN z a ON a.id = src JOIN z b ON b.id = dst WHERE a.component <> b.component), t AS (SELECT q.a, min(q.b) AS b FROM q JOIN n ON n.component = q.b AND n.n > 3 GROUP BY 1) SELECT n.component, CASE WHEN n.n <= 3 THEN coalesce(t.b, n.component) ELSE n.component END AS merged FROM n LEFT JOIN t ON t.a = n.component")
def graph_merge_small_zones(spark, sf):
    n, e = grid(spark, sf)
    return Gr.merge_small_zones(e, Gr.same_type_components(e, n), 3)


@query()
def graph_fill_small_zones(spark, sf):
    n, e = grid(spark, sf)
    return Gr.fill_small_zones(e, n, 4)


@query(WG + ", d AS (SELECT src, dst FROM e UNION ALL SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE b.dst = a.src + 41), o AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM d), t AS (SELECT x.a, x.b, y.b AS c FROM o x JOIN o y ON y.a = x.b JOIN o z ON z.a = x.a AND z.b = y.b) SELECT list_sort([p.type_ix, q.type_ix, r.type_ix])[1] AS t0, list_sort([p.type_ix, q.type_ix, r.type_ix])[2] AS t1, list_sort([p.type_ix, q.type_ix, r.type_ix])[3] AS t2, count(*) AS n FROM t JOIN g p ON p.id = a JOIN g q ON q.id = b JOIN g r ON r.id = c GROUP BY ALL")
def graph_triangle_types(spark, sf):
    n, e = grid(spark, sf)
    two = e.alias("a").join(e.alias("b").hint("merge"), F.col("a.dst") == F.col("b.src")).filter(F.col("b.dst") == F.col("a.src") + 41).select("a.src", "b.dst")
    t = Gr.triangle_type_counts(e.union(two), n)
    return t.select(*[F.col("types")[i].alias(f"t{i}") for i in range(3)], "n")


@query()
def graph_triplet_enrichment(spark, sf):
    n, e = grid(spark, sf)
    two = e.alias("a").join(e.alias("b").hint("merge"), F.col("a.dst") == F.col("b.src")).filter(F.col("b.dst") == F.col("a.src") + 41).select("a.src", "b.dst")
    t = Gr.triplet_enrichment(e.union(two), n)
    return t.select(*[F.col("types")[k].alias(f"t{k}") for k in range(3)], *[r6(c).alias(c) for c in ("obs", "expected", "enrichment", "p", "q")])


@query()
def graph_enrichment(spark, sf):
    n, e = grid(spark, sf)
    return Gr.edge_enrichment(e, n).select("a", "b", *[r6(c).alias(c) for c in ("obs", "expected", "enrichment", "p", "q")])


@query()
def graph_bridges(spark, sf):
    n, e = grid(spark, sf)
    return Gr.bridge_edges(e, n)


@query()
def graph_communities(spark, sf):
    n, e = grid(spark, sf)
    return Gr.communities(e, n, 0.5)


@query()
def graph_resolution_sweep(spark, sf):
    n, e = grid(spark, sf)
    return Gr.resolution_sweep(e, n, [0.2, 1.0])


@query()
def percolation(spark, sf):
    c = cells(spark, sf)
    return Gr.percolate(N.knn_plane(c, 6), c).withColumn("entropy", r6("entropy"))


@query()
def percolation_score(spark, sf):
    c = cells(spark, sf)
    p = Gr.percolate(N.knn_plane(c, 6), c)
    curve = lambda kind: p.filter(F.col("kind") == kind).drop("kind")
    return Gr.percolation_score(curve("real"), curve("permuted")).withColumn("score", r6("score"))


@query("SELECT 16::BIGINT AS zones")
def toy_grid_zones(spark, sf):
    """4 x 4 squares of alternating type: 16 zones of 4."""
    n, e = Gr.toy_grid(spark, 8, "grid", 2)
    return Gr.same_type_components(e, n).agg(F.countDistinct("component").alias("zones"))

"""Worked answers, invariants and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.functions import arrays as A
from cellweft.functions import scalars as S
from cellweft.operators import classify, design, environments, graph, neighbours, normalize, relational, spatial, stats
from cellweft.plans.dataset import Dataset, Taxonomy
from cellweft.sources import io
from cellweft.streaming import ingest


def rows(spark, data):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(data)], "id int, bits array<double>")


def bits(df):
    return [r["bits"] for r in df.orderBy("id").collect()]


def test_grid_and_corner_squares(spark):
    n, e = graph.toy_grid(spark, 8, "squares", 2)
    u, q, up = graph.contract_by_component(n, e)
    assert sorted(r["node_size"] for r in u.collect()) == [4, 4, 4, 4, 48]
    h = relational.conditional_entropy(u).first()
    assert np.allclose([h["h_zone"], h["h_type"], h["h_cond"]], [1.311278, 0.811278, 0.5], atol=1e-6)
    assert q.count() == 4 and up.count() == 64
    merged, _, _ = graph.contract_by_label(n, e, "type_ix")
    assert merged.count() == 2 and abs(relational.conditional_entropy(merged).first()["h_cond"]) < 1e-12
    n, e = graph.toy_grid(spark, 8, "grid", 2)
    assert graph.edge_type_counts(e, n).agg(F.sum("n")).first()[0] == e.count()


def test_components_of_a_long_path_and_isolated_nodes(spark):
    e = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    c = graph.components(e, spark.range(310))
    assert c.filter("id <= 300").select("component").distinct().count() == 1 and c.select("component").distinct().count() == 10


def test_watershed_on_a_path(spark):
    n = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 2.0), (3, 5.0), (4, 4.0)], "id long, v double")
    e = spark.range(4).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["id"] for r in graph.peaks(e, n, "v").collect()} == {1, 3}
    assert {r["id"]: r["peak"] for r in graph.watershed(e, n, "v").collect()} == {0: 1, 1: 1, 2: 1, 3: 3, 4: 3}


def test_library_size(spark):
    assert bits(normalize.library_size(rows(spark, [[1, 3], [2, 2], [8, 0]]), "bits")) == [[1, 3], [2, 2], [4, 0]]


def test_batch_scaling(spark):
    d = rows(spark, [[2], [4], [6], [8], [10], [12]]).withColumn("s", F.when(F.col("id") < 3, "A").otherwise("B"))
    assert np.allclose(bits(normalize.batch_scaling(d, "s", "bits", 1)), [[3.5], [7], [10.5], [5.6], [7], [8.4]])


def test_medians(spark):
    d = rows(spark, [[1], [2], [3], [4]])
    assert d.select(F.median(F.col("bits")[0])).first()[0] == 2.5
    assert np.allclose([r[0] for r in bits(normalize.robust_zscore(d, "bits", 1))], [-1, 0, 1, 2])
    assert spark.range(1).select(A.median(F.array(*[F.lit(float(x)) for x in (4, 1, 3, 2)]))).first()[0] == 2.5


def test_constant_columns(spark):
    d = rows(spark, [[5, 1], [5, 2], [5, 3]])
    assert [r[0] for r in bits(normalize.zscore(d, "bits", 2))] == [None] * 3
    assert [r[0] for r in bits(normalize.iqr_scale(d, "bits", 2))] == [0.0] * 3
    assert [r[0] for r in bits(normalize.robust_zscore(d, "bits", 2))] == [0.0] * 3
    assert [r[0] for r in bits(normalize.quantile_scale(d, "bits", 2))] == [0.0] * 3


def test_shared_factors_leave_uncorrelated_residuals(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 1)) + 0.3 * rng.normal(size=(200, 4))
    r = np.array(bits(normalize.remove_shared_factor(rows(spark, x), "bits", 4)))
    for i in range(4):
        rest = [j for j in range(4) if j != i]
        assert np.abs(np.corrcoef(r[:, i], x[:, rest].T)[0, 1:]).max() < 1e-8
    v = np.array(bits(normalize.remove_first_component(rows(spark, x), "bits", 4)))
    assert v.var(axis=0).sum() < 0.5 * x.var(axis=0).sum()
    out = x.copy()
    out[0, 0] = 50
    robust = np.array(bits(normalize.robust_regression(rows(spark, out + 20), "bits", 4)))
    assert np.isfinite(robust).all()


def test_regress_needs_a_known_covariate(spark):
    with pytest.raises(ValueError):
        normalize.regress(rows(spark, [[1]]), "bits", 1, value="mode")


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.normal(size=(150, 2)), rng.normal(size=(20, 2)) * 40, [[0.5, 0.5]] * 3])
    p = spark.createDataFrame([(i, "A" if i % 3 else "B", float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(999, "lonely", 0.0, 0.0)], "id long, section string, x double, y double")
    got = {}
    for r in neighbours.knn_plane(p, 4).collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    assert 999 not in got
    section = np.array([bool(i % 3) for i in range(len(xy))])
    for i in range(len(xy)):
        d = np.sqrt(((xy - xy[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(xy)), d)) if j != i and section[j] == section[i]][:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == order


def test_radius_join_leaves_out_repeats(spark):
    p = spark.createDataFrame([(0, "A", 0.0, 0.0), (1, "A", 0.0, 0.0), (2, "A", 1.0, 0.0), (3, "B", 0.0, 0.0)], "id long, section string, x double, y double")
    assert {(r["src"], r["dst"]) for r in neighbours.radius_join(p, 1.0).collect()} == {(0, 2), (2, 0), (1, 2), (2, 1)}


def test_delaunay_has_empty_circles():
    rng = np.random.default_rng(2)
    for pts in (rng.uniform(size=(120, 2)), rng.normal(size=(60, 2)) * 1e3):
        t = spatial.delaunay(pts)
        hull = len(pts) * 2 - 2 - len(t)
        assert 3 <= hull < len(pts)
        for a, b, c in t[:: max(1, len(t) // 40)]:
            m = np.array([pts[b] - pts[a], pts[c] - pts[a]]) * 2
            centre = np.linalg.solve(m, [pts[b] @ pts[b] - pts[a] @ pts[a], pts[c] @ pts[c] - pts[a] @ pts[a]])
            r = np.linalg.norm(pts[a] - centre)
            assert (np.linalg.norm(pts - centre, axis=1) > r * (1 - 1e-7)).all()


def test_voronoi_cells_tile_the_box():
    pts = np.random.default_rng(3).uniform(size=(80, 2))
    cells = spatial.voronoi_cells(pts, (0, 0, 1, 1))
    assert abs(sum(map(spatial.polygon_area, cells)) - 1) < 1e-6


def test_ray_cast(spark):
    g = spark.createDataFrame([(1, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))")], "unit_id int, wkt string")
    p = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.5, 0.5)], "id int, x double, y double")
    assert [r["id"] for r in spatial.points_in_polygons(p, g).collect()] == [0]


def test_phase_shift_finds_a_roll():
    rng = np.random.default_rng(4)
    big = rng.normal(size=(80, 80))
    dy, dx, err = spatial.phase_shift(big[10:60, 10:60], big[13:63, 8:58])
    assert (dy, dx) == (3, -2) and err < 1e-6


def test_image_filters():
    """Against plain loops with mirrored borders."""
    rng = np.random.default_rng(2)
    img = rng.normal(size=(12, 16))
    mirror = lambda i, n: (i if 0 <= i < n else -i - 1 if i < 0 else 2 * n - 1 - i)
    for size in (3, 4):
        around = [[sorted(img[mirror(y + a, 12), mirror(x + b, 16)] for a in range(-(size // 2), size - size // 2) for b in range(-(size // 2), size - size // 2)) for x in range(16)] for y in range(12)]
        around = np.array(around)
        assert (spatial.filter_image(img, "median", size) == around[:, :, size * size // 2]).all()
        assert (spatial.filter_image(img, "minimum", size) == around[:, :, 0]).all()
        assert (spatial.filter_image(img, "percentile_30", size) == around[:, :, int(size * size * 0.3)]).all()
    assert (spatial.filter_image(img, "unknown", 1) == 0).all()
    assert spatial.filter_image(np.ones((9, 9)), "gaussian", 1.0) == pytest.approx(np.ones((9, 9)))
    clipped = np.clip(img, *np.percentile(img, [10, 60]))
    assert spatial.filter_image(img, "robust[10,60]gaussian", 1.0) == pytest.approx(spatial.filter_image(clipped, "gaussian", 1.0))
    ball = np.array([[min(img[y + a, x + b] + 2 - np.sqrt(4 - a * a - b * b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4 and 0 <= y + a < 12 and 0 <= x + b < 16) for x in range(16)] for y in range(12)])
    assert spatial._rolled_ball(img, 2) == pytest.approx(ball)
    assert spatial.filter_image(np.full((12, 16), 3.0), "rolling_ball", 2) == pytest.approx(np.full((12, 16), 3.0))
    y, x = np.mgrid[:12, :16]
    plane = 2.0 * y + 3.0 * x
    fit = spatial.filter_image(plane, "polyfit_1", 50)
    assert np.abs(fit[2:-2, 2:-2] - (plane / 2 + (np.median(2.0 * y) + np.median(3.0 * x)) / 2)[2:-2, 2:-2]).max() < 1.0
    assert spatial.filter_image(np.full((12, 16), 3.0), "spline_median_smooth", "3|4") == pytest.approx(np.full((12, 16), 3.0))
    up = spatial.filter_image(plane, "spline", "5|4")  # 5 does not divide 12: 4 does
    small = plane.reshape(3, 4, 4, 4).mean(axis=(1, 3))
    assert up[0, 0] == small[0, 0] and up[6, 0] == pytest.approx(small[1, 0]) and up[0, 8] == pytest.approx((small[0, 1] + small[0, 2]) / 2)


def test_multiquadric_passes_through_its_points(spark):
    c = np.array([[0, 0], [1, 0], [0, 1], [1, 1.0]])
    t = np.array([0.0, 2, 1, 5])
    w, eps = spatial.fit_multiquadric(c, t)
    d = spark.createDataFrame([(float(x), float(y)) for x, y in c], "x double, y double").coalesce(1)
    assert np.allclose([r["m"] for r in spatial.apply_multiquadric(d, c, w, eps, "x", "y", "m").collect()], t)


def test_label_purity_is_strict(spark):
    d = spark.createDataFrame([("a", "s1")] * 50 + [("a", "s2")] * 50 + [("b", "s1")] * 49 + [("b", "s2")] * 26 + [("b", "s3")] * 25 + [("c", "s1")] * 51 + [("c", "s2")] * 49, "label string, section string")
    assert [r["label"] for r in relational.dispersed_labels(d).collect()] == ["b"]


def test_type_frequency_has_gaps(spark):
    d = spark.createDataFrame([(0, 1), (0, 1), (2, 2)], "type_ix int, node_size int")
    assert [r["p"] for r in relational.type_frequency(d, 2).orderBy("type_ix").collect()] == [0.5, 0.0, 0.5]


def test_section_name_collisions(spark):
    d = spark.createDataFrame([("s1", 1.01), ("s2", 1.04), ("s3", 2.0)], "section string, ccf_x double")
    got = {r["section"]: r["section_name"] for r in relational.rename_sections(d, "W").collect()}
    assert got == {"s1": "W_1.0", "s2": "W_1.0_1", "s3": "W_2.0"}


def test_strict_lookup_raises(spark):
    with pytest.raises(ValueError):
        relational.strict_lookup(spark.range(3), spark.range(2).withColumn("v", F.lit(1)), "id")


def test_samples_are_exact_and_repeatable(spark):
    d = spark.range(100).withColumn("s", F.col("id") % 3)
    a = {r["id"] for r in relational.stratified_sample(d, "s", 5, "id").collect()}
    assert len(a) == 15 and a == {r["id"] for r in relational.stratified_sample(d.repartition(7), "s", 5, "id").collect()}
    assert relational.stratified_sample(d, "s", {0: 2, 1: 3}, "id").count() == 5
    assert relational.stratified_resample(d, "s", 50, "id").count() == 150


def test_percolation_bounds(spark):
    n, e = graph.toy_grid(spark, 4, "grid", 4)
    b = graph.simple_edges(e).withColumn("p", F.lit(0.5))
    got = {round(r["p"], 2): r["entropy"] for r in graph.bond_percolation(b, n, 11).collect()}
    assert got[0.0] == pytest.approx(4) and got[1.0] == pytest.approx(0, abs=1e-9)


def test_nested_merging_keeps_what_scores():
    parents = [np.array([0, 0, 0, 0]), np.array([0, 0, 1, 1]), np.arange(4)]
    assert (graph.merge_nested(np.ones(4), parents, lambda m: 1.0 if len(m) == 2 else 0.0) == 1).all()
    assert (graph.merge_nested(np.ones(4), parents, lambda m: 1.0 if len(m) == 2 else 0.0, top_down=False) == 1).all()


def test_communities_of_two_cliques(spark):
    e = [(a, b) for s in (0, 5) for a in range(s, s + 5) for b in range(s, a)] + [(0, 5)]
    n = spark.range(10).withColumn("section", F.lit("s"))
    got = {r["id"]: r["community"] for r in graph.communities(spark.createDataFrame(e, "src long, dst long"), n).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len(set(got.values())) == 2


def test_enrichment_of_blocks(spark):
    n, e = graph.toy_grid(spark, 8, "grid", 4)
    got = {(r["a"], r["b"]): r for r in graph.edge_enrichment(e, n, 30).collect()}
    assert got[(0, 0)]["enrichment"] > 1 > got[(0, 1)]["enrichment"] and got[(0, 1)]["p"] < 0.1


def test_earth_mover_agrees_with_the_line(spark):
    rng = np.random.default_rng(5)
    cost = np.abs(np.subtract.outer(np.arange(5), np.arange(5))).astype(float)
    for _ in range(20):
        a, b = rng.dirichlet(np.ones(5)), rng.dirichlet(np.ones(5))
        assert stats.earth_mover(a, b, cost) == pytest.approx(np.abs(np.cumsum(a - b)).sum(), abs=1e-9)


def test_ward_and_cuts():
    x = np.array([[0.0], [0.1], [5], [5.2], [20]])
    m = classify.ward(x)
    assert classify.cut(m, 5, groups=3).tolist() == [0, 0, 1, 1, 2]
    assert sorted(classify.leaf_order(m, 5)) == list(range(5))


def test_projective_factors_are_non_negative():
    x = np.random.default_rng(6).uniform(size=(6, 50))
    w = classify.projective_nmf(x @ x.T, 2)
    assert (w >= 0).all() and np.linalg.norm(x - w @ w.T @ x) < np.linalg.norm(x)


def test_supervised_walk_reaches_leaves(spark):
    rng = np.random.default_rng(7)
    data = [(i, [float(v) for v in rng.normal(size=2) * 0.1 + c], "abc"[i % 3]) for i in range(60) for c in [[(0, 0), (0, 4), (9, 9)][i % 3]]]
    ref = spark.createDataFrame(data, "id long, bits array<double>, label string")
    prior = ref.select("id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("label")).withColumn("p", F.lit(1 / 3))
    m = classify.ward(np.array([[0.0, 0], [0, 4], [9, 9]]))
    got = classify.supervised_walk(ref, ref.select("id", "bits"), prior, m, ["a", "b", "c"])
    assert {(r["id"], r["label"]) for r in got.collect()} == {(i, v) for i, _, v in data}


def test_transfer_rolls_up(spark):
    ref = spark.createDataFrame([(i, [float(i % 2), 1.0, 2.0 + i % 2 * 3], f"t{i % 2}") for i in range(8)], "id long, bits array<double>, label string")
    prior = ref.select("id", F.explode(F.array(F.lit("t0"), F.lit("t1"))).alias("label")).withColumn("p", F.lit(0.5))
    m = spark.createDataFrame([("t0", "A"), ("t1", "A")], "fine string, coarse string")
    got = classify.transfer(ref, ref, prior, [(m, "fine", "coarse")], k=3, metric="euclidean")
    assert got["finest"].join(ref, "id").filter(got["finest"]["label"] != ref["label"]).count() == 0
    assert {r["label"] for r in got["coarse"].collect()} == {"A"}


def test_sequences(spark):
    d = spark.createDataFrame([("AACG",)], "s string")
    assert d.select(S.reverse_complement(F.col("s")), S.gc_fraction(F.col("s"))).first()[:] == ("CGTT", 0.5)
    tm = d.select(S.melting_temperature(F.lit("ACGTTGCAATGCCGTA")), S.melting_temperature(F.lit("GCGCGGCCGCGCCGCG"))).first()
    assert 30 < tm[0] < tm[1] < 100
    with pytest.raises(ValueError):
        design.screen(d.withColumnRenamed("s", "seq"), {"colour": 1})


def test_spaced_subset_is_the_sequential_choice(spark):
    s = ["aaaa", "aaab", "bbbb", "abbb", "cccc", "aacc"]
    kept = []
    for v in s:
        if all(sum(a != b for a, b in zip(v, k, strict=True)) >= 2 for k in kept):
            kept.append(v)
    d = spark.createDataFrame(list(enumerate(s)), "id int, seq string")
    assert [r["seq"] for r in design.spaced_subset(d, 2).orderBy("id").collect()] == kept


def test_orthogonal_subset_drops_the_worst(spark):
    p = spark.createDataFrame([(0, 1, -9.0), (0, 2, -1.0), (1, 2, -2.0), (2, 3, -1.0)], "a int, b int, value double")
    assert design.orthogonal_subset(p, 3, protected=[0]) == [0, 2, 3]


def test_dataset_round_trip(spark, tmp_path):
    n, e = graph.toy_grid(spark, 4, "grid", 2)
    d = Dataset(spark, str(tmp_path / "d"))
    d.add_cells(n, e)
    tax = Taxonomy("kind", spark.createDataFrame([(0, "even"), (1, "odd")], "type_ix int, type string"))
    d.add_types("cell", n.select("id", F.when(F.col("type_ix") == 0, "even").otherwise("odd").alias("type")), tax)
    d.merge("zone")
    with pytest.raises(ValueError):
        d.merge("zone")
    with pytest.raises(ValueError):
        d.filter_cells(F.col("x") > 1)
    d.save()
    back = Dataset.load(spark, str(tmp_path / "d"))
    assert list(back.layers) == ["cell", "zone"] and back.base_of("zone") == "cell" and back.taxonomy_of["zone"] == "kind"
    sizes = back.to_cells("zone", "node_size")
    assert sizes.count() == 16 and {r["node_size"] for r in sizes.collect()} == {4}


def test_sources(spark, tmp_path):
    p = str(tmp_path)
    assert io.load(spark, p, "matrix", dataset="d") is None
    io.save(spark.range(3), p, "matrix", dataset="d", section="s")
    assert io.load(spark, p, "matrix", dataset="d", section="s").count() == 3
    with pytest.raises(ValueError):
        io.save(spark.range(1), p, "nonsense")
    io.save(spark.createDataFrame([(0, 0, 70000.0), (0, 1, -5.0)], "row int, col int, value double"), p, "image")
    assert {r["value"] for r in io.load(spark, p, "image").collect()} == {65535, 0}
    assert io.update_config(spark, f"{p}/c", "k", {"a": 1}) == {"a": 1}
    assert io.update_config(spark, f"{p}/c", "k", {"b": 2}) == {"a": 1, "b": 2} and io.update_config(spark, f"{p}/c", "other") == {}


def test_matrix_market_and_boundaries(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%c\n2 3 3\n1 1 5\n2 3 7\n1 2 1\n")
    (tmp_path / "b.tsv").write_text("c1\nc2\nc3\n")
    (tmp_path / "f.tsv").write_text("g1\tGene1\texpr\ng2\tGene2\texpr\n")
    e = io.read_matrix_market(spark, *[f"{tmp_path}/{f}" for f in ("m.mtx", "b.tsv", "f.tsv")])
    m = {r["cell_id"]: r["counts"] for r in io.cell_matrix(e, ["g1", "g2"]).collect()}
    assert m == {"c1": [5, 0], "c2": [1, 0], "c3": [0, 7]}
    cells = spark.createDataFrame([("c1", 0.0, 0.0), ("c2", 5.0, 5.0)], "cell_id string, x_centroid double, y_centroid double")
    v = spark.createDataFrame([("c1", k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (1, 0), (0, 1)])], "cell_id string, ord int, vertex_x double, vertex_y double")
    w = {r["cell_id"]: r["wkt"] for r in io.boundary_polygons(cells, v).collect()}
    assert w["c1"] == "POLYGON ((0.0 0.0, 1.0 0.0, 0.0 1.0, 0.0 0.0))" and w["c2"].startswith("POLYGON ((4.0 4.0")
    with pytest.warns(UserWarning):
        assert io.read_clusters(spark, f"{tmp_path}/none.csv").count() == 0


def test_newest_catalog(spark):
    d = spark.createDataFrame([("a", "d", "s", "processing", "p1", "/x/p1", 1), ("a", "d", "s", "processing", "p2", "/x/p2", 2), ("a", "d", "s", "registration", "r", "/y/r", 1), ("a", "d", "t", "processing", "p", "/x/p", 1)], "animal string, dataset string, section string, kind string, name string, path string, mtime int")
    got = io.newest_catalog(d).collect()
    assert len(got) == 1 and got[0]["processing"] == "p2" and got[0]["dataset_path"] == "/x"


def test_volumes(spark, tmp_path):
    v = np.zeros((2, 3, 4), np.uint16)
    v[1, 2, 3] = 7
    np.save(tmp_path / "v.npy", v)
    assert [tuple(r) for r in io.read_volume(spark, f"{tmp_path}/v.npy").collect()] == [(1, 2, 3, 7)]
    head = b"NRRD0004\ntype: uint16\ndimension: 3\nsizes: 4 3 2\nendian: little\nencoding: raw\n\n"
    assert (io.parse_volume(head + v.astype("<u2").tobytes()) == v).all()


def test_ontology(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"id": 997, "acronym": "root", "name": "r", "color_hex_triplet": "FF", "children": [{"id": 8, "acronym": "x", "name": "y", "color_hex_triplet": "ABCDEF", "children": []}]}')
    got = {r["id"]: r for r in io.load_ontology(spark, f"{tmp_path}/o.json").collect()}
    assert got[8]["path"] == [997, 8] and got[997]["rgb"] == "0000FF" and sorted(r["sid"] for r in got.values()) == [0, 1, 2]


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    src, dst, ck = (f"{tmp_path}/{x}" for x in ("src", "dst", "ck"))
    for batch in (1, 2):
        spark.createDataFrame([(batch, "A"), (batch + 10, "B")], "id long, section string").write.mode("append").parquet(src)
        ingest.ingest_sections(spark, src, dst, "id long, section string", f"{ck}{batch}").awaitTermination(60)
    assert spark.read.parquet(dst).count() == 4


def test_environments_of_an_isolated_node(spark):
    n = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 1, 1)], "id long, type_ix int, node_size int")
    e = spark.createDataFrame([(0, 1)], "src long, dst long")
    env = environments.graph_environment(e, n, 1)
    assert {(r["id"], r["type_ix"], r["n"]) for r in env.collect()} == {(0, 1, 1), (0, 2, 1), (1, 1, 1), (1, 2, 1), (2, 1, 1)}
    assert 2 not in {r["id"] for r in environments.local_abundance(e, n).collect()}


def test_colour_difference_2000(spark):
    # published test pairs of the formula
    pairs = [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082)]
    for a, b, want in pairs:
        got = spark.range(1).select(S.delta_e_2000(tuple(map(F.lit, a)), tuple(map(F.lit, b)))).first()[0]
        assert got == pytest.approx(want, abs=1e-4)


def test_zoom_is_linear_and_skips_holes(spark):
    r = spark.createDataFrame([(i, j, float(i + 2 * j)) for i in range(3) for j in range(3)], "row int, col int, value double")
    got = {(x["row"], x["col"]): x["value"] for x in spatial.zoom(r, 3, 3, 5 / 3).collect()}
    assert len(got) == 25 and got[(1, 1)] == pytest.approx(1.5) and got[(4, 4)] == pytest.approx(6)
    assert (2, 2) not in {(x["row"], x["col"]) for x in spatial.zoom(r.filter("row <> 1 or col <> 1"), 3, 3, 5 / 3).collect()}


def test_edge_preserving_smoothing_keeps_a_step():
    rng = np.random.default_rng(8)
    step = np.repeat([[0.0] * 10 + [1.0] * 10], 20, axis=0)
    u, v = spatial.edge_preserving(step + rng.normal(0, 0.05, step.shape), alpha=4.0, beta=0.05)
    assert u[:, :9].std() < 0.05 and u[:, 11:].mean() - u[:, :9].mean() > 0.8 and v[:, 9].mean() < v[:, 3].mean()


def test_group_harmonisation(spark):
    rng = np.random.default_rng(9)
    ref = spark.createDataFrame([(i, [float(x)], "a") for i, x in enumerate(rng.normal(10, 2, 200))], "id int, bits array<double>, label string")
    own = spark.createDataFrame([(i, [float(x)], "a" if i < 300 else "z", f"s{i % 2}") for i, x in enumerate(rng.normal(0, 1, 320))], "id int, bits array<double>, label string, section string")
    got = normalize.harmonise_by_group(own, ref, "bits", 1)
    m = got.filter("label = 'a'").agg(F.avg(F.col("bits")[0]), F.stddev(F.col("bits")[0])).first()
    assert abs(m[0] - 10) < 0.3 and abs(m[1] - 2) < 0.3
    assert got.filter("label = 'z'").join(own.select("id", F.col("bits").alias("o")), "id").filter("bits <> o").count() == 0


def _blobs(spark, n=90):
    rng = np.random.default_rng(10)
    centre = np.array([[0, 0, 5, 1], [5, 0, 0, 2], [0, 5, 0, 9.0]])
    return spark.createDataFrame(
        [(i, [float(v) for v in rng.normal(size=4) * 0.2 + centre[i % 3]], "abc"[i % 3], "N" if i % 3 else "M", f"s{i % 2}", float(i % 2) * 0.1) for i in range(n)],
        "id long, bits array<double>, label string, flag string, section string, z double",
    )


def test_kfold_regression_of_blobs(spark):
    d = _blobs(spark)
    got = classify.kfold_regression(d, d.select("id", F.col("bits").alias("target")), 4)
    assert stats.paired_mse(got, "target", "predicted", 4).first()["r2"] > 0.9 and got.count() == 90


def test_alignment_and_subsampled_communities(spark):
    d = _blobs(spark)
    communities = classify.subsampled_communities(d, every=2, k=5, resolution=0.5)
    assert communities.join(d, "id").groupBy("community").agg(F.countDistinct("label").alias("k")).agg(F.max("k")).first()[0] == 1
    prior = d.select("id", F.explode(F.array(*[F.lit(x) for x in "abc"])).alias("label")).withColumn("p", F.lit(1 / 3))
    got = classify.align(d, d.select("id", "bits"), prior, communities, 4, resample=90)
    want = {r["id"]: r["label"] for r in d.collect()}
    assert np.mean([want[r["id"]] == r["label"] for r in got.collect()]) > 0.95


def test_knn_in_the_plane_with_an_outlier(spark):
    """Tiles of few points, points of one place, and one far away, against all pairs."""
    rng = np.random.default_rng(7)
    xy = np.concatenate([rng.normal(size=(700, 2)), np.round(rng.normal(size=(200, 2)), 1), np.zeros((40, 2)), [[1e6, -1e6]], rng.normal(size=(3, 2))])
    section = ["a"] * 941 + ["b"] * 3
    df = spark.createDataFrame([(i, section[i], float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, section string, x double, y double")
    for include_self in (False, True):
        got = {}
        for r in neighbours.knn_plane(df, 5, include_self=include_self, tile=50).orderBy("src", "rank").collect():
            got.setdefault(r["src"], []).append((r["dst"], r["dist"], r["rank"]))
        for i in range(len(xy)):
            d = np.sqrt((xy[:, 0] - xy[i, 0]) ** 2 + (xy[:, 1] - xy[i, 1]) ** 2)
            best = sorted((d[j], j) for j in range(len(xy)) if section[j] == section[i] and (include_self or j != i))[:5]
            assert [(b, r) for b, _, r in got[i]] == [(j, k) for k, (_, j) in enumerate(best, 1)] and np.allclose([v for _, v, _ in got[i]], [v for v, _ in best])


def test_components_beyond_one_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 50)
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(0, 300) if i % 37] + [tuple(map(int, e)) for e in rng.integers(400, 900, (300, 2))]
    e = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    got = {r["id"]: r["component"] for r in graph.components(e, spark.range(1000)).collect()}
    least = list(range(1000))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    assert got == dict(enumerate(least))


def test_leiden_finds_planted_communities():
    """Rings of cliques, a random planted partition, and no community that falls apart."""
    rng = np.random.default_rng(3)
    edges = [(c * 6 + i, c * 6 + j) for c in range(20) for i in range(6) for j in range(i)] + [(c * 6, (c + 1) % 20 * 6 + 1) for c in range(20)]

    def run(edges, n, resolution=1.0):
        a, b = np.array(edges).T
        return graph._leiden(np.concatenate([a, b]), np.concatenate([b, a]), np.ones(2 * len(a)), n, resolution, 0)

    label = run(edges, 120)
    assert all(len(set(label[c * 6 : c * 6 + 6])) == 1 for c in range(20)) and 10 <= len(set(label)) <= 20
    kind = np.repeat(np.arange(4), 50)
    planted = [(i, j) for i in range(200) for j in range(i) if rng.random() < (0.3 if kind[i] == kind[j] else 0.01)]
    label = run(planted, 200)
    assert len(set(label)) == 4 and all(len(set(label[kind == k])) == 1 for k in range(4))
    random = [tuple(e) for e in rng.integers(0, 300, (900, 2)) if e[0] != e[1]]
    label = run(random, 300, 2.0)
    a, b = np.array(random).T
    inside = label[a] == label[b]
    nodes, least = graph._least_labels(a[inside], b[inside])
    part = dict(zip(nodes, least, strict=True))
    assert all(len({part.get(v, v) for v in np.flatnonzero(label == k)}) == 1 for k in set(label))


def test_triplets_against_permutations(spark):
    """Observed counts are those of the types; expected ones lie near the share of each triple."""
    rng = np.random.default_rng(4)
    tri = [(3 * k, 3 * k + 1, 3 * k + 2) for k in range(200)]
    types = [int(t) for k in range(200) for t in ([0, 0, 0] if k < 60 else rng.integers(0, 2, 3))]
    e = spark.createDataFrame([p for a, b, c in tri for p in ((a, b), (b, c), (a, c))], "src long, dst long")
    n = spark.createDataFrame(list(enumerate(types)), "id long, type_ix int")
    got = {tuple(r["types"]): r for r in graph.triplet_enrichment(e, n, 50).collect()}
    want = {}
    for t in tri:
        key = tuple(sorted(types[v] for v in t))
        want[key] = want.get(key, 0) + 1
    share = np.mean(types)
    assert {k: r["obs"] for k, r in got.items()} == want
    assert abs(got[(0, 0, 0)]["expected"] - 200 * (1 - share) ** 3) < 6 and got[(0, 0, 0)]["enrichment"] > 1.5 and got[(0, 0, 0)]["q"] < 0.1

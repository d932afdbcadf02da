"""Sources, sinks, importers and the data set: written to the shared folder and read again."""

from __future__ import annotations

import io as _io
import uuid

import numpy as np
from pyspark.sql import functions as F

from cellweft.functions import scalars as S
from cellweft.operators import classify as K
from cellweft.operators import relational, views
from cellweft.operators import environments as E
from cellweft.operators import graph as Gr
from cellweft.operators import neighbours as N
from cellweft.operators import normalize as Z
from cellweft.plans.checkpoints import checkpoint_dir
from cellweft.plans.dataset import Dataset, Taxonomy
from cellweft.plans.fixtures import BITS, C, G, L, cells, grid, read
from cellweft.plans.graph_queries import _ZONE
from cellweft.plans.registry import SQL, R, query, r6
from cellweft.sources import io

W = "WITH " + C + " "
WL = "WITH " + L + " "
WG = "WITH RECURSIVE " + G + " "


def _folder(spark) -> str:  # noqa: ANN001
    return f"{checkpoint_dir(spark)}/query-{uuid.uuid4().hex}"


def _write(spark, path: str, content: bytes) -> str:  # noqa: ANN001
    """A small file, written where all executors see it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content))
    out.close()
    return path


# sources and sinks


@query(W + "SELECT section, id, " + R("x", "x") + " FROM c")
def saved_layers(spark, sf):
    """One folder a section, read one by one; a missing one is None."""
    c, at = cells(spark, sf).select("id", "x", "section"), _folder(spark)
    out = None
    for k in range(4):
        io.save(c.filter(F.col("section") == f"A_{k}.0").drop("section"), at, "layer", section=f"A_{k}.0")
        part = io.load(spark, at, "layer", section=f"A_{k}.0").select(F.lit(f"A_{k}.0").alias("section"), "id", r6("x").alias("x"))
        out = part if out is None else out.unionByName(part)
    assert io.load(spark, at, "layer", section="A_9.0") is None
    return out


@query("SELECT p_partkey AS id, greatest(0, least(round(p_retailprice * 100 - 100000)::INT, 65535)) AS value FROM part")
def saved_image(spark, sf):
    at = _folder(spark)
    io.save(read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 100 - 100000).alias("value")), at, "image")
    return io.load(spark, at, "image")


@query("SELECT c_custkey AS id, c_mktsegment AS segment, " + R("c_acctbal", "v") + " FROM customer")
def saved_matrix(spark, sf):
    """Through CSV with a header."""
    at = _folder(spark)
    io.save(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("v")), at, "matrix")
    return io.load(spark, at, "matrix").select(F.col("id").cast("long").alias("id"), "segment", r6("v").alias("v"))


@query("SELECT 'a' AS key, 'x=1,y=3' AS v UNION ALL SELECT 'b', 'z=2'")
def saved_config(spark, sf):
    at = _folder(spark)
    for key, values in (("a", {"x": 1, "y": 2}), ("b", {"z": 2}), ("a", {"y": 3})):
        io.update_config(spark, at, key, values)
    got = {k: io.update_config(spark, at, k) for k in "ab"}
    return spark.createDataFrame([(k, ",".join(f"{n}={x}" for n, x in sorted(v.items()))) for k, v in got.items()], "key string, v string")


def _squares(spark, sf):  # noqa: ANN001, ANN202
    n, _ = grid(spark, sf)
    x, y = F.col("x"), F.col("y")
    ring = [F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in ((x, y), (x + 1, y), (x + 1, y + 1), (x, y))]
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *ring), F.lit("))"))
    return n.select(F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("section"), F.when(F.col("id") % 2 == 0, "cell").otherwise("voronoi").alias("geom_type"), F.floor(F.col("id") / 3).alias("pos"), F.col("id").alias("unit_id"), wkt.alias("wkt"))


_WKT = "'POLYGON ((' || x || ' ' || y || ', ' || (x + 1) || ' ' || y || ', ' || (x + 1) || ' ' || (y + 1) || ', ' || x || ' ' || y || '))'"


@query("WITH " + G + f" SELECT 'S' || (id % 3) AS section, id // 3 AS pos, id AS unit_id, {_WKT} AS wkt FROM g WHERE id % 3 IN (0, 2) AND id % 2 = 0")
def saved_polygons(spark, sf):
    """Two sections and one kind of geometry read back."""
    at = _folder(spark)
    io.save_polygons(_squares(spark, sf), at)
    return io.load_polygons(spark, at, ["S0", "S2"], ["cell"]).select("section", "pos", "unit_id", "wkt")


@query("WITH " + G + f" SELECT id::INT AS pos, {_WKT} AS wkt FROM g WHERE id < 50")
def polygon_lines(spark, sf):
    at = _folder(spark)
    lines = _squares(spark, sf).filter("unit_id < 50").orderBy("unit_id").collect()  # a file of 50 lines
    _write(spark, f"{at}/cells.wkt", "\n".join(r["wkt"] for r in lines).encode())
    return io.load_wkt_lines(spark, f"{at}/cells.wkt").select("pos", "wkt")


_LISTING = (
    "WITH t AS (SELECT 'm' || (o_custkey % 5) AS animal, 'd' || (o_custkey % 5) AS dataset, 's' || (o_orderkey % 7) AS section, CASE WHEN o_orderkey % 3 = 0 THEN 'registration' ELSE 'processing' END AS kind, 'n' || o_orderkey AS name, '/data/d' || (o_custkey % 5) || '/n' || o_orderkey AS path, o_orderdate AS mtime FROM orders WHERE o_orderkey % 7 < 5 OR o_orderkey % 3 <> 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY dataset, section, kind ORDER BY mtime DESC, name DESC) AS k FROM t) "
)


@query(
    _LISTING + "SELECT p.animal, p.section AS section_acq_name, p.name AS processing, q.name AS registration, p.dataset, q.path AS registration_path, p.path AS processing_path, '/data/' || p.dataset AS dataset_path "
    "FROM r p JOIN r q ON p.dataset = q.dataset AND p.section = q.section AND q.kind = 'registration' AND q.k = 1 WHERE p.kind = 'processing' AND p.k = 1"
)
def newest_catalog(spark, sf):
    o = read(spark, sf, "orders").filter("o_orderkey % 7 < 5 or o_orderkey % 3 <> 0")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    d, name = text("d", F.col("o_custkey") % 5), text("n", F.col("o_orderkey"))
    listing = o.select(
        text("m", F.col("o_custkey") % 5).alias("animal"), d.alias("dataset"), text("s", F.col("o_orderkey") % 7).alias("section"),
        F.when(F.col("o_orderkey") % 3 == 0, "registration").otherwise("processing").alias("kind"), name.alias("name"), F.concat(F.lit("/data/"), d, F.lit("/"), name).alias("path"), F.col("o_orderdate").alias("mtime"),
    )
    return io.newest_catalog(listing)


@query("SELECT 'WTF' AS animal, 's1' AS section_acq_name, 'unknown' AS processing, 'unknown' AS registration, 'd' AS dataset, 'unknown' AS registration_path, 'unknown' AS processing_path, 'unknown' AS dataset_path")
def experiment_record(spark, sf):
    return io.experiment_record(spark, {"animal": "WTF", "section_acq_name": "s1", "dataset": "d", "processing": None, "other": 3})


_ENTRIES = "e AS (SELECT l_partkey % 20 AS g, l_suppkey % 9 AS c, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2)"


def _matrix(spark, sf):  # noqa: ANN001, ANN202
    """A coordinate matrix of 20 genes by 9 cells in three text files."""
    at = _folder(spark)
    e = read(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 20).alias("g"), (F.col("l_suppkey") % 9).alias("c")).agg(F.sum("l_quantity").alias("n"))
    rows = sorted(tuple(r) for r in e.collect())  # 180 entries
    body = ["%%MatrixMarket matrix coordinate real general", "%", f"20 9 {len(rows)}", *[f"{g + 1} {c + 1} {n}" for g, c, n in rows]]
    _write(spark, f"{at}/matrix.mtx", "\n".join(body).encode())
    _write(spark, f"{at}/barcodes.tsv", "\n".join(f"cell{c}" for c in range(9)).encode())
    _write(spark, f"{at}/features.tsv", "\n".join(f"G{g}\tgene{g}\tGene Expression" for g in range(20)).encode())
    return io.read_matrix_market(spark, f"{at}/matrix.mtx", f"{at}/barcodes.tsv", f"{at}/features.tsv")


@query("WITH " + _ENTRIES + " SELECT 'cell' || c AS cell_id, 'G' || g AS gene_id, 'gene' || g AS gene_name, 'Gene Expression' AS feature_type, " + R("n", "count") + " FROM e")
def matrix_market(spark, sf):
    return _matrix(spark, sf).withColumn("count", r6("count"))


@query("WITH " + _ENTRIES + " SELECT 'cell' || a.c AS cell_id, k AS gene, " + R("coalesce(n, 0)", "count") + " FROM (SELECT DISTINCT c FROM e) a CROSS JOIN (SELECT unnest([3, 17, 5]) AS k) b LEFT JOIN e ON e.c = a.c AND e.g = k")
def cell_matrix(spark, sf):
    m = io.cell_matrix(_matrix(spark, sf), ["G3", "G17", "G5"])
    return m.select("cell_id", F.posexplode("counts").alias("p", "count")).select("cell_id", F.element_at(F.array(F.lit(3), F.lit(17), F.lit(5)), F.col("p") + 1).alias("gene"), r6("count").alias("count"))


_IMPORTED = "m AS (SELECT c_custkey AS k, 'c' || c_custkey AS cell_id, (c_custkey * 37) % 120 AS transcript_counts FROM customer), cl AS (SELECT k, cell_id, (k % 4 + 1)::INT AS cluster FROM m WHERE k % 5 <> 0) "


def _import(spark, sf):  # noqa: ANN001, ANN202
    at = _folder(spark)
    k = F.col("c_custkey")
    m = read(spark, sf, "customer").select(k.alias("k"), F.concat(F.lit("c"), k.cast("string")).alias("cell_id"), (k * 37 % 120).alias("transcript_counts"))
    m.filter("k % 5 <> 0").select(F.col("cell_id").alias("Barcode"), (F.col("k") % 4 + 1).alias("Cluster")).write.option("header", True).csv(f"{at}/clusters")
    return m, io.read_clusters(spark, f"{at}/clusters")


@query("WITH " + _IMPORTED + "SELECT cell_id, cluster FROM cl")
def imported_clusters(spark, sf):
    return _import(spark, sf)[1]


@query("SELECT (i - 1)::INT AS type_ix, 'Cluster_' || i AS type, j AS bit, CASE WHEN i - 1 = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([0, 1, 2, 3]) AS j)")
def imported_taxonomy(spark, sf):
    t = io.cluster_taxonomy(_import(spark, sf)[1])
    return t.select("type_ix", "type", F.posexplode("features").alias("bit", "v"))


@query("WITH " + _IMPORTED + ", t AS (SELECT m.cell_id, coalesce(cluster, -1) AS cluster, transcript_counts, k FROM m LEFT JOIN cl USING (cell_id, k)) SELECT cell_id, cluster FROM t WHERE transcript_counts >= 50 AND k % 3 + 1 >= 2")
def imported_cells(spark, sf):
    m, clusters = _import(spark, sf)
    counts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i <= F.col("k") % 3, 1.0).otherwise(0.0))
    return relational.merge_and_filter(m.select("cell_id", counts.alias("counts")), m.select("cell_id", "transcript_counts"), clusters, 50, 2).select("cell_id", "cluster")


@query(
    "WITH " + G + " SELECT id AS cell_id, CASE WHEN id % 4 = 0 THEN 'POLYGON ((' || (x - 1) || ' ' || (y - 1) || ', ' || (x + 1) || ' ' || (y - 1) || ', ' || (x + 1) || ' ' || (y + 1) || ', ' || (x - 1) || ' ' || (y + 1) || ', ' || (x - 1) || ' ' || (y - 1) || '))' "
    "ELSE 'POLYGON ((' || x || ' ' || y || ', ' || (x + 2) || ' ' || y || ', ' || x || ' ' || (y + 3) || ', ' || x || ' ' || y || '))' END AS wkt FROM g"
)
def imported_boundaries(spark, sf):
    """Every fourth cell has only two vertices and gets a square."""
    n, _ = grid(spark, sf)
    x, y = F.col("x"), F.col("y")
    v = n.select(F.col("id").alias("cell_id"), F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), a.alias("vertex_x"), b.alias("vertex_y")) for o, a, b in ((3, x, y + 3), (1, x, y), (2, x + 2, y))])).alias("_v")).select("cell_id", "_v.*")
    v = v.filter("cell_id % 4 <> 0 or ord < 3")
    return io.boundary_polygons(n.select(F.col("id").alias("cell_id"), x.alias("x_centroid"), y.alias("y_centroid")), v, half=1)


@query(
    "WITH t AS (SELECT 1000::BIGINT AS id, 'W' AS acronym, 'world' AS name, '0000ff' AS rgb, '1000' AS path UNION ALL SELECT 2000 + r_regionkey, 'R' || r_regionkey, r_name, '0000ff', '1000/' || (2000 + r_regionkey) FROM region "
    "UNION ALL SELECT 3000 + n_nationkey, 'N' || n_nationkey, n_name, '0000ff', '1000/' || (2000 + n_regionkey) || '/' || (3000 + n_nationkey) FROM nation UNION ALL SELECT 0, 'bg', 'background', '000000', '') "
    "SELECT row_number() OVER (ORDER BY id) - 1 AS sid, * FROM t"
)
def ontology_tree(spark, sf):
    import json

    nations = read(spark, sf, "nation").collect()  # 25 nations of 5 regions
    node = lambda i, a, n, children: {"id": i, "acronym": a, "name": n, "color_hex_triplet": "ff", "children": children}
    tree = node(1000, "W", "world", [
        node(2000 + r["r_regionkey"], f"R{r['r_regionkey']}", r["r_name"], [node(3000 + n["n_nationkey"], f"N{n['n_nationkey']}", n["n_name"], []) for n in nations if n["n_regionkey"] == r["r_regionkey"]])
        for r in read(spark, sf, "region").collect()
    ])
    t = io.load_ontology(spark, _write(spark, f"{_folder(spark)}/tree.json", json.dumps([tree]).encode()))
    return t.select(F.col("sid").cast("long").alias("sid"), "id", "acronym", "name", "rgb", F.array_join(F.transform("path", lambda v: v.cast("string")), "/").alias("path"))


_VOLUME = "SELECT (p_partkey // 30)::INT AS zi, (p_partkey // 6 % 5)::INT AS yi, (p_partkey % 6)::INT AS xi, (p_size % 7)::BIGINT AS id FROM part WHERE p_partkey < 120 AND p_size % 7 <> 0"


def _volume(spark, sf):  # noqa: ANN001, ANN202
    rows = read(spark, sf, "part").filter("p_partkey < 120").orderBy("p_partkey").collect()
    return np.array([r["p_size"] % 7 for r in rows], np.uint16).reshape(4, 5, 6)


@query(_VOLUME)
def volume_npy(spark, sf):
    b = _io.BytesIO()
    np.save(b, _volume(spark, sf))
    return io.read_volume(spark, _write(spark, f"{_folder(spark)}/v.npy", b.getvalue()))


@query(_VOLUME)
def volume_nrrd(spark, sf):
    import gzip

    head = "NRRD0004\ntype: uint16\ndimension: 3\nsizes: 6 5 4\nencoding: gzip\nendian: big\n\n"
    return io.read_volume(spark, _write(spark, f"{_folder(spark)}/v.nrrd", head.encode() + gzip.compress(_volume(spark, sf).astype(">u2").tobytes())))


_ACQ = "WITH i AS (SELECT 'a' || (user_id % 6) AS acq, 'h' || (user_id % 2) AS hybe, event_id % 10 AS position, epoch(ts) AS time FROM events WHERE NOT (user_id % 6 = 2 AND event_id % 10 = 7)) "


def _images(spark, sf):  # noqa: ANN001, ANN202
    e = read(spark, sf, "events").filter("not (user_id % 6 = 2 and event_id % 10 = 7)")
    text = lambda p, n: F.concat(F.lit(p), (F.col("user_id") % n).cast("string"))
    return e.select(text("a", 6).alias("acq"), text("h", 2).alias("hybe"), (F.col("event_id") % 10).alias("position"), F.col("ts").cast("timestamp").cast("double").alias("time"))


@query(_ACQ + "SELECT acq FROM i WHERE hybe = 'h0' GROUP BY acq HAVING count(DISTINCT position) = (SELECT count(DISTINCT position) FROM i) ORDER BY avg(time) DESC, acq LIMIT 1")
def chosen_acquisition(spark, sf):
    """The acquisition that lacks a position is passed over."""
    return io.choose_acquisition(_images(spark, sf), "h0")


@query(_ACQ + ", n AS (SELECT acq, count(DISTINCT position) AS n FROM i GROUP BY 1), g AS (SELECT i.* FROM i JOIN n USING (acq) WHERE n.n = (SELECT quantile_disc(n, 0.5) FROM n)), s AS (SELECT position FROM g GROUP BY 1 HAVING count(DISTINCT acq) = (SELECT count(DISTINCT acq) FROM g)) SELECT acq, position, count(*) AS n FROM g JOIN s USING (position) GROUP BY 1, 2")
def complete_rounds(spark, sf):
    return io.complete_rounds(_images(spark, sf)).groupBy("acq", "position").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS \"rows\", count(DISTINCT p_partkey) AS ids, true AS bounded FROM part")
def shuffled_batches(spark, sf):
    b = io.shuffled_batches(read(spark, sf, "part").select("p_partkey"), 64, "p_partkey")
    n = b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.collect_set("p_partkey").alias("s"))
    return n.agg(F.sum("n").alias("rows"), F.sum(F.size("s")).alias("ids"), (F.max("n") <= 64).alias("bounded"))


# the data set


def _dataset(spark, sf):  # noqa: ANN001, ANN202
    n, e = grid(spark, sf)
    d = Dataset(spark, _folder(spark))
    d.add_cells(n.withColumn("type_ix", F.col("type_ix").cast("int")), e)
    types = spark.createDataFrame([(0, "round"), (1, "square"), (2, "long")], "type_ix int, type string")
    d.add_types("cell", n.select("id", F.when(F.col("type_ix") == 0, "round").when(F.col("type_ix") == 1, "square").otherwise("long").alias("type")), Taxonomy("shape", types))
    d.merge("zone")
    d.save()
    return Dataset.load(spark, d.path)


@query(WG + _ZONE + ", n AS (SELECT component, count(*) AS n FROM z GROUP BY 1) SELECT id, n::BIGINT AS node_size FROM z JOIN n USING (component)")
def dataset_to_cells(spark, sf):
    """Saved, loaded, and a merged layer's sizes mapped back on the cells."""
    return _dataset(spark, sf).to_cells("zone", "node_size").select("id", F.col("node_size").cast("long").alias("node_size"))


@query("SELECT * FROM (VALUES ('layers', 'cell,zone'), ('merged', 'cell>zone'), ('taxonomies', 'shape'), ('zone', 'shape')) t(key, v)")
def dataset_manifest(spark, sf):
    d = _dataset(spark, sf)
    rows = [("layers", ",".join(d.layers)), ("merged", ",".join(f"{a}>{b}" for a, b in d.merged)), ("taxonomies", ",".join(d.taxonomies)), ("zone", d.taxonomy_of["zone"])]
    return spark.createDataFrame(rows, "key string, v string")


@query(WG + "SELECT id, CASE type_ix WHEN 0 THEN 'round' WHEN 1 THEN 'square' ELSE 'long' END AS type, type_ix::INT AS shape_id FROM g")
def dataset_types(spark, sf):
    d = _dataset(spark, sf)
    d.use_taxonomy("cell", "shape")
    return d.layers["cell"].units.join(d.taxonomies["shape"].types, "type_ix").select("id", "type", F.col("shape_id").cast("int").alias("shape_id"))


@query(WG + ", k AS (SELECT id, type_ix FROM g WHERE type_ix <> 1) SELECT (SELECT count(*) FROM k) AS units, (SELECT count(*) FROM e JOIN k a ON a.id = src JOIN k b ON b.id = dst) AS edges")
def dataset_filtered(spark, sf):
    n, e = grid(spark, sf)
    d = Dataset(spark, _folder(spark))
    d.add_cells(n, e)
    own = d.filter_cells(F.col("type_ix") != 1)
    return own.units.agg(F.count(F.lit(1)).alias("units")).join(own.edges.agg(F.count(F.lit(1)).alias("edges")), F.lit(True))


@query(
    WG + _ZONE + ", f AS (SELECT src, dst FROM u UNION ALL SELECT id, id FROM g), v AS (SELECT f.src AS id, b.type_ix AS bit, count(*) AS n FROM f JOIN g b ON b.id = f.dst GROUP BY 1, 2), "
    "x AS (SELECT g.id, t.bit, coalesce(v.n, 0) AS n FROM g CROSS JOIN (SELECT unnest([0, 1, 2]) AS bit) t LEFT JOIN v ON v.id = g.id AND v.bit = t.bit) "
    "SELECT component AS first_id, bit::INT AS bit, " + R("avg(n)") + " FROM x JOIN z USING (id) GROUP BY 1, 2"
)
def merged_layer_composition(spark, sf):
    """Zones with the mean composition of their cells' surroundings as features."""
    n, e = grid(spark, sf)
    env = E.environment_vector(E.graph_environment(e, n, 1), 3).select("id", F.col("vec").alias("env"))
    units, _, _ = Gr.contract_by_component(n.join(env, "id"), e, "env", 3)
    return units.select("first_id", F.posexplode("env").alias("bit", "v")).withColumn("v", r6("v"))


# graph, classes and views that had no query


@query(WG + "SELECT src, dst FROM e WHERE src % 2 = 0 AND dst % 2 = 0")
def graph_section_edges(spark, sf):
    n, e = grid(spark, sf)
    sections = n.withColumn("section", F.concat(F.lit("A_"), (F.col("id") % 2).cast("string")))
    return Gr.section_edges(e, sections, "A_0").select("src", "dst")


_KNN5 = (
    WL + ", m AS (SELECT id, bit, v - avg(v) OVER (PARTITION BY id) AS v FROM l), q AS (SELECT id, sqrt(sum(v * v)) AS s FROM m GROUP BY 1), "
    "d AS (SELECT a.id AS src, b.id AS dst, 1 - sum(a.v * b.v) / any_value(p.s * r.s) AS dist FROM m a JOIN m b ON a.bit = b.bit AND a.id % 5 = 0 AND b.id % 5 <> 0 JOIN q p ON p.id = a.id JOIN q r ON r.id = b.id GROUP BY 1, 2), "
    "n AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY round(dist, 12), dst) AS k FROM d), s AS (SELECT src, 't' || type_ix AS label, count(*) AS n FROM n JOIN c ON c.id = dst WHERE k <= 5 GROUP BY 1, 2) "
)


def _named(spark, sf):  # noqa: ANN001, ANN202
    return cells(spark, sf).withColumn("label", F.concat(F.lit("t"), F.col("type_ix").cast("string")))


@query(_KNN5 + "SELECT src AS id, label, " + R("n / 5", "share") + " FROM s")
def classify_knn_shares(spark, sf):
    """Trained on four fifths of the cells, for the other fifth."""
    c = _named(spark, sf)
    return K.NearestNeighbours(5, "correlation").train(c.filter("id % 5 <> 0")).shares(c.filter("id % 5 = 0")).withColumn("share", r6("share"))


@query(_KNN5 + ", p AS (SELECT src, s.label, n * w AS w FROM s JOIN (SELECT 't' || type_ix AS label, count(*) AS w FROM c GROUP BY 1) USING (label)) SELECT src AS id, label, " + R("w / sum(w) OVER (PARTITION BY src)", "p") + " FROM p")
def label_posterior(spark, sf):
    """The vote times how common each label is."""
    c = _named(spark, sf)
    shares = K.NearestNeighbours(5, "correlation").train(c.filter("id % 5 <> 0")).shares(c.filter("id % 5 = 0")).withColumnRenamed("share", "p")
    prior = shares.select("id", "label").join(c.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("p")), "label")
    return K.posterior(shares, prior).withColumn("p", r6("p"))


@query(W + "SELECT id, 't' || type_ix AS label FROM c")
def given_labels(spark, sf):
    c = _named(spark, sf)
    return K.GivenLabels().train(c.select("id", "label")).classify(c).select("id", "label")


@query(
    W + ", a AS (SELECT id, type_ix, abs(x) AS x, abs(y) AS y FROM c), n AS (SELECT a.id, 't' || b.type_ix AS label, row_number() OVER (PARTITION BY a.id ORDER BY round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 12), b.id) AS k "
    "FROM a JOIN a b ON a.id % 2 = 0 AND b.id % 2 = 1) SELECT id, label FROM n WHERE k = 1"
)
def nearest_in_space(spark, sf):
    c = _named(spark, sf).select("id", "label", F.col("x").alias("ccf_x"), F.col("y").alias("ccf_y"), F.lit(0.0).alias("ccf_z"))
    return K.NearestInSpace(1).train(c.filter("id % 2 = 1")).classify(c.filter("id % 2 = 0"))


@query("WITH " + G + f" SELECT 'fill' AS kind, CASE type_ix WHEN 0 THEN '#ff0000' ELSE '#00ff00' END AS rgb, {_WKT} AS wkt FROM g WHERE type_ix < 2 UNION ALL SELECT 'fill', NULL, {_WKT} FROM g WHERE type_ix = 2 UNION ALL SELECT 'boundary', NULL, {_WKT} FROM g WHERE id % 10 = 0")
def view_type_boundaries(spark, sf):
    n, _ = grid(spark, sf)
    tax = spark.createDataFrame([(0, "a", "#ff0000"), (1, "b", "#00ff00")], "type_ix int, type string, rgb string")
    g = _squares(spark, sf)
    return views.type_map_with_boundaries(n, tax, g, g.filter("unit_id % 10 = 0"))


@query(WL + ", s AS (SELECT id, section, log10(greatest(sum(v), 0) + 1) AS s FROM l GROUP BY 1, 2) SELECT section, unnest([0, 1, 2, 3, 4]) AS k, round(unnest(quantile_cont(s, [0.0, 0.25, 0.5, 0.75, 1.0])), 6) + 0.0 AS v FROM s GROUP BY 1")
def view_sum_quantiles(spark, sf):
    q = views.sum_quantiles(cells(spark, sf), "bits")
    return q.select("section", F.posexplode("q").alias("k", "v")).withColumn("v", r6("v"))


@query("SELECT p_partkey, " + R("-5 + 0.5 * (trunc((p_retailprice / 100 - (-5)) / 0.5)::INT + 0.5)", "back") + ", trunc((p_retailprice / 100 - (-5)) / 0.5)::INT AS ix FROM part")
def pixel_indices(spark, sf):
    ix = S.pixel_index(F.col("p_retailprice") / 100, -5.0, 0.5)
    return read(spark, sf, "part").select("p_partkey", r6(S.pixel_centre(ix, -5.0, 0.5)).alias("back"), ix.alias("ix"))


@query("SELECT strftime(l_shipdate, '%Y/%j') AS d, strftime(l_shipdate, '%Y-%m-%d_%H-%M-%S') AS stamp, count(*) AS n FROM lineitem GROUP BY 1, 2")
def time_stamps(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy/DDD").alias("d"), F.date_format("l_shipdate", "yyyy-MM-dd_HH-mm-ss").alias("stamp")).agg(F.count(F.lit(1)).alias("n"))


@query(WL + ", a AS (SELECT bit, type_ix, median(v) AS m FROM l GROUP BY 1, 2) SELECT type_ix, bit, " + R("m") + " FROM a")
def label_medians(spark, sf):
    return Z.grouped_feature_aggregates(cells(spark, sf), "type_ix", "bits", BITS, m=F.median).select("type_ix", F.posexplode("m").alias("bit", "v")).withColumn("v", r6("v"))


@query(WL + "SELECT a.bit AS i, b.bit AS j, " + R("covar_pop(a.v, b.v)", "cov") + " FROM l a JOIN l b USING (id) GROUP BY 1, 2")
def feature_covariances(spark, sf):
    _, _, cov = Z.moments(cells(spark, sf), "bits", BITS)
    rows = [(i, j, float(cov[i, j])) for i in range(BITS) for j in range(BITS)]
    return spark.createDataFrame(rows, "i int, j int, cov double").withColumn("cov", r6("cov"))


@query()
def ordered_matrix(spark, sf):
    """Rows and columns of types by sections, the largest entries on the diagonal."""
    t = cells(spark, sf).groupBy("type_ix", "section").agg(F.count(F.lit(1)).alias("n")).collect()  # types x sections
    types, sections = sorted({r["type_ix"] for r in t}), sorted({r["section"] for r in t})
    m = np.zeros((len(types), len(sections)))
    for r in t:
        m[types.index(r["type_ix"]), sections.index(r["section"])] = r["n"]
    rows, cols = Z.diagonal_order(m)
    return spark.createDataFrame([("row", k, str(types[i])) for k, i in enumerate(rows)] + [("col", k, sections[i]) for k, i in enumerate(cols)], "axis string, ix int, name string")


# SQL of queries that other modules register

SQL["graph_bridges"] = (
    WG + _ZONE + ", h1 AS (SELECT DISTINCT src, dst FROM u), h2 AS (SELECT DISTINCT a.src, b.dst FROM h1 a JOIN h1 b ON a.dst = b.src), h3 AS (SELECT DISTINCT a.src, b.dst FROM h2 a JOIN h1 b ON a.dst = b.src), "
    "f AS (SELECT src, dst FROM h2 UNION SELECT src, dst FROM h3) SELECT f.src, f.dst FROM f JOIN g a ON a.id = f.src JOIN g b ON b.id = f.dst JOIN z y ON y.id = f.src JOIN z w ON w.id = f.dst "
    "WHERE f.src < f.dst AND a.type_ix = b.type_ix AND y.component <> w.component AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.src = f.src AND h1.dst = f.dst)"
)
SQL["feature_covariance"] = (
    WL + "SELECT bit, " + R("avg(v)", "mean") + ", " + R("var_pop(v)", "var") + " FROM l GROUP BY 1"
)
SQL["poisson_density"] = (
    W + ", d AS (SELECT a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM c a JOIN c b ON a.section = b.section AND a.id <> b.id GROUP BY 1), t AS (SELECT max(d) AS top FROM d), "
    "h AS (SELECT least(floor(d / (top / 50)), 49) AS bin, count(*) AS n FROM d, t GROUP BY 1), k AS (SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS cdf FROM h) "
    "SELECT round(regr_slope(-ln(1 - cdf), pi() * pow((bin + 1) * (top / 50), 2)), 4) AS density FROM k, t WHERE cdf < 1"
)
SQL["rename_sections"] = (
    W + ", m AS (SELECT section, 'WTF01_' || printf('%.1f', avg(x)) AS name FROM c GROUP BY 1), k AS (SELECT section, name, row_number() OVER (PARTITION BY name ORDER BY section) - 1 AS k FROM m) SELECT section, CASE WHEN k > 0 THEN name || '_' || k ELSE name END AS section_name, count(*) AS n FROM k JOIN c USING (section) GROUP BY 1, 2"
)
SQL["correlated_sections"] = (
    W + ", n AS (SELECT section, type_ix, count(*) AS n FROM c GROUP BY 1, 2), f AS (SELECT s.section, t.type_ix, coalesce(n, 0) AS n FROM (SELECT DISTINCT section FROM c) s CROSS JOIN (SELECT DISTINCT type_ix FROM c) t LEFT JOIN n USING (section, type_ix)), "
    "p AS (SELECT a.section, b.section AS other, corr(a.n, b.n) AS r FROM f a JOIN f b USING (type_ix) WHERE a.section <> b.section GROUP BY 1, 2), m AS (SELECT section, avg(r) AS r FROM p GROUP BY 1) "
    "SELECT section, " + R("r", "r") + " FROM m WHERE abs(r - (SELECT median(r) FROM m)) < 2 * (SELECT stddev_pop(r) FROM m)"
)
SQL["classify_knn"] = _KNN5 + "SELECT id, label FROM (SELECT src AS id, label, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS k FROM s) WHERE k = 1"
SQL["log_log_fit"] = (
    "WITH v AS (SELECT log10(o_totalprice) AS v FROM orders WHERE o_totalprice > 0), b AS (SELECT min(v) AS lo, max(v) AS hi FROM v), h AS (SELECT least(floor((v - lo) / ((hi - lo) / 50)), 49) AS bin, count(*) AS n FROM v, b GROUP BY 1), "
    "x AS (SELECT log10(n) AS n, lo + (bin + 0.5) * ((hi - lo) / 50) AS x FROM h, b) SELECT round(regr_slope(n, x), 4) AS slope, round(regr_intercept(n, x), 4) AS intercept FROM x"
)
_POINTS = f"[{', '.join(f'{k} / 99.0' for k in range(100))}]"
SQL["norm_quantile_matching"] = (
    WL + f", a AS (SELECT bit, quantile_cont(v, {_POINTS}) AS q FROM l GROUP BY 1), b AS (SELECT bit, quantile_cont(v, {_POINTS}) AS r FROM l WHERE type_ix % 2 = 0 GROUP BY 1), "
    "k AS (SELECT id, bit, v, q, r, (len(list_filter(q[2:99], lambda t: t < v)) + 1)::INT AS k FROM l JOIN a USING (bit) JOIN b USING (bit)) SELECT id, bit, " + R("r[k] + (v - q[k]) * (r[k + 1] - r[k]) / (q[k + 1] - q[k])") + " FROM k"
)
SQL["norm_harmonise"] = (
    WL + ", f AS (SELECT bit, median(v) AS rm, stddev_pop(v) AS rd FROM l WHERE type_ix % 2 = 0 GROUP BY 1), o AS (SELECT bit, median(v) AS m FROM l GROUP BY 1), s AS (SELECT id, bit, v * rm / m AS v FROM l JOIN f USING (bit) JOIN o USING (bit)), "
    "t AS (SELECT avg(s) AS t FROM (SELECT sum(v) AS s FROM l WHERE type_ix % 2 = 0 GROUP BY id)), w AS (SELECT id, bit, v * t / sum(v) OVER (PARTITION BY id) AS v FROM s, t), n AS (SELECT bit, median(v) AS m, stddev_pop(v) AS d FROM w GROUP BY 1) "
    "SELECT id, bit, " + R("((v - m) / d + rm) * rd") + " FROM w JOIN n USING (bit) JOIN f USING (bit)"
)

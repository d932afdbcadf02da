"""Reading and writing by kind, and the importers. Row order is kept in explicit columns, never implied by files."""

from __future__ import annotations

import io as _io
import json
import warnings

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds of data and the format each is kept in.
FORMATS = {
    "anndata": "parquet", "layer": "parquet", "taxonomy": "parquet", "matrix": "csv", "metadata": "csv", "geom": "parquet", "config": "json", "mask": "parquet",
    "stitched": "parquet", "image": "parquet", "model": "binaryFile", "FF": "parquet", "constant": "parquet", "input_df": "parquet",
}
PARTITIONS = ("dataset", "section", "hybe", "channel")
CATALOG_COLUMNS = ("animal", "section_acq_name", "processing", "registration", "dataset", "registration_path", "processing_path", "dataset_path")


def location(path: str, kind: str, **where: str) -> str:
    """{path}/{kind}/dataset=.../section=...: partition folders in place of long file names."""
    unknown = set(where) - set(PARTITIONS)
    if unknown:
        raise ValueError(f"unknown partitions {sorted(unknown)}")
    return "/".join([path.rstrip("/"), kind, *[f"{k}={where[k]}" for k in PARTITIONS if where.get(k)]])


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save(df: DataFrame, path: str, kind: str, mode: str = "overwrite", **where: str) -> str:
    """Write by kind; images are clipped to 16 bits."""
    if kind not in FORMATS:
        raise ValueError(f"unknown kind {kind}")
    if kind == "image":
        df = df.withColumn("value", F.greatest(F.lit(0), F.least(F.round("value").cast("int"), F.lit(65535))))
    at = location(path, kind, **where)
    w = df.write.mode(mode)
    (w.option("header", True).csv(at) if FORMATS[kind] == "csv" else getattr(w, FORMATS[kind])(at))
    return at


def load(spark: SparkSession, path: str, kind: str, **where: str) -> DataFrame | None:
    """Read by kind; None if it is missing."""
    if kind not in FORMATS:
        raise ValueError(f"unknown kind {kind}")
    at = location(path, kind, **where)
    if not exists(spark, at):
        return None
    try:
        r = spark.read
        return r.option("header", True).option("inferSchema", True).csv(at) if FORMATS[kind] == "csv" else r.format(FORMATS[kind]).load(at)
    except AnalysisException as e:
        warnings.warn(f"{at} can't be read: {e}", stacklevel=2)
        return None


def update_config(spark: SparkSession, path: str, key: str, values: dict | None = None) -> dict:
    """Read a keyed configuration; with values, merge and rewrite it. One small JSON row a key."""
    at = f"{path.rstrip('/')}/config"
    rows = {r["key"]: json.loads(r["value"]) for r in spark.read.schema("key string, value string").json(at).collect()} if exists(spark, at) else {}
    if values is not None:
        rows[key] = {**rows.get(key, {}), **values}
        spark.createDataFrame([(k, json.dumps(v, default=str)) for k, v in rows.items()], "key string, value string").coalesce(1).write.mode("overwrite").json(f"{at}.new")
        # written aside first: the old rows are read until the new ones are complete
        spark.read.schema("key string, value string").json(f"{at}.new").coalesce(1).write.mode("overwrite").json(at)
    return rows.get(key, {})


def save_polygons(geoms: DataFrame, path: str) -> None:
    """Geometry with its position, partitioned by section and type."""
    geoms.select("section", "geom_type", "pos", "unit_id", "wkt").write.mode("overwrite").partitionBy("section", "geom_type").parquet(path)


def load_polygons(spark: SparkSession, path: str, sections: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.filter(F.col("section").isin(sections)) if sections else df
    return df.filter(F.col("geom_type").isin(kinds)) if kinds else df


def load_wkt_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, wkt) of text files with one geometry a line; pos is the line within its file, whole files being read as the unit."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("_l"))
    return t.select("file", F.posexplode("_l").alias("pos", "wkt")).filter(F.trim("wkt") != "")


def newest_catalog(listing: DataFrame) -> DataFrame:
    """The newest processing and newest registration of each (dataset, section); sections without a registration are left out.

    listing: (animal, dataset, section, kind processing|registration, name, path, mtime).
    """
    w = Window.partitionBy("dataset", "section", "kind").orderBy(F.desc("mtime"), F.desc("name"))
    top = listing.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    p = top.filter("kind = 'processing'").select("animal", "dataset", F.col("section").alias("section_acq_name"), F.col("name").alias("processing"), F.col("path").alias("processing_path"))
    r = top.filter("kind = 'registration'").select("dataset", F.col("section").alias("section_acq_name"), F.col("name").alias("registration"), F.col("path").alias("registration_path"))
    j = p.join(r, ["dataset", "section_acq_name"]).withColumn("dataset_path", F.regexp_replace("processing_path", "/[^/]+/?$", ""))
    return j.select(*CATALOG_COLUMNS)


def experiment_record(spark: SparkSession, info: dict) -> DataFrame:
    """One catalog row; what the metadata lack is unknown."""
    return spark.createDataFrame([tuple(str(info.get(c) or "unknown") for c in CATALOG_COLUMNS)], ", ".join(f"{c} string" for c in CATALOG_COLUMNS))


def read_matrix_market(spark: SparkSession, matrix: str, barcodes: str, features: str) -> DataFrame:
    """(cell_id, gene_id, gene_name, feature_type, count) of a coordinate matrix of genes by cells with its two name lists."""
    numbered = lambda path: spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda s: F.trim(s) != "")).alias("pos", "line"))
    b = numbered(barcodes).select((F.col("pos") + 1).alias("_c"), F.trim(F.split("line", "\t")[0]).alias("cell_id"))
    f = numbered(features).select((F.col("pos") + 1).alias("_g"), F.split("line", "\t").alias("_f"))
    f = f.select("_g", *[F.trim(F.get("_f", F.lit(i))).alias(n) for i, n in enumerate(("gene_id", "gene_name", "feature_type"))])
    lines = spark.read.text(matrix).withColumn("value", F.trim("value")).filter(~F.col("value").startswith("%"))
    # the size line names the numbers of genes, cells and entries; entries have three fields too, so it is told by its numbers
    n_genes, n_cells = f.count(), b.count()
    p = F.split("value", r"\s+")
    t = lines.select(p[0].cast("long").alias("_g"), p[1].cast("long").alias("_c"), p[2].cast("double").alias("count"), "value")
    total = lines.count() - 1
    t = t.filter(~((F.col("_g") == n_genes) & (F.col("_c") == n_cells) & (F.col("count") == total)))
    return t.join(b, "_c").join(f, "_g").select("cell_id", "gene_id", "gene_name", "feature_type", "count")


def cell_matrix(entries: DataFrame, genes: list[str]) -> DataFrame:
    """(cell_id, counts array in the order of genes)."""
    return entries.groupBy("cell_id").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("gene_id") == g, F.col("count"))), F.lit(0.0)) for g in genes]).alias("counts"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, cluster); empty with a warning if the file is missing."""
    if not exists(spark, path):
        warnings.warn(f"no clusters at {path}", stacklevel=2)
        return spark.createDataFrame([], "cell_id string, cluster int")
    c = spark.read.option("header", True).csv(path)
    return c.select(F.col("Barcode").alias("cell_id"), F.col("Cluster").cast("int").alias("cluster"))


def boundary_polygons(cells: DataFrame, boundaries: DataFrame, half: float = 1.0) -> DataFrame:
    """(cell_id, wkt) from ordered vertices (cell_id, ord, vertex_x, vertex_y); a cell with fewer than three has a square around its centroid."""
    v = boundaries.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("ord", "vertex_x", "vertex_y"))).alias("v")).filter(F.size("v") >= 3)
    text = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    ring = F.transform("v", lambda p: text(p["vertex_x"], p["vertex_y"]))
    poly = F.concat(F.lit("POLYGON (("), F.array_join(F.concat(ring, F.slice(ring, 1, 1)), ", "), F.lit("))"))
    x, y = F.col("x_centroid"), F.col("y_centroid")
    corners = [text(x + a * half, y + b * half) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    square = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *corners), F.lit("))"))
    return cells.join(v.withColumn("_p", poly), "cell_id", "left").select("cell_id", F.coalesce("_p", square).alias("wkt"))


def cluster_taxonomy(clusters: DataFrame) -> DataFrame:
    """(type_ix, type, features): clusters in order, named Cluster_i, identity features."""
    c = clusters.select("cluster").filter("cluster >= 0").distinct()
    n = c.count()  # a taxonomy
    c = c.withColumn("type_ix", F.row_number().over(Window.orderBy("cluster")) - 1)
    return c.select("type_ix", F.concat(F.lit("Cluster_"), F.col("cluster").cast("string")).alias("type"), F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda i: (i == F.col("type_ix")).cast("double")).alias("features"))


def load_ontology(spark: SparkSession, path: str) -> DataFrame:
    """(sid, id, acronym, name, rgb, path): a nested JSON ontology flattened, id 0 added, sid dense by id."""
    raw = json.loads(spark.read.text(path, wholetext=True).first()[0])
    rows, queue = [(0, "bg", "background", "000000", [])], [(raw, [])]
    while queue:
        node, above = queue.pop()
        if isinstance(node, list):
            queue += [(c, above) for c in node]
            continue
        trail = [*above, int(node["id"])]
        rows.append((int(node["id"]), node.get("acronym"), node.get("name"), str(node.get("color_hex_triplet", "")).zfill(6), trail))
        queue += [(c, trail) for c in node.get("children", [])]
    df = spark.createDataFrame(rows, "id long, acronym string, name string, rgb string, path array<long>")
    return df.withColumn("sid", F.row_number().over(Window.orderBy("id")) - 1)


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """(zi, yi, xi, id) of the non-zero voxels of .npy volumes or raw NRRD volumes; one file a task."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for content in b["content"]:
                v = parse_volume(bytes(content))
                for z in range(v.shape[0]):
                    y, x = np.nonzero(v[z])
                    yield pd.DataFrame({"zi": z, "yi": y, "xi": x, "id": v[z][y, x].astype(np.int64)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "zi int, yi int, xi int, id long")


def parse_volume(content: bytes) -> np.ndarray:
    if content[:6] == b"\x93NUMPY":
        return np.load(_io.BytesIO(content), allow_pickle=False)
    if content[:4] == b"NRRD":
        import gzip

        head, body = content.split(b"\n\n", 1)
        field = dict(line.split(": ", 1) for line in head.decode("ascii").splitlines() if ": " in line)
        kinds = {"uint8": "u1", "unsigned char": "u1", "uint16": "u2", "unsigned short": "u2", "uint32": "u4", "unsigned int": "u4", "float": "f4", "double": "f8", "int": "i4", "short": "i2"}
        if field["encoding"] in ("gzip", "gz"):
            body = gzip.decompress(body)
        order = ">" if field.get("endian") == "big" else "<"
        return np.frombuffer(body, order + kinds[field["type"]]).reshape([int(n) for n in field["sizes"].split()][::-1])
    raise ValueError("neither a .npy nor an NRRD volume")


def shuffled_batches(df: DataFrame, batch_size: int, key: str, seed: int = 0) -> DataFrame:
    """df plus batch: rows in a hashed order, in batches of a size within each partition."""
    n = df.repartition(F.xxhash64(F.lit(seed), key)).sortWithinPartitions(F.xxhash64(F.lit(seed), key))
    at = F.monotonically_increasing_id()
    return n.withColumn("_at", at).withColumn("batch", F.concat_ws("-", F.shiftright("_at", 33).cast("string"), F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / batch_size).cast("string"))).drop("_at")


def choose_acquisition(images: DataFrame, rnd: str) -> DataFrame:
    """(acq): among acquisitions of a round that imaged all positions, the one with the newest mean time; raises if there is none."""
    own = images.filter(F.col("hybe") == rnd).groupBy("acq").agg(F.countDistinct("position").alias("n"), F.avg("time").alias("t"))
    full = images.select("position").distinct().count()
    best = own.filter(F.col("n") == full).orderBy(F.desc("t"), "acq").limit(1)
    if not best.count():
        raise ValueError(f"no complete acquisition of {rnd}")
    return best.select("acq")


def complete_rounds(images: DataFrame) -> DataFrame:
    """Images of the rounds whose number of positions is the median, at positions that all of those have."""
    n = images.groupBy("acq").agg(F.countDistinct("position").alias("n"))
    m = n.agg(F.percentile_approx("n", 0.5)).first()[0]
    good = images.join(n.filter(F.col("n") == m).select("acq"), "acq", "left_semi")
    k = good.select("acq").distinct().count()
    shared = good.groupBy("position").agg(F.countDistinct("acq").alias("k")).filter(F.col("k") == k).select("position")
    return good.join(shared, "position", "left_semi")

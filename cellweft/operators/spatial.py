"""Geometry, rasters, atlas volumes and registration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.functions import arrays as A
from cellweft.operators.normalize import feature_aggregates

# triangulation


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (m x 3) by incremental insertion along a sorted order, with a walk to the containing triangle's cavity.

    Exact repeats of a point should be removed first; cocircular points are resolved by the order of insertion.
    """
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), np.int64)
    centre, span = points.mean(0), max(float(np.ptp(points, axis=0).max()), 1e-9)
    p = (points - centre) / span
    far = 1e4
    p = np.vstack([p, [[-far, -far], [far, -far], [0, far]]])
    tri: dict[int, tuple[int, int, int]] = {0: (n, n + 1, n + 2)}
    across: dict[tuple[int, int], int] = {(n, n + 1): 0, (n + 1, n + 2): 0, (n + 2, n): 0}
    fresh, last = 1, 0

    def orient(a: int, b: int, c: int) -> float:
        return (p[b, 0] - p[a, 0]) * (p[c, 1] - p[a, 1]) - (p[b, 1] - p[a, 1]) * (p[c, 0] - p[a, 0])

    def in_circle(t: tuple[int, int, int], d: int) -> bool:
        (ax, ay), (bx, by), (cx, cy) = (p[k] - p[d] for k in t)
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return ax * (by * c2 - cy * b2) - ay * (bx * c2 - cx * b2) + a2 * (bx * cy - cx * by) > 1e-14

    # a serpentine order keeps the walks short
    rows = np.floor((p[:n, 1] - p[:n, 1].min()) * math.sqrt(n))
    order = np.lexsort((np.where(rows % 2 == 0, p[:n, 0], -p[:n, 0]), rows))
    for d in order.tolist():
        t = last
        for _ in range(4 * n + 8):
            for a, b in ((0, 1), (1, 2), (2, 0)):
                u, v = tri[t][a], tri[t][b]
                if orient(u, v, d) < 0 and (v, u) in across:
                    t = across[(v, u)]
                    break
            else:
                break
        cavity, queue = {t}, [t]
        while queue:
            cur = queue.pop()
            for a, b in ((0, 1), (1, 2), (2, 0)):
                other = across.get((tri[cur][b], tri[cur][a]))
                if other is not None and other not in cavity and in_circle(tri[other], d):
                    cavity.add(other)
                    queue.append(other)
        rim = []
        for c in cavity:
            for a, b in ((0, 1), (1, 2), (2, 0)):
                u, v = tri[c][a], tri[c][b]
                if across.get((v, u)) not in cavity:
                    rim.append((u, v))
        for c in cavity:
            for a, b in ((0, 1), (1, 2), (2, 0)):
                across.pop((tri[c][a], tri[c][b]), None)
            del tri[c]
        for u, v in rim:
            tri[fresh] = (u, v, d)
            across[(u, v)] = across[(v, d)] = across[(d, u)] = fresh
            last, fresh = fresh, fresh + 1
    return np.array([t for t in tri.values() if max(t) < n], np.int64).reshape(-1, 3)


def spatial_graph(points: DataFrame, max_dist: float = 300.0) -> DataFrame:
    """(section, src, dst) of the Delaunay edges shorter than max_dist, a section a task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").drop_duplicates(["x", "y"])
        xy, ids = pdf[["x", "y"]].to_numpy(float), pdf["id"].to_numpy()
        t = delaunay(xy)
        e = np.unique(np.sort(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]]), axis=1), axis=0) if len(t) else np.array([[0, 1]] if len(xy) == 2 else np.zeros((0, 2)), np.int64)
        e = e[np.linalg.norm(xy[e[:, 0]] - xy[e[:, 1]], axis=1) < max_dist]
        a, b = ids[e[:, 0]], ids[e[:, 1]]
        return pd.DataFrame({"section": key[0], "src": np.minimum(a, b), "dst": np.maximum(a, b)})

    return points.select("section", "id", "x", "y").groupBy("section").applyInPandas(run, "section string, src long, dst long")


def clip_convex(poly: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A convex polygon cut to a rectangle (x0, y0, x1, y1)."""
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for i in range(len(poly)):
            a, b = poly[i - 1], poly[i]
            da, db = sign * (a[axis] - bound), sign * (b[axis] - bound)
            if (da >= 0) != (db >= 0):
                out.append(a + (b - a) * da / (da - db))
            if db >= 0:
                out.append(b)
        poly = np.array(out).reshape(-1, 2)
    return poly


def voronoi_cells(xy: np.ndarray, box: tuple[float, float, float, float] | None = None, margin: float = 0.05) -> list[np.ndarray]:
    """The Voronoi cell of each point, cut to a rectangle: reflections of the points at its sides close the outer cells."""
    lo, hi = xy.min(0), xy.max(0)
    pad = np.maximum((hi - lo) * margin, 1e-6)
    x0, y0, x1, y1 = box or (*(lo - pad), *(hi + pad))
    mirrored = [xy]
    for axis, bound in ((0, x0), (0, x1), (1, y0), (1, y1)):
        m = xy.copy()
        m[:, axis] = 2 * bound - m[:, axis]
        mirrored.append(m)
    every = np.vstack(mirrored)
    tri = delaunay(every)
    a, b, c = every[tri[:, 0]], every[tri[:, 1]], every[tri[:, 2]]
    d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
    d[np.abs(d) < 1e-300] = 1e-300
    sq = [(v * v).sum(1) for v in (a, b, c)]
    centre = np.stack([
        (sq[0] * (b[:, 1] - c[:, 1]) + sq[1] * (c[:, 1] - a[:, 1]) + sq[2] * (a[:, 1] - b[:, 1])) / d,
        (sq[0] * (c[:, 0] - b[:, 0]) + sq[1] * (a[:, 0] - c[:, 0]) + sq[2] * (b[:, 0] - a[:, 0])) / d,
    ], axis=1)
    cells = []
    owner = tri.ravel()
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(xy) + 1))
    for i in range(len(xy)):
        v = centre[order[starts[i] : starts[i + 1]] // 3]
        v = v[np.argsort(np.arctan2(v[:, 1] - xy[i, 1], v[:, 0] - xy[i, 0]))]
        cells.append(clip_convex(v, (x0, y0, x1, y1)))
    return cells


def wkt(ring: np.ndarray) -> str:
    pts = [*ring.tolist(), ring[0].tolist()] if len(ring) else []
    return "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in pts) + "))" if pts else "POLYGON EMPTY"


def voronoi_polygons(points: DataFrame, top_share: float | None = None) -> DataFrame:
    """(section, id, area, wkt) of the Voronoi cells. With top_share, cells whose area is above that quantile of the section are cut to the hull box of the points."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").drop_duplicates(["x", "y"])
        xy = pdf[["x", "y"]].to_numpy(float)
        cells = voronoi_cells(xy)
        area = np.array([polygon_area(c) for c in cells])
        if top_share is not None:
            limit = np.quantile(area, top_share)
            box = (*xy.min(0), *xy.max(0))
            cells = [clip_convex(c, box) if a > limit else c for c, a in zip(cells, area, strict=True)]
            area = np.array([polygon_area(c) for c in cells])
        return pd.DataFrame({"section": key[0], "id": pdf["id"].to_numpy(), "area": area, "wkt": [wkt(c) for c in cells]})

    return points.select("section", "id", "x", "y").groupBy("section").applyInPandas(run, "section string, id long, area double, wkt string")


def polygon_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


# polygons as vertex arrays


def rings(text: Column) -> Column:
    """Array of rings (arrays of (x, y)) of a POLYGON or MULTIPOLYGON; the first ring of a polygon is its outside."""
    parts = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def ring(s: Column) -> Column:
        xy = F.transform(F.split(F.trim(s), r"\s*,\s*"), lambda q: F.split(F.trim(q), r"\s+"))
        return F.transform(xy, lambda q: F.struct(q[0].cast("double").alias("x"), q[1].cast("double").alias("y")))

    return F.transform(parts, ring)


def vertices(geoms: DataFrame, inner: bool = True) -> DataFrame:
    """One row a vertex: ring (0 outside), ix, x, y."""
    r = geoms.withColumn("_r", rings(F.col("wkt"))).select(*[c for c in geoms.columns if c != "wkt"], F.posexplode("_r").alias("ring", "_v"))
    r = r if inner else r.filter("ring = 0")
    return r.select("*", F.posexplode("_v").alias("ix", "_p")).select(*[c for c in r.columns if c != "_v"], "ix", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def bounding_boxes(geoms: DataFrame, by: str = "unit_id") -> DataFrame:
    return vertices(geoms, inner=False).groupBy(by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def inside(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring (closed or not); edges along the ray are skipped."""
    n = F.size(ring)

    def crosses(v: Column, i: Column) -> Column:
        w = F.element_at(ring, F.when(i + 1 < n, i + 2).otherwise(F.lit(1)))
        straddles = (v["y"] > py) != (w["y"] > py)
        x_at = v["x"] + (py - v["y"]) / F.nullif(w["y"] - v["y"], F.lit(0.0)) * (w["x"] - v["x"])
        return F.when(straddles & (px < x_at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda s, x: s + x) % 2 == 1


def points_in_polygons(points: DataFrame, geoms: DataFrame, holes: bool = True, cell: float | None = None) -> DataFrame:
    """(id, unit_id) of the points in each polygon, holes of that polygon excluded. Points and bounding boxes meet in a grid, not by a cross join."""
    g = geoms.select("unit_id", rings(F.col("wkt")).alias("_r")).withColumn("_o", F.col("_r")[0])
    lo = lambda c: F.array_min(F.transform("_o", lambda v: v[c]))
    hi = lambda c: F.array_max(F.transform("_o", lambda v: v[c]))
    g = g.filter(F.size("_o") > 0).withColumns({"_x0": lo("x"), "_x1": hi("x"), "_y0": lo("y"), "_y1": hi("y")})
    if cell is None:
        cell = g.agg(F.avg(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")))).first()[0] or 1.0
    at = lambda c: F.floor(c / cell)
    g = g.withColumn("_gx", F.explode(F.sequence(at(F.col("_x0")), at(F.col("_x1"))))).withColumn("_gy", F.explode(F.sequence(at(F.col("_y0")), at(F.col("_y1")))))
    p = points.select("id", "x", "y").withColumns({"_gx": at(F.col("x")), "_gy": at(F.col("y"))})
    hit = inside(F.col("x"), F.col("y"), F.col("_o"))
    if holes:
        hit = hit & ~F.exists(F.slice("_r", 2, F.greatest(F.size("_r") - 1, F.lit(0))), lambda h: inside(F.col("x"), F.col("y"), h))
    return p.join(g, ["_gx", "_gy"]).filter(hit).select("id", "unit_id")


def dissolve(geoms: DataFrame, by: str, digits: int = 9) -> DataFrame:
    """(by, wkt): union of adjoining polygons, by cancelling the edges that two of them share; the boundary edges are chained to rings."""
    v = geoms.select(by, "unit_id", F.col("wkt"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        edges: dict[tuple, int] = {}
        for text in pdf["wkt"]:
            for ring in parse_rings(text):
                ring = [tuple(round(c, digits) for c in q) for q in ring]
                area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
                ring = ring if area > 0 else ring[::-1]
                for e in zip(ring, ring[1:], strict=False):
                    if e[0] == e[1]:
                        continue
                    if edges.get(e[::-1]):
                        edges[e[::-1]] -= 1
                    else:
                        edges[e] = edges.get(e, 0) + 1
        nxt: dict[tuple, list] = {}
        for (a, b), c in sorted(edges.items()):
            nxt.setdefault(a, []).extend([b] * c)
        out = []
        for start in sorted(nxt):
            while nxt[start]:
                ring, at = [start], nxt[start].pop()
                while at != start and nxt.get(at):
                    ring.append(at)
                    at = nxt[at].pop()
                out.append("((" + ", ".join(f"{x!r} {y!r}" for x, y in [*ring, ring[0]]) + "))")
        return pd.DataFrame({by: [key[0]], "wkt": ["MULTIPOLYGON (" + ", ".join(out) + ")"]})

    kind = geoms.schema[by].dataType.simpleString()
    return v.groupBy(by).applyInPandas(run, f"{by} {kind}, wkt string")


def parse_rings(text: str) -> list[list[tuple[float, float]]]:
    out = []
    for part in text.replace("(", ")").split(")"):
        if any(ch.isdigit() for ch in part):
            out.append([tuple(map(float, q.split()[:2])) for q in part.split(",") if q.strip()])
    return out


def principal_angle(points: DataFrame, by: str = "section") -> DataFrame:
    """(section, angle in radians) of the first principal axis, closed form."""
    return points.groupBy(by).agg((0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))).alias("angle"))


def principal_rotation(points: DataFrame, by: str = "section") -> DataFrame:
    """Points turned so that the first principal axis lies along x, about the section's mean, without reflection."""
    m = points.groupBy(by).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), (0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))).alias("_t"))
    dx, dy = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    out = points.join(m, by).withColumns({"x": dx * F.cos("_t") + dy * F.sin("_t"), "y": dy * F.cos("_t") - dx * F.sin("_t")})
    return out.select(*points.columns)


# rasters as (row, col, value)


def point_raster(points: DataFrame, step: float, value: str | None = None, how: str = "count", by: list[str] | None = None) -> DataFrame:
    """(row, col, value): count of points, or an aggregate (avg, sum, min, max) of a column, in cells of a size."""
    b = points.agg(F.min("x").alias("x"), F.min("y").alias("y")).first()
    cells = points.withColumns({"col": F.floor((F.col("x") - b["x"]) / step).cast("int"), "row": F.floor((F.col("y") - b["y"]) / step).cast("int")})
    agg = F.count(F.lit(1)) if how == "count" else getattr(F, how)(value)
    return cells.groupBy(*(by or []), "row", "col").agg(agg.alias("value"))


def commonest_category(points: DataFrame, step: float, category: str, most: int | None = None) -> DataFrame:
    """(row, col, category, value): the category with the most points (counts cut at `most`), ties to the smaller."""
    n = point_raster(points, step, by=[category])
    n = n.withColumn("value", F.least("value", F.lit(most))) if most else n
    return n.groupBy("row", "col").agg(F.min_by(F.struct(F.col(category).alias("category"), "value"), F.struct(-F.col("value"), F.col(category))).alias("_b")).select("row", "col", "_b.category", "_b.value")


def block_aggregate(raster: DataFrame, factor: int, how: str = "avg", rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Raster reduced by factor x factor blocks; with the extents given, ragged edges are left out."""
    r = raster
    for c, n in (("row", rows), ("col", cols)):
        r = r.filter(F.col(c) < n // factor * factor) if n is not None else r
    f = F.median if how == "median" else getattr(F, how)
    return r.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(f("value").alias("value"))


def gaussian_kernel(sigma: float, reach: float = 4.0) -> list[tuple[int, float]]:
    k = int(reach * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) if sigma > 0 else 1.0 for i in range(-k, k + 1)]
    return [(i - k, v / sum(w)) for i, v in enumerate(w)]


def smooth(raster: DataFrame, sigma: float, normalised: bool = True, axes: tuple[str, ...] = ("row", "col"), by: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian smoothing, one axis after the other: each cell is spread to its neighbours and summed.

    normalised divides by the spread of the known cells, so that absent and null cells are skipped and only known cells are returned; otherwise absent cells count 0 and
    the result covers every cell that is reached.
    """
    kernel = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(w).alias("w")) for i, w in gaussian_kernel(sigma)])
    keys = [*by, *axes]
    r = raster.filter(F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("value"), F.lit(1.0).alias("_m"))
    for axis in axes:
        s = r.withColumn("_k", F.explode(kernel)).withColumn(axis, F.col(axis) + F.col("_k.o"))
        r = s.groupBy(*keys).agg(F.sum(F.col("value") * F.col("_k.w")).alias("value"), F.sum(F.col("_m") * F.col("_k.w")).alias("_m"))
    if not normalised:
        return r.drop("_m")
    return r.withColumn("value", F.col("value") / F.col("_m")).drop("_m").join(raster.filter(F.col("value").isNotNull()).select(*keys), keys, "left_semi")


def zoom(raster: DataFrame, rows: int, cols: int, factor: float) -> DataFrame:
    """Raster of a shape resized by linear interpolation, corners on corners; absent and null cells are left out of the weights, and a result without any weight is absent."""
    out = (max(1, round(rows * factor)), max(1, round(cols * factor)))
    at = lambda c, n, m: F.col(c) * F.lit((n - 1) / max(m - 1, 1))
    # each known cell feeds the result cells within one step of it
    scale = [(m - 1) / max(n - 1, 1) for n, m in zip((rows, cols), out, strict=True)]
    near = lambda c, k, m: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - 1) * scale[k])).cast("int"), F.least(F.lit(m - 1), F.floor((F.col(c) + 1) * scale[k])).cast("int"))
    r = raster.filter(F.col("value").isNotNull()).withColumn("_r", F.explode(near("row", 0, out[0]))).withColumn("_c", F.explode(near("col", 1, out[1])))
    w = F.greatest(F.lit(0.0), 1 - F.abs(at("_r", rows, out[0]) - F.col("row"))) * F.greatest(F.lit(0.0), 1 - F.abs(at("_c", cols, out[1]) - F.col("col")))
    s = r.withColumn("_w", w).groupBy(F.col("_r").alias("row"), F.col("_c").alias("col")).agg(F.sum(F.col("value") * F.col("_w")).alias("_v"), F.sum("_w").alias("_w"))
    return s.filter("_w > 0").select("row", "col", (F.col("_v") / F.col("_w")).alias("value"))


def dilate(raster: DataFrame, reach: int = 1) -> DataFrame:
    """Maximum over the square of cells around each cell reached."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    spread = raster.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step)).withColumns({"row": F.col("row") + F.col("_i"), "col": F.col("col") + F.col("_j")})
    return spread.groupBy("row", "col").agg(F.max("value").alias("value"))


def erode(mask: DataFrame, reach: int = 1) -> DataFrame:
    """Cells of a mask (rows present) whose whole square around is in the mask."""
    d = mask.select("row", "col").withColumn("value", F.lit(1))
    step = F.sequence(F.lit(-reach), F.lit(reach))
    n = d.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step)).withColumns({"row": F.col("row") + F.col("_i"), "col": F.col("col") + F.col("_j")})
    full = n.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == (2 * reach + 1) ** 2)
    return full.select("row", "col", F.lit(1).alias("value"))


def closing(mask: DataFrame, reach: int = 1) -> DataFrame:
    """Dilation, then erosion."""
    return erode(dilate(mask.select("row", "col", F.lit(1).alias("value")), reach), reach)


def mask_from_points(points: DataFrame, step: float, reach: int) -> DataFrame:
    """Cells that hold points, grown and closed."""
    return closing(dilate(point_raster(points, step).withColumn("value", F.lit(1)), 1), reach)


def raster_outlines(raster: DataFrame, label: str = "value") -> DataFrame:
    """(label, wkt): each label's cells as one multipolygon of unit squares dissolved."""
    r, c = F.col("row"), F.col("col")
    corner = lambda dx, dy: F.concat_ws(" ", (c + dx).cast("double").cast("string"), (r + dy).cast("double").cast("string"))
    square = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)), F.lit("))"))
    return dissolve(raster.select(F.col(label).alias("label"), F.monotonically_increasing_id().alias("unit_id"), square.alias("wkt")), "label")


def crop(raster: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Rows and columns between the first and last whose sum exceeds a share of the largest such sum."""
    for axis in ("row", "col"):
        s = raster.groupBy(axis).agg(F.sum("value").alias("s"))
        top = s.agg(F.max("s")).first()[0] or 0
        b = s.filter(F.col("s") > threshold * top).agg(F.min(axis).alias("lo"), F.max(axis).alias("hi")).first()
        if b["lo"] is not None:
            raster = raster.filter(F.col(axis).between(b["lo"], b["hi"]))
    return raster


def centre_pad(raster: DataFrame, own: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Shift so that a raster of one shape lies centred in another."""
    return raster.withColumns({"row": F.col("row") + (target[0] - own[0]) // 2, "col": F.col("col") + (target[1] - own[1]) // 2})


def first_writer_mosaic(pixels: DataFrame) -> DataFrame:
    """(row, col, value): of the tiles that cover a pixel, the first by tile order whose guide value is not zero."""
    return pixels.filter(F.col("guide") != 0).groupBy("row", "col").agg(F.min_by("value", "tile").alias("value"), F.min("tile").alias("tile"))


def max_mosaic(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("row", "col").agg(F.max("value").alias("value"))


def tile_shifts(tiles: DataFrame) -> DataFrame:
    """Tiles (tile, dy, dx, ok): failed shifts take the median of the good ones."""
    m = tiles.filter("ok").agg(F.median("dy").alias("dy"), F.median("dx").alias("dx")).first()
    fill = lambda c: F.when(F.col("ok"), F.col(c)).otherwise(F.lit(m[c]))
    return tiles.withColumns({"dy": fill("dy"), "dx": fill("dx")})


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """Shift of b against a by phase correlation, the four wrapped candidates told apart by the overlap's correlation; error is -log of it."""
    w = np.hanning(a.shape[0])[:, None] * np.hanning(a.shape[1])[None, :]
    f = np.fft.fft2((a - a.mean()) * w) * np.conj(np.fft.fft2((b - b.mean()) * w))
    c = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)).real
    y, x = np.unravel_index(np.argmax(c), c.shape)
    best = (0, 0, math.inf)
    for dy in (y, y - a.shape[0]):
        for dx in (x, x - a.shape[1]):
            ya, xa = slice(max(dy, 0), a.shape[0] + min(dy, 0)), slice(max(dx, 0), a.shape[1] + min(dx, 0))
            yb, xb = slice(max(-dy, 0), a.shape[0] + min(-dy, 0)), slice(max(-dx, 0), a.shape[1] + min(-dx, 0))
            p, q = a[ya, xa].ravel(), b[yb, xb].ravel()
            if p.size > 8 and p.std() > 0 and q.std() > 0:
                r = np.corrcoef(p, q)[0, 1]
                err = -math.log(r) if r > 0 else math.inf
                if err < best[2]:
                    best = (int(dy), int(dx), err)
    return best


def register_tiles(pairs: DataFrame) -> DataFrame:
    """(tile, dy, dx, error) of pairs of tiles given as nested arrays fixed and moving."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = [phase_shift(np.array([*map(list, f)], float), np.array([*map(list, m)], float)) for f, m in zip(b["fixed"], b["moving"], strict=True)]
            yield pd.DataFrame({"tile": b["tile"], "dy": [r[0] for r in rows], "dx": [r[1] for r in rows], "error": [r[2] for r in rows]})

    return pairs.select("tile", "fixed", "moving").mapInPandas(run, "tile long, dy int, dx int, error double")


def _windows(img: np.ndarray, size: int) -> np.ndarray:
    """The size x size values around each pixel, sorted, borders mirrored; an even window reaches further back."""
    before, after = size // 2, size - size // 2 - 1
    padded = np.pad(img, ((before, after), (before, after)), mode="symmetric")
    return np.sort(np.lib.stride_tricks.sliding_window_view(padded, (size, size)).reshape(*img.shape, -1), axis=2)


def _gaussian(img: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along every axis, borders mirrored."""
    k = np.array([w for _, w in gaussian_kernel(sigma)])
    out = img.astype(float)
    for axis in range(img.ndim):
        out = np.apply_along_axis(lambda v: np.convolve(np.pad(v, len(k) // 2, mode="symmetric"), k, mode="valid"), axis, out)
    return out


def _rolled_ball(img: np.ndarray, radius: float) -> np.ndarray:
    """Height of the centre of a ball's top that rolls below the surface: the least, over the ball, of the value plus how far the ball lies below its top there."""
    r = int(np.ceil(radius))
    padded = np.pad(img.astype(float), r, constant_values=np.inf)
    out = np.full(img.shape, np.inf)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            left = radius * radius - dy * dy - dx * dx
            if left >= 0:
                out = np.minimum(out, padded[r + dy : r + dy + img.shape[0], r + dx : r + dx + img.shape[1]] + radius - np.sqrt(left))
    return out


def _blocks_up(img: np.ndarray, how: str, value: str) -> np.ndarray:
    """Blocks reduced, smoothed on request, and drawn up to the image's size by linear interpolation."""
    block = []
    for n, want in zip(img.shape, value.split("|"), strict=True):
        whole = [d for d in range(1, n) if n % d == 0] or [1]
        block.append(min(whole, key=lambda d: (abs(d - int(want)), d)))
    parts = img.reshape(img.shape[0] // block[0], block[0], img.shape[1] // block[1], block[1]).swapaxes(1, 2).reshape(img.shape[0] // block[0], img.shape[1] // block[1], -1)
    if "percentile" in how:
        digits = [t for t in how.replace("_", " ").split() if t.replace(".", "").isdigit()]
        small = np.percentile(parts, float(digits[0]) if digits else 50.0, axis=2)
    else:
        small = next((f for name, f in (("mean", np.mean), ("median", np.median), ("max", np.max), ("min", np.min)) if name in how), np.mean)(parts, axis=2)
    small = _gaussian(small, 1) if "smooth" in how else small
    for axis, n in enumerate(img.shape):
        at = np.linspace(0, n, small.shape[axis])
        small = np.apply_along_axis(lambda v, at=at, n=n: np.interp(np.arange(n), at, v), axis, small)
    return small


def filter_image(img: np.ndarray, how: str, value: float | str) -> np.ndarray:
    """The filtered image, or the background that a filter finds.

    gaussian (sigma); median, minimum, percentile_p (window size); rolling_ball (radius, smoothed before and after); spline, with mean, median, max, min,
    percentile_p or smooth in the name (block "height|width"); polyfit_d (percentile of the row and column profiles, fitted to degree d and averaged).
    A name with robust or robust[lo,hi] clips at these percentiles (5 and 95) first. Any other name gives zeros.
    """
    if "robust" in how:
        low, high = (float(v) for v in how.split("[")[1].split("]")[0].split(",")) if "[" in how else (5.0, 95.0)
        img = np.clip(img, *np.percentile(img, [low, high]))
    if "gaussian" in how:
        return _gaussian(img, float(value))
    if how in ("median", "minimum"):
        w = _windows(img, int(value))
        return w[:, :, w.shape[2] // 2 if how == "median" else 0]
    if "rolling_ball" in how:
        return _gaussian(_rolled_ball(_gaussian(img, float(value) / 5), float(value)), float(value))
    if "spline" in how:
        return _blocks_up(img, how, str(value))
    if "percentile" in how:
        w = _windows(img, int(value))
        return w[:, :, min(int(w.shape[2] * int(how.split("_")[-1]) / 100), w.shape[2] - 1)]
    if "polyfit" in how:
        degree, profiles = int(how.split("_")[1]), []
        for axis in (0, 1):
            p = _gaussian(np.percentile(img, float(value), axis=axis), 1)
            profiles.append(np.polyval(np.polyfit(np.arange(len(p)), p, degree), np.arange(len(p))))
        return (profiles[0][None, :] + profiles[1][:, None]) / 2
    return np.zeros_like(img, float)


def filter_images(pixels: DataFrame, how: str, value: float | str, by: str = "image") -> DataFrame:
    """Each whole image of (image, row, col, value) filtered, one image a task; absent pixels count 0."""
    kind = pixels.schema[by].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        img = np.zeros((r.max() + 1, c.max() + 1))
        img[r, c] = pdf["value"]
        out = filter_image(img, how, value)
        rows, cols = np.indices(out.shape)
        return pd.DataFrame({by: key[0], "row": rows.ravel(), "col": cols.ravel(), "value": out.ravel().astype(float)})

    return pixels.select(by, F.col("row").cast("int"), F.col("col").cast("int"), F.col("value").cast("double")).groupBy(by).applyInPandas(run, f"{by} {kind}, row int, col int, value double")


def subtract_background(pixels: DataFrame, smoothing: tuple[str, float | str] | None, background: tuple[str, float | str] | None, by: str = "image") -> DataFrame:
    """Smoothed, the background of the smoothed image taken off, clipped at 0; either step may be left out."""
    smooth_one = filter_images(pixels, *smoothing, by=by) if smoothing else pixels.select(by, "row", "col", F.col("value").cast("double").alias("value"))
    if not background:
        return smooth_one.withColumn("value", F.greatest(F.lit(0.0), F.col("value")))
    low = filter_images(smooth_one, *background, by=by).withColumnRenamed("value", "_b")
    return smooth_one.join(low, [by, "row", "col"]).select(by, "row", "col", F.greatest(F.lit(0.0), F.col("value") - F.col("_b")).alias("value"))


def edge_preserving(img: np.ndarray, alpha: float = 1.0, beta: float = 0.1, epsilon: float = 0.05, rounds: int = 5, inner: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(smoothed image, edge map): smoothing that stops at edges, by alternating two linear problems, each solved by conjugate gradients.

    The image u minimises |u - img|^2 + alpha * v^2 |grad u|^2; the edge map v (1: no edge) minimises alpha * v^2 |grad u|^2 + beta * (epsilon |grad v|^2 + (1 - v)^2 / (4 epsilon)).
    """

    def grad(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(a, axis=0, append=a[-1:]), np.diff(a, axis=1, append=a[:, -1:])

    def div(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The negative adjoint of grad."""
        p, q = p.copy(), q.copy()
        p[-1], q[:, -1] = 0, 0
        return np.diff(p, axis=0, prepend=0) + np.diff(q, axis=1, prepend=0)

    def solve(apply, right: np.ndarray, x: np.ndarray) -> np.ndarray:  # noqa: ANN001
        r = right - apply(x)
        d, rr = r.copy(), (r * r).sum()
        for _ in range(inner):
            if rr < 1e-12:
                break
            ad = apply(d)
            step = rr / (d * ad).sum()
            x, r = x + step * d, r - step * ad
            new = (r * r).sum()
            d, rr = r + new / rr * d, new
        return x

    u, v = img.astype(float).copy(), np.ones(img.shape)
    for _ in range(rounds):
        w = v * v
        u = solve(lambda a, w=w: a - alpha * div(*(w * g for g in grad(a))), img.astype(float), u)
        slope = sum(g * g for g in grad(u))
        v = solve(lambda a, s=slope: (alpha * s + beta / (4 * epsilon)) * a - beta * epsilon * div(*grad(a)), np.full(img.shape, beta / (4 * epsilon)), v)
    return u, v


def flat_field(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field, constant) rasters of a stack (image, row, col, value): per pixel, the least value is the constant and the median above it, relative to its mean, inverted, the field."""
    px = pixels.groupBy("row", "col").agg(F.percentile_approx("value", 0.01).cast("double").alias("constant"), F.median("value").alias("_m"))
    px = px.withColumn("_s", F.greatest(F.col("_m") - F.col("constant"), F.lit(1e-6)))
    mean = px.agg(F.avg("_s")).first()[0]
    return px.select("row", "col", (F.lit(mean) / F.col("_s")).alias("value")), px.select("row", "col", F.col("constant").alias("value"))


def correct_optics(raster: DataFrame, field: DataFrame, constant: DataFrame) -> DataFrame:
    """(value - constant) * field, at least 1."""
    j = raster.join(field.withColumnRenamed("value", "_f"), ["row", "col"]).join(constant.withColumnRenamed("value", "_c"), ["row", "col"])
    return j.withColumn("value", F.greatest((F.col("value") - F.col("_c")) * F.col("_f"), F.lit(1.0))).drop("_f", "_c")


def cells_from_pixels(pixels: DataFrame, bits: list[str], how: str = "median", least: float = 100.0) -> DataFrame:
    """One row a label (0 is background): each bit reduced, centroid, size, median dapi, sum; kept if the largest bit exceeds `least`. median is the lower one."""
    reducers = {"median": lambda c: F.percentile_approx(c, 0.5, 10_000_000), "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    if how not in reducers:
        raise ValueError(f"unknown reduction {how}")
    out = pixels.filter("label <> 0").groupBy("label").agg(
        F.array(*[reducers[how](b).cast("double") for b in bits]).alias("bits"), F.avg("row").alias("y"), F.avg("col").alias("x"), F.count(F.lit(1)).alias("size"), F.median("dapi").alias("dapi")
    )
    return out.withColumn("sum", A.total(F.col("bits"))).filter(F.array_max("bits") > least)


def threshold_segments(raster: DataFrame, threshold: float) -> DataFrame:
    """(row, col, label): 4-connected components of the pixels above a threshold, labels by the first pixel."""
    from cellweft.operators.graph import components

    on = raster.filter(F.col("value") > threshold).withColumn("id", F.col("row").cast("long") * F.lit(1 << 31) + F.col("col"))
    right = on.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = on.select(F.col("id").alias("src"), (F.col("id") + (1 << 31)).alias("dst"))
    e = right.union(down).join(on.select(F.col("id").alias("dst")), "dst", "left_semi")
    return on.join(components(e, on), "id").select("row", "col", F.col("component").alias("label"))


def nuclear_score(cells: DataFrame, bits: str, n: int, nuclear: str | None = None) -> DataFrame:
    """cells plus qc_sum, the density of the log10 row sum about its median relative to its mode, and for nuclear features plus nuc_score, an array.

    Nuclear values, at least 1, are divided by their feature's median over the cells and then by their cell's median; what they are off their cell's median, in
    units of the mean deviation of a cell, has that density.
    """
    s = cells.withColumn("_l", F.log10(F.greatest(A.total(F.col(bits)), F.lit(1.0))))
    m = s.agg(F.median("_l").alias("m"), F.stddev_pop("_l").alias("d")).first()
    z = (F.col("_l") - m["m"]) / (m["d"] or 1.0)
    s = s.withColumn("qc_sum", F.exp(-z * z / 2)).drop("_l")
    if nuclear is None:
        return s
    rows = s.withColumn("_x", F.transform(nuclear, lambda v: F.greatest(v.cast("double"), F.lit(1.0))))
    med = feature_aggregates(rows, "_x", n, m=F.median)["m"]
    even = F.zip_with("_x", A.literal(med), lambda v, k: v / k)
    own = A.let(even, lambda e: A.let(A.median(e), lambda k: F.transform(e, lambda v: v / k)))
    # the median of a row divided by its median is 1
    rows = rows.withColumn("_x", F.transform(own, lambda v: v - F.lit(1.0)))
    spread = A.let(A.centred(F.col("_x")), A.norm) / F.sqrt(F.lit(float(n)))
    mean = rows.agg(F.avg(spread)).first()[0] or 1.0
    return rows.withColumn("nuc_score", F.transform("_x", lambda v: F.exp(-(v / F.lit(mean)) * (v / F.lit(mean)) / 2))).drop("_x")


# volumes as (zi, yi, xi, id)

_NEAR = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


def _neighbours(voxels: DataFrame) -> DataFrame:
    """Each voxel's id at the 26 places around it: (zi, yi, xi, _near)."""
    steps = F.array(*[F.struct(F.lit(a).alias("z"), F.lit(b).alias("y"), F.lit(c).alias("x")) for a, b, c in _NEAR])
    s = voxels.withColumn("_s", F.explode(steps))
    return s.select((F.col("zi") + F.col("_s.z")).alias("zi"), (F.col("yi") + F.col("_s.y")).alias("yi"), (F.col("xi") + F.col("_s.x")).alias("xi"), F.col("id").alias("_near"))


def border_voxels(voxels: DataFrame) -> DataFrame:
    """Voxels next to a different non-zero id."""
    return voxels.join(_neighbours(voxels.filter("id <> 0")), ["zi", "yi", "xi"]).filter("_near <> id").select("zi", "yi", "xi", "id").distinct()


def known_volume(voxels: DataFrame, ontology: DataFrame) -> DataFrame:
    """Ids that the ontology lacks become 0."""
    known = ontology.select("id").withColumn("_k", F.lit(1))
    return voxels.join(known, "id", "left").withColumn("id", F.when(F.col("_k").isNull(), F.lit(0)).otherwise(F.col("id"))).drop("_k")


def fill_borders(labels: DataFrame, borders: DataFrame) -> DataFrame:
    """Border voxels take the largest label among themselves and their neighbours."""
    near = _neighbours(labels.select("zi", "yi", "xi", F.col("label").alias("id"))).groupBy("zi", "yi", "xi").agg(F.max("_near").alias("_m"))
    own = labels.join(borders.select("zi", "yi", "xi", F.lit(1).alias("_b")), ["zi", "yi", "xi"], "left").join(near, ["zi", "yi", "xi"], "left")
    return own.withColumn("label", F.when(F.col("_b") == 1, F.greatest("label", F.coalesce("_m", "label"))).otherwise(F.col("label"))).drop("_b", "_m")


def labelled_volume(voxels: DataFrame) -> DataFrame:
    """(zi, yi, xi, id, label): 26-connected components of the non-zero voxels once region borders are taken out; borders then take a neighbour's label."""
    from cellweft.operators.graph import components

    b = border_voxels(voxels)
    key = (F.col("zi").cast("long") * (1 << 20) + F.col("yi")) * (1 << 20) + F.col("xi")
    core = voxels.filter("id <> 0").join(b, ["zi", "yi", "xi"], "left_anti").withColumn("vid", key)
    near = _neighbours(core.select("zi", "yi", "xi", F.col("vid").alias("id")))
    e = near.join(core.select("zi", "yi", "xi", "vid"), ["zi", "yi", "xi"]).select(F.col("vid").alias("src"), F.col("_near").alias("dst"))
    c = components(e, core.select(F.col("vid").alias("id"))).withColumnRenamed("id", "vid")
    labels = voxels.withColumn("vid", key).join(c, "vid", "left").withColumn("label", F.coalesce(F.col("component") + 1, F.lit(0))).drop("vid", "component")
    return fill_borders(labels, b)


def atlas_lookup(points: DataFrame, voxels: DataFrame, ontology: DataFrame, resolution_um: float, shape: tuple[int, int, int], outside: int = 997) -> DataFrame:
    """points (x, y, z in mm) with parcel_id (0 and absent become `outside`), acronym, and name of the voxel they fall in."""
    from cellweft.functions.scalars import voxel_index

    at = {c: voxel_index(F.col(c[0]), resolution_um, n) for c, n in zip(("zi", "yi", "xi"), shape, strict=True)}
    p = points.withColumns(at).join(voxels.select("zi", "yi", "xi", F.col("id").alias("_id")), ["zi", "yi", "xi"], "left")
    p = p.withColumn("parcel_id", F.when(F.coalesce("_id", F.lit(0)) == 0, F.lit(outside)).otherwise(F.col("_id"))).drop("_id")
    return p.join(ontology.select(F.col("id").alias("parcel_id"), "acronym", "name"), "parcel_id", "left")


def spatial_prior(reference: DataFrame, label: str, bin_size: float, sigma: float, by: tuple[str, ...] = ("xi", "yi", "zi")) -> DataFrame:
    """(voxel, label, p): smoothed label counts, normalised over the labels of each voxel."""
    from pyspark.sql.window import Window

    b = reference.withColumns({v: F.round(F.col(v[0]) / bin_size).cast("int") for v in by})
    n = b.groupBy(label, *by).agg(F.count(F.lit(1)).alias("value"))
    s = smooth(n, sigma / bin_size, normalised=False, axes=by, by=(label,))
    return s.withColumn("p", F.col("value") / F.sum("value").over(Window.partitionBy(*by))).drop("value")


def prior_of(points: DataFrame, prior: DataFrame, bin_size: float, label: str, by: tuple[str, ...] = ("xi", "yi", "zi")) -> DataFrame:
    """(id, label, p) of the voxel nearest to each point; a point in an empty voxel has equal priors."""
    labels = prior.select(label).distinct()
    p = points.withColumns({v: F.round(F.col(v[0]) / bin_size).cast("int") for v in by}).select("id", *by)
    hit = p.join(prior, list(by)).select("id", label, "p")
    none = p.join(hit.select("id").distinct(), "id", "left_anti").select("id")
    k = labels.count()
    return hit.unionByName(none.crossJoin(F.broadcast(labels)).withColumn("p", F.lit(1.0 / max(k, 1))))  # labels: a taxonomy


# registration


def rigid(points: DataFrame, centre: tuple[float, float], reference: tuple[float, float], angle_degrees: float, scale: float) -> DataFrame:
    """Centre, turn, divide by the scale, move to the reference centre."""
    from cellweft.functions.scalars import rotated

    x, y = rotated(F.col("x") - centre[0], F.col("y") - centre[1], angle_degrees)
    return points.withColumns({"x": x / scale + reference[0], "y": y / scale + reference[1]})


def affine_points(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Rows of a 2 x 3 matrix."""
    x, y = F.col("x"), F.col("y")
    (a, b, c), (d, e, f) = matrix
    return points.withColumns({"x": x * a + y * b + c, "y": x * d + y * e + f})


def fit_multiquadric(control: np.ndarray, target: np.ndarray, smooth_by: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and radius of a multiquadric interpolation through control points (bounded: clicked pairs)."""
    span = np.ptp(control, axis=0)
    epsilon = float((np.prod(span[span > 0]) / len(control)) ** (1 / max((span > 0).sum(), 1)))
    d = np.linalg.norm(control[:, None] - control[None], axis=2)
    return np.linalg.solve(np.sqrt((d / epsilon) ** 2 + 1) - np.eye(len(control)) * smooth_by, target), epsilon


def apply_multiquadric(points: DataFrame, control: np.ndarray, weights: np.ndarray, epsilon: float, x: str, y: str, out: str) -> DataFrame:
    """The interpolation as one expression over the control points."""
    terms = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(w)).alias("w")) for (a, b), w in zip(control, weights, strict=True)])

    def add(s: Column, t: Column) -> Column:
        r2 = ((F.col(x) - t["a"]) * (F.col(x) - t["a"]) + (F.col(y) - t["b"]) * (F.col(y) - t["b"])) / (epsilon * epsilon)
        return s + t["w"] * F.sqrt(r2 + 1)

    return points.withColumn(out, F.aggregate(terms, F.lit(0.0), add))


def fit_plane(control: DataFrame, y: str, z: str, value: str) -> tuple[float, float, float]:
    """(slope of y, slope of z, constant) by least squares, from moments."""
    r = control.agg(
        F.avg(y).alias("my"), F.avg(z).alias("mz"), F.avg(value).alias("mv"), F.var_pop(y).alias("yy"), F.var_pop(z).alias("zz"), F.covar_pop(y, z).alias("yz"), F.covar_pop(y, value).alias("yv"), F.covar_pop(z, value).alias("zv")
    ).first()
    det = r["yy"] * r["zz"] - r["yz"] ** 2
    a, b = (r["yv"] * r["zz"] - r["zv"] * r["yz"]) / det, (r["zv"] * r["yy"] - r["yv"] * r["yz"]) / det
    return a, b, r["mv"] - a * r["my"] - b * r["mz"]


def displace(points: DataFrame, field: DataFrame, step: float) -> DataFrame:
    """Points moved by a displacement raster (row, col, dx, dy) of cells of a size, unmoved where it has no cell."""
    p = points.withColumns({"col": F.floor(F.col("x") / step).cast("int"), "row": F.floor(F.col("y") / step).cast("int")}).join(field, ["row", "col"], "left")
    return p.withColumns({"x": F.col("x") + F.coalesce("dx", F.lit(0.0)), "y": F.col("y") + F.coalesce("dy", F.lit(0.0))}).select(*points.columns)


def hemisphere(points: DataFrame, a: tuple[float, float], b: tuple[float, float]) -> DataFrame:
    """points plus hemi: the side of the line a-b; True is the side with the larger mean x."""
    from cellweft.functions.scalars import side_of_line

    p = points.withColumn("hemi", side_of_line(F.col("x"), F.col("y"), a, b))
    m = p.agg(F.avg(F.when(F.col("hemi"), F.col("x"))).alias("t"), F.avg(F.when(~F.col("hemi"), F.col("x"))).alias("f")).first()
    return p.withColumn("hemi", ~F.col("hemi")) if (m["t"] if m["t"] is not None else -math.inf) < (m["f"] if m["f"] is not None else -math.inf) else p

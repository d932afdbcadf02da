"""A dataset: layers of units with their edges, taxonomies, geometries and the maps between layers, kept as tables in one folder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.operators import graph, relational
from cellweft.sources.io import exists, update_config


@dataclass
class Layer:
    name: str
    units: DataFrame
    edges: DataFrame | None = None
    upstream: DataFrame | None = None
    features: dict[str, DataFrame] = field(default_factory=dict)

    def count(self, section: str | None = None) -> int:
        return relational.project(self.units, ["id"], section).count()

    def sections(self) -> list[str]:
        return [r["section"] for r in relational.section_order(self.units).orderBy("ix").collect()]


@dataclass
class Taxonomy:
    name: str
    types: DataFrame  # type_ix, type, ...
    upstream: str | None = None

    def indices(self, names: DataFrame) -> DataFrame:
        """names (type) with type_ix; raises on an unknown one."""
        return relational.strict_lookup(names, self.types.select("type", "type_ix"), "type")


class Dataset:
    """Layers by name in order; layer 0 is the cells."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.layers: dict[str, Layer] = {}
        self.taxonomies: dict[str, Taxonomy] = {}
        self.merged: list[tuple[str, str]] = []
        self.taxonomy_of: dict[str, str] = {}

    def add_cells(self, units: DataFrame, edges: DataFrame | None = None) -> Layer:
        """The base layer; nothing happens if there is one."""
        if "cell" not in self.layers:
            self.layers["cell"] = Layer("cell", units, edges)
        return self.layers["cell"]

    def filter_cells(self, condition, rebuild: float | None = None) -> Layer:  # noqa: ANN001
        """Only the cell layer can be filtered. Its spatial graph is restricted, or built again with a largest distance; feature graphs are dropped."""
        if list(self.layers) != ["cell"]:
            raise ValueError("cells can be filtered only before other layers are built on them")
        cell = self.layers["cell"]
        units, edges = relational.filter_units(cell.units, condition, cell.edges)
        if rebuild is not None:
            from cellweft.operators.spatial import spatial_graph

            edges = spatial_graph(units, rebuild).select("src", "dst")
        self.layers["cell"] = Layer("cell", units, edges)
        return self.layers["cell"]

    def add_types(self, layer: str, types: DataFrame, taxonomy: Taxonomy) -> None:
        """types (id, type): registers the taxonomy and makes it the layer's active one."""
        self.taxonomies[taxonomy.name] = taxonomy
        ix = taxonomy.indices(types).select("id", F.col("type_ix"))
        own = self.layers[layer]
        own.units = own.units.drop("type_ix").join(ix, "id").withColumn(f"{taxonomy.name}_id", F.col("type_ix"))
        self.taxonomy_of[layer] = taxonomy.name

    def use_taxonomy(self, layer: str, taxonomy: str) -> None:
        own = self.layers[layer]
        own.units = own.units.withColumn("type_ix", F.col(f"{taxonomy}_id"))
        self.taxonomy_of[layer] = taxonomy

    def merge(self, name: str, base: str = "cell", by_label: str | None = None, replace: bool = False, bits: str | None = None, n: int = 0) -> Layer:
        """A layer of same-type components, or of equal labels."""
        if name in self.layers and not replace:
            raise ValueError(f"there is a layer {name}")
        b = self.layers[base]
        made = graph.contract_by_label(b.units, b.edges, by_label, bits, n) if by_label else graph.contract_by_component(b.units, b.edges, bits, n)
        units, edges, upstream = made
        self.layers[name] = Layer(name, units.withColumnRenamed("unit_id", "id"), edges, upstream)
        self.merged = [m for m in self.merged if m[1] != name] + [(base, name)]
        if base in self.taxonomy_of:
            self.taxonomy_of[name] = self.taxonomy_of[base]
        return self.layers[name]

    def base_of(self, layer: str) -> str | None:
        return next((b for b, m in self.merged if m == layer), None)

    def to_cells(self, layer: str, value: str) -> DataFrame:
        """(id, value): a layer's values on the cells, through every map between."""
        chain, at = [], layer
        while at != "cell":
            chain.append(self.layers[at].upstream)
            at = self.base_of(at)
        if not chain:
            return self.layers["cell"].units.select("id", value)
        ids = chain[-1].select("id", "unit_id")
        for up in reversed(chain[:-1]):
            ids = ids.withColumnRenamed("unit_id", "_m").join(up.select(F.col("id").alias("_m"), "unit_id"), "_m").select("id", "unit_id")
        return ids.join(self.layers[layer].units.select(F.col("id").alias("unit_id"), value), "unit_id", "left").select("id", value)

    def save(self) -> None:
        """Tables of all layers and taxonomies, and a manifest."""
        for layer in self.layers.values():
            for part in ("units", "edges", "upstream"):
                df = getattr(layer, part)
                if df is not None:
                    df.write.mode("overwrite").parquet(f"{self.path}/layers/{layer.name}/{part}")
            for g, df in layer.features.items():
                df.write.mode("overwrite").parquet(f"{self.path}/layers/{layer.name}/graph={g}")
        for t in self.taxonomies.values():
            t.types.write.mode("overwrite").parquet(f"{self.path}/taxonomies/{t.name}")
        update_config(self.spark, self.path, "manifest", {
            "layers": list(self.layers), "merged": self.merged, "taxonomy_of": self.taxonomy_of, "taxonomies": {t.name: t.upstream for t in self.taxonomies.values()},
        })

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dataset:
        d = cls(spark, path)
        m = update_config(spark, d.path, "manifest")
        for name in m.get("layers", []):
            at = f"{d.path}/layers/{name}"
            part = lambda p, at=at: spark.read.parquet(f"{at}/{p}") if exists(spark, f"{at}/{p}") else None
            d.layers[name] = Layer(name, part("units"), part("edges"), part("upstream"))
        d.merged = [tuple(x) for x in m.get("merged", [])]
        d.taxonomy_of = m.get("taxonomy_of", {})
        for name, up in m.get("taxonomies", {}).items():
            d.taxonomies[name] = Taxonomy(name, spark.read.parquet(f"{d.path}/taxonomies/{name}"), up)
        return d

"""Filters, lookups, aggregates, ranks, samples and set operations over tables of units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.functions import arrays as A
from cellweft.operators.ordering import dense_index

# filters and projections


def filter_units(units: DataFrame, condition: Column, edges: DataFrame | None = None, unit: str = "id") -> tuple[DataFrame, DataFrame | None]:
    """Units that meet the condition, and the edges whose both ends do. Rebuilding the graph instead may link other neighbours."""
    kept = units.filter(condition)
    if edges is None:
        return kept, None
    ids = kept.select(unit)
    return kept, edges.join(ids.withColumnRenamed(unit, "src"), "src", "left_semi").join(ids.withColumnRenamed(unit, "dst"), "dst", "left_semi")


def project(units: DataFrame, columns: Sequence[str], section: str | Sequence[str] | None = None) -> DataFrame:
    """Columns of all units, of one section or of several."""
    if section is not None:
        units = units.filter(F.col("section").isin([section] if isinstance(section, str) else list(section)))
    return units.select(*columns)


def with_depth(units: DataFrame, z: float | Column = 0.0) -> DataFrame:
    return units.withColumn("xyz", F.array(F.col("x"), F.col("y"), z if isinstance(z, Column) else F.lit(float(z))))


def section_sizes(units: DataFrame, least: int = 0) -> DataFrame:
    """Units of each section that has at least `least`."""
    return units.groupBy("section").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def nuclear_filter(units: DataFrame, bits: str, n: int, floor: float = 10.0) -> DataFrame:
    """units plus nuc_mask: which rounds pass. Rounds are scaled to the median of the round medians; a value passes above half of the row's
    median (at least 1); no round passes where the row's minimum is below the floor."""
    med = units.agg(F.array(*[F.median(F.col(bits)[i]) for i in range(n)]).alias("m")).select("m", A.median(F.col("m")).alias("g")).first()
    scale = A.literal([med["g"] / m if m else 1.0 for m in med["m"]])
    x = F.zip_with(bits, scale, lambda v, k: v * k)
    units = units.withColumn("_x", x)
    limit = 0.5 * F.greatest(A.median(F.col("_x")), F.lit(1.0))
    ok = F.array_min("_x") >= floor
    return units.withColumn("nuc_mask", F.transform("_x", lambda v: ok & (v > limit))).drop("_x")


def merge_and_filter(matrix: DataFrame, metadata: DataFrame, clusters: DataFrame, min_transcripts: int = 50, min_genes: int = 20) -> DataFrame:
    """Cells in both matrix and metadata, their cluster or -1, with enough transcripts and non-zero genes."""
    both = matrix.join(metadata, "cell_id").join(clusters.select("cell_id", "cluster"), "cell_id", "left")
    genes = F.size(F.filter("counts", lambda x: x > 0))
    return both.withColumn("cluster", F.coalesce("cluster", F.lit(-1))).filter((F.col("transcript_counts") >= min_transcripts) & (genes >= min_genes))


def dispersed_labels(rows: DataFrame, label: str = "label", section: str = "section", most: float = 0.5) -> DataFrame:
    """Labels of which no section holds the share `most` or more."""
    counts = rows.groupBy(label, section).agg(F.count(F.lit(1)).alias("n"))
    share = counts.groupBy(label).agg((F.max("n") / F.sum("n")).alias("share"))
    return share.filter(F.col("share") < most)


def correlated_sections(rows: DataFrame, label: str = "label", section: str = "section", deviations: float = 2.0) -> DataFrame:
    """Sections whose mean correlation of label counts with the others lies within some deviations of the median over sections.

    The table of counts has sections x labels entries; it is paired by label, so no pair of rows is formed.
    """
    counts = rows.groupBy(section, label).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select(section).distinct().crossJoin(counts.select(label).distinct())  # one row a table cell
    full = grid.join(counts, [section, label], "left").fillna(0, ["n"])
    a, b = (full.select(F.col(section).alias(s), label, F.col("n").alias(f"n{s}")) for s in ("a", "b"))
    corr = a.join(b, label).filter("a <> b").groupBy("a", "b").agg(F.corr("na", "nb").alias("r")).groupBy("a").agg(F.avg("r").alias("r"))
    stats = corr.agg(F.median("r").alias("m"), F.stddev_pop("r").alias("d")).first()
    return corr.filter(F.abs(F.col("r") - stats["m"]) < deviations * (stats["d"] or 1.0)).select(F.col("a").alias(section), "r")


def clip_percentiles(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    q = df.agg(F.percentile(column, low).alias("lo"), F.percentile(column, high).alias("hi")).first()
    return df.withColumn(column, F.greatest(F.least(F.col(column), F.lit(q["hi"])), F.lit(q["lo"])))


def rename_sections(units: DataFrame, animal: str, decimals: int = 1) -> DataFrame:
    """section_name {animal}_{mean depth}; sections of one name get _1, _2 in the order of the old names."""
    mean = units.groupBy("section").agg(F.avg("ccf_x").alias("_z")).withColumn("_n", F.format_string(f"{animal}_%.{decimals}f", "_z"))
    nth = F.row_number().over(Window.partitionBy("_n").orderBy("section")) - 1
    named = mean.withColumn("section_name", F.when(nth > 0, F.concat("_n", F.lit("_"), nth.cast("string"))).otherwise(F.col("_n")))
    return units.join(named.select("section", "section_name"), "section")


# lookups


def position_lookup(queries: DataFrame, keys: DataFrame, on: str, missing: int = -1) -> DataFrame:
    """queries plus ix of keys (columns on, ix), `missing` where there is none."""
    return queries.join(keys.select(on, "ix"), on, "left").withColumn("ix", F.coalesce("ix", F.lit(missing)))


def strict_lookup(df: DataFrame, mapping: DataFrame, on: str) -> DataFrame:
    """Inner join on a map that must know every value; raises otherwise."""
    lost = df.join(mapping, on, "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"{on} {lost[0][on]!r} is not in the mapping")
    return df.join(mapping, on)


def relabel(df: DataFrame, lookup: DataFrame, label: str = "label", zero: int = 0) -> DataFrame:
    """Non-zero labels replaced by lookup (old, new); zeros stay."""
    m = lookup.select(F.col("old").alias(label), "new")
    return df.join(m, label, "left").withColumn(label, F.when(F.col(label) == zero, F.col(label)).otherwise(F.col("new"))).drop("new")


def type_names(units: DataFrame, taxonomy: DataFrame, upstream: DataFrame | None = None) -> DataFrame:
    """units (type_ix) with the type's name, and that of its parent if the parent taxonomy is given."""
    out = units.join(taxonomy.select("type_ix", F.col("type"), *(["upstream_type"] if upstream is not None else [])), "type_ix", "left")
    if upstream is None:
        return out
    return out.join(upstream.select(F.col("type").alias("upstream_type"), F.col("type_ix").alias("upstream_ix")), "upstream_type", "left")


def map_to_base(cells: DataFrame, layer: DataFrame, value: str, unit: str = "unit_id") -> DataFrame:
    """A layer's values on the cells it was built from (cells have upstream_id)."""
    return cells.join(layer.select(F.col(unit).alias("upstream_id"), value), "upstream_id", "left")


def descendants(ontology: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Terms whose path (array of ids) holds one of the ids."""
    return ontology.filter(F.arrays_overlap("path", F.array(*[F.lit(int(i)) for i in ids])))


def parcellation_levels(ontology: DataFrame, depth: int = 5) -> DataFrame:
    """Ontology (id, structure_id_path '/1/2/') with `depth` level columns: known ids of the path, the last one repeated."""
    ids = F.transform(F.filter(F.split("structure_id_path", "/"), lambda s: s != ""), lambda s: s.cast("long"))
    rows = ontology.withColumn("_path", ids)
    known = rows.select("id", F.posexplode("_path").alias("_at", "_p")).join(ontology.select(F.col("id").alias("_p")), "_p", "left_semi")
    paths = known.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_p"))), lambda s: s["_p"]).alias("_path"))
    full = F.concat("_path", F.array_repeat(F.element_at("_path", -1), depth))
    return ontology.join(paths, "id").select(*ontology.columns, *[F.element_at(full, k + 1).alias(f"level_{k}") for k in range(depth)])


def coarse_labels(pairs: DataFrame, fine: str, coarse: str, order: str) -> DataFrame:
    """Fine to coarse, the last mention by order wins."""
    return pairs.groupBy(fine).agg(F.max_by(coarse, order).alias(coarse))


def first_labels(pairs: DataFrame, fine: str, coarse: str, order: str) -> DataFrame:
    """Fine to coarse, the first mention by order wins."""
    return pairs.groupBy(fine).agg(F.min_by(coarse, order).alias(coarse))


def roll_up(shares: DataFrame, mapping: DataFrame, fine: str, coarse: str, by: str = "cell_id", value: str = "p") -> DataFrame:
    """Sums of (by, fine, value) over the coarse labels."""
    return shares.join(mapping.select(fine, coarse), fine).groupBy(by, coarse).agg(F.sum(value).alias(value))


def aligned_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, na, nb) of two count tables, 0 where absent."""
    return a.select(key, F.col("n").alias("na")).join(b.select(key, F.col("n").alias("nb")), key, "full").fillna(0, ["na", "nb"])


def log_count_correlation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return aligned_counts(a, b, key).agg(F.corr(F.log10(F.col("na") + 1), F.log10(F.col("nb") + 1)).alias("r"))


# aggregates


def group_features(df: DataFrame, by: str, bits: str, n: int, how: str = "mean", groups: DataFrame | None = None, expand: bool = False) -> DataFrame:
    """Sum or mean of the features of each group; absent groups of `groups` give nulls (mean) or zeros (sum); expand returns to the rows."""
    f = F.avg if how == "mean" else F.sum
    out = df.groupBy(by).agg(F.array(*[f(F.col(bits)[i]) for i in range(n)]).alias(f"{how}_{bits}"), F.count(F.lit(1)).alias("n"))
    if groups is not None:
        none = A.literal([0.0 if how == "sum" else None] * n)
        out = groups.select(by).distinct().join(out, by, "left").withColumn(f"{how}_{bits}", F.coalesce(f"{how}_{bits}", none)).fillna(0, ["n"])
    return df.join(out, by) if expand else out


def type_frequency(units: DataFrame, most: int | None = None, section: str | None = None) -> DataFrame:
    """(type_ix, p): shares weighted by node_size, with a row for every index up to `most`."""
    rows = units if section is None else units.filter(F.col("section") == section)
    sums = rows.groupBy("type_ix").agg(F.sum("node_size").alias("w"))
    total = F.sum("w").over(Window.partitionBy())
    p = sums.withColumn("p", F.col("w") / total).select(F.col("type_ix").cast("long").alias("type_ix"), "p")
    if most is None:
        return p
    return units.sparkSession.range(most + 1).toDF("type_ix").join(p, "type_ix", "left").fillna(0.0, ["p"])


def weighted_entropy(df: DataFrame, weight: str) -> DataFrame:
    """Entropy (base 2) of the shares of a weight column."""
    w = F.col(weight).cast("double")
    # H = log2 S - sum w log2 w / S
    return df.agg((F.log2(F.sum(w)) - F.sum(F.when(w > 0, w * F.log2(w)).otherwise(0.0)) / F.sum(w)).alias("h"))


def label_entropy(df: DataFrame, label: str) -> DataFrame:
    return weighted_entropy(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "n")


def conditional_entropy(zones: DataFrame) -> DataFrame:
    """H(zone) - H(type) of a contracted layer (type_ix, node_size), one row."""
    by_type = zones.groupBy("type_ix").agg(F.sum("node_size").alias("node_size"))
    return weighted_entropy(zones, "node_size").withColumnRenamed("h", "h_zone").crossJoin(weighted_entropy(by_type, "node_size").withColumnRenamed("h", "h_type")).withColumn("h_cond", F.col("h_zone") - F.col("h_type"))


def contingency(df: DataFrame, a: str, b: str, values: Sequence | None = None) -> DataFrame:
    """Counts of a by b with 0 for absent pairs."""
    return df.groupBy(a).pivot(b, list(values) if values is not None else None).count().fillna(0)


def contingency_shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, share of its row, share of its column)."""
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(a))).withColumn("col_share", F.col("n") / F.sum("n").over(Window.partitionBy(b)))


def binary_side_entropy(df: DataFrame, label: str, side: str) -> DataFrame:
    """Mean over labels of the entropy of a two-valued side; labels with one side are left out."""
    p = df.groupBy(label).agg(F.avg(F.col(side).cast("double")).alias("p")).filter((F.col("p") > 0) & (F.col("p") < 1))
    return p.agg(F.avg(-F.col("p") * F.log2("p") - (1 - F.col("p")) * F.log2(1 - F.col("p"))).alias("h"))


def taxonomy_table(cells: DataFrame, level: str, bits: str, n: int, parent: str | None = None, colour: str | None = None, order: str = "id") -> DataFrame:
    """One row a type: mean and population deviation of features, first colour, last parent."""
    aggs = [F.array(*[F.avg(F.col(bits)[i]) for i in range(n)]).alias("mean"), F.array(*[F.stddev_pop(F.col(bits)[i]) for i in range(n)]).alias("std"), F.count(F.lit(1)).alias("n")]
    aggs += [F.min_by(colour, order).alias("rgb")] if colour else []
    aggs += [F.max_by(parent, order).alias("upstream_type")] if parent else []
    return cells.groupBy(F.col(level).alias("type")).agg(*aggs)


def weighted_centres(rows: DataFrame, label: str, bits: str, n: int, weight: str | None = None) -> DataFrame:
    """Feature means per label, weighted by a probability on request."""
    w = F.col(weight) if weight else F.lit(1.0)
    return rows.groupBy(label).agg(F.array(*[F.sum(F.col(bits)[i] * w) / F.sum(w) for i in range(n)]).alias("centre"))


def weighted_tabulation(df: DataFrame, value: str, reference: DataFrame, weight: str | None = None, normalise: bool = True) -> DataFrame:
    """(value, n) for all reference values, 0 where absent."""
    w = F.col(weight) if weight else F.lit(1.0)
    n = reference.select(value).distinct().join(df.groupBy(value).agg(F.sum(w).alias("n")), value, "left").fillna(0.0, ["n"])
    return n.withColumn("n", F.col("n") / F.sum("n").over(Window.partitionBy())) if normalise else n


# ranks and windows


def ordinal_rank(df: DataFrame, value: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """rank from 0 in the order of value, ties by another column; over the whole table by ranges, within `by` by a window."""
    if not by:
        return dense_index(df, [value, tie], "rank")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)) - 1)


def dense_labels(df: DataFrame, keys: Sequence[str], name: str = "dense") -> DataFrame:
    """Dense numbers from 0 of the distinct keys in their order; the keys are ranked, not the rows."""
    return df.join(dense_index(df.select(*keys).distinct(), list(keys), name), list(keys))


def section_order(sections: DataFrame) -> DataFrame:
    """Sections by the number in the second token of the name (split at _ or .), then name."""
    key = F.try_element_at(F.split("section", r"[_.]"), F.lit(2)).cast("double")
    return sections.select("section").distinct().withColumn("key", key).withColumn("ix", F.row_number().over(Window.orderBy("key", "section")) - 1)


def block_positions(edges: DataFrame, by: str, seed: int, key: Sequence[str]) -> DataFrame:
    """Position of each row in the shuffled block of its `by`, divided by the block's size."""
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    return edges.withColumn("u", (F.row_number().over(w) - 1) / F.count(F.lit(1)).over(Window.partitionBy(by)))


def permutation_test(rows: DataFrame, key: Sequence[str], value: str = "value", observed: str = "is_observed") -> DataFrame:
    """Rank of the observed value among itself and its permutations: two-sided p (at least 2/n), enrichment, Benjamini-Hochberg q."""
    obs = F.max(F.when(F.col(observed), F.col(value)))
    per = rows.join(rows.groupBy(*key).agg(obs.alias("obs")), list(key))
    stats = per.groupBy(*key).agg(
        F.first("obs").alias("obs"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) < F.col("obs")).alias("below"), F.count_if(F.col(value) == F.col("obs")).alias("ties"),
        F.avg(F.when(~F.col(observed), F.col(value))).alias("expected"),
    )
    rank = F.col("below") + (F.col("ties") + 1) / 2
    p = F.greatest(2 / F.col("n"), F.least(F.lit(1.0), 2 * F.least(rank, F.col("n") + 1 - rank) / F.col("n")))
    out = stats.withColumn("p", p).withColumn("enrichment", (F.col("obs") + 1) / (F.col("expected") + 1))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    out = out.withColumn("_q", F.col("p") * n / F.row_number().over(Window.orderBy("p", *key)))
    q = F.min("_q").over(Window.orderBy(F.desc("p"), *[F.desc(k) for k in key]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("q", F.least(F.lit(1.0), q)).select(*key, "obs", "expected", "enrichment", "p", "q")


# samples


def stratified_sample(df: DataFrame, by: str, n: int | dict, key: str, seed: int = 0) -> DataFrame:
    """Up to n rows a stratum (one number, or one for each), the first by a hash of key."""
    want = F.lit(n) if isinstance(n, int) else F.coalesce(F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(v))])[F.col(by)], F.lit(0))
    order = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= want).drop("_r")


def stratified_resample(df: DataFrame, by: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly n rows of every stratum, with replacement; column draw numbers them."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(key)))
    draws = df.groupBy(by).agg(F.count(F.lit(1)).alias("_c")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draws = draws.withColumn("_r", (1 + F.pmod(F.xxhash64(F.lit(seed), by, "draw"), F.col("_c"))).cast("int"))
    return draws.join(ranked, [by, "_r"]).drop("_r", "_c")


def weighted_resample(df: DataFrame, by: str, weight: str, n: int, least: int, key: str, seed: int = 0) -> DataFrame:
    """About n rows, labels in proportion to their summed weight but `least` each at the fewest, drawn with replacement where short."""
    sums = df.groupBy(by).agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_c"))
    want = F.greatest(F.lit(least), F.round(F.lit(n) * F.col("_w") / F.sum("_w").over(Window.partitionBy()))).cast("int")
    draws = sums.withColumn("_want", want).withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_want"))))
    # without replacement as long as the label has rows left: draw k takes the k-th row of the hashed order, then starts again
    draws = draws.withColumn("_r", (1 + (F.col("draw") - 1) % F.col("_c")).cast("int"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)))
    return draws.select(by, "draw", "_r").join(ranked, [by, "_r"]).drop("_r")


def bernoulli_split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """is_test by a hash of the key: the same rows whatever the partitioning."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20)) < int(share * (1 << 20)))


def every_nth(df: DataFrame, n: int, by: str, key: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1).filter(F.col("_r") % n == 0).drop("_r")


# set operations


def union_shared(frames: Sequence[DataFrame]) -> DataFrame:
    """Union over the columns that all have, in the first frame's order."""
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    out = frames[0].select(*shared)
    for f in frames[1:]:
        out = out.unionByName(f.select(*shared))
    return out


def shared_features(sections: DataFrame, ids: str = "features") -> DataFrame:
    """Features that every row's array holds, one row each."""
    n = sections.count()
    return sections.select(F.explode(F.array_distinct(ids)).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n).select("feature")


def missing_ids(volume: DataFrame, ontology: DataFrame) -> DataFrame:
    """Non-zero ids of a volume that the ontology lacks."""
    return volume.select("id").filter("id <> 0").distinct().join(ontology.select("id"), "id", "left_anti")


def unique_with_counts(df: DataFrame, label: str, pos: str) -> DataFrame:
    """(label, dense number, first position, count)."""
    g = df.groupBy(label).agg(F.min(pos).alias("first"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("dense", F.row_number().over(Window.orderBy(label)) - 1)


def mirrored(df: DataFrame, z: str = "z", plane: float = 0.0) -> DataFrame:
    """df and its reflection about z = plane."""
    return df.unionByName(df.withColumn(z, F.lit(2.0 * plane) - F.col(z)))

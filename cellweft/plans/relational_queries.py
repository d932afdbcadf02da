"""Filters, lookups, aggregates, ranks, samples, set operations and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.functions import arrays as A
from cellweft.functions import scalars as S
from cellweft.operators import design, relational, stats, views
from cellweft.plans.fixtures import BITS, C, G, L, cells, grid, read
from cellweft.plans.registry import R, long, query, r6

W = "WITH " + C + " "
WL = "WITH " + L + " "
WG = "WITH " + G + " "


@query(W + "SELECT id, section, " + R("x", "x") + ", " + R("y", "y") + " FROM c WHERE type_ix > 3")
def filter_cells(spark, sf):
    return relational.filter_units(cells(spark, sf), F.col("type_ix") > 3)[0].select("id", "section", r6("x").alias("x"), r6("y").alias("y"))


@query(WG + "SELECT src, dst FROM e WHERE src IN (SELECT id FROM g WHERE type_ix > 0) AND dst IN (SELECT id FROM g WHERE type_ix > 0)")
def filter_edges(spark, sf):
    n, e = grid(spark, sf)
    return relational.filter_units(n, F.col("type_ix") > 0, e)[1].select("src", "dst")


@query(W + "SELECT id, type_ix FROM c WHERE section IN ('A_1.0', 'A_3.0')")
def project_sections(spark, sf):
    return relational.project(cells(spark, sf), ["id", "type_ix"], ["A_1.0", "A_3.0"])


@query(W + "SELECT id, " + R("x", "x") + ", " + R("y", "y") + ", 1.5::DOUBLE AS z FROM c")
def coordinates_with_depth(spark, sf):
    d = relational.with_depth(cells(spark, sf), 1.5)
    return d.select("id", *[r6(F.col("xyz")[i]).alias(c) for i, c in enumerate("xyz")])


@query(W + "SELECT section, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 100")
def section_sizes(spark, sf):
    return relational.section_sizes(cells(spark, sf), 100)


@query(
    WL + ", m AS (SELECT bit, median(v) AS m FROM l GROUP BY 1), k AS (SELECT bit, (SELECT median(m) FROM m) / m AS k FROM m), s AS (SELECT id, bit, v * k AS v FROM l JOIN k USING (bit)), "
    "r AS (SELECT id, median(v) AS rm, min(v) AS lo FROM s GROUP BY 1) SELECT id, bit, lo >= 10 AND v > 0.5 * greatest(rm, 1) AS ok FROM s JOIN r USING (id)"
)
def nuclear_filter(spark, sf):
    return relational.nuclear_filter(cells(spark, sf), "bits", BITS).select("id", F.posexplode("nuc_mask").alias("bit", "ok"))


@query("SELECT o_orderpriority AS label, max(n) / sum(n)::DOUBLE AS share FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1 HAVING max(n) / sum(n)::DOUBLE < 0.5".replace("max(n) / sum(n)::DOUBLE AS share", R("max(n) / sum(n)::DOUBLE", "share")))
def dispersed_labels(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("section"))
    return relational.dispersed_labels(o).select("label", r6("share").alias("share"))


@query()
def correlated_sections(spark, sf):
    return relational.correlated_sections(cells(spark, sf).withColumnRenamed("type_ix", "label")).select("section", r6("r").alias("r"))


@query("SELECT l_linenumber, " + R("greatest(least(l_extendedprice, hi), lo)", "v") + ", count(*) AS n FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem) GROUP BY 1, 2")
def clip_percentiles(spark, sf):
    d = relational.clip_percentiles(read(spark, sf, "lineitem").select("l_linenumber", "l_extendedprice"), "l_extendedprice")
    return d.groupBy("l_linenumber", r6("l_extendedprice").alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query()
def rename_sections(spark, sf):
    d = cells(spark, sf).withColumn("ccf_x", F.col("x"))
    return relational.rename_sections(d, "WTF01").groupBy("section", "section_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_custkey END, -1) AS ix FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def position_lookup(spark, sf):
    c = read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("ix"))
    return relational.position_lookup(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "ix")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def strict_lookup(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return relational.strict_lookup(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey").select("c_custkey", "n_name")


@query(W + "SELECT id, CASE WHEN type_ix = 0 THEN 0 ELSE type_ix * 10 END AS label FROM c")
def relabel(spark, sf):
    d = cells(spark, sf).select("id", F.col("type_ix").alias("label"))
    m = d.select(F.col("label").alias("old")).distinct().filter("old <> 0").withColumn("new", F.col("old") * 10)
    return relational.relabel(d, m).select("id", "label")


@query("SELECT c_custkey AS id, n_name AS type, r_name AS upstream_type FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def type_names(spark, sf):
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    tax = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("type_ix"), F.col("n_name").alias("type"), F.col("r_name").alias("upstream_type"))
    up = r.select(F.col("r_name").alias("type"), F.col("r_regionkey").alias("type_ix"))
    u = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("type_ix"))
    return relational.type_names(u, tax, up).select("id", "type", "upstream_type")


@query("SELECT o_orderkey AS id, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def map_to_base(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("upstream_id"))
    return relational.map_to_base(o, read(spark, sf, "customer").withColumnRenamed("c_custkey", "unit_id"), "c_mktsegment").select("id", "c_mktsegment")


@query("SELECT n_nationkey + 100 AS id FROM nation WHERE n_regionkey IN (1, 3) UNION ALL SELECT r_regionkey AS id FROM region WHERE r_regionkey IN (1, 3)")
def ontology_descendants(spark, sf):
    n = read(spark, sf, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.array(F.col("n_regionkey"), F.col("n_nationkey") + 100).alias("path"))
    r = read(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.array("r_regionkey").alias("path"))
    return relational.descendants(n.union(r), [1, 3]).select("id")


@query("SELECT n_nationkey + 100 AS id, n_regionkey AS level_0, n_nationkey + 100 AS level_1, n_nationkey + 100 AS level_4 FROM nation UNION ALL SELECT r_regionkey, r_regionkey, r_regionkey, r_regionkey FROM region")
def parcellation_levels(spark, sf):
    n = read(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.concat(F.lit("/9999/"), F.col("n_regionkey").cast("string"), F.lit("/"), (F.col("n_nationkey") + 100).cast("string"), F.lit("/")).alias("structure_id_path"))
    r = read(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.concat(F.lit("/"), F.col("r_regionkey").cast("string"), F.lit("/")).alias("structure_id_path"))
    d = relational.parcellation_levels(n.union(r))
    return d.select(*[F.col(c).cast("int").alias(c) for c in ("id", "level_0", "level_1", "level_4")])


@query("SELECT l_partkey, arg_max(l_suppkey, l_orderkey * 10000000 + l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1")
def coarse_labels(spark, sf):
    return relational.coarse_labels(read(spark, sf, "lineitem").withColumn("o", F.col("l_orderkey") * 10000000 + F.col("l_suppkey")), "l_partkey", "l_suppkey", "o")


@query("SELECT l_partkey, arg_min(l_suppkey, l_orderkey * 10000000 + l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1")
def first_labels(spark, sf):
    return relational.first_labels(read(spark, sf, "lineitem").withColumn("o", F.col("l_orderkey") * 10000000 + F.col("l_suppkey")), "l_partkey", "l_suppkey", "o")


@query("SELECT o_custkey, o_orderstatus, round(sum(o_totalprice), 2) AS p FROM orders GROUP BY ALL".replace("o_orderstatus, round", "substr(o_orderpriority, 1, 1) AS band, round"))
def hierarchy_roll_up(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.col("o_totalprice").alias("p"))
    m = o.select("o_orderpriority").distinct().withColumn("band", F.substring("o_orderpriority", 1, 1))
    return relational.roll_up(o, m, "o_orderpriority", "band", by="o_custkey").withColumn("p", F.round("p", 2))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.k = b.k")
def aligned_counts(spark, sf):
    o = read(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    n = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return relational.aligned_counts(n("F"), n("P"), "k")


@query("SELECT " + R("corr(log10(na + 1), log10(nb + 1))", "r") + " FROM (SELECT c_nationkey, count(*) FILTER (o_orderstatus = 'F') AS na, count(*) FILTER (o_orderstatus = 'P') AS nb FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING na > 0 OR nb > 0)")
def log_count_correlation(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    n = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return relational.log_count_correlation(n("F"), n("P"), "c_nationkey").select(r6("r").alias("r"))


# aggregates


@query(WL + "SELECT type_ix, bit, " + R("avg(v)") + " FROM l GROUP BY 1, 2")
def group_mean(spark, sf):
    return long(relational.group_features(cells(spark, sf), "type_ix", "bits", BITS), "type_ix", bits="mean_bits")


@query(WL + ", s AS (SELECT type_ix, bit, sum(v) AS v FROM l GROUP BY 1, 2) SELECT t.k::INT AS type_ix, b.k::INT AS bit, " + R("coalesce(v, 0)") + f" FROM range(0, 12) t(k), range(0, {BITS}) b(k) LEFT JOIN s ON s.type_ix = t.k AND s.bit = b.k")
def group_sum_with_absent(spark, sf):
    g = spark.range(12).select(F.col("id").cast("int").alias("type_ix"))
    return long(relational.group_features(cells(spark, sf), "type_ix", "bits", BITS, "sum", g), "type_ix", bits="sum_bits")


@query(WL + "SELECT id, bit, " + R("avg(v) OVER (PARTITION BY type_ix, bit)") + " FROM l")
def group_mean_expanded(spark, sf):
    return long(relational.group_features(cells(spark, sf), "type_ix", "bits", BITS, expand=True), "id", bits="mean_bits")


@query(W + "SELECT r.k AS type_ix, " + R("coalesce(n, 0) / (SELECT count(*) FROM c)::DOUBLE", "p") + " FROM range(0, 13) r(k) LEFT JOIN (SELECT type_ix, count(*) AS n FROM c GROUP BY 1) t ON t.type_ix = r.k")
def type_frequency(spark, sf):
    return relational.type_frequency(cells(spark, sf), 12).select("type_ix", r6("p").alias("p"))


@query("SELECT " + R("-sum(p * log2(p))", "h") + " FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)")
def label_entropy(spark, sf):
    return relational.label_entropy(read(spark, sf, "events"), "event_type").select(r6("h").alias("h"))


@query("WITH z AS (SELECT user_id, min(event_type) AS t, count(*) AS n FROM events GROUP BY 1) SELECT " + R("(SELECT -sum(n / s * log2(n / s)) FROM z, (SELECT sum(n)::DOUBLE AS s FROM z)) - (SELECT -sum(m / s * log2(m / s)) FROM (SELECT sum(n)::DOUBLE AS m FROM z GROUP BY t), (SELECT sum(n)::DOUBLE AS s FROM z))", "h_cond"))
def conditional_entropy(spark, sf):
    z = read(spark, sf, "events").groupBy("user_id").agg(F.min("event_type").alias("type_ix"), F.count(F.lit(1)).alias("node_size"))
    return relational.conditional_entropy(z).select(r6("h_cond").alias("h_cond"))


@query('SELECT o_orderstatus, count(*) FILTER (o_orderpriority = \'1-URGENT\') AS "1-URGENT", count(*) FILTER (o_orderpriority = \'5-LOW\') AS "5-LOW" FROM orders GROUP BY 1')
def contingency(spark, sf):
    return relational.contingency(read(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("SELECT quality, toxic, n, " + R("n / sum(n) OVER (PARTITION BY quality)", "row_share") + ", " + R("n / sum(n) OVER (PARTITION BY toxic)", "col_share") + " FROM (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL)")
def contingency_shares(spark, sf):
    d = relational.contingency_shares(read(spark, sf, "labels"), "quality", "toxic")
    return d.select("quality", "toxic", "n", r6("row_share").alias("row_share"), r6("col_share").alias("col_share"))


@query(W + "SELECT " + R("avg(-p * log2(p) - (1 - p) * log2(1 - p))", "h") + " FROM (SELECT type_ix, avg((x > 0)::INT) AS p FROM c GROUP BY 1) WHERE p > 0 AND p < 1")
def side_entropy(spark, sf):
    return relational.binary_side_entropy(cells(spark, sf).withColumn("hemi", (F.col("x") > 0).cast("int")), "type_ix", "hemi").select(r6("h").alias("h"))


@query(WL + "SELECT l.type_ix AS type, bit, " + R("avg(v)", "mean") + ", " + R("stddev_pop(v)", "std") + ", m.up AS upstream_type FROM l JOIN (SELECT type_ix, arg_max(section, id) AS up FROM c GROUP BY 1) m USING (type_ix) GROUP BY ALL")
def taxonomy_table(spark, sf):
    t = relational.taxonomy_table(cells(spark, sf), "type_ix", "bits", BITS, parent="section")
    z = t.select("type", "upstream_type", F.posexplode(F.arrays_zip("mean", "std")).alias("bit", "_z"))
    return z.select("type", "upstream_type", "bit", r6("_z.mean").alias("mean"), r6("_z.std").alias("std"))


@query(WL + "SELECT type_ix, bit, " + R("sum(v * (x + 10)) / sum(x + 10)") + " FROM l GROUP BY 1, 2")
def weighted_centres(spark, sf):
    return long(relational.weighted_centres(cells(spark, sf).withColumn("w", F.col("x") + 10), "type_ix", "bits", BITS, "w"), "type_ix", bits="centre")


@query("SELECT t.v AS event_type, " + R("coalesce(s, 0) / (SELECT sum(value) FROM events WHERE event_type IN ('click', 'view', 'none'))", "n") + " FROM (VALUES ('click'), ('view'), ('none')) t(v) LEFT JOIN (SELECT event_type, sum(value) AS s FROM events GROUP BY 1) e ON e.event_type = t.v")
def weighted_tabulation(spark, sf):
    ref = spark.createDataFrame([("click",), ("view",), ("none",)], "event_type string")
    return relational.weighted_tabulation(read(spark, sf, "events"), "event_type", ref, "value").select("event_type", r6("n").alias("n"))


# ranks


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS rank FROM events")
def ordinal_rank(spark, sf):
    return relational.ordinal_rank(read(spark, sf, "events"), "value", "event_id", ["event_type"]).select("event_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type, user_id) - 1 AS dense FROM events")
def dense_labels(spark, sf):
    return relational.dense_labels(read(spark, sf, "events"), ["event_type", "user_id"]).select("event_id", F.col("dense").cast("long").alias("dense"))


@query("SELECT * FROM (VALUES ('WTF01_9.1', 0::BIGINT), ('WTF01_9.7', 1::BIGINT), ('WTF01_10.2', 2::BIGINT)) t(section, ix)")
def section_order(spark, sf):
    d = spark.createDataFrame([("WTF01_10.2",), ("WTF01_9.7",), ("WTF01_9.1",)], "section string")
    return relational.section_order(d).select("section", F.col("ix").cast("long").alias("ix"))


@query(WL + "SELECT id, bit, row_number() OVER (PARTITION BY id ORDER BY v, bit) - 1 AS r FROM l")
def rank_features(spark, sf):
    return cells(spark, sf).select("id", F.posexplode(A.ordinal_ranks(F.col("bits"))).alias("bit", "r")).withColumn("r", F.col("r").cast("long"))


@query("SELECT user_id, round(sum(s) OVER (ORDER BY user_id), 4) + 0.0::DOUBLE AS running FROM (SELECT user_id, sum(value) AS s FROM events GROUP BY 1)")
def running_sum(spark, sf):
    s = read(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("s"))
    return s.select("user_id", (F.round(F.sum("s").over(Window.orderBy("user_id")), 4) + F.lit(0.0)).alias("running"))


@query()
def block_positions(spark, sf):
    _, e = grid(spark, sf)
    return relational.block_positions(e.withColumn("k", F.col("src") % 5), "k", 1, ["src", "dst"]).select("src", "dst", r6("u").alias("u"))


@query(
    "WITH v AS (SELECT event_type AS key, event_id = first AS obs, value FROM events JOIN (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1) USING (event_type)), "
    "o AS (SELECT key, max(value) AS o FROM v WHERE obs GROUP BY 1), s AS (SELECT key, any_value(o) AS obs, count(*) AS n, count(*) FILTER (value < o) + (count(*) FILTER (value = o) + 1) / 2 AS rk, avg(value) FILTER (NOT v.obs) AS expected FROM v JOIN o USING (key) GROUP BY 1), "
    "p AS (SELECT *, greatest(2 / n, least(1, 2 * least(rk, n + 1 - rk) / n)) AS p FROM s), b AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, key) AS raw FROM p) "
    "SELECT key, " + R("obs", "obs") + ", " + R("expected", "expected") + ", " + R("(obs + 1) / (expected + 1)", "enrichment") + ", " + R("p", "p") + ", " + R("least(1, min(raw) OVER (ORDER BY p DESC, key DESC))", "q") + " FROM b"
)
def permutation_test(spark, sf):
    e = read(spark, sf, "events")
    f = e.groupBy("event_type").agg(F.min("event_id").alias("first"))
    v = e.join(f, "event_type").select(F.col("event_type").alias("key"), "value", (F.col("event_id") == F.col("first")).alias("is_observed"))
    d = relational.permutation_test(v, ["key"])
    return d.select("key", *[r6(c).alias(c) for c in ("obs", "expected", "enrichment", "p", "q")])


# samples


@query("SELECT event_type, least(count(*), 20) AS n FROM events GROUP BY 1")
def stratified_sample(spark, sf):
    return relational.stratified_sample(read(spark, sf, "events"), "event_type", 20, "event_id").groupBy("event_type").agg(F.countDistinct("event_id").alias("n"))


@query("SELECT event_type, 50::BIGINT AS n FROM events GROUP BY 1")
def stratified_resample(spark, sf):
    return relational.stratified_resample(read(spark, sf, "events"), "event_type", 50, "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, greatest(10, round(1000 * sum(value) / (SELECT sum(value) FROM events)))::BIGINT AS n FROM events GROUP BY 1")
def weighted_resample(spark, sf):
    return relational.weighted_resample(read(spark, sf, "events"), "event_type", "value", 1000, 10, "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query()
def bernoulli_split(spark, sf):
    return relational.bernoulli_split(read(spark, sf, "events"), "event_id", 0.2).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE (r - 1) % 10 = 0")
def every_nth(spark, sf):
    return relational.every_nth(read(spark, sf, "events"), 10, "user_id", "event_id").select("event_id")


# set operations


@query("SELECT c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_shared(spark, sf):
    a = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), "c_name")
    b = read(spark, sf, "supplier").select("s_name", F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id"))
    return relational.union_shared([a, b])


@query("SELECT l_linenumber AS feature FROM (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def shared_features(spark, sf):
    s = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.collect_set("l_linenumber").alias("features"))
    return relational.shared_features(s)


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_ids(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return relational.missing_ids(o, read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@query("SELECT event_type, min(event_id) AS first, count(*) AS n, dense_rank() OVER (ORDER BY event_type) - 1 AS dense FROM events GROUP BY 1")
def unique_with_counts(spark, sf):
    return relational.unique_with_counts(read(spark, sf, "events"), "event_type", "event_id").withColumn("dense", F.col("dense").cast("long"))


@query(W + "SELECT id, " + R("y", "z") + " FROM c UNION ALL SELECT id, " + R("11.42 - y", "z") + " FROM c")
def mirrored(spark, sf):
    return relational.mirrored(cells(spark, sf).select("id", F.col("y").alias("z")), "z", 5.71).withColumn("z", r6("z"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_pairs(spark, sf):
    return read(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


# scalars


@query("SELECT p_partkey, " + R("(length(p_name) - length(regexp_replace(upper(p_name), '[GC]', '', 'g'))) / length(p_name)", "gc") + ", reverse(translate(upper(p_name), 'ACGT', 'TGCA')) AS rc FROM part")
def sequence_scalars(spark, sf):
    s = F.upper("p_name")
    return read(spark, sf, "part").select("p_partkey", r6(S.gc_fraction(s)).alias("gc"), S.reverse_complement(s).alias("rc"))


@query("WITH n AS (SELECT n_name FROM nation) SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_name = b.n_name THEN 0 ELSE levenshtein(a.n_name, b.n_name) END AS dist FROM n a, n b")
def edit_distances(spark, sf):
    d = design.edit_distances(read(spark, sf, "nation").select(F.col("n_name").alias("seq")))
    return d.withColumn("dist", F.col("dist").cast("long"))


@query("SELECT base, len(t) - len(replace(t, base, '')) AS count, count(*) AS n FROM (SELECT upper(p_name) AS t FROM part), (VALUES ('A'), ('C'), ('G'), ('T')) b(base) GROUP BY ALL")
def base_count_histogram(spark, sf):
    d = design.base_count_histogram(read(spark, sf, "part").select(F.upper("p_name").alias("seq")))
    return d.withColumn("count", F.col("count").cast("long"))


@query("SELECT p_partkey FROM part WHERE (length(p_name) - length(regexp_replace(upper(p_name), '[GC]', '', 'g'))) / length(p_name) BETWEEN 0.1 AND 0.3 AND NOT regexp_matches(upper(p_name), 'EE')")
def screen_sequences(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("seq"))
    return design.screen(p, {"gc": (0.1, 0.3), "exclude": ["EE"]}).select("p_partkey")


@query("SELECT * FROM (VALUES ('ACGTACGT', 8), ('AAAACCCC', 4)) t(seq, best)")
def best_slide(spark, sf):
    d = spark.createDataFrame([("ACGTACGT", "ACGTACGT"), ("AAAACCCC", "CCCCAAAA")], "seq string, other string")
    return d.select("seq", S.best_slide(F.col("seq"), F.col("other")).alias("best"))


@query("SELECT * FROM (VALUES ('a', 'single'), ('a+a', 'self-bind'), ('a+b', 'cross-bind')) t(name, kind)")
def binding_groups(spark, sf):
    return spark.createDataFrame([("a",), ("a+a",), ("a+b",)], "name string").select("name", S.binding_group(F.col("name")).alias("kind"))


@query("SELECT p_partkey, substr(p_name, 1, 2) AS a, substr(p_name, 3, 3) AS b FROM part")
def fixed_fields(spark, sf):
    return read(spark, sf, "part").select("p_partkey", *S.fixed_fields(F.col("p_name"), [0, 2, 5], ["a", "b"]))


@query("SELECT p_partkey, " + R("(p_partkey % 256) / 255::DOUBLE", "r") + ", printf('#%02x%02x%02x', (p_partkey % 256)::INT, (p_partkey * 7 % 256)::INT, (p_partkey * 13 % 256)::INT) AS hex FROM part")
def hex_colours(spark, sf):
    k = F.col("p_partkey")
    p = read(spark, sf, "part").select("p_partkey", S.to_hex(k % 256, k * 7 % 256, k * 13 % 256).alias("hex"))
    return p.select("p_partkey", r6(S.hex_channel(F.col("hex"), 0)).alias("r"), "hex")


@query()
def colour_round_trip(spark, sf):
    k = F.col("p_partkey")
    p = read(spark, sf, "part").select("p_partkey", *[((k * m % 256) / 255).alias(c) for c, m in zip("rgb", (1, 7, 13), strict=True)])
    back = S.srgb(*S.lab(F.col("r"), F.col("g"), F.col("b")))
    d = S.delta_e_1976(S.lab(F.col("r"), F.col("g"), F.col("b")), S.lab(F.col("b"), F.col("g"), F.col("r")))
    return p.select("p_partkey", *[F.round(c, 3).alias(n) for c, n in zip(back, ("r", "g", "b"), strict=True)], F.round(d, 3).alias("delta_e"))


@query(W + "SELECT id, " + R("x * cos(radians(30)) - y * sin(radians(30))", "x") + ", " + R("x * sin(radians(30)) + y * cos(radians(30))", "y") + " FROM c")
def rotated_points(spark, sf):
    x, y = S.rotated(F.col("x"), F.col("y"), 30)
    return cells(spark, sf).select("id", r6(x).alias("x"), r6(y).alias("y"))


@query(W + "SELECT id, greatest(0, least(trunc((x + 5) * 1000 / 10)::INT, 799)) AS xi FROM c")
def voxel_indices(spark, sf):
    return cells(spark, sf).select("id", S.voxel_index(F.col("x") + 5, 10, 800).alias("xi"))


@query(W + "SELECT id, (1 * (y - 0) - 2 * (x - 0)) > 0 AS hemi FROM c")
def side_of_line(spark, sf):
    return cells(spark, sf).select("id", S.side_of_line(F.col("x"), F.col("y"), (0, 0), (1, 2)).alias("hemi"))


@query(WL + f", p AS (SELECT a.id, a.v AS u, b.v AS w FROM l a JOIN l b ON b.id = a.id AND b.bit = {BITS - 1} - a.bit) SELECT id, " + R("corr(u, w)", "r") + " FROM p GROUP BY 1")
def paired_correlation(spark, sf):
    return stats.paired_correlation(cells(spark, sf).withColumn("rev", F.reverse("bits")), "bits", "rev").select("id", r6("r").alias("r"))


@query(WL + f", p AS (SELECT id, bit, v, row_number() OVER (PARTITION BY id ORDER BY v, bit) AS r FROM l), q AS (SELECT a.id, a.r AS u, b.r AS w FROM p a JOIN p b ON b.id = a.id AND b.bit = {BITS - 1} - a.bit) SELECT id, " + R("corr(u, w)", "r") + " FROM q GROUP BY 1")
def paired_spearman(spark, sf):
    return stats.paired_correlation(cells(spark, sf).withColumn("rev", F.reverse("bits")), "bits", "rev", "spearman").select("id", r6("r").alias("r"))


@query(
    WL + ", s AS (SELECT id, bit, greatest(v, 0) / sum(greatest(v, 0)) OVER (PARTITION BY id) AS p FROM l), "
    f"j AS (SELECT a.id, a.p, b.p AS q FROM s a JOIN s b ON b.id = a.id AND b.bit = {BITS - 1} - a.bit), k AS (SELECT id, unnest([(p + q) / 2, p, q]) AS x, unnest([-1, 0.5, 0.5]) AS w FROM j) "
    "SELECT id, " + R("sum(w * CASE WHEN x > 0 THEN x * log2(x) ELSE 0 END)", "d") + " FROM k GROUP BY 1"
)
def jensen_shannon(spark, sf):
    p = cells(spark, sf).withColumn("p", F.transform("bits", lambda x: F.greatest(x, F.lit(0.0))))
    p = p.withColumn("p", A.let(A.total(F.col("p")), lambda t: F.transform("p", lambda x: x / t)))
    return p.select("id", r6(A.jensen_shannon(F.col("p"), F.reverse("p"))).alias("d"))


# statistics and views


@query(W + "SELECT " + R("(s - r * k / t) / ((r + k) / 2 - r * k / t)", "ari") + " FROM (SELECT sum(n * (n - 1) / 2) AS s, sum(n) * (sum(n) - 1) / 2 AS t FROM (SELECT count(*) AS n FROM c GROUP BY type_ix, section)), (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT count(*) AS n FROM c GROUP BY type_ix)), (SELECT sum(n * (n - 1) / 2) AS k FROM (SELECT count(*) AS n FROM c GROUP BY section))")
def adjusted_rand(spark, sf):
    return stats.adjusted_rand(cells(spark, sf), "type_ix", "section").select(r6("ari").alias("ari"))


@query("SELECT quality, toxic, count(*) AS n, " + R("count(*) / sum(count(*)) OVER (PARTITION BY toxic)", "share") + " FROM labels GROUP BY 1, 2")
def confusion(spark, sf):
    return stats.confusion(read(spark, sf, "labels"), "quality", "toxic").withColumn("share", r6("share"))


@query(WL + ", g AS (SELECT bit, avg(v) AS m FROM l GROUP BY 1), k AS (SELECT bit, type_ix, avg(v) AS m, count(*) AS n FROM l GROUP BY 1, 2) SELECT bit, " + R("any_value(b) / (sum((v - m) * (v - m)) + 1e-6)", "eta2") + " FROM l JOIN g USING (bit) JOIN (SELECT k.bit, sum(n * (k.m - g.m) * (k.m - g.m)) AS b FROM k JOIN g USING (bit) GROUP BY 1) USING (bit) GROUP BY 1")
def eta_squared(spark, sf):
    return stats.eta_squared(cells(spark, sf), "type_ix", "bits", BITS).withColumn("eta2", r6("eta2"))


@query(WL + f", p AS (SELECT a.id, a.bit, a.v AS t, b.v AS q FROM l a JOIN l b ON b.id = a.id AND b.bit = {BITS - 1} - a.bit), s AS (SELECT bit, avg((t - q) * (t - q)) AS e, avg(t * t) AS s, var_pop(t) AS v FROM p GROUP BY 1) SELECT " + R("avg(e)", "mse") + ", " + R("1 - avg(e) / avg(s)", "explained") + ", " + R("1 - avg(e) / avg(v)", "r2") + " FROM s")
def paired_mse(spark, sf):
    d = stats.paired_mse(cells(spark, sf).withColumn("rev", F.reverse("bits")), "bits", "rev", BITS)
    return d.select(*[r6(c).alias(c) for c in ("mse", "explained", "r2")])


@query("SELECT least(floor((value - 0) / 2), 49)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def histogram(spark, sf):
    return stats.histogram(read(spark, sf, "events"), "value", 0, 100, 50)


@query()
def log_log_fit(spark, sf):
    return stats.log_log_fit(read(spark, sf, "orders"), "o_totalprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(WL + "SELECT id, section, " + R("x", "x") + ", " + R("y", "y") + ", " + R("greatest(least(v, hi), lo)", "value") + " FROM l JOIN (SELECT section, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM l WHERE bit = 2 GROUP BY 1) USING (section) WHERE bit = 2")
def view_basis(spark, sf):
    d = views.basis_values(cells(spark, sf), "bits", 2, per_section=True)
    return d.select("id", "section", *[r6(c).alias(c) for c in ("x", "y", "value")])


@query(W + "SELECT id, " + R("greatest(least((y - -1) / 3, 1), 0)", "shade") + " FROM c")
def view_colorpleth(spark, sf):
    return views.colorpleth(cells(spark, sf), "y", -1, 2).select("id", r6("shade").alias("shade"))


@query("SELECT c_custkey AS id, n_name AS type, '#' || lpad(n_nationkey::VARCHAR, 6, '0') AS rgb FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def view_type_map(spark, sf):
    t = read(spark, sf, "nation").select(F.col("n_nationkey").alias("type_ix"), F.col("n_name").alias("type"), F.concat(F.lit("#"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0")).alias("rgb"))
    return views.type_map(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("type_ix")), t).select("id", "type", "rgb")


@query(W + "SELECT section, " + ", ".join(R(f"quantile_cont(log10(greatest(x, 0) + 1), {p})", f"q{i}") for i, p in enumerate((0.0, 0.25, 0.5, 0.75, 1.0))) + " FROM c GROUP BY 1")
def view_distributions(spark, sf):
    d = views.value_quantiles(cells(spark, sf), "x")
    return d.select("section", *[r6(F.col("q")[i]).alias(f"q{i}") for i in range(5)])


@query(W + "SELECT id FROM c WHERE x BETWEEN -1 AND 1 AND y BETWEEN 0 AND 2")
def view_window(spark, sf):
    return views.window(cells(spark, sf), (-1, 1), (0, 2)).select("id")


@query("SELECT event_id, " + R("(value - a) / (b - a) * 10 - 5") + " FROM events, (SELECT min(value) AS a, max(value) AS b FROM events)")
def scaled_values(spark, sf):
    return views.scaled(read(spark, sf, "events"), "value", -5, 5).select("event_id", r6("value").alias("v"))


@query(WL + "SELECT id, bit, " + R("log2(v / sum(v) OVER (PARTITION BY id) + 1)") + " FROM l")
def log_shares(spark, sf):
    return long(views.log_shares(cells(spark, sf), "bits"), "id")


@query()
def view_random_colours(spark, sf):
    return views.random_colours(cells(spark, sf)).select("id", "rgb")

"""Sequence and probe design: relational parts. Thermodynamic simulation belongs to external tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.functions import scalars as S
from cellweft.plans.checkpoints import materialize


def edit_distances(a: DataFrame, b: DataFrame | None = None, self_distance: int = 0) -> DataFrame:
    """(a, b, dist) of all sequences of two small sets, or of one with itself; the task is the full matrix."""
    left = a.select(F.col("seq").alias("a"))
    right = (a if b is None else b).select(F.col("seq").alias("b"))
    d = F.levenshtein("a", "b")
    d = F.when(F.col("a") == F.col("b"), F.lit(self_distance)).otherwise(d) if b is None else d
    return left.crossJoin(right).withColumn("dist", d)


def base_count_histogram(seqs: DataFrame, bases: str = "ACGT") -> DataFrame:
    """(base, count, n): how many sequences hold a base so often."""
    per = seqs.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), S.base_count(F.col("seq"), b).alias("count")) for b in bases])).alias("_s"))
    return per.groupBy("_s.base", "_s.count").agg(F.count(F.lit(1)).alias("n"))


def screen(seqs: DataFrame, rules: dict) -> DataFrame:
    """Sequences that meet all rules: gc (low, high), exclude (patterns), tm (low exclusive, high inclusive), counts ({base: (low, high)})."""
    known = {"gc", "exclude", "tm", "counts"}
    if set(rules) - known:
        raise ValueError(f"unknown rules {sorted(set(rules) - known)}")
    s, ok = F.col("seq"), F.lit(True)
    if "gc" in rules:
        ok = ok & S.gc_fraction(s).between(*rules["gc"])
    for pattern in rules.get("exclude", []):
        ok = ok & ~s.rlike(pattern)
    if "tm" in rules:
        tm = S.melting_temperature(s)
        ok = ok & (tm > rules["tm"][0]) & (tm <= rules["tm"][1])
    for base, (low, high) in rules.get("counts", {}).items():
        ok = ok & S.base_count(s, base).between(low, high)
    return seqs.filter(ok)


# Runs that are rejected.
LONG_RUNS = ("AAAA", "CCCC", "TTTTT", "GGGGG")


def without_long_runs(seqs: DataFrame) -> DataFrame:
    return seqs.filter(~F.col("seq").rlike("|".join(LONG_RUNS)))


def balanced_counts(seqs: DataFrame, gc: tuple[float, float] = (0.5, 0.55), most: int | None = None) -> DataFrame:
    """GC share within bounds, and no base more often than `most`."""
    rules: dict = {"gc": gc}
    if most is not None:
        rules["counts"] = {b: (0, most) for b in "ACGT"}
    return screen(seqs, rules)


def random_sequences(spark: SparkSession, n: int, length: int, rules: dict | None = None, seed: int = 0, left: str = "", right: str = "", tries: int = 1_000_000) -> DataFrame:
    """n sequences that meet the rules (overhangs included), by rejection from at most `tries` hashed ones."""
    letter = lambda i: F.substring(F.lit("ACGT"), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(4)).cast("int") + 1, F.lit(1))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), "")
    made = spark.range(tries).withColumn("seq", F.concat(F.lit(left), body, F.lit(right)))
    got = screen(made, rules or {}).orderBy("id").limit(n)
    return got.select("id", "seq")


def mutated(seqs: DataFrame, seed: int = 0, mask: str | None = None) -> DataFrame:
    """One substitution in each sequence, at a hashed place where the mask is 1, to one of the three other bases."""
    places = F.filter(F.sequence(F.lit(1), F.length("seq")), lambda i: F.substring(F.col(mask), i, F.lit(1)) == "1") if mask else F.sequence(F.lit(1), F.length("seq"))
    rows = seqs.withColumn("_p", places).withColumn("_h", F.xxhash64(F.lit(seed), "seq"))
    at = F.element_at("_p", F.pmod(F.col("_h"), F.size("_p")).cast("int") + 1)
    rows = rows.withColumn("_at", at).withColumn("_b", F.substring(F.col("seq"), F.col("_at"), F.lit(1)))
    others = F.array_remove(F.array(*[F.lit(b) for b in "ACGT"]), F.col("_b"))
    new = F.element_at(others, F.pmod(F.shiftright("_h", 8), F.lit(3)).cast("int") + 1)
    changed = F.concat(F.substring(F.col("seq"), F.lit(1), F.col("_at") - 1), new, F.substring(F.col("seq"), F.col("_at") + 1, F.length("seq")))
    return rows.withColumn("seq", F.when(F.size("_p") > 0, changed).otherwise(F.col("seq"))).drop("_p", "_h", "_at", "_b")


def spaced_subset(seqs: DataFrame, least: int, kept: DataFrame | None = None) -> DataFrame:
    """Greedy choice in id order: a sequence stays if its edit distance to all that stay is at least `least`.

    Equal to the sequential scan, in rounds: of the open sequences, those with no conflicting open one before them are chosen, and their conflicts dropped.
    """
    open_seqs = seqs.select("id", "seq")
    if kept is not None:
        near = open_seqs.crossJoin(kept.select(F.col("seq").alias("_k"))).filter(F.levenshtein("seq", "_k") < least).select("id").distinct()
        open_seqs = open_seqs.join(near, "id", "left_anti")
    a, b = open_seqs.select(F.col("id").alias("a"), F.col("seq").alias("_a")), open_seqs.select(F.col("id").alias("b"), F.col("seq").alias("_b"))
    conflicts = materialize(a.crossJoin(b).filter((F.col("a") < F.col("b")) & (F.levenshtein("_a", "_b") < least)).select("a", "b"))
    open_ids, chosen = materialize(open_seqs.select("id")), None
    while open_ids.limit(1).count():
        live = conflicts.join(open_ids.withColumnRenamed("id", "a"), "a", "left_semi").join(open_ids.withColumnRenamed("id", "b"), "b", "left_semi")
        blocked = live.select(F.col("b").alias("id")).distinct()
        won = materialize(open_ids.join(blocked, "id", "left_anti"))
        lost = conflicts.join(won.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
        chosen = won if chosen is None else chosen.union(won)
        open_ids = materialize(open_ids.join(won.union(lost).distinct(), "id", "left_anti"))
    return seqs.join(chosen, "id", "left_semi") if chosen is not None else seqs.limit(0)


def orthogonal_subset(pairs: DataFrame, keep: int, protected: list[int] | None = None) -> list[int]:
    """Ids left when the id with the worst (lowest) pair value is dropped until `keep` are left; pairs (a, b, value) of a small set, one job a drop."""
    left = {r[0] for r in pairs.select("a").union(pairs.select("b")).distinct().collect()}
    rows = materialize(pairs)
    while len(left) > keep:
        worst = rows.select("a", "b", "value").union(rows.select("b", "a", "value")).groupBy("a").agg(F.min("value").alias("m"))
        worst = worst.filter(~F.col("a").isin(list(protected or []))).orderBy("m", "a").first()
        if worst is None:
            break
        left.discard(worst["a"])
        rows = rows.filter((F.col("a") != worst["a"]) & (F.col("b") != worst["a"]))
    return sorted(left)


def allocate_readouts(encoders: DataFrame, weights: DataFrame, spacer: str = "") -> DataFrame:
    """Encoders in order take readouts in order, each readout as often as its weight: (encoder ix, seq with readout)."""
    w = weights.withColumn("_hi", F.sum("weight").over(Window.orderBy("ix"))).withColumn("_lo", F.col("_hi") - F.col("weight"))
    slots = w.withColumn("_slot", F.explode(F.sequence(F.col("_lo").cast("long"), F.col("_hi").cast("long") - 1))).filter("weight > 0")
    e = encoders.withColumn("_slot", (F.row_number().over(Window.orderBy("ix")) - 1).cast("long"))
    return e.join(slots.select("_slot", "readout", F.col("seq").alias("_r")), "_slot").select("ix", "readout", F.concat("seq", F.lit(spacer), "_r").alias("seq"))


def concentration_table(conc: DataFrame, total: float) -> DataFrame:
    """Complexes by falling concentration: ordinal, log10 share of a total, binding group."""
    return conc.withColumns({
        "ordinal": F.row_number().over(Window.orderBy(F.desc("conc"), "complex")) - 1, "log_share": F.log10(F.col("conc") / total), "kind": S.binding_group(F.col("complex")),
    })


def binding_summary(conc: DataFrame, readout: str) -> DataFrame:
    """precision (share of the readout's bound amount that is on its own encoder), usage (share of the readout that is bound) and recall (share of the encoder that is bound by it).

    Complexes are named r<i>, e<j> and sums of them.
    """
    own = F.col("complex").rlike(rf"(^|\+)r{readout}(\+|$)")
    target = F.col("complex").rlike(rf"(^|\+)e{readout}(\+|$)")
    bound = F.col("complex").rlike(r"\+") & F.col("complex").rlike(r"(^|\+)e\d+(\+|$)")
    amount = lambda c: F.coalesce(F.sum(F.when(c, F.col("conc"))), F.lit(0.0))
    r = conc.agg(amount(own & target).alias("hit"), amount(own & bound).alias("bound"), amount(own).alias("all"), amount(target).alias("target"))
    return r.select((F.col("hit") / F.nullif("bound", F.lit(0.0))).alias("precision"), (F.col("bound") / F.nullif("all", F.lit(0.0))).alias("usage"), (F.col("hit") / F.nullif("target", F.lit(0.0))).alias("recall"))


def readout_by_encoder(conc: DataFrame, readout: str) -> DataFrame:
    """(encoder, conc) bound to a readout."""
    own = F.col("complex").rlike(rf"(^|\+)r{readout}(\+|$)")
    return conc.filter(own).withColumn("encoder", F.regexp_extract("complex", r"e(\d+)", 1)).filter("encoder <> ''").groupBy("encoder").agg(F.sum("conc").alias("conc"))


def tube_rows(tubes: DataFrame) -> DataFrame:
    """(tube, complex, conc) of a map column."""
    return tubes.select("tube", F.explode("result").alias("complex", "conc"))


def pair_count(n: Column) -> Column:
    """Complexes of up to two of n strands."""
    return n + n + n * (n - 1) / 2


def best_complementary_slide(a: Column, b: Column) -> Column:
    """Largest slide score of two sequences over the reverse complement of either."""
    ra, rb = S.reverse_complement(a), S.reverse_complement(b)
    return F.greatest(S.best_slide(a, b), S.best_slide(a, rb), S.best_slide(ra, b), S.best_slide(ra, rb))


def probe_pivot(probes: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of a by b, and shares of each b."""
    n = probes.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(b)))

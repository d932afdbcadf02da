"""Mixing sources to target weights by entropy balancing (native).

Each document gets a rate r = min(cap, exp(lambda_source * size / scale_source)), the distribution closest in relative
entropy to rate 1 whose words per source equal a target (and no rate above the cap). The dual is convex; its
gradient and curvature are sums over the documents, taken in each Newton iteration by one distributed aggregate over
the (source, size) histogram, as documents of one source and size share a rate.

Rates are then rounded into whole copies. Along the sizes of a source, from the largest down, the copies taken so far are the sum of the
rates so far, rounded: as the sizes descend, the words are off by half the largest document at most. What is missing is then made up
once, by some sizes of every order of magnitude: each takes or gives as many copies as bring the source nearest to its target, and then
pairs of them exchange a copy where that comes nearer. A source ends within half of the smallest of these sizes, mostly within a
few words, unless their documents are at none or all of their copies.

Null sources form a source of their own, last in order; null and empty texts have size 0, rate 1 and take no words;
repeated rows count each and take copies each; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.llm.common import dense_index, hot_limit, join_unique, materialize

#: Most copies of a document, and so the largest multiple of its size that a source may be asked for.
CAP = 3
NEWTON_STEPS = 40
TOLERANCE = 1e-9
#: Digits of a multiplier that count, so that the order of sums does not matter.
DIGITS = 10
#: Sizes of every power of two that make up for what rounding left.
MENDERS = 3
EXCHANGES = 4
#: Sources up to this number are broadcast.
FEW_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = CAP) -> DataFrame:
    """Rows (source, source_size, target): shares of all words by the weights, repeating over the sources in order.

    sizes has source and size. A source whose share exceeds cap times its words stops there, the excess goes to the others by weight,
    until none is above. One aggregate over the sources finds each round; no source list reaches the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = dense_index(totals, ["source"], "_rank")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % n + 1).cast("int"))
    ranked = materialize(ranked.withColumn("_weight", weight).withColumn("_most", F.col("source_size") * float(cap)))
    all_words = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = -math.inf, -1
    while True:
        # a source stays below its limit while weight * level does
        held = F.col("_most") <= F.col("_weight") * F.lit(level)
        count, capped, free = ranked.agg(
            F.count_if(held), F.sum(F.when(held, F.col("_most")).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("_weight")))
        ).first()
        if count <= stopped or not free:
            break
        level, stopped = (all_words - capped) / free, count
    top = F.col("_most") if level == math.inf else F.least(F.col("_most"), F.col("_weight") * F.lit(level))
    return ranked.select("source", "source_size", F.coalesce(top, F.lit(0.0)).alias("target"))


def _rate(lam: Column, size: Column, scale: Column, cap: int) -> Column:
    """exp is cut at the cap before it can overflow."""
    return F.exp(F.least(lam * size / scale, F.lit(math.log(cap))))


def balance(cells: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """Newton's method on the dual, for all sources at once: rows (source, lam, scale).

    cells: (source, size, n). An iteration is one aggregate over the cells; steps that leave the bracket known to
    hold the root are replaced by its middle. Sources that reach the cap or have no words need no multiplier.
    """
    scale = F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))
    scales = cells.filter(F.col("size") > 0).groupBy("source").agg(scale.alias("scale"), F.min("size").alias("_least"))
    state = (
        targets.join(scales, targets["source"].eqNullSafe(scales["source"])).drop(scales["source"])
        # at the upper end even the smallest document reaches the cap; at the lower end all are close to nothing
        .withColumn("_hi", math.log(cap) * F.col("scale") / F.col("_least") + 1.0)
        .withColumn("_lo", -60.0 * F.col("scale") / F.col("_least"))
        .withColumn("lam", F.lit(0.0))
        .select("source", "source_size", "target", "scale", "_lo", "_hi", "lam")
    )
    state = materialize(state)
    few = F.broadcast if state.count() <= FEW_SOURCES else lambda df: df
    own = cells.withColumnRenamed("source", "_source").filter(F.col("size") > 0)
    for _ in range(NEWTON_STEPS):
        r = _rate(F.col("lam"), F.col("size"), F.col("scale"), cap)
        x = F.col("size") / F.col("scale")
        mass = F.col("n") * F.col("size")
        sums = (
            own.join(few(state), F.col("_source").eqNullSafe(F.col("source")))
            .groupBy("source")
            .agg(
                F.first("source_size").alias("source_size"),
                F.first("target").alias("target"),
                F.first("scale").alias("scale"),
                F.first("_lo").alias("_lo"),
                F.first("_hi").alias("_hi"),
                F.first("lam").alias("lam"),
                F.sum(mass * r).alias("_words"),
                F.sum(F.when(r < F.lit(cap * (1 - 1e-12)), mass * r * x).otherwise(0.0)).alias("_slope"),
            )
        )
        # log of the words taken is close to linear in lambda, so the step is taken there
        gap = F.log(F.col("target") / F.col("_words"))
        lo = F.when(gap > 0, F.col("lam")).otherwise(F.col("_lo"))
        hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("_hi"))
        stepped = sums.withColumns({"_gap": F.coalesce(gap, F.lit(0.0)), "_lo": lo, "_hi": hi}).withColumn(
            "_try", F.col("lam") + F.col("_gap") * F.col("_words") / F.nullif(F.col("_slope"), F.lit(0.0))
        )
        inside = (F.col("_try") > F.col("_lo")) & (F.col("_try") < F.col("_hi"))
        done = F.abs("_gap") <= TOLERANCE
        nxt = F.when(done, F.col("lam")).when(inside, F.col("_try")).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        state = materialize(
            stepped.select("source", "source_size", "target", "scale", "_lo", "_hi", nxt.alias("lam"), (~done).alias("_open"))
        )
        if not state.filter("_open").limit(1).count():
            break
        state = state.drop("_open")
    return state.select("source", "target", "scale", F.round("lam", DIGITS).alias("lam"))


def round_cells(cells: DataFrame, rates: DataFrame, cap: int = CAP) -> DataFrame:
    """Whole copies for each (source, size) cell: rows (source, size, n, rate, copies).

    Sums run along the different sizes of a source, whose number the longest text bounds, not the number of documents; at most
    MENDERS sizes a power of two are gathered for a source.
    """
    own = cells.withColumnRenamed("source", "_source")
    joined = own.join(rates.select("source", "scale", "lam"), F.col("_source").eqNullSafe(F.col("source")), "left")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(F.col("lam"), F.col("size"), F.col("scale"), cap))
    rated = joined.select(F.col("_source").alias("source"), "size", "n", F.coalesce(rate, F.lit(1.0)).alias("rate"))
    along = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = rated.withColumn("_sum", F.sum(F.col("n") * F.col("rate")).over(along))
    before = F.lag(F.round("_sum")).over(Window.partitionBy("source").orderBy(F.desc("size")))
    copies = F.greatest(F.lit(0.0), F.least(F.round("_sum") - F.coalesce(before, F.lit(0.0)), F.col("n") * float(cap)))
    whole = materialize(whole.withColumn("copies", F.when(F.col("size") == 0, F.col("n").cast("double")).otherwise(copies).cast("long")).drop("_sum"))

    missing = F.sum((F.col("n") * F.col("rate") - F.col("copies")) * F.col("size"))
    left = whole.groupBy("source").agg(missing.alias("_left"))
    # how far a size can go either way
    room = F.least("copies", F.col("n") * cap - F.col("copies"))
    power = Window.partitionBy("source", "_power").orderBy(F.desc("_room"), "size")
    menders = whole.filter(F.col("size") > 0).withColumns({"_power": F.floor(F.log2("size")), "_room": room}).withColumn("_k", F.row_number().over(power))
    lists = menders.filter(F.col("_k") <= MENDERS).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n", "copies")), asc=False).alias("_menders"))

    def step(acc: Column, c: Column) -> Column:
        asked = F.round(acc["left"] / c["size"]).cast("long")
        more = F.greatest(-c["copies"], F.least(asked, c["n"] * cap - c["copies"]))
        one = F.struct(c["size"].alias("size"), (c["copies"] + more).alias("down"), (c["n"] * cap - c["copies"] - more).alias("up"), more.alias("more"))
        return F.struct((acc["left"] - more * c["size"]).alias("left"), F.array_append(acc["out"], one).alias("out"))

    def exchange(acc: Column, _: Column) -> Column:
        """One size gives a copy and one takes one, or either alone, if that brings the words nearer."""
        side = lambda c: F.concat(F.array(F.lit(0).cast("long")), F.transform(F.filter(acc["out"], lambda x: x[c] > 0), lambda x: x["size"]))
        pair = lambda give, take: F.struct(F.abs(acc["left"] - (take - give)).alias("off"), give.alias("give"), take.alias("take"))
        best = F.array_min(F.flatten(F.transform(side("down"), lambda give: F.transform(side("up"), lambda take: pair(give, take)))))

        def done(b: Column) -> Column:
            def moved(x: Column) -> Column:
                by = F.when(x["size"] == b["take"], 1).otherwise(0) - F.when(x["size"] == b["give"], 1).otherwise(0)
                return F.struct(x["size"].alias("size"), (x["down"] + by).alias("down"), (x["up"] - by).alias("up"), (x["more"] + by).alias("more"))

            return F.struct((acc["left"] - (b["take"] - b["give"])).alias("left"), F.transform(acc["out"], moved).alias("out"))

        return F.element_at(F.transform(F.array(best), done), 1)

    start = F.struct(F.col("_left").alias("left"), F.array().cast("array<struct<size:bigint,down:bigint,up:bigint,more:bigint>>").alias("out"))
    first = F.aggregate("_menders", start, step)
    l2 = left.withColumnRenamed("source", "_ls")
    mended = lists.join(l2, F.col("source").eqNullSafe(F.col("_ls"))).select("source", first.alias("_first"))
    mended = mended.select("source", F.inline(F.aggregate(F.sequence(F.lit(1), F.lit(EXCHANGES)), F.col("_first"), exchange)["out"]))
    mended = mended.filter("more <> 0").select(F.col("source").alias("_ms"), F.col("size").alias("_mz"), "more")
    same = F.col("source").eqNullSafe(F.col("_ms")) & (F.col("size") == F.col("_mz"))
    return whole.join(mended, same, "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("_ms", "_mz", "more")


def _cell(source: str, size: str) -> Column:
    return F.concat_ws("/", F.col(size).cast("string"), F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")))


def mix(docs: DataFrame, key: str, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = CAP) -> DataFrame:
    """docs (with source, size and a key that orders documents) plus source_size, target, rate and copies (0 to cap).

    Give narrow rows: they are sorted and written once. Inside a cell, the documents that get one copy more than
    the others are those first by a hash of the key.
    """
    docs = materialize(docs.withColumns({"_h": F.xxhash64(key), "_cell": _cell("source", "size")}))
    ordered = materialize(dense_index(docs, ["source", "size", "_h", key], "_idx"))
    cells = materialize(ordered.groupBy("source", "size", "_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_idx").alias("_first")))
    targets = materialize(source_targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), weights, cap))
    counts = cells.select("source", "size", "n")
    rounded = round_cells(counts, balance(counts, targets, cap), cap)
    t = targets.withColumnRenamed("source", "_t")
    plan = rounded.join(t, F.col("source").eqNullSafe(F.col("_t"))).select(_cell("source", "size").alias("_cell"), "source_size", "target", "rate", F.col("copies").alias("_total"))
    plan = plan.join(cells.select("_cell", "n", "_first"), "_cell")
    hot = cells.filter(F.col("n") > hot_limit(docs.sparkSession, cells.agg(F.sum("n")).first()[0] or 0))
    both = join_unique(ordered, plan, "_cell", hot)
    more = (F.col("_idx") - F.col("_first")) < F.col("_total") % F.col("n")
    copies = (F.floor(F.col("_total") / F.col("n")) + F.when(more, 1).otherwise(0)).cast("long")
    return both.withColumn("copies", copies).drop("_h", "_idx", "_first", "_cell", "n", "_total")


def repeat_copies(docs: DataFrame, key: str, text: str, text_words: Column, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = CAP) -> DataFrame:
    """docs (with source and any other columns) as the mix takes them: each row as often as its copies, in the same columns.

    Rows that agree in key, source and text share the copies the mix gives them as evenly as they can.
    """
    shown = F.concat_ws("/", *[F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("")) for c in (key, "source", text)])
    sized = docs.select(F.struct(*docs.columns).alias("_row"), F.unhex(F.md5(shown.cast("binary"))).alias("_own"), key, "source", text_words.alias("size"))
    taken = mix(sized.select("_own", key, "source", "size"), key, weights, cap)
    plan = materialize(taken.groupBy("_own").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).filter("_copies > 0"))
    hot = plan.filter(F.col("_rows") > hot_limit(docs.sparkSession, plan.agg(F.sum("_rows")).first()[0] or 0))
    rows = join_unique(sized.select("_row", "_own"), plan, "_own", hot).withColumn("_extra", F.col("_copies") % F.col("_rows"))
    each = F.floor(F.col("_copies") / F.col("_rows"))
    if plan.filter("_copies % _rows > 0").limit(1).count():
        # among repeated rows, so many take one copy more
        uneven = dense_index(rows.filter("_extra > 0").withColumn("_at", F.monotonically_increasing_id()), ["_own", "_at"], "_idx")
        first = uneven.groupBy("_own").agg(F.min("_idx").alias("_first"))
        uneven = join_unique(uneven, first, "_own", hot).withColumn("_more", (F.col("_idx") - F.col("_first") < F.col("_extra")).cast("long"))
        rows = rows.filter("_extra = 0").select("_row", each.alias("_each")).unionByName(uneven.select("_row", (each + F.col("_more")).alias("_each")))
    else:
        rows = rows.select("_row", each.alias("_each"))
    return rows.filter("_each > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_each").cast("long")))).select("_row.*")

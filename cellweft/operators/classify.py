"""Classification, label transfer, hierarchies and factorisation."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.functions import arrays as A
from cellweft.operators import neighbours as N
from cellweft.operators import normalize as Z
from cellweft.operators.ordering import dense_index
from cellweft.operators.relational import label_entropy, roll_up, stratified_sample
from cellweft.plans.checkpoints import materialize


class Classifier(ABC):
    """Learns labels from (id, bits, label) and gives (id, label) for (id, bits)."""

    @abstractmethod
    def train(self, reference: DataFrame) -> Classifier: ...

    @abstractmethod
    def classify(self, cells: DataFrame) -> DataFrame: ...


class GivenLabels(Classifier):
    """Labels that exist already; as many as cells are required."""

    def train(self, reference: DataFrame) -> GivenLabels:
        self.labels = reference.select("id", "label")
        return self

    def classify(self, cells: DataFrame) -> DataFrame:
        out = cells.select("id").join(self.labels, "id")
        if out.count() != cells.count():
            raise ValueError("labels and cells differ in number")
        return out


class NearestNeighbours(Classifier):
    """Vote of the k nearest reference cells; with weights, features are scaled by their F statistic over the reference."""

    def __init__(self, k: int = 1, metric: str = "correlation", n: int | None = None, f_weights: bool = False, max_distance: float | None = None) -> None:
        self.k, self.metric, self.n, self.f_weights, self.max_distance = k, metric, n, f_weights, max_distance

    def train(self, reference: DataFrame) -> NearestNeighbours:
        self.reference, self.weights = reference, None
        if self.f_weights:
            f = [v for v, _ in Z.anova(reference, "label", "bits", self.n)]
            self.weights = [v / max(f) for v in f]
        return self

    def shares(self, cells: DataFrame) -> DataFrame:
        """(id, label, share)."""
        scaled = lambda d: d.withColumn("bits", Z._each("bits", lambda x, w: x * w, self.weights)) if self.weights else d
        # a cell and a reference cell of one id are different cells
        near = N.knn_features(scaled(cells), scaled(self.reference), self.k, self.metric, include_self=True)
        near = near.filter(F.col("dist") <= self.max_distance) if self.max_distance is not None else near
        return N.vote(near, self.reference)

    def classify(self, cells: DataFrame) -> DataFrame:
        return N.majority(self.shares(cells))


class NearestInSpace(NearestNeighbours):
    """Labels of the nearest reference cells in the atlas, mirrored to one side."""

    def __init__(self, k: int = 1) -> None:
        super().__init__(k, "euclidean")

    @staticmethod
    def _placed(df: DataFrame) -> DataFrame:
        return df.withColumn("bits", F.array(*[F.abs(F.col(c)).cast("double") for c in ("ccf_x", "ccf_y", "ccf_z")]))

    def train(self, reference: DataFrame) -> NearestInSpace:
        super().train(self._placed(reference))
        return self

    def classify(self, cells: DataFrame) -> DataFrame:
        return super().classify(self._placed(cells))


class FittedModel(Classifier):
    """A pyspark.ml classifier over the features; labels of any kind."""

    def __init__(self, estimator) -> None:  # noqa: ANN001
        self.estimator = estimator

    def train(self, reference: DataFrame) -> FittedModel:
        names = [r["label"] for r in reference.select("label").distinct().orderBy("label").collect()]  # a taxonomy
        self.names = names
        ix = F.create_map(*[x for i, v in enumerate(names) for x in (F.lit(v), F.lit(float(i)))])
        rows = reference.select(array_to_vector("bits").alias("features"), ix[F.col("label")].alias("label"))
        self.model = self.estimator.fit(rows) if len(names) > 1 else None
        return self

    def probabilities(self, cells: DataFrame) -> DataFrame:
        """(id, label, p); only for models that give probabilities."""
        if self.model is None:
            return cells.select("id", F.lit(self.names[0]).alias("label"), F.lit(1.0).alias("p"))
        p = self.model.transform(cells.select("id", array_to_vector("bits").alias("features")))
        names = F.array(*[F.lit(v) for v in self.names])
        return p.select("id", F.explode(F.arrays_zip(names.alias("label"), vector_to_array("probability").alias("p"))).alias("_z")).select("id", "_z.label", "_z.p")

    def classify(self, cells: DataFrame) -> DataFrame:
        if self.model is None:
            return cells.select("id", F.lit(self.names[0]).alias("label"))
        p = self.model.transform(cells.select("id", array_to_vector("bits").alias("features")))
        return p.select("id", F.element_at(F.array(*[F.lit(v) for v in self.names]), (F.col("prediction") + 1).cast("int")).alias("label"))


def logistic(max_iter: int = 50) -> FittedModel:
    return FittedModel(LogisticRegression(maxIter=max_iter))


def gaussian_bayes() -> FittedModel:
    return FittedModel(NaiveBayes(modelType="gaussian"))


def linear_svc(max_iter: int = 30) -> FittedModel:
    """Two classes; used to carry labels across hemispheres."""
    return FittedModel(LinearSVC(maxIter=max_iter))


def neuron_flags(reference: DataFrame, subclass: str = "subclass") -> DataFrame:
    """Two-class labels: a subclass named with NN is Non_Neuron."""
    return reference.withColumn("label", F.when(F.col(subclass).contains("NN"), "Non_Neuron").otherwise("Neuron"))


def split_classification(reference: DataFrame, cells: DataFrame, flags: DataFrame, make: Callable[[], Classifier]) -> DataFrame:
    """Neurons and others classified apart, each among reference cells of its kind: flags (id, flag), reference has flag."""
    out = None
    for flag in ("Neuron", "Non_Neuron"):
        own = cells.join(flags.filter(F.col("flag") == flag).select("id"), "id", "left_semi")
        got = make().train(reference.filter(F.col("flag") == flag)).classify(own)
        out = got if out is None else out.unionByName(got)
    return out


def posterior(likelihood: DataFrame, prior: DataFrame) -> DataFrame:
    """(id, label, p) of likelihood times prior, normalised; a cell whose products are all 0 keeps its likelihood."""
    j = likelihood.join(prior.withColumnRenamed("p", "_q"), ["id", "label"], "left").withColumn("_p", F.col("p") * F.coalesce("_q", F.lit(0.0)))
    w = Window.partitionBy("id")
    total = F.sum("_p").over(w)
    return j.withColumn("p", F.when(total > 0, F.col("_p") / total).otherwise(F.col("p") / F.sum("p").over(w))).select("id", "label", "p")


def transfer(reference: DataFrame, cells: DataFrame, prior: DataFrame, hierarchy: list[tuple[DataFrame, str, str]], k: int = 15, metric: str = "correlation", permute: bool = False, seed: int = 0) -> dict[str, DataFrame]:
    """Label transfer with spatial priors: neighbour vote times prior at the finest level, rolled up the hierarchy.

    hierarchy lists (mapping, fine, coarse) from fine to coarse; permute deals the reference labels anew, as a null model.
    """
    if permute:
        a = dense_index(reference.drop("label"), ["id"], "_k")
        b = dense_index(reference.select("label", "id"), [F.xxhash64(F.lit(seed), "id"), "id"], "_k").drop("id")
        reference = a.join(b, "_k").drop("_k")
    shares = NearestNeighbours(k, metric).train(reference).shares(cells).withColumnRenamed("share", "p")
    post = materialize(posterior(shares, prior))
    out = {"finest": N.majority(post, "p")}
    level = post
    for mapping, fine, coarse in hierarchy:
        level = roll_up(level.withColumnRenamed("label", fine), mapping, fine, coarse, by="id").withColumnRenamed(coarse, "label")
        out[coarse] = N.majority(level, "p")
    return out


def iterative_classify(reference: DataFrame, cells: DataFrame, levels: list[str], make: Callable[[], Classifier], ignore_errors: bool = False) -> DataFrame:
    """Level by level, each within the parent predicted above: (id, one column a level). One class needs no model; on request, cells under a parent that has no reference cell are named `failed`. Other errors are raised."""
    out = cells.select("id", "bits").withColumn("_parent", F.lit(""))
    ref = reference.withColumn("_parent", F.lit(""))
    for level in levels:
        parents = [r["_parent"] for r in out.select("_parent").distinct().collect()]  # a taxonomy
        got = None
        for parent in parents:
            own, known = out.filter(F.col("_parent") == parent), ref.filter(F.col("_parent") == parent).withColumn("label", F.col(level))
            kinds = [r["label"] for r in known.select("label").distinct().limit(2).collect()]
            if len(kinds) == 1:
                part = own.select("id", F.lit(kinds[0]).alias("label"))
            elif kinds:
                part = make().train(known.select("id", "bits", "label")).classify(own.select("id", "bits"))
            elif ignore_errors:
                part = own.select("id", F.lit("failed").alias("label"))
            else:
                raise ValueError(f"no reference cell under {parent!r}")
            got = part if got is None else got.unionByName(part)
        out = materialize(out.join(got.withColumnRenamed("label", level), "id").withColumn("_parent", F.col(level)))
        ref = ref.withColumn("_parent", F.col(level))
    return out.select("id", *levels)


def bagging(reference: DataFrame, cells: DataFrame, make: Callable[[], Classifier], estimators: int = 10, per_class: int = 100) -> DataFrame:
    """Majority of classifiers trained on different balanced samples."""
    votes = None
    for seed in range(estimators):
        got = make().train(stratified_sample(reference, "label", per_class, "id", seed)).classify(cells)
        votes = got if votes is None else votes.unionByName(got)
    return votes.groupBy("id").agg(F.mode("label", True).alias("label"))


def classify_with_prior(reference: DataFrame, cells: DataFrame, make: Callable[[], Classifier], total: int = 2000, least: int = 10, momentum: float = 0.0, max_ratio: float | None = None, rounds: int = 10, tolerance: float = 1e-2) -> DataFrame:
    """The reference is sampled again in the proportions predicted so far until they settle; max_ratio bounds the most to the fewest."""
    labels = [r["label"] for r in reference.select("label").distinct().orderBy("label").collect()]
    share = {v: 1 / len(labels) for v in labels}
    got = None
    for i in range(1, rounds + 1):
        want = {v: max(least, int(total * s)) for v, s in share.items()}
        if max_ratio is not None:
            low = min(want.values())
            want = {v: min(c, int(max_ratio * low)) for v, c in want.items()}
        got = materialize(make().train(stratified_sample(reference, "label", want, "id", i)).classify(cells))
        n = {r["label"]: r["count"] for r in got.groupBy("label").count().collect()}
        all_cells = sum(n.values())
        m = momentum / i
        new = {v: m * share[v] + (1 - m) * n.get(v, 0) / max(all_cells, 1) for v in labels}
        moved = sum(abs(new[v] - share[v]) for v in labels)
        share = new
        if moved <= tolerance:
            break
    return got


def topics(environments: DataFrame, types: int, candidates: list[int], seed: int = 0, max_iter: int = 20) -> tuple[int, DataFrame]:
    """(topics chosen, (id, topic, mixture)): LDA over type counts (id, vec) for each candidate number; the one whose most probable topics have the largest entropy."""
    rows = environments.select("id", array_to_vector("vec").alias("features"))
    best = None
    for k in candidates:
        model = LDA(k=k, seed=seed, maxIter=max_iter).fit(rows)
        got = model.transform(rows).select("id", vector_to_array("topicDistribution").alias("mixture"))
        got = materialize(got.withColumn("topic", (F.array_position("mixture", F.array_max("mixture")) - 1).cast("int")))
        h = label_entropy(got, "topic").first()["h"]
        if best is None or h > best[0]:
            best = (h, k, got)
    return best[1], best[2].select("id", "topic", "mixture")


def kmeans_regions(environments: DataFrame, k: int, seed: int = 1) -> DataFrame:
    rows = environments.select("id", array_to_vector("vec").alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("id", F.col("prediction").alias("region"))


def cluster_vote(reference: DataFrame, cells: DataFrame, clusters: DataFrame, n: int, k: int = 25) -> DataFrame:
    """(id, label): each cluster's median profile takes the label of more than half of its k nearest reference cells, or none."""
    med = Z.grouped_feature_aggregates(cells.join(clusters, "id"), "community", "bits", n, m=F.median).withColumnRenamed("m", "bits")
    shares = NearestNeighbours(k).train(reference).shares(med.withColumnRenamed("community", "id"))
    won = shares.filter("share > 0.5").select(F.col("id").alias("community"), "label")
    return clusters.join(won, "community", "left").select("id", "label")


def recursive_clusters(cells: DataFrame, cluster: Callable[[DataFrame], DataFrame], levels: int = 2) -> DataFrame:
    """(id, label): clusters clustered again; cluster gives (id, community) of the cells it is given."""
    out = materialize(cells.select("id", F.lit(0).cast("long").alias("label")))
    for _ in range(levels):
        parts, offset = None, 0
        for r in out.select("label").distinct().orderBy("label").collect():  # cluster names
            own = materialize(cluster(cells.join(out.filter(F.col("label") == r["label"]).select("id"), "id", "left_semi")))
            part = own.select("id", (F.col("community") + offset).cast("long").alias("label"))
            offset += own.agg(F.max("community")).first()[0] or 0
            parts = part if parts is None else parts.unionByName(part)
        out = materialize(parts)
    return out


def kfold_regression(cells: DataFrame, targets: DataFrame, n: int, folds: int = 2, k: int = 5, metric: str = "euclidean", seed: int = 0) -> DataFrame:
    """(id, bits, predicted): each fold's targets (id, target array of n) predicted as the mean of the k nearest cells of the other folds."""
    placed = materialize(cells.select("id", "bits").withColumn("_f", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(folds))))
    out = None
    for f in range(folds):
        near = N.knn_features(placed.filter(F.col("_f") == f), placed.filter(F.col("_f") != f), k, metric)
        got = N.knn_mean(near, targets, "target", n).withColumnRenamed("target", "predicted")
        out = got if out is None else out.unionByName(got)
    return out.join(targets, "id")


class OptimalCommunities(Classifier):
    """Types as communities of the feature graph at the resolution whose zones carry the most conditional entropy, agreed by several runs; new cells take the type of the nearest."""

    def __init__(self, spatial_edges: DataFrame, feature_edges: DataFrame, iterations: int = 4, runs: int = 3, metric: str = "correlation") -> None:
        self.spatial, self.features, self.iterations, self.runs, self.metric = spatial_edges, feature_edges, iterations, runs, metric

    def train(self, reference: DataFrame) -> OptimalCommunities:
        from cellweft.operators import graph

        nodes = reference.select("id", "section", "x", "y", "type_ix")
        whole = nodes.withColumn("section", F.lit("all"))
        self.resolution = graph.best_resolution(self.features, whole, iterations=self.iterations)
        self.labels = materialize(graph.consensus(self.features, whole, self.resolution, self.runs).withColumnRenamed("community", "label"))
        self.nearest = NearestNeighbours(1, self.metric).train(reference.join(self.labels, "id"))
        return self

    def classify(self, cells: DataFrame) -> DataFrame:
        return self.nearest.classify(cells)


def subsampled_communities(cells: DataFrame, every: int = 10, window: float = 0.3, k: int = 15, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, community): every n-th cell of each section, linked to its nearest sampled cells in sections within a distance (column z), clustered; the other cells take the commonest community of their nearest sampled cells."""
    from cellweft.operators import graph
    from cellweft.operators.relational import every_nth

    sample = materialize(every_nth(cells, every, "section", "id").select("id", "section", "z", "bits"))

    def near(queries: DataFrame, include_self: bool) -> DataFrame:
        # sections within the window of each other, told by their mean depth
        depth = sample.groupBy("section").agg(F.avg("z").alias("z"))
        a, b = depth.select(F.col("section").alias("sa"), F.col("z").alias("za")), depth.select(F.col("section").alias("sb"), F.col("z").alias("zb"))
        close = a.crossJoin(b).filter(F.abs(F.col("za") - F.col("zb")) <= window).select("sa", "sb")  # sections, not cells
        q = queries.select(F.col("id").alias("src"), F.col("section").alias("sa"), F.col("bits").alias("_a")).join(close, "sa")
        pairs = q.join(sample.select(F.col("id").alias("dst"), F.col("section").alias("sb"), F.col("bits").alias("_b")), "sb")
        pairs = pairs if include_self else pairs.filter("src <> dst")
        return N._top(pairs.select("src", "dst", (1 - A.pearson(F.col("_a"), F.col("_b"))).alias("dist")), k)

    edges = materialize(near(sample, False).select("src", "dst"))
    got = materialize(graph.communities(edges, sample.select("id", F.lit("all").alias("section")), resolution, seed))
    rest = cells.join(sample.select("id"), "id", "left_anti")
    votes = near(rest, True).join(got.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.mode("community", True).alias("community"))
    return got.unionByName(votes)


def align(reference: DataFrame, cells: DataFrame, prior: DataFrame, clusters: DataFrame, n: int, make: Callable[[], FittedModel] | None = None, resample: int = 500_000, least: int = 10) -> DataFrame:
    """(id, label): the steps of a whole alignment.

    The reference is resampled by the labels' prior weight; both sides are standardised; clusters vote neuron or not, which rules out the labels of the
    other kind; the dendrogram of label profiles is walked with a model at each split. reference: (id, bits, label, flag), clusters: (id, community).
    """
    weight = prior.groupBy("label").agg(F.sum("p").alias("_w"))
    from cellweft.operators.relational import weighted_resample

    drawn = materialize(weighted_resample(reference.join(weight, "label"), "label", "_w", resample, least, "id"))
    ref, own = Z.zscore(drawn, "bits", n), Z.zscore(cells, "bits", n)
    flags = cluster_vote(ref.withColumn("label", F.col("flag")), own, clusters, n)
    kinds = reference.groupBy("label").agg(F.first("flag").alias("_kind"))
    allowed = prior.join(kinds, "label").join(flags.withColumnRenamed("label", "_flag"), "id", "left")
    allowed = materialize(allowed.filter(F.col("_flag").isNull() | (F.col("_flag") == F.col("_kind"))).select("id", "label", "p"))
    med = Z.grouped_feature_aggregates(ref, "label", "bits", n, m=F.median).orderBy("label").toPandas()  # a taxonomy
    return supervised_walk(ref.select("id", "bits", "label"), own.select("id", "bits"), allowed, ward(np.array(med["m"].tolist())), med["label"].tolist(), make or logistic)


# dendrograms


def ward(x: np.ndarray) -> np.ndarray:
    """Merges (a, b, height, size) of Ward's method over a few hundred profiles, leaves first."""
    n = len(x)
    size, alive = {i: 1 for i in range(n)}, list(range(n))
    d = {(i, j): float(((x[i] - x[j]) ** 2).sum()) for i in range(n) for j in range(i)}
    get = lambda i, j: d[(max(i, j), min(i, j))]
    out = []
    for k in range(n, 2 * n - 1):
        a, b = min(((i, j) for p, i in enumerate(alive) for j in alive[:p]), key=lambda q: (get(*q), q[1], q[0]))
        h = get(a, b)
        rest = [c for c in alive if c not in (a, b)]
        for c in rest:
            total = size[a] + size[b] + size[c]
            d[(k, c)] = ((size[a] + size[c]) * get(a, c) + (size[b] + size[c]) * get(b, c) - size[c] * h) / total
        size[k] = size[a] + size[b]
        alive = [*rest, k]
        out.append((min(a, b), max(a, b), h**0.5, size[k]))
    return np.array(out, float).reshape(-1, 4)


def cut(merges: np.ndarray, n: int, height: float | None = None, groups: int | None = None) -> np.ndarray:
    """Group of each leaf, below a height or into so many groups; groups from 0 in the order of their first leaf."""
    stop = len(merges) if groups is None else max(n - groups, 0)
    parent = list(range(2 * n))
    for k, (a, b, h, _) in enumerate(merges[:stop]):
        if height is not None and h > height:
            break
        parent[int(a)] = parent[int(b)] = n + k

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    roots = [root(i) for i in range(n)]
    names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([names[r] for r in roots])


def leaf_order(merges: np.ndarray, n: int) -> list[int]:
    members = {i: [i] for i in range(n)}
    for k, (a, b, *_) in enumerate(merges):
        members[n + k] = members[int(a)] + members[int(b)]
    return members[n + len(merges) - 1] if len(merges) else list(range(n))


def merge_labels(rows: DataFrame, n: int, groups: int | None = None, correlation: float | None = None, label: str = "label") -> DataFrame:
    """(label, merged): labels whose median profiles correlate, by Ward's method on 1 - correlation; into so many groups or above a correlation."""
    med = Z.grouped_feature_aggregates(rows, label, "bits", n, m=F.median).orderBy(label).toPandas()  # a taxonomy
    r = 1 - np.corrcoef(np.array(med["m"].tolist()))
    merges = ward(np.atleast_2d(r))
    got = cut(merges, len(med), None if correlation is None else 1 - correlation, groups)
    return rows.sparkSession.createDataFrame(pd.DataFrame({label: med[label], "merged": got}))


def dendrogram_table(spark, merges: np.ndarray, names: list[str]) -> DataFrame:  # noqa: ANN001
    """Rows A, B, C, H: A and B join to the internal node C (named n0, n1, ...) at height H."""
    name = lambda i: names[i] if i < len(names) else f"n{i - len(names)}"
    rows = [(name(int(a)), name(int(b)), f"n{k}", float(h)) for k, (a, b, h, _) in enumerate(merges)]
    return spark.createDataFrame(rows, "A string, B string, C string, H double")


def dendrogram_leaves(dend: DataFrame) -> DataFrame:
    """(node, leaf) of every internal node, by a recursive query down the merges."""
    dend.createOrReplaceTempView("_dend")
    return dend.sparkSession.sql(
        """WITH RECURSIVE down AS (
             SELECT C AS node, child FROM (SELECT C, explode(array(A, B)) AS child FROM _dend)
             UNION ALL
             SELECT d.node, e.child FROM down d JOIN (SELECT C, explode(array(A, B)) AS child FROM _dend) e ON d.child = e.C)
           SELECT node, child AS leaf FROM down WHERE child NOT IN (SELECT C FROM _dend)"""
    )


def dendrogram_average(dend: DataFrame, values: DataFrame) -> DataFrame:
    """(node, value): mean of the leaves under each node; values (leaf, value)."""
    return dendrogram_leaves(dend).join(values, "leaf").groupBy("node").agg(F.avg("value").alias("value"))


def dendrogram_cut(dend: DataFrame, labels: DataFrame, level: float) -> DataFrame:
    """(leaf, label): the highest node at or below the level that holds the leaf, else the leaf."""
    own = dendrogram_leaves(dend).join(dend.filter(F.col("H") <= level).select(F.col("C").alias("node"), "H"), "node")
    top = own.groupBy("leaf").agg(F.max_by("node", F.struct("H", "node")).alias("_n"))
    return labels.select("leaf").join(top, "leaf", "left").select("leaf", F.coalesce("_n", "leaf").alias("label"))


def supervised_walk(reference: DataFrame, cells: DataFrame, prior: DataFrame, merges: np.ndarray, names: list[str], make: Callable[[], FittedModel] = logistic) -> DataFrame:
    """(id, label): from the root of a dendrogram of labels, each split decided by a two-class model times the prior of the labels on either side; null where both are 0."""
    n = len(names)
    members = {i: [i] for i in range(n)}
    for k, (a, b, *_) in enumerate(merges):
        members[n + k] = members[int(a)] + members[int(b)]
    at = {n + len(merges) - 1: cells}
    done = []
    for k in range(len(merges) - 1, -1, -1):
        here = at.pop(n + k, None)
        if here is None:
            continue
        a, b = int(merges[k, 0]), int(merges[k, 1])
        left, right = ([names[i] for i in members[s]] for s in (a, b))
        ref = reference.filter(F.col("label").isin([*left, *right])).withColumn("label", F.when(F.col("label").isin(left), "a").otherwise("b"))
        p = make().train(ref).probabilities(here)
        q = prior.filter(F.col("label").isin([*left, *right])).groupBy("id", F.when(F.col("label").isin(left), "a").otherwise("b").alias("label")).agg(F.sum("p").alias("_q"))
        j = p.join(q, ["id", "label"], "left").withColumn("_s", F.col("p") * F.coalesce("_q", F.lit(0.0)))
        side = materialize(j.groupBy("id").agg(F.max("_s").alias("_m"), F.min_by("label", F.struct(-F.col("_s"), F.col("label"))).alias("_side")))
        done.append(side.filter("_m <= 0").select("id", F.lit(None).cast("string").alias("label")))
        for node, name in ((a, "a"), (b, "b")):
            own = here.join(side.filter((F.col("_m") > 0) & (F.col("_side") == name)).select("id"), "id", "left_semi")
            if node < n:
                done.append(own.select("id", F.lit(names[node]).alias("label")))
            else:
                at[node] = materialize(own)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


# factorisation


def start_basis(c: np.ndarray, k: int, how: str = "pca", seed: int = 0) -> np.ndarray:
    """pca (absolute leading directions), pca_2x (positive and negative parts apart), normal or uniform; spectral norm 1."""
    rng = np.random.default_rng(seed)
    if how in ("pca", "pca_2x"):
        v = np.linalg.eigh(c)[1][:, ::-1]
        w = np.abs(v[:, :k]) if how == "pca" else np.concatenate([np.maximum(v[:, : -(-k // 2)], 0), np.maximum(-v[:, : -(-k // 2)], 0)], axis=1)[:, :k]
    elif how == "normal":
        w = np.abs(rng.normal(size=(len(c), k)))
    elif how == "uniform":
        w = rng.uniform(size=(len(c), k))
    else:
        raise ValueError(f"unknown start {how}")
    return w / np.linalg.norm(w, 2)


def projective_nmf(c: np.ndarray, k: int, scatter: np.ndarray | None = None, mu: float = 0.0, start: str = "pca", seed: int = 0, tolerance: float = 1e-5, max_iter: int = 1000, zero: float = 1e-10) -> np.ndarray:
    """Non-negative W with X near W W' X, from the second moments c = X X' alone; with a scatter matrix S, W' S W is rewarded by mu.

    Multiplicative updates; S is split into its positive and negative parts so that all factors stay non-negative.
    """
    w = start_basis(c, k, start, seed)
    plus = np.zeros_like(c) if scatter is None else mu * np.maximum(scatter, 0)
    minus = np.zeros_like(c) if scatter is None else mu * np.maximum(-scatter, 0)
    for _ in range(max_iter):
        up = 2 * c @ w + plus @ w
        down = w @ (w.T @ c @ w) + c @ w @ (w.T @ w) + minus @ w
        new = w * up / np.maximum(down, zero)
        new = new / np.linalg.norm(new, 2)
        new[new < zero] = 0
        moved = ((new - w) ** 2).sum()
        w = new
        if moved <= tolerance:
            break
    return w


def second_moments(df: DataFrame, bits: str, n: int) -> np.ndarray:
    """X X' of the features, by one aggregate."""
    count, mean, cov = Z.moments(df, bits, n)
    return count * (cov + np.outer(mean, mean))

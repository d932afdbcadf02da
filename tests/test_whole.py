"""Registered queries do the whole job: brute force, and inputs beyond former limits."""

import inspect

import numpy as np
import pandas as pd
import pytest

from cellweft.operators import classify, graph
from cellweft.plans.catalogue import QUERIES
from cellweft.plans.fixtures import BITS, cells

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def nearest():
    """ids, labels, features and the 5 nearest of every cell by cosine distance, by brute force."""
    d = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    ids, v = d["vec_id"].to_numpy(), np.stack(d["embedding"]).astype(float)[:, :BITS] * 100 + 50
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    dist = 1 - unit @ unit.T
    np.fill_diagonal(dist, np.inf)
    return ids, d["label"].to_numpy(), v, np.lexsort((np.broadcast_to(ids, dist.shape), dist.round(12)))[:, :5], dist


def test_every_cell_has_its_nearest_features(spark, nearest):
    ids, _, _, best, dist = nearest
    got = QUERIES["knn_features_cosine"](spark, SF).toPandas().sort_values(["src", "rank"])
    assert got["src"].tolist() == np.repeat(ids, 5).tolist()
    assert got["dst"].tolist() == ids[best].ravel().tolist()
    assert np.allclose(got["dist"], np.take_along_axis(dist, best, 1).ravel(), atol=2e-6)


def test_every_cell_has_a_voted_label(spark, nearest):
    ids, label, _, best, _ = nearest
    got = QUERIES["knn_vote"](spark, SF).toPandas().sort_values("id")
    assert got["id"].tolist() == ids.tolist()
    assert got["label"].tolist() == [int(np.bincount(label[b]).argmax()) for b in best]


def test_every_cell_has_imputed_features(spark, nearest):
    ids, _, v, best, _ = nearest
    got = QUERIES["knn_imputation"](spark, SF).toPandas().sort_values(["id", "bit"])
    assert got["id"].tolist() == np.repeat(ids, BITS).tolist()
    assert np.allclose(got["v"], v[best].mean(1).ravel(), atol=2e-6)


def test_small_zones_are_filled_to_any_depth(spark):
    side, deep = 4, 23
    nodes = spark.createDataFrame([(i, 9 if i < side else i % 2) for i in range(side + deep)] + [(100, 0), (101, 1)], "id long, type_ix long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(side + deep - 1)] + [(100, 101)], "src long, dst long")
    got = {r["id"]: r["type_ix"] for r in graph.fill_small_zones(edges, nodes, side).collect()}
    # the pair that no large zone reaches keeps its types
    assert got == {i: 9 for i in range(side + deep)} | {100: 0, 101: 1}


def test_enrichment_has_a_hundred_permutations(spark):
    p = QUERIES["graph_enrichment"](spark, SF).toPandas()["p"] * 101
    assert np.allclose(p, p.round(), atol=1e-4) and p.min() >= 2 - 1e-4


def test_percolation_has_all_steps(spark):
    got = QUERIES["percolation"](spark, SF).toPandas()
    assert (got.groupby(["kind", "section"])["p"].nunique() == 101).all()


@pytest.mark.parametrize(("name", "operator", "want"), [("classify_bagging", "bagging", {"estimators": 10, "per_class": 100}), ("topic_model", "topics", {"candidates": [2, 3, 4, 7, 11, 17, 27, 41, 64, 100], "max_iter": 20})])
def test_models_are_registered_in_full(spark, monkeypatch, name, operator, want):
    signature, seen = inspect.signature(getattr(classify, operator)), []

    def asked(*a, **b):
        seen.append(signature.bind(*a, **b))
        raise InterruptedError

    monkeypatch.setattr(classify, operator, asked)
    with pytest.raises(InterruptedError):
        QUERIES[name](spark, SF)
    seen[0].apply_defaults()
    assert {k: seen[0].arguments[k] for k in want} == want


def test_all_of_an_embedding_is_bound(spark):
    d = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    got = cells(spark, SF).orderBy("id").toPandas()
    assert np.allclose(np.stack(got["bits"]), np.stack(d["embedding"]).astype(float) * 100 + 50)

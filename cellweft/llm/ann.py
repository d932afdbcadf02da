"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts (recursive bisection along the graph's slow direction, halves exchanged
while that saves edges); a small network learns to tell the part from the vector. Every row is indexed under its most
probable part; a query is routed to several most probable parts and all their rows are compared exactly.
The number of parts probed is the least that finds the wanted share of neighbours in a held-out piece of the sample. Where the parts would be
large, each is partitioned again in the same way, by a sample of its own rows in a task of its own, so that the parts grow in number with the rows.

Nearness is the cosine in double precision on the original vectors, ties go to the smaller id. Vectors that are null, zero, of another
length than most, or hold null or non-finite components take no part; repeated rows of one id count once; other columns are ignored; an empty
table gives an empty result. Parts are split into cells of bounded size, so that a part, however many equal
vectors it holds, is never one task. Vectors are scaled by a power of two before anything is multiplied, so that very large and very small
components neither overflow nor vanish.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.llm.common import materialize

#: Bound of each sample that a partition is fitted on.
SAMPLE = 4096
ROWS_PER_PART = 512
#: Parts of a level; there are two levels at most.
MAX_PARTS = 128
#: Parts of the first level whose own parts a query considers; doubled until the held-out neighbours are among them.
WIDE = 16
GRAPH_K = 10
HIDDEN = 64
#: Share of neighbours that the routing must find in the held-out piece of the sample.
COVERAGE = 0.97
CELL = 4096


def nearest(x: np.ndarray, y: np.ndarray, k: int, skip_self: bool = False) -> np.ndarray:
    """Indices of the k rows of y nearest to each row of x, both of unit length, block by block."""
    out = np.empty((len(x), min(k, len(y) - skip_self)), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ y.T
        if skip_self:
            s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        top = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < len(y) else np.argsort(-s, axis=1)
        out[a : a + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
    return out


def bisect(src: np.ndarray, dst: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Two halves of the graph's n nodes: a boolean."""
    degree = np.bincount(src, minlength=n) + 1e-9
    v = rng.normal(size=n)
    for _ in range(60):
        v -= (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * np.bincount(src, v[dst], n) / degree
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(10):
        across = np.bincount(src, side[src] != side[dst], n)
        gain = 2 * across - degree  # edges saved by a move
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b), max(1, n // 50))
        good = gain[a[:m]] + gain[b[:m]] > 2  # the two may share an edge
        if not good.any():
            break
        moved = side.copy()
        moved[a[:m][good]], moved[b[:m][good]] = True, False
        if (moved[src] != moved[dst]).sum() >= (side[src] != side[dst]).sum():
            break
        side = moved
    return side


def partition(neighbours: np.ndarray, depth: int, seed: int = 5) -> np.ndarray:
    """Balanced part of every node of the symmetric graph, 2**depth parts."""
    n = len(neighbours)
    rng = np.random.default_rng(seed)
    src, dst = np.repeat(np.arange(n), neighbours.shape[1]), neighbours.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    part = np.zeros(n, np.int64)
    for level in range(depth):
        for p in range(1 << level):
            nodes = np.flatnonzero(part == p)
            if len(nodes) < 2:
                part[nodes] = 2 * p + (1 << 30)
                continue
            at = np.full(n, -1)
            at[nodes] = np.arange(len(nodes))
            inside = (at[src] >= 0) & (at[dst] >= 0)
            part[nodes] = 2 * p + bisect(at[src[inside]], at[dst[inside]], len(nodes), rng) + (1 << 30)
        part -= 1 << 30
    return part


@dataclass
class Router:
    hidden: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @property
    def dimension(self) -> int:
        return self.hidden.shape[0]

    @property
    def parts(self) -> int:
        return self.out.shape[1]

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.hidden + self.bias, 0) @ self.out + self.out_bias

    def log_probabilities(self, unit: np.ndarray) -> np.ndarray:
        z = self.logits(unit)
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class Index:
    """A router, and one for each part that is partitioned again; a part's number is that of its parent times `fan` plus its own."""

    top: Router
    below: dict[int, Router]
    fan: int
    wide: int
    probes: int = 1

    def homes(self, unit: np.ndarray) -> np.ndarray:
        """The most probable part of each row."""
        part = self.top.logits(unit).argmax(axis=1)
        own = np.zeros(len(part), np.int64)
        for p in np.unique(part):
            if p in self.below:
                own[part == p] = self.below[p].logits(unit[part == p]).argmax(axis=1)
        return part * self.fan + own

    def ranked(self, unit: np.ndarray) -> list[np.ndarray]:
        """Parts of each row, the most probable first: all of one level, or those below the `wide` most probable ones."""
        first = self.top.log_probabilities(unit)
        order = np.argsort(-first, axis=1, kind="stable")
        if not self.below:
            return list(order * self.fan)
        order = order[:, : self.wide]
        parts: list[list[np.ndarray]] = [[] for _ in unit]
        scores: list[list[np.ndarray]] = [[] for _ in unit]
        for p in np.unique(order):
            rows = np.flatnonzero((order == p).any(axis=1))
            z = self.below[p].log_probabilities(unit[rows]) if p in self.below else np.zeros((len(rows), 1))
            for i, r in enumerate(rows):
                parts[r].append(p * self.fan + np.arange(z.shape[1]))
                scores[r].append(first[r, p] + z[i])
        return [np.concatenate(a)[np.argsort(-np.concatenate(b), kind="stable")] for a, b in zip(parts, scores, strict=True)]


def train_router(unit: np.ndarray, target: np.ndarray, seed: int = 5, epochs: int = 40, rate: float = 3e-3) -> Router:
    """Softmax on the share of every part among a vector's neighbours and itself."""
    rng = np.random.default_rng(seed)
    d, parts = unit.shape[1], target.shape[1]
    r = Router(rng.normal(0, np.sqrt(2 / d) * np.sqrt(d) / 4, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts))
    params = [r.hidden, r.bias, r.out, r.out_bias]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(unit))
        for a in range(0, len(order), 128):
            x, t = unit[order[a : a + 128]], target[order[a : a + 128]]
            h = np.maximum(x @ r.hidden + r.bias, 0)
            z = h @ r.out + r.out_bias
            e = np.exp(z - z.max(1, keepdims=True))
            g = (e / e.sum(1, keepdims=True) - t) / len(x)
            gh = (g @ r.out.T) * (h > 0)
            step += 1
            for p, q, u, v in zip(params, [x.T @ gh, gh.sum(0), h.T @ g, g.sum(0)], m1, m2, strict=True):
                u += 0.1 * (q - u)
                v += 0.01 * (q * q - v)
                p -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return r


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(unit: np.ndarray, rows: int) -> tuple[Router, np.ndarray]:
    """A router to the parts of the sample's neighbour graph, and the graph; rows: how many the parts will hold."""
    wanted = min(MAX_PARTS, max(4, rows // ROWS_PER_PART), max(1, len(unit) // 16))
    depth = int(np.log2(wanted)) if wanted > 1 else 0
    if len(unit) < 3 or not depth:
        return Router(np.zeros((unit.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), np.zeros((len(unit), 0), np.int64)
    near = nearest(unit, unit, min(GRAPH_K, len(unit) - 1), skip_self=True)
    part = partition(near, depth)
    eye = np.eye(1 << depth)
    target = (eye[part] + eye[part[near]].mean(axis=1)) / 2
    held = _held(len(unit))
    return train_router(unit[~held], target[~held]), near


def _held(n: int) -> np.ndarray:
    return np.arange(n) % 8 == 7


def set_probes(index: Index, unit: np.ndarray, near: np.ndarray, k: int) -> None:
    """Route held-out rows of the sample and see in how many probes the parts of their neighbours lie, indexed as all rows are."""
    if not near.shape[1]:
        return
    held = _held(len(unit))
    home = index.homes(unit)
    while True:
        ranked = index.ranked(unit[held])
        most = max(map(len, ranked))
        need = []
        for order, wanted in zip(ranked, home[near[held][:, :k]], strict=True):
            place = {p: m for m, p in enumerate(order.tolist(), 1)}
            need += [place.get(p, most + 1) for p in wanted.tolist()]
        found = np.searchsorted(np.sort(need), np.arange(1, most + 1), side="right") / len(need)
        if found[-1] >= COVERAGE or index.wide >= index.top.parts:
            break
        index.wide *= 2
    index.probes = next((m for m, share in enumerate(found.tolist(), 1) if share >= COVERAGE), most)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector as array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col(key).isNotNull() & v.isNotNull()).filter(fine & F.exists(v, lambda x: x != 0)).select(key, v.alias(vector))


def _matrix(values: pd.Series) -> np.ndarray:
    """Rows in double precision, each scaled by a power of two, which changes no digit, so that its largest component is near 1."""
    x = np.array(values.tolist(), np.float64)
    if not x.size:
        return x
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of one vector and rows, summed in the same order for equal rows."""
    return (q * c).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((c * c).sum(axis=1)))


def best_in_cell(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The k nearest rows of each query. Equal vectors are compared once; only their k + 1 smallest ids can be among the nearest."""
    order = np.argsort(c_ids, kind="stable")
    keep = order[np.concatenate([[True], np.diff(c_ids[order]) != 0])]
    c_ids, c = c_ids[keep], c[keep]
    unique, inverse = np.unique(c, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by = np.argsort(inverse, kind="stable")  # ids ascend within a vector
    starts = np.searchsorted(inverse[by], np.arange(len(unique) + 1))
    unit = unique / np.linalg.norm(unique, axis=1, keepdims=True)
    for a in range(0, len(q), 256):
        s = (q[a : a + 256] / np.linalg.norm(q[a : a + 256], axis=1, keepdims=True)) @ unit.T
        floor = np.partition(s, -min(k + 1, len(unique)), axis=1)[:, -min(k + 1, len(unique))] - 1e-9
        for i, row in enumerate(s):
            near = np.flatnonzero(row >= floor[i])
            members = np.concatenate([by[starts[u] : min(starts[u + 1], starts[u] + k + 1)] for u in near])
            members = members[c_ids[members] != q_ids[a + i]]
            score = cosine(q[a + i], c[members])
            top = np.lexsort((c_ids[members], -score))[:k]
            yield q_ids[a + i], c_ids[members[top]], score[top]


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest rows found of each query other than its own id."""
    base = materialize(usable(vectors, key, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")))
    schema = "query_id long, rank int, vec_id long, score double"
    rows = base.count()
    if not rows:
        return base.sparkSession.createDataFrame([], schema)
    dimension = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    base = base.filter(F.size("v") == dimension)
    index = _index(base, rows, k)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["v"]).reshape(-1, index.top.dimension)
            yield batch.assign(part=index.homes(unit_rows(x)).astype(np.int32))

    indexed = materialize(base.mapInPandas(place, "id long, v array<double>, part int"))
    counts = dict(indexed.groupBy("part").count().toPandas().itertuples(index=False))  # as many rows as parts

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["v"]).reshape(-1, index.top.dimension)
            chosen = []
            for order in index.ranked(unit_rows(x)):
                full = [p for p in order.tolist() if counts.get(p)]
                m = index.probes
                while m < len(full) and sum(counts[p] for p in full[:m]) <= k:
                    m += 1
                if sum(counts[p] for p in full[:m]) <= k:  # the parts considered hold too little
                    full, m = [*full, *sorted(set(counts) - set(full))], len(counts)
                chosen.append(full[:m])
            yield batch.assign(parts=chosen)

    q = usable(queries, key, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.size("v") == dimension).dropDuplicates(["id"])
    routed = materialize(q.mapInPandas(route, "id long, v array<double>, parts array<int>").select("id", "v", F.explode("parts").alias("part")))
    asked = dict(routed.groupBy("part").count().toPandas().itertuples(index=False))
    cells = base.sparkSession.createDataFrame([(int(p), -(-int(counts[p]) // CELL), -(-int(asked.get(p, 1)) // CELL)) for p in sorted(counts)], "part int, _c int, _q int")

    def spread(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        """Each row goes to one cell of its own side, and meets all of the other."""
        sized = df.join(F.broadcast(cells), "part")  # as many rows as parts
        return sized.withColumns({mine: F.pmod(F.xxhash64("id"), F.col(own)).cast("int"), theirs: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}).drop("_c", "_q")

    left = spread(routed, "_q", "_c", "qs", "cs").groupBy("part", "cs", "qs")
    right = spread(indexed, "_c", "_q", "cs", "qs").groupBy("part", "cs", "qs")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            for i, ids, score in best_in_cell(a["id"].to_numpy(), _matrix(a["v"]), b["id"].to_numpy(), _matrix(b["v"]), k):
                out.append(pd.DataFrame({"query_id": i, "vec_id": ids, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = left.cogroup(right).applyInPandas(compare, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _index(base: DataFrame, rows: int, k: int) -> Index:
    """Fit on samples of at most SAMPLE rows: one for the first level, one of each part for the second, each of these in a task of its own."""
    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    unit = unit_rows(_matrix(sample["v"]))
    top, near = fit(unit, rows)
    index = Index(top, {}, MAX_PARTS, WIDE)
    if rows > MAX_PARTS * ROWS_PER_PART * 2:
        share = min(1.0, 2 * SAMPLE * top.parts / rows)

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                part = top.logits(unit_rows(_matrix(batch["v"]))).argmax(axis=1) if len(batch) else np.zeros(0)
                yield batch.assign(part=part.astype(np.int32))

        def below(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf.sort_values("_rank")
            r, _ = fit(unit_rows(_matrix(own["v"])), rows // top.parts)
            return pd.DataFrame([(key[0], *(a.astype(np.float32).ravel().tolist() for a in (r.hidden, r.bias, r.out, r.out_bias)))], columns=["part", "a", "b", "c", "d"])

        span = 1 << 30
        drawn = base.withColumn("_h", F.xxhash64(F.lit("below"), "id")).filter(F.pmod("_h", F.lit(span)) < int(share * span))
        drawn = drawn.select("id", "v", "_h").mapInPandas(draw, "id long, v array<double>, _h long, part int")
        first = F.row_number().over(Window.partitionBy("part").orderBy("_h", "id"))
        drawn = drawn.withColumn("_rank", first).filter(F.col("_rank") <= SAMPLE)
        fitted = drawn.groupBy("part").applyInPandas(below, "part int, a array<float>, b array<float>, c array<float>, d array<float>")
        for r in fitted.collect():  # at most MAX_PARTS small networks
            a, b, c, d = (np.array(r[x], np.float64) for x in "abcd")
            index.below[r["part"]] = Router(a.reshape(-1, len(b)), b, c.reshape(len(b), -1), d)
    set_probes(index, unit, near, k)
    return index

"""Quality classifier learned from positive and unlabelled texts.

Trusted positives and unlabelled web text train a classifier by minimising the non-negative unbiased risk: with the class prior pi,
    R = pi * E_p[l(g, +)] + max(0, E_u[l(g, -)] - pi * E_p[l(g, -)]),
where a step at which the second term is below zero raises it again. With the squared loss l(g, y) = (1 - y g)^2 / 4 and g linear in
fixed random features of the text, every expectation is a quadratic form of the features' first and second moments. These are sums over all
positives and all unlabelled texts, taken by one distributed aggregate each, so that no text is left out of the risk and the descent itself
costs the same for any number of texts. (1 + g) / 2 estimates the probability of the positive class.

The prior is estimated from the same texts: a first classifier of positives against unlabelled text, fitted on one half of them, ranks the other
half, and the least ratio of the unlabelled to the positive share above a threshold, with a confidence margin, bounds the prior from above and is
tight where one bin is purely positive.

A text is described by the frequencies of pairs of character classes over all of it and by some shares (repeated lines and
words, word lengths, size). Texts that are null or empty have the description of no character, and a score; without positives every score is 0.5.
Every text is described once, in the shared checkpoint folder. Rows that repeat a key each count and each get their row; a
trusted key that is repeated or unknown counts once or not at all; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import map_rows, materialize

#: Random features beside the constant, their spread, and the weight of their squares in the risk.
HIDDEN = 64
SPREAD = 0.5
DECAY = 1e-3
STEPS = 3000
#: Bins of the first classifier's scores; sums of partitions that are added up in one task.
BINS = 400
FAN = 32

# Character classes of ASCII; other bytes are a class of their own.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",;:", "!?", "'\"()-", "|*#$%&@~^_+=<>/\\[]{}`")
_MAP = np.full(256, len(CLASSES) + 1, np.uint8)
for _k, _chars in enumerate(CLASSES):
    for _c in _chars:
        _MAP[ord(_c)] = _k
_MAP[:32][_MAP[:32] == len(CLASSES) + 1] = len(CLASSES)
_CODE = _MAP.tobytes()
SIDE = len(CLASSES) + 2
FEATURES = SIDE * SIDE + 8


def describe(text: str | None) -> np.ndarray:
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    c = np.frombuffer(raw.translate(_CODE), np.uint8).astype(np.int16)
    pairs = np.bincount(c[:-1] * SIDE + c[1:], minlength=SIDE * SIDE)
    out[: SIDE * SIDE] = np.sqrt(pairs / max(len(raw) - 1, 1))
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    kinds = len(set(words))
    out[SIDE * SIDE :] = (
        np.log1p(len(raw)) / 10,
        np.log1p(len(words)) / 8,
        kinds / n,
        len(raw) / n / 20,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(lines)) / 5,
        np.log1p(len(raw) / len(lines)) / 8,
        kinds / np.sqrt(n) / 20,
    )
    return out


@dataclass
class Projection:
    """Standardised descriptions, through a fixed random layer, with a constant."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), np.tanh(z @ self.weights + self.bias)], axis=1)


def projection(mean: np.ndarray, scale: np.ndarray, seed: int = 3) -> Projection:
    rng = np.random.default_rng(seed)
    return Projection(mean, scale + 1e-3, rng.normal(0, SPREAD / np.sqrt(FEATURES), (FEATURES, HIDDEN)), rng.normal(0, 0.5, HIDDEN))


@dataclass
class Model:
    project: Projection
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self.project(x.astype(np.float64)) @ self.weights + 1) / 2, 0, 1)


@dataclass
class Moments:
    """Number, sum and sum of products of feature rows."""

    n: float
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray) -> Moments:
        d = int(np.sqrt(len(flat)))  # 1 + d + d * d numbers
        return cls(flat[0], flat[1 : d + 1], flat[d + 1 :].reshape(d, d))

    @staticmethod
    def flat(phi: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(phi)], phi.sum(axis=0), (phi.T @ phi).ravel()])

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.first + other.first, self.second + other.second)

    @property
    def means(self) -> tuple[np.ndarray, np.ndarray]:
        return self.first / max(self.n, 1), self.second / max(self.n, 1)


def minimise(pos: Moments, unl: Moments, prior: float, steps: int = STEPS, rate: float = 0.02, decay: float = DECAY) -> np.ndarray:
    """Weights of the least non-negative risk, by Adam with a falling rate."""
    (mp, sp), (mu, su) = pos.means, unl.means
    w, m1, m2 = (np.zeros(len(mp)) for _ in range(3))
    for step in range(1, steps + 1):
        # half the sums of the gradients of E[(1 + g)^2 / 4] and E[(1 - g)^2 / 4]
        negative = (su @ w + mu) / 2 - prior * (sp @ w + mp) / 2
        excess = (1 + 2 * mu @ w + w @ su @ w) / 4 - prior * (1 + 2 * mp @ w + w @ sp @ w) / 4
        g = prior * (sp @ w - mp) / 2 + negative + decay * w if excess >= 0 else -negative
        m1 += 0.1 * (g - m1)
        m2 += 0.001 * (g * g - m2)
        w -= rate * (1 - step / steps) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-10)
    return w


def apart(pos: Moments, unl: Moments) -> np.ndarray:
    """Weights that tell positives from unlabelled rows: least squares with a ridge."""
    (mp, sp), (mu, su) = pos.means, unl.means
    return np.linalg.solve(sp + su + 1e-3 * np.eye(len(mp)), mp - mu)


def prior_of(pos: np.ndarray, unl: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives among the unlabelled rows, from both histograms of scores: the least, over thresholds, of the two shares above it."""
    n_pos, n_unl = pos.sum(), unl.sum()
    if not n_pos or not n_unl:
        return 0.5
    above_p, above_u = (h[::-1].cumsum()[::-1] / h.sum() for h in (pos, unl))
    slack = np.sqrt(np.log(4 / confidence) / 2 / n_pos) + np.sqrt(np.log(4 / confidence) / 2 / n_unl)
    ok = above_p > 0.05
    best = np.argmin((above_u[ok] + slack) / above_p[ok])
    return float(np.clip(above_u[ok][best] / above_p[ok][best], 0.05, 0.95))


def described(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, x), x the description of the row's text; written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key].to_numpy(), "x": [describe(t) for t in batch[text]]})

    return materialize(map_rows(docs, key, [text], run, "x array<float>"))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), np.float64).reshape(-1, FEATURES)


def _sums(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> dict[tuple[bool, int], np.ndarray]:
    """Sums of the vectors that `of` makes of the rows (x, half, positive), for each kind of row.

    A partition hands on one vector a kind; FAN tasks add these up, and as many vectors reach the driver.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for batch in batches:
            for kind, own in batch.groupby(["positive", "half"]):
                total[kind] = total.get(kind, 0) + of(_matrix(own["x"]))
        yield pd.DataFrame([(p, h, v) for (p, h), v in sorted(total.items())], columns=["positive", "half", "v"])

    def add(kind: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("_at")["v"]
        return pd.DataFrame([(kind[0], kind[1], np.sum(np.stack(v.to_numpy()), axis=0))], columns=["positive", "half", "v"])

    schema = "positive boolean, half int, v array<double>"
    parts = rows.mapInPandas(part, schema).withColumn("_at", F.spark_partition_id())
    added = parts.groupBy("positive", "half", (F.col("_at") % FAN).alias("_fan")).applyInPandas(add, schema)
    out: dict = {}
    for r in sorted(added.collect(), key=lambda r: (r["positive"], r["half"], r["v"])):
        kind = (r["positive"], r["half"])
        out[kind] = out.get(kind, 0) + np.array(r["v"])
    return out


def fit(rows: DataFrame, trusted: DataFrame, key: str = "doc_id") -> Model | None:
    """rows: descriptions (key, x) of unlabelled texts; trusted: the keys of positives among them. None without any positive."""
    half = F.pmod(F.xxhash64(F.lit("half"), key), F.lit(2)).cast("int").alias("half")
    unl = rows.select("x", half, F.lit(False).alias("positive"))
    pos = rows.join(trusted.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi").select("x", half, F.lit(True).alias("positive"))
    both = materialize(unl.unionByName(pos))
    sums = _sums(both.filter("not positive"), lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    if not sums:
        return None
    total = sum(sums.values())
    mean = total[1 : FEATURES + 1] / total[0]
    project = projection(mean, np.sqrt(np.maximum(total[FEATURES + 1 :] / total[0] - mean * mean, 0)))
    moments = {k: Moments.of(v) for k, v in _sums(both, lambda x: Moments.flat(project(x))).items()}
    if not any(positive for positive, _ in moments):
        return None
    none = Moments(0.0, np.zeros(HIDDEN + 1), np.zeros((HIDDEN + 1, HIDDEN + 1)))
    part = lambda positive, h: moments.get((positive, h), none)
    first = apart(part(True, 0), part(False, 0))
    bins = lambda x: np.histogram(np.clip(project(x) @ first, -2, 2), BINS, (-2, 2))[0].astype(np.float64)
    counts = _sums(both.filter("half = 1"), bins)
    prior = prior_of(counts.get((True, 1), np.zeros(BINS)), counts.get((False, 1), np.zeros(BINS)))
    return Model(project, minimise(part(True, 0) + part(True, 1), part(False, 0) + part(False, 1), prior), prior)


def score(rows: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """Rows (key, score) of descriptions (key, x)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["x"])
            yield pd.DataFrame({key: batch[key].to_numpy(), "score": model.score(x) if model else np.full(len(x), 0.5)})

    return map_rows(rows, key, ["x"], run, "score double")

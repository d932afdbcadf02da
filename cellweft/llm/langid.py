"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over fixed-length windows, each filter keeps its largest response in the window, and a
softmax over the languages follows; the network is trained in numpy (Adam, cross-entropy) on windows of labelled
texts. A text is cut into windows that overlap by the widest filter less one byte, so that no byte sequence is missed; its language is the
one with the largest mean probability, windows weighted by their bytes.

As a convolution of embedded bytes is linear before the maximum, the filters are folded into tables over byte pairs for
prediction: the same responses, by lookup.

Texts that are null or hold no letter are "und" with score 0, as is everything if no labelled text was given. Training takes at most
`MAX_DOCS` labelled texts with different keys, chosen by hash, and cuts them whole: of all their windows, `MAX_WINDOWS` are drawn by hash, wherever they
lie. Of rows that share a key, one is learned from. Prediction reads whole texts. Other columns pass through; repeated rows each get
their prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import materialize

UNDETERMINED = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
WIDEST = max(WIDTHS)
STRIDE = WINDOW - WIDEST + 1
#: Bounds of the training sample.
MAX_DOCS = 2000
MAX_WINDOWS = 16_000
#: Passes over the sample, and steps at least.
EPOCHS = 4
BATCH = 128
LEAST_STEPS = 400
#: Windows evaluated at a time.
BLOCK = 96


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # per width: width x EMBEDDING x FILTERS
    bias: np.ndarray  # all filters
    weights: np.ndarray  # all filters x languages
    offset: np.ndarray  # languages

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of the first two bytes (all filters) and of the next two (those wider than 2), by byte pair."""
        e = self.embedding
        taps = [[e @ w[j] for j in range(len(w))] for w in self.filters]
        first = np.concatenate([t[0][:, None, :] + t[1][None, :, :] for t in taps], axis=2)
        second = [t[2][:, None, :] + (t[3][None, :, :] if len(t) > 3 else np.zeros((1, 256, FILTERS), np.float32)) for t in taps if len(t) > 2]
        return first.reshape(65536, -1).astype(np.float32), np.concatenate(np.broadcast_arrays(*second), axis=2).reshape(65536, -1).astype(np.float32)


def responses(windows: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """windows x positions x filters, from bytes: position i sees bytes i to i + 3."""
    pairs = (windows[:, :-1].astype(np.intp) << 8) | windows[:, 1:]
    out = first.take(pairs[:, :-2], axis=0)
    out[:, :, FILTERS:] += second.take(pairs[:, 2:], axis=0)
    return out


def probabilities(net: Network, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.empty((len(windows), len(net.languages)), np.float32)
    for a in range(0, len(windows), BLOCK):
        pooled = np.maximum(responses(windows[a : a + BLOCK], *tables).max(axis=1) + net.bias, 0)
        logits = pooled @ net.weights + net.offset
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        out[a : a + BLOCK] = e / e.sum(axis=1, keepdims=True)
    return out


def convolve(net: Network, windows: np.ndarray) -> np.ndarray:
    """The same responses without tables: embedded bytes through every tap of every filter, summed along the taps."""
    taps = np.concatenate([w[j] for w in net.filters for j in range(len(w))], axis=1)
    each = (net.embedding @ taps)[windows].reshape(*windows.shape, -1, FILTERS)
    n, out, at = windows.shape[1] - WIDEST + 1, [], 0
    for w in net.filters:
        out.append(sum(each[:, j : j + n, at + j] for j in range(len(w))))
        at += len(w)
    return np.concatenate(out, axis=2)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7, epochs: int = EPOCHS, rate: float = 4e-3) -> Network:
    """Adam on the cross-entropy; the maximum passes its gradient to the position that won."""
    rng = np.random.default_rng(seed)
    k, n_filters = len(languages), FILTERS * len(WIDTHS)
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n_filters, np.float32),
        rng.normal(0, 0.2, (n_filters, k)).astype(np.float32),
        np.zeros(k, np.float32),
    )
    params = [net.embedding, *net.filters, net.bias, net.weights, net.offset]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // len(windows)))):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            x, y = windows[order[a : a + BATCH]], labels[order[a : a + BATCH]]
            r = convolve(net, x)
            at = r.argmax(axis=1)  # windows x filters
            pre = np.take_along_axis(r, at[:, None, :], axis=1)[:, 0] + net.bias
            pooled = np.maximum(pre, 0)
            logits = pooled @ net.weights + net.offset
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            g = e / e.sum(axis=1, keepdims=True)
            g[np.arange(len(y)), y] -= 1
            g /= len(y)
            back = (g @ net.weights.T) * (pre > 0)
            d_embedding, d_filters = np.zeros_like(net.embedding), []
            for i, w in enumerate(net.filters):
                own = slice(i * FILTERS, (i + 1) * FILTERS)
                gw, d_w = back[:, own], np.zeros_like(w)
                for j in range(len(w)):
                    seen = x[np.arange(len(x))[:, None], at[:, own] + j]
                    d_w[j] = np.einsum("nfd,nf->df", net.embedding[seen], gw, optimize=True)
                    np.add.at(d_embedding, seen.ravel(), (gw[:, :, None] * w[j].T[None]).reshape(-1, EMBEDDING))
                d_filters.append(d_w)
            grads = [d_embedding, *d_filters, back.sum(0), pooled.T @ g, g.sum(0)]
            step += 1
            for p, d, u, v in zip(params, grads, m1, m2, strict=True):
                u += 0.1 * (d - u)
                v += 0.01 * (d * d - v)
                p -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (bytes after the end are 0), the text of each, and the bytes of it that are new."""
    sizes = np.array([max(len(t), 1) for t in texts], np.int64)
    n = -(-sizes // STRIDE)
    padded = n * STRIDE + WIDEST - 1
    flat = np.zeros(int(padded.sum()) + WINDOW, np.uint8)
    begin = np.concatenate([[0], np.cumsum(padded)[:-1]])
    for t, at in zip(texts, begin.tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), n)
    local = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    starts = begin[owner] + local * STRIDE
    fresh = np.minimum(sizes[owner] - local * STRIDE, STRIDE)
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[starts], owner, fresh


def sample_windows(docs: DataFrame, key: str, text: str, label: str, max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS) -> pd.DataFrame:
    """Windows of labelled texts: columns label, window (bytes). Bounded by both limits, whatever the texts and however often a key is repeated."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(key, F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(F.lit("langid"), key).alias("_h"))
    # about twice as many keys as are wanted pass, so that neither all keys nor all copies of one are sorted
    keys = rows.select(F.approx_count_distinct(key, 0.02)).first()[0]
    span = 1 << 30
    few = rows.filter(F.pmod("_h", F.lit(span)) < int(span * min(1.0, 2 * max_docs / max(keys, 1))))
    chosen = few.select(key, "_h").distinct().orderBy("_h", key).limit(max_docs)
    texts = few.join(F.broadcast(chosen.select(key)), key).groupBy(key).agg(F.min(F.struct("label", "text")).alias("_one")).select(key, "_one.*")
    texts = materialize(texts.select(key, "label", F.encode("text", "utf-8").alias("_raw")))
    n = F.ceil(F.greatest(F.octet_length("_raw"), F.lit(1)) / STRIDE).cast("int")
    at = texts.select(key, "label", "_raw", F.explode(F.sequence(F.lit(0), n - 1)).alias("_k"))
    # windows, not texts, go into the order
    window = F.substring(F.col("_raw"), F.col("_k") * STRIDE + 1, F.lit(WINDOW))
    rows = at.select(key, "label", "_k", F.xxhash64("_k", key).alias("_at"), window.alias("window"))
    return rows.orderBy("_at", key, "_k").limit(max_windows).select("label", "window").toPandas()


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", max_docs: int = MAX_DOCS) -> Network | None:
    """Train on the labelled rows of docs; None if there are none with a letter."""
    rows = sample_windows(docs, key, text, label, max_docs)
    rows = rows[[any(map(str.isalpha, bytes(w).decode("utf-8", "ignore"))) for w in rows["window"]]]
    if rows.empty:
        return None
    languages = sorted(rows["label"].unique())
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for i, w in enumerate(rows["window"]):
        windows[i, : len(w)] = np.frombuffer(bytes(w), np.uint8)
    return train(windows, rows["label"].map({v: i for i, v in enumerate(languages)}).to_numpy(), languages)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs plus lang_pred and score; the other columns stay outside Python."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = net.tables() if net else None
        for batch in batches:
            lang = np.full(len(batch), UNDETERMINED, object)
            score = np.zeros(len(batch))
            rows = np.flatnonzero(batch.notna().to_numpy()) if net else np.array([], np.int64)
            for part in _by_bytes(batch, rows):
                windows, owner, fresh = cut([batch.iat[i].encode("utf-8", "surrogatepass") for i in part])
                p = probabilities(net, windows, tables).astype(np.float64) * fresh[:, None]
                first = np.searchsorted(owner, np.arange(len(part)))
                mean = np.add.reduceat(p, first, axis=0) / np.add.reduceat(fresh, first)[:, None]
                best = mean.argmax(axis=1)
                lang[part] = np.array(net.languages, object)[best]
                score[part] = np.clip(mean[np.arange(len(part)), best], 0, 1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    found = docs.withColumn("_found", run(F.when(has_letter(F.col(text)), F.col(text))))
    return found.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def _by_bytes(texts: pd.Series, rows: np.ndarray, most: int = 1 << 21) -> Iterator[np.ndarray]:
    """Rows in runs of about `most` characters, so that the windows of a run stay small; a longer text is a run of its own."""
    at, total = 0, 0
    for k, i in enumerate(rows):
        n = len(texts.iat[i])
        if k > at and total + n > most:
            yield rows[at:k]
            at, total = k, 0
        total += n
    if at < len(rows):
        yield rows[at:]

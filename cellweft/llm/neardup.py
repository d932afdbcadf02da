"""Near-duplicate detection with BagMinHash signatures.

A text is the multiset of its five-word shingles (words: runs of letters and digits, lower case; a text of fewer words is one
shingle). BagMinHash: the weight axis of every shingle is discretised into units and covered by dyadic bands (0, 1], (1, 2],
(2, 4], ...; each band carries a Poisson process whose rate is its width, and each of its points is handed down by fair bits to one
unit. A text of weight w takes the points of the units below w; register i keeps its earliest point. Two registers agree with
the probability of the weighted Jaccard similarity. Points are only drawn up to a time by which all registers are likely to be filled, which
makes the work per shingle one draw and a comparison; texts with a register left open are drawn again for longer.

Registers are banded; texts that share a band are candidates, and candidates are verified by the exact multiset overlap. Texts with
equal multisets are one node from the start. Buckets of few nodes pair all of theirs; in larger ones everything is compared with
the bucket's centre first, in hot ones with the centre of a part of the bucket, and the centres with one another's least. Where different classes still
meet in such a bucket, what is outside its commonest class is compared with everything in it, block against block, exactly, each pair in the first band
that it shares; a block hands on as many links as join its classes, not all pairs. Classes are the connected components of verified links.

Null and empty texts and rows without a key are classes of their own; texts without a word are grouped if equal; repeated rows share a
class, and rows that share a key but not the text are told apart; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import compact, hot_limit, join_unique, map_rows, materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Buckets up to this size pair all their nodes at once.
SMALL = 8
#: Nodes of one side in a block of the last comparison, and different elements that are compared at a time.
BLOCK = 512
COLUMNS = 4096
#: Bytes of an element: two different shingles of a pair of thousand-word texts meet by chance once in 10**8 pairs.
ELEMENT = 6

_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_LETTER = np.array([0 if not (chr(b).isalnum() or b >= 128) else 1 for b in range(256)], bool)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser."""
    x = x + _U(salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(256, dtype=_U), 99)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, _U)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=_U)
    return _POWERS["up"], _POWERS["down"]


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of all texts, sorted by both."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    up, down = _powers(len(raw) + 1)
    inside = _LETTER[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    prefix = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=prefix[1:])
    word = mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(_U))
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.searchsorted(np.cumsum(sizes), start, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    left = n_words[owner] - (np.arange(len(word)) - first[owner])  # words from here to the end of the text
    length = np.minimum(SHINGLE, n_words[owner])
    at = np.flatnonzero(left >= length)
    h = np.zeros(len(at), _U)
    padded = np.concatenate([word, np.zeros(SHINGLE, _U)])
    for j in range(SHINGLE):
        h = mix(h + np.where(j < length[at], padded[at + j], _U(0)), j)
    doc = owner[at]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    where = np.flatnonzero(new)
    return doc[where], h[where], np.diff(np.append(where, len(doc)))


def _points(doc: np.ndarray, x: np.ndarray, count: np.ndarray, until: np.ndarray, out: np.ndarray) -> None:
    """Lay the points up to each text's time into out (texts x registers), by minimum."""
    band = 0
    while len(doc):
        low = 0 if band == 0 else 1 << (band - 1)
        width = 1 if band == 0 else 1 << (band - 1)
        seed = mix(x, 1000 + band)
        d, c, t = doc, count, np.zeros(len(doc))
        k = 0
        while len(d):
            r = mix(seed, 2 * k)
            t = t - np.log(((r >> _U(11)).astype(np.float64) + 0.5) / 2.0**53) / width
            keep = t <= until[d]
            d, c, t, seed = d[keep], c[keep], t[keep], seed[keep]
            r = mix(seed, 2 * k + 1)
            register = ((r & _U(0xFFFFFFFF)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
            # one bit of the hash for every halving of the band
            unit = low + ((r >> _U(32)) & _U(width - 1)).astype(np.int64)
            mine = unit < c
            np.minimum.at(out, (d[mine], register[mine]), t[mine])
            k += 1
        band += 1
        more = count > (1 << (band - 1))
        doc, x, count = doc[more], x[more], count[more]


def signatures(n_texts: int, doc: np.ndarray, x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """texts x registers of 32-bit values; texts without a shingle stay 0."""
    weight = np.bincount(doc, count, n_texts)
    times = np.full((n_texts, REGISTERS), np.inf)
    factor = np.log(REGISTERS) + 3.0
    todo = weight > 0
    while todo.any():
        times[todo] = np.inf
        pick = todo[doc]
        until = np.where(weight > 0, REGISTERS * factor / np.maximum(weight, 1), 0)
        _points(doc[pick], x[pick], count[pick], until, times)
        todo = todo & np.isinf(times).any(axis=1)
        factor *= 2
    times[np.isinf(times)] = 0
    return (mix(times.view(_U)) >> _U(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """texts x bands of 64-bit keys; the band is part of the key."""
    out = np.zeros((len(signature), BANDS), _U)
    for r in range(ROWS):
        out = mix(out + signature[:, r::ROWS][:, :BANDS].astype(_U), 7 + r)
    return mix(out + np.arange(BANDS, dtype=_U), 77).view(np.int64)


def elements(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A multiset as a set: the k-th occurrence of a shingle is an element of its own. Sorted values of ELEMENT bytes."""
    rep = np.repeat(x, count)
    k = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
    return np.unique(mix(rep + k.astype(_U) * _U(_BASE)) >> _U(64 - 8 * ELEMENT))


def packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ELEMENT].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // ELEMENT, 8), np.uint8)
    out[:, :ELEMENT] = np.frombuffer(raw, np.uint8).reshape(-1, ELEMENT)
    return out.view("<u8").ravel()


def _runs(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at, total = 0, 0
    for k, t in enumerate(texts):
        if k > at and total + len(t) > most:
            yield at, k
            at, total = k, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


def _encode(values: pd.Series) -> list[bytes]:
    return [v.lower().encode("utf-8", "surrogatepass") if isinstance(v, str) else b"" for v in values]


def describe(texts: list[bytes], sign_them: bool = True) -> Iterator[tuple[bytes, int, np.ndarray | None, np.ndarray, np.ndarray]]:
    """(content, weight, band keys, elements, signature) of each text; equal multisets have equal content. Signatures may be left out."""
    for a, b in _runs(texts):
        doc, x, count = shingles(texts[a:b])
        sig = signatures(b - a, doc, x, count) if sign_them else np.zeros((b - a, REGISTERS), np.uint32)
        keys = band_keys(sig)
        cuts = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            own = slice(cuts[i], cuts[i + 1])
            if own.start == own.stop:
                yield hashlib.md5(b"no word" + texts[a + i]).digest(), 0, None, np.zeros(0, _U), sig[i]
            else:
                yield hashlib.md5(x[own].tobytes() + count[own].tobytes()).digest(), int(count[own].sum()), keys[i], elements(x[own], count[own]), sig[i]


def sign(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, tid, node, n, keys); tid is the text's digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _encode(batch[text])
            # copies within a batch are signed once
            place = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            got = list((d[0], d[1], None if d[2] is None else d[2].tolist()) for d in describe(list(place)))
            rows = [got[place[t]] for t in texts]
            yield pd.DataFrame({key: batch[key].to_numpy(), "tid": batch["tid"].to_numpy(), "node": [r[0] for r in rows], "n": [r[1] for r in rows], "keys": [r[2] for r in rows]})

    return map_rows(docs, key, ["tid", text], run, "tid binary, node binary, n long, keys array<long>")


def gather_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (node, elements), one for each different node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(d[0], packed(d[3])) for d in describe(_encode(batch[text]), sign_them=False)], columns=["node", "elements"])

    return docs.select(text).mapInPandas(run, "node binary, elements binary").groupBy("node").agg(F.first("elements").alias("elements"))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / max(len(both) - common, 1)


def verify(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by the threshold."""
    one = lambda c: sets.select(F.col("node").alias(c), F.col("elements").alias(f"_{c}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [overlap(unpacked(x), unpacked(y)) >= threshold for x, y in zip(batch["_a"], batch["_b"], strict=True)]
            yield batch.loc[ok, ["a", "b"]]

    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "_a", "_b").mapInPandas(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label): the least node of each connected component, for nodes with a link.

    Every node takes the least label among itself and its neighbours, then its label's label, until nothing changes.
    """
    links = links.filter(F.col("a") != F.col("b")).distinct()
    both, parts = compact(links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select(F.col("b"), F.col("a"))))
    labels = materialize(both.groupBy("node").agg(F.min("to").alias("label")).select("node", F.least("node", "label").alias("label")).coalesce(parts))
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), "label"), "to").coalesce(parts).groupBy("node").agg(F.min("label").alias("_near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "_near").alias("_l")).coalesce(parts)
        jump = labels.select(F.col("node").alias("_l"), F.col("label").alias("_j"))
        step = materialize(step.join(jump, "_l", "left").select("node", F.col("label").alias("_old"), F.least("_l", F.coalesce("_j", "_l")).alias("label")).coalesce(parts))
        changed = step.filter(F.col("label") != F.col("_old")).limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _close_in_size(threshold: float):  # noqa: ANN202
    return F.least("_na", "_nb") >= threshold * F.greatest("_na", "_nb")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of elements that the sets of one side share with those of the other."""
    both = left + right
    values = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(v) for v in both])
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    column = np.full(len(count), -1)
    column[shared] = np.arange(len(shared))
    at = column[inverse]
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(0, len(shared) + COLUMNS, COLUMNS))
    common = np.zeros((len(left), len(right)), np.float32)
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = order[a:b]
        if len(part):
            m = np.zeros((len(both), COLUMNS), np.float32)
            m[owner[part], at[part] % COLUMNS] = 1
            common += m[: len(left)] @ m[len(left) :].T
    return common


def similar(left: list[np.ndarray], right: list[np.ndarray], asked: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the asked pairs overlap by the threshold. Few pairs are compared one by one, many through the elements that sets share."""
    out = np.zeros(asked.shape, bool)
    rows, cols = np.flatnonzero(asked.any(axis=1)), np.flatnonzero(asked.any(axis=0))
    if np.count_nonzero(asked) <= 2 * (len(rows) + len(cols)):
        for i, j in zip(*np.nonzero(asked), strict=True):
            out[i, j] = overlap(left[i], right[j]) >= threshold
        return out
    a, b = [left[i] for i in rows], [right[j] for j in cols]
    common = _common(a, b)
    total = np.array([len(v) for v in a], np.float32)[:, None] + np.array([len(v) for v in b], np.float32)[None] - common
    out[np.ix_(rows, cols)] = common >= (threshold - 1e-6) * np.maximum(total, 1)
    return out & asked


def _joining(close: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Of the close pairs of different labels, as many as join the labels."""
    parent = list(range(int(label.max()) + 1))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(close), strict=True):
        a, b = find(int(label[left[i]])), find(int(label[right[j]]))
        if a != b:
            parent[a] = b
            out.append((int(left[i]), int(right[j])))
    return out


def _mixed(members: DataFrame) -> DataFrame:
    """(key, _main, _others, _insiders) of the buckets in which nodes of different labels meet: the commonest label, and the nodes without and with it."""
    each = members.select("key", "label").groupBy("key", "label").agg(F.count(F.lit(1)).alias("_n"))
    top = F.max(F.struct("_n", "label"))
    info = each.groupBy("key").agg(F.count(F.lit(1)).alias("_labels"), top.alias("_top"), F.sum("_n").alias("_all")).filter("_labels > 1")
    return info.select("key", F.col("_top.label").alias("_main"), (F.col("_all") - F.col("_top._n")).alias("_others"), F.col("_top._n").alias("_insiders"))


def _rest(members: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, hot: DataFrame, threshold: float) -> DataFrame | None:
    """Links (a, b) that join the different labels of a bucket; None if no two meet.

    Nodes outside the bucket's commonest label (others) are compared among themselves and with those inside it, which need no comparison among
    themselves; both sides are dealt into blocks, and a pair of blocks is a task of bounded size. A pair is compared in the first band
    that it shares, if its sizes allow the threshold at all.
    """
    named = materialize(members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    mixed = materialize(_mixed(named))
    if not mixed.limit(1).count():
        return None
    apart = join_unique(named, mixed, "key", hot).withColumn("_inside", F.col("label") == F.col("_main"))
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    placed = apart.withColumns({"_bo": blocks("_others"), "_bi": blocks("_insiders")})
    own = F.pmod(F.xxhash64("node"), F.when(F.col("_inside"), F.col("_bi")).otherwise(F.col("_bo"))).cast("int")
    placed = placed.withColumn("_own", own)

    def place(inside: bool, lo: Column, hi: Column, second: Column) -> Column:
        return F.struct(F.lit(inside).alias("inside"), lo.alias("lo"), hi.alias("hi"), second.alias("second"))

    others = F.sequence(F.lit(0), F.col("_bo") - 1)
    at_others = F.transform(others, lambda j: place(False, F.least(F.col("_own"), j), F.greatest(F.col("_own"), j), F.col("_own") > j))
    at_insiders = F.transform(F.sequence(F.lit(0), F.col("_bi") - 1), lambda j: place(True, F.col("_own"), j, F.lit(False)))
    insider = F.transform(others, lambda j: place(True, j, F.col("_own"), F.lit(True)))
    placed = placed.withColumn("_at", F.explode(F.when(F.col("_inside"), insider).otherwise(F.concat(at_others, at_insiders))))
    placed = placed.select("key", "_at.*", "node", "label").join(sets.join(nodes.select("node", "n", "keys"), "node"), "node")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        second = pdf["second"].to_numpy()
        alone = not key[1] and key[2] == key[3]
        left = np.flatnonzero(~second)
        right = left if alone else np.flatnonzero(second)
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["a", "b"])
        label, n, keys = pdf["label"].factorize()[0], pdf["n"].to_numpy(), np.stack(pdf["keys"].to_numpy())
        asked = label[left][:, None] != label[right][None]
        asked &= np.minimum(n[left][:, None], n[right][None]) >= threshold * np.maximum(n[left][:, None], n[right][None])
        for band in range(int(np.flatnonzero(keys[0] == key[0])[0])):
            asked &= keys[left, band][:, None] != keys[right, band][None]
        if alone:
            asked = np.triu(asked)
        sets_of = lambda rows, wanted: [unpacked(pdf["elements"].iat[k]) if w else np.zeros(0, _U) for k, w in zip(rows, wanted, strict=True)]
        close = similar(sets_of(left, asked.any(axis=1)), sets_of(right, asked.any(axis=0)), asked, threshold)
        nodes = pdf["node"].to_numpy()
        return pd.DataFrame([(nodes[i], nodes[j]) for i, j in _joining(close, left, right, label)], columns=["a", "b"])

    found = placed.groupBy("key", "inside", "lo", "hi").applyInPandas(run, "a binary, b binary")
    return found.select(*_ordered("a", "b")).distinct()


def _usable(key: str, text: str) -> Column:
    return F.col(key).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)


def _labelled(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """Rows (key, tid, label) of the usable rows of docs (key, tid, text): rows of a class share a label."""
    spark = docs.sparkSession
    signed = materialize(sign(docs, key, text))
    nodes = materialize(
        signed.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.min(key).alias("_first"), F.count(F.lit(1)).alias("_copies"))
    )
    documents, with_words = nodes.agg(F.sum("_copies"), F.count_if(F.col("keys").isNotNull())).first()
    limit = hot_limit(spark, with_words * BANDS)
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    buckets = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_size"), F.min("node").alias("_centre")).filter("_size > 1"))
    hot = buckets.filter(F.col("_size") > limit)
    members, _ = compact(join_unique(rows, buckets, "key", hot))

    wanted = members.select("node").distinct().join(nodes.select("node", "_first"), "node").select(F.col("_first").alias(key)).distinct()
    sets, _ = compact(gather_sets(docs.join(wanted, key), key, text), 5_000)

    side = lambda c: members.filter(F.col("_size") <= SMALL).select("key", F.col("node").alias(f"_{c}"), F.col("n").alias(f"_n{c}"))
    small = side("a").join(side("b"), "key").filter((F.col("_a") < F.col("_b")) & _close_in_size(threshold)).select(*_ordered("_a", "_b"))
    large = members.filter(F.col("_size") > SMALL)
    # a hot bucket falls into parts of a bounded number of nodes, each with a centre
    parted = large.filter(F.col("_size") > limit).withColumn("_part", F.pmod(F.xxhash64("node"), F.ceil(F.col("_size") / limit)))
    centres = parted.groupBy("key", "_part").agg(F.min("node").alias("_of_part"), F.first("_centre").alias("_centre"))
    star = (
        large.filter(F.col("_size") <= limit).select("node", "_centre")
        .union(parted.join(centres.drop("_centre"), ["key", "_part"]).select("node", "_of_part"))
        .union(centres.select("_of_part", "_centre"))
    )
    star = star.filter(F.col("node") != F.col("_centre")).select(*_ordered("node", "_centre"))
    links, _ = compact(verify(small.union(star).distinct(), sets, threshold))
    labels = components(links)
    found = _rest(large, labels, nodes, sets, hot, threshold)
    if found is not None:
        found, _ = compact(found)
        if found.limit(1).count():
            labels = components(links.union(found))
    copied = nodes.filter(F.col("_copies") > hot_limit(spark, documents or 0))
    named = join_unique(signed.select(key, "tid", "node"), labels, "node", copied, "left")
    return materialize(named.select(key, "tid", F.coalesce("label", "node").alias("label")))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, class_id): the least key among the documents joined by links of the threshold or more, one row a document."""
    docs = docs.select(key, text)
    alone = docs.filter(~_usable(key, text)).select(key, F.col(key).alias("class_id"))
    named = _labelled(docs.filter(_usable(key, text)).select(key, _digest(text).alias("tid"), text), key, text, threshold)
    first = materialize(named.groupBy("label").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("_n")))
    hot = first.filter(F.col("_n") > hot_limit(docs.sparkSession, first.agg(F.sum("_n")).first()[0] or 0))
    return join_unique(named, first.drop("_n"), "label", hot).select(key, "class_id").unionByName(alone)


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class: the one with the least key (of several texts under that key, the one with the least digest), once.

    Of rows that repeat a key and a text, the one with the least hash of all columns stays. Rows without a key stay; rows without a text stay once a key.
    """
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(*hashed).alias("_hash"), key, _digest(text).alias("tid"), text)
    own = rows.filter(_usable(key, text))
    least = _labelled(own.select(key, "tid", text), key, text, threshold).groupBy("label").agg(F.min(F.struct(key, "tid")).alias("_least"))
    once = lambda df: df.groupBy(key, "tid").agg(F.min_by("_row", "_hash").alias("_row")).select("_row.*")
    kept = once(own.join(least.select("_least.*"), [key, "tid"], "left_semi"))
    without = rows.filter(F.col(key).isNotNull() & ~_usable(key, text))
    return kept.unionByName(once(without)).unionByName(docs.filter(F.col(key).isNull()))

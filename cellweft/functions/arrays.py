"""Column expressions over feature arrays. All stay in the JVM; a null element makes a sum null unless stated."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once for a row; inside a lambda, an expression is else computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def scaled(a: Column, factor: Column) -> Column:
    return let(factor, lambda k: F.transform(a, lambda x: x * k))


def centred(a: Column) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: x - m))


def pearson(a: Column, b: Column, offset: float = 0.0) -> Column:
    """Correlation of two rows; offset is added to the denominator."""
    both = lambda x, y: dot(x, y) / (F.sqrt(dot(x, x) * dot(y, y)) + F.lit(float(offset)))
    return let(centred(a), lambda x: let(centred(b), lambda y: both(x, y)))


def pearson_skipping(a: Column, b: Column) -> Column:
    """Correlation over the positions where neither is null or NaN."""
    ok = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    return pearson(F.transform(ok, lambda p: p["x"]), F.transform(ok, lambda p: p["y"]))


def ordinal_ranks(a: Column) -> Column:
    """0-based ranks, ties by position."""
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    order = F.transform(F.array_sort(pairs), lambda p: p["i"])
    return let(order, lambda o: F.transform(a, lambda _, i: F.array_position(o, i).cast("int") - 1))


def spearman(a: Column, b: Column) -> Column:
    return pearson(F.transform(ordinal_ranks(a), lambda r: r.cast("double")), F.transform(ordinal_ranks(b), lambda r: r.cast("double")))


def median(a: Column) -> Column:
    """Interpolating median of a row."""
    n = F.size(a)
    at = lambda s, k: F.element_at(s, k.cast("int"))
    return let(F.array_sort(a), lambda s: (at(s, F.floor((n + 1) / 2)) + at(s, F.floor(n / 2) + 1)) / 2)


def argmax(a: Column) -> Column:
    """0-based position of the first maximum."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def entropy(p: Column) -> Column:
    """Shannon entropy of shares, base 2; zero shares add nothing."""
    return total(F.transform(p, lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(F.lit(0.0))))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Jensen-Shannon divergence of two share rows, base 2."""
    mid = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    return entropy(mid) - (entropy(a) + entropy(b)) / 2


def ring_mean(values: Column, weights: list[float]) -> Column:
    """Weighted mean over the non-null values, weights renormalised over them."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    zipped = F.arrays_zip(values.alias("v"), w.alias("w"))
    ok = F.filter(zipped, lambda p: p["v"].isNotNull() & ~F.isnan(p["v"]) & p["w"].isNotNull())
    return total(F.transform(ok, lambda p: p["v"] * p["w"])) / total(F.transform(ok, lambda p: p["w"]))


def constant(value: object, kind: str) -> Column:
    """A nested constant, through one literal; the optimiser parses it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def literal(values: list[float]) -> Column:
    """Constant array; NaN and None become null."""
    return constant([None if v is None or math.isnan(v) else float(v) for v in values], "array<double>")


def piecewise(xs: list[list[float]], ys: list[list[float]]) -> Column:
    """Piecewise linear maps through (xs, ys), ascending, one a feature, as a constant; equal neighbouring xs are stepped over."""
    out = []
    for x, y in zip(xs, ys, strict=True):
        pts = [(a, b) for i, (a, b) in enumerate(zip(x, y, strict=True)) if i == 0 or a > x[i - 1]]
        pts = pts if len(pts) > 1 else [pts[0], (pts[0][0] + 1, pts[0][1] + 1)]
        each = list(zip(pts, pts[1:], strict=False))
        out.append({"inner": [p[0] for p in pts[1:-1]], "x": [p[0] for p, _ in each], "y": [p[1] for p, _ in each], "k": [(q[1] - p[1]) / (q[0] - p[0]) for p, q in each]})
    return constant(out, "array<struct<inner:array<double>,x:array<double>,y:array<double>,k:array<double>>>")


def mapped(x: Column, table: Column) -> Column:
    """x through one map of piecewise, continued beyond both ends."""
    at = F.size(F.filter(table["inner"], lambda t: t < x)) + 1
    return let(at, lambda k: F.element_at(table["y"], k) + (x - F.element_at(table["x"], k)) * F.element_at(table["k"], k))

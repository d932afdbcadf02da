"""Scalar helpers: sequences, colours, coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.greatest(F.least(x, hi), lo)


# sequences


def gc_fraction(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, "GCgc", ""))) / F.length(seq)


def base_count(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


# Unified nearest-neighbour parameters (SantaLucia 1998): kcal/mol and cal/(mol K) of each step.
NEAREST_NEIGHBOUR = {
    "AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9),
}
END_AT = (2.3, 4.1)
END_GC = (0.1, -2.8)


def _steps() -> dict[str, tuple[float, float]]:
    flip = str.maketrans("ACGT", "TGCA")
    return NEAREST_NEIGHBOUR | {k[::-1].translate(flip): v for k, v in NEAREST_NEIGHBOUR.items()}


def melting_temperature(seq: Column, sodium_mm: float = 390.0, strand_nm: float = 25.0, formamide_percent: float = 0.0) -> Column:
    """Nearest-neighbour melting temperature in degrees Celsius, with an entropy correction for salt and 0.65 degrees a percent of formamide."""
    table = _steps()
    pairs = F.transform(F.sequence(F.lit(1), F.length(seq) - 1), lambda i: F.substring(seq, i, F.lit(2)))
    lookup = [F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v[j]))]) for j in (0, 1)]

    def summed(table: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.coalesce(table[p], F.lit(0.0)))

    h, s = map(summed, lookup)
    for end in (F.substring(seq, 1, 1), F.substring(seq, -1, 1)):
        at = end.isin("A", "T")
        h = h + F.when(at, END_AT[0]).otherwise(END_GC[0])
        s = s + F.when(at, END_AT[1]).otherwise(END_GC[1])
    s = s + 0.368 * (F.length(seq) - 1) * math.log(sodium_mm / 1000)
    k = strand_nm * 1e-9 / 4
    return 1000 * h / (s + 1.987 * math.log(k)) - 273.15 - 0.65 * formamide_percent


def best_slide(a: Column, b: Column) -> Column:
    """Most equal letters over all alignments of two equally long sequences."""
    n = F.length(a)

    def at(shift: Column) -> Column:
        start, stop = F.greatest(F.lit(0), shift), F.least(n, n + shift)
        hits = F.transform(F.sequence(start, stop - 1), lambda i: (F.substring(a, i + 1, F.lit(1)) == F.substring(b, i - shift + 1, F.lit(1))).cast("int"))
        return F.aggregate(hits, F.lit(0), lambda s, x: s + x)

    return F.array_max(F.transform(F.sequence(1 - n, n - 1), at))


def binding_group(name: Column) -> Column:
    """single, self-bind or cross-bind of a complex named a, a+a or a+b."""
    parts = F.split(name, r"\+")
    return F.when(F.size(parts) == 1, "single").when(F.element_at(parts, 1) == F.element_at(parts, 2), "self-bind").otherwise("cross-bind")


def fixed_fields(seq: Column, breaks: list[int], names: list[str], reverse_strand: bool = False) -> list[Column]:
    """Substrings between breakpoints; of the reverse complement on request."""
    s = reverse_complement(seq) if reverse_strand else seq
    return [F.substring(s, a + 1, b - a).alias(n) for a, b, n in zip(breaks, breaks[1:], names, strict=False)]


# colours


def hex_channel(colour: Column, k: int) -> Column:
    """Channel k (0 to 2) of #RRGGBB as a share of 255."""
    return F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("double") / 255


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0") for c in (r, g, b)])


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (D65) of sRGB shares."""
    lin = [F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, 2.4)).otherwise(c / 12.92) for c in (r, g, b)]
    rows = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
    white = (0.95047, 1.0, 1.08883)
    xyz = [sum((c * w for c, w in zip(lin[1:], m[1:], strict=True)), lin[0] * m[0]) / s for m, s in zip(rows, white, strict=True)]
    f = [F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116) for t in xyz]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def srgb(l: Column, a: Column, b: Column) -> list[Column]:  # noqa: E741
    """sRGB shares of CIE L*a*b* (D65), clipped to [0, 1]."""
    fy = (l + 16) / 116
    f = (fy + a / 500, fy, fy - b / 200)
    white = (0.95047, 1.0, 1.08883)
    xyz = [F.when(t > 0.2068966, t * t * t).otherwise((t - 16 / 116) / 7.787) * w for t, w in zip(f, white, strict=True)]
    rows = ((3.24048134, -1.53715152, -0.49853633), (-0.96925495, 1.87599, 0.04155593), (0.05564664, -0.20404134, 1.05731107))
    lin = [xyz[0] * m[0] + xyz[1] * m[1] + xyz[2] * m[2] for m in rows]
    return [clip(F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, F.lit(0.0)), 1 / 2.4) - 0.055).otherwise(12.92 * c), 0, 1) for c in lin]


def delta_e_1976(first: tuple[Column, Column, Column], second: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(first[1:], second[1:], strict=True)), (first[0] - second[0]) * (first[0] - second[0])))


def delta_e_2000(first: tuple[Column, Column, Column], second: tuple[Column, Column, Column]) -> Column:
    """CIEDE2000 difference of two L*a*b* colours, unit weights."""
    (l1, a1, b1), (l2, a2, b2) = first, second
    chroma = (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2
    g = 0.5 * (1 - F.sqrt(F.pow(chroma, 7) / (F.pow(chroma, 7) + 25.0**7)))
    p1, p2 = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = F.sqrt(p1 * p1 + b1 * b1), F.sqrt(p2 * p2 + b2 * b2)
    hue = lambda b, a: F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    h1, h2 = hue(b1, p1), hue(b2, p2)
    grey = (c1 * c2) == 0
    turn = h2 - h1
    turn = F.when(grey, F.lit(0.0)).when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
    d_hue = 2 * F.sqrt(c1 * c2) * F.sin(F.radians(turn / 2))
    light, sat = (l1 + l2) / 2, (c1 + c2) / 2
    total = h1 + h2
    mean = F.when(grey, total).when(F.abs(h1 - h2) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
    cos = lambda k, off: F.cos(F.radians(mean * k + off))
    t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63)
    off = (light - 50) * (light - 50)
    sl, sc, sh = 1 + 0.015 * off / F.sqrt(20 + off), 1 + 0.045 * sat, 1 + 0.015 * sat * t
    around = (mean - 275) / 25
    turned = -2 * F.sqrt(F.pow(sat, 7) / (F.pow(sat, 7) + 25.0**7)) * F.sin(F.radians(60 * F.exp(-around * around)))
    x, y, z = (l2 - l1) / sl, (c2 - c1) / sc, d_hue / sh
    return F.sqrt(x * x + y * y + z * z + turned * y * z)


# coordinates


def rotated(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return x * c - y * s, x * s + y * c


def side_of_line(x: Column, y: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """True on the left of the line from a to b."""
    return (F.lit(b[0] - a[0]) * (y - a[1]) - F.lit(b[1] - a[1]) * (x - a[0])) > 0


def voxel_index(value: Column, resolution_um: float, size: int) -> Column:
    """Millimetres to a voxel, truncated and clipped to the volume."""
    return F.greatest(F.lit(0), F.least((value * 1000 / resolution_um).cast("int"), F.lit(size - 1)))


def pixel_index(x: Column, low: float, step: float) -> Column:
    return ((x - low) / step).cast("int")


def pixel_centre(i: Column, low: float, step: float) -> Column:
    return F.lit(float(low)) + F.lit(float(step)) * (i + 0.5)

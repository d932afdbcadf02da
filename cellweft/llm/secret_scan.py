"""Secret scans (native): known forms, and runs of characters that look random.

Known forms are found with regular expressions. Everything else is found by entropy: a candidate is a maximal run of one
character class (hexadecimal or base64) in what the known forms leave; a window slides over it, the counts of its characters are kept
up to date by one addition and one subtraction a step, and with them n log n over the window, in integers, so that no rounding
error builds up. Windows above the class's entropy join to spans. Allow-list words (words that mark examples) cut a run: no window touches one,
and what lies beside them is searched. Whole runs on the allow list (words, numbers, identifiers such as UUIDs, names, paths) are suppressed.

Everything is linear in the text: runs are slid over in blocks that overlap by a window less one, positions are sums of sums of blocks, and
no pattern nests a repeat, so that runs of megabytes need neither stack nor quadratic time.

All offsets are code points, end exclusive. Null and empty texts have no spans; texts are scanned whole; repeated rows each give
their spans; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The known forms, in the order that breaks ties of position.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)(?:password|passwd|secret|token|api_?key)"
ASSIGN_LEAST = 12
# greedy runs that are too short are dropped, so the least length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"


@dataclass(frozen=True)
class CharClass:
    """alphabet, least run length, window width and least entropy of a window in bits."""

    name: str
    alphabet: str
    run: int
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        chars = self.alphabet.replace("-", "") + ("-" if "-" in self.alphabet else "")
        return f"[{chars}]{{{self.run},}}"


HEX_CLASS = CharClass("entropy_hex", "0123456789abcdefABCDEF", 20, 20, 3.0)
BASE64_CLASS = CharClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 20, 20, 3.8)
CLASSES = (HEX_CLASS, BASE64_CLASS)

# Runs that are not secrets, as what they look like and what they must not hold. No repeat holds another.
ALLOWED = (
    (r"^[A-Z]+$", None),  # an upper-case word
    (r"^[0-9]+$", None),  # a number
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", None),  # a UUID
    (r"^[A-Za-z]*[/_=+-][A-Za-z/_=+-]*$", None),  # a rule, or words joined into a path or name
    (r"^[A-Za-z]*[a-z]$", r"[A-Z][A-Z]"),  # a word, or words in camel case
)
# Words that mark examples.
ALLOWED_WORDS = ("example", "sample", "dummy", "placeholder", "changeme", "xxxx")

#: Integer scale of n log2 n.
SCALE = 1 << 20
#: Numbers added up, windows slid over, and code points replaced at a time: what is appended to or walked through stays this small.
SUMS, WINDOWS, PIECE = 256, 256, 8192


def n_log_n(n: int) -> int:
    return round(n * math.log2(n) * SCALE) if n else 0


def most_repetition(cls: CharClass) -> int:
    """A window has at least cls.bits of entropy if the sum of its n log n is at most this."""
    return math.floor((math.log2(cls.window) - cls.bits) * cls.window * SCALE)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(values: Column, size: int, extra: int = 0) -> Column:
    """values in pieces of `size`, each followed by the `extra` values after it."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda i: F.slice(values, i, size + extra))


def sums_before(values: Column) -> Column:
    """For an array of int, the sum of the values before each: block by block, then inside the blocks."""
    empty = F.array().cast("array<int>")

    def running(block: Column, start: Column) -> Column:
        def step(acc: Column, v: Column) -> Column:
            return F.struct((acc["at"] + v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), empty.alias("out")), step)["out"]

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, v: acc + v))
        return F.flatten(F.zip_with(blocks, running(totals, F.lit(0)), running))

    return _let(_blocks(values, SUMS), joined)


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """Array of (start, end, value) of the matches; value is the group's text, or the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # what lies between the matches gives their places
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.filter(F.arrays_zip(gaps.alias("gap"), F.transform(found, F.length).alias("size"), values.alias("value")), lambda p: p["size"].isNotNull())

    def placed(parts: Column) -> Column:
        before = sums_before(F.transform(parts, lambda p: p["gap"] + p["size"]))

        def place(p: Column, at: Column) -> Column:
            start = at + p["gap"]
            return F.struct(start.alias("start"), (start + p["size"]).alias("end"), p["value"].alias("value"))

        return F.zip_with(parts, before, place)

    return _let(parts, placed)


def _when_found(text: Column, hint: str, found: Column) -> Column:
    return F.when(text.rlike(hint), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _joined(spans: Column) -> Column:
    """Sorted (start, end), ends ascending too, joined where they touch."""

    def outer(s: Column) -> Column:
        first = F.filter(s, lambda x, k: (k == 0) | (F.get(s, k - 1)["end"] < x["start"]))
        last = F.filter(s, lambda x, k: (k == F.size(s) - 1) | (F.get(s, k + 1)["start"] > x["end"]))
        return F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    return _let(spans, outer)


def high_windows(value: Column, cls: CharClass) -> Column:
    """Spans (start, end) inside a candidate that windows above the class's entropy cover, joined where they touch."""
    # a character's count n is kept as the n-th character from this one on, in a string that is written in place
    zero, most, w = 48, most_repetition(cls), cls.window
    gains = F.array(*[F.lit(n_log_n(n + 1) - n_log_n(n)) for n in range(w + 1)])  # entry n + 1: the n-th of a kind gives way to the next
    counts = F.lit(chr(zero) * len(cls.alphabet))
    none = F.array().cast("array<int>")

    def first(acc: Column, c: Column) -> Column:
        """A character enters while the window fills."""
        count = F.ascii(F.substring(acc["n"], c, F.lit(1))) - zero
        return F.struct(F.overlay(acc["n"], F.char(count + (zero + 1)), c, 1).alias("n"), (acc["sum"] + F.element_at(gains, count + 1)).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        """The window is judged, then one character enters and one leaves; out holds where windows become high and low again."""
        enters, leaves = c["enters"], c["leaves"]
        less, more = (F.ascii(F.substring(acc["n"], x, F.lit(1))) - zero for x in (leaves, enters))
        moved = F.overlay(F.overlay(acc["n"], F.char(less + (zero - 1)), leaves, 1), F.char(more + (zero + 1)), enters, 1)
        change = F.element_at(gains, more + 1) - F.element_at(gains, less)
        same = enters == leaves
        turns = (acc["sum"] <= most) != (F.size(acc["out"]) % 2 == 1)
        return F.struct(
            F.when(same, acc["n"]).otherwise(moved).alias("n"),
            F.when(same, acc["sum"]).otherwise(acc["sum"] + change).alias("sum"),
            (acc["at"] + 1).alias("at"),
            F.when(turns, F.array_append(acc["out"], acc["at"])).otherwise(acc["out"]).alias("out"),
        )

    def slide(block: Column, k: Column) -> Column:
        n = F.greatest(F.size(block) - (w - 1), F.lit(0))  # windows
        filled = F.aggregate(F.slice(block, 1, w), F.struct(counts.alias("n"), F.lit(0).cast("long").alias("sum")), first)
        # the last window is judged as one more character, here its first one again, would enter
        enter = F.concat(F.slice(block, w + 1, F.greatest(n - 1, F.lit(0))), F.slice(block, n, 1))
        steps = F.zip_with(enter, F.slice(block, 1, n), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))

        def ranges(turns: Column) -> Column:
            some = F.filter(turns, lambda x, i: i % 2 == 0)
            return F.transform(some, lambda x, i: F.struct(x.alias("start"), (F.coalesce(F.get(turns, 2 * i + 1), k * WINDOWS + n) + (w - 1)).alias("end")))

        state = lambda f: F.struct(f["n"].alias("n"), f["sum"].alias("sum"), (k * WINDOWS).alias("at"), none.alias("out"))
        found = _let(filled, lambda f: _let(F.aggregate(steps, state(f), step)["out"], ranges))
        return F.when(n > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    codes = F.transform(F.split(value, ""), lambda c: F.call_function("instr", F.lit(cls.alphabet), c))
    return _joined(_let(codes, lambda c: F.flatten(F.transform(_blocks(c, WINDOWS, w - 1), slide))))


def entropy_spans(text: Column, cls: CharClass) -> Column:
    """Array of (start, end) in the text."""
    runs = F.filter(matches(text, cls.pattern), lambda m: ~_allowed(m["value"]))

    def inside(m: Column) -> Column:
        return F.transform(high_windows(m["value"], cls), lambda s: F.struct((m["start"] + s["start"]).alias("start"), (m["start"] + s["end"]).alias("end")))

    return F.when(text.rlike(cls.pattern), F.flatten(F.transform(runs, inside))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _allowed(value: Column) -> Column:
    out = F.lit(False)
    for pattern, without in ALLOWED:
        out = out | (value.rlike(pattern) & ~value.rlike(without) if without else value.rlike(pattern))
    return out


def _merged(spans: Column) -> Column:
    """Spans sorted by start, of any lengths, joined where they overlap, as (start, end)."""
    # the largest end so far, in blocks, so that nothing long is appended to
    def outer(s: Column) -> Column:
        def top(acc: Column, x: Column) -> Column:
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

        def running(block: Column, start: Column) -> Column:
            return F.aggregate(block, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), top)["out"]

        def all_blocks(blocks: Column) -> Column:
            tops = F.transform(blocks, lambda b: F.struct(F.array_max(F.transform(b, lambda x: x["end"])).alias("end")))
            return F.flatten(F.zip_with(blocks, running(tops, F.lit(-1)), running))

        def cut(before: Column) -> Column:
            first = F.filter(s, lambda x, k: F.get(before, k) <= x["start"])
            ends = F.filter(F.transform(s, lambda x, k: F.greatest(x["end"], F.get(before, k))), lambda e, k: (k == F.size(s) - 1) | (F.get(s, k + 1)["start"] >= e))
            return F.zip_with(first, ends, lambda a, e: F.struct(a["start"].alias("start"), e.alias("end")))

        return _let(_let(_blocks(s, SUMS), all_blocks), cut)

    return _let(spans, outer)


def _replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """text with every one of the joined, sorted spans replaced by its mark, piece after piece, so that no span is looked for from the text's start."""
    substr = lambda t, start, size: F.call_function("substr", t, start + 1, F.greatest(size, F.lit(0)))

    def whole(spans: Column) -> Column:
        def piece(at: Column) -> Column:
            def filled(part: Column, own: Column) -> Column:
                def out(s: Column, k: Column) -> Column:
                    # the text since the span before; a mark stands where its span begins
                    since = F.when(k == 0, at).otherwise(F.get(own, k - 1)["end"])
                    return F.concat(substr(part, since - at, s["start"] - since), F.when(s["start"] >= at, mark(s)).otherwise(F.lit("")))

                last = F.when(F.size(own) > 0, F.get(own, F.size(own) - 1)["end"]).otherwise(at)
                return F.concat(F.array_join(F.transform(own, out), ""), substr(part, last - at, at + PIECE - last))

            own = F.filter(spans, lambda s: (s["end"] > at) & (s["start"] < at + PIECE))
            return _let(substr(text, at, F.lit(PIECE)), lambda part: _let(own, lambda o: filled(part, o)))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.length(text), F.lit(PIECE)), piece), "")

    return F.when(F.size(spans) > 0, _let(spans, whole)).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    return _replaced(text, spans, lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))


def _without_words(text: Column) -> Column:
    out = text
    for word in ALLOWED_WORDS:
        out = F.regexp_replace(out, f"(?i){word}", " " * len(word))
    return F.when(text.rlike(f"(?i)(?:{'|'.join(ALLOWED_WORDS)})"), out).otherwise(text)


def scan(df: DataFrame, text: str = "text", classes: tuple[CharClass, ...] = CLASSES) -> DataFrame:
    """df plus base and secrets: arrays of (start, rank of the kind, end, kind), by start, then kind.

    Each class looks at what the known forms, the allow-list words and the classes before it leave of the text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    named = lambda kind: lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))
    assign = F.filter(_when_found(t, ASSIGN_HINT, matches(t, ASSIGN, 2)), lambda m: F.length(m["value"]) >= ASSIGN_LEAST)
    base = F.concat(
        F.transform(assign, named("assign")),
        F.transform(_when_found(t, ACCESS, matches(t, ACCESS)), named("access")),
        F.transform(_when_found(t, HEX, matches(t, HEX)), named("hex")),
    )
    kept = df.columns
    df = df.withColumn("base", F.array_sort(base))
    rest, secrets = _without_words(_blanked(t, _merged(F.col("base")))), [F.col("base")]
    for cls in classes:
        df = df.withColumn("_rest", rest).withColumn(f"_{cls.name}", entropy_spans(F.col("_rest"), cls))
        secrets.append(F.transform(f"_{cls.name}", named(cls.name)))
        rest = _blanked(F.col("_rest"), F.col(f"_{cls.name}"))
    return df.withColumn("secrets", F.array_sort(F.concat(*secrets))).select(*kept, "base", "secrets")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every found span by the mark; overlapping spans become one mark. Other columns, and texts without secrets, stay."""
    found = scan(df, text).withColumn("_spans", _merged(F.col("secrets")))
    return found.withColumn(text, _replaced(F.col(text), F.col("_spans"), lambda s: F.lit(mark))).drop("base", "secrets", "_spans")


def oracle() -> str:
    """The same spans in SQL: positions by running sums, entropies counted anew in every window."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"

    def found(name: str, source: str, pattern: str, group: int, hint: str) -> str:
        p = quote(pattern)
        return (
            f"{name} AS (SELECT rid, (sum(length(gap)) OVER w + sum(coalesce(length(f), 0)) OVER w - coalesce(length(f), 0))::BIGINT AS start, length(f) AS size, v AS value, f FROM "
            f"(SELECT rid, unnest(string_split_regex(t, {p})) AS gap, unnest(regexp_extract_all(t, {p}, 0)) AS f, unnest(regexp_extract_all(t, {p}, {group})) AS v, unnest(range(0, len(string_split_regex(t, {p})))) AS k FROM {source} WHERE regexp_matches(t, {quote(hint)})) "
            "WINDOW w AS (PARTITION BY rid ORDER BY k))"
        )

    def blanked(name: str, source: str, spans: str, words: tuple[str, ...] = ()) -> str:
        """The source's texts with the spans, and then the words, replaced by as many blanks."""
        t = f"CASE WHEN head IS NULL THEN {source}.t ELSE head || substr({source}.t, last + 1) END"
        for word in words:
            t = f"regexp_replace({t}, '(?i){word}', '{' ' * len(word)}', 'g')"
        order = "PARTITION BY rid ORDER BY start, stop, rank"
        return (
            f"{name} AS (SELECT rid, {t} AS t FROM {source} LEFT JOIN (SELECT rid, string_agg(substr(t, prev + 1, start - prev) || repeat(' ', stop - start), '' ORDER BY start) AS head, max(stop) AS last FROM "
            f"(SELECT i.*, t, coalesce(lag(stop) OVER (PARTITION BY i.rid ORDER BY start), 0) AS prev FROM (SELECT rid, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop FROM "
            f"(SELECT *, sum(fresh) OVER ({order}) AS g FROM (SELECT *, CASE WHEN start < max(stop) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {spans})) GROUP BY rid, g) i "
            f"JOIN {source} USING (rid)) GROUP BY rid) USING (rid))"
        )

    parts = ["d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)"]
    parts += [found("m_assign", "d", ASSIGN, 2, ASSIGN_HINT), found("m_access", "d", ACCESS, 0, ACCESS), found("m_hex", "d", HEX, 0, HEX)]
    base = " UNION ALL ".join(
        f"SELECT rid, start, {KINDS.index(k)} AS rank, start + size AS stop, '{k}' AS kind FROM m_{k} WHERE f IS NOT NULL" + (f" AND length(value) >= {ASSIGN_LEAST}" if k == "assign" else "")
        for k in ("assign", "access", "hex")
    )
    parts += [f"base AS ({base})", blanked("r0", "d", "base", ALLOWED_WORDS)]
    for k, c in enumerate(CLASSES):
        allowed = " OR ".join(f"regexp_matches(value, {quote(p)})" + (f" AND NOT regexp_matches(value, {quote(x)})" if x else "") for p, x in ALLOWED)
        parts += [
            found(f"m_{c.name}", f"r{k}", c.pattern, 0, c.pattern),
            f"c_{c.name} AS (SELECT rid, start, value, unnest(range(0, length(value) - {c.window} + 1)) AS i FROM m_{c.name} WHERE f IS NOT NULL AND NOT ({allowed}))",
            f"w_{c.name} AS (SELECT rid, start, i FROM (SELECT rid, start, i, ch, count(*) AS n FROM (SELECT rid, start, i, unnest(string_split(substr(value, (i + 1)::BIGINT, {c.window}), '')) AS ch FROM c_{c.name}) GROUP BY ALL) GROUP BY ALL HAVING sum(round(n * log2(n) * {SCALE})) <= {most_repetition(c)})",
            f"g_{c.name} AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, start ORDER BY i) AS g FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY rid, start ORDER BY i) + {c.window} THEN 0 ELSE 1 END AS fresh FROM w_{c.name}))",
            f"{c.name} AS (SELECT rid, start + min(i) AS start, {KINDS.index(c.name)} AS rank, start + max(i) + {c.window} AS stop, '{c.name}' AS kind FROM g_{c.name} GROUP BY rid, m_start, g)".replace("m_start", f"g_{c.name}.start"),
            blanked(f"r{k + 1}", f"r{k}", c.name),
        ]
    listed_sql = "coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    parts.append("every AS (" + " UNION ALL ".join(f"SELECT * FROM {name}" for name in ("base", *(c.name for c in CLASSES))) + ")")
    return (
        "WITH " + ", ".join(parts) + f" SELECT d.doc_id, {', '.join(f'coalesce(b.n_{k}, 0) AS n_{k}' for k in ('assign', 'access', 'hex'))}, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(e.spans, '') AS spans FROM d "
        f"LEFT JOIN (SELECT rid, {counts}, {listed_sql} AS spans FROM base GROUP BY rid) b USING (rid) LEFT JOIN (SELECT rid, {listed_sql} AS spans FROM every GROUP BY rid) e USING (rid)"
    )

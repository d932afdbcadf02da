"""Sharding by a hierarchical weighted hash tree (native).

A tree has places for regions, racks in a region and shards in a rack; some places are taken, with a weight. A row descends it by
draws of a hash of its key: the digest's bits name a region, a rack in it and a shard in that, and a height that must lie below the
shard's weight, as a part of the heaviest allowed. A draw that ends at an empty place, or above the weight, is repeated with further bits. So a
row reaches a shard with a probability in proportion to its weight, at a cost that the number of shards does not change:
the expected number of draws is places x heaviest / total weight, and a digest holds several.

What a draw does depends on nothing but the key and the place it names. A change of weight therefore moves rows only into or out of the changed
shard, and a new shard takes rows only into itself, as long as the tree keeps its places and heaviest weight. Rows whose draws are all
rejected, which is rare unless the tree is almost empty, go by the least exponential race time among the shards, under which the same holds.

(If every node drew with the weight of its subtree, as nodes of placement trees often do, a new shard would draw rows of other
regions into its region and scatter them over the old shards there.)

Null keys share one hash key; repeated rows go to the same shard; an empty table gives an empty result; other columns
pass through.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import dense_index

#: Places of a tree: regions, racks in a region, shards in a rack. More shards than that need a larger tree from the start.
PLACES = (4, 2, 4)
HEAVIEST = 4.0
#: Digests of a row, draws of a digest, and hex digits of a draw.
DIGESTS, DRAWS, DIGITS = 16, 5, 6
#: Hex digits of the md5 taken for a race time: 52 bits, exact in a double.
RACE_DIGITS = 13


@dataclass(frozen=True)
class Leaf:
    """A shard; its place is the remainder of each number by the places of its level."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform_tree(shards: int, shards_per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    """Shards 0..n-1 of weight 1 laid out rack by rack; one more shard leaves every other leaf in its place."""
    return [Leaf(s // (shards_per_rack * racks_per_region), s // shards_per_rack, s) for s in range(shards)]


def _placed(tree: list[Leaf], places: tuple[int, int, int], heaviest: float) -> dict[int, Leaf]:
    """Leaves by place."""
    if not any(x.weight > 0 for x in tree):
        raise ValueError("the tree has no shard")
    regions, racks, shards = places
    at: dict[int, Leaf] = {}
    for x in tree:
        place = (x.region % regions * racks + x.rack % racks) * shards + x.shard % shards
        if place in at or x.region >= regions:
            raise ValueError(f"the tree has no place for {x}: make it larger from the start")
        if x.weight > heaviest:
            raise ValueError(f"{x} is heavier than {heaviest}")
        at[place] = x
    return at


def _limits(at: dict[int, Leaf], n: int, heaviest: float) -> list[int]:
    """Heights below which a draw counts, by place; a draw's number is place + n * height."""
    span = 16**DIGITS // n
    return [round(span * max(at[k].weight, 0.0) / heaviest) if k in at else 0 for k in range(n)]


def _constant(value: list, kind: str) -> Column:
    """A constant table through one literal; the optimiser parses it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def _number(digest: Column, start: Column | int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, F.lit(digits) if isinstance(start, Column) else digits), 16, 10)


def _place(key: Column, at: dict[int, Leaf], n: int, heaviest: float) -> Column:
    limits = _constant(_limits(at, n, heaviest), "array<int>")

    def draws(k: int) -> Column:
        """Place of the first draw of a digest that counts, or null."""
        digest = F.md5(F.concat_ws("/", _text(key), F.lit(str(k))).cast("binary"))
        numbers = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda i: _number(digest, i * DIGITS + 1, DIGITS).cast("int"))
        hits = F.filter(numbers, lambda v: F.floor(v / n).cast("int") < F.element_at(limits, v % n + 1))
        return F.get(hits, F.lit(0)) % n

    def race(x: Column) -> Column:
        digest = F.md5(F.concat_ws("/", _text(key), F.lit("race"), x["place"].cast("string")).cast("binary"))
        u = (_number(digest, 1, RACE_DIGITS).cast("double") + 0.5) / F.lit(float(16**RACE_DIGITS))
        return F.struct((-F.log(u) / x["weight"]).alias("time"), x["place"].alias("place"))

    runners = _constant([{"place": k, "weight": float(x.weight)} for k, x in sorted(at.items()) if x.weight > 0], "array<struct<place:int,weight:double>>")
    return F.coalesce(*[draws(k) for k in range(DIGESTS)], F.array_min(F.transform(runners, race))["place"])


def assign_shard(df: DataFrame, key: str, tree: list[Leaf], out: str = "shard", places: tuple[int, int, int] = PLACES, heaviest: float = HEAVIEST) -> DataFrame:
    """Add the columns {out}_region, {out}_rack and {out}: the path of each row's key down the tree."""
    added = [f"{out}_region", f"{out}_rack", out]
    clash = {*added, f"_place_{out}"} & set(df.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    n = places[0] * places[1] * places[2]
    at = _placed(tree, places, heaviest)
    path = _constant([{"a": at[k].region, "b": at[k].rack, "c": at[k].shard} if k in at else {} for k in range(n)], "array<struct<a:int,b:int,c:int>>")
    placed = df.withColumn(f"_place_{out}", _place(F.col(key), at, n, heaviest))
    ends = F.element_at(path, F.col(f"_place_{out}") + 1)
    return placed.select(*df.columns, *[ends[c].alias(name) for c, name in zip("abc", added, strict=True)])


def number_slots(df: DataFrame, group: str, keys: list[str], out: str = "slot") -> DataFrame:
    """Add a gapless position from 0 inside each value of group, in the order of keys.

    The number of groups must be bounded (it is the number of shards): their first positions are broadcast.
    """
    ranked = dense_index(df, [group, *keys], "_idx")
    first = ranked.groupBy(group).agg(F.min("_idx").alias("_first"))
    return ranked.join(F.broadcast(first), group).withColumn(out, F.col("_idx") - F.col("_first")).drop("_idx", "_first")


def oracle(shards: int, places: tuple[int, int, int] = PLACES, heaviest: float = 1.0) -> str:
    """Every draw of every row, the first that counts wins, or else the least race time; CRC-32 byte by byte from its polynomial."""
    entries = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        entries.append(n)
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, octets), lambda a, b: xor(a >> 8, ({entries}::BIGINT[])[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"
    n = places[0] * places[1] * places[2]

    def of(count: int) -> str:
        at = _placed(uniform_tree(count), places, heaviest)
        limits = _limits(at, n, heaviest)
        leaves = ", ".join(f"({k}, {x.shard}, {limits[k]}, {float(x.weight)})" for k, x in sorted(at.items()))
        number = lambda salt, start, digits: f"('0x' || substr(md5(k || '/' || {salt}), {start}, {digits}))::BIGINT"
        return (
            f"(SELECT rid, coalesce(drawn, raced) AS shard FROM (SELECT rid, arg_min(shard, g * {DRAWS} + i) AS drawn FROM (SELECT rid, g, i, {number('g::VARCHAR', f'i * {DIGITS} + 1', DIGITS)} AS v "
            f"FROM d, (SELECT unnest(range(0, {DIGESTS})) AS g), (SELECT unnest(range(0, {DRAWS})) AS i)) LEFT JOIN (VALUES {leaves}) l(place, shard, lim, w) ON place = v % {n} AND v // {n} < lim WHERE shard IS NOT NULL GROUP BY rid) "
            f"RIGHT JOIN (SELECT rid, arg_min(shard, -ln(({number(chr(39) + 'race/' + chr(39) + ' || place::VARCHAR', '1', RACE_DIGITS)}::DOUBLE + 0.5) / {16**RACE_DIGITS}.0) / w) AS raced "
            f"FROM d, (VALUES {leaves}) l(place, shard, lim, w) GROUP BY rid) USING (rid))"
        )

    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, encode(coalesce(text, '')) AS b FROM documents), "
        "o AS (SELECT rid, doc_id, (octet_length(b) + 1)::BIGINT AS size, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT) AS octets FROM d), "
        f"c AS (SELECT rid, doc_id, size, {crc} AS text_crc32 FROM o), a AS {of(shards)}, g AS {of(shards + 1)} "
        "SELECT doc_id, size, text_crc32, 'key' AS law, a.shard::INT AS shard, row_number() OVER (PARTITION BY a.shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, g.shard::INT AS grown_shard "
        "FROM c JOIN a USING (rid) JOIN g USING (rid)"
    )

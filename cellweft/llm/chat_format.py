"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (equal role and text) is rendered once as the prompt; what follows in either conversation is
a completion, with the character spans that a loss may use (the texts of assistant turns). Whole turns are compared, whole texts
rendered.

Turns without a pair are left out, as nothing says where they belong; a null role is "unknown", a null text empty; turns are
ordered by turn, role and text, and exact repeats of a turn count once; control markers inside a text are
broken up, so that no text can end its turn; a pair of which one side is missing has an empty prompt and an empty completion
for it; identical sides have two empty completions. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE + "\n"), turn["text"], F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column, trained_role: str) -> Column:
    """start:end of every trained text in the rendered turns, code points, end exclusive, comma-joined."""

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["role"]) + len(OPEN + CLOSE + "\n")
        end = start + F.length(t["text"])
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(
            (end + len(END)).alias("at"),
            F.when(t["role"] == trained_role, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def format_preferences(turns: DataFrame, pair: str = "pair_id", chosen: str = "is_chosen", trained_role: str = "assistant") -> DataFrame:
    """turns (pair, is_chosen boolean, turn, role, text) to one row a pair: n_common, prompt, both completions, both masks.

    One shuffle, on the pair; a conversation is the unit that a task must hold.
    """
    # a marker in a text or role loses its bar: "<|" becomes "< |"
    clean = lambda c, absent: F.replace(F.coalesce(F.col(c), F.lit(absent)), F.lit(OPEN), F.lit("< |"))
    rows = turns.filter(F.col(pair).isNotNull()).select(
        pair, F.col(chosen).alias("_c"), F.struct(F.col("turn").alias("turn"), clean("role", "unknown").alias("role"), clean("text", "").alias("text")).alias("t")
    )
    side = lambda c: F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("_c") == c, F.col("t")))))
    both = rows.groupBy(pair).agg(side(True).alias("_a"), side(False).alias("_b"))
    same = F.zip_with(
        F.slice("_a", 1, F.least(F.size("_a"), F.size("_b"))),
        F.slice("_b", 1, F.least(F.size("_a"), F.size("_b"))),
        lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]),
    )
    common = F.coalesce(F.nullif(F.array_position(F.col("_same"), False), F.lit(0)) - 1, F.size("_same").cast("long")).cast("int")
    both = both.withColumn("_same", same).withColumn("n_common", common)
    rest = lambda c: F.filter(c, lambda _, i: i >= F.col("n_common"))
    both = both.withColumns({"_p": F.filter("_a", lambda _, i: i < F.col("n_common")), "_ra": rest("_a"), "_rb": rest("_b")})
    return both.select(
        pair,
        "n_common",
        _rendered(F.col("_p")).alias("prompt"),
        _rendered(F.col("_ra")).alias("chosen"),
        _rendered(F.col("_rb")).alias("rejected"),
        _mask(F.col("_ra"), trained_role).alias("chosen_mask"),
        _mask(F.col("_rb"), trained_role).alias("rejected_mask"),
    )


def oracle() -> str:
    """Conversations 2k (chosen) and 2k + 1 (rejected) of the table, without lists: turns are numbered and compared by position."""
    render = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"
    return (
        "WITH t AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) - 1 AS pos FROM t), "
        "p AS (SELECT DISTINCT pair_id FROM n), "
        "d AS (SELECT pair_id, min(pos) AS n_common FROM (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos, a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same FROM (SELECT * FROM n WHERE side = 0) a FULL JOIN (SELECT * FROM n WHERE side = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos) WHERE NOT same GROUP BY 1), "
        "l AS (SELECT pair_id, count(*) AS len FROM n WHERE side = 0 GROUP BY 1), "
        "c AS (SELECT p.pair_id, coalesce(d.n_common, l.len) AS n_common FROM p LEFT JOIN d USING (pair_id) LEFT JOIN l USING (pair_id)), "
        f"r AS (SELECT n.*, c.n_common, {render} AS out, sum(CASE WHEN pos >= n_common THEN length({render}) ELSE 0 END) OVER (PARTITION BY n.pair_id, side ORDER BY pos) - 8 AS stop FROM n JOIN c USING (pair_id)) "
        "SELECT c.pair_id, c.n_common::INT AS n_common, "
        "coalesce(string_agg(out, '' ORDER BY pos) FILTER (side = 0 AND pos < c.n_common), '') AS prompt, "
        "coalesce(string_agg(out, '' ORDER BY pos) FILTER (side = 0 AND pos >= c.n_common), '') AS chosen, "
        "coalesce(string_agg(out, '' ORDER BY pos) FILTER (side = 1 AND pos >= c.n_common), '') AS rejected, "
        "coalesce(string_agg((stop - length(text))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY pos) FILTER (side = 0 AND pos >= c.n_common AND role = 'assistant'), '') AS chosen_mask, "
        "coalesce(string_agg((stop - length(text))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY pos) FILTER (side = 1 AND pos >= c.n_common AND role = 'assistant'), '') AS rejected_mask "
        "FROM c LEFT JOIN r USING (pair_id) GROUP BY c.pair_id, c.n_common"
    )

"""Packing by optimal length buckets.

The global histogram of document lengths goes through a dynamic programme that chooses the bucket boundaries with the least
padding; inside each bucket, documents in hash order form batches of as many rows as the token budget holds at
the bucket's padded length.

The histogram has as many entries as there are different lengths, so the longest document bounds it, not the number of documents;
at most `buckets` boundaries go back to the executors. Null and empty texts have length 0 and share the first bucket; a
document longer than the budget is a batch of its own, whole; repeated rows are packed each; other columns pass through; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import dense_index, materialize

BUCKETS = 8
TOKEN_BUDGET = 8192


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Largest length of each bucket, ascending, with the least padding among all choices of up to `buckets` buckets.

    cost(i, j) = length[j] * documents(i..j) - words(i..j) satisfies the quadrangle inequality, so the best split points are
    monotone and divide and conquer finds a layer in m log m steps. Ties go to the smaller split point.
    """
    order = np.argsort(lengths, kind="stable")
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    m = len(x)
    if not m:
        return []
    docs = np.concatenate([[0], np.cumsum(c)])
    words = np.concatenate([[0], np.cumsum(c * x)])
    best = x * docs[1:] - words[1:]
    splits = []
    for _ in range(min(buckets, m) - 1):
        now, at = best.copy(), np.zeros(m, np.int64)
        # spans (first row, last row, first split, last split) of one depth of the recursion at a time
        work = [(0, m - 1, 0, m - 1)]
        while work:
            later = []
            for a, b, s, e in work:
                if a > b:
                    continue
                j = (a + b) // 2
                i = np.arange(s, min(e, j) + 1)  # the last bucket begins at i; i = 0: no further bucket
                before = np.where(i > 0, best[i - 1], 0)
                cost = before + x[j] * (docs[j + 1] - docs[i]) - (words[j + 1] - words[i])
                k = int(np.argmin(cost))
                now[j], at[j] = cost[k], i[k]
                later += [(a, j - 1, s, int(i[k])), (j + 1, b, int(i[k]), e)]
            work = later
        best = now
        splits.append(at)
    ends, j = [], m - 1
    for at in reversed(splits):
        ends.append(int(x[j]))
        if at[j] == 0:
            j = -1
            break
        j = int(at[j]) - 1
    if j >= 0:
        ends.append(int(x[j]))
    return sorted(set(ends))


def pack(docs: DataFrame, key: str, length: str, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """docs (narrow, with a long length) plus bucket, bucket_length, batch, slot (both from 0) and padding."""
    docs = materialize(docs)
    hist = docs.groupBy(length).agg(F.count(F.lit(1)).alias("_n")).toPandas()
    ends = optimal_boundaries(hist[length].to_numpy(np.int64), hist["_n"].to_numpy(np.int64), buckets) or [0]
    bucket = F.lit(len(ends) - 1)
    size = F.lit(ends[-1])
    for k in reversed(range(len(ends) - 1)):
        bucket = F.when(F.col(length) <= ends[k], k).otherwise(bucket)
        size = F.when(F.col(length) <= ends[k], ends[k]).otherwise(size)
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    placed = docs.withColumns({"bucket": bucket.cast("int"), "bucket_length": size.cast("long"), "_h": F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))})
    ranked = materialize(dense_index(placed, ["bucket", "_h", key, length], "_idx"))
    first = ranked.groupBy("bucket").agg(F.min("_idx").alias("_first"))  # as many rows as buckets
    at = ranked.join(F.broadcast(first), "bucket").withColumn("_at", F.col("_idx") - F.col("_first"))
    return (
        at.withColumns({"batch": F.floor(F.col("_at") / rows).cast("long"), "slot": (F.col("_at") % rows).cast("int"), "padding": F.col("bucket_length") - F.col(length)})
        .drop("_h", "_idx", "_first", "_at")
    )


def oracle(length_sql: str, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> str:
    """The same packing in SQL for small tables: the dynamic programme tries every split, layer by layer."""
    layers = ["l1 AS (SELECT j, x * docs - words AS cost, 0::BIGINT AS i FROM p)"]
    for k in range(2, buckets + 1):
        layers.append(
            f"l{k} AS (SELECT q.j, min({{'c': q.x * (q.docs - coalesce(b.docs, 0)) - (q.words - coalesce(b.words, 0)) + coalesce(l.cost, 0), 'i': s.i}}) AS m FROM p q "
            f"JOIN (SELECT unnest(range(0, (SELECT count(*) FROM p))) AS i) s ON s.i <= q.j LEFT JOIN p b ON b.j = s.i - 1 LEFT JOIN l{k - 1}c l ON l.j = s.i - 1 GROUP BY q.j), "
            f"l{k}c AS (SELECT j, m.c AS cost, m.i AS i FROM l{k})"
        )
    layers[0] += ", l1c AS (SELECT * FROM l1)"
    last, walk = "(SELECT max(j) FROM p)", []
    for k in range(buckets, 0, -1):
        walk.append(f"e{k} AS (SELECT j, i FROM l{k}c WHERE j = {last})")
        last = f"(SELECT i - 1 FROM e{k})"
    ends = " UNION ".join(f"SELECT p.x FROM e{k} JOIN p USING (j)" for k in range(1, buckets + 1))
    return (
        f"WITH d AS (SELECT doc_id, {length_sql} AS length FROM documents), "
        "p AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS j, (sum(n) OVER (ORDER BY x))::BIGINT AS docs, (sum(n * x) OVER (ORDER BY x))::BIGINT AS words FROM (SELECT length AS x, count(*) AS n FROM d GROUP BY 1)), "
        + ", ".join([*layers, *walk])
        + f", ends AS (SELECT x, (row_number() OVER (ORDER BY x) - 1)::INT AS bucket FROM ({ends})), "
        "b AS (SELECT d.doc_id, d.length, min(e.x) AS bucket_length, min(e.bucket) AS bucket FROM d JOIN ends e ON d.length <= e.x GROUP BY ALL), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(doc_id::VARCHAR), doc_id, length) - 1 AS pos, "
        f"greatest(1, {budget} // greatest(bucket_length, 1)) AS n FROM b) "
        "SELECT doc_id, length, bucket, bucket_length, (pos // n)::BIGINT AS batch, (pos % n)::INT AS slot, bucket_length - length AS padding FROM r"
    )

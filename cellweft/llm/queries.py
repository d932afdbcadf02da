"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.llm import ann, chat_format, langid, mixing, neardup, ogg, packing, quality, secret_scan, sharding
from cellweft.llm.common import table, word_count

SHARDS = 16


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as preference pairs."""
    turns = table(spark, sf_dir, "conversations").select(
        F.expr("conv_id div 2").alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("is_chosen"), "turn", "role", "text"
    )
    return chat_format.format_preferences(turns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("secrets")).alias("spans"),
    )


def _remainder(key: str, n: int):  # noqa: ANN202
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False))
    net = langid.fit(docs.filter(~held_out))
    return langid.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.mix(docs, "doc_id").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("length"))
    return packing.pack(docs, "doc_id", "length").select("doc_id", "length", "bucket", "bucket_length", "batch", "slot", "padding")


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.store_texts(table(spark, sf_dir, "documents"), "doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted positives: labelled 1, outside the held-out fifth; unlabelled: every document outside it."""
    rows = quality.described(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held_out = F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False))
    trusted = table(spark, sf_dir, "labels").filter((F.col("quality") == 1) & ~held_out).select("doc_id")
    model = quality.fit(rows.filter(~held_out), trusted)
    return quality.score(rows, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    tree = sharding.uniform_tree(SHARDS)
    placed = sharding.assign_shard(docs, "doc_id", tree, heaviest=1.0)
    placed = sharding.assign_shard(placed, "doc_id", sharding.uniform_tree(SHARDS + 1), "grown_shard", heaviest=1.0)
    slots = sharding.number_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_chat_format, op2_secret_scan, op3_langid, op4_mixing, op5_packing, op6_ogg, op7_quality, op8_ann, op9_neardup, op10_sharding,
        pipeline,
    )
}

ORACLES: dict[str, str] = {}
ORACLES["op1_chat_format"] = chat_format.oracle()
ORACLES["op2_secret_scan"] = secret_scan.oracle()
ORACLES["op5_packing"] = packing.oracle(r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))")
ORACLES["op10_sharding"] = sharding.oracle(SHARDS)

"""A corpus pipeline of training-data operators: documents in, packed batches out.

Each stage reads what its predecessor wrote as Parquet. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.llm import langid, mixing, neardup, packing, secret_scan
from cellweft.llm.common import require_checkpoint_dir, table, word_count

#: A text whose best language is less probable than this is rejected.
LEAST_LANGUAGE_SCORE = 0.3


def _apart(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator works on, beside the whole row, so that no other column's name can clash."""
    return docs.select(F.struct(*docs.columns).alias("_row"), *columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter and those in no learned language. Where no document has a language, none can be told and all pass."""
    net = langid.fit(docs)
    if net is None:
        return docs
    named = langid.predict(_apart(docs, "text"), net)
    known = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return named.filter(known).select("_row.*")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; documents stay."""
    clean = secret_scan.redact(_apart(docs, "text", F.col("text").alias("_before"), "n_chars"))
    changed = ~F.col("text").eqNullSafe(F.col("_before"))
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("_row", F.col("_row").withField("text", F.col("text")).withField("n_chars", n_chars)).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as the mix takes it."""
    return mixing.repeat_copies(docs, "doc_id", "text", word_count(F.col("text")))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of a token budget inside length buckets of least padding."""
    return packing.pack(docs.select("doc_id", word_count(F.col("text")).alias("length")), "doc_id", "length")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: The language network and the signatures are not SQL.
ORACLE_SQL: str | None = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared checkpoint folder and read again; what a stage has read is then deleted."""
    require_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            _delete(spark, before)
        docs, before = spark.read.parquet(at), at
    return docs

"""Every query on odd and on empty tables."""

import pytest

import corpus_pipeline
from cellweft.llm.queries import QUERIES

DOC_QUERIES = ["op2_secret_scan", "op3_langid", "op4_mixing", "op5_packing", "op6_ogg", "op7_quality", "op9_neardup", "op10_sharding"]


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, None), (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", DOC_QUERIES)
def test_odd_rows_each_give_a_row(spark, odd_docs, labels, as_table, name):
    got = QUERIES[name](spark, as_table(documents=odd_docs, labels=labels)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd_docs.collect())


@pytest.mark.parametrize("name", DOC_QUERIES)
def test_empty_tables_give_empty_results(spark, no_docs, labels, as_table, name):
    assert QUERIES[name](spark, as_table(documents=no_docs, labels=labels.limit(0))).count() == 0


def test_pipeline_stages_keep_the_columns(spark, odd_docs, as_table, tmp_path):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == odd_docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    ids = [r["doc_id"] for r in docs.collect()]
    assert not {3, 4, 5} & set(ids)  # no letter
    assert not {1, 2} <= set(ids)  # near copies
    assert {"n", "s"} == {r["node"] for r in docs.collect()} | {r["size"] for r in docs.collect()}
    packed = corpus_pipeline.pack_batches(spark, docs, "").collect()
    assert len(packed) == len(ids)


def test_pipeline_on_an_empty_table(spark, no_docs, as_table):
    assert corpus_pipeline.run(spark, as_table(documents=no_docs)).count() == 0


def test_secrets_are_redacted(spark, odd_docs):
    text = {r["doc_id"]: r for r in corpus_pipeline.redact_secrets(spark, odd_docs, "").collect()}
    assert text[7]["text"] == '[SECRET]" und mehr' and text[7]["n_chars"] == len(text[7]["text"])
    assert text[9]["text"].startswith("\U0001f600 [SECRET]") and text[9]["text"].endswith("\U0001f600")
    assert text[3]["text"] is None and text[4]["text"] == ""


TURNS = "conv_id long, turn long, role string, text string, pair_id string, is_chosen string"


def test_chat_format_of_odd_conversations(spark, as_table):
    """Nulls in every column, ties, repeated rows, a missing side, identical sides, long and empty texts, clashing columns."""
    rows = [
        (0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "c"),  # a repeat counts once
        (2, 0, None, None), (2, 1, "assistant", ""), (3, 0, None, None), (3, 1, "assistant", "x" * 200_000),
        (4, 0, "user", "only chosen"),
        (6, 0, "user", "same"), (7, 0, "user", "same"),
        (8, 0, "user", "tie 2"), (8, 0, "user", "tie 1"), (9, 0, "user", "tie 1"), (9, 0, "user", "tie 2"),
        (10, None, "user", "<|end|>"), (11, None, "user", "<|end|>"), (11, 1, "assistant", "\U0001f600 <|assistant|>"),
        (None, 0, "user", "nobody"),
    ]
    at = as_table(conversations=spark.createDataFrame([(*r, "p", "q") for r in rows], TURNS))
    got = {r["pair_id"]: r.asDict() for r in QUERIES["op1_chat_format"](spark, at).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    texts = {k: [v for v in r.values() if isinstance(v, str)] for k, r in got.items()}
    assert any(t.endswith("a<|end|>\n") for t in texts[0]) and any("b<|end|>" in t for t in texts[0]) and any("c<|end|>" in t for t in texts[0])
    assert sum(t.count("b<|end|>") for t in texts[0]) == 1
    assert any("unknown" in t for t in texts[1]) and max(map(len, texts[1])) > 200_000
    assert sum("only chosen" in t for t in texts[2]) == 1 and sum(t.count("same") for t in texts[3]) == 1 and sum(t.count("tie") for t in texts[4]) == 2
    for t in texts[5]:  # no text can end its turn
        assert t.count("<|end|>") == t.count("<|user|>") + t.count("<|assistant|>")


def test_chat_format_of_nothing(spark, as_table):
    empty = spark.createDataFrame([], TURNS)
    assert QUERIES["op1_chat_format"](spark, as_table(conversations=empty)).count() == 0


def test_neighbours_of_nothing(spark, as_table):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, id int, v string, part string")
    assert QUERIES["op8_ann"](spark, as_table(embeddings=empty)).count() == 0


def test_pipeline_without_a_language_keeps_all_texts(spark, odd_docs):
    from pyspark.sql import functions as F

    plain = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, plain, "").count() == odd_docs.count()


def test_pipeline_dedup_keeps_different_texts_of_one_id(spark, odd_docs):
    from pyspark.sql import functions as F

    one = odd_docs.withColumn("doc_id", F.lit(1).cast("long"))
    kept = [r["text"] for r in corpus_pipeline.remove_near_duplicates(spark, one, "").collect()]
    assert len(kept) == len(set(kept)) == len({r["text"] for r in odd_docs.collect()}) - 1  # the two near copies are one class


def test_mixing_repeated_and_keyless_rows(spark):
    """Repeated rows share the copies of the mix; the words taken are those that the mix takes."""
    from cellweft.llm import mixing
    from cellweft.llm.common import word_count
    from pyspark.sql import functions as F

    text = lambda n: " ".join(["w"] * n)
    rows = [(1, text(10), "a")] * 40 + [(None, text(7), "a")] * 30 + [(i, text(3 + i % 5), "b") for i in range(100, 200)] + [(2, text(50), "b"), (2, text(20), "b"), (3, None, "c"), (4, "", None)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, size string")
    size = word_count(F.col("text"))
    out = mixing.repeat_copies(df, "doc_id", "text", size)
    assert out.columns == df.columns
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    targets = {r["source"]: r["target"] for r in mixing.source_targets(df.select("source", size.alias("size"))).collect()}
    assert abs(taken["a"] - targets["a"]) <= 5 and abs(taken["b"] - targets["b"]) <= 3
    each = {r["doc_id"]: r["n"] for r in out.filter("source = 'a'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert each[1] <= 120 and each[None] <= 90
    assert out.filter("doc_id in (3, 4)").count() == 2

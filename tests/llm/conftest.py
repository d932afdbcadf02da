import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, base string, copies string, node string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, wordless and very long texts, repeated rows, columns with clashing names."""
    long = " ".join(f"word{i * 7919 % 5003}" for i in range(30000))
    near = "the quick brown fox jumps over the lazy dog while seven wizards mix potions in a very deep and dark old cellar " * 3
    rows = [
        (1, near + "alpha", "en", "a"),
        (2, near + "beta", "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, None),
        (5, "... !!! 123", "en", "b"),
        (6, long, "de", "c"),
        (6, long, "de", "c"),
        (7, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" und mehr', None, "b"),
        (None, "un texte sans identifiant", "fr", "c"),
        (8, "a b", "fr", ""),
        (9, "\U0001f600 secret: Zx9_kQ7wLm2Rt5Vb \U0001f600", "fr", "a"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "s", "x", None, "1", "n") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def as_table(tmp_path):
    """Folder of tables, for queries that take one."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write

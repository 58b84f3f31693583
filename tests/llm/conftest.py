import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, sha string, fp int"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i * 7919 % 5003}" for i in range(60_000))
    prose = "The quick brown fox jumps over the lazy dog, and the dog, being lazy, lets it pass. " * 8
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, prose), (5, prose), (5, prose), (6, prose.replace(" ", "\n ")),
            (None, prose), (None, None), (7, long), (8, "x"), (9, "a b c"), (10, "Ünïcödé 　 text   here"),
            (11, prose[:300] + "Something else follows here."), (12, "same " * 3000), (12, "other text, same id")]
    return spark.createDataFrame([(i, t, None, "s", None, 1, "x", 2) for i, t in rows], DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")

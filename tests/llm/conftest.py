import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return docs.orderBy("doc_id").collect()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids,
    and extra columns named like columns that operators use inside."""
    base = "the quick onion and the thin line of words that nobody ever wrote before today "
    body = [
        (1, base * 3, "en", "a", 10), (1, base * 3, "en", "a", 10), (2, base * 3, "en", "b", None),
        (3, None, "fr", "a", 0), (4, "", None, "b", 0), (None, base, "en", None, 5),
        (5, "12 34 !!", "de", "c", 3), (6, (base + "\n") * 3000, "en", "c", 1), (7, "\n\n", "en", "a", 2),
        (8, "émile était là où l'été ÉTAIT\nÀ bientôt ﬁn ǅ İ Σς é", "fr", "d", 9),
        (8, "another text under one id", "en", "d", 9), (None, None, None, None, None)]
    df = spark.createDataFrame(body, SCHEMA)
    for name in ("row", "_k1", "line_hash", "text_key", "component_id", "fp", "score", "lang_pred",
                 "n_lines", "key", "h", "part", "ids", "label", "first", "count"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


def pytest_collection_modifyitems(items):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

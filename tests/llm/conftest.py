import pytest

from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing extra columns."""
    long_text = " ".join(f"word{i % 977} and the" for i in range(60_000))
    rows = [(1, "", "en", "a"), (2, None, "en", "a"), (3, long_text, "en", "b"), (4, " \n\t ", None, None),
            (5, "The same text of a few words.", "en", "a"), (6, "the SAME text of a few words.", "en", "a"),
            (6, "the SAME text of a few words.", "en", "a"), (None, "The same text of a few words.", None, "b"),
            (7, "ÄÖÜ é ñ Straße", "de", "b"), (8, "…!?", "de", "b"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.withColumns({c: F.lit("clash") for c in (
        "n_words", "kept", "fp", "fingerprint", "component_id", "n_chars", "topic", "score", "words", "item_id",
        "token", "value", "x", "node", "root", "path", "start", "_text", "_words", "found", "draw", "tokens")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")

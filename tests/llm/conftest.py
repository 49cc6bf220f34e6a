import pytest


@pytest.fixture(scope="session")
def texts(spark, sf):
    """(doc_id, text) of the small documents table."""
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties and clashing column names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, long, "en", None), (3, long, "en", None), (4, "one two three", "de", "b"), (5, "one two three", "de", "b"),
        (None, "no id here at all but some words", "en", "a"), (6, " \t\n ", "en", "a"), (7, "x" * 50_000, "en", "a"), (8, "a\nb\na\nb\nc\n\na\nb", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = ["n_words", "n_lines", "score", "bucket", "spans", "kept", "n_tokens", "_w", "h", "n", "at", "class_id", "label", "_d", "_k", "_key", "_t", "base", "terms", "length", "lo", "run"]
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in extra})

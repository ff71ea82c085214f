import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of every awkward kind, with extra columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "A plain text of a few words.", "en", "a", 28), (1, "A plain text of a few words.", "en", "a", 28), (2, "", "en", "a", 0), (3, None, None, None, None),
        (None, "No key at all here.", "en", "b", 19), (4, "   \n \t ", "en", None, 6), (5, long, "en", "b", len(long)), (6, "日本語 😀 ▁ \u0000 x", "ja", "b", 12),
        (7, "A plain text of a few words.", "en", "c", 28), (None, None, None, None, None), (8, "\n".join(["one line", "two lines"] * 3), "en", "c", 50),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("k", "t", "h", "n", "reason", "bands", "slot", "shard", "block", "gone", "ids", "c"):
        from pyspark.sql import functions as F

        df = df.withColumn(extra, F.lit(extra))
    return df

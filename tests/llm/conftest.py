import pytest

LONG = " ".join(f"w{i % 977}" for i in range(60_000))


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows that any table may hold, beside columns named like those the operators make."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "s0"),
        (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "s0"),
        (2, None, None, None), (3, "", "de", "s1"), (4, " \t\n ", "fr", "s1"), (5, LONG, "en", "s0"),
        (None, "a row that has no id at all", None, "s2"), (6, "é ü ß — 12,5 % \U0001d4b3", "de", None),
        (7, "x", "en", "s0"), (8, "y" * 5000, "en", "s3"), (1, "the same id with another text", "en", "s1"),
    ]
    names = ["score", "_mark", "mark", "key", "fp", "h", "at", "id", "shard", "row", "n", "bin", "_rest", "_low", "count", "toxic"]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    table = table.withColumn("n_chars", F.length("text").cast("long"))
    return table.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)

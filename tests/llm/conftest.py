import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, equal rows, ties and clashing column names."""
    base = "The quick brown fox jumps over the lazy dog near the river bank while seven wise owls watch. "
    rows = [
        (1, base * 3, "en", "a"), (2, base * 3, "en", "a"), (3, base.upper() * 3, "en", "b"), (4, None, "en", "b"), (5, "", None, None),
        (6, "word", "en", "a"), (6, "word", "en", "a"), (7, "two words", "en", "é"), (8, " \t\n ", "en", "a"), (9, "aé日本😀 'll don't 12 ", "xx", None),
        (None, "no id here at all", "en", "a"), (10, "x" * 50_000, "en", "c"), (11, "a b " * 20_000, "en", "c"), (12, base * 2 + "something else entirely", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("chunk", "seq", "key", "bucket", "node", "size", "rest", "n", "label", "root", "id", "words"):
        df = df.selectExpr("*", f"'z' AS {name}")
    for name in ("_", "_dropped", "_id", "a.b", "it`s", "kept_0", "c0", "sequence_id"):
        df = df.withColumn(name, F.lit("z"))
    return df.selectExpr("*", "cast(length(text) as bigint) AS n_chars")


@pytest.fixture(scope="session")
def bulk(spark):
    """3,000 rows of which a third are equal in all columns, a third have no doc_id, and the rest share five doc_ids."""
    text = F.when(F.col("id") < 1000, F.lit("the same words in all of these rows " * 8)).when(F.col("id") < 2000, F.concat(F.lit("no id but some words "), (F.col("id") % 7).cast("string"))).otherwise(F.concat(F.lit("five ids "), (F.col("id") % 50).cast("string")))
    doc_id = F.when(F.col("id") < 1000, F.lit(7)).when(F.col("id") >= 2000, F.col("id") % 5 + 100)
    return spark.range(3000).select(doc_id.cast("long").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("doc_id = -5")

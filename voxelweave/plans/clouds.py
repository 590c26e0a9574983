"""Point clouds over the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import points as P


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, price, discount of line items; no unique key; many equal points."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return P.points(t, "l_quantity", "l_extendedprice / 1000", "l_discount * 100", chunk=F.pmod(F.col("l_orderkey"), F.lit(8)).cast("int"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three numbers of each embedding; key id."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return P.points(t, "embedding[0]", "embedding[1]", "embedding[2]", id="vec_id", chunk="cast(vec_id div 100 as int)")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User, value and hour of events; key id."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.hour("ts").cast("double") + F.minute("ts").cast("double") / F.lit(60.0)
    return P.points(t, "user_id", "value", hour, id="event_id", chunk="cast(event_id div 1000 as int)")


SQL = {
    "items": "SELECT NULL AS id, CAST(l_orderkey % 8 AS INT) AS chunk, CAST(l_quantity AS FLOAT) AS x, CAST(l_extendedprice / 1000 AS FLOAT) AS y, CAST(l_discount * 100 AS FLOAT) AS z FROM lineitem",
    "vectors": "SELECT vec_id AS id, CAST(vec_id // 100 AS INT) AS chunk, embedding[1] AS x, embedding[2] AS y, embedding[3] AS z FROM embeddings",
    "moments": "SELECT event_id AS id, CAST(event_id // 1000 AS INT) AS chunk, CAST(user_id AS FLOAT) AS x, CAST(value AS FLOAT) AS y, "
    "CAST(CAST(hour(ts) AS DOUBLE) + CAST(minute(ts) AS DOUBLE) / CAST(60 AS DOUBLE) AS FLOAT) AS z FROM events",
}
CLOUDS = {"items": items, "vectors": vectors, "moments": moments}

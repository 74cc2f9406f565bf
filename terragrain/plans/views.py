"""Tables of the test data as point clouds: pid, x, y, z, classification, return_number, return_count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Codes of event types.
EVENT_CLASS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}

_events = " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_CLASS.items())
#: The same views for the oracle.
SQL = {
    "li": """SELECT CAST(l_quantity AS DOUBLE) AS x, round(l_discount * 100 + 0.0) + 0.0 AS y, l_extendedprice AS z, l_linenumber AS classification,
      l_linenumber AS return_number, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS return_count FROM lineitem""",
    "evt": f"""SELECT event_id AS pid, CAST(user_id AS DOUBLE) AS x, (epoch_us(ts) - 1704067200000000) / 3600000000.0 AS y, value AS z,
      CASE event_type {_events} END AS classification FROM events""",
    "emb": "SELECT vec_id AS pid, 100.0 * CAST(embedding[1] AS DOUBLE) AS x, 100.0 * CAST(embedding[2] AS DOUBLE) AS y, label + CAST(embedding[3] AS DOUBLE) AS z FROM embeddings",
    "geo": "SELECT c_custkey AS pid, CAST(c_custkey * 7919 % 360 - 180 AS DOUBLE) AS lon, CAST(c_custkey * 104729 % 179 - 89 AS DOUBLE) AS lat, c_acctbal AS h FROM customer",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_points(spark: SparkSession, sf_dir: str, returns: bool = False) -> DataFrame:
    """Dense, with many coincident points. Return counts need the whole order, so they are made on demand."""
    t = _table(spark, sf_dir, "lineitem")
    p = t.select(
        "l_orderkey", F.col("l_quantity").cast("double").alias("x"), (F.round(F.col("l_discount") * 100 + 0.0) + 0.0).alias("y"), F.col("l_extendedprice").alias("z"),
        F.col("l_linenumber").alias("classification"), F.col("l_linenumber").alias("return_number"),
    )
    if returns:
        p = p.withColumn("return_count", F.max("return_number").over(Window.partitionBy("l_orderkey")))
    return p.drop("l_orderkey")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "events")
    codes = F.create_map(*[F.lit(v) for kv in EVENT_CLASS.items() for v in kv])
    hours = (F.unix_micros("ts") - 1704067200000000) / F.lit(3600000000.0)
    ts = F.col("ts").cast("timestamp")
    return t.withColumn("ts", ts).select(F.col("event_id").alias("pid"), F.col("user_id").cast("double").alias("x"), hours.alias("y"), F.col("value").alias("z"), F.try_element_at(codes, F.col("event_type")).alias("classification"))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "embeddings")
    at = lambda k: F.lit(100.0) * F.col("embedding")[k].cast("double")
    return t.select(F.col("vec_id").alias("pid"), at(0).alias("x"), at(1).alias("y"), (F.col("label") + F.col("embedding")[2].cast("double")).alias("z"))


def customer_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return t.select(k.alias("pid"), (k * 7919 % 360 - 180).cast("double").alias("lon"), (k * 104729 % 179 - 89).cast("double").alias("lat"), F.col("c_acctbal").alias("h"))

"""The driver's tables in the roles of rollouts, token matrices, trajectories and text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: the user is the prompt, the event type its source, the id its sample order."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("source"), F.col("user_id").alias("uid"), F.col("event_id").alias("row"), F.col("value").alias("score"), F.get_json_object("props", "$.k").alias("pred"), (F.length("props") + F.pmod("event_id", F.lit(7))).cast("long").alias("length"))


ROLLOUTS = "rollouts AS (SELECT event_type AS source, user_id AS uid, event_id AS row, value AS score, json_extract_string(props, '$.k') AS pred, CAST(length(props) + event_id % 7 AS BIGINT) AS length FROM events)"

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: an order is a sequence; discount, tax and quantity stand for rewards, values and log-probs."""
    l = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    return l.select(F.col("l_orderkey").alias("row"), (F.row_number().over(w) - 1).cast("long").alias("t"), F.col("l_discount").alias("reward"), F.col("l_tax").alias("value"), (F.col("l_returnflag") != "R").cast("int").alias("mask"), (-F.col("l_quantity") / 50).alias("logp"), (-F.col("l_quantity") / 50 + F.col("l_discount") - 0.05).alias("old_logp"), (F.col("l_tax") - 0.04).alias("adv"))


TOKENS = f"tokens AS (SELECT l_orderkey AS row, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1 AS t, l_discount AS reward, l_tax AS value, CAST(l_returnflag <> 'R' AS INTEGER) AS mask, -l_quantity / 50 AS logp, -l_quantity / 50 + l_discount - 0.05 AS old_logp, l_tax - 0.04 AS adv FROM lineitem)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trajectory records: the user is a sample, every event a trajectory of it."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("trajectory_id"), F.col("user_id").alias("parent_id"), (F.col("event_id") % 4).cast("int").alias("suggestion_order"), F.round(F.col("value"), 1).alias("parent_score"), F.col("event_type").alias("stage"), F.col("value").alias("score"), (F.col("event_id") % 5 - 1).cast("int").alias("budget"))


STEPS = "steps AS (SELECT event_id AS trajectory_id, user_id AS parent_id, CAST(event_id % 4 AS INTEGER) AS suggestion_order, round(value, 1) AS parent_score, event_type AS stage, value AS score, CAST(event_id % 5 - 1 AS INTEGER) AS budget FROM events)"

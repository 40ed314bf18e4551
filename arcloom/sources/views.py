"""Graph views over the relational test tables, and the same views as SQL.

Vertices are parts; features of a part are two small numbers. `session_edges` links the items of an order in line
order, with the number of orders as weight.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst with multiplicity: each line item and the next of its order."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.lead("l_partkey").over(w).alias("dst"))
    return rows.where("dst is not null").select(F.col("l_partkey").alias("src"), "dst")


def session_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, w: distinct pairs with their number."""
    return session_rows(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x array<double>, y: parts, two features, and a class of five."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double")).alias("x"),
        (F.col("p_partkey") % 5).cast("int").alias("y"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eid, user_id, item_id, day: what customers bought, in time order. Ids of items begin at 1, so that 0 can pad."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long")
    rows = lines.select(F.col("o_custkey").alias("user_id"), (F.col("l_partkey") + 1).alias("item_id"), day.alias("day"), "l_orderkey", *LINE_ORDER)
    # a number that orders events within a user: day, then order and line; equal rows share it
    return rows


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, first_day, n: distinct interactions of customers and parts."""
    return interactions(spark, sf_dir).groupBy("user_id", "item_id").agg(F.min("day").alias("first_day"), F.count("*").alias("n"))


# ---- the same in SQL, as common table expressions ---------------------------------------------------------------------
SQL_ROWS = """rows_ AS (SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL)"""
SQL_EDGES = SQL_ROWS + """, e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM rows_ GROUP BY src, dst)"""
SQL_NODES = """n AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x0, CAST(p_partkey % 7 AS DOUBLE) AS x1, CAST(p_partkey % 5 AS INTEGER) AS y FROM part)"""
SQL_FEATURES = SQL_NODES + """, f AS (SELECT id, 0 AS pos, x0 AS v FROM n UNION ALL SELECT id, 1, x1 FROM n)"""
SQL_PAIRS = """i AS (SELECT o_custkey AS user_id, l_partkey + 1 AS item_id, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey), p AS (SELECT user_id, item_id, min(day) AS first_day, count(*) AS n FROM i GROUP BY user_id, item_id)"""

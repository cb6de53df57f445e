"""Graphs derived from the star-schema tables; every id is dense and 0-based."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evencut.operators.graph import Graph, normalize


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def order_part(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders, then parts; an edge for each part of an order."""
    orders, parts = _read(spark, sf_dir, "orders").count(), _read(spark, sf_dir, "part").count()
    raw = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + orders).alias("dst"))
    return normalize(raw, orders + parts)


def _bought(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", key).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def cust_supp(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, then suppliers they bought from."""
    c, s = _read(spark, sf_dir, "customer").count(), _read(spark, sf_dir, "supplier").count()
    return normalize(_bought(spark, sf_dir, "l_suppkey").select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + c).alias("dst")), c + s)


def cust_part(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, then parts they bought."""
    c, p = _read(spark, sf_dir, "customer").count(), _read(spark, sf_dir, "part").count()
    return normalize(_bought(spark, sf_dir, "l_partkey").select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + c).alias("dst")), c + p)


def part_part(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts bought in one order."""
    n = _read(spark, sf_dir, "part").count()
    a = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src")).distinct()
    b = a.withColumnRenamed("src", "dst")
    return normalize(a.join(b, "l_orderkey").filter("src < dst").select("src", "dst"), n)

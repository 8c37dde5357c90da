"""Graphs that the star-schema tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = _table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(in_order).alias("dst"), "l_quantity").where("dst is not null")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """From each part to the one on the next line of the same order."""
    return Graph.of(_parts(spark, sf_dir), _steps(spark, sf_dir))


def sparse(spark: SparkSession, sf_dir: str, at_least: float = 48) -> Graph:
    """The steps that start from a line of at least ``at_least`` pieces."""
    return Graph.of(_parts(spark, sf_dir), _steps(spark, sf_dir).where(F.col("l_quantity") >= at_least))


def users(spark: SparkSession, sf_dir: str) -> Graph:
    """From each event's user to the next event's, in order of time.

    The next event is found within minutes; only the last event of each minute looks
    for the first of the next one that has any, so no window spans the table's rows.
    """
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.date_trunc("minute", "ts").alias("minute"))
    inside = Window.partitionBy("minute").orderBy("ts", "event_id")
    event = F.struct("ts", "event_id", "user_id")
    within = events.select(F.col("user_id").alias("src"), F.lead("user_id").over(inside).alias("dst")).where("dst is not null")
    ends = events.groupBy("minute").agg(F.min(event).alias("first"), F.max(event).alias("last"))
    # one row a minute of the table's time span, hour by hour, then one an hour, and so on up to the whole span
    hops = []
    for unit in ("hour", "day", "year"):
        ends = ends.withColumn("unit", F.date_trunc(unit, "minute"))
        step = Window.partitionBy("unit").orderBy("minute")
        hops.append(ends.select(F.col("last.user_id").alias("src"), F.lead("first.user_id").over(step).alias("dst")).where("dst is not null"))
        ends = ends.groupBy(F.col("unit").alias("minute")).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    # at most one row a year is left
    step = Window.partitionBy(F.lit(0)).orderBy("minute")
    hops.append(ends.select(F.col("last.user_id").alias("src"), F.lead("first.user_id").over(step).alias("dst")).where("dst is not null"))
    edges = within
    for hop in hops:
        edges = edges.union(hop)
    return Graph.of(events.select(F.col("user_id").alias("id")).distinct(), edges)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """From the supplier's nation to the customer's, for each line."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    edges = lines.join(suppliers, "l_suppkey").join(orders.join(customers, "c_custkey"), "l_orderkey")
    return Graph.of(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), edges.select("src", "dst"))

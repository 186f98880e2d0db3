"""Graphs out of relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph, from_edges, from_pairs


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bipartite_pairs(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(u, v, wgt): how often two keys meet; left keys are even nodes, right keys odd ones."""
    met = rows.groupBy(F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r")).agg(F.count("*").cast("double").alias("wgt"))
    return met.select((F.col("l") * 2).alias("u"), (F.col("r") * 2 + 1).alias("v"), "wgt")


def part_supplier(spark: SparkSession, folder: str) -> Graph:
    return from_pairs(bipartite_pairs(table(spark, folder, "lineitem"), "l_partkey", "l_suppkey"))


def copurchase_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(u, v, wgt): parts that stand in one order, weight 1. An order has few lines, so its pairs are few; no self-join."""
    baskets = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("p"))
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    return baskets.select(F.explode(pairs).alias("e")).select("e.u", "e.v").distinct().withColumn("wgt", F.lit(1.0))


def copurchase(spark: SparkSession, folder: str) -> Graph:
    return from_pairs(copurchase_pairs(spark, folder))


def copurchase_kept(spark: SparkSession, folder: str) -> Graph:
    """The same as work tables, by one shuffle of the pairs, in both directions."""
    baskets = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("p"))
    pairs = F.flatten(F.transform("p", lambda x: F.transform(F.filter("p", lambda y: y != x), lambda y: F.struct(x.alias("src"), y.alias("dst")))))
    both = baskets.select(F.explode(pairs).alias("e")).select("e.src", "e.dst")
    return from_edges(both.repartition("src").distinct().withColumn("wgt", F.lit(1.0)))


def user_event_type(spark: SparkSession, folder: str) -> Graph:
    events = table(spark, folder, "events")
    kinds = events.select("event_type").distinct().withColumn("kind", F.dense_rank().over(Window.orderBy("event_type")))  # a few kinds
    return from_pairs(bipartite_pairs(events.join(F.broadcast(kinds), "event_type"), "user_id", "kind"))


def nation_region(spark: SparkSession, folder: str) -> Graph:
    return from_pairs(bipartite_pairs(table(spark, folder, "nation"), "n_nationkey", "n_regionkey"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(node_id, vec) of the table of embeddings."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("vec"))

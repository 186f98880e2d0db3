"""Operators on embeddings (node_id, vec array<double>)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unit


def l2_normalise(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("node_id", unit(F.col("vec")).alias("vec"))


def minmax_scale(embeddings: DataFrame) -> DataFrame:
    """Each place scaled to [0, 1] over all rows; a constant place becomes 0. One row of ranges is what is broadcast."""
    v = array_to_vector("vec")
    ranges = embeddings.agg(vector_to_array(Summarizer.min(v)).alias("lo"), vector_to_array(Summarizer.max(v)).alias("hi"))
    scaled = F.zip_with(F.zip_with("vec", "lo", lambda x, y: x - y), F.zip_with("hi", "lo", lambda x, y: x - y), lambda x, r: F.when(r > 0, x / r).otherwise(0.0))
    return embeddings.crossJoin(F.broadcast(ranges)).select("node_id", scaled.alias("vec"))


def project(cmap: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Every fine node takes its coarse node's vector."""
    return cmap.join(embeddings.withColumnRenamed("node_id", "coarse_id"), "coarse_id").select("node_id", "vec")


def select_rows(embeddings: DataFrame, ids: DataFrame) -> DataFrame:
    return embeddings.join(ids.select("node_id").distinct(), "node_id", "left_semi")


def propagate(operator: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(node_id, vec): the sparse operator (src, dst, wgt) times the matrix of vectors, added up inside the JVM."""
    brought = operator.join(embeddings.withColumnRenamed("node_id", "dst"), "dst").select("src", "wgt", array_to_vector("vec").alias("v"))
    # A weighted mean is told for positive weights alone, so the weight goes into the vector's scale.
    return brought.groupBy(F.col("src").alias("node_id")).agg(vector_to_array(Summarizer.sum(F.col("v"), F.col("wgt"))).alias("vec"))


def gcn_operator(nodes: DataFrame, edges: DataFrame, self_share: float = 0.05) -> DataFrame:
    """(src, dst, wgt): the adjacency with self_share times the row sum on its diagonal, then normalised on both sides by the
    root of the new row sums; rows without weight stay 0."""
    rows = edges.groupBy(F.col("src").alias("node_id")).agg(F.sum("wgt").alias("d"))
    with_self = edges.select("src", "dst", "wgt").union(rows.select("node_id", "node_id", F.col("d") * self_share)).groupBy("src", "dst").agg(F.sum("wgt").alias("wgt"))
    # Every row sum grows by the same share, which spares another aggregation.
    d = rows.select("node_id", (F.col("d") * (1 + self_share)).alias("d"))
    out = with_self.join(d.withColumnsRenamed({"node_id": "src", "d": "ds"}), "src").join(d.withColumnsRenamed({"node_id": "dst", "d": "dd"}), "dst")
    return out.select("src", "dst", F.when((F.col("ds") > 0) & (F.col("dd") > 0), F.col("wgt") / F.sqrt(F.col("ds") * F.col("dd"))).otherwise(0.0).alias("wgt"))


def pooled(samples: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(node_id, vec): element-wise largest over the sampled neighbours' vectors; a neighbour drawn twice counts once."""
    pairs = samples.select("node_id", "neighbor").distinct()
    brought = pairs.join(embeddings.withColumnRenamed("node_id", "neighbor"), "neighbor")
    return brought.groupBy("node_id").agg(vector_to_array(Summarizer.max(array_to_vector("vec"))).alias("vec"))

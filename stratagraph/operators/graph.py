"""The graph as two DataFrames, and its basic operators.

nodes(node_id, node_wgt, degree, n_adj), edges(src, dst, wgt): an undirected edge is held in both directions, a self-loop
once. degree adds up weights, self-loops included; n_adj counts the adjacency list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, width


#: Rows of a table of nodes that may be sent to all executors, so that edges meet them where they are.
SENT_ROWS = 2_000_000


@dataclass(frozen=True)
class Graph:
    """Nodes and edges; if `kept` both are work tables, and a node's edges stand together."""

    nodes: DataFrame
    edges: DataFrame
    kept: bool = False


def together(edges: DataFrame) -> DataFrame:
    """Edges dealt by their src, in order: sums and maxima over a node's edges are all but made on the map side."""
    return edges.repartition("src").sortWithinPartitions("src", "dst")


def kept(graph: Graph) -> Graph:
    return graph if graph.kept else Graph(cut(graph.nodes, "nodes"), cut(together(graph.edges), "edges"), True)


def from_edges(edges: DataFrame) -> Graph:
    """The kept graph of edges (src, dst, wgt) in both directions, each once; they are made once."""
    edges = cut(together(edges), "edges")
    return Graph(cut(degrees(edges).select("node_id", F.lit(1.0).alias("node_wgt"), "degree", "n_adj"), "nodes"), edges, True)


def sent(rows: DataFrame) -> DataFrame:
    """A work table of nodes, to be sent to all executors if its rows are few enough."""
    return F.broadcast(rows) if rows.limit(SENT_ROWS + 1).count() <= SENT_ROWS else rows


def symmetrise(pairs: DataFrame) -> DataFrame:
    """(src, dst, wgt) in both directions from undirected (u, v, wgt), each once; repeated pairs are added up."""
    one = pairs.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("wgt").alias("wgt"))
    both = F.when(F.col("u") == F.col("v"), F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")))).otherwise(
        F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    )
    return one.select(F.explode(both).alias("e"), "wgt").select("e.src", "e.dst", "wgt")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.sum("wgt").alias("degree"), F.count("*").alias("n_adj"))


def from_pairs(pairs: DataFrame, vertices: DataFrame | None = None) -> Graph:
    """Graph of undirected (u, v, wgt); `vertices` (node_id) adds those without an edge."""
    edges = symmetrise(pairs)
    nodes = degrees(edges)
    if vertices is not None:
        nodes = vertices.select("node_id").distinct().join(nodes, "node_id", "left").na.fill(0.0, ["degree"]).na.fill(0, ["n_adj"])
    return Graph(nodes.select("node_id", F.lit(1.0).alias("node_wgt"), "degree", "n_adj"), edges)


def canonical(edges: DataFrame) -> DataFrame:
    """Each undirected edge once."""
    return edges.filter("dst >= src")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node_id, dsts, wgts): adjacency lists in the order of ids."""
    pairs = F.sort_array(F.collect_list(F.struct("dst", "wgt")))
    return edges.groupBy(F.col("src").alias("node_id")).agg(pairs.alias("p")).select("node_id", F.col("p.dst").alias("dsts"), F.col("p.wgt").alias("wgts"))


def adjacency(graph: Graph, identity: bool = False) -> DataFrame:
    """(src, dst, wgt) with repeated entries added up, with the identity added if asked."""
    entries = graph.edges.select("src", "dst", "wgt")
    if identity:
        entries = entries.union(graph.nodes.select(F.col("node_id"), F.col("node_id"), F.lit(1.0)))
    return entries.groupBy("src", "dst").agg(F.sum("wgt").alias("wgt"))


def volume(edges: DataFrame) -> DataFrame:
    return edges.agg(F.sum("wgt").alias("volume"))


def normal_weight(wgt: str, ds: str, dd: str, digits: int = 12) -> Column:
    """wgt / sqrt(degree of src * degree of dst), rounded so that ties are ties everywhere."""
    return F.round(F.col(wgt) / F.sqrt(F.col(ds) * F.col(dd)), digits)


def normalised_weights(graph: Graph, digits: int = 12) -> DataFrame:
    """(src, dst, wgt, nw) with the normal weight."""
    d = graph.nodes.select("node_id", "degree")
    d = sent(d) if graph.kept else d
    out = graph.edges.join(d.withColumnsRenamed({"node_id": "src", "degree": "ds"}), "src").join(d.withColumnsRenamed({"node_id": "dst", "degree": "dd"}), "dst")
    return out.select("src", "dst", "wgt", normal_weight("wgt", "ds", "dd", digits).alias("nw"))


def dense_index(ids: DataFrame, column: str) -> DataFrame:
    """(ext_id, node_id): the different ids in their order, numbered from 0 without gaps.

    Range partitions number their own rows; what lies before each comes from the partitions' counts (one row each)."""
    spark = ids.sparkSession
    ordered = ids.select(F.col(column).alias("ext_id")).distinct().repartitionByRange(width(spark), "ext_id").sortWithinPartitions("ext_id")
    # The lower 33 bits of the running id count the rows of a partition.
    placed = cut(ordered.select("ext_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "index")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "part").select("ext_id", (F.col("before") + F.col("at")).alias("node_id"))


def stars(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) for each node that the edges (a, b) link to another: the least node that can be reached.

    Large-star and small-star steps in turn join nodes to the least of their neighbours until all edges are stars, which takes a
    number of rounds that grows with the logarithm of the nodes. Only edges are shuffled, a hub's in parts (a hub has at least
    1 / 4096 of all edges, so there are few, and they are broadcast), and every round is written into the shared folder."""
    spark = edges.sparkSession
    own = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        near = own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(near.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")), name + "-least")
        crowd = max(1000, own.count() // 4096)
        hubs = F.broadcast(least.filter(F.col("n") > crowd).select(F.col("a").alias("hub"), F.least(F.ceil(F.col("n") / crowd), F.lit(width(spark))).cast("int").alias("parts")))
        parts = F.coalesce("parts", F.lit(1))
        roots = least.select("a", F.least("a", "b").alias("m")).join(hubs, F.col("a") == F.col("hub"), "left").select("a", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        dealt = near.join(hubs, F.col("a") == F.col("hub"), "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
        large = dealt.join(roots, ["a", "part"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Now every edge goes from a node to a smaller one, and a node has few.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        own = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct(), name)
        # Stars: a node has one root, and no root has one.
        ends = own.select(F.col("a").alias("x"), F.lit(1).alias("is_a"), F.lit(0).alias("is_b")).union(own.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.sum("is_a").alias("n"), F.max("is_b").alias("root")).filter("n > 1 or n > 0 and root > 0").limit(1).count():
            return own.select(F.col("a").alias("node"), F.col("b").alias("root")).union(own.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, component): the least node that can be reached."""
    found = stars(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), "components")
    return nodes.select("node_id").join(found.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("root", "node_id").alias("component"))


def is_connected(edges: DataFrame, nodes: DataFrame) -> bool:
    return components(edges, nodes).select("component").distinct().limit(2).count() <= 1

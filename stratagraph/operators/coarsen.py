"""Coarse graphs: the map from nodes to groups, the graph of the groups, and the loop over levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .graph import Graph, kept, sent
from .matching import equivalent_exact, equivalent_minhash, heavy_rounds, heavy_sequential


@dataclass(frozen=True)
class Level:
    """A graph and, but for the coarsest, the map to the next one."""

    graph: Graph
    cmap: DataFrame | None
    size: int


def coarse_map(nodes: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, coarse_id) for every node: the least node of its group or pair, itself if it has neither."""
    least = F.least("a", "b")
    named = groups.select("node_id", F.col("group_id").alias("c")).union(pairs.select(F.explode(F.array("a", "b")).alias("node_id"), least.alias("c")))
    return nodes.select("node_id").join(named, "node_id", "left").select("node_id", F.coalesce("c", "node_id").alias("coarse_id"))


def coarse_edges(edges: DataFrame, cmap: DataFrame, keep: bool = False) -> DataFrame:
    """Weights added up by coarse ends; what falls inside a group is its self-loop, both directions of it. With `keep` the map is a
    work table, and a node's edges will stand together."""
    cmap = sent(cmap) if keep else cmap
    a = cmap.withColumnsRenamed({"node_id": "src", "coarse_id": "cs"})
    b = cmap.withColumnsRenamed({"node_id": "dst", "coarse_id": "cd"})
    named = edges.join(a, "src").join(b, "dst").select(F.col("cs").alias("src"), F.col("cd").alias("dst"), "wgt")
    return (named.repartition("src") if keep else named).groupBy("src", "dst").agg(F.sum("wgt").alias("wgt"))


def coarse_nodes(nodes: DataFrame, cmap: DataFrame) -> DataFrame:
    return nodes.join(cmap, "node_id").groupBy(F.col("coarse_id").alias("node_id")).agg(F.sum("node_wgt").alias("node_wgt"), F.sum("degree").alias("degree"))


def coarse_graph(graph: Graph, cmap: DataFrame) -> Graph:
    made = coarse_edges(graph.edges, cmap, graph.kept)
    edges = cut(made.sortWithinPartitions("src", "dst") if graph.kept else made, "coarse-edges")
    lists = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n_adj"))
    nodes = coarse_nodes(graph.nodes, cmap).join(lists, "node_id", "left").select("node_id", "node_wgt", "degree", F.coalesce("n_adj", F.lit(0)).alias("n_adj"))
    return Graph(cut(nodes, "coarse-nodes"), edges, graph.kept)


def coarsen_once(graph: Graph, most: float, parallel: bool = True, threshold: int = 10_000, k: int = 16, size: int | None = None, exact_order: bool = False) -> tuple[DataFrame, Graph]:
    """One level: equivalent nodes first, then heavy edges among the others. Equivalence goes by signatures if `parallel`, else by
    exact neighbour sets. Graphs of more than `threshold` nodes are matched in rounds, smaller ones (all, with `exact_order`) in
    the greedy order, in one task."""
    n = size if size is not None else graph.nodes.count()
    rounds = n > threshold and not exact_order
    groups = cut(equivalent_minhash(graph, k) if parallel else equivalent_exact(graph), "groups")
    free = cut(graph.nodes.select("node_id").join(groups, "node_id", "left_anti"), "free")
    pairs = heavy_rounds(graph, free, most) if rounds else heavy_sequential(graph, free, most)
    cmap = cut(coarse_map(graph.nodes, groups, pairs), "cmap")
    return cmap, coarse_graph(graph, cmap)


def hierarchy(graph: Graph, factor_log2: int = 2, embed_dim: int = 128, parallel: bool = True, threshold: int = 10_000, k: int = 16, double_base: bool = False, exact_order: bool = False) -> list[Level]:
    """Levels from the graph itself to the coarsest: until no more than n / 2 ** factor_log2 nodes are left (one level more with
    `double_base`), or a level no longer shrinks. Raises ValueError if the coarsest is no larger than `embed_dim`."""
    graph = kept(graph)
    size = graph.nodes.count()
    goal = max(1, size // 2**factor_log2)
    most = int(5.0 * size / goal)
    levels: list[Level] = []
    extra = 1 if double_base else 0
    while size > goal or extra:
        extra -= size <= goal
        cmap, coarse = coarsen_once(graph, most, parallel, threshold, k, size, exact_order)
        n = coarse.nodes.count()
        if n == size:
            break
        levels.append(Level(graph, cmap, size))
        graph, size = coarse, n
    if size <= embed_dim:
        raise ValueError(f"the coarsest graph has {size} nodes, not more than the dimension {embed_dim}")
    return [*levels, Level(graph, None, size)]


def report(levels: list[Level]) -> DataFrame:
    """(level, n_nodes, n_edges, node_wgt, wgt): sizes and the sums that coarsening leaves unchanged."""
    out = None
    for i, x in enumerate(levels):
        sums = x.graph.nodes.agg(F.count("*").alias("n_nodes"), F.sum("node_wgt").alias("node_wgt"))
        row = sums.crossJoin(x.graph.edges.agg(F.count("*").alias("n_edges"), F.sum("wgt").alias("wgt"))).select(F.lit(i).cast("long").alias("level"), "n_nodes", "n_edges", "node_wgt", "wgt")
        out = row if out is None else out.union(row)
    return out

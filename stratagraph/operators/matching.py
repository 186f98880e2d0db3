"""Which nodes become one: structural equivalence and heavy edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .graph import Graph, dense_index, normal_weight, normalised_weights, sent

PRIME = 2**31 - 1


def equivalent_exact(graph: Graph, isolated: bool = False) -> DataFrame:
    """(node_id, group_id) of nodes whose neighbour sets are equal, groups of two or more, named by their least node.

    Sets are compared by their size and 128 bits of combined hashes: sums that add up on the map side, so that the
    adjacency list of a hub never stands in one place. Nodes without neighbours stay apart unless `isolated`."""
    parts = [F.bit_xor(F.xxhash64("dst", F.lit(seed))) for seed in (1, 2)]
    keyed = graph.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"), parts[0].alias("x"), parts[1].alias("y"))
    if isolated:
        keyed = keyed.union(graph.nodes.join(keyed, "node_id", "left_anti").select("node_id", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    return groups_of(keyed, ["n", "x", "y"])


def groups_of(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(node_id, group_id) of rows whose keys are equal, two rows or more."""
    heads = keyed.groupBy(*keys).agg(F.min("node_id").alias("group_id"), F.count("*").alias("members")).filter("members > 1").drop("members")
    return keyed.join(heads, keys).select("node_id", "group_id")


def hash_parameters(k: int = 16, seed: int = 123) -> list[tuple[int, int]]:
    """k pairs (a, b), each from prime / 100 up to the prime, told by MD5."""
    least = PRIME // 100
    draw = lambda s: least + int(hashlib.md5(s.encode()).hexdigest(), 16) % (PRIME - least)
    return [(draw(f"{seed}:a:{i}"), draw(f"{seed}:b:{i}")) for i in range(k)]


def signatures(edges: DataFrame, parameters: list[tuple[int, int]]) -> DataFrame:
    """(node_id, n_adj, h1 ... hk): least of (a x + b) mod prime over the neighbours x; a node of one neighbour has it in all places."""
    x = F.pmod(F.col("dst"), F.lit(PRIME))
    least = [F.min(F.pmod(F.lit(a) * x + F.lit(b), F.lit(PRIME))).alias(f"m{i}") for i, (a, b) in enumerate(parameters, 1)]
    found = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n_adj"), F.min("dst").alias("only"), *least)
    places = [F.when(F.col("n_adj") == 1, F.col("only")).otherwise(F.col(f"m{i}")).alias(f"h{i}") for i in range(1, len(parameters) + 1)]
    return found.select("node_id", "n_adj", *places)


def equivalent_minhash(graph: Graph, k: int = 16, seed: int = 123) -> DataFrame:
    """(node_id, group_id) of nodes with equal signatures; not verified, so that near-equal nodes may join."""
    found = signatures(graph.edges, hash_parameters(k, seed))
    return groups_of(found, ["n_adj", *[f"h{i}" for i in range(1, k + 1)]])


def best_neighbours(weighted: DataFrame) -> DataFrame:
    """(src, dst, nw): each node's neighbour by the heaviest normalised edge, ties to the smaller id; self-loops do not count."""
    best = F.max(F.struct("nw", (-F.col("dst")).alias("minus"))).alias("b")
    return weighted.filter("src <> dst").groupBy("src").agg(best).select("src", (-F.col("b.minus")).alias("dst"), F.col("b.nw").alias("nw"))


def _best_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of neighbouring rows (src, dst, nw) of one src the heaviest, ties to the smaller dst (no weight the lightest, NaN the heaviest,
    as Spark has it)."""
    for batch in batches:
        if not len(batch):
            continue
        src, dst = (batch.column(c).to_numpy() for c in ("src", "dst"))
        nw = batch.column("nw").fill_null(-np.inf).to_numpy(zero_copy_only=False)
        nw = np.where(np.isnan(nw), np.inf, nw)
        starts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
        best = nw == np.repeat(np.maximum.reduceat(nw, starts), np.diff(np.r_[starts, len(src)]))
        first = np.minimum.reduceat(np.where(best, dst, np.iinfo(np.int64).max), starts)
        at = np.flatnonzero(best & (dst == np.repeat(first, np.diff(np.r_[starts, len(src)]))))
        at = at[np.r_[True, src[at][1:] != src[at][:-1]]]
        yield batch.take(pa.array(at))


def best_of_runs(weighted: DataFrame) -> DataFrame:
    """Edges (src, dst, nw) that may be the heaviest of their src, where a node's edges stand together: few are left to compare."""
    return weighted.select("src", "dst", "nw").filter("src <> dst").mapInArrow(_best_of_runs, "src long, dst long, nw double")


def mutual_pairs(weighted: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs that are each other's heaviest edge, in the order (weight descending, edge), which all nodes share.

    The heaviest edge of all is mutual, so there is a pair as long as there is an edge."""
    rank = F.struct("nw", (-F.least("src", "dst")).alias("lo"), (-F.greatest("src", "dst")).alias("hi"))
    best = weighted.filter("src <> dst").groupBy("src").agg(F.max(rank).alias("e")).select((-F.col("e.lo")).alias("a"), (-F.col("e.hi")).alias("b"))
    # An edge chosen from both ends comes twice.
    return best.groupBy("a", "b").count().filter("count = 2").select("a", "b")


def _eligible(weighted: DataFrame, weights: DataFrame, most: float) -> DataFrame:
    w = weights.select("node_id", "node_wgt")
    both = weighted.join(w.withColumnsRenamed({"node_id": "src", "node_wgt": "ws"}), "src").join(w.withColumnsRenamed({"node_id": "dst", "node_wgt": "wd"}), "dst")
    return both.filter((F.col("src") != F.col("dst")) & (F.col("ws") + F.col("wd") <= most)).select("src", "dst", "nw")


def greedy(src: np.ndarray, dst: np.ndarray, nw: np.ndarray, nodes: np.ndarray, n_adj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs by visiting nodes in the order (n_adj, node), each taking its heaviest free neighbour (ties to the smaller id)."""
    order = np.lexsort((dst, -nw, src))
    ids = np.unique(np.concatenate([nodes, src, dst]))
    first = np.searchsorted(src[order], ids).tolist() + [len(src)]
    to = np.searchsorted(ids, dst[order]).tolist()
    taken = bytearray(len(ids))
    pairs = []
    for node in np.searchsorted(ids, nodes[np.lexsort((nodes, n_adj))]).tolist():
        if taken[node]:
            continue
        taken[node] = 1  # alone, if no neighbour is free
        for k in range(first[node], first[node + 1]):
            if not taken[to[k]]:
                taken[to[k]] = 1
                pairs.append((node, to[k]))
                break
    found = ids[np.array(pairs, np.int64).reshape(-1, 2)]
    return found[:, 0], found[:, 1]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greedy matching of edges (x, y, nw) and nodes (x, no y, n_adj), all of them."""
    held = [b for b in batches if len(b)]
    x, y, nw = (pa.chunked_array([b.column(c) for b in held], t) for c, t in (("x", pa.int64()), ("y", pa.int64()), ("nw", pa.float64())))
    alone = y.is_null()
    edges, nodes = ([c.filter(keep).to_numpy() for c in (x, y, nw)] for keep in (pc.invert(alone), alone))
    a, b = greedy(*edges, nodes[0], nodes[2])
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _in_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): the greedy matching of edges (src, dst, nw) in the order of nodes (node_id, n_adj), in one task."""
    rows = edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), "nw").union(nodes.select("node_id", F.lit(None).cast("long"), F.col("n_adj").cast("double")))
    return rows.repartition(1).mapInArrow(_matched, "a long, b long")


def _visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greedy matching of edges (src, dst, ...) that come in the order of visits, each node's heaviest first. What is held is one
    byte for each node, by the numbers 0, 1, ... that src and dst are."""
    taken = bytearray()
    for batch in batches:
        src, dst = (batch.column(c).to_numpy() for c in ("src", "dst"))
        if not len(src):
            continue
        taken.extend(bytes(max(0, int(max(src.max(), dst.max())) + 1 - len(taken))))
        held = np.frombuffer(taken, np.uint8)
        # What is taken already stays so; the few others are gone through one by one.
        open_ = np.flatnonzero((held[src] | held[dst]) == 0)
        del held
        a, b = [], []
        for x, y in zip(src[open_].tolist(), dst[open_].tolist(), strict=True):
            if not taken[x] and not taken[y]:
                taken[x] = taken[y] = 1
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def heavy_sequential(graph: Graph, free: DataFrame, most: float) -> DataFrame:
    """(a, b): the greedy matching of the free nodes in the order (n_adj, node_id), in one task, which edges pass through sorted by
    Spark: it holds a byte for each node. Nodes go by their places in that order."""
    own = graph.nodes.join(free, "node_id", "left_semi").select("n_adj", "node_id", "degree", "node_wgt")
    places = cut(dense_index(own.select(F.struct("n_adj", "node_id").alias("visit")), "visit").select("ext_id.node_id", F.col("node_id").alias("place")), "visits")
    nodes = cut(own.join(places, "node_id").select("node_id", "place", "degree", "node_wgt"), "visits")
    ends = [nodes.select(F.col("node_id").alias(c), F.col("place").alias(c + "_at"), F.col("degree").alias("d" + c), F.col("node_wgt").alias("w" + c)) for c in ("src", "dst")]
    both = graph.edges.filter("src <> dst").join(ends[0], "src").join(ends[1], "dst").filter(F.col("wsrc") + F.col("wdst") <= most)
    edges = both.select(F.col("src_at").alias("src"), F.col("dst_at").alias("dst"), F.col("dst").alias("id"), normal_weight("wgt", "dsrc", "ddst").alias("nw"))
    pairs = edges.repartition(1).sortWithinPartitions("src", F.desc("nw"), "id").select("src", "dst").mapInArrow(_visited, "a long, b long")
    names = [places.select(F.col("node_id").alias(x), F.col("place").alias(c)) for c, x in (("a", "x"), ("b", "y"))]
    return cut(pairs, "visited").join(names[0], "a").join(names[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _among(weighted: DataFrame, free: DataFrame) -> DataFrame:
    return weighted.join(free.withColumnRenamed("node_id", "src"), "src", "left_semi").join(free.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def granted_pairs(edges: DataFrame, turn: int) -> DataFrame:
    """(a, b): nodes fall on two sides by a hash of node and turn; one side asks its heaviest neighbour on the other, which grants its
    heaviest request. No node can be in two pairs, and hubs that all would choose hold nobody up."""
    side = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2))
    across = best_of_runs(edges.filter((side("src") == 0) & (side("dst") == 1)))
    asked = across.groupBy("src").agg(F.max(F.struct("nw", (-F.col("dst")).alias("minus"))).alias("e")).select("src", (-F.col("e.minus")).alias("dst"), F.col("e.nw").alias("nw"))
    granted = asked.groupBy("dst").agg(F.max(F.struct("nw", (-F.col("src")).alias("minus"))).alias("e")).select((-F.col("e.minus")).alias("src"), "dst")
    return granted.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))


def _open(graph: Graph, free: DataFrame, most: float) -> DataFrame:
    """Edges (src, dst, nw) that may be matched."""
    if not graph.kept:
        return _among(_eligible(normalised_weights(graph), graph.nodes, most), free)
    own = sent(cut(graph.nodes.join(free, "node_id", "left_semi").select("node_id", "degree", "node_wgt"), "heavy-nodes"))
    ends = [own.select(F.col("node_id").alias(c), F.col("degree").alias("d" + c), F.col("node_wgt").alias("w" + c)) for c in ("src", "dst")]
    both = graph.edges.filter("src <> dst").join(ends[0], "src").join(ends[1], "dst").filter(F.col("wsrc") + F.col("wdst") <= most)
    return both.select("src", "dst", normal_weight("wgt", "dsrc", "ddst").alias("nw"))


def heavy_rounds(graph: Graph, free: DataFrame, most: float, tail: int = 1_000_000) -> DataFrame:
    """(a, b): mutual heaviest pairs and granted requests in turn, among the nodes still free.

    A round is one or two aggregations of the edges left; the heaviest of all is mutual, so every other round has a pair. Once
    `tail` edges or fewer are left (24 bytes each in that task), the greedy order finishes them in one task."""
    edges = cut(_open(graph, free, most), "heavy-edges")
    found, turn = None, 0
    while (left := edges.count()) > tail:
        pairs = cut(granted_pairs(edges, turn) if turn % 2 else mutual_pairs(best_of_runs(edges)), "heavy-pairs")
        found = pairs if found is None else found.union(pairs)
        gone = sent(cut(pairs.select(F.explode(F.array("a", "b")).alias("node")), "heavy-gone"))
        edges = cut(edges.join(gone, edges.src == gone.node, "left_anti").join(gone, edges.dst == gone.node, "left_anti"), "heavy-edges")
        turn += 1
    if left:
        order = graph.nodes.select("node_id", "n_adj").join(edges.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_semi")
        pairs = cut(_in_order(edges, order), "heavy-pairs")
        found = pairs if found is None else found.union(pairs)
    return found if found is not None else graph.nodes.sparkSession.createDataFrame([], "a long, b long")

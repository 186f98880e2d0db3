"""Random walks, context pairs and neighbour samples, all drawn by hashes of what they are for: the same again on any cluster."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pick, uniform
from ..storage import cut


def running_lists(edges: DataFrame) -> DataFrame:
    """(src, dsts, sums): neighbours in the order of ids with running weights, one row for each node; one shuffle."""
    order = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    summed = edges.select("src", "dst", F.sum("wgt").over(order).alias("s"))
    listed = summed.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "s"))).alias("p"))
    return listed.select("src", F.col("p.dst").alias("dsts"), F.col("p.s").alias("sums"))


#: Neighbours that a draw goes through, in the mean.
BIN = 32


def binned_lists(edges: DataFrame) -> DataFrame:
    """(src, bin, bins, total, dsts, sums): as running lists, each cut into bins of equal weight, ceil(n / BIN) for n neighbours.

    A neighbour stands in every bin that its share of the running weights touches, as the same product tells for a draw (it never
    falls as weights grow), so the first neighbour above a draw is in the draw's bin. A hub's list is never copied for a walk."""
    spec = Window.partitionBy("src")
    order = spec.orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    summed = edges.select("src", "dst", F.sum("wgt").over(order).alias("s"), F.coalesce(F.sum("wgt").over(spec.orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    whole = summed.groupBy(F.col("src").alias("node")).agg(F.max_by("s", "dst").alias("total"), F.ceil(F.count("*") / BIN).cast("int").alias("bins"))
    placed = summed.join(whole, F.col("src") == F.col("node")).drop("node")
    spans = F.explode(F.sequence(bin_of(F.col("before"), F.col("total"), F.col("bins")), bin_of(F.col("s"), F.col("total"), F.col("bins"))))
    listed = placed.select("src", "dst", "s", "total", "bins", spans.alias("bin")).groupBy("src", "bin", "bins", "total").agg(F.sort_array(F.collect_list(F.struct("dst", "s"))).alias("p"))
    return listed.select("src", "bin", "bins", "total", F.col("p.dst").alias("dsts"), F.col("p.s").alias("sums"))


def bin_of(at: Column, total: Column, bins: Column) -> Column:
    share = F.when(total > 0, at / total * bins).otherwise(0.0)
    return F.least(F.floor(share).cast("int"), bins - 1)


def random_walks(edges: DataFrame, starts: DataFrame, length: int, seed: int = 123, every: int = 8) -> DataFrame:
    """(walk_id, path) of `length` steps from starts (walk_id, node_id); the next node is drawn in proportion to weights.

    A step is a join to the nodes' total weights and one to the bins of the adjacency lists. A node without neighbours ends its walk."""
    lists = cut(binned_lists(edges), "lists")
    totals = cut(lists.select(F.col("src").alias("node"), "total", "bins").distinct(), "totals")
    lists = lists.select("src", "bin", "dsts", "sums")
    walks = starts.select("walk_id", F.array("node_id").alias("path"), F.col("node_id").alias("at"))
    for step in range(1, length + 1):
        drawn = walks.join(totals, walks["at"] == totals["node"], "left").withColumn("draw", uniform(seed, F.col("walk_id"), step) * F.col("total"))
        drawn = drawn.select("walk_id", "path", "node", "draw", bin_of(F.col("draw"), F.col("total"), F.col("bins")).alias("in_bin"))
        moved = drawn.join(lists, (F.col("node") == F.col("src")) & (F.col("in_bin") == F.col("bin")), "left")
        moved = moved.withColumn("to", F.when(F.col("src").isNotNull(), pick(F.col("dsts"), F.col("sums"), F.col("draw"))))
        walks = moved.select("walk_id", F.when(F.col("to").isNotNull(), F.concat("path", F.array("to"))).otherwise(F.col("path")).alias("path"), F.col("to").alias("at"))
        if step % every == 0:
            walks = cut(walks, "walks")
    return walks.select("walk_id", "path")


def starts_of(nodes: DataFrame, times: int) -> DataFrame:
    """(walk_id, node_id): every node `times` times; the id names both."""
    return nodes.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("turn")).select((F.col("node_id") * times + F.col("turn")).alias("walk_id"), "node_id")


def skipgram_pairs(walks: DataFrame, window: int) -> DataFrame:
    """(center, context, n): how often two nodes stand within `window` places of each other in a walk, by order."""
    near = F.expr(
        f"flatten(transform(path, (c, i) -> transform(filter(sequence(greatest(0, i - {window}), least(size(path) - 1, i + {window})), j -> j <> i), j -> struct(c as center, path[j] as context))))"
    )
    return walks.select(F.explode(near).alias("p")).groupBy("p.center", "p.context").agg(F.count("*").alias("n"))


def neighbour_samples(edges: DataFrame, nodes: DataFrame, size: int, layers: int = 1, seed: int = 123, uniform_draw: bool = False, self_loops: bool = True) -> DataFrame:
    """(layer, node_id, slot, neighbor): `size` draws with replacement for each node and layer, by weight or evenly."""
    own = edges if self_loops else edges.filter("src <> dst")
    own = own.withColumn("wgt", F.lit(1.0)) if uniform_draw else own
    slots = nodes.join(running_lists(own).withColumnRenamed("src", "node_id"), "node_id").withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    drawn = pick(F.col("dsts"), F.col("sums"), uniform(seed, F.col("layer"), F.col("node_id"), F.col("slot")) * F.element_at("sums", -1))
    return slots.select(F.col("layer").cast("long").alias("layer"), "node_id", F.col("slot").cast("long").alias("slot"), drawn.alias("neighbor"))


def drawn_lists(edges: DataFrame, size: int, layers: int = 1, seed: int = 123, uniform_draw: bool = False, self_loops: bool = True) -> DataFrame:
    """(layer, node_id, drawn): the different neighbours that `neighbour_samples` draws for each node with edges. Edges go by node
    through tasks that hold one node's at a time."""
    own = edges if self_loops else edges.filter("src <> dst")
    own = own.select("src", "dst", F.lit(1.0).alias("wgt") if uniform_draw else F.col("wgt"))

    def of(node: int, dsts: np.ndarray, wgts: np.ndarray) -> list[np.ndarray]:
        sums, found = np.cumsum(wgts), []
        for layer in range(layers):
            text = f"{seed}:{layer}:{node}:"
            draws = b"".join([hashlib.md5(f"{text}{slot}".encode()).digest()[:4] for slot in range(size)])
            at = np.frombuffer(draws, ">u4") / 4294967296.0 * sums[-1]
            found.append(np.unique(dsts[np.minimum(np.searchsorted(sums, at, "right"), len(dsts) - 1)]))
        return found

    def table(found: list[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
        parts = [(layer, node, x) for node, sets in found for layer, x in enumerate(sets)]
        ends = np.cumsum([0] + [len(x) for _, _, x in parts])
        drawn = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x for _, _, x in parts]), pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], pa.int64()) for i in (0, 1)] + [drawn], names=["layer", "node_id", "drawn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # of the last node, which may go on
        for batch in batches:
            if not len(batch):
                continue
            src, dst, wgt = (batch.column(c).to_numpy() for c in ("src", "dst", "wgt"))
            starts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
            if held and held[0][0][0] == src[0]:
                starts = starts[1:]
            ends, found = np.r_[starts, len(src)], []
            if held:
                if ends[0]:
                    held.append((src[: ends[0]], dst[: ends[0]], wgt[: ends[0]]))
                if not len(starts):
                    continue
                found.append((int(held[0][0][0]), of(int(held[0][0][0]), *(np.concatenate([h[i] for h in held]) for i in (1, 2)))))
            found += [(int(src[a]), of(int(src[a]), dst[a:b], wgt[a:b])) for a, b in zip(ends[:-2].tolist(), ends[1:-1].tolist(), strict=True)]
            last = starts[-1]
            held = [(src[last:], dst[last:], wgt[last:])]
            if found:
                yield table(found)
        if held:
            yield table([(int(held[0][0][0]), of(int(held[0][0][0]), *(np.concatenate([h[i] for h in held]) for i in (1, 2))))])

    return own.repartition("src").sortWithinPartitions("src", "dst").mapInArrow(run, "layer long, node_id long, drawn array<long>")


def frontiers(samples: DataFrame, batch: DataFrame, layers: int) -> DataFrame:
    """(layer, node_id): the batch as layer 0, then the different neighbours drawn for the layer before."""
    out = [batch.select("node_id").distinct()]
    for k in range(layers):
        drawn = samples.filter(F.col("layer") == k).join(out[-1], "node_id", "left_semi")
        out.append(drawn.select(F.col("neighbor").alias("node_id")).distinct())
    return reduce(DataFrame.union, [x.select(F.lit(k).cast("long").alias("layer"), "node_id") for k, x in enumerate(out)])

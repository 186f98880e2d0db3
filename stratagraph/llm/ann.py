"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Equal vectors are one node (with its least ids, as many as an answer can need), so that a large group of copies costs no more
than one vector. The graph's nearness is the inner product itself, so that long vectors stand near many. The graph starts from
the exact neighbours within blocks, dealt several times: in the order of the sides of random planes that vectors lie on, so that
a block holds vectors of much the same direction, and the blocks of one dealing overlap those of the others. In each round every node brings its neighbours, and those that have it as theirs, together, and each of them learns of its nearest among the others:
neighbours of neighbours, by Spark joins on node ids. The vectors that travel are quantised to bytes; answers are ranked by
the original vectors in double precision.

A search keeps a beam of the best nodes seen for each query and, round by round, joins the best ones not yet opened to their
neighbours, until no query has any or the rounds are over.

Defined results: vectors that are null, zero, or hold null or non-finite numbers, and those of another length than most, take no
part, nor do rows without id; of rows with one id the least vector counts; fewer candidates than asked for are all returned;
ties go to the smaller id; an empty table gives no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import work_path
from .common import cut, grouped, width


@dataclass(frozen=True)
class Descent:
    neighbours: int = 32
    reverse: int = 32
    #: Of each meeting, of how many others, if nearer than those it has, a node learns.
    learnt: int = 12
    block: int = 512
    dealings: int = 4
    rounds: int = 2
    #: Search: beam, nodes opened in a step, steps.
    beam: int = 400
    opened: int = 48
    steps: int = 8


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec array<double>) of the rows that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & good)
    one = found.groupBy("vec_id").agg(F.min("embedding").alias("vec"))
    usual = found.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return one.filter(F.size("vec") == (usual["size"] if usual else 0))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as a float32 scale and one signed byte for each number."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return [s + r.tobytes() for s, r in zip((v.tobytes() for v in scale.astype(np.float32)), q, strict=True)]


def unpack(rows: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(pack(matrix(batch.column("vec"))), pa.binary())], names=["node", "code"])


def _best(owner: np.ndarray, other: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of triples the `most` nearest others of each owner, each once."""
    order = np.lexsort((-near, other, owner))
    owner, other, near = owner[order], other[order], near[order]
    keep = np.r_[True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])] & (owner != other)
    owner, other, near = owner[keep], other[keep], near[keep]
    order = np.lexsort((other, -near, owner))
    owner, other, near = owner[order], other[order], near[order]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
    return owner[place < most], other[place < most], near[place < most]


def _rows(owner: np.ndarray, other: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(other, pa.int64()), pa.array(near, pa.float32())], names=["u", "v", "near"])


def _sided(dealing: int, planes: int = 16):
    """Adds to each node on which sides of a dealing's random planes it lies, the first plane's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = None
        for batch in batches:
            if len(batch):
                x = unpack(batch.column("code").to_pylist())
                if normal is None:
                    normal = np.random.default_rng(dealing).normal(size=(x.shape[1], planes)).astype(np.float32)
                sides = (x @ normal > 0) @ (1 << np.arange(planes - 1, -1, -1))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), pa.array(sides.astype(np.int32))], names=["node", "code", "sides"])

    return run


def _blocks(p: Descent, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        codes: list[bytes] = []

        def out(nodes, codes):
            ids, x = np.array(nodes), unpack(codes)
            near = x @ x.T
            np.fill_diagonal(near, -np.inf)
            k = min(most, len(ids) - 1)
            top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), int)
            return _rows(np.repeat(ids, k), ids[top].reshape(-1), np.take_along_axis(near, top, 1).reshape(-1))

        for batch in batches:
            nodes += batch.column("node").to_pylist()
            codes += batch.column("code").to_pylist()
            while len(nodes) >= 2 * p.block:
                yield out(nodes[: p.block], codes[: p.block])
                nodes, codes = nodes[p.block :], codes[p.block :]
        if nodes:
            yield out(nodes, codes)

    return run


def _meetings(p: Descent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        size = 0

        def out():
            return _rows(*_best(*(np.concatenate([h[i] for h in held]) for i in range(3)), p.neighbours))

        for group in grouped(batches, ["at"]):
            ids, index = np.unique(group.column("node").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            codes = group.column("code").to_pylist()
            x = unpack([codes[i] for i in index])
            near = x @ x.T
            np.fill_diagonal(near, -np.inf)
            k = min(p.learnt, len(ids) - 1)
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            found = np.take_along_axis(near, top, 1)
            who, place = np.nonzero(found > group.column("radius").to_numpy()[index][:, None])
            held.append((ids[who], ids[top[who, place]], found[who, place]))
            k = len(who) / len(ids)
            size += int(len(ids) * k)
            if size > 500_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def nearest_of(edges: DataFrame, owner: str, other: str, most: int) -> DataFrame:
    """The `most` nearest edges of each owner, limited before and after the shuffle."""
    order = Window.partitionBy(owner).orderBy(F.desc("near"), other)
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("rank")


def nn_descent(nodes: DataFrame, p: Descent = Descent()) -> DataFrame:
    """Graph (u, v, near) over nodes (node, code): of each node its `neighbours` nearest found."""
    total = nodes.count()
    most = p.neighbours if total > p.block // 2 else max(total - 1, 1)
    parts = max(1, min(width(nodes.sparkSession), total // p.block))
    if total <= p.block // 2:
        return cut(nodes.repartition(1).mapInArrow(_blocks(p, most), "u long, v long, near float"), "ann-graph")  # complete
    # Blocks dealt anew several times: what only one dealing has brought together is linked to the rest by the others. The last
    # dealing is by chance alone, so that no part of the graph stays apart.
    dealt = []
    for k in range(p.dealings):
        keyed = nodes.mapInArrow(_sided(k), "node long, code binary, sides int") if k + 1 < p.dealings else nodes.withColumn("sides", F.lit(0))
        order = ["sides", F.xxhash64("node", F.lit(k))]
        blocks = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("node", "code")
        dealt.append(blocks.mapInArrow(_blocks(p, most // 2), "u long, v long, near float"))
    graph = cut(reduce(DataFrame.union, dealt).groupBy("u", "v").agg(F.max("near").alias("near")), "ann-graph")
    for _ in range(p.rounds):
        back = nearest_of(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "near"), "u", "v", p.reverse)
        around = graph.select("u", "v").union(back.select("u", "v"))
        around = around.select(F.col("u").alias("at"), F.col("v").alias("node")).union(nodes.select(F.col("node").alias("at"), "node"))
        # With each node goes how near its farthest neighbour is: what is no nearer need not travel.
        farthest = graph.groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"), F.count("*").alias("n"))
        radius = F.when(F.col("n") >= p.neighbours, F.col("near")).otherwise(F.lit(float("-inf"))).cast("float")
        known = nodes.join(farthest, "node", "left").select("node", "code", F.coalesce(radius, F.lit(float("-inf")).cast("float")).alias("radius"))
        brought = around.join(known, "node").select("at", "node", "code", "radius")
        met = brought.repartition(width(nodes.sparkSession), "at").sortWithinPartitions("at", "node").mapInArrow(_meetings(p), "u long, v long, near float")
        pairs = graph.union(met).groupBy("u", "v").agg(F.max("near").alias("near"))
        graph = cut(nearest_of(pairs, "u", "v", p.neighbours), "ann-graph")
    return graph


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each node: its neighbours and their codes."""
    for group in grouped(batches, ["u"]):
        yield pa.RecordBatch.from_arrays([pa.array([group.column("u")[0].as_py()], pa.int64()), pa.array([group.column("v").to_numpy().tobytes()], pa.binary()), pa.array([b"".join(group.column("code").to_pylist())], pa.binary())], names=["u", "others", "codes"])


_SEEN = "query long, code binary, open long, ids binary, near binary"


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nearness of a query to the neighbours of an opened node."""
    for batch in batches:
        near = []
        for code, others, codes in zip(*(batch.column(c).to_pylist() for c in ("code", "others", "codes")), strict=True):
            n = len(others) // 8
            rows = unpack([codes[i * (len(codes) // n) : (i + 1) * (len(codes) // n)] for i in range(n)])
            near.append((rows @ unpack([code])[0]).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array([None] * len(batch), pa.binary()), batch.column("u"), batch.column("others"), pa.array(near, pa.binary())], names=["query", "code", "open", "ids", "near"])


_BEAM = "query long, code binary, ids binary, near binary, opened binary, next array<bigint>"


def _advance(p: Descent):
    """The beam of each query from what it had and what it has seen; the nodes to open next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["query"]):
            code, ids, near, done = None, [], [], []
            for c, i, n, o in zip(*(group.column(x).to_pylist() for x in ("code", "ids", "near", "opened")), strict=True):
                code = c or code
                ids.append(np.frombuffer(i, np.int64))
                near.append(np.frombuffer(n, np.float32))
                done.append(np.frombuffer(o, np.int64) if o else np.zeros(0, np.int64))
            every, first = np.unique(np.concatenate(ids), return_index=True)
            value = np.concatenate(near)[first]
            order = np.lexsort((every, -value))[: p.beam]
            every, value, opened = every[order], value[order], np.concatenate(done)
            following = every[~np.isin(every, opened)][: p.opened]
            yield pa.RecordBatch.from_arrays(
                [pa.array([group.column("query")[0].as_py()], pa.int64()), pa.array([code], pa.binary()), pa.array([every.tobytes()], pa.binary()), pa.array([value.tobytes()], pa.binary()), pa.array([np.concatenate([opened, following]).tobytes()], pa.binary()), pa.array([following.tolist()], pa.list_(pa.int64()))],
                names=["query", "code", "ids", "near", "opened", "next"],
            )

    return run


def greedy_search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, p: Descent = Descent()) -> DataFrame:
    """(query, ids) of queries (query, code, start): the beam of nodes found from each one's start node."""
    spark = nodes.sparkSession
    parts = width(spark)
    both = graph.select("u", "v").union(nearest_of(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "near"), "u", "v", p.reverse // 2).select("u", "v")).distinct()
    coded = both.join(nodes.withColumnRenamed("node", "v"), "v").select("u", "v", "code")
    # Bucketed by node: no step of the search shuffles the graph again.
    name = f"stratagraph_around_{uuid.uuid4().hex}"
    listed = coded.repartition(parts, "u").sortWithinPartitions("u", "v").mapInArrow(_around, "u long, others binary, codes binary")
    listed.write.bucketBy(parts, "u").option("compression", "zstd").option("path", work_path(spark, "ann-around")).saveAsTable(name)
    try:
        return _searched(spark.table(name), queries, parts, p)
    finally:
        spark.sql(f"drop table {name}")


def _searched(around: DataFrame, queries: DataFrame, parts: int, p: Descent) -> DataFrame:
    beams = cut(queries.select("query", "code", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("near"), F.lit(None).cast("binary").alias("opened"), F.array("start").alias("next")), "ann-beam")
    empty = F.lit(b"").cast("binary")
    for _ in range(p.steps):
        opened = beams.select("query", "code", F.explode("next").alias("u"))
        seen = opened.join(around, "u").select("query", "code", "u", "others", "codes").mapInArrow(_look, _SEEN)
        rows = beams.select("query", "code", F.coalesce("ids", empty).alias("ids"), F.coalesce("near", empty).alias("near"), F.coalesce("opened", empty).alias("opened"))
        rows = rows.union(seen.select("query", "code", "ids", "near", F.lit(None).cast("binary").alias("opened")))
        beams = cut(rows.repartition(parts, "query").sortWithinPartitions("query").mapInArrow(_advance(p), _BEAM), "ann-beam")
        if not beams.filter(F.size("next") > 0).limit(1).count():
            break
    return beams.select("query", "ids")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.frombuffer(x, np.int64).tolist() for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(found, pa.list_(pa.int64()))], names=["query", "found"])


def _answer(most: int):
    """Exact scores of a node's candidates, in double precision; each candidate node stands for all its ids. One more than asked
    for is kept, as a query among them is not its own answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["from"]):
            scores = matrix(group.column("vec")) @ np.array(group.column("own")[0].as_py())
            ranked = sorted((-s, i) for s, x in zip(scores.tolist(), group.column("ids").to_pylist(), strict=True) for i in x)[: most + 1]
            found = [[{"vec_id": i, "score": -s + 0.0} for s, i in ranked]]
            kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array([group.column("from")[0].as_py()], pa.int64()), pa.array(found, kind)], names=["from", "found"])

    return run


def nearest(vectors: DataFrame, every: int = 20, most: int = 20, p: Descent = Descent()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every` its `most` nearest other rows."""
    spark = vectors.sparkSession
    rows = cut(usable(vectors), "ann-rows")
    # Copies: one node, named by its least id, with the ids that an answer may hold.
    order = Window.partitionBy("vec").orderBy("vec_id")
    least = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most + 1)
    classes = cut(least.groupBy("vec").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-classes")
    nodes = cut(classes.select("node", "vec").mapInArrow(_packed, "node long, code binary"), "ann-nodes")
    graph = nn_descent(nodes, p)
    asked = rows.filter(F.col("vec_id") % every == 0)
    named = cut(asked.join(classes.select("vec", "node"), "vec").select("vec_id", "node", "vec"), "ann-queries")
    # Copies among the queries ask once.
    different = named.select("node", "vec").dropDuplicates(["node"])
    flat = different.mapInArrow(_packed, "node long, code binary")
    found = greedy_search(graph, nodes, flat.select(F.col("node").alias("query"), "code", F.col("node").alias("start")), p)
    candidates = found.mapInArrow(_ids, "query long, found array<bigint>").select(F.col("query").alias("from"), F.explode(F.array_union("found", F.array("query"))).alias("node"))
    wanted = different.select(F.col("node").alias("from"), F.col("vec").alias("own"))
    scored = candidates.join(classes, "node").join(wanted, "from").select("from", "own", "vec", "ids")
    answers = scored.repartition(width(spark), "from").sortWithinPartitions("from").mapInArrow(_answer(most), "from long, found array<struct<vec_id: bigint, score: double>>")
    each = named.select(F.col("vec_id").alias("query_id"), F.col("node").alias("from")).join(answers, "from")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, most)
    return each.select("query_id", F.posexplode(others).alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


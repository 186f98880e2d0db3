"""Refinement models: trained on the coarsest graph, applied level by level to whole graphs as DataFrame joins.

A coarsest graph of at most `train_nodes` nodes is trained on in one process. On a larger one each step's gradients are partial
sums made by the tasks, added up in tasks again and, as one set of small matrices, on the driver. Applying a model sends nothing
but its weights to the executors; neighbours meet by shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import unit
from ..operators.graph import Graph, together
from ..operators.vectors import gcn_operator, pooled, project, propagate
from ..operators.walks import drawn_lists
from ..storage import cut, width
from .base import Adam, glorot
from .linear import lists, map_rows, matrix, rows_of


#: Bytes of vectors and goals of all nodes that each task of a training may hold.
SENT_LIMIT = 128 << 20
#: The same of the sampling model, whose tasks hold no products beside them.
SAMPLED_LIMIT = 256 << 20
#: Edges that a group of nodes of the convolution model's training has, about.
GROUP_ENTRIES = 2_000_000
#: Edges up to which its first product is made by a join.
JOINED_ENTRIES = 1 << 20


def _unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    return x / size, size


def _through_unit(g: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (g - y * (g * y).sum(1, keepdims=True)) / size


class Stopper:
    """Stops once past `patience` rounds the loss exceeds the mean of that many before."""

    def __init__(self, patience: int) -> None:
        self.patience, self.losses = patience, []

    def done(self, loss: float) -> bool:
        self.losses.append(loss)
        i = len(self.losses) - 1
        return i > self.patience and loss > float(np.mean(self.losses[-self.patience - 1 : -1]))


def _local(embeddings: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(embeddings.select("node_id", "vec").collect())
    return np.array([r.node_id for r in rows]), np.array([r.vec for r in rows])


def _small(graph: Graph, config: Config) -> bool:
    return graph.nodes.limit(config.train_nodes + 1).count() <= config.train_nodes


def summed(rows: DataFrame, f: Callable[[pa.RecordBatch], tuple[float, list[np.ndarray]]], few_tasks: bool = False) -> tuple[float, list[np.ndarray]]:
    """(sum of the numbers, sums of the arrays) that f gives for each batch: every task adds up its own, a few tasks those of the
    others (not if the tasks are few themselves), and the driver what these have made."""

    def pack(total: float, sums: list[np.ndarray]) -> pa.RecordBatch:
        shapes = [list(x.shape) for x in sums]
        return pa.RecordBatch.from_arrays([pa.array([total]), pa.array([np.concatenate([x.ravel() for x in sums]).tobytes()], pa.binary()), pa.array([shapes], pa.list_(pa.list_(pa.int64())))], names=["total", "sums", "shapes"])

    def unpack(raw: bytes, shapes: list[list[int]]) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(x)) for x in shapes])
        return [part.reshape(shape) for part, shape in zip(np.split(np.frombuffer(raw), ends[:-1]), shapes, strict=True)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0.0, None
        for batch in batches:
            if len(batch):
                part, found = f(batch)
                total, sums = total + part, found if sums is None else [x + y for x, y in zip(sums, found, strict=True)]
        if sums is not None:
            yield pack(total, sums)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0.0, None
        for batch in batches:
            for r in batch.to_pylist():
                found = unpack(r["sums"], r["shapes"])
                total, sums = total + r["total"], found if sums is None else [x + y for x, y in zip(sums, found, strict=True)]
        if sums is not None:
            yield pack(total, sums)

    shape = "total double, sums binary, shapes array<array<long>>"
    few = max(1, int(width(rows.sparkSession) ** 0.5))
    parts = rows.mapInArrow(first, shape)
    found = (parts if few_tasks else parts.repartition(few).mapInArrow(again, shape)).collect()
    return sum(r.total for r in found), [reduce(np.add, x) for x in zip(*(unpack(r.sums, r.shapes) for r in found), strict=True)]


_ARRAY = {np.float64: "array<double>", np.float32: "array<float>"}


def _kind(n: int, config: Config) -> type | None:
    """The precision in which vectors of all nodes may be held by every task, if any; sums over nodes are in double precision."""
    size = n * config.embed_dim
    return np.float64 if 16 * size <= SENT_LIMIT else np.float32 if 6 * size <= SENT_LIMIT else None


def _parts(x: np.ndarray) -> Iterator[np.ndarray]:
    return (x[lo : lo + (1 << 16)] for lo in range(0, len(x), 1 << 16))


def _found(vectors: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node ids, their vectors), batch by batch."""
    for b in vectors.select("node_id", "vec").toArrow().to_batches():
        if len(b):
            yield b.column("node_id").to_numpy(), rows_of(b)


def _in_kind(vectors: DataFrame, kind: type) -> np.ndarray:
    """Vectors in the order of their nodes."""
    return matrix(vectors.select("node_id", F.col("vec").cast(_ARRAY[kind]).alias("vec")))[1]


@dataclass
class _Scale:
    """The nodes of a graph in their order, with the roots that its convolution operator has on both sides (0 for rows without weight):
    the operator is turn (edges) turn, and self_weight / (1 + self_weight) of each node's own vector."""

    ids: np.ndarray
    turn: np.ndarray

    @classmethod
    def of(cls, graph: Graph, config: Config) -> _Scale:
        table = graph.nodes.select("node_id", "degree").toArrow()
        order = np.argsort(table["node_id"].to_numpy())
        degree = table["degree"].to_numpy()[order] * (1 + config.self_weight)
        return cls(table["node_id"].to_numpy()[order], np.where(degree > 0, 1 / np.sqrt(np.where(degree > 0, degree, 1.0)), 0.0))

    def places(self, nodes: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_at"):
            span = int(self.ids[-1] - self.ids[0]) + 1
            self._at = None
            if span <= 8 * len(self.ids):
                self._at = np.zeros(span, np.int32)
                self._at[self.ids - self.ids[0]] = np.arange(len(self.ids))
        return np.searchsorted(self.ids, nodes).astype(np.int32) if self._at is None else self._at[nodes - self.ids[0]]


def _run_sums(to: np.ndarray, starts: np.ndarray, wgt: np.ndarray | None, vectors: np.ndarray) -> np.ndarray:
    """Sums of the vectors at `to` (times wgt) over runs that begin at `starts`."""
    ends, out, lo = np.r_[starts, len(to)].astype(np.int64), np.empty((len(starts), vectors.shape[1])), 0
    while lo < len(starts):  # so many runs that their entries are few, one at least
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + 8192, "right")) - 1)
        span = slice(ends[lo], ends[hi])
        part = vectors.take(to[span], axis=0)
        out[lo:hi] = np.add.reduceat(part if wgt is None else part * wgt[span, None], ends[lo:hi] - ends[lo])
        lo = hi
    return out


def _runs(key: np.ndarray, wgt: np.ndarray | None) -> list[np.ndarray]:
    """[heads, numbers of their entries, entries, weights] of sorted keys head * 2^32 + entry, heads of few entries first."""
    head = (key >> 32).astype(np.int32)
    starts = np.flatnonzero(np.r_[True, head[1:] != head[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(key)])
    order = np.argsort(sizes, kind="stable")
    head, sizes = head[starts][order], sizes[order]
    at = np.repeat(starts[order] - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(key))
    return [head, sizes.astype(np.int32), (key[at] & 0xFFFFFFFF).astype(np.int32), np.zeros(0) if wgt is None else wgt[at]]


def _sized_sums(sizes: np.ndarray, to: np.ndarray, wgt: np.ndarray, vectors: np.ndarray, lo: int, hi: int, first: int) -> np.ndarray:
    """Sums of the vectors at `to` (times wgt, if there are weights) over the runs lo to hi, in the order of their sizes; the entries of
    the first begin at `first`."""
    d, out = vectors.shape[1], np.zeros((hi - lo, vectors.shape[1]), vectors.dtype)
    own, buffer = sizes[lo:hi], np.empty((1 << 16, d), vectors.dtype)
    cuts = np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), len(own)].tolist() if len(own) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        k = int(own[a])
        rows, wide = max(1, 8192 // k), min(k, 1 << 16)
        for at in range(a, b, rows):
            n = min(rows, b - at)
            for x in range(0, k, wide):  # a part of a long run
                span = slice(first + x, first + x + min(wide, k - x)) if k > wide else slice(first, first + n * k)
                part = np.take(vectors, to[span], axis=0, out=buffer[: span.stop - span.start], mode="clip")
                part = (part * wgt[span, None] if len(wgt) else part).reshape(n, -1, d)
                out[at : at + n] += np.matmul(np.ones((1, part.shape[1]), part.dtype), part)[:, 0] if k >= 16 else np.einsum("rkd->rd", part)
            first += n * k
    return out


@dataclass
class _Group:
    """The edges of some nodes (places among all): by node and by neighbour, in each those of weight 1 and, with weights, the others.
    Nodes are numbered within the group."""

    nodes: np.ndarray
    near: list[list[np.ndarray]]
    far: list[list[np.ndarray]]
    goals: np.ndarray

    def times(self, vectors: np.ndarray) -> np.ndarray:
        """For each node the sum over its neighbours' vectors."""
        out = np.zeros((len(self.nodes), vectors.shape[1]))
        for at, sizes, to, wgt in self.near:
            out[at] += _sized_sums(sizes, to, wgt, vectors, 0, len(at), 0)
        return out

    def back(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of neighbours, sums over the group's nodes that they are neighbours of), some at a time."""
        for cols, sizes, to, wgt in self.far:
            first = 0
            for lo in range(0, len(cols), 1 << 14):
                hi = min(lo + (1 << 14), len(cols))
                yield cols[lo:hi], _sized_sums(sizes, to, wgt, vectors, lo, hi, first)
                first += int(sizes[lo:hi].sum(dtype=np.int64))


_KINDS = [np.int32, np.int32, np.int32, np.float64]


def _grouped(edges: DataFrame, scale: _Scale, goals: np.ndarray, count: int) -> DataFrame:
    """Packed groups, a row each, of nodes dealt by a hash. Edges of nodes without a scale bring nothing."""
    held, sent = (edges.sparkSession.sparkContext.broadcast(x) for x in (scale, goals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            at, to = (held.value.places(b.column(c).to_numpy()) for c in ("src", "dst"))
            wgt, some = b.column("wgt").to_numpy(), (held.value.turn[at] > 0) & (held.value.turn[to] > 0)
            ones = some & (wgt == 1)
            others = some & ~ones
            key = at.astype(np.int64) << 32 | to
            parts.append((key[ones], key[others], wgt[others]))
        if not sum(len(x) + len(y) for x, y, _ in parts):
            return
        ones, others, wgt = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        nodes = np.unique(np.concatenate([np.unique((x >> 32).astype(np.int32)) for x in (ones, others)]))
        packed = [nodes]
        for far in (False, True):
            for key, w in ((ones, None), (others, wgt)):
                local = np.searchsorted(nodes, (key >> 32).astype(np.int32))
                key = (key & 0xFFFFFFFF) << 32 | local if far else local << 32 | (key & 0xFFFFFFFF)
                if w is None:
                    key.sort()
                else:
                    order = np.argsort(key, kind="stable")
                    key, w = key[order], w[order]
                del local
                packed += _runs(key, w)
        packed.append(sent.value[nodes])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], names=[f"x{i}" for i in range(len(packed))])

    return edges.select("src", "dst", "wgt").repartition(count, "src").mapInArrow(run, ", ".join(f"x{i} binary" for i in range(18)))


def _groups(batch: pa.RecordBatch, kind: type) -> Iterator[_Group]:
    for i in range(len(batch)):
        x = [np.frombuffer(c[i].as_buffer(), k) for c, k in zip(batch.columns, [np.int32, *_KINDS * 4, kind], strict=True)]
        yield _Group(x[0], [x[1:5], x[5:9]], [x[9:13], x[13:17]], x[17].reshape(len(x[0]), -1))


def _first_product(blocks: DataFrame, vectors: np.ndarray, turn: np.ndarray, share: float) -> np.ndarray:
    """The operator times vectors, by groups, in this process."""
    out = np.zeros_like(vectors)
    for x, t in zip(_parts(vectors), _parts(turn), strict=True):
        x *= t[:, None].astype(vectors.dtype)
    sent = blocks.sparkSession.sparkContext.broadcast((vectors, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, turn = sent.value
        for batch in batches:
            for group in _groups(batch, vectors.dtype):
                t = turn[group.nodes][:, None]
                found = (group.times(vectors) * t + share * vectors[group.nodes] / t).astype(vectors.dtype)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (group.nodes, found)], names=["at", "rows"])

    for b in blocks.mapInArrow(run, "at binary, rows binary").toArrow().to_batches():
        for i in range(len(b)):
            out[np.frombuffer(b.column("at")[i].as_buffer(), np.int32)] = np.frombuffer(b.column("rows")[i].as_buffer(), out.dtype).reshape(-1, out.shape[1])
    sent.destroy()
    return out


def _gcn_top(second: np.ndarray, wanted: np.ndarray, w: np.ndarray, n: int) -> tuple[float, np.ndarray, list[np.ndarray]]:
    """Of some rows of the upper layer: (their part of the loss over n rows, gradients of what came in, of the weights)."""
    two = np.tanh(second @ w)
    y, size = _unit_rows(two)
    g = _through_unit(2 * (y - wanted) / n, y, size) * (1 - two * two)
    return float(((y - wanted) ** 2).sum() / n), g @ w.T, [second.T @ g]


@dataclass
class Gcn:
    """Two layers tanh(A H W), rows normalised."""

    config: Config
    weights: list[np.ndarray]
    losses: list[float]

    @classmethod
    def create(cls, config: Config) -> Gcn:
        rng = np.random.default_rng(config.seed)
        return cls(config, [glorot(rng, config.embed_dim, config.embed_dim) for _ in range(2)], [])

    def train(self, graph: Graph, start: DataFrame, target: DataFrame) -> Gcn:
        if not _small(graph, self.config):
            return self._train_apart(graph, start, target)
        c = self.config
        ids, h = _local(start)
        _, wanted = _local(target)
        op = gcn_operator(graph.nodes, graph.edges, c.self_weight).toPandas()
        at, to, w = np.searchsorted(ids, op.src.to_numpy()), np.searchsorted(ids, op.dst.to_numpy()), op.wgt.to_numpy()

        def times(x: np.ndarray) -> np.ndarray:  # the operator is symmetric
            out = np.zeros_like(x)
            np.add.at(out, at, w[:, None] * x[to])
            return out

        adam, stop, first = Adam(self.weights, c.learning_rate), Stopper(c.early_stop), times(h)
        for _ in range(c.refine_epochs):
            one = np.tanh(first @ self.weights[0])
            second = times(one)
            loss, back, (g,) = _gcn_top(second, wanted, self.weights[1], len(h))
            if self._done(loss, stop):
                break
            g1 = times(back) * (1 - one * one)
            adam.step([first.T @ g1 + c.weight_decay * self.weights[0], g + c.weight_decay * self.weights[1]])
        return self

    def _done(self, loss: float, stop: Stopper) -> bool:
        self.losses.append(loss + self.config.weight_decay * sum(float((x * x).sum()) / 2 for x in self.weights))
        return stop.done(self.losses[-1])

    def _train_apart(self, graph: Graph, start: DataFrame, target: DataFrame) -> Gcn:
        """The same steps with every product of the operator a join, and the weights' gradients sums over tasks."""
        c, n = self.config, graph.nodes.count()
        if (kind := _kind(n, c)) is not None:
            return self._train_sent(graph, start, target, kind)
        op = cut(gcn_operator(graph.nodes, graph.edges, c.self_weight), "gcn-operator")
        zero = F.array_repeat(F.lit(0.0), c.embed_dim)

        def times(x: DataFrame) -> DataFrame:
            return start.select("node_id").join(propagate(op, x), "node_id", "left").select("node_id", F.coalesce("vec", zero).alias("vec"))

        adam, stop, first = Adam(self.weights, c.learning_rate), Stopper(c.early_stop), cut(times(start), "gcn-first")
        goal = target.select("node_id", F.col("vec").alias("goal"))
        for _ in range(c.refine_epochs):
            w0, w1 = (w.copy() for w in self.weights)
            second = cut(times(map_rows(first, lambda x, w0=w0: np.tanh(x @ w0))).join(goal, "node_id"), "gcn-second")
            loss, (g,) = summed(second, lambda b, w1=w1: (lambda x: (x[0], x[2]))(_gcn_top(rows_of(b), rows_of(b, "goal"), w1, n)))
            if self._done(loss, stop):
                break

            def back(batches: Iterator[pa.RecordBatch], w1=w1) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if len(b):
                        yield pa.RecordBatch.from_arrays([b.column("node_id"), lists(_gcn_top(rows_of(b), rows_of(b, "goal"), w1, n)[1])], names=["node_id", "vec"])

            pulled = times(second.mapInArrow(back, "node_id long, vec array<double>")).withColumnRenamed("vec", "pull")

            def low(b: pa.RecordBatch, w0=w0) -> tuple[float, list[np.ndarray]]:
                x = rows_of(b)
                return 0.0, [x.T @ (rows_of(b, "pull") * (1 - np.tanh(x @ w0) ** 2))]

            _, (g0,) = summed(first.join(pulled, "node_id"), low)
            adam.step([g0 + c.weight_decay * self.weights[0], g + c.weight_decay * self.weights[1]])
        return self

    def _train_sent(self, graph: Graph, start: DataFrame, target: DataFrame, kind: type) -> Gcn:
        """The same steps with one pass over packed edges for each, in tasks that hold the first product, which does not change, and
        the goals. What is pulled back through the operator is added up by each task for its own rows alone: the first weights'
        gradient is a sum over them, so vectors of nodes never move."""
        c, spark = self.config, graph.nodes.sparkSession
        scale, share = _Scale.of(graph, c), c.self_weight / (1 + c.self_weight)
        ids, turn, n = scale.ids, scale.turn, len(scale.ids)
        entries = graph.edges.count()
        count = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-entries // GROUP_ENTRIES))))
        goals = _in_kind(target, kind)
        alone = sum(float((x.astype(float) ** 2).sum()) for x in _parts(goals[turn == 0])) / n  # rows without entries stay 0
        blocks = cut(_grouped(graph.edges, scale, goals, count), "gcn-blocks")
        del goals
        if entries <= JOINED_ENTRIES:
            low = np.zeros((n, c.embed_dim), kind)
            own, rows = matrix(propagate(gcn_operator(graph.nodes, graph.edges, c.self_weight), start))
            low[np.searchsorted(ids, own)] = rows
        else:
            low = _first_product(blocks, _in_kind(start, kind), turn, share)
        sent = spark.sparkContext.broadcast((low, turn.astype(kind)))
        del low

        def of(batch: pa.RecordBatch, w0: np.ndarray, w1: np.ndarray, seen: dict) -> tuple[float, list[np.ndarray]]:
            low, turn = sent.value
            if "scaled" not in seen:  # of all nodes, once a task
                seen["scaled"] = np.empty_like(low)
                for out, x, t in zip(_parts(seen["scaled"]), _parts(low), _parts(turn), strict=True):
                    np.multiply(np.tanh(x @ w0.astype(kind)), t[:, None], out=out, casting="same_kind")
            scaled, total, g0, g1 = seen["scaled"], 0.0, np.zeros_like(w0), np.zeros_like(w1)
            for group in _groups(batch, kind):
                nodes, t = group.nodes, turn[group.nodes][:, None]
                one = scaled[nodes] / t
                loss, back, (g,) = _gcn_top(group.times(scaled) * t + share * one, group.goals.astype(float), w1, n)
                total, g1 = total + loss, g1 + g
                g0 += low[nodes].T @ (share * back * (1 - one * one))
                for cols, pulled in group.back((back * t).astype(kind)):
                    t = turn[cols][:, None]
                    g0 += low[cols].T @ (pulled * t * (1 - (scaled[cols] / t) ** 2))
            return total, [g0, g1]

        adam, stop = Adam(self.weights, c.learning_rate), Stopper(c.early_stop)
        for _ in range(c.refine_epochs):
            w0, w1 = (w.copy() for w in self.weights)
            loss, (g0, g) = summed(blocks, lambda b, w0=w0, w1=w1, seen={}: of(b, w0, w1, seen), count <= 64) if entries else (0.0, (0.0, 0.0))
            if self._done(loss + alone, stop):
                break
            adam.step([g0 + c.weight_decay * self.weights[0], g + c.weight_decay * self.weights[1]])
        sent.destroy()
        return self

    def _applied_sent(self, graph: Graph, start: DataFrame, kind: type) -> DataFrame:
        """As `apply`, in tasks that hold a layer's vectors of all nodes and add up those of neighbouring edges of one node."""
        c, spark = self.config, graph.nodes.sparkSession
        scale, share = _Scale.of(graph, c), c.self_weight / (1 + c.self_weight)
        edges = (graph.edges if graph.kept else together(graph.edges)).select("src", "dst", "wgt")
        held, own = spark.sparkContext.broadcast(scale), _in_kind(start, kind)
        shape = "node_id long, vec array<double>"
        for k, w in enumerate(self.weights):
            for x, t in zip(_parts(own), _parts(scale.turn), strict=True):
                x[:] = (x @ w.astype(kind)) * t[:, None]
            sent = spark.sparkContext.broadcast(own)

            def brought(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                scale, vectors = held.value, sent.value
                for b in batches:
                    if len(b):
                        src = b.column("src").to_numpy()
                        wgt, starts = b.column("wgt").to_numpy(), np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
                        found = _run_sums(scale.places(b.column("dst").to_numpy()), starts, None if (wgt == 1).all() else wgt, vectors)
                        yield pa.RecordBatch.from_arrays([pa.array(src[starts]), lists(found)], names=["node_id", "vec"])

            def layer(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                scale, vectors = held.value, sent.value
                for b in batches:
                    if len(b):
                        at = scale.places(b.column("node_id").to_numpy())
                        t = scale.turn[at][:, None]
                        found = np.tanh(rows_of(b) * t + share * vectors[at] / np.where(t > 0, t, 1.0))
                        yield pa.RecordBatch.from_arrays([b.column("node_id"), lists(found)], names=["node_id", "vec"])

            sums = edges.mapInArrow(brought, shape).groupBy("node_id").agg(vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec"))
            h = cut(sums.mapInArrow(layer, shape), "gcn-layer")
            if k + 1 < len(self.weights):
                own[:] = 0
                for some, rows in _found(h.select("node_id", F.col("vec").cast(_ARRAY[kind]).alias("vec"))):
                    own[scale.places(some)] = rows
        zero = F.array_repeat(F.lit(0.0), c.embed_dim)
        return start.select("node_id").join(h, "node_id", "left").select("node_id", unit(F.coalesce("vec", zero)).alias("vec"))

    def apply(self, graph: Graph, start: DataFrame) -> DataFrame:
        if (kind := _kind(graph.nodes.count(), self.config)) is not None:
            return self._applied_sent(graph, start, kind)
        op = cut(gcn_operator(graph.nodes, graph.edges, self.config.self_weight), "gcn-operator")
        h = start
        for w in self.weights:
            brought = start.select("node_id").join(propagate(op, h), "node_id", "left")
            zero = F.array_repeat(F.lit(0.0), self.config.embed_dim)
            h = cut(map_rows(brought.select("node_id", F.coalesce("vec", zero).alias("vec")), lambda x, w=w: np.tanh(x @ w)), "gcn-layer")
        return h.select("node_id", unit(F.col("vec")).alias("vec"))


@dataclass
class Block:
    """What the model looks at for some nodes: vectors of all nodes that matter, for each layer the nodes that get a new vector and
    whom they drew (places among `vectors`; `at` counts the layer's nodes, in order), and the goals of the last layer's nodes."""

    vectors: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    goals: np.ndarray


@dataclass
class GraphSage:
    """Layers, as many as `depth`: the largest, place by place, of two ReLU steps over sampled neighbours, beside the node's own vector.

    The steps look at one neighbour at a time, so a node's image is made once and only then brought to those that drew it."""

    config: Config
    weights: list[np.ndarray]
    losses: list[float]

    @classmethod
    def create(cls, config: Config) -> GraphSage:
        rng, d = np.random.default_rng(config.seed), config.embed_dim
        weights = []
        for _ in range(config.depth):
            weights += [glorot(rng, d, d), np.zeros(d), glorot(rng, d, d), np.zeros(d), glorot(rng, d, d), glorot(rng, d, d)]
            weights += [glorot(rng, 2 * d, d), np.zeros(d)] if config.concat else []
        return cls(config, weights, [])

    def layer(self, k: int) -> list[np.ndarray]:
        n = len(self.weights) // self.config.depth
        return self.weights[k * n : (k + 1) * n]

    @staticmethod
    def images(x: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        one = np.maximum(x @ w[0] + w[1], 0)
        return one, np.maximum(one @ w[2] + w[3], 0)

    @staticmethod
    def joined(own: np.ndarray, pool: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        parts = own @ w[4], pool @ w[5]
        both = np.concatenate(parts, axis=1) if len(w) > 6 else parts[0] + parts[1]
        return both, np.tanh(both @ w[6] + w[7] if len(w) > 6 else both)

    def gradients(self, block: Block, n: int) -> tuple[float, list[np.ndarray]]:
        """(the block's part of the sum of squares, its gradients of the mean over n nodes)."""
        h, kept, d = block.vectors, [], self.config.embed_dim
        for k, (nodes, at, to) in enumerate(block.layers):
            w = self.layer(k)
            used, inner = np.unique(to, return_inverse=True)
            one, image = self.images(h[used], w)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
            brought = image[inner]
            pool = np.zeros((len(nodes), d))
            if len(at):
                pool[at[first]] = np.maximum.reduceat(brought, first)
            both, out = self.joined(h[nodes], pool, w)
            y, size = _unit_rows(out)
            kept.append((h, used, inner, one, image, brought, first, pool, both, out, y, size))
            h = h.copy()
            h[nodes] = y
        last = block.layers[-1][0]
        total = float(((h[last] - block.goals) ** 2).sum())
        pull = np.zeros_like(h)
        pull[last] = 2 * (h[last] - block.goals) / n
        found: list[np.ndarray] = []
        for k in reversed(range(len(block.layers))):
            (nodes, at, _), w = block.layers[k], self.layer(k)
            h, used, inner, one, image, brought, first, pool, both, out, y, size = kept[k]
            g = _through_unit(pull[nodes], y, size) * (1 - out * out)
            pull[nodes] = 0
            top = [both.T @ g, g.sum(0)] if len(w) > 6 else []
            inside = g @ w[6].T if len(w) > 6 else g
            gs, gn = (inside[:, :d], inside[:, d:]) if len(w) > 6 else (inside, inside)
            g_image = np.zeros_like(image)
            if len(at):
                # Those that are the largest share what comes down.
                best = brought == pool[at]
                share = np.add.reduceat(best, first, dtype=float)
                each = np.repeat(1 / share, np.diff(np.r_[first, len(at)]), axis=0)
                order = np.argsort(inner, kind="stable")
                those = np.flatnonzero(np.r_[True, inner[order][1:] != inner[order][:-1]])
                g_image = np.add.reduceat((best * each * (gn @ w[5].T)[at])[order], those)
            g2 = g_image * (image > 0)
            g1 = (g2 @ w[2].T) * (one > 0)
            found = [h[used].T @ g1, g1.sum(0), one.T @ g2, g2.sum(0), h[nodes].T @ gs, pool.T @ gn, *top, *found]
            pull[used] += g1 @ w[0].T
            pull[nodes] += gs @ w[4].T
        return total, found

    def drawn(self, graph: Graph) -> DataFrame:
        c = self.config
        return drawn_lists(graph.edges, c.samples, c.depth, c.seed, c.uniform_samples, c.self_loops)

    def samples(self, graph: Graph) -> DataFrame:
        return self.drawn(graph).select("layer", "node_id", F.explode("drawn").alias("neighbor"))

    def train(self, graph: Graph, start: DataFrame, target: DataFrame) -> GraphSage:
        c = self.config
        near = _small(graph, c)
        if near:
            ids, h = _local(start)
            _, wanted = _local(target)
            drawn = self.samples(graph).toPandas().sort_values(["layer", "node_id", "neighbor"])
            lines, rng, n = [], np.random.default_rng(c.seed), len(ids)
            for k in range(c.depth):
                own = drawn[drawn.layer == k]
                lines.append((np.searchsorted(ids, own.node_id.to_numpy()), np.searchsorted(ids, own.neighbor.to_numpy())))

            def steps() -> Iterator[tuple[float, list[np.ndarray]]]:
                order = rng.permutation(n)
                for lo in range(0, n, c.batch_size):
                    batch = np.sort(order[lo : lo + c.batch_size])
                    yield self.gradients(_around(h, lines, wanted, batch), len(batch))
        else:
            n, spark = graph.nodes.count(), graph.nodes.sparkSession
            count, vectors = -(-n // c.block_nodes), [start] if start is target else [start, target]
            held = None
            if 8 * n * c.embed_dim * len(vectors) <= SAMPLED_LIMIT:
                # Vectors of all nodes are sent once, and blocks only say where they stand.
                found = [matrix(x) for x in vectors]
                ids = spark.sparkContext.broadcast(found[0][0])
                held = spark.sparkContext.broadcast([x for _, x in found])
                del found
                tasks = min(count, width(spark), max(spark.sparkContext.defaultParallelism, n * c.samples * c.depth >> 22))
                blocks = cut(self.places(graph, ids, count).coalesce(tasks), "sage-blocks")
                few = tasks <= 32
            else:
                blocks, few = cut(self.blocks(graph, start, target, count), "sage-blocks"), False
            batches = -(-n // c.batch_size)
            epoch = iter(range(c.refine_epochs))

            def steps() -> Iterator[tuple[float, list[np.ndarray]]]:
                turn = next(epoch)
                for batch in range(batches):
                    model = GraphSage(c, [w.copy() for w in self.weights], [])

                    def of(rows: pa.RecordBatch, model=model) -> tuple[float, list[np.ndarray]]:
                        found = [model.gradients(_unpacked(r, c) if held is None else _looked_up(r, held.value), -(-n // batches)) for r in rows.to_pylist()]
                        return sum(x for x, _ in found), [reduce(np.add, g) for g in zip(*(g for _, g in found), strict=True)]

                    yield summed(blocks.filter(F.pmod(F.xxhash64("block", F.lit(turn)), F.lit(batches)) == batch), of, few)

        adam, stop = Adam(self.weights, c.learning_rate), Stopper(c.early_stop)
        for _ in range(c.refine_epochs):
            total = 0.0
            for part, found in steps():
                total += part
                if found:  # a batch of no block
                    adam.step(found)
            self.losses.append(total / max(n, 1))
            if stop.done(self.losses[-1]):
                break
        return self

    def blocks(self, graph: Graph, start: DataFrame, target: DataFrame, count: int) -> DataFrame:
        """One row for each block of nodes, dealt by a hash: all that its gradients need, from its own nodes out to those drawn layer by
        layer."""
        drawn = cut(self.samples(graph), "sage-samples")
        members = target.select("node_id", F.pmod(F.xxhash64("node_id", F.lit(7)), F.lit(count)).cast("int").alias("block"))
        sets = members
        none, empty = F.lit(None).cast("long"), F.lit(None).cast("array<double>")
        rows = [members.join(target, "node_id").select("block", F.lit(-2).alias("layer"), "node_id", none.alias("other"), "vec")]
        for k in reversed(range(self.config.depth)):
            rows.append(sets.select("block", F.lit(2 * k + 1).alias("layer"), "node_id", none.alias("other"), empty.alias("vec")))
            lines = drawn.filter(F.col("layer") == k).drop("layer").join(sets, "node_id")
            rows.append(lines.select("block", F.lit(2 * k).alias("layer"), "node_id", F.col("neighbor").alias("other"), empty.alias("vec")))
            sets = sets.union(lines.select(F.col("neighbor").alias("node_id"), "block")).distinct()
        rows.append(sets.join(start, "node_id").select("block", F.lit(-1).alias("layer"), "node_id", none.alias("other"), "vec"))
        every = reduce(DataFrame.union, rows).repartition(min(count, width(graph.nodes.sparkSession)), "block").sortWithinPartitions("block", "layer", "node_id", "other")
        return every.groupBy("block").applyInArrow(_packed, "block int, ids binary, vectors binary, goals binary, nodes array<binary>, lines array<binary>")

    def places(self, graph: Graph, ids, count: int) -> DataFrame:
        """The same blocks with the places of nodes among all (broadcast) ids in place of vectors and goals."""
        drawn, depth = self.samples(graph), self.config.depth
        drawn = drawn if depth == 1 else cut(drawn, "sage-samples")
        block = F.pmod(F.xxhash64("node_id", F.lit(7)), F.lit(count)).cast("int").alias("block")
        sets = graph.nodes.select(block, "node_id")
        rows = [sets.select("block", F.lit(-1).alias("layer"), "node_id", F.lit(None).cast("long").alias("other"))]
        for k in reversed(range(depth)):
            own = drawn.filter(F.col("layer") == k).select("node_id", F.col("neighbor").alias("other"))
            lines = own.select(block, "node_id", "other") if k + 1 == depth else own.join(sets, "node_id").select("block", "node_id", "other")
            rows.append(lines.select("block", F.lit(k).alias("layer"), "node_id", "other"))
            sets = sets.union(lines.select("block", F.col("other"))).distinct() if k else sets
        every = reduce(DataFrame.union, rows).repartition(min(count, width(graph.nodes.sparkSession)), "block")
        return every.groupBy("block").applyInArrow(lambda rows: _placed(rows, ids.value, depth), "block int, ids binary, nodes array<binary>, lines array<binary>")

    def _applied_here(self, graph: Graph, start: DataFrame) -> DataFrame:
        """As `apply`, in tasks that hold a layer's images of all nodes; each makes its own nodes' vectors from the neighbours drawn."""
        c, spark = self.config, graph.nodes.sparkSession
        shown = "node_id long, vec array<double>"
        drawn = cut(self.drawn(graph), "sage-samples")
        h = start
        for k in range(c.depth):
            w = self.layer(k)
            ids, image = matrix(map_rows(h, lambda x, w=w: GraphSage.images(x, w)[1]))
            held = spark.sparkContext.broadcast((ids, image))
            del ids, image

            def run(batches: Iterator[pa.RecordBatch], w=w, held=held) -> Iterator[pa.RecordBatch]:
                ids, image = held.value
                for batch in batches:
                    if len(batch):
                        own, to = rows_of(batch), batch.column("drawn")
                        counts = pc.list_value_length(to).fill_null(0).to_numpy().astype(np.int64)
                        pool = np.zeros((len(batch), image.shape[1]))
                        if counts.any():
                            some = np.flatnonzero(counts)
                            pool[some] = np.maximum.reduceat(image[np.searchsorted(ids, to.flatten().to_numpy())], (np.cumsum(counts) - counts)[some])
                        yield pa.RecordBatch.from_arrays([batch.column("node_id"), lists(GraphSage.joined(own, pool, w)[1])], names=["node_id", "vec"])

            rows = h.join(drawn.filter(F.col("layer") == k).drop("layer"), "node_id", "left").select("node_id", "vec", "drawn")
            h = rows.mapInArrow(run, shown).select("node_id", unit(F.col("vec")).alias("vec"))
            h = cut(h, "sage-layer") if k + 1 < c.depth else h
        return h

    def apply(self, graph: Graph, start: DataFrame) -> DataFrame:
        c, d = self.config, self.config.embed_dim
        n = graph.nodes.count()
        if 8 * n * d <= SAMPLED_LIMIT:
            return self._applied_here(graph, cut(start, "sage-start"))
        drawn = cut(self.samples(graph), "sage-samples")
        zero, h = F.array_repeat(F.lit(0.0), d), start
        for k in range(c.depth):
            w = self.layer(k)
            images = cut(map_rows(h, lambda x, w=w: GraphSage.images(x, w)[1]), "sage-images")
            pool = pooled(drawn.filter(F.col("layer") == k), images).withColumnRenamed("vec", "pool")
            both = h.join(pool, "node_id", "left").select("node_id", F.concat("vec", F.coalesce("pool", zero)).alias("vec"))
            h = map_rows(both, lambda x, w=w: GraphSage.joined(x[:, :d], x[:, d:], w)[1]).select("node_id", unit(F.col("vec")).alias("vec"))
            h = cut(h, "sage-layer") if k + 1 < c.depth else h
        return h


def _around(vectors: np.ndarray, lines: list[tuple[np.ndarray, np.ndarray]], goals: np.ndarray, batch: np.ndarray) -> Block:
    """The block of some nodes, out of all vectors and the lines (node, drawn) of each layer."""
    nodes, layers = batch, []
    for at, to in reversed(lines):
        own = np.isin(at, nodes)
        layers.append((nodes, np.searchsorted(nodes, at[own]), to[own]))
        nodes = np.union1d(nodes, to[own])
    return Block(vectors, layers[::-1], goals[batch])


def _packed(rows: pa.Table) -> pa.Table:
    """One block's rows as one row of packed arrays."""
    layer, node, other = (rows.column(c).to_numpy() for c in ("layer", "node_id", "other"))
    order = np.lexsort((np.nan_to_num(other.astype(float)), node, layer))
    rows = rows.take(pa.array(order))
    layer, node, other = layer[order], node[order], rows.column("other").fill_null(-1).to_numpy()

    def vectors(of: int) -> np.ndarray:
        part = rows.filter(pa.array(layer == of)).column("vec").combine_chunks()
        return part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)

    ids = node[layer == -1]
    nodes, lines = [], []
    for k in range(int(layer.max()) // 2 + 1):
        own = node[layer == 2 * k + 1]
        mine = layer == 2 * k
        nodes.append(np.searchsorted(ids, own).astype(np.int64).tobytes())
        lines.append(np.stack([np.searchsorted(own, node[mine]), np.searchsorted(ids, other[mine])]).astype(np.int64).tobytes())
    kinds = [("block", pa.int32(), rows.column("block")[0].as_py()), ("ids", pa.binary(), ids.tobytes()), ("vectors", pa.binary(), vectors(-1).tobytes()), ("goals", pa.binary(), vectors(-2).tobytes()), ("nodes", pa.list_(pa.binary()), nodes), ("lines", pa.list_(pa.binary()), lines)]
    return pa.table({name: pa.array([value], kind) for name, kind, value in kinds})


def _placed(rows: pa.Table, ids: np.ndarray, depth: int) -> pa.Table:
    """One block's rows (layer, node_id, other), own nodes as layer -1, as one row of packed places."""
    layer = rows.column("layer").to_numpy()
    node, other = (np.searchsorted(ids, rows.column(c).fill_null(ids[0]).to_numpy()) for c in ("node_id", "other"))
    nodes, layers = np.sort(node[layer == -1]), []
    for k in reversed(range(depth)):
        own = layer == k
        at, to = node[own], other[own]
        order = np.lexsort((to, at))
        layers.append((nodes, np.searchsorted(nodes, at[order]), to[order]))
        nodes = np.union1d(nodes, to)
    packed = lambda x: x.astype(np.int32).tobytes()
    all_nodes = [packed(np.searchsorted(nodes, own)) for own, _, _ in reversed(layers)]
    all_lines = [packed(np.stack([at, np.searchsorted(nodes, to)])) for _, at, to in reversed(layers)]
    kinds = [("block", pa.int32(), rows.column("block")[0].as_py()), ("ids", pa.binary(), packed(nodes)), ("nodes", pa.list_(pa.binary()), all_nodes), ("lines", pa.list_(pa.binary()), all_lines)]
    return pa.table({name: pa.array([value], kind) for name, kind, value in kinds})


def _looked_up(row: dict, vectors: list[np.ndarray]) -> Block:
    """A block of packed places with the vectors and goals (the last of `vectors`) that stand there."""
    ids, layers = np.frombuffer(row["ids"], np.int32), []
    for nodes, lines in zip(row["nodes"], row["lines"], strict=True):
        at, to = np.frombuffer(lines, np.int32).reshape(2, -1)
        layers.append((np.frombuffer(nodes, np.int32), at, to))
    return Block(vectors[0][ids], layers, vectors[-1][ids[layers[-1][0]]])


def _unpacked(row: dict, config: Config) -> Block:
    layers = []
    for nodes, lines in zip(row["nodes"], row["lines"], strict=True):
        at, to = np.frombuffer(lines, np.int64).reshape(2, -1)
        layers.append((np.frombuffer(nodes, np.int64), at, to))
    return Block(np.frombuffer(row["vectors"]).reshape(-1, config.embed_dim), layers, np.frombuffer(row["goals"]).reshape(-1, config.embed_dim))


MODELS = {"graphsage": GraphSage, "gcn": Gcn, "none": Gcn}


def refine_model(config: Config):
    """`none` is the two-layer model with its first weights."""
    if config.refine not in MODELS:
        raise ValueError(f"no refinement {config.refine!r}; there are {sorted(MODELS)}")
    return MODELS[config.refine].create(config)


def refine_down(model, graph: Graph, cmap: DataFrame, coarse: DataFrame) -> DataFrame:
    """Embeddings of a level from those of the next coarser one."""
    return cut(model.apply(graph, project(cmap, coarse)), "refined")

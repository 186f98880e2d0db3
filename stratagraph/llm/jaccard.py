"""Near-duplicate join on word shingles by a MinHash LSH forest with exact verification.

A text's set of five-word shingles gets one signature of `deepest` min-hashes for each tree of the forest. A tree is the prefix
trie of its signatures, read off their sorted order: signatures that share a prefix are neighbours, and how much two
neighbours have in common says where the trie's runs of equal prefixes end.

Each class of equal sets starts with its whole signature in every tree. One tree at a time, its prefix is shortened, that tree
first where a shorter prefix brings the fewest further candidates for what it adds to the recall, until the expected recall of
a pair of similarity `threshold` reaches the target: 1 - product over trees of (1 - threshold ** length). So crowded
prefixes stay long and sparse ones grow short. A node of a trie that any class has come down to is a bucket of all that share
its prefix (the shortest such node counts). Pairs are verified bucket by bucket on whole sets, a pair in the first tree whose
bucket holds both, and buckets of the same members are looked at once.

No pairs are emitted. A bucket is dealt in blocks of bounded size, each pair of blocks is verified in one task, and what comes
out is one row for each class: with how many documents it is linked, and the least class it was joined to; the connected
components of those are the groups. The sets that are compared hold 64-bit hashes of shingles, and classes are told apart by 128
bits; all else is exact.

Defined results: a text of one to four words has one shingle of all; a text without words is only like equal texts, null
and empty being equal; a document's links are all other documents of similarity `threshold` or more, copies included; ids may
repeat or be null (null ids come last when the least is chosen); other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import stars
from .common import cut, grouped, large_binary, passing, spans_to_list, text_steps, texts, width
from .textnum import mix, shingles, word_hashes, word_spans

U64 = np.uint64


@dataclass(frozen=True)
class Forest:
    words: int = 5
    threshold: float = 0.8
    trees: int = 24
    deepest: int = 8
    shallowest: int = 4
    recall: float = 0.9999
    #: Classes and shingles in one block of a bucket, on average.
    block: int = 128
    block_shingles: int = 200_000

    def __post_init__(self) -> None:
        if 1 - (1 - self.threshold**self.shallowest) ** self.trees < self.recall:
            raise ValueError("too few trees, or too long a shortest prefix, for the recall asked for")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles with repetitions, first of each text and their number); a text without words has one hash of its bytes."""
    mapped, starts, ends, first = word_spans(data, offsets)
    found, at = shingles(word_hashes(mapped, starts, ends), first, words)
    bare = np.flatnonzero(np.diff(at) == 0)
    if len(bare):
        own = [np.frombuffer(hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest(), U64)[0] for i in bare]
        found = np.insert(found, at[bare], own)
        at = at + np.searchsorted(bare, np.arange(len(at)), side="left")
    return found, at


def signatures(found: np.ndarray, at: np.ndarray, p: Forest) -> np.ndarray:
    """For each text and tree `deepest` min-hashes, each as 16 bits (big-endian, so that bytes sort as numbers)."""
    rng = np.random.default_rng(20)
    turn = rng.integers(1, 2**32, (p.trees, p.deepest), dtype=np.uint32)
    times = rng.integers(1, 2**32, (p.trees, p.deepest), dtype=np.uint32) | np.uint32(1)
    half = (found >> U64(32)).astype(np.uint32)
    half ^= half >> np.uint32(15)
    out = np.empty((len(at) - 1, p.trees, p.deepest), ">u2")
    for t in range(p.trees):
        for d in range(p.deepest):
            least = np.minimum.reduceat((half ^ turn[t, d]) * times[t, d], at[:-1]) if len(half) else np.zeros(0, np.uint32)
            out[:, t, d] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def prefix_labels(signature: np.ndarray, tree: np.ndarray, shallowest: int) -> np.ndarray:
    """A number for the trie node of each prefix of `shallowest` places or more; signature (rows, deepest)."""
    label = (tree.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    out = np.empty((len(signature), signature.shape[1] - shallowest + 1), U64)
    for d in range(signature.shape[1]):
        label = mix(label * U64(0xD6E8FEB86659FD93) + signature[:, d].astype(U64))
        if d + 1 >= shallowest:
            out[:, d + 1 - shallowest] = label | U64(1)  # 0 is for no bucket
    return out


def prefix_crowds(group: np.ndarray, signature: np.ndarray, shallowest: int) -> np.ndarray:
    """How many of each row's group share its prefixes of `shallowest` places or more. Rows are sorted by group and signature."""
    n, deepest = signature.shape
    same = np.zeros(n, np.int64)  # places in common with the row before, -1 in another group
    if n:
        differ = signature[1:] != signature[:-1]
        same[1:] = np.where(group[1:] == group[:-1], np.where(differ.any(axis=1), differ.argmax(axis=1), deepest), -1)
        same[0] = -1
    out = np.empty((n, deepest - shallowest + 1), np.int64)
    for d in range(shallowest, deepest + 1):
        run = np.cumsum(same < d) - 1
        out[:, d - shallowest] = np.bincount(run)[run] if n else 0
    return out


def shortened(crowds: np.ndarray, p: Forest) -> np.ndarray:
    """Prefix lengths (rows, trees) of crowds (rows, trees, lengths from `shallowest` to `deepest`): shortened one by one, the
    cheapest first, until the expected recall is reached."""
    lengths = np.arange(p.shallowest, p.deepest + 1)
    missed = np.log1p(-(p.threshold**lengths))  # of a pair, by length
    goal = np.log1p(-p.recall)
    at = np.full(crowds.shape[:2], len(lengths) - 1)
    rows = np.arange(len(crowds))
    left = rows
    while len(left):
        own = at[left]
        here, there = own, np.maximum(own - 1, 0)
        more = np.take_along_axis(crowds[left], there[:, :, None], 2)[:, :, 0] - np.take_along_axis(crowds[left], here[:, :, None], 2)[:, :, 0]
        price = np.where(own > 0, more / np.maximum(missed[here] - missed[there], 1e-12), np.inf)
        tree = price.argmin(axis=1)
        at[left, tree] -= 1
        left = left[missed[at[left]].sum(axis=1) > goal + 1e-12]
        left = left[at[left].max(axis=1) > 0]
    return lengths[at]


def _classes(p: Forest, keep_sets: bool):
    """Adds to each row its class (a digest of the shingle set), the set's size and the signatures or, if asked, the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch):
                found, at = shingle_sets(data, offsets, p.words)
                sets = [np.unique(found[at[i] : at[i + 1]]) for i in range(hi - lo)]
                part = batch.slice(lo, hi - lo)
                columns = {c: part.column(c) for c in batch.schema.names if c != "text"}
                columns["class"] = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                columns["size"] = pa.array([len(s) for s in sets], pa.int64())
                if keep_sets:
                    columns["set"] = pa.array([s.tobytes() for s in sets], pa.binary())
                else:
                    columns["signature"] = pa.array([x.tobytes() for x in signatures(found, at, p)], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _climb(p: Forest):
    """Rows of one tree's signatures, sorted within their groups, with how many share each of their prefixes. What a batch cuts off
    or another part of a salted group holds only makes the count, and so the price of a prefix, an estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, _ = large_binary(batch.column("own"))
            own = raw.reshape(len(batch), 2 * p.deepest).view(">u2")
            group = batch.column("key").to_numpy() * np.int64(31) + batch.column("salt").to_numpy()
            crowds = prefix_crowds(group, own, p.shallowest) * batch.column("salts").to_numpy()[:, None]
            lists = spans_to_list(crowds.reshape(-1), np.arange(len(batch) + 1) * crowds.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "tree", "salts", "own")), lists], names=["class", "tree", "salts", "own", "crowds"])

    return run


def _choose(p: Forest):
    """For each class and tree the labels of its prefixes, and the place of the one that it has been shortened to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = batch.column("trees")
            owner = np.repeat(np.arange(len(batch)), np.diff(trees.offsets.to_numpy()))
            flat = trees.flatten()
            tree, salts = flat.field("tree").to_numpy(), flat.field("salts")
            raw, _ = large_binary(flat.field("own"))
            own = raw.reshape(len(owner), 2 * p.deepest).view(">u2")
            wide = p.deepest - p.shallowest + 1
            crowds = np.ones((len(batch), p.trees, wide), np.int64)  # alone where nobody shares even the shortest prefix
            crowds[owner, tree] = flat.field("crowds").flatten().to_numpy().reshape(-1, wide)
            place = (shortened(crowds, p) - p.shallowest)[owner, tree]
            labels = prefix_labels(own, tree, p.shallowest)
            lists = spans_to_list(labels.reshape(-1).view(np.int64), np.arange(len(owner) + 1) * wide, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("class").take(pa.array(owner)), pa.array(tree), salts, lists, pa.array(place.astype(np.int32))], names=["class", "tree", "salts", "labels", "place"])

    return run


def _verify(p: Forest):
    """For each pair of blocks: how many documents each class is linked with, and the least class that it is joined to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["label", "i", "j"]):
            m, tree = len(rows), rows.column("tree")[0].as_py()
            same = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
            if m < 2:
                continue
            block = rows.column("block").to_numpy()
            names = rows.column("class").to_pylist()
            copies = rows.column("n").to_numpy()
            raw, offsets = large_binary(rows.column("set"))
            values, at = raw.view(U64) if raw.flags.c_contiguous else raw.copy().view(U64), offsets // 8
            earlier = np.frombuffer(b"".join(rows.column("buckets").to_pylist()), np.int64).reshape(m, -1)[:, :tree]
            _, inner = np.unique(values, return_inverse=True)
            sizes = np.diff(at)
            flag = np.zeros(int(inner.max()) + 1, bool)
            links, root = np.zeros(m, np.int64), list(range(m))
            own = np.zeros(m, bool)

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            other = np.arange(m) if same else np.flatnonzero(block == rows.column("j")[0].as_py())
            for x in range(m) if same else np.flatnonzero(block == rows.column("i")[0].as_py()):
                z = other[other > x] if same else other
                small, large = np.minimum(sizes[z], sizes[x]), np.maximum(sizes[z], sizes[x])
                z = z[small >= p.threshold * large]
                z = z[~((earlier[z] == earlier[x]) & (earlier[x] != 0)).any(axis=1)]  # verified in that tree
                if not len(z):
                    continue
                flag[inner[at[x] : at[x + 1]]] = True
                shared = np.array([np.count_nonzero(flag[inner[at[y] : at[y + 1]]]) for y in z])
                flag[inner[at[x] : at[x + 1]]] = False
                # Whole numbers: shared / union >= threshold without rounding.
                z = z[shared * 1_000_000 >= round(p.threshold * 1_000_000) * (sizes[z] + sizes[x] - shared)]
                links[x] += copies[z].sum()
                links[z] += copies[x]
                own[z] = True
                own[x] |= len(z) > 0
                for y in z.tolist():
                    a, b = find(int(x)), find(y)
                    root[max(a, b)] = min(a, b)
            linked = np.flatnonzero(own).tolist()
            if linked:
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in linked], pa.binary()), pa.array(links[linked]), pa.array([names[find(x)] for x in linked], pa.binary())], names=["class", "links", "head"])

    return run


def _by_tree(p: Forest):
    """The buckets of each class in the order of trees, as 64-bit numbers; 0 where it is in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found")
            owner, flat = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy())), lists.flatten()
            out = np.zeros((len(batch), p.trees), np.int64)
            out[owner, flat.field("tree").to_numpy()] = flat.field("label").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([x.tobytes() for x in out], pa.binary())], names=["class", "buckets"])

    return run


def forest_buckets(classes: DataFrame, p: Forest) -> DataFrame:
    """(class, tree, label) of classes (class, signature): the bucket of each class in each tree where others share one with it."""
    spark = classes.sparkSession
    wide = 2 * p.deepest
    own = F.expr(f"substring(signature, tree * {wide} + 1, {wide})")
    places = classes.select("class", "signature", F.explode(F.sequence(F.lit(0), F.lit(p.trees - 1))).alias("tree")).select("class", "tree", own.alias("own"))
    places = places.withColumn("key", F.xxhash64("tree", F.substring("own", 1, 2 * p.shallowest)))
    met = cut(places.groupBy("key").agg(F.count("*").alias("met")).filter("met > 1"), "jaccard-met")
    # Keys of so many classes that they are dealt to several tasks: 4,096 at most, by how many places there are.
    crowd = max(256, classes.count() * p.trees // 4096)
    hot = {r.key: -(-r.met // crowd) for r in met.filter(F.col("met") > crowd).collect()}
    salts = spark.createDataFrame(list(hot.items()) or [(0, 1)], "key long, hot int")
    salted = lambda df: df.join(F.broadcast(salts), "key", "left").withColumn("salts", F.coalesce("hot", F.lit(1)))
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    salt = F.pmod(F.xxhash64("class", F.lit(9)), F.col("salts")).cast("int")
    shared = salted(places).withColumn("salt", salt).join(spread(salted(met)).select("key", "salt"), ["key", "salt"])
    # Sorted by prefix the signatures of a tree are its trie.
    climbed = shared.repartition(width(spark), "key", "salt").sortWithinPartitions("key", "salt", "own").mapInArrow(_climb(p), "class binary, tree int, salts int, own binary, crowds array<long>")
    chosen = climbed.groupBy("class").agg(F.collect_list(F.struct("tree", "salts", "own", "crowds")).alias("trees"))
    chosen = cut(chosen.mapInArrow(_choose(p), "class binary, tree int, salts int, labels array<long>, place int"), "jaccard-prefixes")
    opened = spread(chosen.select(F.expr("labels[place]").alias("label"), "salts").distinct()).select("label", "salt")
    nodes = chosen.select("class", "tree", "salts", F.posexplode("labels").alias("length", "label")).withColumn("salt", salt)
    shortest = nodes.join(opened, ["label", "salt"]).groupBy("class", "tree").agg(F.min(F.struct("length", "label")).alias("b"))
    return cut(shortest.select("class", "tree", "b.label"), "jaccard-buckets")


def near_classes(docs: DataFrame, p: Forest = Forest()) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (doc_id, hash, class) of all documents, and for each class with more than one document or a link
    (class, n, least, links, first): its documents, its least one, the documents of other classes that each is linked with, and
    the least document of all that links join. `least` and `first` are (none, doc_id, hash) with hash that of the text."""
    spark = docs.sparkSession
    with passing() as keep:
        own = texts(docs).withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
        rows = keep(cut(own.mapInArrow(_classes(p, False), "doc_id long, hash long, class binary, size long, signature binary"), "jaccard-rows"))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("least")
        classes = cut(rows.groupBy("class").agg(F.count("*").alias("n"), least, F.first("size").alias("size"), F.first("signature").alias("signature")), "jaccard-classes")
        buckets = forest_buckets(classes, p)
        # Of buckets of the same members the first tree's is kept: a pair's first bucket is never another.
        counted = buckets.join(classes.select("class", "size"), "class").groupBy("label").agg(F.min("tree").alias("tree"), F.count("*").alias("met"), F.sum("size").alias("shingles"), *(F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"x{k}") for k in (1, 2)))
        kept = counted.filter("met > 1").groupBy("met", "x1", "x2").agg(F.min(F.struct("tree", "label", "shingles")).alias("b"))
        kept = kept.select("b.label", F.greatest(F.ceil(F.col("met") / p.block), F.ceil(F.col("b.shingles") / p.block_shingles)).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("class", "label"), F.col("blocks")).cast("int")
        members = buckets.join(kept, "label").withColumn("block", block).groupBy("class").agg(F.collect_list(F.struct("label", "tree", "blocks", "block")).alias("places"))
        every = buckets.groupBy("class").agg(F.collect_list(F.struct("tree", "label")).alias("found")).mapInArrow(_by_tree(p), "class binary, buckets binary")
        keyed = members.join(every, "class").join(classes.select("class", "n", "least"), "class").select(F.col("class").alias("expected"), "n", "places", "buckets", F.col("least.doc_id").alias("doc_id"), F.col("least.hash").alias("hash"))
        # The sets of those that meet, from the text of one document of each class.
        with_text = keyed.join(own.withColumnRenamed("doc_id", "id").withColumnRenamed("hash", "text_hash"), (F.col("hash") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("expected", "n", "places", "buckets", "text")
        shape = "expected binary, n long, places array<struct<label: bigint, tree: int, blocks: int, block: int>>, buckets binary, class binary, size long, set binary"
        sets = with_text.mapInArrow(_classes(p, True), shape).filter(F.col("class") == F.col("expected")).dropDuplicates(["class"])
        dealt = sets.select("class", "n", "buckets", "set", F.explode("places").alias("b")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1)))
        dealt = dealt.select("b.label", "b.tree", F.least("b.block", "other").alias("i"), F.greatest("b.block", "other").alias("j"), F.col("b.block").alias("block"), "class", "n", "buckets", "set")
        keys = ["label", "i", "j"]
        verified = cut(dealt.repartition(width(spark), *keys).sortWithinPartitions(*keys, "class").mapInArrow(_verify(p), "class binary, links long, head binary"), "jaccard-links")
        joined = stars(verified.select(F.col("class").alias("a"), F.col("head").alias("b")), "jaccard-groups").withColumnsRenamed({"node": "class"})
        links = verified.groupBy("class").agg(F.sum("links").alias("links"))
        plain = classes.select("class", "n", "least")
        grouped_ = plain.join(joined, "class").join(links, "class")
        first = grouped_.groupBy("root").agg(F.min("least").alias("first"))
        linked = grouped_.join(first, "root").select("class", "n", "least", "links", "first")
        copies = plain.filter("n > 1").join(joined, "class", "left_anti").select("class", "n", "least", F.lit(0).cast("long").alias("links"), F.col("least").alias("first"))
        return rows.select("doc_id", "hash", "class"), keep(cut(linked.unionByName(copies), "jaccard-result"))


def near_duplicates(docs: DataFrame, p: Forest = Forest()) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links, group_id) of every document: the least document of equal shingle sets, how many
    those are, all documents that it is linked with, and the least document that links join it to."""
    rows, classes = near_classes(docs, p)
    found = rows.join(classes, "class", "left")
    return found.select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"), F.coalesce("n", F.lit(1)).alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("n_links"), F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("group_id"),
    )


def keep_one(docs: DataFrame, p: Forest = Forest()) -> DataFrame:
    """The rows of `docs`, all columns, less all but one of each group of near duplicates: its least document stays."""
    names = docs.columns
    hashed = docs.withColumn("stratagraph_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn("stratagraph_id", F.col("doc_id").cast("long"))
    with passing() as keep:
        rows, classes = near_classes(docs, p)
        # What goes: the least document of a class stays unless another class's is smaller; then of equal rows one stays.
        found = rows.join(classes.select("class", F.col("first.doc_id").alias("keep_id"), F.col("first.hash").alias("keep_hash")), "class")
        others = found.filter(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("hash") == F.col("keep_hash"))))
        gone = keep(cut(others.select("doc_id", "hash").distinct(), "jaccard-gone"))
        repeated = rows.groupBy("doc_id", "hash").count().filter("count > 1").limit(1).count()
    on = hashed["stratagraph_id"].eqNullSafe(gone["doc_id"]) & (hashed["stratagraph_hash"] == gone["hash"])
    kept = hashed.join(gone, on, "left_anti")
    if repeated:  # wholly repeated rows
        kept = kept.dropDuplicates(["stratagraph_hash", "stratagraph_id"])
    return kept.select(*[F.col(f"`{c}`") for c in names])

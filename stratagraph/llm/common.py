"""What the operators share: reading, work tables in the shared folder, Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, passing, shared_dir, width  # noqa: F401

#: Bytes of text that one vectorised step takes at once (a longer text is a step of its own).
CHUNK = 1 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that no further column of the input can clash with a result."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def large_binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (from 0) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most `limit` bytes together, or one row."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to
        at = to


def text_steps(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of each bounded part of a batch."""
    data, offsets = large_binary(batch.column(name))
    for lo, hi in chunks(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def spans_to_list(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, type=kind))


def labelled_sample(labels: DataFrame, label: str, keep: Column, per_class: int) -> DataFrame:
    """(doc_id, label, weight): at most `per_class` rows of each class 0 and 1, in the order of a hash of the id.

    A document of several labels has the largest. The weight is the class's share that the sample stands for."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    parts = None
    sizes = {r.label: r["count"] for r in one.filter("label in (0, 1)").groupBy("label").count().collect()}
    total = sum(min(n, per_class) for n in sizes.values())
    for value, n in sorted(sizes.items()):
        weight = n / min(n, per_class) * total / sum(sizes.values())
        part = one.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).withColumn("weight", F.lit(float(weight)))
        parts = part if parts is None else parts.unionByName(part)
    return parts if parts is not None else one.withColumn("weight", F.lit(1.0)).limit(0)


def sample_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label, weight) of the sampled documents, one row for each id: of several the least text. The sample's rows
    are bounded, so it is broadcast."""
    found = texts(docs).join(F.broadcast(sample), "doc_id")
    return found.groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text")).select("doc_id", "text", "label", "weight")


def one_task(df: DataFrame, *order: str) -> DataFrame:
    """A bounded sample in one task, in a fixed order."""
    return df.repartition(1).sortWithinPartitions(*order)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of equal keys, from batches sorted by them."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        at = 0
        while at < len(values):
            to = at + 1
            while to < len(values) and values[to] == values[at]:
                to += 1
            if waiting and values[at] != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(at, to - at))
            last, at = values[at], to
    if waiting:
        yield pa.Table.from_batches(waiting)

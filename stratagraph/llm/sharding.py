"""Contiguous shards of near equal bytes from global prefix sums.

The rows are put in a global order by range partitions, each partition adds up its own sizes, the partitions' totals
(one row each) are added up, and a row goes to the shard in whose equal share of all bytes its middle byte lies.
Only ids, sizes and checksums are shuffled, never a text.

Defined results: null text has size 1 (no bytes, plus 1) and checksum 0; empty text likewise; a null doc_id sorts first;
rows of equal doc_id follow each other by checksum and size, and wholly repeated rows each keep their own place; an empty
table gives no row. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, texts, width


def _local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size, rows = 0, 0
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        before = size + np.cumsum(sizes) - sizes
        at = np.arange(rows, rows + len(sizes))
        size, rows = size + int(sizes.sum()), rows + len(sizes)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(at)], names=[*batch.schema.names, "before", "at"])


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) for all documents, in `shards` contiguous shards."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = texts(docs).select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    placed = rows.repartitionByRange(width(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    sums = cut(placed.mapInArrow(_local_sums, "doc_id long, size long, text_crc32 long, part int, before long, at long"), "shard-sums")
    # One row for each partition: the totals, and what lies before it.
    totals = sums.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    middle = F.col("bytes_before") + F.col("before") + F.expr("size div 2")
    cutoff = F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.col("all_bytes").cast("decimal(38,0)")), F.lit(shards - 1)).cast("int")
    # At most as many rows as range partitions.
    put = sums.join(F.broadcast(starts), "part").select("doc_id", "size", "text_crc32", cutoff.alias("shard"), (F.col("rows_before") + F.col("at")).alias("row"))
    heads = put.groupBy("shard").agg(F.min("row").alias("head"))  # at most one row for each shard
    return put.join(F.broadcast(heads), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("head")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

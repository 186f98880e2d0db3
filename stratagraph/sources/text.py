"""Graphs, labels and embeddings as text files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph, dense_index, from_pairs

FORMATS = ("edgelist", "metis")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, in whatever store Spark reads the path from."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own)


def data_path(name: str, fmt: str, root: str = "./dataset") -> str:
    return f"{root}/{name}.{fmt}"


def read_graph(spark: SparkSession, path: str, fmt: str) -> tuple[Graph, DataFrame | None]:
    """The graph and, if its ids were not 0 ... n - 1, the map (ext_id, node_id)."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {FORMATS}")
    return read_edge_list(spark, path) if fmt == "edgelist" else (read_metis(spark, path), None)


def _numbers(column: str = "value"):
    return F.split(F.trim(column), r"\s+")


def read_edge_list(spark: SparkSession, path: str) -> tuple[Graph, DataFrame | None]:
    """Lines `u v [w]`, u <= v, an edge on one line; weight 1 where none is given. Repeated edges are added up. Other lines are an
    error. Ids with gaps are numbered anew in their order."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(_numbers().alias("p"))
    pairs = lines.select(F.col("p")[0].cast("long").alias("u"), F.col("p")[1].cast("long").alias("v"), F.when(F.size("p") > 2, F.element_at("p", 3).cast("double")).otherwise(1.0).alias("wgt"))
    if pairs.filter("u > v").limit(1).count():
        raise ValueError("an edge whose first id is larger than its second")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id"))
    top, count = ids.agg(F.max("id"), F.count_distinct("id")).first()
    if top is None or top + 1 == count:
        return from_pairs(pairs), None
    index = dense_index(ids, "id")
    named = pairs.join(index.withColumnsRenamed({"ext_id": "u", "node_id": "a"}), "u").join(index.withColumnsRenamed({"ext_id": "v", "node_id": "b"}), "v")
    return from_pairs(named.select(F.col("a").alias("u"), F.col("b").alias("v"), "wgt")), index


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one file, from 0: lines are counted by block, and each block starts after those before it."""
    raw = spark.read.text(path).select("value", F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = raw.groupBy("block").agg(F.min("id").alias("first"), F.count("*").alias("n"))  # one row for each split of the file
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return raw.join(F.broadcast(before), "block").select((F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def read_metis(spark: SparkSession, path: str) -> Graph:
    """Header `n m [fmt]`, then a line of neighbours (1-based; with weights if fmt is 1) for each node; an edge stands on both
    lines, an empty line is a node without neighbours, lines with % are comments."""
    lines = numbered_lines(spark, path).filter(~F.col("value").startswith("%"))
    first = lines.orderBy("line").first()
    head = first["value"].split()
    n, weighted = int(head[0]), len(head) > 2 and int(head[2]) == 1
    rows = lines.filter(F.col("line") > first["line"])
    index = dense_index(rows, "line").filter(F.col("node_id") < n)
    listed = rows.join(index, rows["line"] == index["ext_id"]).select("node_id", F.filter(_numbers(), lambda x: x != "").alias("p"))
    step = 2 if weighted else 1
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / step).cast("int") - 1), lambda i: F.struct((F.get("p", i * step).cast("long") - 1).alias("dst"), (F.get("p", i * step + 1).cast("double") if weighted else F.lit(1.0)).alias("wgt")))
    some = listed.filter(F.size("p") > 0).select("node_id", F.explode(pairs).alias("e")).select(F.col("node_id").alias("src"), "e.dst", "e.wgt")
    edges = some.groupBy("src", "dst").agg(F.sum("wgt").alias("wgt"))
    degree = edges.groupBy(F.col("src").alias("node_id")).agg(F.sum("wgt").alias("degree"), F.count("*").alias("n_adj"))
    nodes = index.select("node_id").join(degree, "node_id", "left").select("node_id", F.lit(1.0).alias("node_wgt"), F.coalesce("degree", F.lit(0.0)).alias("degree"), F.coalesce("n_adj", F.lit(0)).alias("n_adj"))
    return Graph(nodes, edges)


def read_truth(spark: SparkSession, path: str, index: DataFrame | None = None, first: int = 0) -> DataFrame:
    """(node_id, y array<int>) from lines `id y1 y2 ...`; ids are mapped by `index`, or count from `first`."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(_numbers().alias("p"))
    y = F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("int"))
    out = rows.select((F.col("p")[0].cast("long")).alias("ext_id"), y.alias("y"))
    if index is not None:
        return out.join(index, "ext_id").select("node_id", "y")
    return out.select((F.col("ext_id") - first).alias("node_id"), "y")


def embedding_lines(embeddings: DataFrame, index: DataFrame | None = None, first: int = 0) -> DataFrame:
    """(ext_id, line) with lines `id v1 ... vd` of six decimals.

    Digits are those of C's printf and of Python: a value's binary fraction is rounded, a tie to the even digit. (Java rounds its
    shortest decimal, ties up.) Empty places are left out; a row without a vector has no line."""
    named = embeddings.join(index, "node_id") if index is not None else embeddings.withColumn("ext_id", F.col("node_id") + first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [
                None if vec is None else f"{i} " + (("%.6f " * len(vec))[:-1] % tuple(vec) if None not in vec else " ".join(["%.6f" % x for x in vec if x is not None]))
                for i, vec in zip(batch.column("ext_id").to_pylist(), batch.column("vec").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("ext_id"), pa.array(lines, pa.string())], names=["ext_id", "line"])

    return named.select(F.col("ext_id").cast("long").alias("ext_id"), "vec").mapInArrow(run, "ext_id long, line string")


def write_embeddings(embeddings: DataFrame, path: str, index: DataFrame | None = None, first: int = 0) -> None:
    """Text files in the order of ids."""
    embedding_lines(embeddings, index, first).orderBy("ext_id").select("line").write.text(path)


def write_edge_list(graph: Graph, path: str) -> None:
    graph.edges.filter("src <= dst").select(F.format_string("%d %d %s", "src", "dst", F.col("wgt").cast("string")).alias("line")).write.text(path)

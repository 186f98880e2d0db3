"""Command line: read a graph, embed it, evaluate and store the result."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession

from .config import Config
from .plans.base import METHODS
from .plans.evaluate import multilabel, summary
from .plans.multilevel import multilevel_embed
from .plans.refine import MODELS
from .sources.text import exists, data_path, read_graph, read_truth, write_embeddings

log = logging.getLogger("stratagraph")


def parser() -> argparse.ArgumentParser:
    c = Config()
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data", default=c.data, help="name of the graph")
    p.add_argument("--root", default="./dataset", help="folder of the graphs")
    p.add_argument("--format", default=c.fmt, choices=["metis", "edgelist"])
    p.add_argument("--store-embed", action="store_true", help="write <root>/<data>.embeddings")
    p.add_argument("--no-eval", action="store_true", help="leave out the evaluation against <input>.truth")
    p.add_argument("--embed-dim", type=int, default=c.embed_dim)
    p.add_argument("--basic-embed", default=c.base, choices=sorted(METHODS))
    p.add_argument("--refine-type", default=c.refine, choices=sorted(MODELS))
    p.add_argument("--sdne-epoch", type=int, default=c.sdne_epochs)
    p.add_argument("--coarsen-m", type=int, default=c.coarsen_m, help="coarsen until 1 / 2 ** m of the nodes are left")
    p.add_argument("--batch-size", type=int, default=c.batch_size)
    p.add_argument("--partitions", type=int, default=None, help="shuffle partitions")
    p.add_argument("--double-base", action="store_true")
    p.add_argument("--learning-rate", type=float, default=c.learning_rate)
    p.add_argument("--self-weight", type=float, default=c.self_weight)
    p.add_argument("--only-coarse", action="store_true")
    p.add_argument("--coarse-parallel", action="store_true", help="signatures for equivalence")
    p.add_argument("--coarse-threshold", type=int, default=c.coarse_threshold)
    p.add_argument("--min-hash", type=int, default=c.min_hash)
    p.add_argument("--refine-epochs", type=int, default=c.refine_epochs)
    p.add_argument("--train-nodes", type=int, default=c.train_nodes)
    p.add_argument("--samples", type=int, default=None, help=f"neighbours drawn for each node (of yelp 10, else {c.samples})")
    p.add_argument("--depth", type=int, default=c.depth, help="layers of the sampling model")
    p.add_argument("--exact-order", action="store_true", help="the greedy matching order for graphs of any size, in one task")
    p.add_argument("--runs", type=int, default=c.runs)
    p.add_argument("--seed", type=int, default=c.seed)
    return p


def config_of(a: argparse.Namespace) -> Config:
    return Config(
        data=a.data, fmt=a.format, embed_dim=a.embed_dim, base=a.basic_embed, refine=a.refine_type, sdne_epochs=a.sdne_epoch, coarsen_m=a.coarsen_m, batch_size=a.batch_size, double_base=a.double_base,
        learning_rate=a.learning_rate, self_weight=a.self_weight, only_coarse=a.only_coarse, coarse_parallel=a.coarse_parallel, coarse_threshold=a.coarse_threshold, min_hash=a.min_hash,
        refine_epochs=a.refine_epochs, train_nodes=a.train_nodes, samples=a.samples or (10 if a.data == "yelp" else Config.samples), depth=a.depth, exact_order=a.exact_order, runs=a.runs, seed=a.seed,
    )


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    config = config_of(a)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName("stratagraph").getOrCreate()
    if a.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(a.partitions))
    path, began = data_path(config.data, config.fmt, a.root), time.time()
    graph, index = read_graph(spark, path, config.fmt)
    first = 1 if config.fmt == "metis" else 0
    found = multilevel_embed(graph, config).cache()
    seconds = time.time() - began
    log.info("embedded %d nodes in %.1f s", found.count(), seconds)
    if not a.no_eval and not config.only_coarse and exists(spark, f"{path}.truth"):
        truth = read_truth(spark, f"{path}.truth", index, first)
        summary(config, multilabel(found, truth, config), config.coarsen_m, seconds).show(truncate=False)
    if a.store_embed:
        write_embeddings(found, f"{a.root}/{config.data}.embeddings", index, first)


if __name__ == "__main__":
    main()

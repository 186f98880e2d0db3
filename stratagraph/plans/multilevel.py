"""The whole run: coarsen, embed the coarsest graph, refine back to the graph itself."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import Config
from ..operators.coarsen import Level, hierarchy
from ..operators.graph import Graph
from ..operators.vectors import l2_normalise, project
from ..storage import cut
from .base import base_embedding
from .refine import refine_down, refine_model


def levels_of(graph: Graph, config: Config) -> list[Level]:
    return hierarchy(graph, config.coarsen_m, config.embed_dim, config.coarse_parallel, config.coarse_threshold, config.min_hash, config.double_base, config.exact_order)


def multilevel_embed(graph: Graph, config: Config) -> DataFrame:
    """(node_id, vec) of every node; with `only_coarse` of the coarsest graph's nodes."""
    levels = levels_of(graph, config)
    method = base_embedding(config.base)
    base = cut(l2_normalise(method(levels[-1].graph, config)), "base")
    if config.only_coarse:
        return base
    model, top = refine_model(config), len(levels) - 1
    if config.double_base and top:
        # The level below is embedded too: the model learns to make that from what the coarsest projects.
        top -= 1
        target = cut(l2_normalise(method(levels[top].graph, config)), "base")
        start = cut(project(levels[top].cmap, base), "base")
    else:
        start = target = base
    if config.refine != "none":
        model.train(levels[top].graph, start, target)
    found = target
    for level in reversed(levels[:top]):
        found = refine_down(model, level.graph, level.cmap, found)
    return found

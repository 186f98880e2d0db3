"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Features of a text are the set of its words, pairs of neighbours and pairs with one word left out, hashed into 2 ** bits
places. Training goes over a bounded, documented sample of labelled rows (`per_class` of each class) in one task, with
per-coordinate rates and an L1 penalty that leaves few weights. Each sampled text counts once, so that a feature needs the
same support whatever the size of the table; the intercept is then set right for the classes' shares among all labelled rows.
The weights are broadcast (at most 2 ** bits numbers) and every text is scored as a whole.

Defined results: null, empty and wordless texts get the score of the intercept alone; without any label of either class
the score is 0.5 or that of the only class; repeated rows score alike; a document of several labels has the largest, and of
several texts under one id the least is learnt from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, one_task, sample_texts, spans_to_list, text_steps, texts
from .textnum import mix, word_hashes, word_spans

U64 = np.uint64


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the learner and the bound of its sample."""

    bits: int = 20
    alpha: float = 3.0
    beta: float = 1.0
    #: Twice the epochs: a feature of two texts alone, whose gradients add up to less, never gets a weight.
    l1: float = 16.0
    l2: float = 0.1
    epochs: int = 8
    per_class: int = 4096
    skips: int = 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int, skips: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each feature, feature), with repetitions."""
    mapped, starts, ends, first = word_spans(data, offsets)
    hashes = word_hashes(mapped, starts, ends)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rows, found = [text], [hashes]
    for gap in range(1, skips + 2):  # 1: neighbours; above: words left out
        if len(hashes) > gap:
            same = text[gap:] == text[:-gap]
            pairs = mix(hashes[:-gap] * U64(0xA24BAED4963EE407) + hashes[gap:] * U64(0x9FB21C651E98DF25) + U64(gap))
            rows.append(text[gap:][same])
            found.append(pairs[same])
    return np.concatenate(rows), (np.concatenate(found) >> U64(64 - bits)).astype(np.int64)


def _extract(p: Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch):
                rows, found = features(data, offsets, p.bits, p.skips)
                both = np.unique(rows * (1 << p.bits) + found)
                at = np.searchsorted(both, np.arange(hi - lo + 1) * (1 << p.bits))
                lists = spans_to_list((both & ((1 << p.bits) - 1)).astype(np.int32), at, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "label", "weight")] + [lists], names=["doc_id", "label", "weight", "found"])

    return run


def fit(rows: list[tuple[np.ndarray, int, float]], p: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """(places of weights that are not 0, weights, intercept) by FTRL-proximal over the rows (features, label, weight)."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    odds = lambda share: math.log(min(max(share, 1e-3), 1 - 1e-3) / (1 - min(max(share, 1e-3), 1 - 1e-3)))
    sampled = odds(sum(y for _, y, _ in rows) / len(rows)) if rows else 0.0
    stood_for = odds(sum(w for _, y, w in rows if y) / sum(w for _, _, w in rows)) if rows else 0.0
    bias, bias_n = sampled, 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for found, y, _ in rows:
            w = weights(found)
            g = 1 / (1 + math.exp(-min(max(bias + w.sum(), -35), 35))) - y
            before = n[found]
            z[found] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / p.alpha * w
            n[found] = before + g * g
            bias_n += g * g
            bias -= 0.1 * p.alpha * g / (p.beta + math.sqrt(bias_n))
    w = weights(np.arange(1 << p.bits))
    at = np.flatnonzero(w)
    return at, w[at], bias + stood_for - sampled


def _train(p: Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            lists, labels, weights = batch.column("found"), batch.column("label").to_pylist(), batch.column("weight").to_pylist()
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            rows += [(flat[at[i] : at[i + 1]].astype(np.int64), y, w) for i, (y, w) in enumerate(zip(labels, weights, strict=True))]
        order = np.random.default_rng(7).permutation(len(rows))
        at, w, bias = fit([rows[i] for i in order], p)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int64).tobytes()]), pa.array([w.tobytes()]), pa.array([bias])], names=["at", "w", "bias"])

    return run


def _score(shared, p: Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense = np.zeros(1 << p.bits)
        dense[at] = w
        for batch in batches:
            scores = np.full(len(batch), bias)
            for lo, hi, data, offsets in text_steps(batch):
                rows, found = features(data, offsets, p.bits, p.skips)
                some = np.flatnonzero(dense[found])
                both = np.unique(rows[some] * (1 << p.bits) + found[some])  # each feature counts once in a text
                scores[lo:hi] += np.bincount(both >> p.bits, dense[both & ((1 << p.bits) - 1)], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(scores, -35, 35))))], names=["doc_id", "score"])

    return run


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """The sparse model from the rows of `labels` that `keep` lets through."""
    sample = labelled_sample(labels, label, keep if keep is not None else F.lit(True), p.per_class)
    found = sample_texts(docs, sample).mapInArrow(_extract(p), "doc_id long, label int, weight double, found array<int>")
    model = one_task(found, "doc_id").mapInArrow(_train(p), "at binary, w binary, bias double").first()
    if model is None:  # no labelled document at all
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.frombuffer(model["at"], np.int64), np.frombuffer(model["w"]), model["bias"]


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], p: Ftrl = Ftrl()) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts(docs).mapInArrow(_score(shared, p), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows whose fold is `held` are not learnt from."""
    model = train_toxicity(docs, labels, keep=fold(F.col("doc_id").cast("long"), folds) != held)
    return score_toxicity(docs, model).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

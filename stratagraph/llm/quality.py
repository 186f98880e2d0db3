"""Quality by compression: zstandard dictionaries from good and from bad text.

A bounded, documented sample of labelled rows gives two dictionaries, from blocks of all of each text as far as `sample_bytes`
goes. Every text is cut into blocks and each is compressed with either dictionary. The score rests on one number alone: the
difference of the compressed sizes, summed over all blocks of the whole text and normalised by the text's size, which becomes
a probability by logistic calibration on the part of the sample that no dictionary has seen. (Normalised by the text's size
rather than by the compressed one, as mere repetition, which both dictionaries pack to almost nothing, then has a difference
of almost nothing and stands below good text.)

Defined results: null and empty texts have difference 0 and the calibrated score of that; where a class has no sample the
score is the share of label 1; repeated rows score alike; a document of several labels has the largest, and of several texts
under one id the least is learnt from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, one_task, sample_texts, texts


@dataclass(frozen=True)
class ZstdParams:
    per_class: int = 2048
    #: Bytes of samples for one dictionary at most, and the size of a dictionary.
    sample_bytes: int = 6 << 20
    dictionary: int = 112 << 10
    block: int = 512
    level: int = 3


class Sizes:
    """Compressed sizes of texts with either dictionary."""

    def __init__(self, good: bytes, bad: bytes, p: ZstdParams) -> None:
        self.p, self.packers = p, []
        for raw in (good, bad):
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            held.precompute_compress(level=p.level)
            self.packers.append(zstandard.ZstdCompressor(level=p.level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        """Size with the bad dictionary less that with the good one, over the text's size."""
        good = bad = 0
        for at in range(0, len(text), self.p.block):
            part = text[at : at + self.p.block]
            good += len(self.packers[0].compress(part))
            bad += len(self.packers[1].compress(part))
        return (bad - good) / len(text) if text else 0.0


def _blocks(samples: list[bytes], p: ZstdParams) -> list[bytes]:
    """All blocks of the texts; beyond `sample_bytes`, the texts give theirs by turns, each in a hashed order over its whole length."""
    places = [(turn, i, at) for i, text in enumerate(samples) for turn, at in enumerate(sorted(range(0, len(text), p.block), key=lambda at: zlib.crc32(b"%d %d" % (i, at))))]
    taken, size = [], 0
    for _, i, at in sorted(places):
        if size >= p.sample_bytes:
            break
        taken.append((i, at))
        size += min(p.block, len(samples[i]) - at)
    return [samples[i][at : at + p.block] for i, at in sorted(taken)]


def _dictionary(samples: list[bytes], p: ZstdParams) -> bytes:
    parts = _blocks(samples, p)
    try:
        return zstandard.train_dictionary(p.dictionary, parts).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves
        return b"".join(parts)[-p.dictionary :]


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton steps, with a slight ridge."""
    mean, scale = float(x.mean()), float(x.std()) + 1e-9
    m = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
        h = (m * (weight * q * (1 - q))[:, None]).T @ m + 1e-2 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(h, m.T @ (weight * (y - q)) - 1e-2 * beta), -2, 2)
    return float(beta[0] / scale), float(beta[1] - beta[0] / scale * mean)


def _train(p: ZstdParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [((t or "").encode(), y, w) for b in batches for t, y, w in zip(*(b.column(c).to_pylist() for c in ("text", "label", "weight")), strict=True)]
        total = sum(w for _, _, w in rows)
        share = sum(w for _, y, w in rows if y) / total if total else 0.5
        good, bad = ([t for t, y, _ in rows[::2] if y == k and t] for k in (1, 0))
        dictionaries = [_dictionary(good, p), _dictionary(bad, p)] if good and bad else [b"", b""]
        share = min(max(share, 1e-3), 1 - 1e-3)
        curve = (0.0, float(np.log(share / (1 - share))))
        fresh = rows[1::2]
        if good and bad and fresh:
            sizes = Sizes(*dictionaries, p)
            curve = calibrate(np.array([sizes.difference(t) for t, _, _ in fresh]), np.array([y for _, y, _ in fresh], float), np.array([w for _, _, w in fresh]))
        yield pa.RecordBatch.from_arrays([pa.array([dictionaries[0]]), pa.array([dictionaries[1]]), pa.array([list(curve)])], names=["good", "bad", "curve"])

    return run


def _score(shared, p: ZstdParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad, curve = shared.value
        sizes = Sizes(good, bad, p) if good and bad else None
        for whole, lo in ((b, lo) for b in batches for lo in range(0, len(b), 500)):  # few texts at once as Python strings
            batch = whole.slice(lo, 500)
            x = np.array([sizes.difference(t.encode()) if t and sizes else 0.0 for t in batch.column("text").to_pylist()])
            margin = x * curve[0] + curve[1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35)))), pa.array(x)], names=["doc_id", "score", "difference"])

    return run


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, p: ZstdParams = ZstdParams()) -> tuple[bytes, bytes, list[float]]:
    """(dictionary of good text, of bad text, slope and intercept of the calibration)."""
    sample = labelled_sample(labels, label, keep if keep is not None else F.lit(True), p.per_class)
    mixed = sample_texts(docs, sample).withColumn("order", F.xxhash64("doc_id", F.lit(3)))
    m = one_task(mixed, "order", "doc_id").drop("order").mapInArrow(_train(p), "good binary, bad binary, curve array<double>").first()
    if m is None:  # no labelled document at all
        return b"", b"", [0.0, 0.0]
    return bytes(m["good"]), bytes(m["bad"]), list(m["curve"])


def score_quality(docs: DataFrame, model: tuple[bytes, bytes, list[float]], p: ZstdParams = ZstdParams()) -> DataFrame:
    """(doc_id, score, difference) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts(docs).mapInArrow(_score(shared, p), "doc_id long, score double, difference double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted, difference); rows whose fold is `held` are not learnt from."""
    model = train_quality(docs, labels, keep=fold(F.col("doc_id").cast("long"), folds) != held)
    return score_quality(docs, model).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "difference")

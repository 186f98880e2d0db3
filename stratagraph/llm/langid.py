"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters of the lower-cased text are hashed into 2 ** bits places. Document frequencies come from all
documents learnt from; the weights come from a bounded, documented sample (`sample` rows over all languages, an equal share
for each) by follow-the-regularised-leader with L1 and L2 penalties; a part of that sample held back sets the temperature.
What is broadcast has 2 ** bits rows of as many numbers as languages.

Defined results: a null text or one without a letter (of Unicode's categories L) is `und` with score 0; with nothing to learn from all are `und`; more
languages than `max_languages` raise an error; repeated rows get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, one_task, texts

U32 = np.uint32


@dataclass(frozen=True)
class LangParams:
    bits: int = 15
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 3
    sample: int = 8192
    max_languages: int = 1000


def grams(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the text's hashed n-grams of 1 to 3 characters."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), U32)
    with np.errstate(over="ignore"):
        one = c * U32(0x9E3779B1)
        two = (one[:-1] ^ (one[:-1] >> U32(15))) * U32(0x85EBCA77) + c[1:] * U32(0xC2B2AE3D)
        three = (two[:-1] ^ (two[:-1] >> U32(13))) * U32(0x27D4EB2F) + c[2:] * U32(0x165667B1)
    places = np.concatenate([one, (two ^ (two >> U32(16))) * U32(0x9E3779B1), (three ^ (three >> U32(16))) * U32(0x9E3779B1)]) >> U32(32 - bits)
    if len(places) < 1 << bits - 4:
        return np.unique(places.astype(np.int64), return_counts=True)
    counts = np.bincount(places, minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


def has_letter(text: str | None) -> bool:
    """A character of one of Unicode's letter categories; digits, fractions and numerals are none."""
    return text is not None and any(map(str.isalpha, text))


def _frequencies(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                rows += 1
                seen[grams(text or "", bits)[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], names=["place", "n"])

    return run


def _vector(text: str, idf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at, n = grams(text, bits)
    x = (1 + np.log(n)) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, p: LangParams) -> tuple[np.ndarray, float]:
    """(weights by place and class, temperature)."""
    z, n = np.zeros((1 << p.bits, classes)), np.zeros((1 << p.bits, classes))

    def weights(at) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    back = rows[::8]  # for the temperature
    learnt = [r for i, r in enumerate(rows) if i % 8] or rows
    for _ in range(p.epochs):
        for at, x, y in learnt:
            w = weights(at)
            g = _softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g
            before = n[at]
            z[at] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / p.alpha * w
            n[at] = before + g * g
    w = weights(slice(None))
    logits = np.array([x @ w[at] for at, x, _ in back]) if back else np.zeros((0, classes))
    truth = np.array([y for _, _, y in back], int)

    def loss(log_t: float) -> float:
        probs = _softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(probs[np.arange(len(truth)), truth], 1e-300)).mean()) if len(truth) else log_t**2

    low, high = np.log(0.05), np.log(20.0)
    for _ in range(60):
        a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return w, float(np.exp((low + high) / 2))


def _train(shared, p: LangParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, languages = shared.value
        number = {x: i for i, x in enumerate(languages)}
        rows = [(*_vector(t or "", idf, p.bits), number[y]) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)]
        order = np.random.default_rng(11).permutation(len(rows))
        w, temperature = fit([rows[i] for i in order], len(languages), p)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([temperature])], names=["w", "temperature"])

    return run


def _predict(shared, p: LangParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, languages, raw, temperature = shared.value
        w = raw.astype(np.float64)
        for whole in batches:
            for lo in range(0, len(whole), 500):  # few texts at once as Python strings
                batch = whole.slice(lo, 500)
                names, scores = [], []
                for text in batch.column("text").to_pylist():
                    if not languages or not has_letter(text):
                        names.append("und")
                        scores.append(0.0)
                        continue
                    at, x = _vector(text, idf, p.bits)
                    probs = _softmax(x @ w[at] / temperature)
                    best = int(probs.argmax())
                    names.append(languages[best])
                    scores.append(float(probs[best]))
                kept = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return run


def train_language(docs: DataFrame, keep: Column, p: LangParams = LangParams()):
    """(idf, languages, weights, temperature) from text and lang of the rows that `keep` lets through."""
    spark = docs.sparkSession
    known = docs.filter(keep).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().limit(p.max_languages + 1).collect()}
    if len(sizes) > p.max_languages:
        raise ValueError(f"more than {p.max_languages} languages")
    idf, languages = np.zeros(1 << p.bits), sorted(sizes)
    if not languages:
        return idf, [], np.zeros((1 << p.bits, 0), np.float32), 1.0
    counted = known.select("text").mapInArrow(_frequencies(p.bits), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    seen = {r.place: r.n for r in counted}
    total = seen.pop(-1, 0)
    at = np.array(sorted(seen), np.int64)
    idf[at] = np.log((1 + total) / (1 + np.array([seen[i] for i in at.tolist()]))) + 1
    share = max(64, p.sample // len(languages))
    # The first of each language in a hashed order. A cut at twice as many, as expected, spares the sort most rows; the rank bounds
    # them where rows repeat.
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    cuts = F.create_map(*[F.lit(v) for x in languages for v in (x, int(min(1.0, 2 * share / sizes[x]) * (1 << 30)))])
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    near = known.withColumn("draw", draw).filter(F.col("draw") < cuts[F.col("lang")])
    taken = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= share).drop("place", "draw")
    model = one_task(taken, "doc_id", "text").mapInArrow(_train(spark.sparkContext.broadcast((idf, languages)), p), "w binary, temperature double").first()
    return idf, languages, np.frombuffer(model["w"], np.float32).reshape(1 << p.bits, -1), model["temperature"]


def predict_language(docs: DataFrame, model, p: LangParams = LangParams()) -> DataFrame:
    """(row, lang_pred, score): each whole input row with what its text is taken for."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    return whole.mapInArrow(_predict(shared, p), f"row {docs.schema.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """The rows of `docs`, all columns, whose language is recognised: those that are not `und`, so with a letter. A null lang is filled
    in. With nothing to learn from no document can be told from another, and all stay."""
    model = train_language(docs, fold(F.col("doc_id").cast("long"), folds) != held)
    if not model[1]:
        return docs
    found = predict_language(docs, model).filter(F.col("lang_pred") != "und")
    return found.select(*[F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def language_id(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); rows whose fold is `held` are not learnt from."""
    model = train_language(docs, fold(F.col("doc_id").cast("long"), folds) != held)
    found = predict_language(texts(docs), model)
    return found.select("row.doc_id", (fold(F.col("row.doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")

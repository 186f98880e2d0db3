"""Language-model scoring by prediction by partial matching over bytes.

The pretrained model is a trie of byte contexts of up to `order` bytes with the counts of what followed them in all training
texts. A byte is predicted in the longest known context. The probability of escaping to the next shorter one is estimated from
the number of different bytes seen there, each of which gives `DISCOUNT` of its count to the escape (method D, which gives a
half, generalised), and bytes already seen in the longer context are excluded from the shorter one. As the counts stand still,
what a context excludes from the next is known beforehand, and whole arrays of bytes are scored by table lookups. The code
length of a text is that of its bytes (A-Z lower-cased) and its end.

All counts are summed over all training texts, and every one of them is used, whatever the size of the corpus. The commonest
longest grams, at most `share` of them, are broadcast with their probabilities and settle the bytes that they predict. All
other bytes meet the trie in buckets by the three bytes before them: a bucket holds the counts of all longer contexts that end
in its three bytes, and the orders below, of at most 2^24 nodes, are broadcast whole. The base score's token counts are exact
for every token: those of at least 1 / `tokens` of all tokens (at most `tokens` of them) are broadcast, the others are joined.

`adaptive_bits` scores a text by a model that learns from that text alone.

Defined results: null is the empty text, of one token (the end); without training texts a token's base is 0 and each byte costs 8
bits; repeated rows score alike; ids may be null or repeat.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, grouped, large_binary, text_steps, texts, width

U64 = np.uint64
#: Bytes that UTF-8 never has: before the first byte of a text, and after the last.
START, END = 0xFE, 0xFF
#: What each kind of byte seen in a context gives of its count to the escape.
DISCOUNT = 0.3
#: Bytes of context that decide the bucket; the orders below are broadcast whole.
SUFFIX = 3
#: Different grams of a bucket on average, and bytes scored in one step.
BUCKET, STEP = 1 << 19, 1 << 17


@dataclass(frozen=True)
class PpmParams:
    order: int = 6
    share: int = 1 << 21
    tokens: int = 1 << 18


def lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(one number for each byte and end: the bytes before it and itself in the lowest place; the first of each text)."""
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    padded = np.full(len(data) + rows * (order + 1), START, np.uint8)
    at = offsets[:-1] + np.arange(rows) * (order + 1) + order  # first byte of each text
    keep = np.ones(len(padded), bool)
    for k in range(1, order + 1):
        keep[at - k] = False
    kept = np.flatnonzero(keep)
    ends = at + lengths
    body = keep.copy()
    body[ends] = False
    padded[body] = lower(data)
    padded[ends] = END
    keys = padded[kept].astype(U64)
    for k in range(1, order + 1):
        keys |= padded[kept - k].astype(U64) << U64(8 * k)
    return keys, offsets[:-1] + np.arange(rows)


class Index:
    """Places of 64-bit keys in an array, by open addressing, for whole arrays of keys at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self.first(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            missed = self.slots[at] != left
            left, at = left[missed], (at[missed] + 1) & ((1 << self.bits) - 1)

    def first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15) ^ (keys >> U64(29)) * U64(0xBF58476D1CE4E5B9)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self.first(keys)
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.slots[at]
            out[left] = found
            again = (found >= 0) & (self.keys[found] != keys[left])
            left, at = left[again], at[again]
        return out


class Model:
    """Tables of the pretrained trie.

    counts: for each order from 0 on, sorted grams and their counts; followed: sorted contexts and how often each was followed by
    anything, nodes that were left out included: their share goes to the escape. Without it, no node was left out. `low` is a
    model of lower orders that the counts go on from."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], followed: list[tuple[np.ndarray, np.ndarray]] | None = None, low: Model | None = None) -> None:
        tables = (low.grams, low.logs, low.contexts, low.escape, low.escape_after, low.total_after, low.counts) if low else ([],) * 7
        self.grams, self.logs, self.contexts, self.escape, self.escape_after, self.total_after, self.counts = map(list, tables)
        start = len(self.grams)
        self.order = start + len(counts) - 1
        excluded = low.excluded if low else None
        for k, (keys, n) in enumerate(counts, start):
            n = n.astype(np.float64)
            owner, first = np.unique(keys >> U64(8), return_index=True)
            kept = np.add.reduceat(n, first) if len(keys) else np.zeros(0)
            totals = followed[k][1][np.searchsorted(followed[k][0], owner)].astype(np.float64) if followed and len(keys) else kept
            kinds = np.diff(np.append(first, len(keys))).astype(np.float64)
            of = np.repeat(np.arange(len(owner)), kinds.astype(np.int64))
            self.grams.append(Index(keys))
            self.counts.append(n)
            self.logs.append(np.log((n - DISCOUNT) / totals[of]))
            self.contexts.append(Index(owner))
            self.escape.append(np.log((totals - kept + DISCOUNT * kinds) / totals))
            if k:
                # What each context excludes from the next shorter one, and what is left there.
                mask = U64((1 << 8 * k) - 1)
                below = self.grams[k - 1].find(keys & mask)
                shorter = self.contexts[k - 1].find(owner & (mask >> U64(8)))
                seen = np.add.reduceat(self.counts[k - 1][below], first) if len(keys) else np.zeros(0)
                rest = excluded[0][shorter] - seen
                fresh = excluded[1][shorter] - kinds
                self.total_after.append(np.maximum(rest, 1))
                away = excluded[2][shorter] + DISCOUNT * fresh
                self.escape_after.append(np.where(away > 0, np.log(np.maximum(away, DISCOUNT) / np.maximum(rest, 1)), 0.0))
            excluded = totals, kinds, totals - kept
        self.excluded = excluded
        self.none = math.log(1 / 256)
        known = len(self.counts[0]) if self.counts else 0
        self.last = math.log(1 / (256 - known)) if known < 256 else 0.0

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithm of each byte's probability after the bytes before it."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        longer = np.full(len(keys), -1, np.int32)  # the context one longer that was escaped from
        for k in range(self.order, -1, -1):
            wanted = keys[left] & U64((1 << 8 * (k + 1)) - 1 if k < 7 else 2**64 - 1)
            gram = self.grams[k].find(wanted)
            hit = gram >= 0
            direct = hit & (longer < 0)
            out[left[direct]] += self.logs[k][gram[direct]]
            after = hit & (longer >= 0)
            if after.any():
                out[left[after]] += np.log((self.counts[k][gram[after]] - DISCOUNT) / self.total_after[k][longer[after]])
            miss = ~hit
            left, wanted, longer = left[miss], wanted[miss], longer[miss]
            context = self.contexts[k].find(wanted >> U64(8))
            known = context >= 0
            fresh = known & (longer < 0)
            out[left[fresh]] += self.escape[k][context[fresh]]
            again = known & (longer >= 0)
            if again.any():
                out[left[again]] += self.escape_after[k][longer[again]]
            longer = np.where(known, context, -1)
        out[left] += self.last if len(self.counts) and len(self.counts[0]) else self.none
        return out


def adaptive_bits(text: str, order: int = 4) -> float:
    """Code length in bits of a text by a model of method C with exclusion that learns as it goes."""
    seen: dict[bytes, Counter] = {}
    data = bytes(lower(np.frombuffer(text.encode(), np.uint8))) + bytes([END])
    bits, history = 0.0, b""
    for symbol in data:
        gone: set[int] = set()
        for k in range(min(order, len(history)), -1, -1):
            node = seen.get(history[len(history) - k :] if k else b"")
            if node is None:
                continue
            left = {s: n for s, n in node.items() if s not in gone}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if symbol in left:
                bits -= math.log2(left[symbol] / total)
                break
            bits -= math.log2(len(left) / total)
            gone |= left.keys()
        else:
            bits += math.log2(256 - len(gone))
        for k in range(min(order, len(history)) + 1):
            seen.setdefault(history[len(history) - k :] if k else b"", Counter())[symbol] += 1
        history = (history + bytes([symbol]))[-order:] if order else b""
    return bits


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def _count_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = np.zeros(0, U64), np.zeros(0, np.int64), []

        def summed():
            return _summed(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(c for _, c in waiting)]))

        def batch_of(keys, counts):
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(counts[at : at + 100_000])], names=["gram", "n"])

        for batch in batches:
            for _, _, data, offsets in text_steps(batch, limit=4 << 20):
                waiting.append(np.unique(grams(data, offsets, order)[0], return_counts=True))
                if sum(len(k) for k, _ in waiting) > 1 << 20:
                    keys, counts = summed()
                    waiting = []
                    if len(keys) > 1 << 21:
                        yield from batch_of(keys, counts)
                        keys, counts = keys[:0], counts[:0]
        keys, counts = summed()
        yield from batch_of(keys, counts)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("gram", "n")], names=["gram", "n"])


def _collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and numbers of a bounded table (gram, n)."""
    rows = df.mapInArrow(_pack, "gram binary, n binary").collect()
    keys = np.concatenate([np.frombuffer(r.gram, np.int64) for r in rows]).view(U64) if rows else np.zeros(0, U64)
    n = np.concatenate([np.frombuffer(r.n, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def _lowest(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & U64((1 << 8 * n) - 1) if n < 8 else keys


def count_grams(docs: DataFrame, p: PpmParams) -> DataFrame:
    """(gram, n) of all rows of `docs`: each longest gram and its count."""
    return cut(texts(docs).select("text").mapInArrow(_count_grams(p.order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams")


def low_model(counted: DataFrame, p: PpmParams) -> Model:
    """The whole trie of the orders below SUFFIX."""
    top = min(p.order, SUFFIX - 1)
    gram = F.col("gram").bitwiseAND((1 << 8 * (top + 1)) - 1)
    keys, n = _collected(counted.groupBy(gram.alias("gram")).agg(F.sum("n").alias("n")))
    return Model([_summed(_lowest(keys, k + 1), n) for k in range(top + 1)])


def common_grams(counted: DataFrame, p: PpmParams) -> tuple[Index, np.ndarray]:
    """The commonest longest grams, at most `share`, and the logarithms of their probabilities."""
    # Quarters of powers of two, from the commonest down, as long as they fit.
    step = F.floor(4 * F.log2("n")).cast("int")
    least, room = None, p.share
    for r in sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    if least is None:
        return Index(np.zeros(0, U64)), np.zeros(0)
    keys, n = _collected(counted.filter(step >= least))
    context = F.shiftrightunsigned("gram", 8)
    owners, totals = _collected(counted.groupBy(context.alias("gram")).agg(F.sum("n").alias("n"), F.max(step).alias("step")).filter(F.col("step") >= least))
    return Index(keys), np.log((n - DISCOUNT) / totals[np.searchsorted(owners, keys >> U64(8))])


def _dealt(keys: np.ndarray, owners: np.ndarray, buckets: int) -> tuple[list, list, list, list]:
    """Parts of one bucket each: (bucket, keys, runs of equal owners, lengths of the runs)."""
    bucket = (((keys >> U64(8)) & U64((1 << 8 * SUFFIX) - 1)) * U64(0x9E3779B97F4A7C15) >> U64(32)) % U64(buckets)
    order = np.argsort(bucket, kind="stable")
    keys, owners, bucket = keys[order], owners[order], bucket[order].astype(np.int64)
    if not len(keys):
        return [], [], [], []
    new = np.r_[True, bucket[1:] != bucket[:-1]]
    run = np.flatnonzero(new | np.r_[True, owners[1:] != owners[:-1]])
    first = np.flatnonzero(new)
    ids, times, at = owners[run].astype(np.int64), np.diff(np.append(run, len(keys))).astype(np.int32), np.append(np.searchsorted(run, first), len(run))
    ends = np.append(first, len(keys)).tolist()
    at = at.tolist()
    each = range(len(first))
    return (
        bucket[first].tolist(),
        [keys[ends[i] : ends[i + 1]].tobytes() for i in each],
        [ids[at[i] : at[i + 1]].tobytes() for i in each],
        [times[at[i] : at[i + 1]].tobytes() for i in each],
    )


PART = "bucket int, kind int, keys binary, ids binary, times binary"


def _deal_grams(buckets: int):
    """Grams as parts of kind 0, whose owners are the counts."""

    def out(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys = np.concatenate([b.column("gram").to_numpy() for b in waiting]).view(U64)
        bucket, *rest = _dealt(keys, np.concatenate([b.column("n").to_numpy() for b in waiting]), buckets)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([0] * len(bucket), pa.int32()), *(pa.array(x, pa.binary()) for x in rest)], names=["bucket", "kind", "keys", "ids", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(len(b) for b in waiting) >= BUCKET:
                yield out(waiting)
                waiting = []
        if waiting:
            yield out(waiting)

    return run


SUMS = "part int, rows binary, logs binary"


def _predict(shared, order: int, parts: int):
    """Sums of what the bytes of each text cost that met the trie here, packed for the parts that add them up. Input comes by
    bucket, its grams first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = shared.value
        current, model, trie, waiting, size = None, None, [], [], 0
        rows, logs = np.zeros(0, np.int64), np.zeros(0)

        def scored() -> tuple[np.ndarray, np.ndarray]:
            nonlocal model, trie, waiting, size
            if model is None:
                keys = np.concatenate([k for k, _ in trie]) if trie else np.zeros(0, U64)
                n = np.concatenate([c for _, c in trie]) if trie else np.zeros(0, np.int64)
                model, trie = Model([_summed(_lowest(keys, k + 1), n) for k in range(SUFFIX, order + 1)], low=low), []
            found = model.log_probabilities(np.concatenate([k for k, _ in waiting]))
            owners = np.concatenate([o for _, o in waiting])
            waiting, size = [], 0
            return _summed(np.concatenate([rows, owners]), np.concatenate([logs, found]))

        def out() -> pa.RecordBatch:
            part = ((rows.view(U64) * U64(0x9E3779B97F4A7C15) >> U64(32)) % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(ends))
            packed = [[x[order[ends[i] : ends[i + 1]]].tobytes() for i in some] for x in (rows, logs)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["part", "rows", "logs"])

        for batch in batches:
            for bucket, kind, keys, ids, times in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "keys", "ids", "times")), strict=True):
                if bucket != current:
                    if waiting:
                        rows, logs = scored()
                    current, model, trie = bucket, None, []
                part = np.frombuffer(keys, U64), np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(times, np.int32))
                if kind == 0:
                    trie.append(part)
                    continue
                waiting.append(part)
                size += len(part[0])
                if size >= STEP:
                    rows, logs = scored()
                    if len(rows) > 1 << 20:
                        yield out()
                        rows, logs = rows[:0], logs[:0]
        if waiting:
            rows, logs = scored()
        yield out()

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, log_left) of each part."""
    for group in grouped(batches, ["part"]):
        rows, logs = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("rows", np.int64), ("logs", np.float64)))
        rows, logs = _summed(rows, logs)
        for at in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(rows[at : at + 100_000]), pa.array(logs[at : at + 100_000])], names=["row", "log_left"])


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of the texts, A-Z lower-cased and split at ASCII white space; the end is the empty token."""
    found: Counter[bytes] = Counter()

    def out():
        keys = list(found)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([found[t] for t in part], pa.int64())], names=["token", "n"])

    for batch in batches:
        data, offsets = large_binary(batch.column("text"))
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found.update(data[a:b].tobytes().lower().split())
            found[b""] += 1
        if len(found) > 400_000:
            yield from out()
            found.clear()
    yield from out()


def _score(shared, order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, known_logs, frequent = shared.value
        kind = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch, limit=1 << 18):  # small steps: few texts at once, arrays that stay in the cache
                n_tokens, n_known, base, counts, rest, times = [], [], [], [0], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    words = data[a:b].tobytes().lower().split()
                    words.append(b"")
                    known, total = 0, 0.0
                    for token, n in Counter(words).items():
                        log = frequent.get(token)
                        if log is None:
                            rest.append(token)
                            times.append(n)
                        else:
                            known += n
                            total += n * log
                    n_tokens.append(len(words))
                    n_known.append(known)
                    base.append(total)
                    counts.append(len(rest))
                keys, first = grams(data, offsets, order)
                place = common.find(keys)
                settled = place >= 0
                logs = np.zeros(len(keys))
                logs[settled] = known_logs[place[settled]]
                scores = np.add.reduceat(logs, first)
                open_ = np.flatnonzero(~settled)
                pairs = pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(times, pa.int64())], fields=list(kind.value_type))
                rare = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pairs)
                part = batch.slice(lo, hi - lo)
                owners = part.column("row").to_numpy()[np.searchsorted(first, open_, side="right") - 1]
                bucket, *rest = _dealt(keys[open_], owners, buckets)
                dealt = pa.StructArray.from_arrays([pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in rest)], names=["bucket", "keys", "ids", "times"])
                left = pa.ListArray.from_arrays(pa.array([0] + [len(bucket)] * len(part), pa.int32()), dealt)  # all beside the step's first row
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), rare, left], names=["row", "doc_id", "n_tokens", "n_known", "base", "log", "rare", "left"])

    return run


def score_language_model(docs: DataFrame, folds: int = 5, held: int = 1, p: PpmParams = PpmParams()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows whose fold is `held` are not learnt from."""
    spark = docs.sparkSession
    own = texts(docs)
    training = own.filter(fold(F.col("doc_id"), folds) != held)
    counted = count_grams(training, p)
    buckets = max(4 * width(spark), -(-counted.count() // BUCKET))
    low = spark.sparkContext.broadcast(low_model(counted, p))
    tokens = cut(training.select("text").mapInArrow(_count_tokens, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "ppm-tokens")
    total, kinds = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    denominator = total + 0.5 * (kinds + 1)
    least = max(1, -(-total // p.tokens))  # so many that at most p.tokens can have them
    frequent = {bytes(r.token): math.log10((r.n + 0.5) / denominator) for r in tokens.filter(F.col("n") >= least).collect()}
    shared = spark.sparkContext.broadcast((*common_grams(counted, p), frequent))
    shape = "row long, doc_id long, n_tokens long, n_known long, base double, log double, rare array<struct<token: binary, n: long>>, left array<struct<bucket: int, keys: binary, ids: binary, times: binary>>"
    scored = cut(own.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score(shared, p.order, buckets), shape), "ppm-scores")
    # The tokens that were not sent: each joins its exact count, or none.
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.token", F.col("r.n").alias("times"))
    logs = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.5) / F.lit(float(denominator)))
    rest = rare.join(tokens.filter(F.col("n") < least), "token", "left").groupBy("row").agg(F.sum(F.col("times") * logs).alias("rest"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rest_known"))
    # The bytes that no common gram settled: each meets the whole trie of its bucket.
    parts = scored.select(F.explode("left").alias("l")).select("l.bucket", F.lit(1).alias("kind"), "l.keys", "l.ids", "l.times")
    dealt = counted.mapInArrow(_deal_grams(buckets), PART).unionByName(parts).repartition("bucket").sortWithinPartitions("bucket", "kind")
    adders = 4 * width(spark)
    sums = dealt.mapInArrow(_predict(low, p.order, adders), SUMS).repartition("part").sortWithinPartitions("part")
    bytes_left = sums.mapInArrow(_add_up, "row long, log_left double")
    return scored.drop("rare", "left").join(rest, "row", "left").join(bytes_left, "row", "left").select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), ((F.col("log") + F.coalesce("log_left", F.lit(0.0))) / math.log(10)).alias("score"),
    )

"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words, a window into shingles. Containment of a window needs all its
shingles, so its one necessary prefix token is the rarest of them, by a count over all documents. Documents are joined on
those tokens, the position of a match and the number of words bound where the window can lie, and each candidate is
verified word for word.

A benchmark of up to `block_bytes` goes to all executors, and documents meet it as they are read. A larger one is joined by
shuffles: different texts are read once, for the places of tokens that some window has, each with the few words around it; the
tokens are counted and the places joined to the windows by their prefix tokens, common ones in parts.

Defined results: a null or wordless text has no words and is clean; a null or wordless item has no window; a null item_id is
left out of the list of items; repeated rows each get the same result; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, cut, text_steps, texts
from .textnum import WORDS, shingles, word_hashes, word_spans

#: Text bytes of a benchmark that is sent to every executor, at some 30 times that; a larger one is joined by shuffles.
BLOCK_BYTES = 4 << 20
#: Tokens of a joined benchmark by which places in documents are sifted before they are shuffled: 4 bytes each are sent.
SIFTED = 1 << 23


def item_words(text: str | None) -> list[bytes]:
    """Words of a text as bytes: A-Z lower-cased, runs of letters, digits and characters beyond ASCII."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    mapped, starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    raw = mapped.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends, strict=True)]


class Windows:
    """The windows of a block of items, their shingles, and (once counts are known) their prefix tokens."""

    def __init__(self, items: list[tuple[int, str | None]], size: int, shingle: int) -> None:
        self.shingle = shingle
        self.words: list[list[bytes]] = []
        self.items: list[set[int]] = []
        known: dict[tuple[bytes, ...], int] = {}
        for item, text in items:
            words = item_words(text)
            for i in range(max(1, len(words) - size + 1) if words else 0):
                key = tuple(words[i : i + size])
                at = known.setdefault(key, len(known))
                if at == len(self.words):
                    self.words.append(list(key))
                    self.items.append(set())
                if item is not None:
                    self.items[at].add(item)
        parts = [_window_shingles(w, shingle) for w in self.words]
        self.owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
        self.place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
        self.hash = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        # Shingles of fewer words than usual (of short items) are looked up apart.
        self.length = np.array([min(shingle, len(w)) for w in self.words], np.int64)
        self.sizes = sorted(set(self.length.tolist()))
        self.text = [b" ".join(w) for w in self.words]

    def tokens(self, length: int) -> np.ndarray:
        return np.unique(self.hash[self.length[self.owner] == length])

    def choose(self, counts: dict[int, int]) -> None:
        """Order the shingles of each window by rarity and keep the first as its prefix token."""
        rarity = np.array([counts.get(int(h), 0) for h in self.hash], np.int64)
        order = np.lexsort((self.place, self.hash, rarity, self.owner))
        head = order[np.r_[True, np.diff(self.owner[order]) > 0]] if len(order) else order
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {n: {} for n in self.sizes}
        for k in head:
            w = int(self.owner[k])
            self.prefix[int(self.length[w])].setdefault(int(self.hash[k]), []).append((w, int(self.place[k])))
        self.prefix_tokens = {n: np.array(sorted(p), np.uint64) for n, p in self.prefix.items()}


def _window_shingles(words: list[bytes], size: int) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    mapped, starts, ends, first = word_spans(data, np.array([0, len(data)]))
    return shingles(word_hashes(mapped, starts, ends), first, min(size, len(words)))[0]


def _find(values: np.ndarray, sorted_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in values that are tokens, their index among the tokens). A bitmap of low bits answers most."""
    if not len(values) or not len(sorted_tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << max(16, int(len(sorted_tokens) * 16).bit_length())) - 1)
    bitmap = np.zeros(int(low) + 1, bool)
    bitmap[(sorted_tokens & low).astype(np.int64)] = True
    may = np.flatnonzero(bitmap[(values & low).astype(np.int64)])
    at = np.minimum(np.searchsorted(sorted_tokens, values[may]), len(sorted_tokens) - 1)
    hit = sorted_tokens[at] == values[may]
    return may[hit], at[hit]


def _counts(shared, steps: int = CHUNK):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        tokens = {n: windows.tokens(n) for n in windows.sizes}
        found = {n: np.zeros(len(t), np.int64) for n, t in tokens.items()}
        for batch in batches:
            for _, _, data, offsets in text_steps(batch, limit=steps):
                mapped, starts, ends, first = word_spans(data, offsets)
                hashes = word_hashes(mapped, starts, ends)
                for n, t in tokens.items():
                    _, which = _find(shingles(hashes, first, n, short=False)[0], t)
                    found[n] += np.bincount(which, minlength=len(t))
        for n, t in tokens.items():
            some = np.flatnonzero(found[n])
            yield pa.RecordBatch.from_arrays([pa.array(t[some].view(np.int64)), pa.array(found[n][some])], names=["token", "n"])

    return run


def _mark(shared):
    """Adds the word spans hit by windows of this block, and the items, to those of the blocks before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        for batch in batches:
            n_words, spans, items = [], batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for lo, _hi, data, offsets in text_steps(batch):
                mapped, starts, ends, first = word_spans(data, offsets)
                hashes = word_hashes(mapped, starts, ends)
                n_words += np.diff(first).tolist()
                for n, tokens in windows.prefix_tokens.items():
                    hashed, at = shingles(hashes, first, n, short=False)
                    where, which = _find(hashed, tokens)
                    rows = np.searchsorted(at, where, side="right") - 1
                    for p, k, row in zip(where.tolist(), which.tolist(), rows.tolist(), strict=True):
                        begin, end = int(first[row]), int(first[row + 1])
                        word = begin + p - int(at[row])
                        for w, place in windows.prefix[n][int(tokens[k])]:
                            s, e = word - place, word - place + len(windows.words[w])
                            if s < begin or e > end:  # the window would leave the text
                                continue
                            if b" ".join(mapped[a:b].tobytes() for a, b in zip(starts[s:e], ends[s:e], strict=True)) == windows.text[w]:
                                spans[lo + row] = _joined(spans[lo + row], s - begin, e - begin)
                                items[lo + row] = [*{*(items[lo + row] or []), *windows.items[w]}]
            new = {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.int64()))}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return run


def _joined(spans: list[int] | None, s: int, e: int) -> list[int]:
    """The flat list of spans with one more, drawn together with the last if they touch."""
    spans = spans or []
    if spans and spans[-2] <= s <= spans[-1]:
        spans[-1] = max(spans[-1], e)
        return spans
    return [*spans, s, e]


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    """Disjoint, sorted word spans from a flat list of starts and ends."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip((spans or [])[::2], (spans or [])[1::2], strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [sum(e - s for s, e in merged(x)) for x in batch.column("spans").to_pylist()]
        items = [sorted(map(str, x or [])) for x in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([x > 0 for x in hits], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, text, row, n_words, spans, items): all word spans of each document that hold a window, the items they come from,
    and the whole input row."""
    spark = docs.sparkSession
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return _joined_windows(own, items, window, shingle)
    out = own.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<bigint>").alias("items"))
    windows = Windows([(r.item_id, r.text) for r in items.filter("text is not null").collect()], window, shingle)
    # Rarity over all documents: one count for each token of the benchmark.
    counted = texts(docs).select("text").mapInArrow(_counts(spark.sparkContext.broadcast(windows)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")) if len(windows.hash) else None
    windows.choose({r.token & (2**64 - 1): r.n for r in counted.collect()} if counted is not None else {})
    return out.mapInArrow(_mark(spark.sparkContext.broadcast(windows)), out.schema)


def _item_tokens(size: int, shingle: int):
    """(window, size, length, token, place, item_id) for each shingle of each window of each item; `window` is its words, joined."""
    names = ["window", "size", "length", "token", "place", "item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words, out = item_words(text), []
                if not words:
                    continue
                length = min(shingle, size, len(words))
                tokens = _window_shingles(words, length).view(np.int64).tolist()
                wide = min(size, len(words))
                for i in range(len(words) - wide + 1):
                    body = b" ".join(words[i : i + wide]).decode()
                    out += [(body, wide, length, t, k, item) for k, t in enumerate(tokens[i : i + wide - length + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=names)

    return run


_PLACES = "key binary, n_words long, at long, length int, token long, before int, around string"


def _places(shared, sizes: list[int], window: int):
    """For each text a row with its number of words, and one for each place of a token that passes the sieve, with the words
    around it that a window can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in _PLACES.split(", ")]
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for lo, _hi, data, offsets in text_steps(batch):
                mapped, starts, ends, first = word_spans(data, offsets)
                hashes = word_hashes(mapped, starts, ends)
                rows = [(keys[lo + i], n, None, None, None, None, None) for i, n in enumerate(np.diff(first).tolist())]
                for length in sizes:
                    hashed, at = shingles(hashes, first, length, short=False)
                    where = np.arange(len(hashed)) if sieve is None else np.flatnonzero(_may_be(hashed, sieve))
                    for p, row in zip(where.tolist(), (np.searchsorted(at, where, side="right") - 1).tolist(), strict=True):
                        begin, end = int(first[row]), int(first[row + 1])
                        word = begin + p - int(at[row])
                        s, e = max(begin, word - window + length), min(end, word + window)
                        around = b" ".join(mapped[x:y].tobytes() for x, y in zip(starts[s:e], ends[s:e], strict=True)).decode()
                        rows.append((keys[lo + row], end - begin, word - begin, length, int(hashed[p].view(np.int64)), word - s, around))
                        if len(rows) > 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _may_be(tokens: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Whether the upper halves of tokens are among the sorted ones of the sieve."""
    half = (tokens >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(sieve, half), len(sieve) - 1)
    return sieve[at] == half if len(sieve) else np.zeros(len(tokens), bool)


def _joined_windows(own: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame:
    """`find_contamination` by shuffles alone: no part of the benchmark and no text of a document is broadcast."""
    spark = own.sparkSession
    tokens = cut(items.filter("text is not null").mapInArrow(_item_tokens(window, shingle), "window string, size int, length int, token long, place int, item_id long"), "decontaminate-tokens")
    sizes = sorted(r.length for r in tokens.select("length").distinct().collect())
    halves = tokens.select(F.shiftrightunsigned("token", 32).alias("half")).distinct()
    sieve = None
    if halves.count() <= SIFTED:
        sieve = np.sort(np.array([r.half for r in halves.toLocalIterator()], np.int64).astype(np.uint32))
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    different = own.select(key.alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    places = cut(different.mapInArrow(_places(spark.sparkContext.broadcast(sieve), sizes, window), _PLACES), "decontaminate-places")
    met = places.filter("token is not null")
    counts = cut(met.groupBy("length", "token").agg(F.count("*").alias("n")), "decontaminate-counts")
    # The rarest token of each window, a token that no document has first of all: that window is nowhere.
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")
    prefix = tokens.drop("item_id").distinct().join(counts, ["length", "token"], "left").groupBy("window", "size", "length").agg(F.min(rank).alias("p"))
    prefix = prefix.select("window", "size", "length", "p.token", "p.place", "p.n").filter("n > 0")
    # Tokens of so many places that they are dealt to several tasks: 4,096 at most, by how many places there are.
    crowd = max(1000, met.count() // 4096)
    hot = F.broadcast(counts.filter(F.col("n") > crowd).select("length", "token", F.ceil(F.col("n") / crowd).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = prefix.join(hot, ["length", "token"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    asked = met.join(hot, ["length", "token"], "left").withColumn("part", F.pmod(F.xxhash64("key", "at"), parts).cast("int")).drop("parts")
    pairs = asked.join(dealt, ["length", "token", "part"])
    # Position: the window must begin and end inside the text; then word for word.
    begin = F.col("at") - F.col("place")
    inside = (begin >= 0) & (begin + F.col("size") <= F.col("n_words"))
    found = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("place") + 1, F.col("size")), " ")
    hits = cut(pairs.filter(inside).filter(found == F.col("window")).select("key", begin.alias("s"), (begin + F.col("size")).alias("e"), "window"), "decontaminate-hits")
    spans = hits.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("s", "e"))), lambda x: F.array(x["s"], x["e"]))).alias("spans"))
    named = hits.select("key", "window").distinct().join(tokens.select("window", "item_id").distinct(), "window").groupBy("key").agg(F.collect_set("item_id").alias("items"))
    by_text = places.filter("token is null").select("key", "n_words").join(spans, "key", "left").join(named, "key", "left")
    return own.withColumn("key", key).join(by_text, "key").select("doc_id", "text", "row", "n_words", "spans", "items")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = find_contamination(texts(docs), benchmark, window, shingle).drop("row", "text")
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """The rows of `docs`, all columns, that hold no window of the benchmark."""
    return find_contamination(docs, benchmark, window, shingle).filter(F.coalesce(F.size("spans"), F.lit(0)) <= 0).select("row.*")

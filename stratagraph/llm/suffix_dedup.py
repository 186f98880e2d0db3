"""Exact removal of repeated byte strings by sharded suffix arrays.

Every string of `window` bytes that starts at two places or more of the corpus is found, and each byte that such a string
covers is removed. No place is compared with all others:

1. Equal texts become one (map-side combined). Each text is cut, by the least hash among the `gram`-byte strings of each
   window, into runs of window starts that belong to the same anchor string; equal windows have equal anchors.
2. Anchors met at one place only are done: nothing repeats there. Where an anchor's whole segments (all bytes of the run's
   windows) are equal, they repeat as a whole and go on as one.
3. The different segments of an anchor go to a shard. Its suffix array is refined by Larsson and Sadakane's doubling: after a
   first sort, only suffixes whose rank is still shared are sorted again, by the rank of the suffix that many bytes on. The
   common prefixes of neighbours come from Kasai's observation that a prefix shortens by at most one from a place to the
   next: only places where the preceding bytes differ are compared. Neighbours with `window` bytes in common repeat.
4. An anchor of many different segments is split over shards. Each shard's distinct windows, sorted by their digests, are its
   run; the run is cut at as many equal steps as there are shards, by binary search, and what lies in one step of all runs meets.
   There run after run is merged into those before it: where each of its windows belongs is found by binary search, and a window
   found there repeats in both shards.

Segments of one anchor string are told apart by 64 bits of hashes and their length; texts by 128 bits of SHA-256; windows of one
shard by their bytes; windows across shards by 128 bits.

Defined results: null is the empty text; texts shorter than a window keep all; equal texts of a window or more lose all; matches
never cross texts; repeats inside one text count, overlapping or not; ids may be null or repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, grouped, large_binary, passing, text_steps, texts, width
from .textnum import mix, powers, span_hashes

U64 = np.uint64


@dataclass(frozen=True)
class Repeats:
    window: int = 200
    gram: int = 64
    #: Bytes of segments in one suffix array, and different segments of one anchor before it is split.
    shard: int = 1 << 20
    split: int = 1024
    #: One text in `sample` tells which anchors are so common that their segments are dealt to all tasks: those of `hot` or more
    #: different segments there, 4,096 anchors at most. It only says how to deal, never what is found.
    sample: int = 64
    hot: int = 64

    def __post_init__(self) -> None:
        if not 0 < self.window - self.gram < 1 << 16:
            raise ValueError("the window must be longer than the anchor string, by less than 65536")


# Suffix arrays


def suffix_array(symbols: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, which end at `ends` (by place), up to `depth` bytes or more."""
    n = len(symbols)
    at = np.arange(n, dtype=np.int32)
    first = np.zeros(n, U64)
    for k in range(7):  # seven symbols of nine bits, 0 beyond the end
        inside = at + k < ends
        part = np.zeros(n, U64)
        part[: n - k] = symbols[k:].astype(U64) + U64(1)
        first |= np.where(inside, part, U64(0)) << U64(9 * (6 - k))
    order = np.argsort(first, kind="stable").astype(np.int32)
    sorted_keys = first[order]
    new = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
    head = np.maximum.accumulate(np.where(new, at, 0)).astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = head + 1
    shared = np.flatnonzero(~(new & np.r_[new[1:], True]))
    h = 7
    while h < depth and len(shared):
        places = order[shared]
        beyond = places + h
        inside = beyond < ends[places]
        second = np.where(inside, rank[np.where(inside, beyond, 0)], 0)
        keys = rank[places].astype(np.int64) << 32 | second
        turn = np.argsort(keys, kind="stable")
        places, keys = places[turn], keys[turn]
        order[shared] = places
        new = np.r_[True, keys[1:] != keys[:-1]]
        head = shared[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        rank[places] = head + 1
        shared = shared[~(new & np.r_[new[1:], True])]
        h *= 2
    return order


def common_prefixes(symbols: np.ndarray, ends: np.ndarray, starts: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each place the length, up to `limit`, that it has in common with its predecessor in the suffix array."""
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    # A place follows from the one before it if both preceding bytes exist and are equal.
    follows = (at > starts) & (before > starts[before]) & (before >= 0)
    follows[follows] = symbols[at[follows] - 1] == symbols[before[follows] - 1]
    # ... and if that one's predecessor is the one before ours.
    follows[1:] &= before[:-1] == before[1:] - 1
    bare = np.flatnonzero(~follows)
    length = np.zeros(n, np.int64)
    live = bare[before[bare] >= 0]
    # Beyond the limit too, so that places which follow have theirs: up to the end of the shorter suffix.
    most = np.minimum(ends[live] - live, ends[before[live]] - before[live])
    done = 0
    while len(live):
        same = done < most
        same[same] = symbols[live[same] + done] == symbols[before[live[same]] + done]
        length[live[~same]] = done
        live, most = live[same], most[same]
        done += 1
    origin = np.maximum.accumulate(np.where(~follows, at, 0))
    return np.minimum(np.maximum(length[origin] - (at - origin), 0), limit)


def repeated_starts(segments: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(repeats: by place of the joined segments whether its window occurs twice; order of the suffixes that have a window;
    whether a place in that order has a new window; ends of the segments)."""
    sizes = np.array([len(s) for s in segments])
    ends_of = np.cumsum(sizes)
    symbols = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.repeat(ends_of, sizes).astype(np.int32)
    starts = np.repeat(ends_of - sizes, sizes).astype(np.int64)
    order = suffix_array(symbols, ends, window)
    prefix = common_prefixes(symbols, ends, starts, order, window)
    whole = order[ends[order] - order >= window]
    fresh = prefix[whole] < window
    # A suffix without a window can't stand between two that share one.
    if len(whole):
        fresh[0] = True
    alone = fresh & np.r_[fresh[1:], True]
    repeats = np.zeros(len(symbols), bool)
    repeats[whole[~alone]] = True
    return repeats, whole, fresh, ends_of


def intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true values."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# Anchors


def _sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    out, have = x, 1
    while have * 2 <= size:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = size - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, p: Repeats) -> tuple[np.ndarray, ...]:
    """(text, start, end, anchor hash, segment hash) of each run of window starts, places counted within the text."""
    n, wide = len(data), p.window - p.gram + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.add.accumulate((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    short = (sums[p.gram :] - sums[: -p.gram]) * down[: n - p.gram + 1]
    short ^= short >> U64(29)
    short *= U64(0xBF58476D1CE4E5B9)
    tagged = (short >> U64(32) << U64(32)) | np.arange(len(short), dtype=U64)
    least = (_sliding_least(tagged, wide) & U64(0xFFFFFFFF)).astype(np.int64)  # by window start
    lengths = np.diff(offsets)
    count = np.maximum(lengths - p.window + 1, 0)
    text = np.repeat(np.arange(len(lengths)), count)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    place = least[offsets[text] + inner] if len(text) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    text = text[first]
    start = inner[first]
    end = inner[np.r_[first[1:], len(place)] - 1] + 1 if len(first) else start
    anchor = span_hashes(sums, place[first], place[first] + p.gram)
    segment = span_hashes(sums, offsets[text] + start, offsets[text] + end + p.window - 1)
    return text, start, end, anchor, segment


_PACKED = "part int, keys binary, owner binary, start binary, size binary, anchor binary, segment binary, done binary"


def _pack_anchors(p: Repeats, parts: int, hot: np.ndarray):
    """Anchors in packed rows, one for each part; of those whose segment was met already in the same step, `done` is 1, and
    only one of equal ones goes on to the anchor's own part or, if the anchor is hot, to the segment's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([h[0] for h in held])
            owner, start, end, anchor, segment = (np.concatenate([h[i] for h in held]) for i in range(1, 6))
            order = np.lexsort((segment, anchor))
            same = np.r_[False, (anchor[order][1:] == anchor[order][:-1]) & (segment[order][1:] == segment[order][:-1])]
            done = np.zeros(len(order), np.uint8)
            done[order[same | np.r_[same[1:], False]]] = 1
            done[order[same]] = 2  # not the first of its kind: it has its answer and no one needs it
            to = (np.where(np.isin(anchor, hot), mix(anchor ^ segment * U64(0xD6E8FEB86659FD93)), anchor) % U64(parts)).astype(np.int64)
            again = np.flatnonzero(done == 2)
            to[again] = np.arange(len(again)) % parts
            by = np.argsort(to, kind="stable")
            at = np.searchsorted(to[by], np.arange(parts + 1))
            rows = []
            for part in range(parts):
                own = by[at[part] : at[part + 1]]
                if len(own):
                    used, index = np.unique(owner[own], return_inverse=True)
                    rows.append((part, keys[used].tobytes(), index.astype(np.int32).tobytes(), start[own].astype(np.int32).tobytes(), (end - start)[own].astype(np.uint16).tobytes(), anchor[own].tobytes(), segment[own].tobytes(), done[own].tobytes()))
            names = [c.split()[0] for c in _PACKED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 0 else pa.binary()) for i, x in enumerate(zip(*rows, strict=True))], names=names)

        texts_so_far = 0
        for batch in batches:
            raw, _ = large_binary(batch.column("key"))
            keys = raw.reshape(-1, 16)
            for lo, hi, data, offsets in text_steps(batch):
                text, *rest = anchors(data, offsets, p)
                held.append((keys[lo:hi], text + texts_so_far, *rest))
                texts_so_far += hi - lo
                size += len(text)
                if size > 300_000:
                    yield from out()
                    held, size, texts_so_far = [], 0, 0
        if held:
            yield from out()

    return run


_PLACES = "key binary, start int, size int, anchor long, kind int, kinds int"


def _sampled(p: Repeats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_steps(batch):
                *_, anchor, segment = anchors(data, offsets, p)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64))], names=["anchor", "segment"])

    return run


def hot_anchors(different: DataFrame, p: Repeats) -> dict[int, int]:
    """(anchor, how many different segments it may have) of the commonest anchors, judged by a sample of texts."""
    some = different.filter(F.pmod(F.xxhash64("key"), F.lit(p.sample)) == 0).select("text").mapInArrow(_sampled(p), "anchor long, segment long")
    counted = some.groupBy("anchor").agg(F.count_distinct("segment").alias("n")).filter(F.col("n") >= p.hot)
    return {r.anchor & (2**64 - 1): r.n * p.sample for r in counted.orderBy(F.desc("n"), "anchor").limit(4096).collect()}


def _meet(hot: dict[int, int]):
    """Of all anchors of a part: kind 0, segments that occur twice; where an anchor has several segments, one of each: kind 1 if
    it occurs once, 2 if it has its answer. A hot anchor's segments are in many parts, and their number is the sample's."""
    names, sizes = np.array(sorted(hot), U64), np.array([hot[k] for k in sorted(hot)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["part"]):
            yield from _met(group.to_pylist(), names, sizes)

    return run


def _met(rows: list[dict], hot: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys, owner, at = [], [], 0
    for r in rows:
        own = np.frombuffer(r["keys"], np.uint8).reshape(-1, 16)
        keys.append(own)
        owner.append(np.frombuffer(r["owner"], np.int32) + at)
        at += len(own)
    keys_, owner_ = np.concatenate(keys), np.concatenate(owner)
    start, size, anchor, segment, done = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("start", np.int32), ("size", np.uint16), ("anchor", U64), ("segment", U64), ("done", np.uint8)))
    again = done == 2

    def out(which: np.ndarray, kind: int, kinds) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(which), 50_000):
            w = which[lo : lo + 50_000]
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(w), [None, pa.py_buffer(np.ascontiguousarray(keys_[owner_[w]]).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([raw, pa.array(start[w]), pa.array(size[w].astype(np.int32)), pa.array(anchor[w].view(np.int64)), pa.array(np.full(len(w), kind, np.int32)), pa.array(np.asarray(kinds[lo : lo + 50_000] if len(kinds) else np.zeros(len(w)), np.int32))], names=[c.split()[0] for c in _PLACES.split(", ")])

    yield from out(np.flatnonzero(again), 0, [])
    left = np.flatnonzero(~again)
    order = left[np.lexsort((segment[left], anchor[left]))]
    if not len(order):
        return
    new_anchor = np.r_[True, anchor[order][1:] != anchor[order][:-1]]
    new = new_anchor | np.r_[True, segment[order][1:] != segment[order][:-1]]
    group = np.cumsum(new) - 1
    many = (np.bincount(group) > 1) | (np.maximum.reduceat(done[order], np.flatnonzero(new)) > 0)  # by segment
    yield from out(order[many[group]], 0, [])
    head = order[new]
    family = (np.cumsum(new_anchor) - 1)[new]
    kinds = np.bincount(family)[family]
    if len(hot):
        known = np.minimum(np.searchsorted(hot, anchor[head]), len(hot) - 1)
        kinds = np.where(hot[known] == anchor[head], np.maximum(sizes[known], 2), kinds)
    for kind, mine in ((1, ~many), (2, many)):
        some = np.flatnonzero((kinds > 1) & mine)
        yield from out(head[some], kind, kinds[some])


_BODIES = "key binary, start int, anchor long, kind int, salt int, shards int, body binary"


def _segments(p: Repeats):
    names = [c.split()[0] for c in _BODIES.split(", ")]
    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def table(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], t) for i, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for key, text, places in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("places").to_pylist(), strict=True):
                for x in places:
                    body = text[x["start"] : x["start"] + x["size"] + p.window - 1]
                    shards = -(-x["kinds"] // p.split)
                    salt = int.from_bytes(hashlib.blake2b(body, digest_size=4).digest()) % shards if shards > 1 else -1
                    held.append((key, x["start"], x["anchor"], x["kind"], salt, shards, body))
                    if len(held) >= 20_000:
                        yield table(held)
                        held = []
            yield table(held)

    return run


def merged_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of each run (upper and lower halves of different digests, in the order of the upper) which are in another run too.

    Two runs at a time become one: binary search of the second's digests in the first says which are there, and where the others
    go."""
    hit = [np.zeros(len(high), bool) for high, _ in runs]
    flat, first = np.concatenate(hit or [np.zeros(0, bool)]), np.cumsum([0] + [len(h) for h in hit])
    left = [(high, low, np.arange(first[k], first[k + 1])) for k, (high, low) in enumerate(runs)]
    while len(left) > 1:
        pairs = [(*left[k], *left[k + 1]) for k in range(0, len(left) - 1, 2)]
        left = left[len(left) & ~1 :]
        for high, low, who, high2, low2, who2 in pairs:
            lo, hi = np.searchsorted(high, high2, side="left"), np.searchsorted(high, high2, side="right")
            there, k, open_ = np.full(len(high2), -1), 0, np.flatnonzero(hi > lo)
            while len(open_):  # of equal upper halves, hardly ever more than one
                at = lo[open_] + k
                same = low[at] == low2[open_]
                there[open_[same]] = at[same]
                k += 1
                open_ = open_[~same]
                open_ = open_[lo[open_] + k < hi[open_]]
            found, fresh = np.flatnonzero(there >= 0), np.flatnonzero(there < 0)
            flat[who[there[found]]] = flat[who2[found]] = True
            left.append((np.insert(high, hi[fresh], high2[fresh]), np.insert(low, hi[fresh], low2[fresh]), np.insert(who, hi[fresh], who2[fresh])))
    return [flat[first[k] : first[k + 1]] for k in range(len(runs))]


#: Repeated starts (key, a, b), or a step of a shard's run: digests in their order, and of each its place and whether it asks; `key`
#: then joins the keys of those that ask.
_FOUND = "key binary, a int, b int, anchor long, step int, shard int, digests binary, places binary, asks binary"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_TYPES = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _suffixes(p: Repeats):
    """Repeated starts (key, a, b) of the segments of whole anchors; for shards of a split one also the steps of their runs."""

    def search(rows: list[dict], shards: int) -> Iterator[dict]:
        bodies = [r["body"] for r in rows]
        repeats, whole, fresh, ends = repeated_starts(bodies, p.window)
        begin = 0
        for r, end in zip(rows, ends.tolist(), strict=True):
            if r["kind"] == 1:
                a, b = intervals(repeats[begin : end - p.window + 1])
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    yield {"key": r["key"], "a": r["start"] + x, "b": r["start"] + y}
            begin = end
        if shards > 1:
            joined, at = b"".join(bodies), whole[fresh].astype(np.int64)
            digests = np.frombuffer(b"".join(hashlib.blake2b(joined[i : i + p.window], digest_size=16).digest() for i in at.tolist()), U64).reshape(-1, 2)
            order = np.argsort(digests[:, 0], kind="stable")
            digests, at = np.ascontiguousarray(digests[order]), at[order]
            owner = np.searchsorted(ends, at, side="right")
            lengths, starts, kinds = (np.array([f(r) for r in rows]) for f in (lambda r: len(r["body"]), lambda r: r["start"], lambda r: r["kind"]))
            places = (starts[owner] + at - (ends[owner] - lengths[owner])).astype(np.int32)
            asks = ((kinds[owner] == 1) & ~repeats[at]).astype(np.uint8)
            keys = np.frombuffer(b"".join(r["key"] for r in rows), np.uint8).reshape(-1, 16)
            steps = np.searchsorted(digests[:, 0], np.array([(k << 64) // shards for k in range(1, shards)], U64))
            for step, (x, y) in enumerate(zip([0, *steps.tolist()], [*steps.tolist(), len(at)], strict=True)):
                if y > x:
                    yield {"key": keys[owner[x:y][asks[x:y] > 0]].tobytes(), "anchor": rows[0]["anchor"], "step": step, "shard": rows[0]["salt"], "digests": digests[x:y].tobytes(), "places": places[x:y].tobytes(), "asks": asks[x:y].tobytes()}

    def table(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f.get(c) for f in found], t) for c, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        found: list[dict] = []
        size = 0
        for group in grouped(batches, ["anchor", "salt"]):
            rows = group.to_pylist()
            split = rows[0]["salt"] >= 0
            if split:
                found += search(rows, rows[0]["shards"])
            else:
                waiting += rows
                size += sum(len(r["body"]) for r in rows)
            if size > p.shard:
                found += search(waiting, 1)
                waiting, size = [], 0
            if split or len(found) > 20_000:
                yield table(found)
                found = []
        if waiting:
            found += search(waiting, 1)
        yield table(found)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same step of the runs of all shards of an anchor: windows that ask and are in another run too."""
    for group in grouped(batches, ["anchor", "step"]):
        rows = group.to_pylist()
        halves = [np.frombuffer(r["digests"], U64).reshape(-1, 2) for r in rows]
        for r, hit in zip(rows, merged_runs([(x[:, 0], x[:, 1]) for x in halves]), strict=True):
            asks = np.frombuffer(r["asks"], np.uint8) > 0
            own, places = hit[asks], np.frombuffer(r["places"], np.int32)[asks]
            keys = [r["key"][16 * i : 16 * i + 16] for i in np.flatnonzero(own).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(places[own], pa.int32()), pa.array(places[own] + 1, pa.int32())], names=["key", "a", "b"])


def covered(length: int, places: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Disjoint byte spans covered by windows that start in the places [a, b)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        b = min(b + window - 1, length)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def key_of(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def find_repeats(docs: DataFrame, p: Repeats = Repeats()) -> tuple[DataFrame, DataFrame]:
    """(different texts of a window or more with how many have it (key, text, n), places (key, a, b) where repeats start)."""
    spark = docs.sparkSession
    parts = width(spark)
    long_texts = texts(docs).filter(F.octet_length("text") >= p.window).select(key_of(F.col("text")).alias("key"), "text")
    different = cut(long_texts.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n")), "repeats-texts")
    hot = hot_anchors(different, p)
    # More parts than tasks: a task takes one after another.
    fine = max(parts, min(4 * parts, 4096))
    packed = different.select("key", "text").mapInArrow(_pack_anchors(p, fine, np.array(sorted(hot), U64)), _PACKED)
    places = cut(packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_meet(hot), _PLACES), "repeats-places")
    asked = places.filter("kind > 0").groupBy("key").agg(F.collect_list(F.struct("start", "size", "anchor", "kind", "kinds")).alias("places"))
    bodies = different.select("key", "text").join(asked, "key").mapInArrow(_segments(p), _BODIES)
    found = cut(bodies.repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_suffixes(p), _FOUND), "repeats-found")
    steps = found.filter("digests is not null").repartition(parts, "anchor", "step").sortWithinPartitions("anchor", "step", "shard")
    starts = places.filter("kind = 0").select("key", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    return different, starts.union(found.filter("digests is null").select("key", "a", "b")).union(steps.mapInArrow(_merge, "key binary, a int, b int"))


def _remove(p: Repeats, whole_characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests, kept_texts = [], [], [], []
            for text, n, places in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("n").to_pylist(), batch.column("places").to_pylist(), strict=True):
                gone = [(0, len(text))] if n > 1 else covered(len(text), [(x["a"], x["b"]) for x in places or []], p.window)
                if whole_characters:  # a character goes if it is covered as a whole
                    gone = [(a, b) for a, b in (_inward(text, a, b) for a, b in gone) if b > a]
                kept, at = [], 0
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                removed.append(len(text) - len(rest))
                spans.append(len(gone))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept_texts.append(rest.decode() if whole_characters else None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _inward(text: bytes, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def removals(docs: DataFrame, p: Repeats = Repeats(), whole_characters: bool = False) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256, kept) for each different text that loses anything; `kept` is null unless whole
    characters are asked for. It is written, so that the tables it comes from are gone before it is used."""
    with passing() as keep:
        different, starts = find_repeats(docs, p)
        by_text = starts.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("places"))
        touched = different.join(by_text, "key", "left").filter("n > 1 or places is not null")
        lost = touched.select("key", "text", "n", "places").mapInArrow(_remove(p, whole_characters), "key binary, n_removed long, n_spans long, kept_sha256 string, kept string")
        return keep(cut(lost, "repeats-lost"))


def remove_repeats(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    lost = removals(docs, p).drop("kept")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = texts(docs).select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha")).withColumn("key", F.substring(F.unhex("sha"), 1, 16))
    return own.join(lost, "key", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def strip_repeats(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """The rows of `docs`, all columns, with repeats cut out of the text (whole characters only); texts left empty go."""
    names = docs.columns
    lost = removals(docs, p, whole_characters=True).select(F.col("key").alias("stratagraph_key"), F.col("kept").alias("stratagraph_kept"))
    found = docs.withColumn("stratagraph_key", key_of(F.col("text").cast("string"))).join(lost, "stratagraph_key", "left")
    text = F.coalesce("stratagraph_kept", F.col("text"))
    size = [F.when(F.col("stratagraph_kept").isNull(), F.col(c)).otherwise(F.length("stratagraph_kept")).cast(t).alias(c) if c == "n_chars" else (text.alias(c) if c == "text" else F.col(c)) for c, t in docs.dtypes]
    return found.filter("stratagraph_kept is null or stratagraph_kept <> ''").select(*size).select(*names)

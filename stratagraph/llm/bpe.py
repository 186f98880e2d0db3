"""Byte-pair encoding by a tokenization automaton.

The merges are compiled, one gadget after another, into a deterministic automaton whose arcs are tokens and which accepts
just the token sequences that merging would give. All arcs of one token lead to one state. The gadget of merge (u, v) gives
the state behind u a new version without its arc v, and gives every state with an arc u an arc uv, which leads where v led
at that time. A version is named by its token and the rank of the merge; a state's row of arcs is kept as what each version
lost (`lacks`) and when each arc came (`born`, `left`, `right`).

Words are read by a second table, (state, symbol) -> state, over the symbols that the arcs' labels spell. A state of it says
which arc of the first automaton was taken last and which longer arcs are on their way; it has one accepted path at most, as
the first automaton has one for each text. The table is filled in as states are reached, by the subset construction, and
starts anew when it holds `MOST_STATES`. A word's encoding is one transition for each of its symbols and, from the end, the
arc that each state met was reached by; its decoding is those arcs' labels.

Defined results: null and empty texts have no token and decode to the empty text; special tokens standing in a text are their
own pieces; characters that the vocabulary lacks are left out; very long pieces are read without recursion. A vocabulary in
which two live merges make one token is refused.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts

SEPARATORS = regex.compile("[\x1c-\x1f]")
NO_SPACE = regex.compile(r"\S+")

#: Distinct pieces in the younger of the two generations that a Python worker keeps, over its tasks.
KEPT_PIECES = 250_000
#: States of the table of symbols that a worker keeps.
MOST_STATES = 300_000
_encoders: dict[tuple, Encoder] = {}


def encoder_of(key: tuple, automaton: Automaton) -> Encoder:
    """The worker's encoder for that tokenizer, with the pieces it has met in earlier tasks."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(automaton)
    return _encoders[key]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


#: Letters and numbers that the tokenizer's Unicode version (16) has beyond the standard library's (15.1).
ASSIGNED_SINCE = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
#: Capital letters that the standard library does not know yet, first and last, and the first's small letter.
CAPITALS_SINCE = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: As a table for single characters, with the capital that the library makes no final letter of.
SMALL = {first + i: small + i for first, last, small in CAPITALS_SINCE for i in range(last - first + 1)} | {ord("Σ"): ord("σ")}
CAPITAL = regex.compile("[" + "".join(map(chr, SMALL)) + "]")


@lru_cache(1)
def newer_letters() -> frozenset[str]:
    """Letters and numbers of `regex`'s Unicode version that the tokenizer's has not assigned."""
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    known = {chr(c) for first, last in ASSIGNED_SINCE for c in range(first, last + 1)}
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if c not in known and unicodedata.category(c) == "Cn")


class Automaton:
    """The compiled table of one tokenizer."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>", special: dict[str, int] | None = None, pattern: str = r"\S+") -> None:
        self.end, self.special, self.pattern = end, special or {}, pattern
        size = max([*vocabulary.values(), *self.special.values(), 0]) + 1
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.lacks: dict[int, int] = {}  # (token before << 20 | arc): the rank from which the arc is gone
        labels = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.labels = [labels.get(i, "") for i in range(size)]
        live = {i for t, i in vocabulary.items() if len(t) == 1 or end and len(t) == 1 + len(end) and t.endswith(end)}
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if u in live and v in live and self.opens(u, v, rank - 1):
                if w in live:
                    raise ValueError(f"two merges make {a + b!r}")
                self.left[w], self.right[w], self.born[w] = u, v, rank
                self.lacks[u << 20 | v] = rank
                live.add(w)
        self.live = sorted(live)

    def lost(self, before: int, arc: int, rank: int = 1 << 30) -> int | None:
        """None if the state behind the token `before`, in its version after `rank`, has the arc; else the rank of the merge that took it,
        or an arc that it came from, away."""
        left, right, born, lacks = self.left, self.right, self.born, self.lacks
        while True:
            when = lacks.get(before << 20 | arc)
            if when is not None and when <= rank:
                return when
            if born[arc] >= born[before]:
                if born[arc] < 0:
                    return None
                rank, arc = born[arc], left[arc]
            else:
                rank, before = born[before] - 1, right[before]

    def opens(self, before: int, arc: int, rank: int = 1 << 30) -> bool:
        """Whether that state has the arc; the start, before any token (-1), has all."""
        return before < 0 or self.lost(before, arc, rank) is None


def load(path: str) -> Automaton:
    """The automaton of a tokenizer file (JSON with a BPE model); the file stays where it is."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
    return Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "", {t["content"]: t["id"] for t in spec["added_tokens"]}, pattern)


#: What stands for the last byte of a word where the vocabulary marks word ends: the byte plus this.
LAST = 256


class Table:
    """(state, symbol) -> state: the automaton's arcs spelt out in symbols and made deterministic.

    A state is (token, ways): the token that the text so far ends in on its accepted path (-1 at the start, -2 if there is no
    path), and the longer arcs on their way: pairs (token behind which the arc starts, place in the trie of labels)."""

    def __init__(self, automaton: Automaton) -> None:
        self.a = automaton
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        end = automaton.end
        self.children: dict[int, int] = {}  # place << 9 | symbol -> place
        self.arc_at: list[int] = [-1]
        self.inside: list[bool] = [False]  # whether the place has children
        self.length: dict[int, int] = {}
        self.first: dict[int, int] = {}  # the arc of a single symbol
        self.made: dict[int, list[int]] = {}  # the arcs made of an arc and a further one
        for token in sorted(automaton.live, key=lambda t: (automaton.born[t], t)):
            label = automaton.labels[token]
            last = bool(end) and label.endswith(end)
            symbols = [byte_of[c] for c in (label[: -len(end)] if last else label)]
            if last:
                symbols[-1] += LAST
            place = 0
            for s in symbols:
                following = self.children.get(place << 9 | s)
                if following is None:
                    following = self.children[place << 9 | s] = len(self.arc_at)
                    self.arc_at.append(-1)
                    self.inside.append(False)
                    self.inside[place] = True
                place = following
            self.arc_at[place] = token
            self.length[token] = len(symbols)
            if automaton.born[token] < 0:
                self.first[symbols[0]] = token
            else:
                self.made.setdefault(automaton.left[token], []).append(token)
        self.symbols = {s for s in range(2 * LAST) if s in self.children}
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.ways: list[tuple[tuple[int, int], ...]] = [()]
        self.number: dict[tuple, int] = {(-1, ()): 0}
        self.begins: dict[int, bool] = {}

    def _begins(self, before: int, symbol: int) -> bool:
        """Whether any arc of the state behind `before` begins with the symbol."""
        if before < 0:
            return True
        key = before << 9 | symbol
        found = self.begins.get(key)
        if found is None:
            a, open_ = self.a, [self.first[symbol]] if symbol in self.first else []
            found = False
            while open_ and not found:
                arc = open_.pop()
                when = a.lost(before, arc)
                found = when is None
                # What was made of the arc before it was lost may be left.
                open_ += [] if found else [w for w in self.made.get(arc, ()) if a.born[w] < when]
            self.begins[key] = found
        return found

    def step(self, state: int, symbol: int) -> int:
        """The transition, worked out and kept."""
        a, token, ways = self.a, -2, []
        before = self.ends[state]
        for q, place in (*((() if before == -2 else ((before, 0),))), *self.ways[state]):
            following = self.children.get(place << 9 | symbol)
            if following is None:
                continue
            arc = self.arc_at[following]
            if arc >= 0 and a.opens(q, arc):
                token = arc
            if self.inside[following] and (place or self._begins(q, symbol)):
                ways.append((q, following))
        key = (token, tuple(ways))
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.ends)
            self.ends.append(token)
            self.ways.append(key[1])
        self.rows[state << 9 | symbol] = found
        return found

    def read(self, symbols: list[int]) -> list[int]:
        """The arcs of the accepted path that spells the symbols."""
        if len(self.ends) > MOST_STATES:
            self.clear()
        rows, state, met = self.rows, 0, []
        for s in symbols:
            try:
                state = rows[state << 9 | s]
            except KeyError:
                state = self.step(state, s)
            met.append(state)
        ends, length, path, at = self.ends, self.length, [], len(met)
        while at:
            token = ends[met[at - 1]]
            if token < 0:
                raise ValueError("a symbol that the vocabulary lacks")
            path.append(token)
            at -= length[token]
        path.reverse()
        return path


class Encoder:
    """Reads texts through an automaton."""

    def __init__(self, automaton: Automaton) -> None:
        self.a = automaton
        self.table = Table(automaton)
        self.newer = newer_letters()
        self.split = regex.compile(automaton.pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(automaton.special, key=len, reverse=True))) + ")") if automaton.special else None
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def walk(self, word: bytes) -> list[int]:
        """The encoding of a pre-split word; bytes that the vocabulary lacks are left out."""
        symbols = list(word)
        if self.a.end and symbols:
            symbols[-1] += LAST
        try:
            return self.table.read(symbols)
        except ValueError:
            return self.table.read([s for s in symbols if s in self.table.symbols])

    def piece(self, chunk: str) -> bytes:
        """Numbers, as little-endian 32 bits, of a run of characters without white space."""
        if chunk in self.older:
            found = self.pieces[chunk] = self.older[chunk]
            return found
        tokens: list[int] = []
        if self.newer.isdisjoint(chunk):
            words = self.split.findall(chunk)
        else:  # they split as symbols do
            masked = "".join("\ue000" if c in self.newer else c for c in chunk)
            words = [chunk[m.start() : m.end()] for m in self.split.finditer(masked)]
        for word in words:
            tokens += self.walk(word.encode())
        ids = array("I", tokens).tobytes()
        if len(chunk) < 256:
            if len(self.pieces) >= KEPT_PIECES:
                self.pieces, self.older = {}, self.pieces
            self.pieces[chunk] = ids
        return ids

    def normal(self, text: str) -> str:
        """Composed, lower-cased one character at a time (no final sigma)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return (text.translate(SMALL) if CAPITAL.search(text) else text).lower()

    def encode(self, text: str | None) -> bytes:
        """Numbers, as little-endian 32 bits, of a whole text."""
        ids: list[bytes] = []
        parts = self.cut.split(text) if self.cut and text and "<|" in text else [text or ""]
        for i, part in enumerate(parts):
            if i % 2:
                ids.append(array("I", [self.a.special[part]]).tobytes())
                continue
            for chunk in self.chunks(self.normal(part)):
                found = self.pieces.get(chunk)
                ids.append(self.piece(chunk) if found is None else found)
        return b"".join(ids)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Runs without white space; the separators 1C to 1F are none to the tokenizer."""
        return NO_SPACE.findall(text) if SEPARATORS.search(text) else text.split()

    def decode(self, ids: bytes) -> str:
        """The labels of a sequence of numbers, as the tokenizer without a decoder joins them."""
        return " ".join(map(self.a.labels.__getitem__, array("I", ids)))


def _encode(shared, key: tuple, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(key, shared.value)
        for whole, lo in ((b, lo) for b in batches for lo in range(0, len(b), 500)):  # few texts at once as Python strings
            batch = whole.slice(lo, 500)
            counts, digests, decoded, raw = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = encoder.encode(text)
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                if keep_text:
                    raw.append(ids)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())] if keep_text else columns, names=[*names, "ids"] if keep_text else names)

    return run


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text; the table of the vocabulary is what is broadcast."""
    automaton = load(path)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    key = (path, len(automaton.live), sum(automaton.lacks) & 0xFFFFFFFF)
    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts(docs).mapInArrow(_encode(shared, key, keep_ids), shape + ", ids binary" * keep_ids)

"""Byte-pair encoding and decoding by batched numpy merge rounds.

Works from the JSON file of a BPE tokenizer with word ends: NFC, white space to
one space, lower case, pieces by the file's own pattern, bytes as characters.
The symbols of many distinct pieces lie in one flat array; each round finds the
rank of every adjacent pair by binary search over sorted pair keys and merges
the lowest-ranked pair of each piece, in all pieces at once.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back

#: Pieces whose ids a task keeps; the store starts anew when it is full.
STORE_PIECES = 50_000
#: Bytes over which a piece is merged by itself; both ways give the same ids.
LONG_PIECE = 1000
#: Code points encoded together, at least one text.
BLOCK_CHARS = 300_000
_NO_RANK = np.iinfo(np.int64).max
_SHIFT = np.int64(1 << 20)
_SPACE = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte (printable Latin-1 for itself, the rest from 256 on)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file's tables; their size is fixed by the file, not by the data."""

    pattern: str
    first: np.ndarray  # id of each byte inside a piece
    last: np.ndarray  # id of each byte that ends a piece
    keys: np.ndarray  # sorted pair keys
    ranks: np.ndarray
    merged: np.ndarray
    tokens: list[str]
    special: dict[str, int]

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        chars = byte_characters()
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        keys = np.array([ids[a] * int(_SHIFT) + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max(*ids.values(), *special.values()) + 1)
        for token, i in {**ids, **special}.items():
            tokens[i] = token
        return Vocabulary(
            next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"),
            np.array([ids[c] for c in chars], np.int64), np.array([ids[c + suffix] for c in chars], np.int64),
            keys[order], order.astype(np.int64), np.array([ids[a + b] for a, b in pairs], np.int64)[order], tokens, special,
        )


def encode_long(vocab: Vocabulary, piece: bytes) -> np.ndarray:
    """Ids of one long piece, in time that grows with its merges instead of rounds times length.

    The same rounds, lowest rank first, but each touches only the places of its
    rank: symbols are linked to their neighbours, and a heap holds the ranks that
    have places.
    """
    flat = np.frombuffer(piece, np.uint8)
    symbols = vocab.first[flat]
    symbols[-1] = vocab.last[flat[-1]]
    n = len(symbols)
    after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
    places: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def meet(left: np.ndarray) -> None:
        """Note the pairs that begin at these places."""
        keys = symbols[left] * _SHIFT + symbols[after[left]]
        at = np.minimum(np.searchsorted(vocab.keys, keys), len(vocab.keys) - 1)
        hit = vocab.keys[at] == keys
        left, rank = left[hit], vocab.ranks[at[hit]]
        order = np.argsort(rank, kind="stable")
        left, rank = left[order], rank[order]
        for part in np.split(np.arange(len(rank)), np.flatnonzero(np.diff(rank)) + 1):
            if len(part):
                if (r := int(rank[part[0]])) not in places:
                    heapq.heappush(ranks, r)
                places.setdefault(r, []).append(left[part])

    by_rank = np.argsort(vocab.ranks)
    meet(np.arange(n - 1))
    while ranks:
        r = heapq.heappop(ranks)
        spots = np.unique(np.concatenate(places.pop(r)))
        key = vocab.keys[by_rank[r]]
        spots = spots[alive[spots] & (after[spots] < n)]
        spots = spots[symbols[spots] * _SHIFT + symbols[after[spots]] == key]
        # of overlapping spots (aaa) every second one, from the left, merges
        run = np.append(True, after[spots[:-1]] != spots[1:]) if len(spots) else np.empty(0, bool)
        head = np.maximum.accumulate(np.where(run, np.arange(len(spots)), 0))
        spots = spots[(np.arange(len(spots)) - head) % 2 == 0]
        if not len(spots):
            continue
        gone = after[spots]
        symbols[spots], alive[gone] = vocab.merged[by_rank[r]], False
        after[spots] = after[gone]
        inner = after[spots] < n
        before[after[spots[inner]]] = spots[inner]
        left = before[spots]
        meet(np.unique(np.concatenate([left[left >= 0], spots[inner]])))
    return symbols[alive].astype(np.int32)


def encode_pieces(vocab: Vocabulary, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of non-empty pieces, flat, and how many each has."""
    raw = [p.encode() for p in pieces]
    long = [i for i, x in enumerate(raw) if len(x) > LONG_PIECE]
    if long:
        ids = {i: encode_long(vocab, raw[i]) for i in long}
        flat, sizes = encode_pieces(vocab, [p for i, p in enumerate(pieces) if i not in ids]) if len(ids) < len(pieces) else (np.empty(0, np.int32), np.empty(0, np.int64))
        rest = iter(np.split(flat, np.cumsum(sizes)[:-1]))
        parts = [ids[i] if i in ids else next(rest) for i in range(len(pieces))]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
    lengths = np.array([len(x) for x in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    symbols = vocab.first[flat]
    ends = np.cumsum(lengths)
    symbols[ends - 1] = vocab.last[flat[ends - 1]]
    owner = np.repeat(np.arange(len(pieces)), lengths)
    done_symbols, done_owner = [], []
    while len(symbols):
        keys = symbols[:-1] * _SHIFT + symbols[1:]
        at = np.minimum(np.searchsorted(vocab.keys, keys), len(vocab.keys) - 1)
        hit = (vocab.keys[at] == keys) & (owner[:-1] == owner[1:])
        rank = np.append(np.where(hit, vocab.ranks[at], _NO_RANK), _NO_RANK)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(starts, len(symbols)))
        best = np.minimum.reduceat(rank, starts)
        busy = np.repeat(best != _NO_RANK, sizes)
        if not busy.all():
            done_symbols.append(symbols[~busy])
            done_owner.append(owner[~busy])
            if not busy.any():
                break
        take = busy & (rank == np.repeat(best, sizes))
        spots = np.flatnonzero(take)
        # of overlapping spots (aaa) every second one, from the left, merges
        run = np.append(True, np.diff(spots) != 1)
        head = np.maximum.accumulate(np.where(run, np.arange(len(spots)), 0))
        spots = spots[(np.arange(len(spots)) - head) % 2 == 0]
        symbols[spots] = vocab.merged[at[spots]]
        busy[spots + 1] = False
        symbols, owner = symbols[busy], owner[busy]
    symbols, owner = np.concatenate(done_symbols or [symbols]), np.concatenate(done_owner or [owner])
    order = np.argsort(owner, kind="stable")
    return symbols[order].astype(np.int32), np.bincount(owner, minlength=len(pieces)).astype(np.int64)


class Encoder:
    """Encodes texts, keeping the ids of pieces it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.find = regex.compile(vocab.pattern.replace(r"\s", _SPACE.pattern[1:-2])).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.flat, self.size = np.array([*self.vocab.special.values()], np.int32), np.ones(len(self.vocab.special), np.int64)
        self.specials = {s: i for i, s in enumerate(self.vocab.special)}

    def pieces(self, text: str) -> list[str]:
        """The normalised pieces of a text; special tokens stand alone, with a NUL before them."""
        if self.special and "<" in text and self.special.search(text):
            parts = self.special.split(text)
            return [p for i, part in enumerate(parts) for p in (["\0" + part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # one character at a time, as the final sigma has no rule of its own here
        return self.find(_SPACE.sub(" ", text).replace("Σ", "σ").lower())

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of each text's ids."""
        found = [self.pieces(t or "") for t in texts]
        if len(self.row) > STORE_PIECES:
            self._clear()
        new = [*dict.fromkeys(p for x in found for p in x if p not in self.row)]
        plain = [p for p in new if p[0] != "\0" or p[1:] not in self.specials]
        if plain:
            flat, size = encode_pieces(self.vocab, plain)
            first = len(self.size)
            self.row.update(zip(plain, range(first, first + len(plain)), strict=True))
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        self.row.update((p, self.specials[p[1:]]) for p in new if p not in self.row)
        counts = np.array([len(x) for x in found], np.int64)
        rows = np.fromiter((self.row[p] for x in found for p in x), np.int64, counts.sum())
        begin = np.cumsum(self.size) - self.size
        sizes = self.size[rows]
        total = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.repeat(begin[rows] - total[:-1], sizes) + np.arange(total[-1])]
        ends = total[np.cumsum(counts)]
        return ids, np.diff(np.append(0, ends))


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    start, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= BLOCK_CHARS or i == len(texts) - 1:
            yield texts[start : i + 1]
            start, chars = i + 1, 0


def _lists(flat: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), flat)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of the text's token ids (array<int>); a null text is taken as empty.

    Whole texts of any length are encoded. A column already named ``ids`` is
    replaced; all others stay, and don't go to Python. No rows in, no rows out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vocab = spark.sparkContext.broadcast(Vocabulary.load(path))

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocab.value)
        for batch in batches:
            parts = [encoder.encode(texts) for texts in _groups(batch.to_pylist())]
            yield pa.concat_arrays([_lists(pa.array(flat, pa.int32()), counts) for flat, counts in parts] or [pa.array([], pa.list_(pa.int32()))])
            give_back()

    # not deterministic: else Spark runs it once more for each use of its result
    return docs.select(*(c for c in docs.columns if c != ids), run.asNondeterministic()(text).alias(ids))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with a column of the ids' tokens joined by one space, special tokens included.

    Null or empty ids give an empty text; unknown ids raise an error.
    """
    spark = encoded.sparkSession
    bounded_batches(spark)
    tokens = spark.sparkContext.broadcast(pa.array(Vocabulary.load(path).tokens))

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts = pc.list_value_length(batch).to_numpy(zero_copy_only=False)
            yield pc.binary_join(_lists(tokens.value.take(batch.flatten()), counts), " ")
            give_back()

    names = [c for c in encoded.columns if c != text]
    whole = encoded.withColumn(ids, F.coalesce(ids, F.array().cast("array<int>")))
    return whole.select(*names, run.asNondeterministic()(ids).alias(text))

"""Importance resampling towards a target distribution, over hashed n-gram features with a head-tail vocabulary."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sections
from .common import Scratch

#: Words and pairs of the head, and the bytes that one of its words has at most: the broadcast is bounded whatever the corpus.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 1 << 15, 1 << 15, 64
#: Bytes of text handled together within a task.
BLOCK_BYTES = 1 << 20
#: Bytes outside 0-9, a-z, A-Z and above \x7F separate words; A-Z become a-z.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def _blocks(texts: Iterable[pa.Scalar]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words of some texts in a row, and how many each text has."""
    flat, sizes, total = [], [], 0
    for text in texts:
        raw = text.as_py() or ""
        found = words(raw)
        flat += found
        sizes.append(len(found))
        total += len(raw)
        if total >= BLOCK_BYTES:
            yield flat, np.array(sizes)
            flat, sizes, total = [], [], 0
    if sizes:
        yield flat, np.array(sizes)


@dataclass(frozen=True)
class Vocabulary:
    """CRC-32 of frequent words and frequent pairs; all others are computed where they are met.

    A pair goes on from the state of its first word, so the state of a run of
    words is that of the shorter run with a space and the next word added.
    ``pair_keys`` (first word * number of words + second, sorted) belong to ``pair_states``.
    """

    ids: dict[bytes, int]
    states: np.ndarray
    pair_keys: np.ndarray
    pair_states: np.ndarray

    @staticmethod
    def of(head: list[bytes], pairs: list[tuple[bytes, bytes]]) -> Vocabulary:
        ids = {w: i for i, w in enumerate(head)}
        states = np.array([zlib.crc32(w) for w in head], np.uint32)
        keys = np.array([ids[a] * len(head) + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        found = np.array([zlib.crc32(b" " + b, int(states[ids[a]])) for a, b in pairs], np.uint32)
        return Vocabulary(ids, states, keys[order], found[order])

    def runs(self, flat: list[bytes], sizes: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of run: CRC-32 of all runs within a text, and the text (its number) of each."""
        text = np.repeat(np.arange(len(sizes)), sizes)
        ids = np.fromiter(map(self.ids.get, flat, repeat(-1)), np.int64, len(flat))
        states = self.states[ids] if len(self.states) else np.zeros(len(flat), np.uint32)
        tail = np.flatnonzero(ids < 0)
        states[tail] = np.fromiter((zlib.crc32(flat[i]) for i in tail.tolist()), np.uint32, len(tail))
        yield states, text
        spaced = [b" " + w for w in flat] if longest > 1 else []
        for k in range(2, longest + 1):
            inside = np.flatnonzero(text[k - 1 :] == text[: len(text) - k + 1]) if len(text) >= k else np.zeros(0, np.int64)
            out, rest = np.zeros(len(text), np.uint32), inside
            if k == 2 and len(self.pair_keys):
                both = inside[(ids[inside] >= 0) & (ids[inside + 1] >= 0)]
                key = ids[both] * len(self.states) + ids[both + 1]
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                hit = self.pair_keys[at] == key
                out[both[hit]] = self.pair_states[at[hit]]
                rest = np.setdiff1d(inside, both[hit], assume_unique=True)
            before = states[rest].tolist()
            out[rest] = np.fromiter((zlib.crc32(spaced[i + k - 1], s) for i, s in zip(rest.tolist(), before, strict=True)), np.uint32, len(rest))
            states = out
            yield states[inside], text[inside]


def _frequent(found: Counter, most: int) -> Counter:
    """The counter's heaviest entries; what the others count at most is taken off all (a frequent-items summary)."""
    if len(found) <= 4 * most:
        return found
    cut = sorted(found.values(), reverse=True)[most]
    return Counter({w: n - cut for w, n in found.items() if n > cut})


def vocabulary(texts: DataFrame, longest: int, most_words: int = HEAD_WORDS, most_pairs: int = HEAD_PAIRS) -> Vocabulary:
    """Head of a table of one text column: its most frequent words, and pairs of them.

    Each task keeps a summary of bounded size, so what is shuffled grows with
    the tasks and not with the vocabulary. The head decides speed only: a word
    outside it gets the same CRC-32, computed directly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones: Counter = Counter()
        twos: Counter = Counter()
        for batch in batches:
            for flat, sizes in _blocks(batch.column(0)):
                ones.update(flat)
                if longest > 1:
                    ends = set((np.cumsum(sizes) - 1).tolist())
                    twos.update(p for i, p in enumerate(zip(flat, flat[1:], strict=False)) if i not in ends)
                ones, twos = _frequent(ones, most_words), _frequent(twos, most_pairs)
        rows = [(w, None, n) for w, n in ones.most_common(most_words) if len(w) <= HEAD_BYTES]
        rows += [(a, b, n) for (a, b), n in twos.most_common(most_pairs) if len(a) <= HEAD_BYTES and len(b) <= HEAD_BYTES]
        for at in range(0, len(rows), 10_000):
            a, b, n = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])

    seen = texts.mapInArrow(run, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    head = [bytes(r.a) for r in seen.filter("b is null").orderBy(F.desc("n"), "a").limit(most_words).collect()]  # HEAD_WORDS words of HEAD_BYTES at most
    if longest == 1:
        return Vocabulary.of(head, [])
    known = set(head)
    pairs = [(bytes(r.a), bytes(r.b)) for r in seen.filter("b is not null").orderBy(F.desc("n"), "a", "b").limit(most_pairs).collect()]  # HEAD_PAIRS at most
    return Vocabulary.of(head, [p for p in pairs if p[0] in known and p[1] in known])


def bucket_totals(texts: DataFrame, known: Vocabulary, longest: int, buckets: int) -> DataFrame:
    """bucket, n: how many features of a table of one text column fall in each bucket; buckets without any don't appear."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for flat, sizes in _blocks(batch.column(0)):
                for states, _ in shared.value.runs(flat, sizes, longest):
                    total += np.bincount(states % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: a thousand times the log ratio of the target's smoothed share of the bucket to the source's, rounded down."""
    of = lambda df, name: df.select("bucket", F.col("n").alias(name))
    each = source.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(of(source, "s"), "bucket", "left").join(of(target, "t"), "bucket", "left").fillna(0)
    whole = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    return each.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # whole is one row


def _noise(seed: int) -> Column:
    """Gumbel noise by seed and id, in thousandths."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, table: np.ndarray, known: Vocabulary, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of its features' gains) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast((table, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, vocab = shared.value
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for flat, sizes in _blocks(batch.column(1)):
                count, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                for states, text in vocab.runs(flat, sizes, longest):
                    ends = np.searchsorted(text, np.arange(len(sizes) + 1))
                    upto = np.concatenate(([0], np.cumsum(gain[states % np.uint32(len(gain))])))
                    count += np.diff(ends)
                    total += np.diff(upto[ends])
                n_words.append(sizes)
                n_features.append(count)
                weight.append(total)
            if n_words:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(c).astype(np.int64)) for c in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 2024, most_words: int = HEAD_WORDS, most_pairs: int = HEAD_PAIRS
) -> DataFrame:
    """Draw ``percent`` of docs (doc_id, text) without replacement, by how much more likely the target (text) is to hold their features.

    Words are runs of 0-9, letters a-z (A-Z lowered) and all characters above
    \\x7F; features are all runs of 1 to ``longest`` words of a text, repeats counted, hashed by CRC-32
    modulo ``buckets``. Returns every row of docs: doc_id, n_words, n_features, weight (sum of the
    features' gains, 0 without any), score (weight plus Gumbel noise by seed and doc_id)
    and rank: 1, 2, 3, ... for the drawn ones, null for the others. Drawn are the highest
    scores among documents of ``min_words`` words, ties to the smaller doc_id.

    Texts count whole; a null text has no words. Repeated rows count and are
    drawn as rows of their own; rows without an id share one noise and come first among ties.
    Other columns of docs are left out. Empty tables give an empty table; an empty target leaves the noise
    and the source's rarity to decide.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    source, wanted = docs.select("text"), target.select("text")
    known = vocabulary(source.unionByName(wanted), longest, most_words, most_pairs)
    of_bucket = gains(*(bucket_totals(t, known, longest, buckets) for t in (source, wanted)), buckets).collect()  # one row a bucket
    table = np.zeros(buckets, np.int64)
    table[[r.bucket for r in of_bucket]] = [r.gain for r in of_bucket]
    scored = scratch.write(weigh(docs, table, known, longest).withColumn("score", F.col("weight") + _noise(seed)), "scored")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    placed = sections.positions(able, [], "score", "doc_id", descending=True).withColumn("rank", F.when(F.col("position") <= drawn, F.col("position")))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return scratch.close(placed.select(*columns).unionByName(rest.select(*columns)))

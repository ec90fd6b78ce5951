"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters found with at most k edits shares m - q + 1 - kq of
its q-grams with the place where it stands, all on k + 1 neighbouring diagonals
(place in the text minus place in the passage). Shared q-grams are counted in
overlapping diagonal bands of that width; bands with enough of them are
verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, window_hash

Q, EDITS = 8, 0.1
#: Characters of benchmark text that are sent to the executors at once; more are handled in several passes.
PASS_CHARS = 2_000_000
#: Characters of documents handled at once, at least one text.
BLOCK_CHARS = 500_000
_BASE = 0x9E3779B97F4A7C15
_BITS = 22


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with each run of white space as one space, and where each stood."""
    low = text.lower()
    if len(low) != len(text):  # characters whose lower case is longer stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    points = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    first = space.copy()
    first[1:] &= ~space[:-1]
    keep = np.flatnonzero(~space | first)
    return np.where(space, np.uint32(32), points)[keep], keep


def edit_budget(m: int) -> int:
    """Edits allowed for a passage of m characters: a tenth, as long as a shared q-gram must remain."""
    return min(int(EDITS * m), (m - Q) // Q)


@dataclass
class Index:
    """Passages and their q-grams; its size is that of one pass of the benchmark."""

    ids: list[int]
    passages: list[np.ndarray]
    budget: np.ndarray
    need: np.ndarray
    grams: np.ndarray  # sorted distinct q-gram hashes
    begin: np.ndarray  # of each gram's postings
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray

    @staticmethod
    def build(rows: list[tuple[int, str]]) -> Index:
        ids, passages = [], []
        for i, text in rows:
            points = normalised(text or "")[0]
            low, high = (1 if len(points) and points[0] == 32 else 0), (len(points) - 1 if len(points) and points[-1] == 32 else len(points))
            points = points[low:high]
            if len(points) >= Q:
                ids.append(i)
                passages.append(points)
        lengths = np.array([len(p) for p in passages], np.int64)
        budget = np.array([edit_budget(m) for m in lengths], np.int64)
        hashes = [window_hash(p.astype(np.uint64), Q, _BASE) for p in passages]
        grams = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(passages)), lengths - Q + 1)
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(grams, kind="stable")
        distinct, begin = np.unique(grams[order], return_index=True)
        maybe = np.zeros(1 << _BITS, bool)
        maybe[(distinct >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return Index(ids, passages, budget, lengths - Q + 1 - Q * budget, distinct, np.append(begin, len(grams)), item[order], place[order], maybe)


def _fill(passage: np.ndarray, text: np.ndarray, diagonal: int, cost: np.ndarray, most: int) -> np.ndarray | None:
    """Edits after the whole passage on the diagonals from ``diagonal`` on, given those before it; None once all are over most.

    One row for each character of the passage, a vector over the diagonals. A
    place outside the text is a change like any other: it costs as much as dropping the character.
    """
    width = len(cost)
    around = np.full(len(passage) + width, -1, np.int64)
    low, high = max(0, diagonal), min(len(text), diagonal + len(around))
    if low < high:
        around[low - diagonal : high - diagonal] = text[low:high]
    steps, last = np.arange(width), np.full(width + 1, len(passage) + most + 1)
    new = np.empty_like(cost)
    for i, c in enumerate(passage.tolist()):
        # the same diagonal goes on by one character of each, the next one by one of the passage alone
        last[:-1] = cost
        np.add(cost, around[i : i + width] != c, out=new)
        np.minimum(new, last[1:] + 1, out=new)
        new -= steps
        np.minimum.accumulate(new, out=new)  # inserted characters of the text
        new += steps
        cost, new = new, cost
        if i & 3 == 3 and cost.min() > most:
            return None
    return cost


def distance(passage: np.ndarray, text: np.ndarray, diagonal: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits of the passage to a part of the text, with the part's bounds; None if over most.

    Banded alignment: the shared q-grams lie on the 2 * (most + 1) diagonals from
    ``diagonal`` on, and an alignment that holds one of them strays at most
    ``most`` diagonals from it; only cells on those are filled. Where the
    alignment begins is found backwards from its end.
    """
    diagonal -= most
    cost = _fill(passage, text, diagonal, np.zeros(4 * most + 2, np.int64), most)
    if cost is None or cost.min() > most:
        return None
    best = int(cost.argmin())
    end = diagonal + len(passage) + best
    offset = np.arange(2 * most + 1) - most
    back = _fill(passage[::-1], text[::-1], len(text) - end - most, np.where(offset < 0, len(passage) + most + 1, offset), len(passage))
    begin = end - len(passage) - int(offset[int(back.argmin())])
    return int(cost[best]), min(max(begin, 0), len(text)), min(max(end, 0), len(text))


def candidates(index: Index, points: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, passage, diagonal) of bands that hold as many shared q-grams as the lemma asks for.

    points are the joined texts, doc the number of each code point's document.
    Neighbouring bands of one document and passage give one candidate each; the
    diagonal is the band's first.
    """
    grams = window_hash(points.astype(np.uint64), Q, _BASE)
    spots = np.flatnonzero(index.maybe[(grams >> np.uint64(64 - _BITS)).view(np.int64)])
    found = np.searchsorted(index.grams, grams[spots])
    found = np.minimum(found, len(index.grams) - 1)
    real = (index.grams[found] == grams[spots]) & (doc[spots] == doc[np.minimum(spots + Q - 1, len(doc) - 1)])
    spots, found = spots[real], found[real]
    sizes = index.begin[found + 1] - index.begin[found]
    total = np.append(0, np.cumsum(sizes))
    posting = np.repeat(index.begin[found] - total[:-1], sizes) + np.arange(total[-1])
    item = index.item[posting]
    diagonal = np.repeat(spots, sizes) - index.place[posting] + (1 << 40)
    width = index.budget[item] + 1
    band = diagonal // width
    place, owner = index.place[posting], np.repeat(doc[spots], sizes)
    order = np.lexsort((place, band, item, owner))
    d, i, b, place = owner[order], item[order], band[order], place[order]
    if not len(d):
        return []
    other = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])
    new = np.flatnonzero(np.append(True, other))
    # a q-gram of the passage counts once in a band, however often the text repeats it
    count = np.add.reduceat(np.append(True, other | (place[1:] != place[:-1])).astype(np.int64), new)
    d, i, b = d[new], i[new], b[new]
    follows = np.append((d[1:] == d[:-1]) & (i[1:] == i[:-1]) & (b[1:] == b[:-1] + 1), False)
    with_next = count + np.where(follows, np.append(count[1:], 0), 0)
    ok = with_next >= index.need[i]
    return [(int(x), int(y), int(z * (index.budget[y] + 1) - (1 << 40))) for x, y, z in zip(d[ok], i[ok], b[ok], strict=True)]


def leaks_of(index: Index, texts: list[str | None]) -> list[list[dict]]:
    """Verified passages of each text, with places in the text as it is."""
    parts = [normalised(t or "") for t in texts]
    lengths = np.array([len(p) for p, _ in parts], np.int64)
    starts = np.cumsum(lengths) - lengths
    out: list[list[dict]] = [[] for _ in texts]
    if not index.ids or lengths.sum() < Q:
        return out
    points, doc = np.concatenate([p for p, _ in parts]), np.repeat(np.arange(len(texts)), lengths)
    for d, i, diagonal in candidates(index, points, doc):
        passage, most = index.passages[i], int(index.budget[i])
        body, where = parts[d]
        diagonal -= int(starts[d])
        low = max(0, diagonal - most)
        region = body[low : max(low, diagonal + len(passage) + 3 * most + 2)]
        at = region.tobytes().find(passage.tobytes())
        hit = (0, low + at // 4, low + at // 4 + len(passage)) if at >= 0 and at % 4 == 0 else distance(passage, body, diagonal, most)
        if hit and hit[2] > hit[1]:
            out[d].append({"item_id": index.ids[i], "start": int(where[hit[1]]), "end": int(where[hit[2] - 1]) + 1, "edits": hit[0]})
    return [_best(x) for x in out]


def _best(found: list[dict]) -> list[dict]:
    """Of overlapping finds of one passage (neighbouring bands) the one with fewest edits."""
    kept: list[dict] = []
    for x in sorted(found, key=lambda x: (x["item_id"], x["edits"], x["start"], x["end"])):
        if not any(x["item_id"] == y["item_id"] and x["start"] < y["end"] and y["start"] < x["end"] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x["start"], x["item_id"]))


_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
_LEAKS_NAME = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:int>>"


def _in_blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    start, size = 0, 0
    for n, text in enumerate(texts):
        size += len(text or "")
        if size >= BLOCK_CHARS or n == len(texts) - 1:
            yield texts[start : n + 1]
            start, size = n + 1, 0


def _scan(index: Broadcast):
    """The function of a text column that finds the index's passages."""

    @F.arrow_udf(_LEAKS_NAME)
    def run(texts: pa.Array) -> pa.Array:
        found = pa.array([x for block in _in_blocks(texts.to_pylist()) for x in leaks_of(index.value, block)], _LEAKS)
        give_back()
        return found

    # not deterministic: else Spark runs it once more for each filter on its result
    return run.asNondeterministic()


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "leaks") -> DataFrame:
    """docs with a column ``name``: array of (item_id, start, end, edits) of benchmark passages in each text.

    Places are code points of the text as it is. Case and the width of white
    space don't count. A null or empty text has no leaks; repeated rows have the
    same; passages that are null or shorter than Q characters are not searched.
    A column already named so is replaced, others stay. Only texts go to Python.
    Benchmark texts go to the executors PASS_CHARS at a time, chosen by a hash of
    their item, in as many passes as needed; a pass writes the hashes and leaks of
    the texts that have any, so one index is alive at a time and no text is written. An empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    passes = max(1, -(-chars // PASS_CHARS))
    names = [c for c in docs.columns if c != name]

    def index_of(number: int):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).orderBy("item_id", "text").collect()
        return spark.sparkContext.broadcast(Index.build([tuple(r) for r in rows]))

    if passes == 1:
        return docs.select(*names, _scan(index_of(0))("text").alias(name))
    key = [F.xxhash64("text").alias("__k1"), F.xxhash64(F.lit(0x5EED), "text").alias("__k2")]  # what a text holds follows from the text
    found = None
    for number in range(passes):
        shared = index_of(number)
        hits = docs.select(*key, _scan(shared)("text").alias("__leaks")).filter(F.size("__leaks") > 0).dropDuplicates(["__k1", "__k2"])
        hits = scratch.write(hits, f"pass-{number}")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    each = found.groupBy("__k1", "__k2").agg(F.array_sort(F.flatten(F.collect_list("__leaks"))).alias("__leaks"))
    met = docs.select(*names, *key).join(each, ["__k1", "__k2"], "left")
    return met.select(*names, F.coalesce("__leaks", F.array().cast(_LEAKS_NAME)).alias(name))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per passage found: doc_id, item_id, start, end, edits."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no benchmark passage, with the same columns."""
    return with_leaks(docs, benchmark, "__leaks").filter(F.size("__leaks") == 0).drop("__leaks")

"""Substring deduplication on a de Bruijn graph of words.

A window of WIDTH words is an edge from the node of its first to the node of
its last WIDTH - 1 words; an edge met at two places is repeated. Only windows
that can be repeated become edges: every window has a least k-mer (its anchor),
equal windows have equal anchors, so an anchor met once rules its windows out.
Repeated edges are counted by a join on their hash, and runs that follow the same
source without branching compact to paths. Each path carries the coordinates of
its source, whose words verify it: a path counts if both spans are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, join_seen, release_shuffles, signed, window_hash, word_hashes

WIDTH, KMER = 35, 12
#: Words of a source whose spans are read together.
SOURCE_BLOCK = 1024
_ANCHOR, _EDGE, _CHECK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum of every run of width values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def least(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """k-mer hashes of a text and the least one in each of its windows."""
    k = min(KMER, width)
    kmers = window_hash(h, k, _ANCHOR)
    return kmers, _sliding(kmers, width - k + 1, np.minimum)


def anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each k-mer that is least in some window; ties all count."""
    if len(h) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    kmers, low = least(h, width)
    w = len(kmers) - len(low) + 1
    edge = np.zeros(w - 1, np.uint64)
    places = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), w, np.maximum) == kmers)
    return kmers[places], places


def _hashed(column: pa.Array) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Row, words and word hashes of each text."""
    for at, words in blocks((t.as_py() for t in column), lower=False):
        h = word_hashes((w for x in words for w in x), sum(map(len, words)))
        start = 0
        for i, x in zip(at, words, strict=True):
            yield i, x, h[start : start + len(x)]
            start += len(x)


def digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, spans and text without repeated passages, one row per row of docs.

    A word goes if a window of ``width`` words that covers it starts anywhere
    else too, in this or another row; windows are judged on the input. spans
    lists (start, end) in words of what goes, text is the rest joined by one
    space. A null text is empty; texts shorter than a window stay whole; equal
    texts of two rows go wholly; a null or repeated doc_id is as good as any, as
    rows are matched by a 128-bit hash of their content. Other columns are ignored.
    An empty table gives an empty table.

    Edges meet by 96 bits of two independent hashes; a repeated span is then
    compared with its source's by a 128-bit hash of the words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id")).withColumn("key", F.unhex(F.md5("text")))
    keyed = keyed.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63))))

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            found = [anchors(h, width) for _, _, h in _hashed(batch.column(0))]
            rows = np.arange(number, number + len(found)) + (task << 33)
            number += len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column(1), batch.column(2), pa.array([signed(k) for k, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int32()))],
                ["row", "key", "id", "kmers", "places"],
            )

    def find_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            for i, _, h in _hashed(batch.column(0)):
                kmers, low = least(h, width)
                starts = np.flatnonzero(np.isin(low, kmers[places[i].values.to_numpy()]))
                edge, check = window_hash(h, width, _EDGE)[starts], window_hash(h, width, _CHECK)[starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(edge)), pa.array(check.astype(np.uint32).view(np.int32)), pa.array(np.full(len(starts), rows[i])), pa.array(starts.astype(np.int32))],
                    ["edge", "check", "row", "start"],
                )

    def read_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digest of each span asked of a source text."""
        for batch in batches:
            for text, asked in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = text.as_py().encode().split()
                out = [(x["row"], x["source"], x["n"], digest(words[x["source"] : x["source"] + x["n"] - 1 + width])) for x in asked]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["source_row", "source", "n", "digest"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = {"doc_id": [], "n_words": [], "n_removed": [], "spans": [], "text": []}
            copies, paths = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, (text, doc_id) in enumerate(zip(batch.column(0), batch.column(1).to_pylist(), strict=True)):
                words = text.as_py().encode().split()
                found = sorted((p["start"], p["start"] + p["n"] - 1 + width, p["digest"]) for p in paths[i] or ())
                found = [(start, end) for start, end, source in found if digest(words[start:end]) == source]
                if copies[i] > 1 and len(words) >= width:
                    found = [(0, len(words))]
                spans: list[list[int]] = []
                for start, end in found:
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                kept, at = [], 0
                for start, end in spans:
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                for name, value in zip(part, (doc_id, len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans], b" ".join(kept).decode()), strict=True):
                    part[name].append(value)
                if len(part["text"]) >= 1000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(part.values(), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()), strict=True)], list(part))
                    part = {name: [] for name in part}

    marks = scratch.write(keyed.select("text", "key", "id").mapInArrow(find_anchors, "row long, key binary, id long, kmers array<long>, places array<int>"), "anchors")
    # exact copies are one text here, that of their smallest id: a window that only they hold is theirs, see remove()
    texts = scratch.write(marks.groupBy("key").agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.min("id").alias("id")), "texts")
    places = marks.select("row", "kmers", "places").join(texts.select("row"), "row", "left_semi")
    places = places.select("row", F.explode(F.arrays_zip("kmers", "places")).alias("x")).select("row", F.col("x.kmers").alias("kmer"), F.col("x.places").alias("place"))
    where = F.xxhash64("row", "place")
    shared = places.groupBy("kmer").agg(F.min(where).alias("lo"), F.max(where).alias("hi"), F.count("*").alias("seen")).filter("lo < hi").select("kmer", "seen")
    hits = join_seen(places, scratch.write(shared, "kmers"), ["kmer"], "seen").groupBy("row").agg(F.array_sort(F.collect_set("place")).alias("places"))
    hits = scratch.write(hits.join(texts, "row").select("key", "id", "row", "places"), "hits")
    scratch.drop("anchors", "kmers")
    release_shuffles(spark)
    source = keyed.select("text", "key", "id").join(hits, ["key", "id"])
    edges = scratch.write(source.select("text", "row", "places").mapInArrow(find_edges, "edge long, check int, row long, start int"), "edges")
    release_shuffles(spark)
    repeated = edges.groupBy("edge", "check").agg(F.count("*").alias("n"), F.min(F.struct("row", "start")).alias("source")).filter("n > 1")
    repeated = scratch.write(repeated, "repeated")
    met = join_seen(edges, repeated, ["edge", "check"], "n").select("row", "start", F.col("source.row").alias("source_row"), (F.col("start") - F.col("source.start")).alias("shift"))
    run = Window.partitionBy("row", "source_row", "shift").orderBy("start")
    paths = (
        met.withColumn("run", F.col("start") - F.row_number().over(run))
        .groupBy("row", "source_row", "shift", "run")
        .agg(F.min("start").alias("start"), F.count("*").alias("n"))
    )
    paths = scratch.write(paths.select("row", "source_row", "start", "n", (F.col("start") - F.col("shift")).alias("source")), "paths")
    scratch.drop("edges", "repeated")
    release_shuffles(spark)
    # a source may have many followers, but its text bounds the distinct spans of each block of it
    asked = paths.select(F.col("source_row").alias("row"), "source", "n").distinct().groupBy("row", F.floor(F.col("source") / SOURCE_BLOCK).alias("block"))
    asked = asked.agg(F.collect_list(F.struct("row", "source", "n")).alias("asked")).join(texts, "row").select("key", "id", "asked")
    read = keyed.select("text", "key", "id").join(asked, ["key", "id"]).select("text", "asked")
    read = read.mapInArrow(read_sources, "source_row long, source int, n long, digest binary").distinct()
    spans = paths.join(read, ["source_row", "source", "n"]).groupBy("row").agg(F.collect_list(F.struct("start", "n", "digest")).alias("paths"))
    spans = scratch.write(spans, "spans")
    release_shuffles(spark)
    found = texts.join(spans, "row", "left").filter("copies > 1 or paths is not null").select("key", "copies", "paths")
    return (
        keyed.join(found, "key", "left")
        .select("text", "doc_id", F.coalesce("copies", F.lit(1)).alias("copies"), "paths")
        .mapInArrow(remove, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, text string")
    )

"""MinHash near-deduplication with HyperMinHash registers.

Each distinct shingle set gets K registers. A register packs the number of
leading zeros of the smallest hash (6 bits) and the MANTISSA bits after its
leading one (10 bits) into 16 bits. Bands of compressed registers give buckets;
pairs of one bucket are estimated with the correction for chance collisions of
registers, and links are confirmed on full shingle sets.

At s = 0.75 a pair is missed with probability (1 - 0.75**ROWS)**BANDS = 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blocks, connected_components, give_back, key_bitmap, mix64, signed, window_hash, word_hashes

SHINGLE = 5
K, ROWS, BANDS, MANTISSA = 128, 4, 32, 10
#: Pairs whose estimate is below this are not verified: six standard errors under 0.75.
ESTIMATE_AT_LEAST = 0.52
#: Members of an undecided bucket over which prefixes take its place; both ways are exact.
CROWD = 8
_BASE = 0x9E3779B97F4A7C15

_rng = np.random.default_rng(20_011)
_MUL = _rng.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, K, dtype=np.uint64)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of 5-word shingles; a shorter text is one shingle, none without words."""
    if len(h) == 0:
        return h
    if len(h) < SHINGLE:
        with np.errstate(over="ignore"):
            return window_hash(h, len(h), _BASE) * np.uint64(3) + np.uint64(len(h))
    return np.unique(window_hash(h, SHINGLE, _BASE))


def registers(shingles: np.ndarray) -> np.ndarray:
    """K compressed registers (uint16) of one set of shingle hashes."""
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 512):
            part = shingles[None, i : i + 512] * _MUL[:, None]
            part += _ADD[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        zeros = np.zeros(K, np.uint64)
        rest = low.copy()
        for step in (32, 16, 8, 4, 2, 1):
            small = rest < np.uint64(1 << (64 - step))
            zeros[small] += np.uint64(step)
            rest[small] <<= np.uint64(step)
    return ((zeros << np.uint64(MANTISSA)) | ((rest << np.uint64(1)) >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band, of one set's registers or of rows of them; the band's number is part of the key."""
    packed = np.ascontiguousarray(regs).view(np.uint64)  # four 16-bit registers each
    with np.errstate(over="ignore"):
        return mix64(packed * np.uint64(_BASE) + np.arange(1, BANDS + 1, dtype=np.uint64))


@F.arrow_udf(T.DoubleType())
def estimate(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    """Jaccard estimate of register pairs, corrected for chance collisions.

    Two disjoint sets of n and m members agree in a register with probability of
    about 0.1699 * 2**-MANTISSA * 4(n/m) / (1 + n/m)**2.
    """
    x = np.frombuffer(b"".join(a.to_pylist()), np.uint16).reshape(-1, K)
    y = np.frombuffer(b"".join(b.to_pylist()), np.uint16).reshape(-1, K)
    ratio = n_a.to_numpy(zero_copy_only=False) / n_b.to_numpy(zero_copy_only=False)
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return pa.array(((x == y).mean(axis=1) - chance) / (1 - chance))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at, words in blocks((t.as_py() for t in texts), lower=True):
            h = word_hashes((w for x in words for w in x), sum(map(len, words)))
            sizes, digests, regs, start = [], [], [], 0
            for x in words:
                s = shingle_set(h[start : start + len(x)])
                start += len(x)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at)), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())],
                ["doc_id", "n_shingles", "digest", "regs"],
            )
        give_back()


def _full_sets(wanted: Broadcast | None):
    """Shingle sets of the texts whose id the bitmap may hold; of all without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted.value.may_hold(batch.column(0).fill_null(0).to_numpy())))
            ids, texts = batch.column(0), batch.column(1)
            for at, words in blocks((t.as_py() for t in texts), lower=True):
                h = word_hashes((w for x in words for w in x), sum(map(len, words)))
                ends = np.cumsum([len(x) for x in words])
                sets = [signed(shingle_set(h[e - len(x) : e])) for e, x in zip(ends, words, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])
            give_back()

    return run


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and distinct shingles of the documents in wanted (doc_id), and of a few others.

    A bitmap of the wanted ids saves shuffling the texts; where they are too many for it, the texts are joined.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    bitmap = key_bitmap(wanted)
    if bitmap is None:
        narrow = narrow.join(wanted, "doc_id", "left_semi")
    shared = None if bitmap is None else docs.sparkSession.sparkContext.broadcast(bitmap)
    return narrow.mapInArrow(_full_sets(shared), "doc_id long, shingles array<long>")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set and registers per row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signatures, "doc_id long, n_shingles long, digest binary, regs binary")


@F.arrow_udf(T.ArrayType(T.LongType()))
def bands(regs: pa.Array) -> pa.Array:
    """Band keys of packed registers."""
    keys = signed(band_keys(np.frombuffer(b"".join(regs.to_pylist()), np.uint16).reshape(-1, K)).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys))


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach percent: estimate first, then exact."""
    side = lambda c: sigs.select(F.col("doc_id").alias(c), F.col("regs").alias(f"regs_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    likely = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .filter(estimate("regs_a", "regs_b", "n_a", "n_b") >= ESTIMATE_AT_LEAST)
        .select("a", "b")
        .distinct()
    )
    return (
        likely.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
        .withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
        .filter(100 * F.col("common") >= percent * (F.size("set_a") + F.size("set_b") - F.col("common")))
        .select("a", "b")
        .distinct()
    )


def prefix_entries(sets: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """Bucket entries (bucket, id, score, part, n, rest) of crowded documents by their rarest shingles.

    Two sets that reach percent share one of the n - ceil(n * percent / 100) + 1
    members that come first in any order common to all. With the rarest first,
    texts that only share a very common passage don't meet, and no link is lost.
    rest counts the members from the shared one on: that is all that two sets
    can share whose first common member it is.
    """
    each = sets.join(crowded.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct().select("doc_id", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    ordered = each.join(often, "shingle").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("x"))
    first = F.size("x") - F.ceil(F.size("x") * percent / 100).cast("int") + 1
    entries = ordered.select(F.col("doc_id").alias("id"), F.size("x").alias("size"), F.posexplode(F.slice("x", F.lit(1), first)).alias("at", "x")).filter("x.often > 1")
    return entries.select("id", F.xxhash64("x.shingle").alias("bucket"), (F.col("size") - F.col("at")).cast("long").alias("rest")).join(crowded, "id").select("bucket", "id", "score", "part", "n", "rest")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Components of documents linked by 5-word shingle sets of Jaccard >= percent/100.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable) and kept
    (doc_id = component_id), one row per input row. Null and empty texts have no
    shingles and link with nothing; repeated texts share a component; a null
    doc_id keeps a null component and stays (kept). doc_id is a key: rows that
    repeat one are each answered for their own text, and are one node where their
    texts link with others. Other columns are ignored. An empty table gives an empty result.

    Copies collapse to one representative by the digest of their whole set.
    Buckets then work in rounds: some pivots of each bucket (1, 4, 64, ...), those
    that share most buckets with others, meet the bucket's members of other
    components, links merge components, and pivots leave. A bucket is done when it
    holds one component or no untested pair, so a bucket of near copies costs its
    size, not its square. What the first round leaves in buckets of over CROWD
    members (texts that share much, but too little) moves to buckets by prefix:
    see ``prefix_entries``. No pair of different components that meet goes untested.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    sigs = scratch.write(signatures(docs), "signatures")
    filled = sigs.filter("digest is not null and doc_id is not null")
    first = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "regs")).alias("x"))
    reps = scratch.write(first.select("digest", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), F.col("x.regs").alias("regs")), "reps")
    entries = reps.select(F.col("rep").alias("id"), "n", F.explode(bands("regs")).alias("bucket"))
    busy = entries.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = scratch.write(entries.join(busy, "bucket"), "shared")
    # a text that many others are copies of shares more buckets with them than they share with each other
    central = shared.groupBy("id").agg(F.sum("size").alias("score"))
    members = scratch.write(shared.join(central, "id").select("bucket", "id", "score", "n", F.col("n").alias("rest")).distinct(), "members")
    scratch.drop("shared")
    wanted = scratch.write(members.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    sets = scratch.write(full_sets(docs, wanted), "sets")
    rep_sigs = scratch.write(reps.select(F.col("rep").alias("doc_id"), "regs", F.col("n").alias("n_shingles")).join(wanted, "doc_id", "left_semi"), "wanted-signatures")
    labels = spark.createDataFrame([], "node long, component long")
    width, indexed = 1, False
    while not members.isEmpty():
        placed = members.join(labels, members.id == labels.node, "left").select("bucket", "id", "score", "n", "rest", F.coalesce("component", "id").alias("part"))
        open_ = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("bucket", "size")
        placed = scratch.write(placed.join(open_, "bucket"), "placed")
        if width > 1 and not indexed:
            indexed = True
            crowded = placed.filter(F.col("size") > CROWD)
            by_prefix = prefix_entries(sets, crowded.select("id", "score", "part", "n").distinct(), percent)
            placed = scratch.write(placed.filter(F.col("size") <= CROWD).drop("size").unionByName(by_prefix), "placed")
        pivots = placed.groupBy("bucket", F.pmod(F.xxhash64("id"), F.lit(width)).alias("slot")).agg(F.max(F.struct("score", "id", "part", "n", "rest")).alias("p"))
        pivots = pivots.select("bucket", F.col("p.id").alias("pivot"), F.col("p.part").alias("pivot_part"), F.col("p.n").alias("pivot_n"), F.col("p.rest").alias("pivot_rest"))
        enough = (100 + percent) * F.least("rest", "pivot_rest") >= percent * (F.col("n") + F.col("pivot_n"))
        pairs = placed.join(pivots, "bucket").filter((F.col("part") != F.col("pivot_part")) & enough).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        links = scratch.write(_confirmed(pairs, rep_sigs, sets, percent), "links")
        if not links.isEmpty():
            # the stars so far stand for all links found before
            labels = connected_components(links.union(labels), scratch, "labels")
        members = scratch.write(placed.join(pivots.select("bucket", F.col("pivot").alias("id")), ["bucket", "id"], "left_anti").select("bucket", "id", "score", "n", "rest"), "members")
        width *= 4 if width == 1 else 16
    owner = reps.join(labels, reps.rep == labels.node, "left").select("digest", F.coalesce("component", "rep").alias("part"))
    return scratch.close(
        sigs.select("doc_id", "n_shingles", "digest")
        .join(owner, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )

"""Shared helpers of the corpus operators: scratch tables, word hashing, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import drop_table, release_shuffles, remember  # noqa: F401 (operators take release_shuffles from here)

#: Words handled together by the vectorised tokenising helpers; bounds a task's memory.
BLOCK_WORDS = 200_000

_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only in local mode (tests) is a folder made where the setting is missing; on
    a cluster a missing setting is an error, as a machine-local folder would not
    be seen by other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="sparkpanel-"))
    return f"file://{_local_folder[0]}"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a Parquet table in the shared folder and read it again.

    Cuts lineage: a lost executor costs no recomputation of what went before.
    The table goes with the driver's process, or earlier by ``drop_table``, or by
    ``checkpoints.release`` of a result that reads it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkpanel/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remember(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Scratch tables of one call of an operator, by name; a new table of a name takes the old one's place."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark, self.operator, self.paths = spark, operator, {}
        bounded_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out, path = materialize(df, f"{self.operator}-{name}")
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                drop_table(self.spark, path)

    def rename(self, old: str, new: str) -> None:
        self.drop(new)
        self.paths[new] = self.paths.pop(old)

    def close(self, result: DataFrame) -> DataFrame:
        """Write the operator's result and drop every other table."""
        out, _ = materialize(result, f"{self.operator}-result")
        self.drop(*list(self.paths))
        return out


#: Rows and bytes of one batch between Spark and Python at most, one row at least.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that Spark sends to Python by their bytes too, as texts may be long; smaller settings stay.

    The settings stay for the session: results are computed when they are asked for, and need the bound then.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", None)
        if not (now or "").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def smallest_hashes(df: DataFrame, key: list[str], most: int, by: list[str] | None = None) -> DataFrame:
    """The ``most`` rows of df (of each group of columns ``by``) with the smallest hash of ``key``.

    A bound on the hash, from the number of rows, leaves few more than that before
    anything is sorted or sent. Rows of equal keys may take each other's places.
    """
    by = by or []
    n = df.groupBy(*by).agg(F.count("*").alias("__n"))
    share = F.least(F.lit(1.0), (most + 6 * most**0.5 + 20) / F.col("__n"))
    met = df.join(F.broadcast(n), by) if by else df.crossJoin(F.broadcast(n))  # n is one row, or one for each group
    met = met.withColumn("__h", F.xxhash64(*key)).filter(F.col("__h") / 2.0**64 + 0.5 <= share)
    if not by:
        return met.orderBy("__h").limit(most).drop("__h", "__n")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("__h"))
    return met.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__h", "__n", "__rank")


#: Bits of a membership bitmap at most, and bits for each key; more keys than fit are matched by a join.
BITMAP_BITS, BITS_A_KEY = 1 << 28, 16


class KeyBitmap:
    """Which slots the hashes of some keys take: tells without a join which rows cannot have one of them."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.slots = bits, np.uint64(8 * len(bits))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """False where a key (int64) is surely not among them."""
        slot = (mix64(keys.view(np.uint64)) % self.slots).astype(np.int64)
        return (self.bits[slot >> 3] >> (slot & 7) & 1).astype(bool)


def key_bitmap(keys: DataFrame, most: int = BITMAP_BITS) -> KeyBitmap | None:
    """The bitmap of a table of one long column, put together where the keys are; None where they need more than ``most`` bits."""
    (name,) = keys.columns
    slots = 1 << max(15, (BITS_A_KEY * keys.count() - 1).bit_length())
    if slots > most:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((mix64(found.view(np.uint64)) % np.uint64(slots)).astype(np.int64))], ["slot"])

    # bitmap positions count from 0 within buckets of 32,768 that are numbered from 1
    slot = keys.select(name).mapInArrow(run, "slot long")
    parts = slot.groupBy(F.expr("bitmap_bucket_number(slot + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("bits"))
    bits = np.zeros(slots // 8, np.uint8)
    for r in parts.collect():  # slots / 8 bytes
        part = np.frombuffer(bytes(r.bits), np.uint8)
        bits[(r.bucket - 1) * 4096 : (r.bucket - 1) * 4096 + len(part)] = part
    return KeyBitmap(bits)


def without_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't in ids (one long column); those without an id stay.

    Rows that surely stay aren't shuffled; the others are matched by a join.
    """
    bitmap, gone = key_bitmap(ids), ids.toDF("__gone")
    if bitmap is None:
        return docs.join(gone, F.col(column) == F.col("__gone"), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # BITMAP_BITS at most

    @F.arrow_udf("boolean")
    def suspect(keys: pa.Array) -> pa.Array:
        return pa.array(shared.value.may_hold(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) & keys.is_valid().to_numpy(zero_copy_only=False))

    marked = docs.withColumn("__suspect", suspect.asNondeterministic()(F.col(column).cast("long")))
    found = marked.filter("__suspect").join(gone, F.col(column) == F.col("__gone"), "left_anti")
    return marked.filter("not __suspect").unionByName(found).drop("__suspect")


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def give_back() -> None:
    """Return the memory that a finished batch has freed to the system; a reused Python worker would hold it through the tasks that follow."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: Keys that are broadcast at most, where some are seen far more often than others.
HOT_KEYS = 1 << 16


def join_seen(rows: DataFrame, keys: DataFrame, on: list[str], seen: str, most: int = HOT_KEYS) -> DataFrame:
    """Inner join of rows with a table of unique keys that says in ``seen`` how many rows each has.

    Keys with more than one part in ``most`` of all sightings (so fewer than ``most`` keys) are
    broadcast: their rows stay where they are. The rows of the others are shuffled, and none of those is hot.
    """
    total = keys.agg(F.sum(seen)).first()[0] or 0
    hot = keys.filter(F.col(seen) * most > total)
    more = [c for c in keys.columns if c not in on]
    met = rows.join(F.broadcast(hot), on, "left")
    rest = met.filter(F.col(seen).isNull()).drop(*more).join(keys.filter(F.col(seen) * most <= total), on)
    return met.filter(F.col(seen).isNotNull()).unionByName(rest)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    """64-bit hashes of n words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def window_hash(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (mixed polynomial).

    The polynomial is built by doubling, so a width of w costs about log2(w) passes.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, size, done, out = np.uint64(base), 1, 0, None
        part = h
        while True:
            if width & size:
                piece = part[done : done + n]
                out = piece.copy() if out is None else out * power + piece
                done += size
            if size * 2 > width:
                break
            part = part[:-size] * power + part[size:]
            power = power * power
            size *= 2
        return mix64(out)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return x.view(np.int64)


def blocks(texts: Iterable[str | None], lower: bool) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Groups of texts as words, of about BLOCK_WORDS words (one text at least).

    bytes.lower() changes A-Z only, and bytes.split() splits at \\x20 and
    \\x09-\\x0D only: the words are those of ``[^\\x20\\x09-\\x0D]+``.
    """
    at: list[int] = []
    words: list[list[bytes]] = []
    total = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        found = (raw.lower() if lower else raw).split()
        at.append(i)
        words.append(found)
        total += len(found)
        if total >= BLOCK_WORDS:
            yield at, words
            at, words, total = [], [], 0
    if at:
        yield at, words


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Smallest reachable id per node of an undirected graph with columns a, b.

    Alternates large-star and small-star steps until the edge set is a forest of
    stars; each step aggregates before it shuffles, and AQE splits the join's
    partitions of a hub. Returns node, component for all nodes that have an edge
    to another node, as a table of the scratch. An empty edge table gives an empty result.
    """
    now = scratch.write(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        f"{name}-edges",
    )
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter(F.col("a") != F.col("b"))
            .distinct()
        )
        now = scratch.write(small, f"{name}-edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            scratch.rename(f"{name}-edges", name)
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark

"""Brown class-based bigram language model with exchange clustering.

P(word | previous) = P(class | previous class) * P(word | class), mixed with the
word's own smoothed frequency. Texts become chunks of tokens with a chunk's own
word numbers, written once; all statistics are counted per chunk and word before
they are shuffled, in buckets of words whose number grows with the vocabulary
and the root of the chunks. A bucket's rows stream through its task, which holds
one table of the bucket's words. An exchange sweep counts only if it raises the
likelihood of the training texts. The class-to-class table (CLASSES squared
numbers) is all that reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release_shuffles, signed, word_hashes

CLASSES, SWEEPS, MIX = 32, 2, 0.8
#: Tokens of a chunk, one text at least; bounds a task's memory.
CHUNK_TOKENS = 1_000_000
#: Distinct words of a bucket, about; bounds the table of counts that a task holds.
BUCKET_WORDS = 50_000
FOLDS, HELD_OUT = 5, 1
_END = xxhash.xxh3_64_intdigest(b"")  # no word is empty


_COLUMNS = ["chunk", "ids", "sizes", "end", "tokens", "words", "counts"]
_KINDS = {"chunk": pa.int64(), "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "end": pa.int32()}
_NAMES = {"chunk": "long", "ids": "array<long>", "sizes": "array<int>", "end": "int"}


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {_NAMES.get(n, 'binary')}" for n in names)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    number, task = 0, TaskContext.get().partitionId()

    def chunk() -> pa.RecordBatch:
        h = np.concatenate(hashes)
        words, token, count = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words get small numbers, which pack well
        back = np.empty(len(order), np.uint32)
        back[order] = np.arange(len(order), dtype=np.uint32)
        token, words = back[token], words[order]
        learn = np.repeat([not is_held_out(i) for i in ids], sizes)
        count = np.bincount(token[learn], minlength=len(words))
        values = ((task << 32) + number, ids, sizes, int(np.flatnonzero(words == np.uint64(_END))[0]), _pack(token), _pack(words), _pack(count.astype(np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array([v], _KINDS.get(n, pa.binary())) for n, v in zip(_COLUMNS, values, strict=True)], _COLUMNS)

    ids, sizes, hashes, total = [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            found = (text.as_py() or "").encode().lower().split()
            ids.append(doc_id.as_py())
            sizes.append(len(found) + 1)
            hashes.append(np.append(word_hashes(found, len(found)), np.uint64(_END)))
            total += sizes[-1]
            if total >= limit:
                yield chunk()
                ids, sizes, hashes, total, number = [], [], [], 0, number + 1
    if ids:
        yield chunk()


def _initial(words: np.ndarray, top: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Class of each word at the start: the most frequent ones alone, all others together."""
    if not len(top):
        return np.full(len(words), CLASSES - 1, np.int8)
    at = np.minimum(np.searchsorted(top, words), len(top) - 1)
    return np.where(top[at] == words, order[at], CLASSES - 1).astype(np.int8)


def _neighbours(token: np.ndarray, sizes: np.ndarray, learn: np.ndarray, klass: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the learned tokens: word numbers, classes before them (start of text: that of the end token), and whether one follows."""
    ends = np.cumsum(sizes)
    first = np.zeros(len(token), bool)
    first[ends - sizes] = True
    before = np.append(start, klass[token[:-1]])
    before[first] = start
    return before, learn, ~np.append(first[1:], True)


def _statistics(token, sizes, learn, klass, start) -> np.ndarray:
    """Class-to-class counts of the learned texts."""
    before, learn, _ = _neighbours(token, sizes, learn, klass, start)
    keep = learn & (before >= 0) & (klass[token] >= 0)
    return np.bincount(before[keep].astype(np.int64) * CLASSES + klass[token[keep]], minlength=CLASSES * CLASSES)


def _contexts(token, sizes, learn, klass, start) -> tuple[np.ndarray, np.ndarray]:
    """Sparse counts by word number * 2 * CLASSES + side * CLASSES + class, of the classes on either side."""
    before, learn, followed = _neighbours(token, sizes, learn, klass, start)
    left = token[learn].astype(np.int64) * 2 * CLASSES + before[learn]
    here = np.flatnonzero(learn & followed)
    right = token[here].astype(np.int64) * 2 * CLASSES + CLASSES + klass[token[here + 1]]
    return np.unique(np.concatenate([left, right]), return_counts=True)


class _Chunk:
    """One row of the chunk table, unpacked."""

    def __init__(self, row: dict, top=None):
        self.number, self.ids = row["chunk"], row["ids"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.token = _unpack(row["tokens"], np.uint32)
        self.words = _unpack(row["words"], np.uint64) if "words" in row else None
        self.counts = _unpack(row["counts"], np.uint32) if "counts" in row else None
        self.learn = np.repeat(np.array([not is_held_out(i) for i in self.ids]), self.sizes)
        self.total = _unpack(row["totals"], np.uint64) if "totals" in row else None
        self.klass = _unpack(row["classes"], np.int8) if "classes" in row else _initial(self.words, *top)
        self.start = int(self.klass[row["end"]])


def _each(batches: Iterator[pa.RecordBatch], top=None) -> Iterator[_Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Chunk({n: batch.column(n)[i].as_py() for n in batch.schema.names}, top)


def _matrix(chunks: DataFrame, top=None) -> np.ndarray:
    """Class-to-class counts of the whole training corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for c in _each(batches, top):
            total += _statistics(c.token, c.sizes, c.learn, c.klass, c.start)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "n"])

    out = np.zeros(CLASSES * CLASSES)
    for r in chunks.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(CLASSES, CLASSES)


def _buckets(chunks: DataFrame, count: int, top=None, contexts: bool = True) -> DataFrame:
    """Per chunk and bucket of words: the words, their training counts and context counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _each(batches, top):
            bucket = (c.words % np.uint64(count)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            used, begin = np.unique(bucket[order], return_index=True)
            end = np.append(begin[1:], len(order))
            keys, n = _contexts(c.token, c.sizes, c.learn, c.klass, c.start) if contexts else (np.empty(0, np.int64), np.empty(0, np.int64))
            keys = rank[keys // (2 * CLASSES)] * 2 * CLASSES + keys % (2 * CLASSES)
            by = np.argsort(keys, kind="stable")
            keys, n = keys[by], n[by]
            cuts = np.searchsorted(keys, np.append(begin, len(order)) * 2 * CLASSES)
            rows = [
                (int(b), _pack(c.words[order[s:e]]), _pack(c.counts[order[s:e]]), _pack(np.diff(keys[x:y] - s * 2 * CLASSES, prepend=0).astype(np.uint32)), _pack(n[x:y].astype(np.uint32)))
                for b, s, e, x, y in zip(used, begin, end, cuts[:-1], cuts[1:], strict=True)
            ]
            columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "words", "counts", "keys", "n"])

    return chunks.mapInArrow(run, "bucket long, words binary, counts binary, keys binary, n binary")


def _vocabulary(chunks: DataFrame) -> int:
    """About how many distinct words the chunks hold, from those whose hash falls in one of 256 parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.concatenate([_unpack(x.as_py(), np.uint64) for x in batch.column(0)])
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.unique(words[words % np.uint64(256) == 0])))], ["word"])

    return chunks.select("words").mapInArrow(run, "word long").distinct().count() * 256


def _bucket_count(vocabulary: int, chunks: int) -> int:
    return max(1, -(-vocabulary // BUCKET_WORDS), int(2 * chunks**0.5))


class _Table:
    """Distinct words of a bucket with sums of their rows, grown as rows stream in.

    Rows wait until they hold as many words as the table, so that merging costs no more than the rows do.
    """

    def __init__(self, width: int):
        self.words, self.total, self.vectors = np.empty(0, np.uint64), np.empty(0, np.uint64), np.zeros((0, width))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, words: np.ndarray, counts: np.ndarray, keys: np.ndarray, n: np.ndarray) -> None:
        """keys: place of a word in words * width + context, each with its count n."""
        self.waiting.append((words, counts, keys, n))
        self.size += len(words)
        if self.size >= max(len(self.words), BUCKET_WORDS // 4):
            self.merge()

    def merge(self) -> None:
        rows, width = self.waiting, self.vectors.shape[1]
        merged, at = np.unique(np.concatenate([self.words, *(r[0] for r in rows)]), return_inverse=True)
        place = np.split(at, np.cumsum([len(self.words), *(len(r[0]) for r in rows)])[:-1])
        total, vectors = np.zeros(len(merged), np.uint64), np.zeros((len(merged), width))
        total[place[0]], vectors[place[0]] = self.total, self.vectors
        for mine, (_, counts, keys, n) in zip(place[1:], rows, strict=True):
            total[mine] += counts.astype(np.uint64)  # a row's words and keys are distinct
            if width:
                vectors.reshape(-1)[mine[keys // width] * width + keys % width] += n
        self.words, self.total, self.vectors, self.waiting, self.size = merged, total, vectors, [], 0


def _table_of(batches: Iterator[pa.RecordBatch], width: int) -> tuple[int, _Table]:
    """The number and the table of one bucket."""
    table, bucket = _Table(width), 0
    for batch in batches:
        for i in range(batch.num_rows):
            bucket = batch.column("bucket")[i].as_py()
            words, counts, keys, n = (_unpack(batch.column(c)[i].as_py(), kind) for c, kind in (("words", np.uint64), ("counts", np.uint32), ("keys", np.uint32), ("n", np.uint32)))
            table.add(words, counts, np.cumsum(keys, dtype=np.int64), n)
    table.merge()
    return bucket, table


def _totals(buckets: DataFrame, scratch: Scratch) -> tuple[int, int, np.ndarray]:
    """Training tokens, distinct ones, and the CLASSES - 1 most frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, t = _table_of(batches, 0)
        best = np.argsort(-t.total.astype(np.int64), kind="stable")[: CLASSES - 1]
        values = (int(t.total.sum()), int((t.total > 0).sum()), signed(t.words[best]), t.total[best].astype(np.int64))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["tokens", "known", "words", "totals"])

    found = scratch.write(buckets.groupBy("bucket").applyInArrow(run, "tokens long, known long, words array<long>, totals array<long>"), "totals")
    sums = found.agg(F.sum("tokens"), F.sum("known")).first()
    best = found.select(F.explode(F.arrays_zip("words", "totals")).alias("x")).select("x.*").filter("totals > 0").orderBy(F.desc("totals"), "words").limit(CLASSES - 1).collect()
    return sums[0] or 0, sums[1] or 0, np.array([r.words for r in best], np.int64).view(np.uint64)


def likelihood(matrix: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for a constant of the word counts."""
    part = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return part(matrix) - part(matrix.sum(0)) - part(matrix.sum(1))


def gains(matrix: np.ndarray) -> np.ndarray:
    """What one neighbour of each side and class adds to the likelihood of each class, at the present class statistics."""
    smooth = matrix + 0.1
    size = np.log(smooth.sum(0) + smooth.sum(1))
    return np.vstack([np.log(smooth) - size[None, :], np.log(smooth.T) - size[None, :]]).astype(np.float32)


def _exchange(buckets: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Per bucket its words, their training counts and best classes: a word goes where its neighbours' classes are likeliest."""
    gain = gains(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, t = _table_of(batches, 2 * CLASSES)
        best = (t.vectors @ gain).argmax(1).astype(np.int8)
        best[t.total == 0] = -1
        yield pa.RecordBatch.from_arrays([pa.array([bucket]), *(pa.array([_pack(x)], pa.binary()) for x in (t.words, t.total, best))], ["bucket", "words", "totals", "classes"])

    return buckets.groupBy("bucket").applyInArrow(run, "bucket long, words binary, totals binary, classes binary")


def _replies(chunks: DataFrame, answers: DataFrame, count: int) -> DataFrame:
    """Each chunk's words of each bucket with their counts and classes, in the chunk's order.

    A bucket's answer and the chunks' words of it meet in one partition, the
    answer first; the words stream by.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _unpack(packed.as_py(), np.uint64)
                bucket = (words % np.uint64(count)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                used, begin = np.unique(bucket[order], return_index=True)
                parts = [_pack(x) for x in np.split(words[order], begin[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), chunk)), pa.array(parts, pa.binary())], ["bucket", "chunk", "words"])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, answer = None, ()
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                bucket, chunk, words = (batch.column(c)[i].as_py() for c in ("bucket", "chunk", "words"))
                words = _unpack(words, np.uint64)
                if chunk is None:
                    at, answer = bucket, (words, *(_unpack(batch.column(c)[i].as_py(), kind) for c, kind in (("totals", np.uint64), ("classes", np.int8))))
                    continue
                if at != bucket:
                    raise ValueError(f"bucket {bucket} has no answer")
                place = np.searchsorted(answer[0], words)
                rows.append((chunk, bucket, _pack(answer[1][place]), _pack(answer[2][place])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["chunk", "bucket", "totals", "classes"])

    none = F.lit(None)
    asked = chunks.select("chunk", "words").mapInArrow(ask, "bucket long, chunk long, words binary").select("bucket", "chunk", "words", none.cast("binary").alias("totals"), none.cast("binary").alias("classes"))
    both = answers.select("bucket", none.cast("long").alias("chunk"), "words", "totals", "classes").unionByName(asked)
    return both.repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("chunk")).mapInArrow(reply, "chunk long, bucket long, totals binary, classes binary")


def _with_classes(chunks: DataFrame, replies: DataFrame, count: int, last: bool) -> DataFrame:
    """Chunks with totals and classes of their words."""
    replies = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "totals", "classes")).alias("replies"))
    joined = chunks.join(replies, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                replies = sorted(row.pop("replies"), key=lambda r: r["bucket"])
                order = np.argsort((_unpack(row["words"], np.uint64) % np.uint64(count)).astype(np.int64), kind="stable")
                for name, kind in (("totals", np.uint64), ("classes", np.int8)):
                    value = np.empty(len(order), kind)
                    value[order] = np.concatenate([_unpack(r[name], kind) for r in replies])
                    row[name] = _pack(value)
                yield pa.RecordBatch.from_pylist([{n: row[n] for n in names}], schema=out)

    # after the last sweep the words themselves are not needed any more
    names = [*(c for c in chunks.columns if not last or c not in ("words", "counts")), "totals", "classes"]
    out = pa.schema([(n, _KINDS.get(n, pa.binary())) for n in names])
    return joined.select(*chunks.columns, "replies").mapInArrow(run, _schema(names))


def token_scores(token, sizes, klass, total, start, matrix, tokens: int, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: base log10, the model's log10, and whether the word is known."""
    n, c = total[token].astype(np.float64), klass[token]
    base = (n + 0.5) / (tokens + 0.5 * (known + 1))
    ends = np.cumsum(sizes)
    before = np.append(start, c[:-1])
    before[ends - sizes] = start
    size = matrix.sum(0)
    share = 0.5 * (size > 0)  # classes without words take no part
    change = np.vstack([(matrix + share) / np.maximum(matrix.sum(1, keepdims=True) + share.sum(), 1e-300), (size + share) / max(size.sum() + share.sum(), 1e-300)])
    seen = c >= 0
    emission = np.divide(n, size[c], out=np.zeros(len(n)), where=seen & (size[c] > 0))
    unknown = 0.5 / (tokens + 0.5 * (known + 1))
    model = np.where(seen, (1 - unknown) * change[before, c] * emission, base)
    return np.log10(base), np.log10(MIX * model + (1 - MIX) * base), seen


def score(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every whole text.

    The model learns from documents outside the held-out fold of crc32(doc_id).
    A null text is empty, and has the end token only; a null doc_id is learned
    from. Rows are answered one by one, so repeated rows count as often as they
    occur. Without training documents every token has probability 1.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "classlm")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = scratch.write(narrow.mapInArrow(lambda x: _chunks(x, chunk_tokens), _schema(_COLUMNS)), "chunks")
    count = _bucket_count(_vocabulary(chunks), chunks.count())
    none = np.empty(0, np.uint64)
    tokens, known, best = _totals(_buckets(chunks, count, (none, none), contexts=False), scratch)
    release_shuffles(spark)
    order = np.argsort(best)
    top, ready = (best[order], order), chunks
    matrix = _matrix(ready, top)
    for sweep in range(SWEEPS):
        last = sweep == SWEEPS - 1
        answers = scratch.write(_exchange(_buckets(ready, count, top), matrix), "answers")
        release_shuffles(spark)
        replies = scratch.write(_replies(ready, answers, count), "replies")
        release_shuffles(spark)
        moved = scratch.write(_with_classes(ready.drop("totals", "classes"), replies, count, last), f"sweep-{sweep}")
        scratch.drop("answers", "replies")
        new = _matrix(moved)
        if sweep and likelihood(new) <= likelihood(matrix):
            scratch.drop(f"sweep-{sweep}")
            break
        scratch.drop("chunks", f"sweep-{sweep - 1}")
        ready, matrix = moved, new
        release_shuffles(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _each(batches):
            base, model, seen = token_scores(c.token, c.sizes, c.klass, c.total, c.start, matrix, tokens, known)
            begin = np.cumsum(c.sizes) - c.sizes
            base, model, seen = (np.add.reduceat(x, begin) for x in (base, model, seen.astype(np.int64)))
            values = (c.ids, [is_held_out(i) for i in c.ids], c.sizes, seen, np.full(len(c.ids), tokens), base, model, 10 ** (-model / c.sizes))
            kinds = (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return ready.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

"""Fill-in-middle transformation: cuts between tokens found by a learned index of boundary offsets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

#: Marks of the parts: prefix, suffix, middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Distance between a boundary and its segment's line at most; residuals then fit a byte.
ERROR = 126


def boundaries(chars: np.ndarray) -> np.ndarray:
    """Offsets of all token boundaries, 0 and the end included.

    A token is white space (\\x20, \\x09-\\x0D) and the word after it; white space at the end is one of its own.
    """
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    n = len(chars)
    if not n:
        return np.zeros(1, np.int64)
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.concatenate(([0], last, [n])).astype(np.int64)


@dataclass(frozen=True)
class RankIndex:
    """Offset of each rank as a line of its segment plus a stored residual of one byte.

    ``first[s]`` is the first rank of segment s, ``base[s]`` the offset there and
    ``slope[s]`` its line; ``residual[rank]`` makes the prediction exact.
    """

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @staticmethod
    def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """Greedy segments, each as long as one line stays within ``error`` of all its offsets.

        The slopes that keep a segment's points form a cone that narrows with
        each point; the segment ends where nothing is left of it. Points are
        tried in steps that double, so a segment costs a few array operations.
        """
        first, base, slope = [], [], []
        at, n = 0, len(offsets)
        while at < n:
            low, high, to, step = -np.inf, np.inf, at + 1, 64
            while to < n:
                upto = min(n, to + step)
                run, rise = np.arange(to - at, upto - at), offsets[to:upto] - offsets[at]
                lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                closed = lows > highs
                kept = int(closed.argmax()) if closed.any() else len(closed)
                if kept:
                    low, high = lows[kept - 1], highs[kept - 1]
                to += kept
                if kept < len(closed):
                    break
                step *= 2
            first.append(at)
            base.append(offsets[at])
            slope.append((low + high) / 2 if to > at + 1 else 0.0)
            at = to
        index = RankIndex(np.array(first), np.array(base, np.int64), np.array(slope), np.zeros(0, np.int8))
        missed = offsets - index.predict(np.arange(n))
        if len(missed) and np.abs(missed).max() > 127:
            raise AssertionError("a segment's line is farther than a byte from an offset")
        return RankIndex(index.first, index.base, index.slope, missed.astype(np.int8))

    def predict(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, rank, "right") - 1
        return self.base[at] + np.rint(self.slope[at] * (rank - self.first[at])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Exact offsets of ranks."""
        return self.predict(rank) + self.residual[rank]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)


_CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "last")])


@F.arrow_udf(_CUTS)
def cuts(text: pa.Array, h1: pa.Array, h2: pa.Array, whole: pa.Array) -> pa.Array:
    """Number of tokens and the offsets of the two cuts; no offsets where the text stays whole."""
    n, first, last = [], [], []
    for t, a, b, plain in zip(text, h1, h2, whole, strict=True):
        offsets = boundaries(code_points(t.as_py()))
        tokens = len(offsets) - 1
        n.append(tokens)
        if plain.as_py():
            first.append(None)
            last.append(None)
            continue
        i, j = a.as_py() % (tokens + 1), b.as_py() % (tokens + 1)
        x, y = RankIndex.fit(offsets).offset(np.array([min(i, j), max(i, j)]))
        first.append(int(x))
        last.append(int(y))
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (n, first, last)], ["n", "first", "last"])


def _groups(seed: int) -> list[Column]:
    """The first four 32-bit numbers of the sha256 of seed and id."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """docs (doc_id, text and any other columns) with texts rearranged for infilling.

    Adds ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (code
    points; null if plain) and ``output``; columns of these names in docs are
    replaced. ``percent`` of the texts are cut in three between tokens, and of these ``spm_percent``
    have the suffix first; which ones, and where, follows from seed and doc_id alone.
    Texts that are empty (or null) or hold one of the marks stay plain. Repeated rows get the
    same output, rows without an id count as id ''. An empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    h1, h2, h3, h4 = _groups(seed)
    rows = docs.select(*own, F.coalesce(F.col("text"), F.lit("")).alias("__t"), h1.alias("__h1"), h2.alias("__h2"), h3.alias("__h3"), h4.alias("__h4"))
    t = F.col("__t")
    marked = F.contains(t, F.lit(PREFIX)) | F.contains(t, F.lit(SUFFIX)) | F.contains(t, F.lit(MIDDLE))
    whole = (t == "") | marked | (F.col("__h3") % 100 >= percent)
    rows = rows.withColumn("form", F.when(whole, "plain").when(F.col("__h4") % 100 < spm_percent, "spm").otherwise("psm"))
    rows = rows.withColumn("__c", cuts("__t", "__h1", "__h2", F.col("form") == "plain"))
    first, last = F.col("__c.first"), F.col("__c.last")
    prefix, middle, suffix = F.substring(t, F.lit(1), first.cast("int")), F.substring(t, (first + 1).cast("int"), (last - first).cast("int")), F.substring(t, (last + 1).cast("int"), F.length(t))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select(*own, F.col("__c.n").alias("n"), "form", first.alias("prefix_chars"), (last - first).alias("middle_chars"), output.alias("output"))


def restore(df: DataFrame) -> DataFrame:
    """df (form, output) with ``restored``, the text that transform() was given.

    No part holds a mark, and a mark's last character ends no other mark, so the output splits at its three marks only.
    """
    parts = F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return df.withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", psm).otherwise(spm))

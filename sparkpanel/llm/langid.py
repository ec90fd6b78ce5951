"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths over bytes, max pooling over a window and softmax. A
filter of width w is w tables of 256 rows, so a convolution over one-hot bytes
is a sum of w table look-ups. Texts are cut into windows of WINDOW bytes; the
prediction is the mean of the windows' probabilities, weighted by their letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, smallest_hashes

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 12, 192
#: Labelled rows that the network is fitted on at most, for each language; all windows of their whole texts are used.
SAMPLE_PER_LANGUAGE = 250
EPOCHS, BATCH, RATE = 5, 64, 0.02
UNKNOWN = "und"
#: Windows handled at once in prediction; bounds memory and stays in the CPU's cache.
_AT_ONCE = 128


def window_bytes(text: str) -> np.ndarray:
    """All of a text's lower-cased bytes as rows of WINDOW bytes, the last filled up with zeros."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    rows = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(rows, WINDOW)


def letters_in(rows: np.ndarray) -> np.ndarray:
    """Bytes of each window that belong to ASCII letters or to other scripts."""
    return ((rows >= 97) & (rows <= 122)).sum(1) + (rows >= 128).sum(1)


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, rows: np.ndarray, places: bool = False):
        """Largest response of each filter in each window, and where it was."""
        found, where = [], []
        for table in self.tables:
            width = len(table)
            n = rows.shape[1] - width + 1
            total = table[0].take(rows[:, :n], axis=0)
            for j in range(1, width):
                total += table[j].take(rows[:, j : j + n], axis=0)
            if places:
                at = total.argmax(1)
                where.append(at)
                found.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0])
            else:
                found.append(total.max(1))
        return np.concatenate(found, 1) + self.bias, where

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(rows), _AT_ONCE):
            z = np.maximum(self.pooled(rows[i : i + _AT_ONCE])[0], 0) @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            parts.append(z / z.sum(1, keepdims=True))
        return np.concatenate(parts)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on cross-entropy; only the bytes under a filter's maximum get a gradient."""
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    net = Network(
        languages,
        [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n_filters, np.float32), rng.normal(0, 0.2, (n_filters, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    params = [*net.tables, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    filters = np.arange(FILTERS)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            x, y = windows[order[i : i + BATCH]], labels[order[i : i + BATCH]]
            pooled, where = net.pooled(x, places=True)
            active = np.maximum(pooled, 0)
            z = active @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.out.T) * (pooled > 0)
            grads = [np.zeros_like(t) for t in net.tables] + [back.sum(0), active.T @ p, p.sum(0)]
            for k, at in enumerate(where):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(WIDTHS[k]):
                    np.add.at(grads[k][j], (np.take_along_axis(x, at + j, 1), filters[None, :]), part)
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(labelled: DataFrame) -> Network:
    """Fit on columns doc_id, text, lang: SAMPLE_PER_LANGUAGE rows of each language at most.

    Rows are chosen by the smallest hash of doc_id and text; their whole texts
    come to the driver. Rows without a language or a letter are not used.
    """
    usable = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = smallest_hashes(usable, ["doc_id", "text"], SAMPLE_PER_LANGUAGE, ["lang"]).select("lang", "text").collect()
    if not rows:
        return Network([], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    rows.sort()
    languages = sorted({r.lang for r in rows})
    windows = [window_bytes(r.text) for r in rows]
    labels = np.repeat([languages.index(r.lang) for r in rows], [len(w) for w in windows])
    windows = np.concatenate(windows)
    lettered = letters_in(windows) > 0
    return fit(windows[lettered], labels[lettered], languages)


def guess(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each text; the windows of all texts go through the network together."""
    lettered = [bool(net.languages and t and any(map(str.isalpha, t))) for t in texts]
    found = [t for t, ok in zip(texts, lettered, strict=True) if ok]
    languages, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if found:
        parts = [window_bytes(t) for t in found]
        sizes = np.array([len(p) for p in parts])
        begin = np.cumsum(sizes) - sizes
        rows = np.concatenate(parts)
        weight = letters_in(rows).astype(np.float64)
        none = np.add.reduceat(weight, begin) == 0  # letters whose bytes are no letters' after all
        weight[np.repeat(none, sizes)] = 1
        keep = weight > 0
        p = np.zeros((len(rows), len(net.languages)))
        p[keep] = net.probabilities(rows[keep]) * weight[keep, None]
        p = np.add.reduceat(p, begin) / np.add.reduceat(weight, begin)[:, None]
        languages[lettered], scores[lettered] = np.array(net.languages, object)[p.argmax(1)], np.minimum(p.max(1), 1.0)
    return languages.tolist(), scores.tolist()


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """docs with lang_pred and score (0 to 1) from each whole text alone.

    A text that is null or has no letter gets ``und`` with score 0, as does
    every text when nothing was learned. Columns already named so are replaced.
    Repeated rows get the same answer, an empty table gives an empty table.
    Only texts go to Python, in batches bounded by their bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(net)  # a few hundred kilobytes at any input size

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def answer(texts: pa.Array) -> pa.Array:
        languages, scores = guess(shared.value, texts.to_pylist())
        give_back()
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    # not deterministic: else Spark runs it once more for each filter on its result
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(*names, answer.asNondeterministic()("text").alias("__language"))
    return found.select(*names, "__language.lang_pred", "__language.score")


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    """Column: crc32 of the id as text falls in the held-out fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))

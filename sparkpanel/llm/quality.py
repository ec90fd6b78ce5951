"""Quality classification by hierarchical empirical Bayes.

A document classifier (logistic regression on hashed words and simple shares)
gives each document's own evidence. Its probabilities, summed by host and by
path within the host, give beta-binomial posteriors: a path shrinks toward its
host and a host toward the whole corpus, by prior strengths that the method of
moments takes from the spread between sites. A document's log odds then move by
those of its path against the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, smallest_hashes, word_hashes

BITS = 20
#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 20_000
STEPS, RATE, PENALTY, SURE, LEAST = 150, 0.05, 1e-5, 3.5, 1.5
#: Bounds of a prior's strength, in documents.
STRENGTH = (2.0, 1000.0)
HEADS = ("quality", "toxic")
_EDGES = b".,;:!?()[]\"'#$%&*|"
_SHARES = ("symbols", "digits", "capitals", "long words", "repeated words", "few words")
SIZE = (1 << BITS) + len(_SHARES) + 1


def features(words: list[bytes], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a text's features: its distinct hashed words (lower case), and the shares as values."""
    words_at = np.unique(h >> np.uint64(64 - BITS)).astype(np.uint32)
    raw = np.frombuffer(b"".join(words), np.uint8)
    n, chars = max(1, len(words)), max(1, len(raw))
    letters = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    digits = (raw >= 48) & (raw <= 57)
    shares = np.array([
        (~letters & ~digits & (raw < 128)).sum() / chars, digits.sum() / chars, ((raw >= 65) & (raw <= 90)).sum() / chars,
        sum(len(w) > 16 for w in words) / n, 1 - len(set(words)) / n, 1 / n,
    ])
    return words_at, shares.astype(np.float32)


@dataclass
class Classifier:
    weights: np.ndarray  # SIZE x heads
    center: np.ndarray
    scale: np.ndarray

    def odds(self, words_at: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Log odds of the heads."""
        tail = self.weights[1 << BITS :]
        return self.weights[words_at].sum(0) + ((shares - self.center) / self.scale) @ tail[:-1] + tail[-1]


def fit(words_at: list[np.ndarray], shares: np.ndarray, labels: np.ndarray) -> Classifier:
    """Logistic regression by Adam on all sampled rows.

    A word counts as its smoothed log ratio between the classes; one whose ratio
    is under LEAST or within SURE standard errors of nothing says nothing.
    """
    rows = np.repeat(np.arange(len(words_at)), [len(w) for w in words_at])
    flat = np.concatenate(words_at).astype(np.int64) if words_at else np.empty(0, np.int64)
    center, scale = shares.mean(0), shares.std(0) + 1e-3
    x = (shares - center) / scale
    split, heads = 1 << BITS, labels.shape[1]
    often = np.bincount(flat, minlength=split)
    weights = np.zeros((SIZE, heads))
    for k in range(heads):
        y = labels[:, k]
        yes = np.bincount(flat, y[rows], split)
        ratio = np.log((yes + 1) / (y.sum() + 2)) - np.log((often - yes + 1) / (len(y) - y.sum() + 2))
        ratio[np.abs(ratio) < np.maximum(LEAST, SURE * np.sqrt(1 / (yes + 1) + 1 / (often - yes + 1)))] = 0
        # words that say nothing take no part
        telling = ratio[flat] != 0
        words, at = np.unique(flat[telling], return_inverse=True)
        of, scaled, n = rows[telling], ratio[flat[telling]], len(words)
        w = np.zeros(n + x.shape[1] + 1)
        w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        first, second = np.zeros(len(w)), np.zeros(len(w))
        for step in range(1, STEPS + 1):
            z = np.bincount(of, scaled * w[at], len(y)) + x @ w[n:-1] + w[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
            grad = np.concatenate([np.bincount(at, scaled * error[of], n), x.T @ error, [error.sum()]])
            grad[:-1] += PENALTY * w[:-1]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            w -= RATE * (1 - step / (STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights[words, k] = w[:n] * ratio[words]
        weights[split:, k] = w[n:]
    return Classifier(weights.astype(np.float32), center, scale)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """Batches with the rows handled and their features; the text is the first column."""
    for batch in batches:
        for at, words in blocks((t.as_py() for t in batch.column(0)), lower=False):
            h = word_hashes((w.lower().strip(_EDGES) for x in words for w in x), sum(map(len, words)))
            ends = np.cumsum([len(x) for x in words])
            yield batch, at, [features(x, h[e - len(x) : e]) for x, e in zip(words, ends, strict=True)]


def train(documents: DataFrame, labels: DataFrame) -> Classifier | None:
    """Fit on SAMPLE labelled documents at most, chosen by a hash of doc_id; None without labels."""
    known = labels.select("doc_id", *[F.col(h).cast("int").alias(h) for h in HEADS]).filter(" and ".join(f"{h} in (0, 1)" for h in HEADS) + " and doc_id is not null")
    chosen = known.groupBy("doc_id").agg(*[F.max(h).alias(h) for h in HEADS])
    chosen = smallest_hashes(chosen, ["doc_id"], SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, found in _featured(batches):
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([w.tobytes() for w, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], [*HEADS, "words", "shares"])

    # SAMPLE rows of three numbers at most, so the texts need no shuffle
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", *HEADS).mapInArrow(run, ", ".join(f"{h} int" for h in HEADS) + ", words binary, shares binary").collect()
    if not rows:
        return None
    return fit([np.frombuffer(r.words, np.uint32) for r in rows], np.array([np.frombuffer(r.shares, np.float32) for r in rows]), np.array([[r[h] for h in HEADS] for r in rows], float))


def _logit(p: F.Column) -> F.Column:
    return F.log(p / (1 - p))


def strength(mean: float, spread: float, within: float, sites: int, above: int, n: int) -> float:
    """Documents that a prior is worth: mean(1 - mean) / variance between sites - 1, within STRENGTH.

    spread is the mean squared distance of n documents' site means from those of
    the ``above`` wider sites, within the sum of squared distances of documents
    from their site's mean. Sites that don't differ spread by their sampling
    variance alone, within / (n - sites) * (sites - above) / n, which is taken off.
    """
    chance = within / max(n - sites, 1) * (sites - above) / max(n, 1)
    return float(np.clip(mean * (1 - mean) / max(spread - chance, 1e-9) - 1, *STRENGTH))


def classify(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", model: Classifier | None = None) -> DataFrame:
    """One row per document: doc_id, doc_<head>, host_<head>, path_<head>, <head> and kept.

    <head> is quality or toxic, from 0 to 1: by the document's words alone, by
    host and by path (posterior means from the sites' other documents), and combined. kept: likelier good than
    bad, and not likelier toxic than not. A null text is empty; null hosts or
    paths are sites of their own; repeated rows count as often as they occur.
    Without labels every probability is 0.5 and all documents are kept. An empty
    table gives an empty table.
    """
    scratch = Scratch(documents.sparkSession, "quality")
    model = model or train(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights for each head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, found in _featured(batches):
            odds = np.array([shared.value.odds(*f) if shared.value else np.zeros(len(HEADS)) for f in found], np.float64)
            p = 1 / (1 + np.exp(-np.clip(odds, -12, 12)))
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *[pa.array(p[:, k]) for k in range(len(HEADS))]], ["doc_id", "host", "path", *[f"doc_{h}" for h in HEADS]])

    source = documents.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    scored = scratch.write(source.mapInArrow(run, "doc_id long, host string, path string, " + ", ".join(f"doc_{h} double" for h in HEADS)), "scored")
    sites = scratch.write(
        scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(f"doc_{h}").alias(f"sum_{h}") for h in HEADS], *[F.sum(F.col(f"doc_{h}") * F.col(f"doc_{h}")).alias(f"square_{h}") for h in HEADS]),
        "sites",
    )
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n_host"), *[F.sum(f"sum_{h}").alias(f"host_sum_{h}") for h in HEADS])
    both = sites.join(hosts, "host")
    total = sites.agg(F.sum("n").alias("n"), F.count("*").alias("paths"), F.count_distinct("host").alias("hosts"), *[F.sum(f"sum_{h}").alias(h) for h in HEADS]).first()
    if not total.n:
        mean = dict.fromkeys(HEADS, 0.5)
    else:
        mean = {h: min(max(total[h] / total.n, 1e-4), 1 - 1e-4) for h in HEADS}
    in_host = F.col("n") / F.col("n_host")  # a host's sums stand in each of its paths
    spread = both.agg(
        *[(F.sum(F.col("n") * F.pow(F.col(f"host_sum_{h}") / F.col("n_host") - mean[h], 2)) / F.sum("n")).alias(f"host_{h}") for h in HEADS],
        *[(F.sum(F.col("n") * F.pow(F.col(f"sum_{h}") / F.col("n") - F.col(f"host_sum_{h}") / F.col("n_host"), 2)) / F.sum("n")).alias(f"path_{h}") for h in HEADS],
        *[F.sum(F.col(f"square_{h}") - F.pow(f"host_sum_{h}", 2) / F.col("n_host") * in_host).alias(f"in_host_{h}") for h in HEADS],
        *[F.sum(F.col(f"square_{h}") - F.pow(f"sum_{h}", 2) / F.col("n")).alias(f"in_path_{h}") for h in HEADS],
    ).first()
    out = scored.join(both.select("host", "path", "n", "n_host", *[f"{part}sum_{h}" for part in ("", "host_") for h in HEADS]), ["host", "path"])
    for h in HEADS:
        # a document's own evidence is left out of its sites', as it is added for itself
        own = F.col(f"doc_{h}")
        k = strength(mean[h], spread[f"host_{h}"] or 0, spread[f"in_host_{h}"] or 0, total.hosts, 1, total.n or 0)
        out = out.withColumn(f"host_{h}", (F.greatest(F.col(f"host_sum_{h}") - own, F.lit(0.0)) + k * mean[h]) / (F.col("n_host") - 1 + k))
        k = strength(mean[h], spread[f"path_{h}"] or 0, spread[f"in_path_{h}"] or 0, total.paths, total.hosts, total.n or 0)
        out = out.withColumn(f"path_{h}", (F.greatest(F.col(f"sum_{h}") - own, F.lit(0.0)) + k * F.col(f"host_{h}")) / (F.col("n") - 1 + k))
        prior = F.least(F.greatest(F.col(f"path_{h}"), F.lit(1e-4)), F.lit(1 - 1e-4))
        out = out.withColumn(h, 1 / (1 + F.exp(-(_logit(F.col(f"doc_{h}")) + _logit(prior) - float(np.log(mean[h] / (1 - mean[h])))))))
    return out.select("doc_id", *[f"{level}_{h}" for level in ("doc", "host", "path") for h in HEADS], *HEADS, ((F.col("quality") >= 0.5) & (F.col("toxic") <= 0.5)).alias("kept"))

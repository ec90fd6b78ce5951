"""Embedding near-deduplication by epsilon grid order join.

Unit vectors whose cosine is at least c lie within eps = sqrt(2 - 2c), and so do
their projections on leading principal directions. Vectors are sorted by the
grid cells (of width eps) of those projections into a sequence of blocks. Pairs
of sequence intervals are joined recursively, from coarse intervals to blocks;
pairs whose boxes are further apart than eps are skipped, which loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, smallest_hashes

AXES, BLOCK = 6, 512
#: Vectors that the principal directions are fitted on at most; any directions give the same result.
SAMPLE = 2000
#: Sizes of the sequence's intervals as bits of a block's number, coarse to fine (32 bits count partitions).
LEVELS = (52, 46, 40, 36, 32, 8, 4, 0)
_SLACK = 1e-9


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, digests, dims = [], [], []
        for value, label in zip(batch.column(1), batch.column(2), strict=True):
            x = value.as_py() if label.is_valid else None
            v = np.array(x, np.float64) if x and None not in x else None
            ok = v is not None and np.isfinite(v).all() and 0 < (v @ v) < np.inf
            raw.append(v.tobytes() if ok else None)
            digests.append(xxhash.xxh3_128_digest(raw[-1]) if ok else None)
            dims.append(len(v) if ok else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "label", "dim", "digest", "raw"]
        )


def _directions(reps: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions for each vector length."""
    rows = smallest_hashes(reps.select("vec_id", "dim", "raw"), ["vec_id"], SAMPLE).collect()
    out = {}
    for dim in {r.dim for r in rows}:
        x = np.array([np.frombuffer(r.raw) for r in rows if r.dim == dim])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[dim] = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:AXES].T
    return out


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosine of each row of x with each row of y is at least ``least``, in double precision."""
    return (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]) >= least


def _roots(mask: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id connected to each row and column through the mask's links."""
    big = np.iinfo(np.int64).max
    x, y = ids_x.copy(), ids_y.copy()
    while True:
        new_x = np.minimum(x, np.where(mask, y[None, :], big).min(1))
        new_y = np.minimum(y, np.where(mask, new_x[:, None], big).min(0))
        if (new_x == x).all() and (new_y == y).all():
            return x, y
        x, y = new_x, new_y


def near_duplicates(embeddings: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of embeddings.

    Rows of one label are linked when their cosine, in double precision, is at
    least ``least``. n_links counts the other rows linked directly, component_id
    is the smallest vec_id reachable, kept tells that it is the row's own. Rows
    without label, and vectors that are null, zero, of another length, or hold
    null or non-finite components, link with nothing. Equal vectors of a label
    are one point of the join and count as many times as they occur. vec_id is
    taken as a key; a null one keeps a null component. Other columns are ignored.
    An empty table gives an empty table.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "embedding")
    eps = float(np.sqrt(2 - 2 * least)) + _SLACK
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    label = source.schema["label"].dataType.simpleString()
    rows = scratch.write(source.mapInArrow(_vectors, f"vec_id long, label {label}, dim int, digest binary, raw binary"), "rows")
    valid = rows.filter("digest is not null and vec_id is not null")
    groups = scratch.write(valid.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min(F.struct("vec_id", "dim", "raw")).alias("first")), "groups")
    reps = groups.select(F.col("rep").alias("vec_id"), "label", "copies", F.col("first.dim").alias("dim"), F.col("first.raw").alias("raw"))
    axes = spark.sparkContext.broadcast(_directions(reps))  # AXES numbers for each component, whatever the rows
    cells = [f"c{i}" for i in range(AXES)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.zeros((batch.num_rows, AXES))
            for i, (dim, raw) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("raw"), strict=True)):
                v = np.frombuffer(raw.as_py())
                directions = axes.value.get(dim)
                if directions is not None:  # lengths outside the sample stay at the origin, and none of their pairs is skipped
                    at[i, : directions.shape[1]] = v @ directions / np.linalg.norm(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(at[:, k]) for k in range(AXES)]], [*batch.schema.names, *cells])

    schema = f"vec_id long, label {label}, copies long, dim int, raw binary, " + ", ".join(f"{c} double" for c in cells)
    placed = reps.mapInArrow(project, schema)
    order = ["label", "dim", *[F.floor(F.col(c) / eps) for c in cells], "vec_id"]
    placed = scratch.write(placed, "placed")
    sequence = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held = TaskContext.get().partitionId(), 0, None

        def block(t: pa.Table) -> pa.RecordBatch:
            ids, copies = t["vec_id"].to_numpy(), t["copies"].to_numpy()
            at = [t[c].to_numpy() for c in cells]
            values = [(task << 32) + number, t["label"][0].as_py(), t["dim"][0].as_py(), ids.tobytes(), copies.tobytes(), b"".join(t["raw"].to_pylist())]
            kinds = [pa.int64(), t.schema.field("label").type, pa.int32(), *[pa.binary()] * 3]
            values += [float(x.min()) for x in at] + [float(x.max()) for x in at]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, [*kinds, *[pa.float64()] * 2 * AXES], strict=True)], names)

        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            while held.num_rows:
                same = np.array([a == b for a, b in zip(held["label"].to_pylist()[:BLOCK], [held["label"][0].as_py()] * BLOCK, strict=False)]) & (held["dim"].to_numpy()[:BLOCK] == held["dim"][0].as_py())
                n = len(same) if same.all() else int(same.argmin())
                if n == held.num_rows and n < BLOCK:
                    break  # it may go on in the next batch
                yield block(held.slice(0, n))
                held, number = held.slice(n), number + 1
        if held is not None and held.num_rows:
            yield block(held)

    bounds = [f"{side}{i}" for side in ("lo", "hi") for i in range(AXES)]
    names = ["block", "label", "dim", "ids", "copies", "raw", *bounds]
    blocks = scratch.write(sequence.mapInArrow(cut, f"block long, label {label}, dim int, ids binary, copies binary, raw binary, " + ", ".join(f"{b} double" for b in bounds)), "blocks")

    def nodes(shift: int, above: int, suffix: str) -> DataFrame:
        """Intervals of a level with their boxes and the interval above."""
        found = blocks.select("label", "dim", F.shiftright("block", shift).alias("key"), F.shiftright("block", above).alias("over"), *bounds)
        boxes = [*(F.min(f"lo{i}").alias(f"lo{i}{suffix}") for i in range(AXES)), *(F.max(f"hi{i}").alias(f"hi{i}{suffix}") for i in range(AXES))]
        return found.groupBy("label", "dim", "key", "over").agg(*boxes).withColumnsRenamed({"key": f"key{suffix}", "over": f"over{suffix}"})

    zero = F.lit(0.0)
    gap = sum((F.pow(F.greatest(zero, F.col(f"lo{i}a") - F.col(f"hi{i}b"), F.col(f"lo{i}b") - F.col(f"hi{i}a")), 2) for i in range(AXES)), zero)
    pairs, above = None, 62
    for shift in LEVELS:
        a, b = nodes(shift, above, "a"), nodes(shift, above, "b")
        met = a.join(b, ["label", "dim"]) if pairs is None else pairs.join(a, ["label", "dim", "overa"]).join(b, ["label", "dim", "overb"])
        pairs = met.filter((F.col("keya") <= F.col("keyb")) & (gap <= eps * eps)).select("label", "dim", F.col("keya").alias("overa"), F.col("keyb").alias("overb"))
        pairs = scratch.write(pairs, "pairs")
        above = shift

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids_x, ids_y = np.frombuffer(r["ids_x"], np.int64), np.frombuffer(r["ids_y"], np.int64)
                x, y = np.frombuffer(r["raw_x"]).reshape(-1, r["dim"]), np.frombuffer(r["raw_y"]).reshape(-1, r["dim"])
                mask = _linked(x, y, least)
                own = r["overa"] == r["overb"]
                if own:
                    np.fill_diagonal(mask, False)
                if not mask.any():
                    continue
                root_x, root_y = _roots(mask, ids_x, ids_y)
                parts = [(ids_x, root_x, mask @ np.frombuffer(r["copies_y"], np.int64))]
                if not own:
                    parts.append((ids_y, root_y, mask.T @ np.frombuffer(r["copies_x"], np.int64)))
                ids, roots, links = (np.concatenate(p) for p in zip(*parts, strict=True))
                keep = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(roots[keep]), pa.array(links[keep])], ["a", "b", "links"])

    side = lambda s, o: blocks.select(F.col("block").alias(o), F.col("ids").alias(f"ids_{s}"), F.col("copies").alias(f"copies_{s}"), F.col("raw").alias(f"raw_{s}"))
    compared = pairs.join(side("x", "overa"), "overa").join(side("y", "overb"), "overb").drop("label")
    found = scratch.write(compared.mapInArrow(compare, "a long, b long, links long"), "links")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    owner = (
        groups.select("label", "digest", "rep", "copies")
        .join(links.withColumnRenamed("a", "rep"), "rep", "left")
        .join(connected_components(found.select("a", "b"), scratch, "labels").withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    return scratch.close(
        rows.select("vec_id", "label", "digest")
        .join(owner, ["label", "digest"], "left")
        .select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )

"""Line dedup: lines that many documents share go from all of them; only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: What is stripped from both ends of a line.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that are broadcast at most (two longs each); more are matched by a join.
BROADCAST_KEYS = 1 << 20


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(*of: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that depend on different seeds: 128 bits in all."""
    return F.xxhash64(*of), F.xxhash64(F.lit(0x5EED), *of)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row a line: the document's columns __d1, __d2 and doc_id, position ``at``, hashes h1, h2 of its key (null for short keys)."""
    each = docs.select("__d1", "__d2", "doc_id", F.posexplode(F.split("__text", "\n")).alias("at", "line")).withColumn("key", line_key(F.col("line")))
    long = F.length("key") >= min_chars
    h1, h2 = _hashes(F.col("key"))
    return each.select("__d1", "__d2", "doc_id", "at", F.when(long, h1).alias("h1"), F.when(long, h2).alias("h2"))


def shared_keys(lines: DataFrame, least_documents: int) -> DataFrame:
    """h1, h2, n: keys found in at least so many documents. A document without an id is told by its text."""
    ids = lines.filter("h1 is not null").select("h1", "h2", "doc_id", F.when(F.col("doc_id").isNull(), F.col("__d1")).alias("__d1")).distinct()
    return ids.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= least_documents)


def _marked(lines: DataFrame, gone: DataFrame, most: int) -> DataFrame:
    """lines with ``gone``, true where the key is among the given ones.

    Few keys are broadcast. Of more, those that take more than an even share of
    all sightings are (fewer than ``most`` by that rule), and the others, none
    of which is hot, are joined by hash.
    """
    keys = gone.select("h1", "h2", F.lit(True).alias("gone"))
    if gone.count() <= most:
        return lines.join(F.broadcast(keys), ["h1", "h2"], "left")
    share = gone.agg(F.sum("n")).first()[0] / most
    hot = gone.filter(F.col("n") > share).select("h1", "h2", F.lit(True).alias("hot"))
    met = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    found = met.filter("hot").withColumnRenamed("hot", "gone")
    rest = met.filter("hot is null and h1 is not null").drop("hot").join(keys, ["h1", "h2"], "left")
    short = met.filter("h1 is null").withColumnRenamed("hot", "gone")
    return found.unionByName(rest).unionByName(short)


def deduplicate(docs: DataFrame, least_documents: int = 10, min_chars: int = 1, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs (doc_id, text and any other columns) without the lines that at least ``least_documents`` documents hold.

    A line's key is the line stripped of white space at both ends, with A-Z in
    lower case. Keys of fewer than ``min_chars`` code points stay. All lines of
    a shared key go, in every document; the others stay as they are, in order,
    joined by a line feed. ``n_lines`` (before) and ``n_dropped`` are added; columns
    of these names in docs are replaced.

    A null or empty text has one empty line and stays as an empty text. Rows
    with the same doc_id are one document when documents are counted, and each
    row keeps a row of its own in the result; rows without an id count as a
    document for each different text. An empty table gives an empty table.

    Lines are exploded twice, as hashes: to count documents (pre-aggregated in
    each task) and to mark each position. A text is shuffled once at most, to meet its own marks.
    """
    scratch = Scratch(docs.sparkSession, "linededup")
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col("text"), F.lit(""))
    d1, d2 = _hashes(F.col("doc_id"), text)
    rows = docs.select(*own, text.alias("__text"), d1.alias("__d1"), d2.alias("__d2"))
    lines = _lines(rows, min_chars)
    gone = scratch.write(shared_keys(lines, least_documents), "keys")
    marked = _marked(lines.drop("doc_id"), gone, broadcast_keys).select("__d1", "__d2", F.struct("at", F.col("gone").isNotNull().alias("gone")).alias("mark"), "gone")
    # repeated rows give the same marks, which are one set
    marks = marked.groupBy("__d1", "__d2").agg(F.sort_array(F.collect_set("mark")).alias("__marks"), F.max("gone").alias("__any")).filter("__any").select("__d1", "__d2", F.col("__marks.gone").alias("__gone"))
    met = rows.join(marks, ["__d1", "__d2"], "left").withColumn("__lines", F.split("__text", "\n"))
    left = F.zip_with("__lines", "__gone", lambda line, drop: F.when(~drop, line))  # array_join leaves out nulls
    met = met.withColumns({"text": F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(left, "\n")), "n_lines": F.size("__lines").cast("long"), "n_dropped": F.coalesce(F.size(F.filter("__gone", lambda drop: drop)), F.lit(0)).cast("long")})
    return scratch.close(met.select(*own, "n_lines", "n_dropped"))

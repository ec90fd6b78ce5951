import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkpanel.llm import linededup, queries

SPACE = " \t\n\x0b\f\r"
SCHEMA = "doc_id long, text string, n_lines string, __gone int"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, least, shortest):
    """n_lines, n_dropped and kept text of each row, and how often."""
    seen = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            seen[key(line)].add(doc if doc is not None else f"text {text}")
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < shortest or len(seen[key(x)]) < least]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


def hard_rows():
    rng = random.Random(3)
    lines = ["", " ", "Shared line", " shared LINE\t", "Äpfel", "äpfel", " Shared line", "x", "\x0b", "ÄPFEL", "İ shared", "long " * 50] + [f"own {i}" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n"), (None, "Shared line\nnothing"), (None, "Shared line\nnothing"), (None, None), (503, "\r\nShared line\r\n"), (504, "\n".join(lines * 3000))]
    return rows + rows[:30] + [(600, "again and again")] * 40 + [(601 + i, "copies of one") for i in range(60)]


@pytest.mark.parametrize(("least", "shortest", "most"), [(10, 1, 1 << 20), (2, 0, 1 << 20), (10, 1, 3), (3, 6, 1)])
def test_matches_brute_force_by_both_routes(spark, least, shortest, most):
    rows = hard_rows()
    df = spark.createDataFrame([(*r, "mine", 7) for r in rows], SCHEMA).repartition(5)
    got = linededup.deduplicate(df.drop("__gone"), least, shortest, most)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert rows_of(got) == plain(rows, least, shortest)


def test_whole_table_and_empty_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op11_line_dedup(spark, "/root/testdata/sf0.01").collect()}
    want = plain(rows, 10, 1)
    assert got == {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in want} and any(k for _, _, k, _ in want)
    assert linededup.deduplicate(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_columns_stay_and_no_python_runs(spark):
    df = spark.createDataFrame([(i, "a\nb", "keep", i) for i in range(12)], "doc_id long, text string, key string, h1 long")
    got = linededup.deduplicate(df)
    assert got.columns == ["doc_id", "text", "key", "h1", "n_lines", "n_dropped"]
    assert {(r.text, r.key, r.h1 == r.doc_id) for r in got.collect()} == {("", "keep", True)}
    source = open(linededup.__file__).read()
    assert not any(word in source for word in ("pandas", "Arrow", "arrow", "udf", ".rdd", "numpy"))
    assert F.col("x") is not None

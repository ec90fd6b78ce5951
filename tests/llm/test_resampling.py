import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from sparkpanel.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, percent=10, longest=1, buckets=10_000, min_words=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    made = [features(t, longest) for _, t in docs]
    s, t = Counter(bucket(f) for _, fs in made for f in fs), Counter(bucket(f) for text in target for f in features(text, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (all_s + buckets)) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for (doc, _), (n, fs) in zip(docs, made, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        rows.append([doc, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], -math.inf if r[0] is None else r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("longest", "head"), [(1, 1 << 15), (1, 3), (2, 1 << 15), (3, 5), (2, 1)])
def test_matches_brute_force_with_any_head(spark, longest, head):
    rng = random.Random(9)
    vocabulary = ["alpha", "Beta", "GAMMA", "naïve", "ÄÖ", "x1", "日本", "the", "the", "the", "w" * 100] + [f"r{i}" for i in range(200)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", ", ", "\x7f"]) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "!?"), (None, text(40)), (1003, text(40_000))]
    docs += [(2000, "the the " * 30)] * 5
    target = [text(30) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, rank string, bucket int").repartition(4)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, item int")
    got = resampling.resample(df, wanted, 25, longest, 997, 5, 7, most_words=head, most_pairs=head)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == plain(docs, target, 25, longest, 997, 5, 7)


def test_whole_table(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    want = plain([(r.doc_id, r.text) for r in read("documents").collect()], [r.text for r in read("benchmark").collect()])
    got = queries.op13_importance_resampling(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == sorted([(d, f, w, s, r) for d, _, f, w, s, r in want], key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert resampling.resample(docs, one).collect() == [] == resampling.resample(docs, docs).collect()
    assert rows_of(resampling.resample(one, docs, 100)) == plain([(1, "a b c " * 10)], [], 100)


def test_frequent_items_summary_keeps_what_is_frequent():
    found = Counter({f"w{i}": 1 for i in range(100)} | {"often": 60, "also": 50})
    kept = resampling._frequent(found, 10)
    assert kept["often"] == 59 and kept["also"] == 49 and len(kept) == 2

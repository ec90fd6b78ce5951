import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from sparkpanel.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    digits = lambda m: re.sub(r"\D", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_patterns_match_plain_expressions(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab.@-+_ 0123456789().") for _ in range(rng.randrange(120))) for _ in range(20_000)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text in texts:
        assert pii.base_spans(text) == plain(text), text
    pii.base_spans("a" * 200_000 + "@"), pii.base_spans("1" * 200_000), pii.base_spans("a" * 100_000 + "@@" + "+1" * 50_000)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_contract_digest(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op10_pii(spark, f"/root/testdata/{size}").collect()}
    assert len(got) == len(docs)
    for r in docs:
        spans = plain(r.text or "")
        counts = Counter(k for _, k, _ in spans)
        assert [got[r.doc_id][f"n_{name}"] for name in pii.KINDS] == [counts[k] for k in range(4)]
        assert got[r.doc_id].n_spans == len([s for s in got[r.doc_id].spans.split(",") if s])
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(got[r.doc_id].spans.split(","))


def test_disclosing_terms_and_edges(spark):
    days = ["monday", "tuesday", "friday", "sunday", "winter", "summer"]
    rows = [(i, f"{i} says mister Quillfeather can be reached at q.f@example.org every {days[i]} for notes") for i in range(6)]
    rows += [(200 + i, f"{i} says the house can be reached every {days[i % 6]} for notes without mail") for i in range(160)]
    rows += [(100, None), (101, ""), (101, ""), (None, "call +1 (212) 555-0123 now")]
    # a context that is repeated word for word counts once
    rows += [(500 + i, "copied words of Thistlewood at t.w@example.org here") for i in range(9)]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, near int, base string")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    text = rows[0][1]
    assert "Quillfeather" in {text[s.start : s.end] for s in found[0].spans} and "reached" not in {text[s.start : s.end] for s in found[0].spans}
    assert len(found[500].spans) == 1
    assert found[100].spans == [] and found[210].spans == [] and len(found[None].spans) == 1
    clean = {(r.doc_id, r.near, r.base): r.text for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in clean[(0, 1, "b")] and "Quillfeather" not in clean[(0, 1, "b")] and clean[(100, 1, "b")] is None
    assert clean[(None, 1, "b")] == "call [PHONE] now" and clean[(200, 1, "b")] == rows[6][1]
    assert {(r.doc_id, r.near, r.base): r.text for r in pii.sanitise(df, most=0).collect()} == clean
    assert pii.sanitise(df).count() == len(rows) and pii.find(df.limit(0)).count() == 0 and pii.sanitise(df.limit(0)).count() == 0


def test_telling_terms_go_wherever_they_stand(spark):
    filler = [f"{a}{b}" for a in ("red", "blue", "green", "grey", "black", "white", "pink") for b in ("stone", "water", "forest", "field")]
    far = lambda i: " ".join(filler[(i * 5 + k) % len(filler)] for k in range(12))
    rows = [(i, f"{far(i)} Quillfeather O'Brien-Smith AB12 {far(i + 1)} then write to q.f@example.org {far(i + 2)} or quillfeather again") for i in range(5)]
    rows += [(50, f"{far(3)} (Quillfeather), told us of O'Brien-Smith and AB12 {far(9)}")]
    rows += [(100 + i, f"{far(i)} {far(i + 7)} none") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text, found = dict(rows), {r.doc_id: r.spans for r in pii.find(df).collect()}
    for i in (0, 4, 50):
        terms = [text[i][s.start : s.end] for s in found[i] if s.kind == len(pii.KINDS)]
        assert {"Quillfeather", "O'Brien-Smith", "AB12"} <= set(terms) and not set(terms) & set(filler)
    assert "quillfeather" in [text[0][s.start : s.end] for s in found[0]]
    assert all(not found[100 + i] for i in range(160))
    # one copied text gives one context, however far the term
    same = spark.createDataFrame([(i, text[0]) for i in range(6)] + rows[6:], "doc_id long, text string")
    assert all(len(r.spans) == 1 for r in pii.find(same).filter("doc_id < 6").collect())


def test_terms_that_disclose_a_kind_against_plain_counts(spark):
    """All spans of the largest given documents, from P(kind | term) counted in dictionaries; no value there is seen often enough."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    n_term, n_kind, n_both, of, contexts = Counter(), Counter(), Counter(), {}, defaultdict(dict)
    for doc_id, text in rows:
        spans = pii.base_spans(text)
        kinds = {k for _, k, _ in spans} | ({"any"} if spans else set())
        free = [(t, s, e, i) for i, (term, form, s, e) in enumerate(pii._words(text, spans)) for t in (term, form) if t]
        of[doc_id] = text, spans, kinds, free
        n_term.update(pii.terms_in(text))
        n_kind.update(kinds)
        n_both.update((t, k) for t in {x[0] for x in free} for k in kinds)
    bits = lambda t, k: math.log2(n_both[t, k] / n_term[t] * len(rows) / n_kind[k])
    suspects = {(t, k) for (t, k), n in n_both.items() if n > 8 and n >= 0.5 * n_term[t] and bits(t, k) >= 3}
    wanted = {t for t, _ in suspects}
    for text, spans, kinds, free in of.values():
        if any(t in wanted for t, *_ in free):
            words = [t if t.isalpha() else "" for t, _, _, _ in pii._words(text, spans)]
            for t, _, _, i in free:
                if t in wanted:
                    around = tuple(words[j] if 0 <= j < len(words) else "" for j in range(i - pii.CONTEXT, i + pii.CONTEXT + 1))
                    contexts[t].setdefault(around, set()).update(kinds)

    def sure(t, k):
        n, p = len(contexts[t]), sum(k in x for x in contexts[t].values()) / len(contexts[t])
        return (p + 8 / n - 4 * math.sqrt(p * (1 - p) / n + 4 / n**2)) / (1 + 16 / n) >= 0.5

    telling = {t for t, k in suspects if sure(t, k)}
    assert {"token", "<40 hex>"} <= telling
    want = {i: sorted({*spans, *((s, len(pii.KINDS), e) for t, s, e, _ in free if t in telling)}) for i, (_, spans, _, free) in of.items()}
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()}
    assert got == want and sum(map(len, got.values())) > sum(len(x[1]) for x in of.values())
    joined = pii.find(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), most=0)
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in joined.collect()} == want


def test_long_texts_take_linear_time():
    import time

    text = " ".join(f"word{i} name{i}@example.org {i % 250}.1.2.{i % 250} +1 212 555 {i % 10000:04d}" for i in range(5000))
    start = time.perf_counter()
    spans = pii.base_spans(text)
    pii.sightings(text, spans)
    assert len(spans) > 14_000 and time.perf_counter() - start < 10

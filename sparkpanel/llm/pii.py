"""Personal data: pattern matches, and terms that disclose them.

Information-theoretic sanitisation: from co-occurrence over whole documents of
the corpus the share of a term's documents that mention one protected entity is
estimated, P(entity | term), and the information it gives over the entity's own
frequency, log2 P(entity | term) / P(entity). Protected are each value found (one
e-mail address) and each kind of them (any e-mail address, any personal data). A
term over both thresholds discloses the entity; it is removed wherever it
stands, in documents without the entity too. A term is a word, or the form of
words made of letters and digits (40 hexadecimal digits).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_WORDS, Scratch, give_back, key_bitmap, signed, window_hash, word_hashes

KINDS = ("email", "ip", "card", "phone")
#: Words on either side that make the context of an entity or a term; copied contexts count once.
CONTEXT = 5
#: Least number of different contexts of term and entity, share of the term's documents, and bits of information.
MIN_CONTEXTS, MIN_SHARE, MIN_BITS = 3, 0.5, 4.0
#: Of a kind of entity: bits of information, and standard errors that the share is taken lower by, as many terms are tried.
KIND_BITS, KIND_ERRORS = 3.0, 4.0
#: Disclosing terms that are sent to the executors at most (8 MB); more are matched by a join.
TELLING_MOST = 1_000_000

_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
#: White space at which str.split() splits too, though words here don't end there.
_OTHER_SPACE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\v\f\r") + "]")
_DIGIT = re.compile(r"[0-9]")
_HEX = re.compile(r"[0-9a-fA-F]+")
_EDGES = ".,;:!?()[]{}<>\"'*#$%&|/\\"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, in time linear in the text."""
    out = []
    for run in _RUN.finditer(text) if "@" in text else ():
        begin = run.start()
        at = text.find("@", begin, run.end())
        while at >= 0:
            found = _DOMAIN.match(text, at + 1, run.end()) if at > begin else None
            if found:
                out.append((begin, found.end()))
            begin = found.end() if found else at + 1
            at = text.find("@", begin, run.end())
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind (index in KINDS), end of all base matches, in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def term_of(word: str) -> str:
    """The term a word stands for: without edge punctuation, lower case; empty unless it has three letters or digits."""
    term = word.strip(_EDGES).lower()
    return term if len(term) >= 3 and (term.isalnum() or sum(map(str.isalnum, term)) >= 3) else ""


def form_of(word: str) -> str:
    """The form of a word of eight or more letters and digits, both of them: its length and alphabet; empty for others."""
    word = word.strip(_EDGES)
    if len(word) < 8 or not word.isalnum() or word.isalpha() or word.isdigit():
        return ""
    return f"<{len(word)} {'hex' if _HEX.fullmatch(word) else 'alphanumeric'}>"


def terms_in(text: str) -> set[str]:
    """All terms of a text, those within pattern matches too."""
    words = set(_WORD.findall(text) if _OTHER_SPACE.search(text) else text.split())
    alphabetic = {w for w in words if w.isalpha()}
    others = words - alphabetic
    out = {w.lower() for w in alphabetic if len(w) >= 3} | {term_of(w) for w in others}
    if _DIGIT.search(text):
        out |= {form_of(w) for w in others if len(w) >= 8}
    out.discard("")
    return out


def _words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int]]:
    """Term, form, start and end of each word without its edge punctuation; neither where a span overlaps the word."""
    out, k, last = [], 0, 0
    for m in _WORD.finditer(text):
        word, s, e = m[0], m.start(), m.end()
        while k < len(spans) and spans[k][0] < e:
            last = max(last, spans[k][2])
            k += 1
        lead, tail = len(word) - len(word.lstrip(_EDGES)), len(word) - len(word.rstrip(_EDGES))
        term, form = ("", "") if last > s else (term_of(word), form_of(word))
        out.append((term, form, s + lead, e - tail))
    return out


def _around(words: list[tuple[str, str, int, int]]) -> list[int]:
    """Hash of the alphabetic terms of each word and CONTEXT words on either side."""
    h = word_hashes((t.encode() if t.isalpha() else b"" for t, _, _, _ in words), len(words))
    h[[not t.isalpha() for t, _, _, _ in words]] = 0
    return signed(window_hash(np.pad(h, CONTEXT), 2 * CONTEXT + 1, 0x9E3779B97F4A7C15)).tolist()


def _entity(text: str, kind: int) -> str:
    return f"{KINDS[kind]}:{re.sub(r'[ ().-]', '', text).lower() if kind > 1 else text.lower()}"


def sightings(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[dict], list[dict], list[dict]]:
    """Of a text with spans: terms near each entity, its entities, and all its terms.

    Contexts are hashes of the alphabetic terms around; an entity or a term seen
    more than once has the least of its hashes.
    """
    if not spans:
        return [], [], []
    words = _words(text, spans)
    around = _around(words)
    keys = signed(word_hashes((t.encode() for t, _, _, _ in words), len(words))).tolist()
    forms = signed(word_hashes((f.encode() for _, f, _, _ in words), len(words))).tolist()
    terms: dict[int, int] = {}
    for (term, form, _, _), key, other, context in zip(words, keys, forms, around, strict=True):
        if term:
            terms[key] = min(terms.get(key, context), context)
        if form:
            terms[other] = min(terms.get(other, context), context)
    near, entities = [], {}
    starts = np.array([m.start() for m in _WORD.finditer(text)])
    for start, kind, end in spans:
        entity = _entity(text[start:end], kind)
        low = int(np.searchsorted(starts, start, "right")) - 1
        high = int(np.searchsorted(starts, end, "left"))
        at = [*range(max(0, low - CONTEXT), low), *range(high, min(high + CONTEXT, len(words)))]
        context = xxhash.xxh3_64_intdigest(" ".join(words[i][0] for i in at if words[i][0].isalpha()).encode()) - 2**63
        entities[entity] = min(entities.get(entity, context), context)
        near += [{"term_key": keys[i], "entity": entity, "context": context} for i in at if words[i][0]]
    return near, [{"entity": e, "context": c} for e, c in entities.items()], [{"term_key": t, "context": c} for t, c in terms.items()]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_NEAR = pa.list_(pa.struct([("term_key", pa.int64()), ("entity", pa.string()), ("context", pa.int64())]))
_ENTITIES = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64())]))
_TERMS = pa.list_(pa.struct([("term_key", pa.int64()), ("context", pa.int64())]))
_NAMED = (
    "text_key binary, kinds array<int>, near array<struct<term_key:long,entity:string,context:long>>, "
    "entities array<struct<entity:string,context:long>>, terms array<struct<term_key:long,context:long>>"
)
_SPAN_LIST = "array<struct<start:long,kind:int,end:long>>"
_HITS = pa.list_(pa.struct([("term_key", pa.int64()), ("context", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is counted of each row whose text holds a pattern match."""
    for batch in batches:
        keys, kinds, seen = [], [], []
        for value in batch.column(0):
            text = value.as_py() or ""
            if found := base_spans(text):
                keys.append(xxhash.xxh3_128_digest(text.encode()))
                kinds.append([*{k for _, k, _ in found}, len(KINDS)])
                seen.append(sightings(text, found))
        columns = [pa.array([x[i] for x in seen], kind) for i, kind in enumerate((_NEAR, _ENTITIES, _TERMS))]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(kinds, pa.list_(pa.int32())), *columns], ["text_key", "kinds", "near", "entities", "terms"])
        give_back()


def occurrences(text: str, spans: list[tuple[int, int, int]], known: Callable[[np.ndarray], np.ndarray], contexts: bool = False) -> list[tuple[int, int, int, int]]:
    """Key, context (0 unless asked for), start and end of the text's terms whose keys are known, outside its pattern matches."""
    terms = list(terms_in(text))
    h = signed(word_hashes((t.encode() for t in terms), len(terms)))
    found = np.flatnonzero(known(h)) if len(terms) else ()
    if not len(found):
        return []
    key_of = {terms[i]: k for i, k in zip(found.tolist(), h[found].tolist(), strict=True)}
    words = _words(text, spans)
    around = _around(words) if contexts else [0] * len(words)
    return [(key_of[t], c, s, e) for (term, form, s, e), c in zip(words, around, strict=True) for t in (term, form) if t in key_of]


def among(keys: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Which of some numbers are among the sorted keys."""
    if not len(keys):
        return lambda h: np.zeros(len(h), bool)
    return lambda h: keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def _hits(sorted_keys: Broadcast | None, bitmap: Broadcast | None):
    """Occurrences of the terms with these keys, or that the bitmap may hold, of each text that has any; kinds: bits of those it has."""

    def known(h: np.ndarray) -> np.ndarray:
        if sorted_keys is not None:
            return among(sorted_keys.value)(h)
        return np.ones(len(h), bool) if bitmap is None else bitmap.value.may_hold(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds, hits = [], [], []
            for value in batch.column(0):
                text = value.as_py() or ""
                spans = base_spans(text)
                if found := occurrences(text, spans, known, contexts=True):
                    keys.append(xxhash.xxh3_128_digest(text.encode()))
                    kinds.append(sum({1 << k for _, k, _ in spans}))
                    hits.append([{"term_key": k, "context": c, "start": s, "end": e} for k, c, s, e in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(kinds, pa.int32()), pa.array(hits, _HITS)], ["text_key", "kinds", "hits"])

    return run


def _places(docs: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """text_key, kinds, term_key, context, start and end of the terms' occurrences in distinct texts, and of others if they are over ``most``."""
    shared = _sent(terms, most)
    bitmap = key_bitmap(terms) if shared is None else None
    held = None if bitmap is None else docs.sparkSession.sparkContext.broadcast(bitmap)
    hits = docs.select("text").mapInArrow(_hits(shared, held), "text_key binary, kinds int, hits array<struct<term_key:long,context:long,start:long,end:long>>")
    return hits.dropDuplicates(["text_key"]).select("text_key", "kinds", F.explode("hits").alias("x")).select("text_key", "kinds", "x.*")


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term, summed over the batch before anything is shuffled."""
    for batch in batches:
        parts, block, size = [], [], 0
        for i, value in enumerate(batch.column(0)):
            block.extend(terms_in(value.as_py() or ""))
            if len(block) - size >= BLOCK_WORDS or i == batch.num_rows - 1:
                h, n = np.unique(word_hashes((t.encode() for t in block), len(block)), return_counts=True)
                parts.append((h, n.astype(np.float64)))
                block = []
        if parts:
            keys, counts = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts)], ["term_key", "n"])
        give_back()


def lower_share(n: Column, all_: Column, errors: float) -> Column:
    """The share n / all_, lower by so many standard errors (Wilson's bound)."""
    p, z = n / all_, errors * errors
    return (p + z / (2 * all_) - errors * F.sqrt(p * (1 - p) / all_ + z / (4 * all_ * all_))) / (1 + z / all_)


def telling_terms(docs: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """term_key of all terms that disclose a value or a kind of personal data.

    A value is disclosed by a term that is seen with it in MIN_CONTEXTS different
    contexts; a kind by a term whose share over its different contexts is above
    MIN_SHARE by KIND_ERRORS standard errors.
    """
    named = scratch.write(docs.select("text").mapInArrow(_named, _NAMED), "named")
    # documents, not texts: a copy counts on both sides
    texts = named.groupBy("text_key").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"))
    owned = scratch.write(texts.select("text_key", "copies", F.explode("entities").alias("x")).select("text_key", "copies", "x.*"), "owned")
    entities = scratch.write(owned.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("n_texts")), "entities")
    n_term = scratch.write(docs.select("text").mapInArrow(_term_counts, "term_key long, n long").groupBy("term_key").agg(F.sum("n").alias("n_term")), "terms")
    n_docs = docs.count()

    near = named.select("text_key", F.explode("near").alias("x")).select("text_key", "x.*").distinct()
    support = near.select("term_key", "entity", "context").distinct().groupBy("term_key", "entity").count().filter(F.col("count") >= MIN_CONTEXTS)
    support = scratch.write(support.select("term_key", "entity"), "support")

    # over whole texts; left out are only entities and terms that cannot pass: a share is 1 at most, and half of a term's documents name the entity
    able = entities.filter((F.col("n_texts") >= MIN_CONTEXTS) & (F.col("n_entity") * 2**MIN_BITS <= n_docs)).select("entity")
    common = n_term.filter(F.col("n_term") * MIN_SHARE * 2**MIN_BITS > n_docs).select("term_key")  # few: each is in a large part of the documents
    owners = scratch.write(owned.join(able, "entity").select("text_key", "copies", "entity", F.col("context").alias("__c")), "owners")
    one = named.join(owners.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"])
    terms = one.select("text_key", F.explode("terms").alias("x")).select("text_key", "x.*").join(F.broadcast(common), "term_key", "left_anti")
    pairs = terms.join(owners, "text_key").groupBy("term_key", "entity", F.xxhash64("context", "__c").alias("context")).agg(F.sum("copies").alias("n_both"))
    both = pairs.groupBy("term_key", "entity").agg(F.sum("n_both").alias("n_both"), F.count("*").alias("n")).filter(F.col("n") >= MIN_CONTEXTS).drop("n")
    # terms with enough contexts near the entity, though of fewer texts, count over whole texts too
    supported = owned.join(support.select("entity").distinct(), "entity").select("text_key", "copies", "entity")
    own = named.join(supported.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"]).select("text_key", F.explode("terms.term_key").alias("term_key"))
    again = own.join(support, "term_key").join(supported, ["text_key", "entity"]).groupBy("term_key", "entity").agg(F.sum("copies").alias("n_both"))
    share = F.col("n_both") / F.col("n_term")
    telling = scratch.write(
        both.unionByName(again).join(n_term, "term_key").join(entities, "entity")
        .filter((share >= MIN_SHARE) & (F.log2(share * n_docs / F.col("n_entity")) >= MIN_BITS))
        .select("term_key").distinct(),
        "telling",
    )

    # kinds: the documents' shares first; the terms over them are few, and looked at in all their contexts
    n_kind = named.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n_kind"))
    by_kind = named.select(F.explode("terms.term_key").alias("term_key"), "kinds").groupBy("term_key", F.sort_array("kinds").alias("kinds")).count()
    by_kind = by_kind.select("term_key", "count", F.explode("kinds").alias("kind")).groupBy("term_key", "kind").agg(F.sum("count").alias("n_both")).filter(F.col("n_both") > KIND_ERRORS**2 * MIN_SHARE)
    suspects = scratch.write(
        by_kind.join(n_term, "term_key").join(F.broadcast(n_kind), "kind")  # a row for each kind
        .filter((share >= MIN_SHARE) & (F.log2(share * n_docs / F.col("n_kind")) >= KIND_BITS))
        .select("term_key", "kind"),
        "suspects",
    )
    if suspects.isEmpty():
        return telling
    seen = _places(docs, suspects.select("term_key").distinct(), most).groupBy("term_key", "context").agg(F.bit_or("kinds").alias("kinds"))
    has = F.when(F.col("kind") == len(KINDS), F.col("kinds") != 0).otherwise(F.getbit("kinds", F.col("kind")) == 1)
    sure = seen.join(suspects, "term_key").groupBy("term_key", "kind").agg(F.sum(has.cast("int")).alias("n"), F.count("*").alias("all"))
    sure = sure.filter(lower_share(F.col("n"), F.col("all"), KIND_ERRORS) >= MIN_SHARE).select("term_key")
    return scratch.write(telling.unionByName(sure).distinct(), "disclosing")


def _sent(telling: DataFrame, most: int) -> Broadcast | None:
    """The sorted keys for the executors, or None where they are more than ``most``."""
    if telling.count() > most:
        return None
    return telling.sparkSession.sparkContext.broadcast(np.sort(np.array([r.term_key for r in telling.collect()], np.int64)))


def all_spans(text: str, keys: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those of the terms whose keys (sorted) are given."""
    base = base_spans(text)
    if not len(keys):
        return base, base
    return base, sorted({*base, *((s, len(KINDS), e) for _, _, s, e in occurrences(text, base, among(keys)))})


def _span_column(spans: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in spans], _SPANS)


def _extra(docs: DataFrame, telling: DataFrame) -> DataFrame:
    """text_key and the spans of disclosing terms, matched by a join."""
    places = _places(docs, telling, 0).join(telling, "term_key")
    return places.groupBy("text_key").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("extra"))


def find(docs: DataFrame, most: int = TELLING_MOST) -> DataFrame:
    """doc_id, text_key, base and spans of every whole text, one row per row of docs.

    base holds the pattern matches as (start, kind, end) in code points, ends
    exclusive; spans adds each occurrence of a disclosing term as kind
    ``len(KINDS)``. A null text has none. Repeated rows get the same spans. No
    other column is read. Up to ``most`` disclosing terms are looked up in the
    tasks, more are joined. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    telling = telling_terms(docs, scratch, most)
    shared = _sent(telling, most)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value if shared else np.empty(0, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [all_spans(t, keys) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_128_digest(t.encode()) for t in texts], pa.binary()), _span_column([b for b, _ in found]), _span_column([x for _, x in found])],
                ["doc_id", "text_key", "base", "spans"],
            )

    out = narrow.mapInArrow(run, f"doc_id long, text_key binary, base {_SPAN_LIST}, spans {_SPAN_LIST}")
    if shared is None:
        joined = out.join(_extra(docs, telling), "text_key", "left")
        out = joined.select("doc_id", "text_key", "base", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(_SPAN_LIST)))).alias("spans"))
        return scratch.close(out)
    scratch.drop(*list(scratch.paths))
    return out


def replaced(text: str, spans: list) -> str:
    """The text with each span generalised to the name of its kind; overlapping spans become one."""
    names = [*(k.upper() for k in KINDS), "TERM"]
    out, at = [], 0
    for start, kind, end in sorted(tuple(s) for s in spans):
        if start >= at:
            out += [text[at:start], f"[{names[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, most: int = TELLING_MOST) -> DataFrame:
    """docs with personal data in text replaced by the name of its kind; rows and columns stay.

    A null text stays null; repeated rows stay, with the same text each; an empty
    table gives an empty table. Only texts go to Python, and no row is shuffled, unless more than ``most`` terms disclose.
    """
    scratch = Scratch(docs.sparkSession, "pii-sanitise")
    telling = telling_terms(docs, scratch, most)
    shared = _sent(telling, most)
    names = docs.columns
    if shared is not None:

        @F.arrow_udf(T.StringType())
        def clean(texts: pa.Array) -> pa.Array:
            out = pa.array([t if t is None else replaced(t, all_spans(t, shared.value)[1]) for t in texts.to_pylist()], pa.string())
            give_back()
            return out

        scratch.drop(*list(scratch.paths))
        return docs.select(*[clean.asNondeterministic()("text").alias("text") if n == "text" else F.col(n) for n in names])
    extra = scratch.write(_extra(docs, telling), "extra").toDF("__text_key", "__extra")
    keyed = docs.withColumn("__key", _content_key("text")).join(extra, F.col("__key") == F.col("__text_key"), "left")
    return keyed.select(*[_replace.asNondeterministic()("text", "__extra").alias("text") if n == "text" else F.col(n) for n in names])


@F.arrow_udf(T.BinaryType())
def _content_key(texts: pa.Array) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest((t or "").encode()) for t in texts.to_pylist()], pa.binary())


@F.arrow_udf(T.StringType())
def _replace(texts: pa.Array, extra: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), extra.to_pylist(), strict=True)
    return pa.array([t if t is None else replaced(t, [*base_spans(t), *((s["start"], s["kind"], s["end"]) for s in x or ())]) for t, x in rows], pa.string())

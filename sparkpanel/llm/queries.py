"""Queries of the corpus operators, and SQL for those that it can express.

The others are tested in tests/llm against brute force, an exact round trip or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classlm, decontaminate, embedding, html, infill, langid, linededup, minhash, pii, quality, resampling, substring

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _hex(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", _hex(F.col("text")).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(_read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    net = langid.train(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), net)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER).drop("text")
    return bpe.decode(ids, TOKENIZER).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _hex(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        _hex(F.col("decoded")).alias("decoded_sha256"),
    )


def _span_list(spans: str) -> F.Column:
    kinds = F.array(*[F.lit(k) for k in (*pii.KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_of(kind: int) -> F.Column:
    """How many base spans are of a kind. (A second argument of the lambda would be the span's position.)"""
    return F.size(F.filter("base", lambda s: s["kind"] == F.lit(kind))).cast("long")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents"))
    counts = [_count_of(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, _hex(_span_list("base")).alias("base_sha256"), _span_list("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.deduplicate(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", _hex(F.col("text")).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.restore(infill.transform(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _hex(F.col("output")).alias("output_sha256"), _hex(F.col("restored")).alias("restored_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash, op2_substring, op3_quality, op4_class_lm, op5_decontamination, op6_html, op7_embedding, op8_language, op9_bpe, op10_pii, op11_line_dedup, op12_fill_in_middle, op13_importance_resampling,
    )
}

#: White space of the contracts, in SQL.
_SPACE = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_HASHED = "('0x'||substr(h,{at},8))::BIGINT"

ORACLE: dict[str, str] = {
    "op11_line_dedup": f"""WITH l AS (SELECT doc_id, string_split(coalesce(text,''),chr(10)) AS a FROM documents), e AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a,1) AS place FROM l),
 k AS (SELECT *, translate(trim(line,{_SPACE}),'{linededup.UPPER}','{linededup.LOWER}') AS key FROM e), s AS (SELECT key AS shared FROM k WHERE length(key)>=1 GROUP BY 1 HAVING count(DISTINCT doc_id)>=10)
 SELECT doc_id, count(*) AS n_lines, count(shared) AS n_dropped, sha256(coalesce(string_agg(line,chr(10) ORDER BY place) FILTER (shared IS NULL),'')) AS kept_sha256 FROM k LEFT JOIN s ON key=shared GROUP BY 1""",
    "op12_fill_in_middle": f"""WITH d AS (SELECT doc_id, coalesce(text,'') AS t, sha256('42:'||doc_id) AS h FROM documents), k AS (SELECT *, regexp_extract_all(t,'[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS a,
 {_HASHED.format(at=1)} AS h1, {_HASHED.format(at=9)} AS h2, {_HASHED.format(at=17)} AS h3, {_HASHED.format(at=25)} AS h4 FROM d),
 c AS (SELECT *, len(a) AS n, least(h1%(len(a)+1),h2%(len(a)+1)) AS i, greatest(h1%(len(a)+1),h2%(len(a)+1)) AS j, CASE WHEN t='' OR contains(t,'<P>') OR contains(t,'<S>') OR contains(t,'<M>') OR h3%100>=50 THEN 'plain' WHEN h4%100<80 THEN 'spm' ELSE 'psm' END AS form FROM k),
 p AS (SELECT *, array_to_string(a[1:i],'') AS prefix, array_to_string(a[i+1:j],'') AS middle, array_to_string(a[j+1:n],'') AS suffix FROM c)
 SELECT doc_id, n, form, CASE WHEN form<>'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form<>'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>'||prefix||'<S>'||suffix||'<M>'||middle ELSE '<S>'||suffix||'<P>'||prefix||'<M>'||middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}

"""A training-corpus pipeline over ``documents``: five stages, each on all that its predecessor kept.

Each stage's rows are written as Parquet in the shared folder and read again, so
a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.llm import bpe, decontaminate, langid, minhash, pii
from sparkpanel.llm.common import materialize, without_ids
from sparkpanel.llm.queries import TOKENIZER


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without any letter or text (null too) go. Repeated rows stay or go together; an empty table stays empty."""
    net = langid.train(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    return langid.predict(docs, net).filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates.

    Rows without a text or id, and empty texts, are in no group and stay. Rows of one id stay or go
    together. An empty table stays empty.
    """
    return without_ids(docs, minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct())


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null and empty texts hold none; repeated rows stay or go together; an empty table stays empty."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it generalised; n_chars follows. A null text stays null with a null n_chars; repeated rows stay; an empty table stays empty."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text they decode to. A null text has no ids and decodes to an empty one; repeated rows stay; an empty table stays empty."""
    # written in between, so that a task needs one Python worker at a time
    ids, _ = materialize(bpe.encode(docs, TOKENIZER).select("doc_id", "lang", "source", "ids"), "pipeline-ids")
    return bpe.decode(ids, TOKENIZER).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", keep_known_languages),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", remove_personal_data),
    ("bpe", encode_and_decode),
]

#: None of the stages can be expressed in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

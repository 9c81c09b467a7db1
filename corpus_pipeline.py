"""Corpus pipeline over `documents`: toxicity, near-duplicates, decontamination, personal data, encoding.

Every stage takes all rows that its predecessor kept and applies one operator of
`veritab.llm`.  All but the last return the columns of `documents`; where a stage
changes a text, `n_chars` follows it.  NULL texts stay NULL until they are encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import fmindex, jaccardjoin, pii, toxicity
from veritab.llm.queries import bpe_digests, load, remainder
from veritab.session import scratch_folder

#: No SQL: a trained network, linked shingle sets and a tokenizer are no SQL expressions; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores under 0.5; learned from the label rows that operator 6 may use."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: of equal words, or linked by a five-word Jaccard similarity of 0.8 or more."""
    return jaccardjoin.keep_first(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words inside benchmark windows; clean texts stay as they are."""
    return _measured(fmindex.decontaminate(docs, load(spark, sf_dir, "benchmark")))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, disguised or not, replaced by its kind."""
    return _measured(pii.redact(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_copies),
    ("benchmark_decontamination", cut_benchmark),
    ("pii", mask_personal),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # later stages read a result more than once; a table in the shared folder is made once
        folder = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)

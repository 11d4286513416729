"""From documents to token ids: filter, deduplicate, redact, mix, encode.

Every stage takes the documents that the one before it wrote and decides for all of
them. All but the last return the columns they are given, whatever their names; the
last returns ``doc_id``, ``tokens``, ``n_tokens`` and ``exact``.

Defined results: a document without text, or with an empty one, goes through every
stage (it isn't toxic, nobody's copy, has no secret, costs nothing and has null
tokens, or none); a null id is nobody's copy and is kept; a null source is a source
of its own; rows that share an id are one document to the second stage, and otherwise
are treated each; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.llm import bpe, minhash, mixing, secret_scan, toxicity
from trestle.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic; it is fitted on the labelled rows of ``sf_dir``.

    Without labels, and without text, nothing is toxic.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id; without id or words it stays."""
    return minhash.without_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced, and ``n_chars`` to match (null for a null text)."""
    names = docs.columns
    clean = docs.withColumn("text", secret_scan.redacted(spark, F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks; each at least once."""
    return mixing.mix(docs, copy_col=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; null for a null text."""
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash", drop_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: models, signatures and token merges have no SQL; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs

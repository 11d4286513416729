"""Queries of this subpackage over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, minhash, mixing, quality_model, quality_rules, secret_scan, topk, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and whether it passes all quality rules."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with secrets: rule, number and hash of the first."""
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op3_warc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of the deduplicated archive that is written."""
    return warc.deduplicated(table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", F.col("_copy").alias("copy"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its language."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has a near copy, its class and number of links."""
    return minhash.classes(table(spark, sf_dir, "documents"))


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its probability of each category."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its quality score."""
    return quality_model.score(table(spark, sf_dir, "documents"))


def op9_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    return topk.nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc_dedup": op3_warc_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_language_id": op5_language_id,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_toxicity_chain": op7_toxicity_chain,
    "op8_quality_model": op8_quality_model,
    "op9_bpe_encode": op9_bpe_encode,
    "op10_exact_topk": op10_exact_topk,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.oracle(),
    "op2_secret_scan": secret_scan.oracle(),
    "op3_warc_dedup": warc.oracle(),
    "op4_source_mixing": mixing.oracle(),
    "op10_exact_topk": topk.oracle(),
}

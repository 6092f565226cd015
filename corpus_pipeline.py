"""The corpus pipeline: ``run`` applies STAGES, in order, to the documents table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm import bpe, decontaminate, langid, pii, simhash
from maskweave.llm.common import read, unused
from maskweave.llm.queries import VOCABULARY, language_model
from maskweave.session import shared_dir, ship_package

# A document whose best language has no more than this share of the likelihood is rejected.
MIN_LANGUAGE_SCORE = 0.5


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or in no language more than in the others, go."""
    ship_package(spark)
    found = unused(docs, "__lang")
    rows = langid.identify(docs, language_model(spark, docs), out=found)
    sure = (F.col(f"{found}.lang") != langid.UNDETERMINED) & (
        F.col(f"{found}.score") >= MIN_LANGUAGE_SCORE
    )
    return rows.where(sure).drop(found)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash: of every group of linked documents the one with the smallest id stays."""
    ship_package(spark)
    return simhash.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold a benchmark passage go."""
    ship_package(spark)
    return decontaminate.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: spans are replaced by their kind in brackets; n_chars follows the text."""
    ship_package(spark)
    weights = pii.fit(pii.with_candidates(docs.select("text")))
    return pii.redacted(docs, weights).withColumn("n_chars", F.length("text").cast("bigint"))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: every document left, with its token ids, their number, and whether decoding
    them gives the text back."""
    ship_package(spark)
    vocab = bpe.vocabulary(spark, public_tokenizers.path(VOCABULARY))
    return bpe.with_round_trip(docs, vocab, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", keep_identified),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("byte_bpe", encode_documents),
]

# Segmentation sums, fingerprints, alignments and BPE merges are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each stage's rows are written and read again.

    Null and empty texts go at the first stage, repeated rows at the second; an empty table gives
    an empty result.  The columns are those of documents and those the last stage adds.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

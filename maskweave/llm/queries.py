"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm import (
    bpe,
    decontaminate,
    langid,
    oracle,
    pii,
    prefix_trie,
    sentence_spans,
    simhash,
    suffix_runs,
    token_rollup,
    toxicity,
    url_filter,
    vector_codes,
    vptree,
)
from maskweave.llm.common import fold, held_out, read
from maskweave.session import shared_dir

VOCABULARY = "byte_bpe_50k.tiktoken"
NEW_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage found in a document: doc_id, item_id, start, end, edits."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def language_model(spark: SparkSession, docs: DataFrame) -> Broadcast:
    words = langid.labelled_words(docs, fold() != 1)
    model = langid.fit(words, langid.vocabulary_pieces(public_tokenizers.path(PIECES)))
    return spark.sparkContext.broadcast(model)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), language_model(spark, docs), out="found")
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = bpe.vocabulary(spark, public_tokenizers.path(VOCABULARY))
    return bpe.digest(read(spark, sf_dir, "documents"), vocab, public_tokenizers.PATTERN)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def token_changes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A change feed over the whole table, with the batch each change belongs to.

    Batches 1 to 4 insert every document, counted by the first tokenizer version.  Batch 5 revises
    the French ones to counts by the second version.  Batch 6 deletes every twentieth document, as
    it is counted by then.
    """
    first, second = (
        bpe.vocabulary(spark, public_tokenizers.path(v)) for v in (VOCABULARY, NEW_VOCABULARY)
    )
    pattern = public_tokenizers.PATTERN
    french = F.coalesce(F.col("lang") == "fr", F.lit(False))
    counted = docs.select(
        "source",
        "lang",
        french.alias("revised"),
        F.coalesce(F.pmod("doc_id", F.lit(20)) == 0, F.lit(False)).alias("gone"),
        (F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)), F.lit(4)) + 1).alias("arrival"),
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"),
        bpe.token_counts(F.col("text"), first, pattern).alias("n_first"),
        bpe.token_counts(F.when(french, F.col("text")), second, pattern).alias("n_second"),
    )

    def change(batch, sign: int, version, tokens, when) -> Column:
        row = F.struct(
            batch.cast("bigint").alias("batch"),
            version.alias("tokenizer"),
            F.lit(sign).cast("bigint").alias("n_docs"),
            (F.lit(sign) * tokens).cast("bigint").alias("n_tokens"),
            (F.lit(sign) * F.col("n_chars")).cast("bigint").alias("n_chars"),
        )
        return F.when(when, row)

    old, new = F.lit(VOCABULARY), F.lit(NEW_VOCABULARY)
    changes = F.array(
        change(F.col("arrival"), 1, old, F.col("n_first"), F.lit(True)),
        change(F.lit(5), -1, old, F.col("n_first"), F.col("revised")),
        change(F.lit(5), 1, new, F.col("n_second"), F.col("revised")),
        change(
            F.lit(6),
            -1,
            F.when(F.col("revised"), new).otherwise(old),
            F.when(F.col("revised"), F.col("n_second")).otherwise(F.col("n_first")),
            F.col("gone"),
        ),
    )
    return counted.select("source", "lang", F.inline(F.filter(changes, lambda c: c.isNotNull())))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after six batches; the sums of batch 2 are committed again, and folded in between."""
    ledger = token_rollup.Ledger(spark, f"{shared_dir(spark)}/token-ledger-{uuid.uuid4().hex}")
    changes = token_changes(spark, read(spark, sf_dir, "documents"))
    ledger.commit_all(changes, [1, 2, 3, 4, 5, 6])
    again = ledger.batch(2)
    ledger.commit(2, again)
    ledger.compact()
    ledger.commit(2, again)
    return ledger.totals()


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that loses a sentence: counts, sentence numbers, remaining text."""
    return sentence_spans.deduplicated(read(spark, sf_dir, "documents"))


def op7_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_runs.digest(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read(spark, sf_dir, "documents"))


def op9_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.digest(read(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.sample(docs, read(spark, sf_dir, "labels"), fold() != 1))
    scored = toxicity.scored(docs.select("doc_id", "text"), spark.sparkContext.broadcast(model))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


# Fixed values: (host, path, verdict) of the rules, and the sites whose urls the query lists.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
LISTED_SITES = r"(^|\.)(spam-farm|cheap-pills|casino-win)\.example\.(com|net|org)$"


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules; the list holds each url that pages has of the listed sites."""
    pages = read(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    host, _ = url_filter.host_and_path(F.col("url"))
    listed = pages.select("url").where(host.rlike(LISTED_SITES))
    return url_filter.judged(pages, rules, listed)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(read(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_pii": op4_pii,
    "op5_token_counts": op5_token_counts,
    "op6_sentence_spans": op6_sentence_spans,
    "op7_suffix_runs": op7_suffix_runs,
    "op8_simhash": op8_simhash,
    "op9_vptree": op9_vptree,
    "op10_toxicity": op10_toxicity,
    "op11_url_filter": op11_url_filter,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

# Learned models, merges and alignments are not SQL.
ORACLE: dict[str, str] = {
    "op11_url_filter": oracle.url_verdicts(URL_RULES, LISTED_SITES),
    "op12_vector_codes": oracle.vector_codes(),
    "op13_prefix_trie": oracle.prefix_trie(),
}

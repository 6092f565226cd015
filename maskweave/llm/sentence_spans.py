"""Substring dedup by sliding spans of sentences.

A text is cut into sentences (after ., ! or ? before white space, and at line ends).  From every
sentence a span starts that takes in following sentences until it has at least ``MIN_SENTENCES``
sentences and ``MIN_WORDS`` words.  Two neighbouring sentences of ``PAIR_WORDS`` words together are
a span as well, and so is a single one of ``ALONE_WORDS``.  What a span is depends on its own words
only, so equal passages give equal spans wherever they stand.  Spans are hashed to 128 bits and
counted over the whole table; of equal spans the first (smallest id, then row, then place) stays,
and every sentence covered by another one is removed.  A repeat that is only part of a sentence is
no span.

Spans are narrow rows: hashes are combined before the shuffle that counts them, and met again
through a join against unique keys, which Spark may split for a passage that a third of all rows
share.  Only texts that lose something are read again.

Defined results: null and empty texts have no sentence and lose nothing; shorter texts than any
span lose nothing; a repeated row counts as a later copy; a null id comes after all others; the
query returns the rows that lose something; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.session import staged

MIN_SENTENCES = 3
MIN_WORDS = 12
# Words from which two sentences, or one, are a span of their own.
PAIR_WORDS = 25
ALONE_WORDS = 50
_END = r"(?<=[.!?])\s+|\n\s*"


def sentences(text: Column) -> Column:
    """Non-empty sentences of a text, trimmed, in order."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), _END, -1), lambda s: F.trim(s))
    return F.filter(cut, lambda s: s != "")


def spans(
    docs: DataFrame,
    min_sentences: int = MIN_SENTENCES,
    min_words: int = MIN_WORDS,
    pair_words: int = PAIR_WORDS,
    alone_words: int = ALONE_WORDS,
) -> DataFrame:
    """(h1, h2, doc_id, row, first, last): the spans of every row of (doc_id, row, text).

    A span whose sentences are all covered by shorter spans within it is left out: where it is
    repeated they are too, and where it is not the first of its kind neither are they.
    """
    told = docs.select("doc_id", "row", F.explode(F.array(sentences(F.col("text")))).alias("all"))
    told = told.where(F.size("all") > 0)
    counted = told.select(
        "doc_id",
        "row",
        F.transform(
            "all",
            lambda s: F.struct(
                F.xxhash64(F.lit(1), s).alias("a"),
                F.xxhash64(F.lit(2), s).alias("b"),
                F.size(F.split(s, r"\s+")).alias("words"),
            ),
        ).alias("all"),
    )
    # A span is looked for among the next few sentences; it never needs more than one of
    # min_words sentences, since each has a word.
    most = max(min_sentences, min_words)
    # ``apart``: two neighbours within the span are no span, so it is needed beside the pairs.
    grown = f"""aggregate(slice(all, i, {most}),
      struct(0 AS n, 0 AS words, 0 AS prior, false AS apart, 0L AS a, 0L AS b),
      (acc, s) -> CASE WHEN acc.n >= {min_sentences} AND acc.words >= {min_words} THEN acc
        ELSE struct(acc.n + 1 AS n, acc.words + s.words AS words, s.words AS prior,
          acc.apart OR (acc.n > 0 AND acc.prior + s.words < {pair_words}) AS apart,
          xxhash64(acc.a, s.a) AS a, xxhash64(acc.b, s.b) AS b) END)"""
    span = "struct(i - 1 AS first, {n} AS n, {a} AS a, {b} AS b)"
    long = f"""transform(filter(array({grown}), g -> g.n >= {min_sentences} AND g.words >= {min_words}
        AND (g.apart OR g.n = 1)), g -> {span.format(n="g.n", a="g.a", b="g.b")})"""
    one, two = "all[i - 1]", "get(all, i)"
    hashes = {h: f"xxhash64(0L, {one}.{h})" for h in "ab"}
    alone = f"""CASE WHEN {one}.words >= {alone_words}
      THEN array({span.format(n=1, **hashes)}) END"""
    hashes = {h: f"xxhash64({hashes[h]}, {two}.{h})" for h in "ab"}
    pair = f"""CASE WHEN {one}.words + {two}.words >= {pair_words}
        AND least({one}.words, {two}.words) < {alone_words}
      THEN array({span.format(n=2, **hashes)}) END"""
    window = F.expr(
        f"""flatten(filter(flatten(transform(sequence(1, size(all)),
          i -> array({long}, {pair}, {alone}))), x -> x IS NOT NULL))"""
    )
    each = counted.select("doc_id", "row", F.explode(window).alias("x"))
    return each.select(
        F.col("x.a").alias("h1"),
        F.col("x.b").alias("h2"),
        "doc_id",
        "row",
        F.col("x.first").alias("first"),
        (F.col("x.first") + F.col("x.n") - 1).alias("last"),
    )


def removals(found: DataFrame) -> DataFrame:
    """(row, gone): sentence numbers covered by a span that is not the first of its kind."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "first")
    repeated = (
        found.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min(order).alias("head"))
        .where("n > 1")
        .select("h1", "h2", F.col("head.row").alias("head_row"), F.col("head.first").alias("head_first"))
    )
    # Written first: Spark splits a hot span's rows only where both sides of the join are plain
    # exchanges.
    repeated = staged(repeated, "repeated-spans")
    later = found.join(repeated, ["h1", "h2"]).where(
        (F.col("row") != F.col("head_row")) | (F.col("first") != F.col("head_first"))
    )
    # One group per row of the table: bounded by the spans of one text.
    return later.groupBy("row").agg(
        F.array_sort(
            F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last"))))
        ).alias("gone")
    )


def deduplicated(docs: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, text) of every row that loses a sentence.

    ``removed`` holds the sentence numbers, ``text`` the remaining sentences, one per line.
    """
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    gone = removals(staged(spans(rows, **limits), "sentence-spans"))
    left = rows.join(gone, "row").withColumn("all", sentences(F.col("text")))
    kept = F.expr("transform(array_except(sequence(0, size(all) - 1), gone), i -> all[i])")
    return left.select(
        "doc_id",
        F.size("all").cast("bigint").alias("n_sentences"),
        F.size("gone").cast("bigint").alias("n_removed"),
        F.col("gone").alias("removed"),
        F.array_join(kept, "\n").alias("text"),
    )

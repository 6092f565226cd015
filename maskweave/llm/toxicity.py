"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are present or absent: its words (runs of letters, lower case), pairs of
neighbours, and pairs with one word between, hashed into a fixed number of buckets.  Every bucket
has its own learning rate, and the L1 term keeps most weights at exactly zero, so the model is a
short list that is safe to broadcast.  It is learned in a stream over a bounded sample of the
labelled rows, in an order given by a hash of the id.

Defined results: a null or empty text has no feature but the constant and gets the base score;
rows with a null id or null label teach nothing, several labels of one id count as the highest;
of the document rows of one id the first text by value is learned from; without labelled rows every score is 0.5; very long
texts are read whole; extra columns pass through ``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import Numbering, chunked

BUCKETS = 1 << 20
# Labelled rows the model is fitted on, at most.
SAMPLE_ROWS = 30_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.0
THRESHOLD = 0.7
# Distinct words remembered within a task.
MEMO_WORDS = 300_000

_letters = regex.compile(r"\p{L}+").findall
_PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_ONE, _LEFT, _RIGHT, _SKIP = (np.uint64(p) for p in _PRIMES)


class Features:
    """Hashed features of many texts at once; each distinct word is hashed once."""

    def __init__(self):
        self.numbers = Numbering()
        self.hashes = np.empty(0, np.uint64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, bucket) of every feature occurrence; bucket 0 is the constant."""
        if len(self.numbers) > MEMO_WORDS:
            self.numbers.restart()
            self.hashes = self.hashes[:0]
        counts = np.empty(len(texts), np.int64)
        seen: list[int] = []
        number = self.numbers.__getitem__
        for k, t in enumerate(texts):
            words = _letters(t.lower())
            counts[k] = len(words)
            seen.extend(map(number, words))
        fresh, self.numbers.fresh = self.numbers.fresh, []
        new = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in fresh), np.uint64, len(fresh))
        self.hashes = np.concatenate((self.hashes, new))
        h = self.hashes[np.array(seen, np.int64)]
        doc = np.repeat(np.arange(len(texts)), counts)
        docs, features = [np.arange(len(texts)), doc], [np.zeros(len(texts), np.int64), _bucket(h * _ONE)]
        for gap, right in ((1, _RIGHT), (2, _SKIP)):
            same = np.flatnonzero(doc[gap:] == doc[:-gap]) if len(doc) > gap else np.empty(0, np.int64)
            docs.append(doc[same])
            features.append(_bucket(h[same] * _LEFT + h[same + gap] * right))
        return np.concatenate(docs), np.concatenate(features)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ONE
    return ((h >> np.uint64(33)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


class Ftrl:
    """FTRL-proximal: lazily computed weights from the sums z and n of each coordinate."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        slack = np.maximum(np.abs(z) - self.l1, 0.0)
        return -np.sign(z) * slack / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One row: ``at`` are its distinct buckets."""
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def sample(docs: DataFrame, labels: DataFrame, train: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y) to learn from: at most ``rows`` rows, one for each labelled id, chosen by a hash.

    Of an id that several documents have, the first text by value is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & train)
    one = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    drawn = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` ids and labels are broadcast, so no text is shuffled for the join.  The texts are then
    # combined on the map side, so an id with a large share of all rows does not travel either.
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit(rows: DataFrame, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of the non-zero weights learned from (doc_id, text, y)."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Features()
        for b in batches:
            at = 0
            for texts in chunked(pa.array(b["text"], pa.string())):
                doc, bucket = found(texts)
                pairs = np.unique(doc * BUCKETS + bucket)
                cuts = np.searchsorted(pairs, np.arange(1, len(texts)) * BUCKETS)
                part = b.iloc[at : at + len(texts)]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "y": part["y"].to_numpy(),
                        "at": [p % BUCKETS for p in np.split(pairs, cuts)],
                    }
                )
                at += len(texts)

    id_type = dict(rows.dtypes)["doc_id"]
    hashed = rows.mapInPandas(features, f"doc_id {id_type}, y int, at array<int>")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Ftrl()
        for b in batches:
            for y, at in zip(b["y"], b["at"]):
                model.learn(np.asarray(at, np.int64), int(y))
        weights = model.weights(slice(None))
        kept = np.flatnonzero(weights)
        yield pd.DataFrame({"bucket": kept, "weight": weights[kept]})

    # The sample is bounded, so one task may stream through it, once for every epoch.
    stream = (
        hashed.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        .repartition(1)
        .sortWithinPartitions("epoch", F.xxhash64("doc_id"), "doc_id")
        .select("y", "at")
    )
    found = stream.mapInPandas(learn, "bucket bigint, weight double").toPandas()  # <= BUCKETS rows
    return found["bucket"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)


def scores(text: Column, model: Broadcast) -> Column:
    """Probability that each text is toxic."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets, weights = model.value
        dense = np.zeros(BUCKETS)
        dense[buckets] = weights
        found = Features()
        for batch in batches:
            out = [np.empty(0)]
            for texts in chunked(batch):
                doc, bucket = found(texts)
                felt = np.flatnonzero(dense[bucket])
                pairs = np.unique(doc[felt] * BUCKETS + bucket[felt])
                total = np.bincount(pairs // BUCKETS, dense[pairs % BUCKETS], len(texts))
                out.append(_sigmoid(total))
            yield pa.array(np.concatenate(out), pa.float64())

    return score(text)


def scored(df: DataFrame, model: Broadcast, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the score of ``text``; a column of that name is replaced."""
    return df.withColumn(out, scores(F.col(text), model))

"""Language identification by unigram pieces, summed over every segmentation.

The pieces are those of a fixed public vocabulary; each language has its own piece
probabilities.  The probability of a word is the sum, by the forward algorithm, over all ways of
cutting it into pieces, and a text's is the product over its words (runs of letters, lower case,
the first piece carrying the word mark).  The probabilities come from expectation-maximisation:
expected piece counts (forward times backward) over the words of a bounded sample of labelled
rows, summed by Spark in each round; no more than pieces x languages numbers reach the driver.

Defined results: a text that is null or has no letter is ``und`` with score 0; otherwise the
score is the winning language's share of the total likelihood, prior shares equal, and equal
likelihoods go to the language first in the alphabet.  Rows with a null id, null text or null
language train nothing.  Without any labelled row every text is ``und``.  Characters outside the
vocabulary have the same small probability in every language.  Words of any length are summed
whole.  Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm.common import Numbering, chunked
from maskweave.session import staged

WORD_MARK = "▁"
UNDETERMINED = "und"
# Labelled documents per language the model is fitted on (expected number; chosen by hash of id).
SAMPLE_DOCS = 2500
EM_ROUNDS = 3
# Added to every expected count.
SMOOTHING = 0.05
# Probability of a character that no piece covers, in every language.
UNKNOWN = 1e-7
# Distinct words remembered within a task.
MEMO_WORDS = 200_000
# More languages than this are refused, so the broadcast model is bounded.
MAX_LANGUAGES = 512

_BASE = np.uint64(0x9E3779B97F4A7C15)
_letters = regex.compile(r"\p{L}+").findall


def words_of(text: str) -> list[str]:
    return _letters(text.lower())


def vocabulary_pieces(path: str) -> list[str]:
    """Text pieces of a sentencepiece model; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    return [
        model.id_to_piece(i)
        for i in ids
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))
    ]


def _mixed(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h + code + np.uint64(1)) * _BASE
    return h ^ (h >> np.uint64(29))


class Pieces:
    """Finds the vocabulary pieces at every position of many words at once."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        hashes = np.empty(len(pieces), np.uint64)
        with np.errstate(over="ignore"):
            for k, p in enumerate(pieces):
                h = np.zeros(1, np.uint64)
                for c in p:
                    h = _mixed(h, np.array([ord(c)], np.uint64))
                hashes[k] = h[0]
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.ids = order.astype(np.int64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")

    def lengths_matrix(self, words: list[str]) -> np.ndarray:
        """Code points of words of one length, each after the word mark: (words, length)."""
        flat = "".join(WORD_MARK + w for w in words)
        return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)

    def arcs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, stop, rows, piece ids): the words that have a piece at start..stop."""
        length = codes.shape[1]
        wide = codes.astype(np.uint64)
        with np.errstate(over="ignore"):
            for i in range(length):
                h = np.zeros(len(codes), np.uint64)
                for j in range(i, min(length, i + self.longest)):
                    h = _mixed(h, wide[:, j])
                    at = np.searchsorted(self.hashes, h)
                    at[at == self.size] = 0
                    rows = np.flatnonzero(self.hashes[at] == h)
                    yield i, j + 1, rows, self.ids[at[rows]]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        step = max(1, 400_000 // (int(n) + 1))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            yield part, [words[k] for k in part]


def log_forward(pieces: Pieces, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """log of the summed probability of each word in each language: (words, languages).

    ``prob`` is (pieces, languages).  Sums are rescaled on the way, so no word is too long.
    """
    out = np.zeros((len(words), prob.shape[1]))
    for rows, group in _by_length(words):
        codes = pieces.lengths_matrix(group)
        n, length = codes.shape
        alpha = np.zeros((length + 1, n, prob.shape[1]))
        alpha[0] = 1.0
        scale = np.zeros((n, prob.shape[1]))
        done = 0
        for i, j, hit, ids in pieces.arcs(codes):
            if i > done:
                done = i
                if i % 16 == 0:
                    top = alpha[max(0, i - 1) : i + pieces.longest].max(axis=0)
                    alpha[i : i + pieces.longest] /= top
                    scale += np.log(top)
            if j == i + 1:
                alpha[j] += alpha[i] * UNKNOWN
            alpha[j, hit] += alpha[i, hit] * prob[ids]
        out[rows] = np.log(alpha[length]) + scale
    return out


def expected_counts(
    pieces: Pieces, prob: np.ndarray, words: list[str], langs: np.ndarray, weights: np.ndarray
) -> np.ndarray:
    """Expected uses of each piece by each language over weighted words: (pieces, languages)."""
    out = np.zeros(prob.shape)
    flat = out.reshape(-1)
    n_langs = prob.shape[1]
    for rows, group in _by_length(words):
        codes = pieces.lengths_matrix(group)
        n, length = codes.shape
        if length > 200:  # sums of longer words could vanish; they would teach nothing
            continue
        own, w = langs[rows], weights[rows]
        arcs = [(i, j, hit, ids, prob[ids, own[hit]]) for i, j, hit, ids in pieces.arcs(codes)]
        alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
        alpha[0] = beta[length] = 1.0
        for i, j, hit, _, p in arcs:
            if j == i + 1:
                alpha[j] += alpha[i] * UNKNOWN
            alpha[j, hit] += alpha[i, hit] * p
        for i, j, hit, _, p in reversed(arcs):
            if j == i + 1:
                beta[i] += beta[j] * UNKNOWN
            beta[i, hit] += beta[j, hit] * p
        total = np.where(alpha[length] > 0, alpha[length], 1.0)
        for i, j, hit, ids, p in arcs:
            share = alpha[i, hit] * p * beta[j, hit] / total[hit] * w[hit]
            np.add.at(flat, ids * n_langs + own[hit], share)
    return out


def labelled_words(docs: DataFrame, train: Column, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, word, n) over the sample of rows to learn from."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return docs.sparkSession.createDataFrame([], "lang string, word string, n bigint")
    share = F.create_map(*[F.lit(x) for s in sizes for x in (s["lang"], min(1.0, sample_docs / s["count"]))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        for b in batches:
            tally: Counter = Counter()
            for lang, text in zip(b["lang"], b["text"]):
                tally.update((lang, w) for w in words_of(text))
            yield pd.DataFrame(
                [(lang, w, n) for (lang, w), n in tally.items()], columns=["lang", "word", "n"]
            )

    counted = drawn.select("lang", "text").mapInPandas(count, "lang string, word string, n bigint")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages and their piece probabilities, (pieces, languages)."""

    def __init__(self, pieces: list[str], langs: list[str], prob: np.ndarray):
        self.pieces, self.langs, self.prob = pieces, langs, prob

    def start(self) -> "Scorer":
        return Scorer(Pieces(self.pieces), self.prob)


class Scorer:
    """Log likelihoods of texts; each distinct word is summed once."""

    def __init__(self, pieces: Pieces, prob: np.ndarray):
        self.pieces, self.prob = pieces, prob
        self.numbers = Numbering()
        self.table = np.empty((0, prob.shape[1]))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood by language, number of words) of each text."""
        if len(self.numbers) > MEMO_WORDS:
            self.numbers.restart()
            self.table = self.table[:0]
        counts = np.empty(len(texts), np.int64)
        seen: list[int] = []
        number = self.numbers.__getitem__
        for k, t in enumerate(texts):
            words = words_of(t)
            counts[k] = len(words)
            seen.extend(map(number, words))
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if fresh:
            self.table = np.concatenate((self.table, log_forward(self.pieces, self.prob, fresh)))
        sums = np.zeros((len(texts), self.prob.shape[1]))
        full = np.flatnonzero(counts)
        if len(full):
            starts = (np.cumsum(counts) - counts)[full]
            sums[full] = np.add.reduceat(self.table[np.array(seen, np.int64)], starts, axis=0)
        return sums, counts


def fit(words: DataFrame, pieces: list[str], rounds: int = EM_ROUNDS) -> Model:
    """Piece probabilities by expectation-maximisation over (lang, word, n)."""
    spark: SparkSession = words.sparkSession
    words = staged(words, "langid-words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    v, k = len(pieces), len(langs)
    model = Model(pieces, langs, np.full((v, k), 1.0 / max(v, 1)))
    if not langs:
        return model
    position = {name: n for n, name in enumerate(langs)}
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = sent.value
            finder = Pieces(m.pieces)
            total = np.zeros(m.prob.shape)
            for b in batches:
                own = b["lang"].map(position).to_numpy(np.int64)
                total += expected_counts(
                    finder, m.prob, b["word"].tolist(), own, b["n"].to_numpy(np.float64)
                )
            at, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": at, "lang": lang, "uses": total[at, lang]})

        sums = (
            words.mapInPandas(expect, "piece bigint, lang bigint, uses double")
            .groupBy("piece", "lang")
            .agg(F.sum("uses").alias("uses"))
            .toPandas()  # at most pieces x languages rows
        )
        counts = np.full((v, k), SMOOTHING)
        counts[sums["piece"].to_numpy(np.int64), sums["lang"].to_numpy(np.int64)] += sums["uses"].to_numpy()
        model = Model(pieces, langs, counts / counts.sum(axis=0))
        sent.unpersist()
    return model


def identified(text: Column, model: Broadcast) -> Column:
    """struct(lang string, score double) of each text."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        scorer = m.start()
        names = np.array([*m.langs, UNDETERMINED], object)
        for batch in batches:
            best, score = [np.empty(0, np.int64)], [np.empty(0)]
            for texts in chunked(batch):
                sums, counts = scorer(texts)
                if not m.langs:
                    best.append(np.zeros(len(texts), np.int64))
                    score.append(np.zeros(len(texts)))
                    continue
                top = sums.argmax(axis=1)
                shares = np.exp(sums - sums.max(axis=1, keepdims=True))
                best.append(np.where(counts > 0, top, len(m.langs)))
                score.append(np.where(counts > 0, 1.0 / shares.sum(axis=1), 0.0))
            picked = names[np.concatenate(best)] if len(batch) else []
            yield pa.StructArray.from_arrays(
                [pa.array(list(picked), pa.string()), pa.array(np.concatenate(score), pa.float64())],
                ["lang", "score"],
            )

    return identify(text)


def identify(df: DataFrame, model: Broadcast, text: str = "text", out: str = "lang_found") -> DataFrame:
    """Add ``out``, struct(lang, score); a column of that name is replaced."""
    return df.withColumn(out, identified(F.col(text), model))

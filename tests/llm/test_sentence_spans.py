import random
import re

from pyspark.sql import functions as F

from maskweave.llm import sentence_spans as S
from tests.llm.conftest import prose


def plain(rows):
    """Ids that lose sentences and which, by comparing the spans' words themselves."""
    told = []
    for n, (doc_id, text) in enumerate(rows):
        cut = [s.strip(" ") for s in re.split(r"(?<=[.!?])\s+|\n\s*", text or "")]
        told.append((doc_id, n, [s for s in cut if s]))
    first, spans = {}, []
    for doc_id, n, sents in told:
        for i in range(len(sents)):
            j, words = i, 0
            while j < len(sents) and (j - i < S.MIN_SENTENCES or words < S.MIN_WORDS):
                words += len(sents[j].split())
                j += 1
            if j - i >= S.MIN_SENTENCES and words >= S.MIN_WORDS:
                key, at = tuple(sents[i:j]), (doc_id is None, doc_id or 0, n, i)
                spans.append((key, at, n, range(i, j)))
                first[key] = min(first.get(key, at), at)
    gone = {}
    for key, at, n, covered in spans:
        if at != first[key]:
            gone.setdefault(n, set()).update(covered)
    return [(told[n][0], len(told[n][2]), sorted(g), "\n".join(s for k, s in enumerate(told[n][2]) if k not in g)) for n, g in gone.items()]


def test_against_plain_spans(make_docs, awkward, nothing):
    shared = prose(77, 90)
    rows = [(n, prose(n, 60) + ". " + (shared if n % 2 else "") + " " + prose(n + 500, 30), "en", "s") for n in range(30)]
    rows += [(40, shared[: len(shared) // 2], "en", "s"), (41, "A. B. C. " * 30, "en", "s"), (3, rows[3][1], "en", "s")]
    docs = make_docs(rows).union(awkward).coalesce(1)
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = S.deduplicated(docs.withColumn("row", F.lit(7))).collect()
    assert sorted(((r["doc_id"], r["n_sentences"], r["removed"], r["text"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["n_removed"] == len(r["removed"]) for r in got)
    assert len(want) > 15
    assert S.deduplicated(nothing).collect() == []


def test_long_blank_runs_are_linear(make_docs):
    text = "One two three. " + " " * 200_000 + "x" + "\n" * 50_000 + "Four five."
    assert S.deduplicated(make_docs([text])).collect() == []


def words(seed, n):
    return " ".join(f"w{seed}x{k}" for k in range(n)) + "."


def plain_with_short_spans(texts):
    """Sentence numbers each text loses, with every span of every length."""
    seen, spans = {}, []
    for n, text in enumerate(texts):
        sents = [s for s in (x.strip(" ") for x in re.split(r"(?<=[.!?])\s+|\n\s*", text)) if s]
        for i in range(len(sents)):
            for j in range(i + 1, len(sents) + 1):
                size = sum(len(s.split()) for s in sents[i:j])
                before = size - len(sents[j - 1].split())
                grown = j - i >= 3 and size >= 12 and not (j - i > 3 and before >= 12)
                if grown or (j - i == 2 and size >= 25) or (j - i == 1 and size >= 50):
                    key = tuple(sents[i:j])
                    seen.setdefault(key, (n, i))
                    spans.append((key, n, range(i, j)))
    gone = {}
    for key, n, covered in spans:
        if seen[key] != (n, covered[0]):
            gone.setdefault(n, set()).update(covered)
    return {n: sorted(g) for n, g in gone.items()}


def test_repeats_in_one_or_two_long_sentences(make_docs):
    pair, alone = words("p", 26) + " " + words("q", 30), words("s", 60)
    texts = [f"{words(n, 5)} {pair} {words(n + 50, 6)} {alone} {words(n + 90, 4)}" for n in range(3)]
    texts += [alone, pair, words("p", 26), words("t", 49), words("t", 49), words("u", 12) + " " + words("v", 12)] * 2
    got = {r["doc_id"]: r["removed"] for r in S.deduplicated(make_docs(texts)).collect()}
    assert got == plain_with_short_spans(texts)
    assert got[1] == got[2] == [1, 2, 4] and got[3] == [0] and got[4] == [0, 1]
    assert 0 not in got and 5 not in got


def test_spans_left_out_change_nothing(make_docs):
    rng = random.Random(5)
    pool = [words(k, rng.choice([1, 3, 8, 12, 13, 20, 49, 50, 70])) for k in range(14)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    got = {r["doc_id"]: r["removed"] for r in S.deduplicated(make_docs(texts)).collect()}
    assert got == plain_with_short_spans(texts)
    assert len(got) > 50

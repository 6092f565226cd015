import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from maskweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.parse_ranks(open(PATH, "rb").read())
REFERENCE = tiktoken.Encoding(
    "t",
    pat_str=public_tokenizers.PATTERN,
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))},
    special_tokens={},
)


@pytest.mark.parametrize("leaf", [1, 2, 7, 64])
def test_tree_gives_the_library_s_tokens(leaf):
    rng = random.Random(leaf)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN, leaf)
    for _ in range(200):
        letters = rng.choice(["ab", "aethn ", "éàüß", "日本語中 ", "0123 ", "a\n \t!?.", "thening s'"])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([1, 20, 300])))
        assert codec.encode(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_001, "ab" * 9_999, " " * 5_000, "é" * 3_333, "!?" * 4_000])
def test_long_pieces(text):
    assert bpe.Codec(RANKS, public_tokenizers.PATTERN).encode(text) == REFERENCE.encode_ordinary(text)


def test_join_is_associative():
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    word = b"antidisestablishmentarianisms" * 4
    a, b, c = (codec._tree(word[i:j]) for i, j in ((0, 31), (31, 60), (60, len(word))))
    left = codec.join(codec.join(a, b), c)
    assert left == codec.join(a, codec.join(b, c)) == codec._merged(word)


def test_digest(spark, awkward):
    vocab = bpe.vocabulary(spark, PATH)
    got = sorted(map(tuple, bpe.digest(awkward, vocab, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for r in awkward.collect():
        ids = REFERENCE.encode_ordinary(r["text"] or "")
        want.append(
            (
                r["doc_id"],
                len(ids),
                hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((r["text"] or "").encode()).hexdigest(),
            )
        )
    assert got == sorted(want, key=repr)


def test_separate_steps_and_clashing_columns(spark, awkward, nothing):
    vocab = bpe.vocabulary(spark, PATH)
    df = awkward.withColumn("ids", F.lit("old")).withColumn("decoded", F.lit(1))
    out = bpe.decode(bpe.encode(df, vocab, public_tokenizers.PATTERN), vocab)
    assert set(out.columns) == set(df.columns)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in out.collect())
    done = bpe.with_round_trip(df, vocab, public_tokenizers.PATTERN)
    assert done.where("NOT round_trip").count() == 0
    counts = awkward.select(bpe.token_counts(F.col("text"), vocab, public_tokenizers.PATTERN).alias("n"), "text")
    assert all(r["n"] == len(REFERENCE.encode_ordinary(r["text"] or "")) for r in counts.collect())
    assert bpe.digest(nothing, vocab, public_tokenizers.PATTERN).collect() == []


def test_a_batch_leaves_in_runs():
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    texts = ["two words " * 40_000, None, "", "end"] * 4
    parts = list(bpe._encoded(codec, pa.array(texts, pa.string())))
    assert len(parts) > 1 and sum(map(len, parts)) == len(texts)
    assert [x for p in parts for x in p.to_pylist()] == [codec.encode(t or "") for t in texts]
    few = pa.array([[1], None, [2, 3]] * 300, pa.list_(pa.int32()))
    back = list(bpe._decoded(codec, few))
    assert max(map(len, back)) <= bpe.DECODE_ROWS
    assert [x for b in back for x in b.to_pylist()] == [i and codec.decode(i) for i in few.to_pylist()]

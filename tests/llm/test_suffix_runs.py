import hashlib
import random

import numpy as np
import pytest

from maskweave.llm import suffix_runs as S
from tests.llm.conftest import prose


def plain(texts):
    """(n_bytes, n_removed, n_spans, kept) of each text, by counting every window."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for s in range(len(b) - S.LENGTH + 1):
            w = b[s : s + S.LENGTH]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        reach = 0
        for s in range(len(b) - S.LENGTH + 1):
            if seen[b[s : s + S.LENGTH]] > 1:
                gone[max(s, reach) : s + S.LENGTH] = True
                reach = s + S.LENGTH
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def case(seed):
    """Texts that share passages of many lengths, at many places."""
    rng = random.Random(seed)
    passages = [prose(1000 + seed * 50 + n, rng.choice([20, 40, 60, 150])) for n in range(8)]
    passages += ["ab" * 150, "z" * 420, "nul\x00" * 60]
    texts = [None, "", "short", "y" * 200, "y" * 199, "y" * 201, passages[0]]
    for n in range(60):
        parts = [prose(seed * 977 + n * 7 + k, rng.randint(1, 60)) for k in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            p = p[a:] if rng.random() < 0.5 else p[:a] if rng.random() < 0.3 else p
            parts.insert(rng.randrange(len(parts) + 1), p)
        texts.append(rng.choice(["", " "]).join(parts))
    return texts + [texts[9]]


@pytest.mark.parametrize("seed,hot,small", [(1, 32_768, 6), (2, 32_768, 1), (3, 5, 6)])
def test_digest_against_all_windows(spark, make_docs, monkeypatch, seed, hot, small):
    monkeypatch.setattr(S, "HOT_ROWS", hot)
    monkeypatch.setattr(S, "SMALL_GROUP", small)
    texts = case(seed)
    got = {r["doc_id"]: tuple(r)[1:] for r in S.digest(make_docs(texts)).collect()}
    want = plain(texts)
    assert [got[n] for n in range(len(texts))] == want
    assert sum(w[1] for w in want) > 1000


def test_groups_of_many_against_pairs(monkeypatch):
    rng = random.Random(8)
    for _ in range(60):
        m = rng.randint(7, 25)
        rights = sorted(
            b"g" * S.GRAM + bytes(rng.choice(b"ab") for _ in range(rng.choice([4, 8])))[: rng.randint(0, 8)] + b"c" * rng.randint(0, 140)
            for _ in range(m)
        )
        rights = [r[: S.LENGTH] for r in rights]
        befores = [bytes(rng.choice(b"ab") for _ in range(3)) + b"d" * rng.randint(0, 130) for _ in range(m)]
        prefixes = [0] + [S.common_prefix(a, b) for a, b in zip(rights, rights[1:])]
        many = S.group_ranges(prefixes, befores, [len(r) for r in rights])
        monkeypatch.setattr(S, "SMALL_GROUP", 1000)
        pairs = S.group_ranges(prefixes, befores, [len(r) for r in rights])
        monkeypatch.undo()
        assert many == pairs


def test_merging_keeps_order_and_prefixes():
    rng = random.Random(4)
    for runs_of in (1, 2, 3, 7, 16):
        every, runs = [], []
        for k in range(runs_of):
            text = bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 900)))
            place = np.array(sorted(rng.sample(range(len(text)), min(len(text), 60))), np.int64)
            every += [text[p : p + S.LENGTH] for p in place]
            runs.append(S.Run(S.front_coded([text], np.array([k]), np.zeros(len(place), np.int64), place)))
        last, got = b"", []
        for prefix, run in S.merged(runs):
            assert prefix == (S.common_prefix(last, run.suffix) if got else 0)
            last = run.suffix
            got.append(last)
        assert got == sorted(every)


def test_long_texts_and_awkward_rows(awkward, nothing):
    got = sorted(map(tuple, S.digest(awkward).collect()), key=repr)
    rows = awkward.collect()
    assert got == sorted([(r["doc_id"], *p) for r, p in zip(rows, plain([r["text"] for r in rows]))], key=repr)
    assert S.digest(nothing).collect() == []


def test_pieces_of_one_text_meet(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 1000)
    data = prose(5, 2000).encode()
    text, place, gram = S.anchors([data])
    monkeypatch.undo()
    assert list(place) == list(S.anchors([data])[1])

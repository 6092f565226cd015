import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from maskweave.llm import pii
from tests.llm.conftest import prose

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            if valid(kind, m.group()):
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


PIECES = [
    "a.b@c-d.org", "x@y", "@", "a@b.c_d@e.f", "a@b..c", "me@host.example.com", "1.2.3.4", "255.255.255.0",
    "256.1.1.1", "000255.1.1.1", "1.2.3.4.5.6.7.8", "99999999999999999999.1.1.1", "4111 1111 1111 1111",
    "4111111111111112", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "+1 (415) 555-0132", "+12", "+1-2", "+44 20 7946 0958",
    "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "call 415-555-0132", "password=c1f6c02f845bf3028d", 'token = "a3bb2eca6d68"',
    "é", "日本", "🎉", " ", "\n", ", ", "7", "12", ".", "-", "+", "word ",
]


def check(docs):
    rows = {}
    for r in docs.collect():
        rows.setdefault(r["doc_id"], []).append(r["text"])
    got = pii.digest(docs).collect()
    assert len(got) == sum(map(len, rows.values()))
    for r in got:
        for text in {t for t in rows[r["doc_id"]]}:
            want = plain(text)
            base = [f"{k}:{s}:{e}" for s, _, e, k in want]
            if r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest():
                assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[3] == k for x in want) for k in PLAIN]
                spans = r["spans"].split(",") if r["spans"] else []
                assert [s for s in spans if s in base] == base
                keys = [(int(s.split(":")[1]), pii.ORDER.index(s.split(":")[0])) for s in spans]
                assert keys == sorted(keys)
                break
        else:
            raise AssertionError((r, plain(rows[r["doc_id"]][0])))
    return got


def test_base_spans_against_plain_scans(make_docs, awkward):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    check(make_docs(texts).union(awkward.where("doc_id IS NULL OR doc_id > 900")))
    check(awkward)


@pytest.mark.parametrize("text", ["1" * 40_000, "a" * 40_000, "1-" * 20_000, "a@" * 20_000, "1.2" * 15_000, "+1 " * 15_000])
def test_long_runs_are_linear(make_docs, text):
    check(make_docs([text]))


def test_many_spans_in_one_text(make_docs):
    got = check(make_docs([" ".join(f"u{n}@h{n}.example.com" for n in range(20_000))]))
    assert got[0]["n_email"] == 20_000


def test_method_adds_what_the_labelers_agree_on(make_docs):
    texts = [prose(n, 40) + f" password=k{n:05d}f845bf3028d " + prose(n + 1, 20) for n in range(60)]
    texts += [prose(n, 40) + " phone 415-555-0132 " for n in range(30)]
    texts += [prose(n, 30) + f" order 41111111111{n:05d} " for n in range(30)]
    docs = make_docs(texts)
    got = {r["doc_id"]: r for r in pii.digest(docs).collect()}
    assert sum("secret:" in got[n]["spans"] for n in range(60)) == 60
    start = texts[0].index("k00000")
    assert got[0]["spans"] == f"secret:{start}:{start + len('k00000f845bf3028d')}"
    weights = pii.fit(pii.with_candidates(docs))
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs, weights).collect()}
    assert "k00000f845bf3028d" not in clean[0] and "password=[SECRET]" in clean[0]


def test_redaction_leaves_no_span(make_docs, awkward):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    docs = make_docs(texts).union(awkward).withColumn("candidates", F.lit("mine"))
    weights = pii.fit(pii.with_candidates(docs.drop("candidates")))
    out = pii.redacted(docs, weights)
    assert out.columns == docs.columns
    by_id = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    for n, text in enumerate(texts):
        if n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10):
            continue
        cleaned = by_id[n]["text"]
        for s, _, e, kind in plain(text):
            assert f"[{kind.upper()}]" in cleaned or any(k in cleaned for k in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[SECRET]"))
        if not plain(text) and "415-555" not in text and "=" not in text and not re.search(r"\d{4}", text):
            assert "[" in cleaned or cleaned == text
    assert by_id[3]["text"] in (None, "") and by_id[3]["candidates"] == "mine"


def test_nothing(nothing):
    assert pii.digest(nothing).collect() == []


def test_a_long_secret_goes_whole(make_docs):
    texts = [prose(n, 40) + f" password=k{n:05d}f845bf3028d " + prose(n + 1, 20) for n in range(60)]
    long = "eyJ" + "k7Qz9" * 400
    docs = make_docs([*texts, f"{prose(99, 40)} token={long} {prose(98, 20)}"])
    start = docs.where("doc_id = 60").first()["text"].index(long)
    got = {r["doc_id"]: r["spans"] for r in pii.digest(docs).collect()}
    assert got[60] == f"secret:{start}:{start + len(long)}"
    clean = pii.redacted(docs, pii.fit(pii.with_candidates(docs))).where("doc_id = 60").first()["text"]
    assert "token=[SECRET] " in clean and "k7Qz9" not in clean

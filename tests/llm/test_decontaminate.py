import random

import numpy as np
from pyspark.sql import functions as F

from maskweave.llm import decontaminate as D
from tests.llm.conftest import AWKWARD, prose

ITEMS = [(n, prose(9000 + n, w)) for n, w in enumerate([12, 20, 30, 60, 90, 14])]


def edited(text, k, rng):
    out = list(text)
    for at in rng.sample(range(2, len(out) - 2), k):
        out[at] = rng.choice(["", "#", out[at] + "#"])
    return "".join(out)


def plain_contains(window, text, k):
    """Whether some stretch of the text is within k edits of the window (full table)."""
    cost = list(range(len(window) + 1))
    for c in text:
        new = [0]
        for i, w in enumerate(window, 1):
            new.append(min(cost[i - 1] + (w != c), cost[i] + 1, new[i - 1] + 1))
        cost = new
        if cost[-1] <= k:
            return True
    return False


def folded(text):
    return "".join(map(chr, D.codes(text, D._fold_table()).tolist()))


def plain(text):
    found = set()
    for item, whole in ITEMS:
        c = folded(whole)
        if len(c) < D.Q:
            continue
        starts = list(range(0, max(1, len(c) - D.WINDOW + 1), D.STRIDE))
        if len(c) > D.WINDOW:
            starts.append(len(c) - D.WINDOW)
        for s in starts:
            w = c[s : s + D.WINDOW]
            if plain_contains(w, folded(text), D.edit_budget(len(w))):
                found.add(item)
    return found


def hosts(seed, n):
    rng = random.Random(seed)
    texts = []
    for k in range(n):
        host = prose(seed * 331 + k, 40)
        if k % 3:
            item = rng.choice(ITEMS)[1]
            part = item if rng.random() < 0.5 else item[rng.randrange(len(item) // 2) :]
            part = edited(part, min(len(part) // 8, int(len(part) * rng.choice([0, 0.02, 0.05, 0.1]))), rng)
            at = rng.randrange(len(host))
            host = host[:at] + (part.upper() if rng.random() < 0.2 and "ß" not in part else part) + host[at:]
        texts.append(host)
    return texts


def test_filter_loses_nothing():
    index = D.Index(ITEMS)
    texts = hosts(1, 45)
    got = [set() for _ in texts]
    for t, item, start, end, edits in index.search(texts):
        got[t].add(item)
        assert 0 <= start < end <= len(texts[t])
        assert edits <= D.edit_budget(D.WINDOW)
    assert got == [plain(t) for t in texts]
    assert sum(map(len, got)) > 10


def test_every_quote_of_the_stated_length_is_found():
    item = prose(321, 90)
    assert len(item) > 300
    index = D.Index([(1, item)])
    length = D.WINDOW + D.STRIDE - 1
    quotes = [f"# {item[s : s + length]} #" for s in range(len(item) - length + 1)]
    assert {t for t, *_ in index.search(quotes)} == set(range(len(quotes)))


def test_short_items_are_found_verbatim():
    items = [(1, "What is seven times six?"), (2, "forty-two ok"), (3, "too short")]
    index = D.Index(items)
    texts = ["He asked: what is seven times six? And left", "what is seven times sixx?", "what is sevn times six?", "forty-two ok", "too short"]
    found = {(t, i) for t, i, *_ in index.search(texts)}
    assert found == {(0, 1), (3, 2)}


def test_counts_do_not_depend_on_how_many_places_are_held(monkeypatch):
    items = [*ITEMS, (7, "-" * 150)]
    texts = [*hosts(5, 20), "-" * 3000 + ITEMS[3][1]]
    whole = D.Index(items).search(texts)
    monkeypatch.setattr(D, "POSTINGS", 100)
    assert D.Index(items).search(texts) == whole
    # In a run every place of a band is as good; the earliest is reported.
    assert any(f[:3] == (20, 7, 0) and abs(f[3] - 3000) <= D.BAND for f in whole)


def test_alignment_finds_start_end_and_cost():
    window = np.frombuffer(b"the quick brown fox", np.uint8).astype(np.uint32)
    regions = [b"xxthe quick brown foxyyyyy", b"xxthe quik browwn foxyyyyyy", b"nothing of the kind here.."]
    rows = np.stack([np.frombuffer(r[:26].ljust(26), np.uint8).astype(np.uint32) for r in regions])
    start, end, edits = D.aligned(np.stack([window] * 3), rows)
    assert (start[0], end[0], edits[0]) == (2, 21, 0)
    assert (start[1], end[1], edits[1]) == (2, 21, 2)
    assert edits[2] > 5


def test_rows(spark, make_docs, awkward, nothing):
    bench = spark.createDataFrame([*ITEMS, (90, None), (91, ""), (None, prose(1, 40))], "item_id bigint, text string")
    texts = hosts(2, 30)
    docs = make_docs(texts).union(awkward)
    found = D.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {
        (n, i) for n, t in enumerate(texts) for i in plain(t)
    }
    clean = D.clean_rows(docs.withColumn("contamination", F.lit("mine")), bench)
    assert clean.count() == docs.count() - sum(1 for t in texts if plain(t))
    assert clean.columns == [*docs.columns, "contamination"]
    assert D.contaminated(docs, bench.limit(0)).collect() == []
    assert D.clean_rows(nothing, bench).collect() == []


def test_blocks_of_a_large_benchmark_agree(spark, make_docs, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = make_docs(hosts(3, 30))
    whole = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    assert sorted(map(tuple, D.contaminated(docs, bench).collect())) == whole
    assert len(AWKWARD) and whole


def test_every_region_of_an_item_is_reported(spark, make_docs):
    item = prose(77, 80)
    assert len(item) > 2 * D.WINDOW
    bench = spark.createDataFrame([(5, item), (6, prose(78, 30))], "item_id bigint, text string")
    gaps = [prose(n, 30) + " # " for n in range(3)]
    texts = [gaps[0] + item + " # " + gaps[1] + item + " # " + gaps[2], item, item + item]
    got = sorted(map(tuple, D.contaminated(make_docs(texts), bench).collect()))
    first = len(gaps[0])
    second = first + len(item) + 3 + len(gaps[1])
    assert got == [
        (0, 5, first, first + len(item), 0),
        (0, 5, second, second + len(item), 0),
        (1, 5, 0, len(item), 0),
        (2, 5, 0, 2 * len(item), 0),
    ]
    assert D.merged([(0, 1, 9, 12, 2), (0, 1, 3, 9, 0), (0, 2, 4, 6, 1), (1, 1, 3, 9, 1), (0, 1, 14, 20, 1)]) == [
        (0, 1, 3, 12, 2), (0, 1, 14, 20, 1), (0, 2, 4, 6, 1), (1, 1, 3, 9, 1)
    ]

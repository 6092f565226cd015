import json

import pytest
from pyspark.sql import functions as F

from maskweave.operators import policy as P
from maskweave.sources import policy_store as PS
from maskweave.sources.tables import load_policy


def test_load_defaults_and_errors(spark, tmp_path):
    f = tmp_path / "p.json"
    f.write_text(json.dumps({"deny": [{"term": "Acme", "label": "ORG"}]}))
    row = load_policy(spark, str(f)).first()
    assert (row.list, row.term, row.scope, row.aliases, row.source, row.whole_word) == (
        "deny", "Acme", "global", [], "", False,
    )
    assert load_policy(spark, str(tmp_path / "none.json")).count() == 0
    f.write_text("{broken")
    with pytest.raises(Exception):
        load_policy(spark, str(f)).collect()


def log(spark, *events):
    rows = [(i, op, t, lab, sc, w) for i, (op, t, lab, sc, w) in enumerate(events)]
    return spark.createDataFrame(rows, P.LOG_SCHEMA)


def test_policy_state_follows_the_log(spark):
    events = log(
        spark,
        ("teach", "Acme", "ORG", "alpha", False),
        ("teach", "ACME", "CLIENT", "Alpha", True),
        ("teach", "Acme", "CLIENT", "beta", False),
        ("unteach", "acme", None, "ALPHA", None),
        ("teach", "Zed", "ORG", "global", False),
        ("unteach", "zed", None, None, None),
        ("teach", "ZED", "NEW", "global", True),
    )
    rows = {(r.term, r.scope): r for r in P.policy_state(events).collect()}
    assert set(rows) == {("Acme", "beta"), ("ZED", "global")}
    assert rows[("ZED", "global")].ord == 6 and rows[("ZED", "global")].label == "NEW"
    effect = {r.seq: r.changed for r in P.unteach_effect(events, blocks=2).collect()}
    assert effect == {3: True, 5: True}


def test_unteach_of_nothing_changes_nothing(spark):
    events = log(
        spark,
        ("unteach", "Acme", None, None, None),
        ("teach", "Acme", "ORG", "alpha", False),
        ("unteach", "acme", None, "beta", None),
        ("unteach", "acme", None, "alpha", None),
        ("unteach", "acme", None, None, None),
    )
    effect = {r.seq: r.changed for r in P.unteach_effect(events, blocks=3).collect()}
    assert effect == {0: False, 2: False, 3: True, 4: False}


@pytest.mark.parametrize("seed,unit", [(1, 1), (2, 10**15)])
def test_unteach_effect_against_replay(spark, seed, unit):
    import random

    rng = random.Random(seed)
    rows, live, want = [], {}, {}
    for n in range(400):
        op, term = rng.choice(["teach", "unteach"]), rng.choice(["A", "a", "b", "hot", "hot", "HOT"])
        scope = rng.choice(["x", "Y", "z", None]) if op == "unteach" else rng.choice(["X", "y", "z"])
        kt, ks, seq = term.lower(), scope and scope.lower(), n * unit
        rows.append((seq, op, term, "L", scope, False))
        scopes = live.setdefault(kt, set())
        if op == "teach":
            scopes.add(ks)
        else:
            want[seq] = bool(scopes) if ks is None else ks in scopes
            live[kt] = set() if ks is None else scopes - {ks}
    events = spark.createDataFrame(rows, P.LOG_SCHEMA)
    got = P.unteach_effect(events, blocks=7)
    assert {r.seq: r.changed for r in got.collect()} == want
    assert P.unteach_effect(events.limit(0)).count() == 0


def test_scope_terms(spark, make_policy):
    policy = make_policy(
        ("deny", "Acme", "ORG", {"scope": "alpha"}), ("deny", "Acme", "CLIENT", {"scope": "beta"})
    )
    asked = spark.createDataFrame([("alpha",), ("gamma",), (None,)], "request_scope string")
    rows = P.forms_by_request_scope(asked, P.hidden_forms(policy)).collect()
    assert sorted((r.request_scope or "", r.label) for r in rows) == [("", "ORG"), ("alpha", "ORG")]


def test_version_changes_with_every_relevant_field(spark, make_policy):
    base = ("deny", "Acme", "ORG")
    variants = [
        [base],
        [("deny", "Acme", "PERSON")],
        [("deny", "Acme", "ORG", {"scope": "alpha"})],
        [("deny", "Acme", "ORG", {"whole_word": True})],
        [("deny", "Acme", "ORG", {"aliases": ["A"]})],
        [base, ("allow", "Acme", "")],
        [("allow", "Acme", ""), base],
    ]
    seen = {P.policy_version(make_policy(*v)).first()[0] for v in variants}
    assert len(seen) == len(variants)
    again = P.policy_version(make_policy(base).repartition(3)).first()[0]
    assert again == P.policy_version(make_policy(base)).first()[0]


def test_store_is_append_only_and_versioned(spark, tmp_path):
    path = str(tmp_path / "log")
    PS.teach(spark, path, "Acme", "ORG")
    PS.teach(spark, path, "Zed", "ORG", "alpha", True)
    PS.unteach(spark, path, "ACME")
    assert [(r.term, r.scope, r.whole_word) for r in PS.current(spark, path).collect()] == [
        ("Zed", "alpha", True)
    ]
    known = spark.createDataFrame([("alpha",)], "scope string")
    with pytest.raises(ValueError):
        PS.teach(spark, path, "Q", "ORG", "typo", known_scopes=known)
    with pytest.raises(ValueError):
        PS.teach(spark, path, "Q", "straße")
    store = str(tmp_path / "store")
    assert PS.latest(spark, store)[1] == 0
    PS.publish(PS.current(spark, path), store, 1)
    policy, version = PS.latest(spark, store)
    assert version == 1 and policy.select(F.col("term")).first()[0] == "Zed"
    with pytest.raises(Exception):
        PS.publish(policy, store, 1)


def test_compact_keeps_the_rows_and_leaves_large_policies_alone(spark, make_policy, monkeypatch):
    policy = make_policy(("deny", "Acme", "ORG", {"aliases": ["A", "B"]}), ("allow", "x", ""))
    small = P.compact(policy)
    assert sorted(small.collect()) == sorted(policy.collect()) and small.schema == policy.schema
    monkeypatch.setattr(P, "COMPACT_ROWS", 1)
    assert P.compact(policy) is policy
    monkeypatch.setattr(P, "COMPACT_ROWS", 10)
    long = make_policy(("deny", "y" * 5000, "ORG"))
    assert P.compact(long) is long

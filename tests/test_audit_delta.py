import pytest
from pyspark.sql import functions as F

import maskweave
from maskweave.operators import audit as A
from maskweave.operators import bodies as B
from maskweave.operators import delta as DL


def test_reasons(spark, make_policy):
    policy = make_policy(("deny", "Cartalian", "ORG"), ("deny", "Adit", "ORG"), ("allow", "ADIT", ""))
    rows = [(1, "Cartalian is our client."), (2, "cut <<ORG_1"), (3, "Adit <<ORG_1>>"), (4, "<< cartalian")]
    df = spark.createDataFrame(rows, "id int, body string")
    done = A.audit(df, policy, ["id"], "body")
    assert {r.id: r.reason for r in done.collect()} == {
        1: "residual_term", 2: "malformed_placeholder", 3: None, 4: "residual_term",
    }
    clean, held = A.split_clean(done)
    assert clean.count() == 1 and held.count() == 3
    assert {r.id: r.outcome for r in A.with_outcome(done).collect()}[3] == "clean"
    with pytest.raises(Exception, match="output blocked"):
        A.strict(done).collect()
    assert A.strict(done.where("id = 3")).count() == 1


def test_term_hidden_by_json_escapes(spark, make_policy):
    policy = make_policy(("deny", 'the "Falcon" project', "PROJECT"))
    body = r'{"messages":[],"metadata":{"note":"about the \"Falcon\" project"}}'
    df = spark.createDataFrame([(1, body)], "id int, body string")
    df = df.withColumn("strings", F.transform(B.leaves_column(F.col("body"), True), lambda x: x["value"]))
    assert A.audit(df, policy, ["id"], "body").first().reason is None
    assert A.audit(df, policy, ["id"], "body", "strings").first().reason == "residual_term"


def test_scope_config(spark):
    def report(text):
        rows = list(enumerate(text.split(",")))
        out = A.scope_config_violations(spark.createDataFrame(rows, "entry_no bigint, entry string"))
        return [r.violation for r in out.collect()]

    assert report("a=1,a=2") == ["scope listed twice"]
    assert report("a=1,b=1") == ["token shared"]
    assert report("global=1") == ["reserved scope"]
    assert report("a=") == ["empty part"]
    assert report("a:supersecret") == ["not scope=token"]
    assert report("a=1,b=2") == []


def test_resolve_scopes(spark):
    scopes = spark.createDataFrame([(0, "alpha", "t1"), (1, "beta", "t2")], "pos bigint, scope string, t string")
    scopes = scopes.select("pos", "scope", F.sha2("t", 256).alias("token_hash"))
    rows = [(1, "Bearer t1", None), (2, None, "t2"), (3, "t1", None), (4, "Bearer t1", "t2"), (5, None, None)]
    req = spark.createDataFrame(rows, "id int, bearer string, api_key string")
    got = {r.id: (r.scope, r.reason) for r in A.resolve_scopes(req, scopes).collect()}
    bad = (None, "unauthorized_scope")
    assert got == {1: ("alpha", None), 2: ("beta", None), 3: bad, 4: ("beta", None), 5: bad}
    open_mode = A.resolve_scopes(req, scopes.limit(0)).collect()
    assert all(r.scope is None and r.reason is None for r in open_mode)


def segments(spark, rows):
    return DL.with_hash(spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string"))


def test_delta_scan_reuses_and_invalidates(spark, make_policy):
    policy = make_policy(("deny", "Project Loki", "PROJECT"))
    segs = segments(spark, [(1, 0, "about project loki"), (1, 1, "a@b.com"), (2, 0, "a@b.com"), (2, 1, "plain")])
    empty = spark.createDataFrame([], DL.CACHE_SCHEMA)
    old = lambda df: maskweave.detect_rows(df, make_policy(), ["seg_hash"])
    new = lambda df: maskweave.detect_rows(df, policy, ["seg_hash"])
    first, rows = DL.delta_scan(segs, empty, "v1", old)
    assert {(r.conv_id, r.turn): len(r.spans) for r in first.collect()} == {
        (1, 0): 0, (1, 1): 1, (2, 0): 1, (2, 1): 0,
    }
    cache = spark.createDataFrame(rows.collect(), DL.CACHE_SCHEMA)
    assert cache.count() == 3 and "text" not in cache.columns
    again, fresh = DL.delta_scan(segs, cache, "v1", new)
    assert fresh.count() == 0 and again.where("hit").count() == 4
    later, fresh = DL.delta_scan(segs, cache, "v2", new)
    assert fresh.count() == 3 and later.where("not hit").count() == 4
    assert {(r.conv_id, r.turn): len(r.spans) for r in later.collect()}[(1, 0)] == 1


def test_delta_scan_of_two_tenants(spark, make_policy):
    policy = make_policy(("deny", "Loki", "PROJECT", {"scope": "a"}), ("deny", "Falcon", "CODE", {"scope": "b"}))
    rows = [(0, "Loki and Falcon", "A"), (1, "Loki and Falcon", "b"), (2, "Loki and Falcon", "A"), (3, None, "b"),
            (4, "Loki and Falcon", "c"), (5, "Loki and Falcon", None)]
    segs = DL.with_hash(spark.createDataFrame(rows, "id int, text string, who string"), scope="who")
    detect = lambda df: maskweave.detect_rows(df, policy, ["seg_hash"], scope="who")
    out, new = DL.delta_scan(segs, spark.createDataFrame([], DL.CACHE_SCHEMA), "v1", detect, carry=("who",))
    labels = {r.id: [s.label for s in r.spans] for r in out.collect()}
    assert labels == {0: ["PROJECT"], 1: ["CODE"], 2: ["PROJECT"], 3: [], 4: [], 5: ["PROJECT", "CODE"]}
    assert new.count() == 5
    again, none = DL.delta_scan(segs, new, "v1", detect, carry=("who",))
    assert none.count() == 0 and {r.id: [s.label for s in r.spans] for r in again.collect()} == labels


def test_hash_keeps_scopes_apart(spark):
    df = spark.createDataFrame([("x", None), ("x", "a"), ("x", "b"), ("x", "a")], "text string, s string")
    assert DL.with_hash(df, scope="s").select("seg_hash").distinct().count() == 3


def test_resent_history_is_linear_and_right(spark):
    rows = [(1, t, f"text {t % 3}") for t in range(6)] + [(2, 0, "text 0"), (2, 1, "new")]
    got = {(r.conv_id, r.turn): r for r in DL.resent_history(segments(spark, rows), block_size=2).collect()}
    assert [got[(1, t)].segments for t in range(6)] == [1, 2, 3, 4, 5, 6]
    assert [got[(1, t)].misses for t in range(6)] == [1, 1, 1, 0, 0, 0]
    assert [got[(1, t)].chars_sent for t in range(6)] == [6, 12, 18, 24, 30, 36]
    assert (got[(2, 0)].misses, got[(2, 1)].misses, got[(2, 1)].hits) == (0, 1, 1)
    look = DL.lookups(segments(spark, rows)).first()
    assert (look.lookups, look.hits, look.misses) == (8, 4, 4)


def queue(spark, rows, policy, limit=200):
    df = spark.createDataFrame(
        rows, "seg_no bigint, seg_hash string, scope string, start bigint, source string, value string"
    )
    return DL.suggestions(df, policy, scope="scope", limit=limit)


def test_suggestions(spark, make_policy):
    policy = make_policy(
        ("deny", "Known", "ORG", {"scope": "a"}), ("allow", "fine", "", {"scope": "a"})
    )
    rows = [(i, f"h{i}", "a", 0, "regex", f"v{i}") for i in range(250)]
    rows += [(300, "h0", "a", 0, "regex", "v0")]  # a copy: its first place counts
    rows += [(301, "k", "a", 0, "regex", "KNOWN"), (302, "f", "a", 0, "model", "Fine")]
    rows += [(303, "k", "b", 0, "regex", "KNOWN"), (304, "d", "a", 0, "dictionary", "w")]
    got = queue(spark, rows, policy)
    terms = [(r.scope, r.term) for r in got.collect()]
    assert len(terms) == 200 and ("b", "KNOWN") in terms and ("a", "KNOWN") not in terms
    assert ("a", "Fine") not in terms and ("a", "w") not in terms
    assert ("a", "v0") not in terms and ("a", "v249") in terms and ("a", "v51") in terms
    assert DL.suggestions_of(got, "A").count() == 0 and DL.suggestions_of(got, "b").count() == 1

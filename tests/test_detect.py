import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import maskweave
from maskweave.functions import patterns as P
from maskweave.functions import spans as S
from maskweave.operators import detect as D
from maskweave.operators import dictionary as DD


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = D.explode_spans(D.detect_patterns(df), "id").collect()
    out = [[] for _ in texts]
    for r in sorted(rows, key=lambda r: (r.id, r.start)):
        assert texts[r.id][r.start : r.end] == r.value
        out[r.id].append((r.label, r.value))
    return out


def test_pattern_cases(spark):
    got = found(
        spark,
        [
            "pay 4111 1111 1111 1111 today",
            "pay 4111 1111 1111 1112 today",
            "released 2026-10-02.",
            "see 1.........9",
            "call +1 (415) 555-0132",
            "host 192.168.10.4",
            "write to a@b.com. Soon",
            None or "",
        ],
    )
    assert got[0] == [("CARD", "4111 1111 1111 1111")]
    assert [x[0] for x in got[1]] == ["PHONE"]
    assert got[2] == [] and got[3] == []
    assert [x[0] for x in got[4]] == ["PHONE"]
    assert got[5] == [("IP", "192.168.10.4")]
    assert got[6] == [("EMAIL", "a@b.com.")]
    assert got[7] == []


def test_null_text_has_no_spans(spark):
    df = spark.createDataFrame([(1, None)], "id int, text string")
    assert D.detect_patterns(df).select(F.size("spans")).first()[0] == 0


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab@.-+ é", max_size=24), min_size=20, max_size=40))
def test_linear_email_pattern_finds_the_same(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(
        S.all_matches(F.col("text"), P.EMAIL).alias("a"),
        S.all_matches(F.col("text"), P.EMAIL_LINEAR).alias("b"),
    ).collect()
    assert all(r.a == r.b for r in rows)


def merged(spark, spans):
    rows = [(s, e, "L", src, 0.0, "") for s, e, src in spans]
    df = spark.createDataFrame([(rows,)], f"spans {S.SPANS_TYPE}")
    return [(s.start, s.end) for s in df.select(S.merged("spans")).first()[0]]


def test_merge_keeps_spans_after_a_dropped_longer_one(spark):
    spans = [(0, 3, "dictionary"), (0, 5, "regex"), (3, 4, "model"), (4, 8, "regex")]
    assert merged(spark, spans) == [(0, 3), (3, 4), (4, 8)]


def test_merge_prefers_source_then_length(spark):
    assert merged(spark, [(0, 9, "model"), (0, 4, "regex"), (0, 6, "regex")]) == [(0, 6)]
    assert merged(spark, [(2, 4, "dictionary"), (1, 3, "model")]) == [(1, 3)]


# --- dictionary, all paths ------------------------------------------------------------------

PATHS = [
    {"max_forms": 500},
    {"max_forms": 0},
    {"max_forms": 0, "chunk_bytes": 260, "chunks": True},
    {"max_forms": 0, "chunk_bytes": 0},
]


def hide(spark, policy, texts, scopes=None, **path):
    rows = [(i, t, scopes[i] if scopes else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string, who string")
    out = DD.with_dictionary_spans(
        df, policy, scope="who" if scopes else None, key=["id"], out="spans", **path
    )
    got = {r.id: [(s.start, s.end, s.label) for s in r.spans] for r in out.collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("path", PATHS)
def test_dictionary_cases(spark, make_policy, path):
    policy = make_policy(
        ("deny", "Project", "ORG"),
        ("deny", "Project Loki", "PROJECT"),
        ("deny", "Cartalian", "ORG"),
        ("deny", "Ann", "PERSON", {"whole_word": True}),
        ("deny", "straße-corp", "ORG"),
        ("deny", "ΣΑΣ", "GREEK"),
        ("deny", "a.b", "DOT", {"aliases": ["c(d"]}),
    )
    texts = [
        "About Project Loki today.",
        "İİİİİ met Cartalian, then CARTALIAN again.",
        "Anna wrote to Ann, not channel.",
        "STRASSE-CORP straße-CORP",
        "σας σασ",
        "axb a.b C(D",
        "CARTALİAN",
        "éAnn Annß Ann",
        "",
    ]
    assert hide(spark, policy, texts, **path) == [
        [(6, 18, "PROJECT")],
        [(10, 19, "ORG"), (26, 35, "ORG")],
        [(14, 17, "PERSON")],
        [(13, 24, "ORG")],
        [(0, 3, "GREEK"), (4, 7, "GREEK")],
        [(4, 7, "DOT"), (8, 11, "DOT")],
        [],
        [(10, 13, "PERSON")],
        [],
    ]


@pytest.mark.parametrize("path", PATHS)
def test_scopes_see_their_own_and_global_terms(spark, make_policy, path):
    policy = make_policy(
        ("deny", "Acme", "ORG", {"scope": "alpha"}),
        ("deny", "Acme Corp", "BIG", {"scope": "beta"}),
        ("deny", "Borealis", "ORG", {"scope": "Beta"}),
        ("deny", "Cartalian", "ORG"),
    )
    t = "Acme Corp, Borealis and Cartalian"
    got = hide(spark, policy, [t] * 4, ["alpha", "BETA", "gamma", None], **path)
    assert got[0] == [(0, 4, "ORG"), (24, 33, "ORG")]
    assert got[1] == [(0, 9, "BIG"), (11, 19, "ORG"), (24, 33, "ORG")]
    assert got[2] == [(24, 33, "ORG")]
    assert got[3] == [(0, 9, "BIG"), (11, 19, "ORG"), (24, 33, "ORG")]


@pytest.mark.parametrize("path", PATHS)
def test_stricter_duplicate_wins(spark, make_policy, path):
    policy = make_policy(
        ("deny", "Ann", "WORD", {"whole_word": True}), ("deny", "ANN", "ANY")
    )
    assert hide(spark, policy, ["channel Ann"], **path) == [[(2, 5, "ANY"), (8, 11, "ANY")]]


def brute(text, forms):
    """Leftmost, then longest form; by definition, position by position."""
    out, i = [], 0
    while i < len(text):
        hits = [f for f, w in forms if matches(text, i, f, w)]
        if hits:
            best = max(hits, key=len)
            out.append((i, i + len(best)))
            i += len(best)
        else:
            i += 1
    return out


def matches(text, i, form, whole):
    if text[i : i + len(form)].lower() != form.lower():
        return False
    word = lambda c: bool(re.match(r"\w", c))
    if not whole:
        return True
    left = i > 0 and word(text[i - 1]) and word(text[i])
    end = i + len(form)
    right = end < len(text) and word(text[end]) and word(text[end - 1])
    return not left and not right


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.text(alphabet="abA é.", min_size=1, max_size=4), st.booleans()),
        min_size=1,
        max_size=8,
        unique_by=lambda f: f[0].lower(),
    ),
    st.lists(st.text(alphabet="abAB é.", max_size=30), min_size=10, max_size=20),
)
def test_dictionary_against_brute_force(spark, make_policy, forms, texts):
    policy = make_policy(*[("deny", f, "T", {"whole_word": w}) for f, w in forms])
    want = [brute(t, forms) for t in texts]
    for path in PATHS:
        got = hide(spark, policy, texts, **path)
        assert [[x[:2] for x in row] for row in got] == want


# --- everything together ----------------------------------------------------------------------

PIECES = ["Cartalian", "cartalian", "PROJECT LOKI", "Zoë Müller", "straße-corp", "İİİ", "ǅ Σ ς",
          "d.pratt@northwind.com", "+1 (415) 555-0132", "4111 1111 1111 1111", "10.0.0.1",
          "2026-10-02", "über", "x>y", "\n"]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=11), min_size=8, max_size=16))
def test_redact_then_restore_is_identity(spark, make_policy, lists):
    policy = make_policy(
        ("deny", "Cartalian", "ORG"), ("deny", "Project Loki", "PROJECT"),
        ("deny", "Zoë Müller", "PERSON"), ("deny", "straße-corp", "ORG"),
    )
    rows = [(i % 3, i, " ".join(x)) for i, x in enumerate(lists)]
    segs = spark.createDataFrame(rows, "conv_id bigint, seg_no bigint, text string")
    red, vault = maskweave.redact(segs, policy)
    back = maskweave.restore(red.select("conv_id", "seg_no", F.col("redacted").alias("text")), vault)
    got = {r.seg_no: r.restored for r in back.collect()}
    assert got == {i: t for _, i, t in rows}
    hidden = [r.redacted.lower() for r in red.collect()]
    assert not any(t in h for h in hidden for t in ("cartalian", "project loki", "zoë müller"))
    assert maskweave.audit(red, policy, ["seg_no"]).where("reason is not null").count() == 0


def test_allow_list_leaves_text_alone(spark, make_policy):
    for many in (False, True):
        policy = make_policy(("deny", "Adit", "ORG"), ("allow", "adit", ""))
        df = spark.createDataFrame([(1, "Adit pinged us.")], "id int, text string")
        out = DD.with_dictionary_spans(df, policy, key=["id"], out="spans")
        from maskweave.operators.policy import drop_allowed

        kept = drop_allowed(out, policy, ["id"], max_terms=0 if many else 10)
        assert kept.select(F.size("spans")).first()[0] == 0


def test_dictionary_at_the_same_start_beats_a_longer_email(spark, make_policy):
    policy = make_policy(("deny", "daniel", "PERSON"))
    segs = spark.createDataFrame([(1, 0, "daniel.pratt@x.com")], "conv_id bigint, seg_no bigint, text string")
    red, _ = maskweave.redact(segs, policy)
    assert red.first().redacted == "<<PERSON_1>>.pratt@x.com"

"""Inputs that once gave wrong results or crashed."""

import glob
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import maskweave
from maskweave.functions import spans
from maskweave.operators import bodies, delta, dictionary, model, score, vault
from maskweave.operators.detect import detect_patterns
from maskweave.operators.policy import drop_allowed
from maskweave.sources import policy_store as PS
from maskweave.sources import sinks
from maskweave.streaming import batch_restore, redact, restore

EDGES = ["Ann", "A😀B", "²x", "x²", "_a", "a_", "Ä", "ß", "é", "क्", "é"]
AROUND = ["²", "́", "‿", "😀", "Ⓐ", "a", "1", "_", "-", " ", ".", "‍", "é", "İ", ""]


def spans_of(df, **how):
    rows = dictionary.with_dictionary_spans(df, **how).collect()
    return [[(s.start, s.end, s.label) for s in r.dictionary_spans] for r in rows]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*EDGES, *AROUND]), min_size=1, max_size=8), min_size=20, max_size=40))
def test_every_policy_size_finds_the_same(spark, make_policy, texts):
    df = spark.createDataFrame([("".join(t),) for t in texts], "text string").coalesce(1)
    policy = make_policy(*[("deny", e, f"L{n}", {"whole_word": n % 3 != 0}) for n, e in enumerate(EDGES)])
    few = spans_of(df, policy=policy)
    assert few == spans_of(df, policy=policy, max_forms=0)
    assert few == spans_of(df, policy=policy, max_forms=0, chunk_bytes=600, chunks=True)
    joined = dictionary.with_dictionary_spans(df, policy, max_forms=0, chunk_bytes=0).collect()
    by_text = {r.text: [(s.start, s.end, s.label) for s in r.dictionary_spans] for r in joined}
    assert len(joined) == len(few) and few == [by_text["".join(t)] for t in texts]


def test_probed_word_edges(spark, make_policy):
    policy = make_policy(("deny", "Ann", "P", {"whole_word": True}), ("deny", "A😀B", "Q", {"whole_word": True}))
    texts = ["Ann²", "A😀B hi", "Anń", "Ann‿b", "xA😀B", "(Ann)"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = [[(0, 3, "P")], [(0, 3, "Q")], [], [], [], [(1, 4, "P")]]
    assert spans_of(df, policy=policy) == spans_of(df, policy=policy, max_forms=0) == want


def test_term_of_many_scopes_is_cut_into_chunks(spark, make_policy):
    policy = make_policy(*[("deny", "Loki", "P", {"scope": f"s{n}"}) for n in range(300)])
    handles = list(dictionary._chunk_handles(
        dictionary.hidden_forms(policy).select(*dictionary.FORM_COLUMNS), 60_000, 10_000))
    assert len(handles) > 3
    df = spark.createDataFrame([("Loki", "s7"), ("Loki", "other")], "text string, who string").coalesce(1)
    for chunks in (True, False):
        found = spans_of(df, policy=policy, scope="who", max_forms=0, chunk_bytes=10_000, chunks=chunks)
        assert sorted(found) == [[], [(0, 4, "P")]]


def test_stream_with_many_allowed_terms_and_chunks(spark, make_policy, tmp_path, monkeypatch):
    monkeypatch.setattr(dictionary, "MAX_PATTERN_FORMS", 0)
    monkeypatch.setattr(dictionary.with_dictionary_spans, "__defaults__", ("text", None, "dictionary_spans", None, 0, 4000, False))
    policy = make_policy(
        *[("deny", f"term{n}xyz", "T") for n in range(60)],
        *[("allow", f"term{n}xyz", "") for n in range(50, 60)],
        *[("allow", f"other{n}", "") for n in range(501)],
    )
    src = str(tmp_path / "in")
    rows = [(0, "hello term1xyz"), (0, "hello term55xyz"), (1, "a long text before term2xyz")]
    spark.createDataFrame(rows, "seg_no bigint, text string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("seg_no bigint, text string").parquet(src)
    q = redact.redacted_stream(stream, policy).writeStream.format("memory").queryName("edge").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = sorted(r.redacted for r in spark.table("edge").collect())
    assert got == ["a long text before <<T_1>>", "hello <<T_1>>", "hello term55xyz"]


def test_allow_list_paths_agree(spark, make_policy):
    policy = make_policy(("allow", "Acme", "", {"scope": "a"}), ("allow", "Beta", ""))
    span = "struct<start:bigint,end:bigint,label:string,source:string,score:double,value:string>"
    rows = [(s, [(0, 1, "X", "regex", 0.0, v) for v in ("ACME", "beta", "Gamma")]) for s in ("a", "A", "b", None)]
    df = spark.createDataFrame([*rows, ("a", []), ("a", None)], f"who string, spans array<{span}>").coalesce(1)
    paths = [
        [None if r.spans is None else [s.value for s in r.spans] for r in drop_allowed(df, policy, ["who"], scope="who", max_terms=n).collect()]
        for n in (500, 0)
    ]
    assert paths[0] == paths[1] == [["Gamma"], ["Gamma"], ["ACME", "Gamma"], ["Gamma"], [], None]


def test_long_texts(spark):
    texts = ["a-" * 200_000, "word " * 400_000, " ".join(f"u{n}@h.example" for n in range(50_000))]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id int, text string")
    words = model.with_words(df.where("id < 2")).select("id", F.size("words").alias("n"))
    start = time.time()
    assert {r.id: r.n for r in words.collect()} == {0: 2, 1: 400_000}
    assert time.time() - start < 60
    start = time.time()
    found = detect_patterns(df.where("id = 2"))
    assert found.select(F.size("spans").alias("n")).first().n == 50_000
    assert time.time() - start < 60
    cuts = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("#").alias("placeholder")))
    done = spans.settled(spans.settled(found, {"cuts": cuts}), {"red": spans.applied("text", "cuts")})
    assert done.select("red").first().red == " ".join(["#"] * 50_000)
    assert time.time() - start < 90


def test_many_distinct_values_in_one_row(spark):
    text = " ".join(f"u{n % 15_000}@h.example 10.0.0.{n % 250}" for n in range(20_000))
    df = spark.createDataFrame([(1, text), (2, "none"), (3, "a@b.example a@b.example")], "id int, text string")
    start = time.time()
    rows = {r.id: r for r in vault.redact_rows(detect_patterns(df)).collect()}
    assert time.time() - start < 60
    assert [(v.label, v.n) for v in rows[1].vault[:3]] == [("EMAIL", 1), ("IP", 1), ("EMAIL", 2)]
    assert len(rows[1].vault) == 15_250 and rows[1].redacted.endswith("<<EMAIL_5000>> <<IP_250>>")
    assert rows[2].redacted == "none" and rows[2].vault == []
    assert rows[3].redacted == "<<EMAIL_1>> <<EMAIL_1>>"


def test_clean_table_holds_only_what_is_named(spark, make_policy, tmp_path):
    segs = spark.createDataFrame(
        [("r1", 1, 0, "mail a@b.com", "k1"), ("r1", 1, 1, "about Loki <<", "k2")],
        "req_id string, conv_id bigint, seg_no bigint, text string, note string",
    )
    red, _ = maskweave.redact(segs, make_policy(("deny", "Loki", "P")), ["req_id", "conv_id"])
    assert "text" not in red.columns
    checked = maskweave.audit(red, make_policy(("deny", "mail", "P")), ["conv_id", "seg_no"])
    clean, held = str(tmp_path / "clean"), str(tmp_path / "held")
    key = ["req_id", "conv_id", "seg_no"]
    sinks.write_corpus(checked, clean, held, key, ["redacted"])
    assert set(spark.read.parquet(clean).columns) == {*key, "redacted"}
    kept = spark.read.parquet(held)
    assert set(kept.columns) == {*key, "reason"} and [r.req_id for r in kept.collect()] == ["r1"]
    for path in glob.glob(str(tmp_path / "**/*.parquet"), recursive=True):
        with open(path, "rb") as f:
            data = f.read()
        assert b"a@b.com" not in data and b"Loki" not in data
    with pytest.raises(ValueError, match="text"):
        sinks.write_corpus(checked.withColumn("text", F.lit("x")), clean, held, key, ["text"])


def test_requests_of_one_conversation(spark, tmp_path):
    root, policy = str(tmp_path / "out"), str(tmp_path / "policy")
    schema = "req_id string, conv_id bigint, seg_no bigint, text string"
    job = redact.RedactionJob(policy, root, request="req_id")
    job(spark.createDataFrame([
        ("r1", 1, 0, "mail a@b.com now"), ("r2", 1, 0, "mail a@b.com now"), ("r2", 1, 1, "and c@d.com"),
        ("r2", 1, 1, "and c@d.com"), ("r2", 1, 2, None),
    ], schema), 0)
    job(spark.createDataFrame([("r3", 1, 0, "c@d.com first, a@b.com next")], schema), 1)
    out = {(r.req_id, r.seg_no): r.redacted for r in spark.read.parquet(root + "/redacted").collect()}
    assert out == {
        ("r1", 0): "mail <<EMAIL_1>> now", ("r2", 0): "mail <<EMAIL_1>> now", ("r2", 1): "and <<EMAIL_2>>",
        ("r2", 2): "", ("r3", 0): "<<EMAIL_1>> first, <<EMAIL_2>> next",
    }
    src, done = str(tmp_path / "chunks"), str(tmp_path / "done")
    spark.createDataFrame(
        [(1, "r1", "c", 0, "to <<EMAIL_1>>", True), (1, "r3", "c", 0, "to <<EMAIL_", False), (1, "r3", "c", 1, "1>>", True)],
        restore.CHUNK_SCHEMA,
    ).coalesce(1).write.parquet(src)
    chunks = spark.readStream.schema(restore.CHUNK_SCHEMA).parquet(src)
    q = restore.write_restored(chunks, root + "/vault", done, str(tmp_path / "cp"), request="req_id")
    q.awaitTermination(120)
    assert q.exception() is None
    rows = sorted((r.stream_id, r.chunk_no, r.restored) for r in spark.read.parquet(done + "/batch=*").collect())
    assert rows == [("r1", 0, "to a@b.com"), ("r3", 0, "to "), ("r3", 1, "c@d.com")]


def test_a_name_with_two_values_is_not_restored(spark):
    texts = spark.createDataFrame([(1, 0, "<<A_1>> <<B_1>>")], "conv_id int, seg_no int, text string")
    names = spark.createDataFrame([(1, "A_1", "x"), (1, "A_1", "y"), (1, "B_1", "z"), (1, "B_1", "z")], "conv_id int, inner string, real string")
    assert vault.restore_by_join(texts, names).first().restored == "<<A_1>> z"


def test_sealing_binds_each_part(spark):
    df = spark.createDataFrame([("a|b", "c", "v"), ("n", None, "v")], "x string, y string, real string")
    sealed = vault.seal(df, "real", b"k" * 16, ["x", "y"])
    moved = sealed.withColumns({"x": F.lit("a"), "y": F.lit("b|c")}).limit(1)
    assert vault.unseal(moved, "real", b"k" * 16, ["x", "y"], strict=False).first().real is None
    nulled = sealed.where("x = 'n'").withColumn("y", F.lit(""))
    assert vault.unseal(nulled, "real", b"k" * 16, ["x", "y"], strict=False).first().real is None
    assert {r.real for r in vault.unseal(sealed, "real", b"k" * 16, ["x", "y"]).collect()} == {"v"}


def test_delta_scan_loses_and_doubles_nothing(spark):
    segs = delta.with_hash(spark.createDataFrame([(1, None), (2, "a@b.com"), (3, "a@b.com"), (4, "x")], "id int, text string"))
    h = {r.id: r.seg_hash for r in segs.collect()}
    cache = spark.createDataFrame([(h[4], "v", []), (h[4], "v", []), (h[2], "old", [])], delta.CACHE_SCHEMA)
    out, new = delta.delta_scan(segs, cache, "v", detect_patterns)
    rows = {r.id: (len(r.spans), r.hit) for r in out.collect()}
    assert out.count() == 4 and rows == {1: (0, False), 2: (1, False), 3: (1, False), 4: (0, True)}
    assert new.count() == 2


def test_label_scores_skip_broken_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [3.0, 0.0]), (4, [1.0]), (5, [None, 1.0])], "id int, embedding array<double>")
    labels = spark.createDataFrame([("x", [1.0, 0.0])], "label string, vector array<double>")
    got = {r.id: r.logit for r in model.label_scores(items, labels, "id").collect()}
    assert got == {1: 1.0, 3: 3.0}


def test_plugin_is_one_detector_for_every_plan():
    plugin = model.DetectorPlugin("p", list)
    assert model._tag(plugin) == model._tag(plugin)


def test_presets(spark):
    table = spark.createDataFrame([(f"p{n}", None, 0.0 if n == 7 else None) for n in range(1500)], "name string, labels array<string>, threshold double")
    assert score.choose_preset(table, "p1400") == (None, 0.5)
    assert score.choose_preset(table, "p7") == (None, 0.0)
    with pytest.raises(ValueError, match="unknown preset"):
        score.choose_preset(table, "none")
    spans = spark.createDataFrame([("p7", "A", 0.1), ("p8", "A", 0.6), ("p8", "A", 0.4)], "preset string, label string, score double")
    assert score.preset_filter(spans, table).count() == 2
    assert score.preset_filter(spans, table, override=7.0).count() == 2
    with pytest.raises(Exception, match="unknown preset"):
        score.preset_filter(spans.withColumn("preset", F.lit("zz")), table).collect()


@pytest.mark.parametrize("ends,want", [
    ([True, False], ["x <<", "y"]),
    ([False, True], ["x ", "<<y"]),
    ([False, False], ["x ", "<<y"]),
    ([True, True], ["x <<", "y"]),
])
def test_every_kind_of_stream_end(spark, ends, want):
    df = spark.createDataFrame([(1, 0, "x <<", ends[0]), (1, 1, "y", ends[1])], "sid int, chunk_no bigint, text string, is_end boolean")
    rows = batch_restore.emitted_chunks(df, ["sid"], is_end="is_end").orderBy("chunk_no").collect()
    assert [r.emitted for r in rows] == want


def test_bodies_that_cannot_be_walked(spark):
    good = '{"messages":[{"role":"user","content":"hi [[[[ \\" {"}]}'
    cases = [(1, good), (2, good[:-3]), (3, "[" * 200_000), (4, '{"a":1}'), (5, None), (6, '{"messages":' + "[" * 300 + "]" * 300 + "}")]
    df = spark.createDataFrame(cases, "id int, body string")
    reasons = {r.id: r.reason for r in bodies.with_body_reason(df, shape="chat").collect()}
    assert reasons == {1: None, 2: "unreadable_body", 3: "body_too_deep", 4: "unreadable_body", 5: "unreadable_body", 6: "body_too_deep"}
    segs = bodies.extract_segments(df, "chat", "id")
    assert [(r.id, r.text) for r in segs.collect()] == [(1, 'hi [[[[ " {')]
    rebuilt = bodies.rebuild_bodies(df, segs.withColumn("redacted", F.lit("X")), "chat", ["id"])
    got = {r.id: r.rebuilt for r in rebuilt.collect()}
    assert '"content":"X"' in got[1] and got[2] is None and got[3] is None
    assert bodies.json_leaves(df, "id").where("id = 3").count() == 0


def test_stored_policy_and_log(spark, make_policy, tmp_path):
    base = make_policy(("deny", "Acme", "ORG", {"aliases": ["ACM"]}), ("deny", "Beta", "ORG"), ("allow", "ok", ""))
    log = str(tmp_path / "log")
    assert PS.current(spark, log, base).count() == 3
    PS.teach(spark, log, "acme", "CLIENT", whole_word=True)
    PS.teach(spark, log, "Loki", "PROJECT")
    PS.unteach(spark, log, "BETA")
    rows = PS.current(spark, log, base).orderBy("ord").collect()
    deny = [(r.term, r.label, r.aliases, r.whole_word) for r in rows if r.list == "deny"]
    assert deny == [("Acme", "CLIENT", ["ACM"], True), ("Loki", "PROJECT", [], False)]
    assert [r.term for r in rows if r.list == "allow"] == ["ok"]
    PS.unteach(spark, log, "acme")
    PS.teach(spark, log, "acme", "ORG")
    again = {r.term: r.aliases for r in PS.current(spark, log, base).where("list = 'deny'").collect()}
    assert again == {"acme": [], "Loki": []}


def test_taught_term_reaches_the_running_job(spark, make_policy, tmp_path):
    store, log, root = (str(tmp_path / x) for x in ("store", "log", "out"))
    PS.publish(make_policy(("deny", "Acme", "ORG"), ("allow", "Beta", "")), store, 1)
    job = redact.RedactionJob(store, root, log_path=log)
    rows = spark.createDataFrame([(1, 0, "Acme met Loki")], "conv_id bigint, seg_no bigint, text string")
    job(rows, 0)
    PS.teach(spark, log, "Loki", "PROJECT")
    job(rows, 1)
    out = [r.redacted for r in spark.read.parquet(root + "/redacted").orderBy("batch").collect()]
    assert out == ["<<ORG_1>> met Loki", "<<ORG_1>> met <<PROJECT_1>>"]

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskweave.functions import spans as S
from maskweave.operators import bodies as B
from maskweave.operators import metrics as MT
from maskweave.operators import model as M
from maskweave.operators import score as SC
from maskweave.operators.ranking import first_n_per_key, numbered

SPAN = "id int, start bigint, end bigint"


def scored(spark, docs, gold, pred):
    base = spark.createDataFrame(docs, "id int, task string, n_chars bigint")
    per = SC.overlap_chars(
        base, spark.createDataFrame(gold, SPAN), spark.createDataFrame(pred, SPAN), ["id"]
    )
    return SC.masking_score(per, "task").first()


@pytest.mark.parametrize(
    "gold,pred,want",
    [
        ([(0, 3)], [(1, 4)], (2 / 3, 2 / 3, 2 / 3, 2 / 3, 1 / 7)),
        ([(2, 5)], [(2, 5)], (1, 1, 1, 1, 0)),
        ([], [(0, 2)], (0, 0, 0, 0, 0.2)),
        ([(0, 4)], [], (0, 0, 0, 0, 0)),
        ([(0, 3), (3, 6)], [(0, 6)], (1, 1, 1, 1, 0)),
        ([(0, 6)], [(0, 4), (2, 6)], (1, 1, 1, 1, 0)),
        ([(0, 10)], [(0, 99)], (1, 1, 1, 1, 0)),
    ],
)
def test_known_scores(spark, gold, pred, want):
    r = scored(spark, [(1, "t", 10)], [(1, *x) for x in gold], [(1, *x) for x in pred])
    assert (r.precision, r.recall, r.f1, r.f2, r.fpr) == pytest.approx(want)


def test_overlap_in_rows_counts_as_sets_do(spark):
    import random

    rng = random.Random(4)
    rows, want = [], {}
    for i in range(60):
        n = rng.choice([0, 5, 40])
        sides = [[(a, a + rng.randint(-2, 9)) for a in rng.choices(range(-5, 45), k=rng.randint(0, 6))] for _ in "gp"]
        g, p = ({c for a, b in side for c in range(max(a, 0), min(b, n))} for side in sides)
        rows.append((i, n, *sides))
        want[i] = (len(g & p), len(g), len(p), n - len(g))
    span = "array<struct<start:bigint,end:bigint>>"
    df = spark.createDataFrame([*rows, (60, 3, None, [])], f"id int, n_chars bigint, gold {span}, pred {span}")
    out = SC.overlap_in_rows(df, ["id"], [], "gold", "pred")
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == {**want, 60: (0, 0, 0, 3)}
    plan = SC.masking_score(out, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_micro_average(spark):
    r = scored(spark, [(1, "t", 10), (2, "t", 10)], [(1, 0, 4), (2, 0, 1)], [(1, 0, 4)])
    assert (r.precision, r.recall) == pytest.approx((1.0, 0.8))


def test_published_sums_give_published_rates(spark):
    # Character sums and rates of the public benchmark run.
    rows = [
        ("t1", 38923, 42866, 51497, 149975, 0.7558, 0.9080, 0.8250, 0.8729, 0.0838),
        ("t2", 27363, 28954, 30843, 79647, 0.8872, 0.9451, 0.9152, 0.9329, 0.0437),
        ("t3", 14820, 16928, 19660, 107656, 0.7538, 0.8755, 0.8101, 0.8481, 0.0450),
        ("t4", 32168, 39100, 101750, 516090, 0.3161, 0.8227, 0.4568, 0.6230, 0.1348),
    ]
    cols = "task string, tp_chars bigint, gold_chars bigint, pred_chars bigint, nonpii_chars bigint"
    got = SC.rates(spark.createDataFrame([r[:5] for r in rows], cols))
    for want, r in zip(rows, got.orderBy("task").collect()):
        assert (r.precision, r.recall, r.f1, r.f2, r.fpr) == pytest.approx(want[5:], abs=5e-5)
    macro = SC.masking_score_macro(got, 4).first()
    assert (macro.avg_f2, macro.avg_f1, macro.avg_precision, macro.avg_recall) == pytest.approx(
        (0.8192, 0.7518, 0.6782, 0.8878), abs=5e-5
    )
    assert macro.complete


@pytest.mark.parametrize(
    "spans,want",
    [
        ([(5, 7), (0, 3)], [(0, 3), (5, 7)]),
        ([(0, 3), (3, 6)], [(0, 6)]),
        ([(0, 5), (2, 8)], [(0, 8)]),
        ([(4, 4)], []),
        ([(0, 9), (1, 2), (3, 4), (9, 10)], [(0, 10)]),
    ],
)
def test_merge_intervals(spark, spans, want):
    out = SC.merge_intervals(spark.createDataFrame([(1, *s) for s in spans], SPAN), ["id"])
    assert sorted((r.start, r.end) for r in out.collect()) == want


def test_presets(spark):
    presets = SC.preset_table(spark)
    assert SC.choose_preset(presets, "recall") == (None, 0.3)
    assert SC.choose_preset(presets, "recall", " a, ,b ", 0.9) == (["a", "b"], 0.9)
    assert SC.choose_preset(presets, "small", threshold=1.5)[1] == 0.4
    with pytest.raises(ValueError, match="general, precision, recall, small"):
        SC.choose_preset(presets, "huge")


def test_sampling_is_stable_and_whole_when_not_limited(spark):
    df = spark.range(500).select(F.col("id").alias("uid"), (F.col("id") % 2).alias("task"))
    a = SC.sample_per_task(df, "task", "uid", 7)
    assert {r.task: r.n for r in a.groupBy("task").agg(F.count("*").alias("n")).collect()} == {0: 7, 1: 7}
    b = SC.sample_per_task(df.repartition(7), "task", "uid", 7)
    assert sorted(a.collect()) == sorted(b.collect())
    assert SC.sample_per_task(df, "task", "uid", 0).count() == 500
    assert first_n_per_key(df, ["task"], [F.col("uid")], 3).agg(F.max("uid")).first()[0] == 5


def test_numbering_in_blocks(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("pos"))
    out = numbered(df, ["k"], F.floor(F.col("pos") / 64), ["pos"])
    assert out.where(F.col("n") != F.col("pos") + 1).count() == 0


# --- model side --------------------------------------------------------------------------------


def test_words_keep_offsets(spark):
    texts = ["mail dana@example.com or see https://example.com/x", "İİİ met Daniel Pratt", " a-b_c d! "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = M.word_tokens(df, "id").collect()
    words = {i: [r.word for r in sorted(rows) if r.id == i] for i in range(3)}
    assert words[0] == ["mail", "dana@example.com", "or", "see", "https://example.com/x"]
    assert words[1] == ["İİİ", "met", "Daniel", "Pratt"]
    assert words[2] == ["a-b_c", "d", "!"]
    assert all(texts[r.id][r.start : r.end] == r.word for r in rows)


def test_candidates(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "")], "id int, text string")
    rows = M.candidate_spans(df, "id", max_width=3).collect()
    want = [(i, j) for i in range(4) for j in range(i, min(i + 3, 4))]
    assert sorted((r.first_word, r.last_word) for r in rows) == want
    assert all((r.start, r.end) == (2 * r.first_word, 2 * r.last_word + 1) for r in rows)


def test_label_scores_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "LABELS_PER_CHUNK", 2)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 4)), rng.normal(size=(5, 4)) * 300
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
    labels = spark.createDataFrame([(f"l{i}", v.tolist()) for i, v in enumerate(y)], "label string, vector array<double>")
    got = M.label_scores(items, labels, "id", threshold=0.5).collect()
    with np.errstate(over="ignore"):
        want = 1 / (1 + np.exp(-(x @ y.T)))
    assert {(r.id, r.label) for r in got} == {(i, f"l{j}") for i, j in np.argwhere(want >= 0.5)}
    assert all(abs(r.score - want[r.id, int(r.label[1:])]) < 1e-9 for r in got)


def test_nms_keeps_other_labels(spark):
    found = [(0, 5, "A", "m", 0.5, ""), (3, 8, "A", "m", 0.9, ""), (4, 6, "B", "m", 0.1, ""), (5, 6, "A", "m", 0.5, "")]
    df = spark.createDataFrame([(found,)], f"spans {S.SPANS_TYPE}")
    out = df.select(S.suppressed("spans")).first()[0]
    assert [(s.start, s.end, s.label) for s in out] == [(3, 8, "A"), (4, 6, "B")]


def plain_nms(spans):
    """Every kept span compared with every other."""
    kept = []
    for s in sorted(range(len(spans)), key=lambda i: (-spans[i][4], i)):
        a, b, label = spans[s][:3]
        if not any(k[2] == label and a < k[1] and b > k[0] for k in kept):
            kept.append(spans[s])
    return [k[:3] for k in kept]


@pytest.mark.parametrize("seed", range(3))
def test_nms_against_all_pairs(spark, seed):
    import random

    rng = random.Random(seed)
    found = []
    for _ in range(300):
        a = rng.randrange(60)
        found.append((a, a + rng.choice([0, 1, 3, 9]), rng.choice("AB"), "m", rng.randrange(20) / 20, ""))
    df = spark.createDataFrame([(found,), ([],), (None,)], f"spans {S.SPANS_TYPE}")
    out = [r[0] for r in df.select(S.suppressed("spans")).collect()]
    assert [(s.start, s.end, s.label) for s in out[0]] == plain_nms(found)
    assert out[1] == [] and out[2] is None


def test_nms_of_odd_spans(spark):
    found = [
        (0, 5, "A", "m", None, ""), (1, 2, "A", "m", 9.0, ""), (1, 2, None, "m", 0.1, ""), (None, 2, "A", "m", 0.1, ""),
        (9, 3, "A", "m", 0.1, ""), (0, 9, "A", "m", float("nan"), ""), (5, 6, "A", "m", float("nan"), ""),
    ]
    df = spark.createDataFrame([(found,)], f"spans {S.SPANS_TYPE}")
    out = df.select(S.suppressed("spans")).first()[0]
    assert [(s.start, s.end) for s in out] == [(0, 5), (1, 2), (None, 2), (9, 3), (5, 6)]


def test_nms_of_fifty_thousand_spans(spark):
    import time

    one = "named_struct('start', i * 2, 'end', i * 2 + 3, 'label', 'A', 'source', 'm', 'score', 1.0D / (1 + i % 977), 'value', '')"
    df = spark.range(1).select(F.expr(f"transform(sequence(0L, 49999L), i -> {one})").alias("spans"))
    df.select(F.size(S.suppressed("spans"))).collect()
    start = time.time()
    n = df.select(F.size(S.suppressed("spans"))).first()[0]
    assert 20_000 < n < 50_000 and time.time() - start < 5


def test_plugin_output_of_any_kind_stays_with_its_text(spark):
    answers = {
        "ok": [(0, 2, "A", 0.9)], "short": [(1,)], "null start": [(None, 1, "A", 0.5)], "strings": [("0", "1", "A", 0.5)],
        "not a list": 7, "nan": [(0, 1, "A", float("nan"))], "label": [(0, 1, None, 0.5)], "huge": [(0, 1 << 70, "A", 1.0)],
        "generator": None,
    }
    bad = {"short", "null start", "strings", "not a list", "nan", "label", "huge"}

    def one():
        def detect(text):
            if text == "boom":
                raise MemoryError
            return ((0, 1, "G", 1.0) for _ in range(1)) if text == "generator" else answers[text]

        return detect

    def many():
        def detect(texts):
            assert len(texts) <= 4
            return [one()(t) for t in texts]

        return detect

    rows = [(i, t) for i, t in enumerate([*answers, "boom", "", "ok"])]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    for load, size in ((one, None), (many, 4), (many, 1)):
        for byte_offsets in (False, True):
            plugin = M.DetectorPlugin("p", load, byte_offsets=byte_offsets, batch=size)
            out = {r.id: r for r in M.with_plugin_spans(df, plugin).collect()}
            assert {t for i, t in rows if out[i].failed} == bad | {"boom"}
            assert {t: len(out[i].plugin_spans) for i, t in rows if out[i].plugin_spans} == {"ok": 1, "generator": 1}


def test_plugin_boundaries_and_failures(spark):
    def load():
        def detect(text):
            if text == "bad":
                raise RuntimeError
            return [(1, 4, "person", 0.9), (50, 60, "x", 0.9), (0, 1, "low", 0.1)]

        return detect

    plugin = M.DetectorPlugin("p", load, byte_offsets=True, threshold=0.5)
    df = spark.createDataFrame([(1, "é€x"), (2, "bad"), (3, "  ")], "id int, text string")
    out = M.with_plugin_spans(df, plugin)
    got = {r.id: ([(s.start, s.end) for s in r.plugin_spans], r.failed) for r in out.collect()}
    assert got == {1: ([(0, 2)], False), 2: ([], True), 3: ([], False)}
    assert M.detector_failures(out).first().failures == 1


# --- bodies ---------------------------------------------------------------------------------------

CHAT = (
    '{"model":"m","stream":true,"messages":[{"role":"user","name":"n","content":"one"},'
    '{"role":"user","content":[{"type":"text","text":"two"},{"type":"image_url","image_url":{"url":"u"}},'
    '{"input_text":"three","output_text":"four"}]},{"role":"assistant","content":null,"tool_calls":'
    '[{"id":"c","function":{"name":"f","arguments":"{\\"q\\":1}"}}]},{"content":5},7]}'
)
BLOCKS = (
    '{"system":[{"type":"text","text":"sys"},{"type":"x","text":"no"}],"messages":[{"content":"m0"},'
    '{"content":[{"type":"text","text":"t"},{"type":"thinking","thinking":"no"},'
    '{"type":"tool_result","content":[{"type":"text","text":"r"},{"type":"tool_result","content":"deep"}]},'
    '{"type":"tool_use","input":{"b":"2","a":["1",{"z":3}],"n":null}}]}]}'
)


def texts(spark, body, shape):
    df = spark.createDataFrame([(1, body)], "id int, body string")
    return [r.text for r in B.extract_segments(df, shape, "id").orderBy("seg_no").collect()]


def test_walks(spark):
    assert texts(spark, CHAT, "chat") == ["one", "two", "three", "four", '{"q":1}']
    assert texts(spark, BLOCKS, "blocks") == ["sys", "m0", "t", "r", "deep", "1", "2"]
    assert texts(spark, "not json", "chat") == [] and texts(spark, "[1]", "blocks") == []


@pytest.mark.parametrize("body,shape", [(CHAT, "chat"), (BLOCKS, "blocks")])
def test_rebuild_keeps_other_fields(spark, body, shape):
    import json

    df = spark.createDataFrame([(1, body)], "id int, body string")
    segs = B.extract_segments(df, shape, "id")
    same = B.rebuild_bodies(df, segs.withColumnRenamed("text", "redacted"), shape, ["id"]).first().rebuilt
    assert json.loads(same) == json.loads(body)
    marked = segs.withColumn("redacted", F.concat(F.lit("#"), F.col("seg_no").cast("string")))
    out = B.rebuild_bodies(df, marked, shape, ["id"]).select("id", F.col("rebuilt").alias("body"))
    n = segs.count()
    assert [r.text for r in B.extract_segments(out, shape, "id").orderBy("seg_no").collect()] == [
        f"#{i}" for i in range(n)
    ]


def test_leaves(spark):
    df = spark.createDataFrame([(1, '{"b":[{"c":"x"}],"a":"y","d":1}')], "id int, body string")
    assert [(r.path, r.value) for r in B.json_leaves(df, "id").orderBy("leaf_no").collect()] == [
        ("$.a", "y"), ("$.b[0].c", "x"),
    ]
    both = [r.value for r in B.json_leaves(df, "id", with_keys=True).orderBy("leaf_no").collect()]
    assert both == ["a", "y", "b", "c", "x", "d"]


def test_strings_of_any_json():
    import json
    import random

    rng = random.Random(8)

    def tree(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["x", 'q"\\', "é\n", 1, -2.5e3, True, None, "", "{[,:"])
        if kind < 0.6:
            return [tree(depth - 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice(["a", "b c", "é", "Z", ""]): tree(depth - 1) for _ in range(rng.randint(0, 4))}

    for n in range(200):
        value = tree(5)
        raw = json.dumps(value, indent=rng.choice([None, 1]), ensure_ascii=n % 2 == 0)
        for keys in (False, True):
            want: list = []
            B._on_strings(value, "$", lambda p, v: want.append((p, v)) or v, (lambda p, k: want.append((p, k))) if keys else None)
            assert B.strings_of(raw, keys) == want
    assert B.strings_of('{"a":{"x":"1"},"b":"2","a":["3"]}') == [("$.a[0]", "3"), ("$.b", "2")]
    assert len(B.strings_of("[" * 100_000 + '"deep"' + "]" * 100_000)) == 1
    for bad in ("", "[", "]", "{", '{"a"}', '{"a":}', "[1,]", "[,1]", "[1 2]", '"a" "b"', "{1:2}", "nope", "[1}", '{"a":1]', '"\n"', "01"):
        with pytest.raises(ValueError):
            B.strings_of(bad)


def test_json_strings_by_lateral_join(spark):
    rows = [(1, '{"b":["x"],"a":"y"}', "z"), (2, "nope", "z"), (3, None, "z"), (4, "[]", "z"), (4, '"s"', "z")]
    df = spark.createDataFrame(rows, "id int, body string, path string")
    got = sorted(tuple(r) for r in B.json_strings(df, "id", with_keys=True).collect())
    assert got == [(1, 0, "$.a", "a"), (1, 1, "$.a", "y"), (1, 2, "$.b", "b"), (1, 3, "$.b[0]", "x"), (4, 0, "$", "s")]


def test_chat_bodies_need_no_python(spark):
    df = spark.createDataFrame([(1, CHAT)], "id int, body string")
    segs = B.extract_segments(df, "chat", "id")
    again = B.rebuild_bodies(df, segs.withColumnRenamed("text", "redacted"), "chat", ["id"])
    for rows in (segs, again, B.with_body_reason(df, shape="chat")):
        assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_chat_bodies_that_look_like_one_value(spark):
    odd = [CHAT + " x", CHAT + "]", CHAT + "}", CHAT + ",{}", CHAT + "],[", CHAT + "},{", CHAT + "}],[{", "\n " + CHAT + " \t"]
    odd += ['{"messages":[]}', '{"messages":{}}', "[]", "7", '{"messages":[{"content":1.5}]}', '{"messages":[{"content":"a","content":"b"}]}']
    df = spark.createDataFrame(list(enumerate(odd)), "id int, body string")
    good = {r.id for r in B.with_body_reason(df, shape="chat").where("reason IS NULL").collect()}
    assert good == {7, 8, 12}
    assert {r.id for r in B.extract_segments(df, "chat", "id").collect()} == {7}


# --- counters ----------------------------------------------------------------------------------------


def test_counters(spark):
    df = spark.range(64 * 3).select(F.concat(F.lit("label"), "id").alias("l"), "id")
    rows = MT.capped_counts(df, F.col("l"), F.col("id")).collect()
    assert len(rows) == 65 and {r.label: r.n for r in rows}["other"] == 128
    lat = spark.createDataFrame([("a", 0.03), ("a", 0.2), ("b", 500.0)], "r string, s double")
    got = {(r.r, r.le): r.n for r in MT.histogram(lat, "s", "r").collect()}
    assert got[("a", 0.05)] == 1 and got[("a", 0.25)] == 2 and got[("b", 120.0)] == 0 and got[("b", None)] == 1
    paths = spark.createDataFrame([("/v1/messages",), ("/wp-login.php",)], "p string")
    assert [r[0] for r in paths.select(MT.route(F.col("p"))).collect()] == ["anthropic", "other"]

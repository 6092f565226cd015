import json
import os
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskweave.operators.detect import detect_patterns
from maskweave.operators.metrics import windowed_counts
from maskweave.operators.model import DetectorPlugin
from maskweave.session import shared_dir
from maskweave.sources import policy_store as PS
from maskweave.sources import sinks
from maskweave.sources.tables import parse_lines
from maskweave.streaming import batch_restore as BR
from maskweave.streaming import redact as RD
from maskweave.streaming import restore as RS
from maskweave.streaming.carry import advance

PARTS = ["He works at ", "<<", "EMAIL", "_1", ">>", "<", ">", "ORG_1>>", "é€", "x" * 90, "<<ORG_1>>", "\n"]


def fold(chunks):
    held, out = "", []
    for c in chunks:
        ready, held = advance(held, c)
        out.append(ready)
    out[-1] += held
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=14))
def test_carry_loses_nothing_and_never_cuts_a_placeholder(chunks):
    out = fold(chunks)
    assert "".join(out) == "".join(chunks)
    whole = "".join(chunks)
    if len(whole) < 250:
        assert sum(p.count("<<ORG_1>>") for p in out) == whole.count("<<ORG_1>>")


def test_split_placeholder_and_giving_up():
    assert fold(["He works at <<EMAI", "L_1>>"]) == ["He works at ", "<<EMAIL_1>>"]
    assert advance("", "<<" + "x" * 300) == ("<<" + "x" * 300, "")
    assert advance("", "a<") == ("a", "<")


def test_batch_twin_equals_the_fold_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(BR, "BLOCK_CHARS", 300)
    monkeypatch.setattr(BR, "STREAMS_PER_ORDER_BLOCK", 8)
    rnd = random.Random(5)
    rows, want = [], {}
    for s in range(12):
        chunks = [rnd.choice(PARTS) for _ in range(60)]
        want.update({(s, i): t for i, t in enumerate(fold(chunks))})
        rows += [(s, i, t) for i, t in enumerate(chunks)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "sid int, chunk_no bigint, text string")
    got = {(r.sid, r.chunk_no): r.emitted for r in BR.emitted_chunks(df, ["sid"]).collect()}
    assert got == want
    flagged = df.withColumn("is_end", F.col("chunk_no") == 59)
    out = BR.emitted_chunks(flagged, ["sid"], is_end="is_end").collect()
    assert {(r.sid, r.chunk_no): r.emitted for r in out} == want


def write_chunks(spark, path, name, rows):
    df = spark.createDataFrame(rows, RS.CHUNK_SCHEMA)
    df.coalesce(1).write.parquet(os.path.join(path, name))


def test_stream_restores_chunks_that_arrive_out_of_order(spark, tmp_path):
    src, out, vault = (str(tmp_path / x) for x in ("in", "out", "vault"))
    spark.createDataFrame(
        [(1, "EMAIL_1", "daniel@example.com"), (2, "EMAIL_1", "other@example.com")],
        "conv_id bigint, inner string, real string",
    ).write.parquet(vault)
    write_chunks(spark, src, "b1", [
        (1, "s", "content", 1, "L_1>> ok", False),
        (2, "s", "content", 0, "<<EMAIL", False),
        (1, "s", "reasoning", 0, "think <", False),
    ])
    write_chunks(spark, src, "b2", [
        (1, "s", "content", 0, "at <<EMAI", False), (1, "s", "content", 1, "L_1>> ok", False),
        (2, "s", "content", 1, "_1>>", True), (1, "s", "reasoning", 1, "", True),
        (1, "s", "content", 2, " end <<", True),
    ])
    for batch in ("b1", "b2"):
        chunks = spark.readStream.schema(RS.CHUNK_SCHEMA).parquet(os.path.join(src, "{b1,%s}" % batch))
        q = RS.write_restored(chunks, vault, out, str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
    rows = spark.read.parquet(out + "/batch=*").collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.chunk_no):
        k = (r.conv_id, r.field)
        got[k] = got.get(k, "") + r.restored
    assert got == {
        (1, "content"): "at daniel@example.com ok end <<",
        (2, "content"): "other@example.com",
        (1, "reasoning"): "think <",
    }
    by_no = {r.chunk_no: r.restored for r in rows if (r.conv_id, r.field) == (1, "content")}
    assert by_no == {0: "at ", 1: "daniel@example.com ok", 2: " end <<"}


def state_rows(spark, checkpoint, name):
    reader = spark.read.format("statestore").option("stateVarName", name)
    return reader.load(checkpoint).count()


def test_state_is_gone_after_its_time_and_lost_chunks_are_told_from_late_ones(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = RS.CHUNK_SCHEMA
    write_chunks(spark, src, "b0", [(1, "s", "f", 0, "a <<EM", False), (2, "s", "f", 0, "done", True)])
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    got = []

    def keep(batch, n):
        got.extend(tuple(r) for r in batch.select("conv_id", "chunk_no", "piece", "emitted", "note").collect())

    q = (
        RS.carried(chunks, idle_ms=1500, ttl_ms=20_000).writeStream.foreachBatch(keep)
        .option("checkpointLocation", cp).trigger(processingTime="300 milliseconds").start()
    )

    def until(test, seconds=60):
        end = time.time() + seconds
        while not test() and time.time() < end:
            assert q.exception() is None
            time.sleep(0.2)
        assert test(), got

    try:
        until(lambda: (2, 0, 0, "done", None) in got)
        # Chunk 1 does not come: 2 waits, then goes out after the gap, and 1 is late.
        until(lambda: (1, 0, 1, "<<EM", None) in got)
        write_chunks(spark, src, "b1", [(1, "s", "f", 2, "c", False)])
        until(lambda: (1, 2, 0, "c", "after_gap") in got)
        write_chunks(spark, src, "b2", [(1, "s", "f", 1, "b", False), (1, "s", "f", 2, "c", False)])
        until(lambda: (1, 1, 0, "b", "late") in got)
        assert len({r[:3] for r in got}) == len(got)
        names = ("pending", "next_no", "early", "missing")
        assert state_rows(spark, cp, "next_no") > 0
        until(lambda: sum(state_rows(spark, cp, n) for n in names) == 0, 90)
    finally:
        q.stop()


def test_redaction_job_reloads_the_policy_and_caches_offsets(spark, tmp_path, make_policy):
    policy, root, src = (str(tmp_path / x) for x in ("policy", "out", "in"))
    schema = "conv_id bigint, seg_no bigint, text string"
    job = RD.RedactionJob(policy, root)

    def run(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{name}")
        stream = spark.readStream.schema(schema).parquet(f"{src}/*")
        q = (
            stream.writeStream.foreachBatch(job).option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
        assert q.exception() is None

    run("b0", [(1, 0, "Loki wrote a@b.com"), (1, 1, "Loki wrote a@b.com")])
    PS.publish(make_policy(("deny", "Loki", "PROJECT")), policy, 1)
    run("b1", [(2, 0, "Loki wrote a@b.com"), (2, 1, "plain")])
    out = spark.read.parquet(root + "/redacted")
    got = {(r.conv_id, r.seg_no): r.redacted for r in out.collect()}
    assert got == {
        (1, 0): "Loki wrote <<EMAIL_1>>", (1, 1): "Loki wrote <<EMAIL_1>>",
        (2, 0): "<<PROJECT_1>> wrote <<EMAIL_1>>", (2, 1): "plain",
    }
    cache = spark.read.parquet(root + "/cache")
    assert cache.groupBy("policy_version").count().count() == 2 and cache.count() == 3
    assert set(cache.columns) == {"seg_hash", "spans", "policy_version", "run", "bucket"}
    queue = spark.read.parquet(root + "/suggestions/batch=1").collect()
    assert [(r.term, r.last_seen.batch) for r in queue] == [("a@b.com", 1)]
    # Replaying a batch changes nothing.
    job(spark.createDataFrame([(2, 0, "Loki wrote a@b.com"), (2, 1, "plain")], schema), 1)
    assert spark.read.parquet(root + "/redacted").count() == 4


def test_redaction_job_with_a_plugin(spark, tmp_path, monkeypatch):
    policy, root = str(tmp_path / "policy"), str(tmp_path / "out")
    schema = "conv_id bigint, seg_no bigint, text string"
    fuse = tmp_path / "fuse"

    def load():
        def detect(texts):
            if any("Ann" in t for t in texts) and not fuse.exists():
                raise RuntimeError
            return [[(t.index("Ann"), t.index("Ann") + 3, "PERSON", 0.9)] if "Ann" in t else [] for t in texts]

        return detect

    job = RD.RedactionJob(policy, root, plugin=DetectorPlugin("names", load, batch=8))
    staged_before = set(os.listdir(shared_dir(spark)))
    rows = [(1, 0, "Ann wrote a@b.com"), (1, 1, "nobody wrote"), (1, 2, None)]
    job(spark.createDataFrame(rows, schema), 0)
    out = {r.seg_no: r.redacted for r in spark.read.parquet(root + "/redacted/batch=0").collect()}
    assert out == {0: "Ann wrote <<EMAIL_1>>", 1: "nobody wrote", 2: ""}
    assert tuple(spark.read.parquet(root + "/failures/batch=0").first()) == (3, 1)
    fuse.touch()
    # The text it failed on was not cached and is tried again.
    job(spark.createDataFrame(rows, schema), 1)
    out = {r.seg_no: r.redacted for r in spark.read.parquet(root + "/redacted/batch=1").collect()}
    assert out[0] == "<<PERSON_1>> wrote <<EMAIL_1>>"
    assert tuple(spark.read.parquet(root + "/failures/batch=1").first()) == (1, 0)
    # Nothing with private values is left in the work folder.
    assert set(os.listdir(shared_dir(spark))) == staged_before


def test_old_policy_versions_leave_the_cache(spark, tmp_path, make_policy):
    policy, root = str(tmp_path / "policy"), str(tmp_path / "out")
    job = RD.RedactionJob(policy, root)
    for n in range(3):
        PS.publish(make_policy(("deny", f"Loki{n}", "P")), policy, n + 1)
        job(spark.createDataFrame([(1, 0, f"Loki{n}")], "conv_id bigint, seg_no bigint, text string"), n)
    assert sorted(os.listdir(f"{root}/cache")) == ["policy_version=v2", "policy_version=v3"]
    assert spark.read.parquet(root + "/redacted").count() == 3


def test_repeats_and_windows_on_a_stream(spark, tmp_path, make_policy):
    src = str(tmp_path / "in")
    schema = "seg_no bigint, ts timestamp, text string"
    rows = spark.range(6).select(
        F.col("id").alias("seg_no"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("id") * 100).alias("ts"),
        F.when(F.col("id") < 3, "call +1 (415) 555-0132").otherwise(F.concat(F.lit("n"), "id")).alias("text"),
    )
    rows.coalesce(1).write.parquet(src)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.table(name).collect()

    once = run(RD.without_repeats(spark.readStream.schema(schema).parquet(src), "ts", "1 hour"), "once", "append")
    assert len(once) == 4
    version = F.when(F.col("seg_no") < 2, "v1").otherwise("v2")
    source = spark.readStream.schema(schema).parquet(src)
    again = run(RD.without_repeats(source, "ts", "1 hour", version), "again", "append")
    assert len(again) == 5 and set(again[0].asDict()) == {"seg_no", "ts", "text", "seg_hash"}
    stream = spark.readStream.schema(schema).parquet(src)
    counts = run(windowed_counts(stream, "ts", "text", late="10 minutes"), "counts", "complete")
    assert sum(r.n for r in counts) == 6
    red = run(
        RD.redacted_stream(spark.readStream.schema(schema).parquet(src), make_policy(("deny", "n4", "ORG"))),
        "red", "append",
    )
    assert {r.seg_no: r.redacted for r in red}[4] == "<<ORG_1>>"
    assert {r.seg_no: r.redacted for r in red}[0] == "call <<PHONE_1>>"


def test_merge_suggestions(spark):
    cols = "scope string, term string, last_seen bigint"
    old = spark.createDataFrame([("a", f"t{i}", i) for i in range(200)], cols)
    new = spark.createDataFrame([("a", "t0", 500), ("b", "t0", 501)], cols)
    got = {(r.scope, r.term) for r in RD.merge_suggestions(old, new).collect()}
    assert len(got) == 200 and {("a", "t0"), ("b", "t0")} <= got and ("a", "t1") not in got


def test_sinks(spark, tmp_path):
    rows = [(1, "ok", None), (2, "Cartalian", "residual_term")]
    audited = spark.createDataFrame(rows, "id int, redacted string, reason string")
    clean, held = str(tmp_path / "clean"), str(tmp_path / "held")
    sinks.write_corpus(audited, clean, held, ["id"], ["redacted"])
    assert [r.id for r in spark.read.parquet(clean).collect()] == [1]
    kept = spark.read.parquet(held)
    assert set(kept.columns) == {"id", "reason"} and kept.count() == 1
    lines = spark.createDataFrame([('{"id":7,"text":"a@b.com"}',), ('{"id":"x7","text":""}',), ('{"text":"t"}',), ("{",)], "value string")
    found = str(tmp_path / "found")
    sinks.write_entities(detect_patterns(parse_lines(lines).coalesce(1)), found)
    entity = {"start": 0, "end": 7, "label": "EMAIL", "score": 0.0, "source": "regex"}
    out = [json.loads(r.value) for r in spark.read.text(found).collect()]
    assert out == [{"id": 7, "entities": [entity]}, {"id": "x7", "entities": []}, {"entities": []}, {"error": "unreadable line"}]
    res = str(tmp_path / "res")
    for task, v in (("a", 1), ("b", 2), ("a", 3)):
        df = spark.createDataFrame([(v, task)], "f2 int, task_name string")
        sinks.write_task_results(df, res)
    assert {r.task_name: r.f2 for r in spark.read.parquet(res).collect()} == {"a": 3, "b": 2}

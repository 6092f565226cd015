"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import maskweave
from maskweave.functions import spans as S
from maskweave.functions import text as T
from maskweave.operators import audit as A
from maskweave.operators import bodies as B
from maskweave.operators import delta as DL
from maskweave.operators import detect as D
from maskweave.operators import dictionary as DD
from maskweave.operators import metrics as MT
from maskweave.operators import model as M
from maskweave.operators import policy as PO
from maskweave.operators import score as SC
from maskweave.operators import vault as V
from maskweave.plans import inputs as I
from maskweave.sources import tables as TB
from maskweave.streaming import batch_restore as BR

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPAN_COLUMNS = ["start", "end", "label", "value"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- detection -------------------------------------------------------------------------------


@query
def scan_segments(spark, sf):
    return TB.table(spark, sf, "documents", "doc_id", "source", "text").where(
        F.trim("text") != ""
    ).select("doc_id", "source", F.length("text").cast("bigint").alias("chars"), "text")


def _one(detector):
    def run(spark, sf):
        docs = D.detect_patterns(I.documents(spark, sf, "doc_id", "text"), (detector,))
        return D.explode_spans(docs, "doc_id").select("doc_id", *SPAN_COLUMNS)

    return run


QUERIES["detect_email"] = _one(D.EMAIL)
QUERIES["detect_card"] = _one(D.CARD)
QUERIES["detect_ip"] = _one(D.IP)
QUERIES["detect_phone"] = _one(D.PHONE)


@query
def detect_regex(spark, sf):
    docs = D.detect_patterns(I.documents(spark, sf, "doc_id", "text"))
    return D.explode_spans(docs, "doc_id").select("doc_id", *SPAN_COLUMNS)


@query
def merge_spans(spark, sf):
    """Overlap resolution of pattern hits before validation, where overlaps are frequent."""
    raw = D.with_pattern_spans(I.documents(spark, sf, "doc_id", "text"), validate=False)
    return D.explode_spans(D.with_merged(raw, "pattern_spans"), "doc_id").select(
        "doc_id", *SPAN_COLUMNS
    )


@query
def detect_dictionary(spark, sf):
    docs = DD.with_dictionary_spans(
        I.documents(spark, sf), I.policy(spark, sf), scope="source", out="spans", key=["doc_id"]
    )
    docs = docs.withColumnRenamed("source", "source_name")
    return D.explode_spans(docs, "doc_id").select("doc_id", *SPAN_COLUMNS)


@query
def detect_dictionary_pattern(spark, sf):
    """The same result through one JVM pattern per scope, the path for short policies."""
    docs = DD.with_dictionary_spans(
        I.documents(spark, sf),
        I.policy(spark, sf),
        scope="source",
        out="spans",
        key=["doc_id"],
        max_forms=10_000,
    ).withColumnRenamed("source", "source_name")
    return D.explode_spans(docs, "doc_id").select("doc_id", *SPAN_COLUMNS)


@query
def detect_dictionary_large(spark, sf):
    """The same result through the path for policies too large for one pattern, cut into
    several broadcast chunks."""
    docs = DD.with_dictionary_spans(
        I.documents(spark, sf),
        I.policy(spark, sf),
        scope="source",
        out="spans",
        key=["doc_id"],
        max_forms=0,
        chunk_bytes=16 * 1024,
        chunks=True,
    ).withColumnRenamed("source", "source_name")
    return D.explode_spans(docs, "doc_id").select("doc_id", *SPAN_COLUMNS)


@query
def detect_dictionary_join(spark, sf):
    """The same result through the index of the forms' grams, the path for policies of any size."""
    docs = DD.with_dictionary_spans(
        I.documents(spark, sf), I.policy(spark, sf), scope="source", out="spans", max_forms=0, chunk_bytes=0
    ).withColumnRenamed("source", "source_name")
    return D.explode_spans(docs, "doc_id").select("doc_id", *SPAN_COLUMNS)


@query
def detect_whole_word(spark, sf):
    words = I.policy(spark, sf).where(F.col("whole_word"))
    docs = DD.with_dictionary_spans(
        I.documents(spark, sf, "doc_id", "text"), words, out="spans", key=["doc_id"]
    )
    return D.explode_spans(docs, "doc_id").select("doc_id", *SPAN_COLUMNS)


@query
def detect_all(spark, sf):
    return I.kept_spans(spark, sf).select("doc_id", *SPAN_COLUMNS, "source")


@query
def allow_list_filter(spark, sf):
    """Spans kept per source and label once allowed texts are dropped, with the drop count."""
    docs = I.detected(spark, sf).withColumnRenamed("source", "source_name")
    rows = D.explode_spans(docs, "doc_id", "source_name")
    kept = PO.without_allowed(rows, I.policy(spark, sf), scope="source_name")
    by = ["source_name", "label"]
    return (
        rows.groupBy(*by)
        .agg(F.count("*").alias("found"))
        .join(kept.groupBy(*by).agg(F.count("*").alias("kept")), by, "left")
        .select(*by, "found", F.coalesce("kept", F.lit(0)).alias("kept"))
    )


@query
def redactions_by_label(spark, sf):
    return D.redaction_counts(I.kept_spans(spark, sf))


# --- policy ------------------------------------------------------------------------------------


@query
def policy_load(spark, sf):
    docs = I.policy_documents(spark, sf)
    rows = PO.policy_from_json(docs, "doc", F.col("item_id"))
    return rows.select(
        "ord", "list", "term", "label", "scope",
        F.array_join("aliases", ",").alias("aliases"), "source", "whole_word",
    )


@query
def policy_state(spark, sf):
    return PO.policy_state(I.admin_log(spark, sf)).select(
        "ord", "term", "label", "scope", "whole_word"
    )


@query
def unteach_effect(spark, sf):
    return PO.unteach_effect(I.admin_log(spark, sf))


@query
def policy_forms(spark, sf):
    return PO.distinct_forms(PO.hidden_forms(I.policy(spark, sf)), "scope")


@query
def policy_terms(spark, sf):
    return PO.policy_terms(I.policy(spark, sf))


@query
def policy_version(spark, sf):
    return PO.policy_version(I.policy(spark, sf))


@query
def scope_terms(spark, sf):
    asked = TB.table(spark, sf, "documents", "source").select(
        F.when(F.col("source") != "src0", F.col("source")).alias("request_scope")
    )
    return PO.forms_by_request_scope(asked, PO.hidden_forms(I.policy(spark, sf))).select(
        "request_scope", "form", "label", "whole_word"
    )


# --- vault -----------------------------------------------------------------------------------------


@query
def assign_placeholders(spark, sf):
    vault = V.assign_placeholders(I.turn_spans(spark, sf))
    return vault.select("conv_id", "real", "label", "n", "placeholder")


@query
def redact_text(spark, sf):
    return V.redact_rows(I.kept(spark, sf)).select("doc_id", "redacted")


@query
def redact_conversations(spark, sf):
    red, _ = I.redacted_turns(spark, sf)
    return red.select("conv_id", "seg_no", "redacted")


@query
def restore_text(spark, sf):
    """Redact each document, reformat its placeholders, restore it from its own vault."""
    docs = V.redact_rows(I.kept(spark, sf))
    reply = F.regexp_replace(
        F.concat(F.col("redacted"), F.lit(" <<ORG_0>>")), "<<([A-Z]+)_", "<<  $1_"
    )
    reals = V.restore_map(F.col("vault")).alias("reals")
    back = docs.select("doc_id", "redacted", reply.alias("reply"), reals)
    return back.select(
        "doc_id",
        "redacted",
        F.regexp_count("redacted", F.lit("<<[^<>]*>>")).cast("bigint").alias("n"),
        V.restored(F.col("reply"), F.col("reals")).alias("restored"),
    )


@query
def restore_join(spark, sf):
    red, vault = I.redacted_turns(spark, sf)
    n = F.regexp_count("redacted", F.lit("<<[^<>]*>>")).cast("bigint").alias("n")
    back = V.restore_by_join(red, vault, text="redacted")
    return back.select("conv_id", "seg_no", "redacted", n, "restored")


@query
def vault_isolation(spark, sf):
    """Texts of one conversation restored with the next conversation's vault."""
    red, vault = I.redacted_turns(spark, sf)
    foreign = vault.withColumn("conv_id", F.col("conv_id") - 1)
    out = V.restore_by_join(red, foreign, text="redacted")
    own = V.restore_by_join(red, vault, text="redacted").select(
        "conv_id", "seg_no", (F.col("restored") == F.col("text")).alias("own_vault_restores")
    )
    return out.select("conv_id", "seg_no", F.col("restored").alias("with_foreign_vault")).join(
        own, ["conv_id", "seg_no"]
    )


@query
def sealed_vault_roundtrip(spark, sf):
    """Seal the vault's real values, open them in place, and fail to open them elsewhere."""
    key = bytes(range(32))
    vault = V.assign_placeholders(I.turn_spans(spark, sf)).select("conv_id", "inner", "real")
    sealed = V.seal(vault, "real", key, ["conv_id", "inner"])
    opened = V.unseal(sealed, "real", key, ["conv_id", "inner"])
    moved = V.unseal(
        sealed.withColumn("conv_id", F.col("conv_id") + 1), "real", key, ["conv_id", "inner"],
        strict=False,
    ).select((F.col("conv_id") - 1).alias("conv_id"), "inner", F.col("real").isNull().alias("refused"))
    return opened.join(moved, ["conv_id", "inner"])


# --- audit -----------------------------------------------------------------------------------------------


def _half_redacted(spark, sf):
    """Documents redacted by the pattern layer alone: taught terms stay visible."""
    docs = D.detect_patterns(I.documents(spark, sf))
    red = V.redact_rows(docs).select("doc_id", "source", "redacted")
    # Odd documents lose their last closing bracket, as a cut-off transfer would.
    cut = F.regexp_replace("redacted", r"(?s)>>[^>]*$", "")
    body = F.when(F.col("doc_id") % 2 == 1, cut).otherwise(F.col("redacted"))
    return S.settled(red, {"body": body}).drop("redacted")


@query
def audit_residual(spark, sf):
    found = A.with_residual(
        _half_redacted(spark, sf), I.policy(spark, sf), ["doc_id"], "body", scope="source"
    )
    return found.where(F.col("residual") > 0).select("doc_id", "residual")


@query
def audit_malformed(spark, sf):
    return _half_redacted(spark, sf).select("doc_id", A.malformed(F.col("body")).alias("malformed"))


@query
def audit_split(spark, sf):
    done = A.audit(
        _half_redacted(spark, sf), I.policy(spark, sf), ["doc_id"], "body", scope="source"
    )
    return A.with_outcome(done).select("doc_id", "outcome")


@query
def audit_decoded_strings(spark, sf):
    """Serialized bodies hide a term that JSON escapes; the decoded strings show it."""
    taught = I.quoted_terms(spark, sf)
    bodies = I.chat_bodies(spark, sf)
    strings = B.leaves_column(F.col("body"), with_keys=True)
    walked = bodies.withColumn("strings", F.transform(strings, lambda x: x["value"]))
    key = ["conv_id", "turn"]
    raw = A.audit(bodies, taught, key, "body").select(*key, F.col("reason").alias("serialized"))
    both = A.audit(walked, taught, key, "body", "strings").select(
        *key, F.col("reason").alias("decoded")
    )
    return raw.join(both, key)


@query
def scope_resolution(spark, sf):
    return A.resolve_scopes(I.requests(spark, sf), I.scopes(spark, sf)).select(
        "req_id", "scope", "reason"
    )


@query
def scope_requests(spark, sf):
    done = A.resolve_scopes(I.requests(spark, sf), I.scopes(spark, sf))
    return done.where(F.col("scope").isNotNull()).groupBy("scope").agg(
        F.count("*").alias("requests")
    )


@query
def oversize_split(spark, sf):
    pages = TB.table(spark, sf, "pages", "page_id", "html")
    return A.oversize(pages, "html", 8192).select("page_id", "reason")


@query
def blocked_by_reason(spark, sf):
    audited = A.audit(
        _half_redacted(spark, sf), I.policy(spark, sf), ["doc_id"], "body", scope="source"
    )
    refused = A.resolve_scopes(I.requests(spark, sf), I.scopes(spark, sf))
    bodies = B.with_body_reason(I.chat_bodies(spark, sf), shape="chat")
    reasons = [x.select("reason") for x in (audited, refused, bodies)]
    return A.blocked_by_reason(reasons[0].unionByName(reasons[1]).unionByName(reasons[2]))


@query
def scope_config_violations(spark, sf):
    return A.scope_config_violations(I.scope_config(spark, sf))


@query
def unknown_scopes(spark, sf):
    known = TB.table(spark, sf, "documents", "source").select(F.col("source").alias("scope"))
    seen = known.where(F.col("scope").rlike("[13579]$")).distinct()
    return A.unknown_scopes(I.policy(spark, sf), seen).select("ord", "term", "scope")


# --- delta scan ----------------------------------------------------------------------------------------------


@query
def segment_hash(spark, sf):
    docs = TB.table(spark, sf, "documents", "doc_id", "source", "text")
    return docs.select(
        "doc_id",
        T.segment_hash(F.col("text"), F.col("source")).alias("scoped"),
        T.segment_hash(F.col("text")).alias("unscoped"),
    )


@query
def resend_expand(spark, sf):
    return DL.resent_history(DL.with_hash(I.turns(spark, sf)))


@query
def delta_scan(spark, sf):
    """Conversations scanned against a cache filled by an earlier run over the user turns, part
    of it under an older policy version."""
    policy = I.policy(spark, sf)
    detect = lambda df: maskweave.detect_rows(df, policy, ["seg_hash"])
    segs = DL.with_hash(I.turns(spark, sf))
    before = segs.where(F.col("role") == "user").groupBy("seg_hash").agg(
        F.any_value("text").alias("text")
    )
    version = F.when(F.length("text") % 2 == 0, "v2").otherwise("v1")
    cache = DL.cache_rows(detect(before), version)
    done, _ = DL.delta_scan(segs, cache, "v2", detect)
    return done.select(
        "conv_id", "turn", F.size("spans").cast("bigint").alias("n_spans"), "hit",
        F.coalesce(F.get("spans", F.lit(0))["start"], F.lit(-1)).alias("first_start"),
    )


@query
def delta_hit_rate(spark, sf):
    return DL.lookups(
        DL.with_hash(TB.table(spark, sf, "documents", "doc_id", "source", "text"), scope="source")
    )


def _queue(spark, sf):
    docs = DL.with_hash(I.detected(spark, sf), scope="source").withColumnRenamed(
        "source", "source_name"
    )
    rows = D.explode_spans(docs, "doc_id", "source_name", "seg_hash")
    return DL.suggestions(rows, I.policy(spark, sf), scope="source_name", order=("doc_id",))


def _flat(queue):
    return queue.select(
        *[c for c in queue.columns if c != "last_seen"],
        F.col("last_seen.place.doc_id").alias("doc_id"),
        F.col("last_seen.start").alias("start"),
    )


@query
def suggestions(spark, sf):
    return _flat(_queue(spark, sf))


@query
def suggestions_by_scope(spark, sf):
    return _flat(DL.suggestions_of(_queue(spark, sf), "src3"))


@query
def suggestions_all_scopes(spark, sf):
    return _flat(DL.suggestions_over_scopes(_queue(spark, sf)))


# --- scoring ---------------------------------------------------------------------------------------------------


def _gold_and_pred(spark, sf):
    """Gold: the merged pattern layer.  Prediction: cards and phones only, shifted by two."""
    docs = I.documents(spark, sf, "doc_id", "text", "lang")
    base = docs.select("doc_id", "lang", F.length("text").cast("bigint").alias("n_chars"))
    gold = D.explode_spans(D.detect_patterns(docs), "doc_id", "lang")
    raw = D.with_pattern_spans(docs, (D.CARD, D.PHONE), out="spans", validate=False)
    pred = D.explode_spans(raw, "doc_id", "lang").select(
        "doc_id", "lang", (F.col("start") + 2).alias("start"), (F.col("end") + 2).alias("end")
    )
    return base, gold, pred


@query
def merge_intervals(spark, sf):
    raw = D.with_pattern_spans(
        I.documents(spark, sf, "doc_id", "text"), out="spans", validate=False
    )
    return SC.merge_intervals(D.explode_spans(raw, "doc_id"), ["doc_id"])


@query
def span_overlap(spark, sf):
    base, gold, pred = _gold_and_pred(spark, sf)
    return SC.overlap_chars(base, gold, pred, ["doc_id"]).select(
        "doc_id", "tp_chars", "gold_chars", "pred_chars", "nonpii_chars"
    )


def _scores(spark, sf):
    """The same comparison from arrays in one row: the texts are read once."""
    docs = D.detect_patterns(I.documents(spark, sf, "doc_id", "text", "lang"), out="gold")
    raw = D.with_pattern_spans(docs, (D.CARD, D.PHONE), out="pred", validate=False)
    rows = raw.select(
        "doc_id",
        "lang",
        F.length("text").cast("bigint").alias("n_chars"),
        "gold",
        F.transform(
            "pred", lambda s: F.struct((s["start"] + 2).alias("start"), (s["end"] + 2).alias("end"))
        ).alias("pred"),
    )
    per_text = SC.overlap_in_rows(rows, ["doc_id"], ["lang"], "gold", "pred")
    return SC.masking_score(per_text, "lang")


@query
def masking_score(spark, sf):
    sums = _scores(spark, sf)
    return sums.select(
        "lang", "texts", "tp_chars", "gold_chars", "pred_chars", "nonpii_chars",
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "f2", "fpr")],
    )


@query
def masking_score_macro(spark, sf):
    out = SC.masking_score_macro(_scores(spark, sf), 4)
    return out.select(
        *[F.round(c, 9).alias(c) for c in ("avg_f2", "avg_f1", "avg_precision", "avg_recall")],
        "complete",
    )


@query
def task_labels(spark, sf):
    docs = I.documents(spark, sf, "doc_id", "text", "lang")
    return SC.task_labels(D.explode_spans(D.detect_patterns(docs), "lang"), "lang")


@query
def sample_per_task(spark, sf):
    docs = TB.table(spark, sf, "documents", "doc_id", "lang")
    return SC.sample_per_task(docs, "lang", "doc_id", 20)


@query
def label_list_split(spark, sf):
    lists = I.documents(spark, sf, "doc_id", "lang", "source").select(
        "doc_id",
        F.concat_ws(",", F.lit(" "), F.concat(F.lit(" "), "lang"), F.lit(""), "source").alias("raw"),
    )
    out = SC.split_labels(lists, "raw")
    return out.select("doc_id", F.array_join("labels", "|").alias("labels"))


@query
def preset_filter(spark, sf):
    names = F.array(*[F.lit(p[0]) for p in SC.PRESETS])
    spans = I.scored_spans(spark, sf).withColumn(
        "preset", F.get(names, (F.col("conv_id") % len(SC.PRESETS)).cast("int"))
    )
    kept = SC.preset_filter(spans, SC.preset_table(spark))
    return kept.groupBy("preset", "label").agg(
        F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total")
    )


# --- bodies ------------------------------------------------------------------------------------------------------


@query
def extract_chat_segments(spark, sf):
    return B.extract_segments(I.chat_bodies(spark, sf), "chat", "conv_id", "turn")


@query
def extract_block_segments(spark, sf):
    return B.extract_segments(I.block_bodies(spark, sf), "blocks", "conv_id", "turn")


@query
def json_string_leaves(spark, sf):
    return B.json_leaves(I.block_bodies(spark, sf), "conv_id", "turn").drop("leaf_no")


@query
def json_all_strings(spark, sf):
    return B.json_leaves(I.chat_bodies(spark, sf), "conv_id", "turn", with_keys=True).drop("leaf_no")


@query
def json_deep_strings(spark, sf):
    """Strings of bodies nested 500 deep, by a table function and a lateral join."""
    return B.json_strings(I.deep_bodies(spark, sf), "conv_id", "turn")


@query
def rebuild_chat_body(spark, sf):
    bodies = I.chat_bodies(spark, sf)
    segs = B.extract_segments(bodies, "chat", "conv_id", "turn").withColumn(
        "redacted", F.concat(F.lit("#"), F.col("seg_no").cast("string"), F.lit("/"),
                             F.length("text").cast("string"))
    )
    out = B.rebuild_bodies(bodies, segs, "chat", ["conv_id", "turn"])
    return out.select("conv_id", "turn", "rebuilt")


@query
def jsonl_detect(spark, sf):
    lines = TB.parse_lines(I.request_lines(spark, sf))
    found = D.detect_patterns(lines)
    entities = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"),
            s["score"].alias("score"), s["source"].alias("source"),
        ),
    )
    return found.select(
        "doc_id",
        F.col("id").cast("string").alias("id"),
        F.when(F.col("error").isNull(), F.to_json(entities)).alias("entities"),
        "error",
    )


# --- model data ------------------------------------------------------------------------------------------------------


@query
def word_tokens(spark, sf):
    return M.word_tokens(I.documents(spark, sf), "doc_id")


@query
def candidate_spans(spark, sf):
    cand = M.candidate_spans(I.documents(spark, sf), "doc_id", max_width=8)
    return cand.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.sum("start").alias("starts"),
        F.sum("end").alias("ends"),
        F.sum(F.col("last_word") - F.col("first_word")).alias("extra_words"),
    )


def _label_scores(spark, sf, threshold):
    items = TB.table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    labels = M.label_vectors(M.mean_vectors(items, "label", "embedding"), "label")
    return M.label_scores(items, labels, "vec_id", threshold=threshold)


@query
def label_scores(spark, sf):
    out = _label_scores(spark, sf, 0.0)
    return out.select("vec_id", "label", F.round("logit", 6).alias("logit"),
                      F.round("score", 6).alias("score"))


@query
def label_top_k(spark, sf):
    """The three best labels of every vector."""
    items = TB.table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    means = M.label_vectors(M.mean_vectors(items, "label", "embedding"), "label")
    out = M.label_top_k(items, means, "vec_id", 3)
    return out.select("vec_id", "rank", "label", F.round("logit", 6).alias("logit"), F.round("score", 6).alias("score"))


@query
def top_values(spark, sf):
    """The fifty values redacted most often."""
    return MT.top_values(_applied(spark, sf), 50, "label")


@query
def redactions_rollup(spark, sf):
    """Redactions by source, language and label, with all subtotals."""
    return MT.redactions_rollup(_applied(spark, sf), "source", "lang", "label")


def _applied(spark, sf):
    docs = D.detect_patterns(I.documents(spark, sf, "doc_id", "text", "source", "lang"))
    rows = D.explode_spans(docs.withColumnRenamed("source", "origin"), "origin", "lang")
    return rows.select(F.col("origin").alias("source"), "lang", "label", "value")


@query
def score_threshold(spark, sf):
    texts = I.scored_arrays(spark, sf)
    rows = S.settled(texts, {"spans": D.score_at_least(F.col("found"), None)})
    return D.explode_spans(rows, "conv_id").groupBy("conv_id", "label").agg(F.count("*").alias("n"))


@query
def nms_spans(spark, sf):
    texts = I.scored_arrays(spark, sf)
    strong = S.settled(texts, {"found": D.score_at_least(F.col("found"), None)})
    rows = S.settled(strong, {"spans": S.suppressed("found")})
    return D.explode_spans(rows, "conv_id", "turn").select(
        "conv_id", "turn", "start", "end", "label", F.round("score", 6).alias("score")
    )


@query
def span_clamp(spark, sf):
    n = F.length("text").cast("bigint")
    at = lambda a, b, label: F.struct(
        a.cast("bigint").alias("start"), b.cast("bigint").alias("end"), F.lit(label).alias("label"),
        F.lit("plugin").alias("source"), F.lit(0.5).alias("score"),
    )
    raw = F.array(
        at(F.lit(-3), F.col("doc_id") % 7, "A"), at(n - 2, n + 9, "B"), at(n + 1, n + 9, "C"),
        at(F.lit(5), F.lit(5), "D"),
    )
    docs = I.documents(spark, sf, "doc_id", "text").withColumn("raw", raw)
    rows = docs.withColumn("spans", S.clamped(F.col("raw"), F.col("text")))
    return D.explode_spans(rows, "doc_id").select("doc_id", *SPAN_COLUMNS)


def hex_token_plugin():
    """Sample plug-in: 40-digit hex tokens; gives up on texts with triple hashes."""
    import re

    token = re.compile(r"[0-9a-f]{40}")

    def detect(text: str):
        if "### " in text:
            raise ValueError("unsupported text")
        return [(m.start(), m.end(), "SECRET", 0.9) for m in token.finditer(text)]

    return detect


def _plugged(spark, sf):
    plugin = M.DetectorPlugin("hex", hex_token_plugin)
    return M.with_plugin_spans(D.with_pattern_spans(I.documents(spark, sf, "doc_id", "text")), plugin)


@query
def detect_plugin(spark, sf):
    done = D.with_merged(_plugged(spark, sf), "pattern_spans", "plugin_spans")
    return D.explode_spans(done, "doc_id").select("doc_id", *SPAN_COLUMNS, "source")


@query
def detector_failures(spark, sf):
    return M.detector_failures(_plugged(spark, sf))


# --- streams and counters ------------------------------------------------------------------------------------------------


@query
def stream_restore_batch(spark, sf):
    chunks, vault = I.reply_chunks(spark, sf)
    key = ["conv_id", "stream_id", "field"]
    return BR.restore_chunks(chunks, vault, "conv_id", key, is_end="is_end").select(
        "stream_id", "field", "chunk_no", "restored"
    )


@query
def windowed_counts(spark, sf):
    events = TB.table(spark, sf, "events", "ts", "event_type")
    return MT.windowed_counts(events, "ts", "event_type").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n"
    )


@query
def histogram_buckets(spark, sf):
    events = TB.table(spark, sf, "events", "event_type", "value")
    return MT.histogram(events, "value", "event_type").select(
        "event_type", F.coalesce("le", F.lit(-1.0)).alias("le"), "n",
        F.round("total", 4).alias("total"), "observations",
    )


@query
def capped_counts(spark, sf):
    events = TB.table(spark, sf, "events", "event_id", "user_id")
    label = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    return MT.capped_counts(events, label, F.col("event_id"))


@query
def traffic_matrix(spark, sf):
    events = TB.table(spark, sf, "events", "event_id", "event_type", "user_id")
    paths = F.array(*[F.lit(p) for p in [*MT.ROUTES, "/wp-login.php"]])
    path = F.get(paths, (F.col("user_id") % (len(MT.ROUTES) + 1)).cast("int"))
    status = F.when(F.col("event_type") == "error", 502).otherwise(200)
    return MT.traffic_matrix(events, MT.route(path), status)

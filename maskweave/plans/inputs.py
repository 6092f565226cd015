"""Inputs of the registered queries, all derived from the given tables.

The tables hold texts and events but no policy, tokens, bodies or chunks.  Each function here
derives one of them by a rule, so that it grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import maskweave
from maskweave.functions import spans as S
from maskweave.operators import detect as D
from maskweave.operators import dictionary as DD
from maskweave.operators import model as M
from maskweave.operators import policy as PO
from maskweave.operators import vault as V
from maskweave.sources.tables import table, text_table


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return text_table(spark, sf, "documents", ["doc_id"], *(columns or ("doc_id", "text", "source")))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation segments: the turn is the segment number."""
    key = ["conv_id", "turn"]
    return text_table(spark, sf, "conversations", key, *key, "role", "text")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("conv_id", F.col("turn").alias("seg_no"), "text")


# --- policy --------------------------------------------------------------------------------


def _picked_words(spark: SparkSession, sf: str) -> DataFrame:
    """Longest, second longest, shortest and second shortest long word of each passage."""
    words = F.array_distinct(S.all_matches(F.lower("text"), "[a-z]{6,}"))
    ranked = F.sort_array(
        F.transform(words, lambda w: F.struct((-F.length(w)).alias("k"), w.alias("w")))
    )
    rows = table(spark, sf, "benchmark", "item_id", "text").select("item_id", ranked.alias("r"))
    return rows.where(F.size("r") >= 4).select(
        "item_id",
        F.get("r", F.lit(0))["w"].alias("w1"),
        F.get("r", F.lit(1))["w"].alias("w2"),
        F.get("r", F.size("r") - 1)["w"].alias("wn"),
    )


def policy(spark: SparkSession, sf: str) -> DataFrame:
    """Taught terms and exceptions taken from the benchmark passages."""
    w = _picked_words(spark, sf)
    i = F.col("item_id")
    none = F.array().cast("array<string>")
    names = F.array(*[F.lit(x) for x in ("ORG", "person", "PROJECT", "Client")])

    def entry(side, no, term, label, scope, aliases, whole_word, when=None):
        e = F.struct(
            (i * 4 + no).alias("ord"),
            F.lit(side).alias("list"),
            term.alias("term"),
            label.alias("label"),
            scope.alias("scope"),
            aliases.alias("aliases"),
            F.lit("").alias("source"),
            whole_word.alias("whole_word"),
        )
        return e if when is None else F.when(when, e)

    scoped = lambda n: F.concat(F.lit("src"), (n % 20).cast("string"))
    entries = F.array(
        entry(
            "deny",
            0,
            F.initcap("w1"),
            F.get(names, (i % 4).cast("int")),
            F.when(i % 3 == 0, "global").otherwise(F.concat(F.lit("SRC"), (i % 20).cast("string"))),
            F.array("w2"),
            i % 2 == 1,
        ),
        entry(
            "deny",
            1,
            F.col("wn"),
            F.lit("CODENAME"),
            F.when(i % 5 == 0, "Global").otherwise(scoped(i * 7)),
            none,
            i % 3 == 1,
        ),
        entry(
            "allow",
            2,
            F.upper("wn"),
            F.lit(""),
            F.when(i % 2 == 0, "global").otherwise(scoped(i)),
            none,
            F.lit(False),
            (i % 8).isin(0, 3),
        ),
    )
    rows = w.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
    return PO.compact(rows.select("e.*"))


def policy_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One policy store document per passage, with fields left out as old files have them."""
    w = _picked_words(spark, sf)
    full = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.col("w1").alias("term"),
                    F.lit("ORG").alias("label"),
                    F.array("w2").alias("aliases"),
                    F.lit("alpha").alias("scope"),
                    (F.col("item_id") % 2 == 0).alias("whole_word"),
                )
            ).alias("deny"),
            F.array(F.struct(F.col("wn").alias("term"), F.lit("").alias("label"))).alias("allow"),
        )
    )
    short = F.to_json(
        F.struct(
            F.array(F.struct(F.col("w1").alias("term"), F.lit("ORG").alias("label"))).alias("deny")
        )
    )
    return w.select("item_id", F.when(F.col("item_id") % 3 == 0, short).otherwise(full).alias("doc"))


def admin_log(spark: SparkSession, sf: str) -> DataFrame:
    """Teach and unteach events, one per row of the events table."""
    e = F.col("event_id")
    name = F.concat(F.lit("Term-"), F.col("user_id").cast("string"))
    area = F.concat(F.lit("Scope"), (e % 4).cast("string"))
    gone = F.col("event_type") == "error"
    return table(spark, sf, "events", "event_id", "user_id", "event_type").select(
        e.alias("seq"),
        F.when(gone, "unteach").otherwise("teach").alias("op"),
        F.when(e % 2 == 0, name).otherwise(F.upper(name)).alias("term"),
        F.upper("event_type").alias("label"),
        F.when(gone & (e % 3 == 0), F.lit(None).cast("string"))
        .when(e % 4 == 0, "global")
        .when(e % 7 == 0, F.upper(area))
        .otherwise(area)
        .alias("scope"),
        (e % 5 == 0).alias("whole_word"),
    )


# --- scopes ----------------------------------------------------------------------------------


def scopes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation", "n_nationkey", "n_name").select(
        n.cast("bigint").alias("pos"),
        F.lower("n_name").alias("scope"),
        F.sha2(F.concat(F.lit("key-"), n.cast("string")), 256).alias("token_hash"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    key = lambda n: F.concat(F.lit("key-"), n.cast("string"))
    return table(spark, sf, "events", "event_id", "user_id").select(
        e.alias("req_id"),
        F.when(e % 3 == 0, F.concat(F.lit("Bearer "), key(u % 30)))
        .when(e % 3 == 1, F.concat(F.lit("Basic "), key(u % 30)))
        .alias("bearer"),
        F.when(e % 5 != 0, key((u + e) % 28)).alias("api_key"),
    )


def scope_config(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    s = lambda n: n.cast("string")
    return table(spark, sf, "customer", "c_custkey").select(
        c.cast("bigint").alias("entry_no"),
        F.when(c % 97 == 0, F.concat(F.lit("Global=tok"), s(c)))
        .when(c % 89 == 0, F.concat(F.lit("scope-"), s(c)))
        .when(c % 83 == 0, F.concat(F.lit("scope"), s(c), F.lit("= ")))
        .otherwise(F.concat(F.lit("seg"), s(c % 140), F.lit(" = tok"), s(c % 130)))
        .alias("entry"),
    )


# --- detected spans ----------------------------------------------------------------------------


def layered(spark: SparkSession, sf: str, max_forms: int = DD.MAX_PATTERN_FORMS) -> DataFrame:
    """Documents with the dictionary and pattern layers as separate columns."""
    docs = D.with_pattern_spans(documents(spark, sf))
    return DD.with_dictionary_spans(
        docs, policy(spark, sf), scope="source", key=["doc_id"], max_forms=max_forms
    )


def detected(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with merged spans of both layers."""
    return D.with_merged(layered(spark, sf), "dictionary_spans", "pattern_spans")


def kept(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with merged spans less the allow-list, filtered in the row."""
    return PO.drop_allowed(detected(spark, sf), policy(spark, sf), ["doc_id"], scope="source")


def kept_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Span rows of the documents after the allow-list, filtered by a join."""
    docs = detected(spark, sf).withColumnRenamed("source", "source_name")
    rows = D.explode_spans(docs, "doc_id", "source_name")
    return PO.without_allowed(rows, policy(spark, sf), scope="source_name")


def turn_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Span rows of the conversations; no scope, so every term applies."""
    return maskweave.detect(segments(spark, sf), policy(spark, sf), ["conv_id", "seg_no"])


def redacted_turns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return V.redact_conversations(segments(spark, sf), turn_spans(spark, sf))


# --- scored spans --------------------------------------------------------------------------------

SPAN_LABELS = ("email", "person", "city", "vehicle", "iban")


def _stand_in(start: Column, end: Column, first_word: Column) -> tuple[Column, Column]:
    """Label and score of a candidate span of a turn."""
    labels = F.array(*[F.lit(x) for x in SPAN_LABELS])
    number = start * 31 + end * 17 + F.col("turn") * 7
    return F.get(labels, (first_word % 5).cast("int")), (number % 1000) / F.lit(1000.0)


def scored_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate spans over the conversations, at full width, with a stand-in score."""
    cand = M.candidate_spans(turns(spark, sf), "conv_id", "turn", max_width=8)
    label, score = _stand_in(F.col("start"), F.col("end"), F.col("first_word"))
    return cand.select("conv_id", "turn", "start", "end", label.alias("label"), score.alias("score"))


def scored_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """The scored spans of each turn as an array, ``found``.

    Only texts are shuffled.  The spans of a turn that has one text, which come in order, never
    leave its row; those of a turn with several are put together where its texts are.
    """
    texts = turns(spark, sf).groupBy("conv_id", "turn").agg(F.collect_list("text").alias("texts"))
    rows = texts.select("conv_id", "turn", F.size("texts").alias("n"), F.explode("texts").alias("text"))
    cand = M.candidate_spans(rows, "conv_id", "turn", "n", max_width=8, nested="found")

    def span(c: Column) -> Column:
        label, score = _stand_in(c["start"], c["end"], c["first_word"])
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), label.alias("label"),
            F.lit("model").alias("source"), score.alias("score"),
            F.lit(None).cast("string").alias("value"),
        )

    scored = cand.select("conv_id", "turn", "n", F.transform("found", span).alias("found"))
    one = scored.where(F.col("n") == 1).select("conv_id", "turn", "found")
    several = scored.where(F.col("n") > 1).groupBy("conv_id", "turn").agg(
        F.sort_array(F.flatten(F.collect_list("found"))).alias("found")
    )
    return one.unionByName(several)


# --- bodies ------------------------------------------------------------------------------------------


def _quoted(c: Column) -> Column:
    """A JSON string literal."""
    inside = F.to_json(F.array(c))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def chat_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """One chat request per turn; the shape of the message depends on the turn, and some bodies
    are cut off."""
    t = _quoted(F.col("text"))
    args = _quoted(F.concat(F.lit('{"q":'), t, F.lit("}")))
    shape = F.col("turn") % 4
    message = (
        F.when(shape == 0, F.concat(F.lit('{"content":'), t, F.lit(',"name":"x","role":"user"}')))
        .when(
            shape == 1,
            F.concat(
                F.lit('{"content":[{"text":'), t,
                F.lit(',"type":"text"},{"image_url":{"url":"u"},"type":"image_url"},{"input_text":'),
                t, F.lit(',"type":"input_text"}],"role":"user"}'),
            ),
        )
        .when(
            shape == 2,
            F.concat(
                F.lit('{"content":null,"role":"assistant","tool_calls":[{"function":{"arguments":'),
                args, F.lit(',"name":"f"},"id":"c1","type":"function"}]}'),
            ),
        )
        .otherwise(
            F.concat(
                F.lit('{"content":'), t,
                F.lit(',"reasoning_content":"kept","role":"assistant"}'),
            )
        )
    )
    body = F.concat(
        F.lit('{"messages":['), message, F.lit('],"metadata":{"note":"n"},"model":"m"}')
    )
    cut = (F.col("conv_id") % 11 == 5) & (F.col("turn") % 3 == 1)
    sent = F.when(cut, F.substring(body, F.lit(1), F.length(body) - 2)).otherwise(body)
    return turns(spark, sf).select("conv_id", "turn", sent.alias("body"))


def quoted_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A policy that teaches how the tool arguments of every third conversation begin: terms with
    quotes, which a serializer escapes."""
    begins = turns(spark, sf).where("conv_id % 3 = 0 AND turn % 4 = 2").select(
        F.substring(F.concat(F.lit('"q":'), _quoted(F.col("text"))), 1, 17).alias("term")
    )
    rows = begins.distinct()
    return rows.select(
        F.xxhash64("term").alias("ord"), F.lit("deny").alias("list"), "term",
        F.lit("KEY").alias("label"), F.lit("global").alias("scope"),
        F.array().cast("array<string>").alias("aliases"), F.lit("").alias("source"),
        F.lit(False).alias("whole_word"),
    )


NESTING = 250


def deep_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """One body per turn whose text lies 500 levels deep."""
    opened, closed = F.lit('{"a":[' * NESTING), F.lit("]}" * NESTING)
    body = F.concat(opened, _quoted(F.col("text")), F.lit(',1,"'), F.col("role"), F.lit('"'), closed)
    return turns(spark, sf).select("conv_id", "turn", body.alias("body"))


def block_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """One block-shaped request per turn."""
    t = _quoted(F.col("text"))
    r = _quoted(F.concat(F.col("role"), F.lit(" prompt")))
    shape = F.col("turn") % 4
    system = F.when(F.col("conv_id") % 2 == 0, r).otherwise(
        F.concat(F.lit('[{"text":'), r, F.lit(',"type":"text"},{"type":"other"}]'))
    )
    content = (
        F.when(shape == 0, t)
        .when(
            shape == 1,
            F.concat(F.lit('[{"text":'), t, F.lit(',"type":"text"},{"thinking":"no","type":"thinking"}]')),
        )
        .when(
            shape == 2,
            F.concat(
                F.lit('[{"content":[{"text":'), t,
                F.lit(',"type":"text"},{"content":"deep","type":"tool_result"}],"type":"tool_result"}]'),
            ),
        )
        .otherwise(
            F.concat(
                F.lit('[{"input":{"b":'), t, F.lit(',"a":["x",{"z":1,"y":"w"}]},"type":"tool_use"}]')
            )
        )
    )
    body = F.concat(
        F.lit('{"max_tokens":5,"messages":[{"content":'), content,
        F.lit(',"role":"user"}],"system":'), system, F.lit("}"),
    )
    return turns(spark, sf).select("conv_id", "turn", body.alias("body"))


def request_lines(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines, some blank, cut short or without a text."""
    d = F.col("doc_id")
    full = F.concat(
        F.lit('{"id":'), d.cast("string"), F.lit(',"text":'), _quoted(F.col("text")), F.lit("}")
    )
    line = (
        F.when(d % 10 == 3, F.concat(F.lit('{"id":'), d.cast("string"), F.lit(',"text"')))
        .when(d % 10 == 5, "  ")
        .when(d % 10 == 7, F.concat(F.lit('{"id":'), d.cast("string"), F.lit("}")))
        .otherwise(full)
    )
    return documents(spark, sf, "doc_id", "text").select("doc_id", line.alias("value"))


# --- chunk stream ----------------------------------------------------------------------------------------

CHUNK_CHARS = 16


def reply_chunks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Redacted turns cut into small chunks as a provider would stream them, and the vault."""
    red, vault = redacted_turns(spark, sf)
    n = F.ceil(F.length("redacted") / CHUNK_CHARS).cast("int")
    cuts = F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
        lambda i: F.struct(
            i.cast("bigint").alias("chunk_no"),
            F.substring(F.col("redacted"), i * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)).alias("text"),
            (i == F.greatest(n, F.lit(1)) - 1).alias("is_end"),
        ),
    )
    rows = red.select("conv_id", "seg_no", F.explode(cuts).alias("c"))
    chunks = rows.select(
        F.col("conv_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("seg_no").cast("string")).alias(
            "stream_id"
        ),
        F.when(F.col("seg_no") % 2 == 0, "content").otherwise("reasoning").alias("field"),
        F.col("c.chunk_no").alias("chunk_no"),
        F.col("c.text").alias("text"),
        F.col("c.is_end").alias("is_end"),
    )
    return chunks, vault

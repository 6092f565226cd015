"""Data work around a model detector: tokens, candidate spans, label scores, plug-ins."""

from __future__ import annotations

import functools
import math
import operator
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskweave.functions import patterns as P
from maskweave.functions import spans as S
from maskweave.functions.text import sigmoid
from maskweave.session import staged


def with_words(df: DataFrame, text: str = "text", out: str = "words") -> DataFrame:
    """Add the words of a text with their ranges in the original text."""
    t = F.coalesce(F.col(text), F.lit(""))
    gaps = F.expr(S.pieces(f"coalesce(`{text}`, '')", S.sql_text(P.WORD)))
    hits = S.settled(df, {"__words": S.all_matches(t, P.WORD), "__gaps": F.transform(gaps, F.length)})
    at = hits.withColumn("__at", S.positions(F.col("__gaps"), F.transform("__words", F.length)))
    words = F.arrays_zip("__at.start", "__at.end", F.col("__words").alias("value"))
    return S.settled(at, {out: words}).drop("__words", "__gaps", "__at")


def word_tokens(df: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """One row per word: (key.., word_no, word, start, end)."""
    words = with_words(df, text).select(
        *key, F.posexplode("words").alias("word_no", "w")
    )
    return words.select(
        *key,
        F.col("word_no").cast("bigint").alias("word_no"),
        F.col("w.value").alias("word"),
        F.col("w.start").alias("start"),
        F.col("w.end").alias("end"),
    )


def candidate_spans(
    df: DataFrame, *key: str, max_width: int = 8, text: str = "text", nested: str | None = None
) -> DataFrame:
    """Every run of up to ``max_width`` words: (key.., first_word, last_word, start, end).

    With ``nested`` the runs stay in the row of their text, in order, as an array of that name:
    (key.., nested).
    """
    words = S.settled(with_words(df, text), {"__ends": F.col("words.end")})
    if nested is not None:
        runs = F.transform(
            "words",
            lambda w, i: F.transform(
                F.slice("__ends", i + 1, F.lit(max_width)),
                lambda end, more: F.struct(
                    i.cast("bigint").alias("first_word"),
                    (i + more).cast("bigint").alias("last_word"),
                    w["start"].alias("start"),
                    end.alias("end"),
                ),
            ),
        )
        return words.select(*key, F.flatten(runs).alias(nested))
    opened = words.select(*key, "__ends", F.posexplode("words").alias("first", "w"))
    reach = F.slice("__ends", F.col("first") + 1, F.lit(max_width))
    return opened.select(
        *key, "first", F.col("w.start").alias("start"), F.posexplode(reach).alias("more", "end")
    ).select(
        *key,
        F.col("first").cast("bigint").alias("first_word"),
        (F.col("first") + F.col("more")).cast("bigint").alias("last_word"),
        "start",
        "end",
    )


# --- label scores ------------------------------------------------------------------------------

LABELS_PER_CHUNK = 1024


def mean_vectors(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Element-wise mean vector per label, as (label, pos, value) rows."""
    return (
        df.select(label, F.posexplode(vector).alias("pos", "x"))
        .groupBy(label, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("value"))
    )


def label_vectors(means: DataFrame, label: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return means.groupBy(label).agg(F.transform(ordered, lambda e: e["value"]).alias("vector"))


def label_scores(
    items: DataFrame,
    labels: DataFrame,
    key: str,
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.0,
) -> DataFrame:
    """(key, label, logit, score) of every item against every label scoring at least the
    threshold: a dot product, then the logistic function.

    Label vectors reach the tasks in chunks of at most ``LABELS_PER_CHUNK``; each chunk is one
    matrix product per Arrow batch.  Larger label sets mean more passes over the items.  An item
    whose vector is null, holds a null or has another length than the label's has no score.
    """
    labels = staged(labels.select(label, "vector"), "label-vectors")
    n_labels = labels.count()
    chunks = max(1, -(-n_labels // LABELS_PER_CHUNK))
    slot = F.pmod(F.xxhash64(label), F.lit(chunks))
    key_type = dict(items.dtypes)[key]
    label_type = dict(labels.dtypes)[label]
    out = None
    for i in range(chunks):
        rows = labels.where(slot == i).orderBy(label).collect()
        if not rows:
            continue
        names = [str(r[label]) for r in rows]
        for dim in sorted({len(r["vector"]) for r in rows}):
            same = [k for k, r in enumerate(rows) if len(r["vector"]) == dim]
            matrix = np.array([rows[k]["vector"] for k in same], dtype="float64").reshape(-1, dim)
            run = _scorer([names[k] for k in same], matrix, threshold, key, label)
            v = F.col(vector).cast("array<double>")
            whole = items.where((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull()))
            part = whole.select(key, v.alias("v")).mapInArrow(
                run, f"{key} {key_type}, {label} string, logit double, score double"
            )
            part = part.withColumn(label, F.col(label).cast(label_type))
            out = part if out is None else out.unionByName(part)
    if out is None:
        return items.sparkSession.createDataFrame(
            [], f"{key} {key_type}, {label} {label_type}, logit double, score double"
        )
    return out


def _scorer(names: list, matrix: np.ndarray, threshold: float, key: str, label: str):
    dim = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            logits = flat.reshape(-1, dim) @ matrix.T
            small = np.exp(-np.abs(logits))
            scores = np.where(logits >= 0, 1.0 / (1.0 + small), small / (1.0 + small))
            rows, cols = np.nonzero(scores >= threshold)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array([names[c] for c in cols]),
                    pa.array(logits[rows, cols]),
                    pa.array(scores[rows, cols]),
                ],
                names=[key, label, "logit", "score"],
            )

    return run


# Items and labels that meet in one task.
SCORE_BLOCK = 4096


def label_top_k(
    items: DataFrame,
    labels: DataFrame,
    key: str,
    k: int,
    vector: str = "embedding",
    label: str = "label",
    block: int = SCORE_BLOCK,
) -> DataFrame:
    """(key, rank, label, logit, score): the ``k`` best labels of every item, ties to the smaller label.

    A matrix product in blocks: every block of items meets every block of labels in one task, which
    keeps k labels of each item, and the blocks' lists are ranked together.  The output is k rows an
    item whatever the number of labels, and no label passes through the driver.  ``key`` names single
    items; those without a usable vector have no row.
    """
    v = F.col(vector).cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull())
    rows = items.where(usable).select(F.col(key).alias("key"), v.alias("v"))
    named = labels.where(F.col("vector").isNotNull()).select(
        F.col(label).alias("label"), F.col("vector").cast("array<double>").alias("w")
    )
    n_items = max(1, -(-rows.count() // block))
    n_labels = max(1, -(-named.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = rows.withColumn("i", F.pmod(F.xxhash64("key"), F.lit(n_items)).cast("int")).withColumn("j", every(n_labels))
    spread = named.withColumn("j", F.pmod(F.xxhash64("label"), F.lit(n_labels)).cast("int")).withColumn("i", every(n_items))
    types = {**dict(rows.dtypes), **dict(named.dtypes)}

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"key": [], "label": [], "logit": []})]
        sizes, widths = left["v"].map(len), right["w"].map(len)
        for dim in sizes.unique():
            mine, theirs = left[sizes == dim], right[widths == dim].sort_values("label", kind="stable")
            if not len(theirs):
                continue
            logits = np.stack(mine["v"].to_numpy()).reshape(-1, dim) @ np.stack(theirs["w"].to_numpy()).reshape(-1, dim).T
            top = np.argsort(-logits, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(mine)), top.shape[1])
            found = {"key": mine["key"].to_numpy()[at], "label": theirs["label"].to_numpy()[top.ravel()]}
            out.append(pd.DataFrame({**found, "logit": np.take_along_axis(logits, top, axis=1).ravel()}))
        return pd.concat(out[1:] or out)

    found = (
        placed.groupBy("i", "j")
        .cogroup(spread.groupBy("i", "j"))
        .applyInPandas(best, f"key {types['key']}, label {types['label']}, logit double")
    )
    order = Window.partitionBy("key").orderBy(F.desc("logit"), "label")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(
        F.col("key").alias(key), "rank", F.col("label").alias(label), "logit", sigmoid(F.col("logit")).alias("score")
    )


# --- plug-in detectors ---------------------------------------------------------------------------

_PLUGIN = "struct<spans:array<struct<start:bigint,end:bigint,label:string,score:double>>,failed:boolean>"


@dataclass(frozen=True)
class DetectorPlugin:
    """A third-party detector.

    ``load`` runs once per Python worker and returns a function from a text to a list of
    (start, end, label, score), or with ``batch`` from a list of up to that many texts to one such list
    each.  With ``byte_offsets`` its ranges are UTF-8 byte offsets and are widened to whole
    characters.  A text it fails on, or gives anything else for, gets no spans and counts as
    failed; the other texts of its batch do not suffer.
    """

    name: str
    load: Callable[[], Callable]
    byte_offsets: bool = False
    labels: tuple[str, ...] | None = None
    threshold: float | None = None
    batch: int | None = None


# Detectors loaded in this worker, newest last; older ones are let go.
_LOADED: dict[str, Callable] = {}
MAX_LOADED = 4


@functools.lru_cache(maxsize=256)
def _tag(plugin: DetectorPlugin) -> str:
    """One name per plug-in object, however many plans use it."""
    return f"{plugin.name}-{uuid.uuid4().hex}"


def _to_characters(text: str, start: int, end: int) -> tuple[int, int]:
    """Byte range to character range, widened outward to whole characters."""
    raw = text.encode()
    start, end = (min(max(x, 0), len(raw)) for x in (start, end))
    while start > 0 and start < len(raw) and raw[start] & 0xC0 == 0x80:
        start -= 1
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end += 1
    return len(raw[:start].decode()), len(raw[:end].decode())


def _plugin_column(plugin: DetectorPlugin, text: Column) -> Column:
    tag = _tag(plugin)

    @F.pandas_udf(_PLUGIN)
    def run(texts: pd.Series) -> pd.DataFrame:
        if tag not in _LOADED:
            while len(_LOADED) >= MAX_LOADED:
                _LOADED.pop(next(iter(_LOADED)))
            _LOADED[tag] = plugin.load()
        found = _found_in(list(texts), _LOADED[tag], plugin)
        spans = [[] if x is None else [dict(zip(_SPAN_FIELDS, s)) for s in x] for x in found]
        return pd.DataFrame({"spans": spans, "failed": [x is None for x in found]})

    return run(text)


_SPAN_FIELDS = ("start", "end", "label", "score")


def _found_in(texts: list[str], detect: Callable, plugin: DetectorPlugin) -> list[list[tuple] | None]:
    """Checked spans of each text; None for one the detector failed on."""
    out: list[list[tuple] | None] = [[] for _ in texts]
    asked = [i for i, t in enumerate(texts) if t.strip()]
    step = plugin.batch or 1
    for a in range(0, len(asked), step):
        part = asked[a : a + step]
        try:
            answers = list(detect([texts[i] for i in part])) if plugin.batch else [detect(texts[part[0]])]
            if len(answers) != len(part):
                raise ValueError("one answer for each text")
        except Exception:
            if len(part) > 1:
                # One text spoils a whole call: ask for each alone.
                for i in part:
                    out[i] = _found_in([texts[i]], detect, plugin)[0]
            else:
                out[part[0]] = None
            continue
        for i, answer in zip(part, answers):
            try:
                out[i] = [_checked(texts[i], s, plugin.byte_offsets) for s in answer]
            except Exception:
                out[i] = None
    return out


def _checked(text: str, span, byte_offsets: bool) -> tuple[int, int, str, float]:
    """A plug-in's span in the types it must have; anything else is an error."""
    start, end, label, score = span
    start, end, score = operator.index(start), operator.index(end), float(score)
    if not isinstance(label, str) or math.isnan(score) or max(abs(start), abs(end)) >= 1 << 63:
        raise ValueError("a span is (start, end, label, score)")
    return (*(_to_characters(text, start, end) if byte_offsets else (start, end)), label, score)


def with_plugin_spans(
    df: DataFrame, plugin: DetectorPlugin, text: str = "text", out: str = "plugin_spans"
) -> DataFrame:
    """Add the plug-in layer and a ``failed`` flag."""
    t = F.coalesce(F.col(text), F.lit(""))
    ran = df.withColumn("__plugin", _plugin_column(plugin, t))
    tagged = F.transform(
        F.col("__plugin.spans"),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["label"].alias("label"),
            F.lit(plugin.name).alias("source"),
            s["score"].alias("score"),
        ),
    )
    spans = S.clamped(tagged, t)
    if plugin.labels is not None:
        wanted = F.array(*[F.lit(x) for x in plugin.labels])
        spans = F.filter(spans, lambda s: F.array_contains(wanted, s["label"]))
    if plugin.threshold is not None and 0.0 <= plugin.threshold <= 1.0:
        spans = F.filter(spans, lambda s: s["score"] >= plugin.threshold)
    done = S.settled(ran, {out: spans, "failed": F.col("__plugin.failed")})
    return done.select(*df.columns, out, "failed")


def detector_failures(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("segments"), F.count_if("failed").alias("failures"))

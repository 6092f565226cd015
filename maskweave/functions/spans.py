"""Span arrays: finding, ordering, merging and applying detected ranges.

A span is a half-open code-point range of one text plus its label.  All functions work on
an ``array<span>`` column of the row that owns the text, so none of them shuffles.  The folds are
SQL text over column names: one call to the JVM each, however long the expression.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN_TYPE = "struct<start:bigint,end:bigint,label:string,source:string,score:double,value:string>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"
RANGES_TYPE = "array<struct<start:bigint,end:bigint,value:string>>"


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add computed columns that are evaluated once per row.

    A plain projection can be inlined: a later filter on a detection result would be pushed
    below it with a copy of the whole expression, layer over layer.  Columns that come out of
    ``inline`` over one struct are real values to the optimizer, so filters on them stay above,
    while filters on other columns still reach the scan.
    """
    rest = [c for c in df.columns if c not in columns]
    row = F.struct(*[e.alias(n) for n, e in columns.items()])
    return df.select(*rest, F.inline(F.array(row)))


def no_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def no_strings() -> Column:
    return F.array().cast("array<string>")


def all_matches(text: Column, pattern: str | Column) -> Column:
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.regexp_extract_all(text, p, F.lit(0))


def sql_text(s: str) -> str:
    """A string as a Spark SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pieces(text: str, pattern: str) -> str:
    """The text around the matches of a pattern, as an SQL array."""
    return f"split({text}, {pattern}, -1)"


# Items folded between two copies of the output.
FOLD_BLOCK = 64


def one(item: str, array_type: str) -> str:
    """SQL of an array of one item, of exactly this type: appended to an array that may hold
    nulls where it does not, it would have that whole array cast first."""
    return f"CAST(array({item}) AS {array_type})"


def folded(
    items: str, state: str, out_type: str, step: str, state_type: str = "bigint", short: bool = False
) -> str:
    """SQL of a left fold over an array that emits elements, in time nearly linear in its size.

    ``step`` is an SQL expression over ``acc.st`` (the state), ``acc.out`` and the item ``x``; it
    must be struct(<state> AS st, <acc.out with new elements> AS out).  A fold copies what it has
    gathered at every step, so it must not gather much: a first pass keeps the state at the start
    of every block of items and drops the output, a second one emits each block from its state.

    Items are taken by index, since ``slice`` walks the whole array each time.  ``items`` should
    be a column or lambda variable: it is named once for every item.  The result is struct(st, out).
    With ``short`` an array of one block is folded plainly, once.
    """
    empty = f"CAST(array() AS array<{out_type}>)"

    def block(at: str, start: str, result: str) -> str:
        stop = f"least({at} + {FOLD_BLOCK - 1}, size({items}))"
        return f"""aggregate(transform(sequence({at} - 1, {stop} - 1), i -> {items}[i]),
          struct(CAST({start} AS {state_type}) AS st, {empty} AS out), (acc, x) -> {step},
          part -> {result})"""

    kept = one("whole.st", f"array<{state_type}>")
    following = block("at", "whole.st", f"struct(part.st AS st, concat(whole.out, {kept}) AS out)")
    emitted = block(f"(k * {FOLD_BLOCK} + 1)", "s", "part.out")
    blocks = f"""aggregate(
      CASE WHEN size({items}) > 0 THEN sequence(1, size({items}), {FOLD_BLOCK})
        ELSE CAST(array() AS array<int>) END,
      struct(CAST({state} AS {state_type}) AS st, CAST(array() AS array<{state_type}>) AS out),
      (whole, at) -> {following},
      whole -> struct(whole.st AS st, flatten(transform(whole.out, (s, k) -> {emitted})) AS out))"""
    if not short:
        return blocks
    once = f"aggregate({items}, struct(CAST({state} AS {state_type}) AS st, {empty} AS out), (acc, x) -> {step})"
    return f"CASE WHEN size({items}) <= {FOLD_BLOCK} THEN {once} ELSE {blocks} END"


def ranges(gaps: str, matches: str, short: bool = False) -> Column:
    """Positions of ``matches``, every match of a pattern in order, from ``gaps``, the pieces
    around them (both are SQL arrays).

    Summing lengths along (piece, match, piece, ...) gives each match's start.  The pieces are
    only made for rows that have a match.
    """
    new = one("struct(acc.st + x.gap AS `start`, acc.st + x.gap + x.len AS `end`, x.hit AS value)", RANGES_TYPE)
    step = f"""struct(acc.st + x.gap + x.len AS st,
        concat(acc.out, {new}) AS out)"""
    fold = folded("z", "0L", RANGES_TYPE[6:-1], step, short=short)
    # One-element transform: the zipped array is made once and named.
    return F.expr(
        f"""CASE WHEN size({matches}) > 0 THEN flatten(transform(array(
          zip_with(slice({gaps}, 1, size({matches})), {matches},
            (g, m) -> struct(length(g) AS gap, length(m) AS len, m AS hit))),
          z -> ({fold}).out))
        ELSE CAST(array() AS {RANGES_TYPE}) END"""
    )


# Items of span arrays worked on at a time inside an Arrow batch; bounds memory, changes no result.
BATCH_ITEMS = 250_000


def _cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of rows with about ``limit`` items; a row is never cut."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, last - first
        first = last


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def positions(gaps: Column, matches: Column) -> Column:
    """struct(start, end) of two arrays: where each match lies, from the lengths of the pieces
    around the matches and of the matches themselves.

    For texts with a match at every word.  Running sums of whole batches take the place of the fold
    of :func:`ranges`, whose steps copy what they have gathered.
    """
    return _positions()(gaps, matches)


@functools.cache
def _positions():
    def located(gaps: pa.ListArray, matches: pa.ListArray) -> pa.StructArray:
        n, around = _sizes(matches), _sizes(gaps)
        upto = np.concatenate(([0], np.cumsum(n)))
        lens = matches.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        # The piece before match k of a row is piece k of that row.
        before = np.repeat(np.cumsum(around) - around - upto[:-1], n) + np.arange(len(lens))
        run = np.cumsum(gaps.flatten().to_numpy(zero_copy_only=False)[before] + lens)
        base = np.concatenate(([0], run))[upto[:-1]]
        end = run - np.repeat(base, n)
        offsets = pa.array(upto.astype(np.int32))
        sides = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (end - lens, end)]
        return pa.StructArray.from_arrays(sides, ["start", "end"])

    @F.arrow_udf("struct<start:array<bigint>,end:array<bigint>>")
    def where(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for gaps, matches in batches:
            for first, rows in _cuts(_sizes(matches), BATCH_ITEMS):
                yield located(gaps.slice(first, rows), matches.slice(first, rows))

    return where


def labelled(found: Column, label, source: str) -> Column:
    """Turn ranges into spans; ``label`` is a name or a function of the matched range."""

    def one(r: Column) -> Column:
        name = F.lit(label) if isinstance(label, str) else label(r)
        return F.struct(
            r["start"].alias("start"),
            r["end"].alias("end"),
            name.alias("label"),
            F.lit(source).alias("source"),
            F.lit(0.0).alias("score"),
            r["value"].alias("value"),
        )

    return F.transform(found, one)


def merged(spans: str) -> Column:
    """Drop overlaps: earliest start, then source priority, then longest, then list order.

    Deterministic layers outrank any other detector at the same start.  A dropped span does not
    move the frontier, which is why this is a fold and not a running maximum.
    """
    step = f"""CASE WHEN x.`start` >= acc.st
        THEN struct(x.span.`end` AS st, concat(acc.out, {one("x.span", SPANS_TYPE)}) AS out)
        ELSE acc END"""
    fold = folded("z", "-1L", SPAN_TYPE, step, short=True)
    return F.expr(
        f"""CASE WHEN size({spans}) > 1 THEN flatten(transform(array(
          sort_array(transform({spans}, (s, i) -> struct(s.`start` AS `start`,
            CASE s.source WHEN 'dictionary' THEN 0 WHEN 'regex' THEN 1 ELSE 2 END AS prio,
            s.`start` - s.`end` AS neg_len, i AS ord, s AS span)))),
          z -> ({fold}).out))
        ELSE {spans} END"""
    )


def suppressed(spans: str) -> Column:
    """Score suppression: best score first, drop overlaps with a kept span of the same label.

    Kept spans of one label do not overlap, so they stay sorted by start and by end at once, and
    a span is compared with one neighbour only.  A fold in the JVM would copy what it has kept at
    every step; this is one Arrow call on bounds, scores and labels.  Spans without a score come
    first, those of score NaN last; one that ends before it starts, or lacks a bound, overlaps nothing.
    """
    part = lambda name: F.transform(spans, lambda s: s[name])
    kept = _kept_numbers()(part("start"), part("end"), part("label"), part("score"))
    return F.transform(kept, lambda i: F.get(F.col(spans), i))


@functools.cache
def _kept_numbers():
    def one(starts, ends, labels, scores) -> list[int]:
        def rank(i: int):
            x = scores[i]
            return (0, 0.0, i) if x is None else (2, 0.0, i) if x != x else (1, -x, i)

        lists: dict[str | None, tuple[list, list]] = {}
        kept = []
        for i in sorted(range(len(starts)), key=rank):
            start, end, label = starts[i], ends[i], labels[i]
            if start is not None and end is not None and start <= end and label is not None:
                begins, stops = lists.setdefault(label, ([], []))
                at = bisect_right(stops, start)
                if at < len(begins) and begins[at] < end:
                    continue
                begins.insert(at, start)
                stops.insert(at, end)
            kept.append(i)
        return kept

    @F.arrow_udf("array<int>")
    def numbers(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for parts in batches:
            # Few spans at a time become Python objects, and the answer leaves as it is found.
            for first, n in _cuts(_sizes(parts[0]), BATCH_ITEMS):
                rows = zip(*(x.slice(first, n).to_pylist() for x in parts))
                yield pa.array([None if r[0] is None else one(*r) for r in rows], pa.list_(pa.int32()))

    return numbers


def leftmost_longest(candidates: str, text: str) -> Column:
    """Spans from dictionary candidates: sorted by start and rank, skipping what overlaps."""
    span = f"""struct(x.`start` AS `start`, x.`end` AS `end`,
          x.label AS label, 'dictionary' AS source, 0.0D AS score,
          substring({text}, CAST(x.`start` + 1 AS INT), CAST(x.`end` - x.`start` AS INT))
            AS value)"""
    step = f"""CASE WHEN x.`start` >= acc.st
      THEN struct(x.`end` AS st, concat(acc.out, {one(span, SPANS_TYPE)}) AS out)
      ELSE acc END"""
    fold = folded("z", "0L", SPAN_TYPE, step, short=True)
    return F.expr(f"flatten(transform(array(sort_array({candidates})), z -> ({fold}).out))")


def clamped(spans: Column, text: Column) -> Column:
    """Cut third-party offsets to the text and drop what is empty afterwards."""
    n = F.length(text).cast("bigint")

    def fix(s: Column) -> Column:
        start = F.least(F.greatest(s["start"], F.lit(0).cast("bigint")), n)
        end = F.least(F.greatest(s["end"], F.lit(0).cast("bigint")), n)
        return F.struct(
            start.alias("start"),
            end.alias("end"),
            s["label"].alias("label"),
            s["source"].alias("source"),
            s["score"].cast("double").alias("score"),
            F.substring(text, start + 1, end - start).alias("value"),
        )

    return F.filter(F.transform(spans, fix), lambda s: s["start"] < s["end"])


def applied(text: str, cuts: str) -> Column:
    """Replace each range of ``cuts`` (array of start, end, placeholder; in order) in one pass.

    Taking a piece of a text walks the text up to it, so each block of cuts first takes the stretch
    it covers and its cuts work on that.
    """
    block = FOLD_BLOCK
    first = f"CASE WHEN at = 1 THEN 0L ELSE {cuts}[at - 2].`end` END"
    last = f"least(at + {block - 1}, size({cuts})) - 1"
    before = f"CASE WHEN i = 0 THEN 0L ELSE {cuts}[i - 1].`end` END"
    gap = f"""substring(b.part, CAST({before} - b.lo + 1 AS INT), CAST({cuts}[i].`start` - ({before}) AS INT))"""
    stretch = f"""struct({first} AS lo, substring({text}, CAST({first} + 1 AS INT),
        CAST({cuts}[{last}].`end` - ({first}) AS INT)) AS part)"""
    return F.expr(
        f"""CASE WHEN size({cuts}) > 0 THEN concat(
          array_join(flatten(transform(sequence(1, size({cuts}), {block}), at ->
            flatten(transform(array({stretch}), b ->
              transform(sequence(at - 1, {last}), i -> concat({gap}, {cuts}[i].placeholder)))))), ''),
          substring({text}, CAST({cuts}[size({cuts}) - 1].`end` + 1 AS INT)))
        ELSE {text} END"""
    )

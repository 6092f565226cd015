"""Dictionary detector: taught terms anywhere in the text, longest form first.

Three ways to match, chosen by the size of the policy:

* few forms: one JVM regular expression per scope, a literal in the plan;
* more forms: a broadcast of at most ``CHUNK_BYTES`` of forms, matched by an automaton in an Arrow
  batch function;
* more than that: an index of the forms that the texts' grams are joined with
  (``dictionary_index``), so that nothing broadcast grows with the policy.

All give the same spans.  The first two stay in the row: no key, no shuffle.  A stream, where a join
and a grouping would need state, takes broadcast chunks whatever their number.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
from collections import OrderedDict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions import spans as S
from maskweave.functions.patterns import GLOBAL_SCOPE
from maskweave.functions.text import ascii_lower
from maskweave.operators.dictionary_index import FORM_COLUMNS, with_indexed_spans
from maskweave.operators.dictionary_match import (
    CANDIDATE,
    asks_edge,
    at_edges,
    fold_char,
    fold_table,
    fold_text,
)
from maskweave.operators.policy import hidden_forms

# Measured on 25 MB of text: up to about 50 forms the pattern wins (no Python worker), beyond
# it the automaton does, whose cost hardly grows with the number of forms.
MAX_PATTERN_FORMS = 50
MAX_PATTERN_SCOPES = 64
CHUNK_BYTES = 64 * 1024 * 1024
# Forms whose automata a Python worker keeps.
WORKER_BYTES = 2 * CHUNK_BYTES

_MARK = "\ue000"  # a private-use character

_SHAPES = "array<struct<p:string,label:string>>"

@dataclass(frozen=True)
class Form:
    scope: str
    form: str
    label: str
    whole_word: bool
    ord: int
    form_no: int

    @property
    def rank(self):
        return (-len(self.form.encode()), self.ord, self.form_no)


# --- few forms: a pattern per scope ----------------------------------------------------


@functools.cache
def _variants() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for cp, low in fold_table().items():
        out.setdefault(low, [low]).append(chr(cp))
    return out


def _literal(folded: str) -> str:
    """One character in all its cases.  Spelled out rather than left to a case-insensitive flag:
    a character class is one table lookup in the matcher."""
    chars = [c if c.isascii() and c.isalnum() else "\\x{%x}" % ord(c) for c in
             _variants().get(folded, [folded])]
    return chars[0] if len(chars) == 1 else f"[{''.join(chars)}]"


def visible(forms: list[Form], scope: str | None) -> list[Form]:
    """Forms a request scope sees, one per lower-cased spelling, longest first."""
    seen: dict[str, Form] = {}
    mine = [f for f in forms if scope is None or f.scope in (GLOBAL_SCOPE, scope)]
    for f in sorted(mine, key=lambda f: (f.whole_word, *f.rank)):
        seen.setdefault(f.form.lower(), f)
    return sorted(seen.values(), key=lambda f: f.rank)


def _edges(f: Form) -> str:
    """Word-edge tests of a whole-word form, written after its last character."""
    if not f.whole_word:
        return ""
    lead = trail = ""
    if asks_edge(f.form[0]):
        # A look-behind counts code points only if it holds a character beyond the BMP itself.
        wide = any(ord(c) > 0xFFFF for c in f.form)
        any_char = "[\\s\\S\U00010000]" if wide else r"[\s\S]"
        lead = r"(?<=(?<!\w)%s{%d})" % (any_char, len(f.form))
    if asks_edge(f.form[-1]):
        trail = r"(?!\w)"
    return lead + trail


def _tree(entries: list[tuple[str, str]]) -> str:
    """Pattern for (folded rest, edge test) pairs: shared prefixes once, longer rests first."""
    ends = [edge for rest, edge in entries if not rest]
    groups: dict[str, list[tuple[str, str]]] = {}
    for rest, edge in entries:
        if rest:
            groups.setdefault(rest[0], []).append((rest[1:], edge))
    if len(groups) == 1 and not ends:
        (first, rest), = groups.items()
        shared = os.path.commonprefix([r for r, _ in rest])
        below = [(r[len(shared):], e) for r, e in rest]
        return "".join(map(_literal, first + shared)) + _tree(below)
    if not groups and len(ends) == 1:
        return ends[0]
    if "" in ends:
        ends = [""]
    parts = [_tree([(first + r, e) for r, e in rest]) for first, rest in groups.items()]
    return "(?:" + "|".join([*parts, *ends]) + ")"


def pattern_for(forms: list[Form]) -> str:
    """Leftmost, then longest match of any form, in every case.

    The tree tries longer forms before the shorter ones they start with.  A look-ahead over the
    possible first characters rejects most positions at the cost of one lookup.
    """
    entries = [("".join(map(fold_char, f.form)), _edges(f)) for f in forms]
    firsts = {_literal(rest[0]).strip("[]") for rest, _ in entries}
    return f"(?U)(?=[{''.join(sorted(firsts))}])" + _tree(entries)


def _by_scope(scope: Column | None, named: dict[str, Column], everything: Column, rest: Column):
    """Pick the value for the row's scope: its own, the global one, or all without a scope."""
    if scope is None:
        return everything
    case = F.when(scope.isNull(), everything)
    for name, value in named.items():
        case = case.when(ascii_lower(scope) == name, value)
    return case.otherwise(rest)


def _pattern_spans(
    df: DataFrame, forms: list[Form], text: str, scope: str | None, out: str
) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    request = F.col(scope) if scope else None
    own = sorted({f.scope for f in forms} - {GLOBAL_SCOPE}) if scope else []
    sets = {s: visible(forms, s) for s in own}
    everything = visible(forms, None)
    rest = visible(forms, GLOBAL_SCOPE) if scope else []

    def pick(build, empty):
        made = lambda fs: build(fs) if fs else empty
        return _by_scope(
            request, {s: made(fs) for s, fs in sets.items()}, made(everything), made(rest)
        )

    def names(fs: list[Form]) -> Column:
        pairs: dict[str, str] = {}
        for f in fs:
            pairs.setdefault(f.form.lower(), f.label)
            pairs.setdefault("".join(map(fold_char, f.form)), f.label)
        return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")

    def odd_shapes(fs: list[Form]) -> Column:
        # An ASCII form is always found by one of the two lower-cased lookups.
        odd = [{"p": pattern_for([f]), "label": f.label} for f in fs if not f.form.isascii()]
        return F.from_json(F.lit(json.dumps(odd)), _SHAPES) if odd else no_shapes

    no_shapes = F.array().cast(_SHAPES)
    patterns = {id(fs): pattern_for(fs) for fs in [*sets.values(), everything, rest] if fs}
    hits = S.settled(
        df, {"__dict_hit": pick(lambda fs: S.all_matches(t, patterns[id(fs)]), S.no_strings())}
    )
    # ``split`` compiles its pattern for every row, ``regexp_replace`` once per task: mark the
    # matches with a character the text does not hold, then split on that character.
    some = F.size("__dict_hit") > 0
    marked = pick(lambda fs: F.regexp_replace(t, F.lit(patterns[id(fs)]), F.lit(_MARK)), t)
    direct = pick(lambda fs: F.split(t, F.lit(patterns[id(fs)]), F.lit(-1)), S.no_strings())
    gaps = F.when(some & F.contains(t, F.lit(_MARK)), direct).when(some, F.split(marked, _MARK, -1))
    hits = S.settled(hits, {"__dict_gaps": gaps})
    labels = pick(names, F.create_map().cast("map<string,string>"))
    shapes = pick(odd_shapes, no_shapes)

    def label_of(r: Column) -> Column:
        # Some hits differ from their form even in lower case (a long s, a kelvin sign): look again by shape.
        folded = F.filter(shapes, lambda x: F.regexp_like(r["value"], F.concat(F.lit("^(?:"), x["p"], F.lit(")$"))))
        return F.coalesce(
            F.element_at(labels, F.lower(r["value"])),
            F.element_at(labels, F.lower(F.upper(r["value"]))),
            F.get(folded, F.lit(0))["label"],
        )

    found = S.ranges("__dict_gaps", "__dict_hit", short=True)
    spans = S.labelled(found, label_of, "dictionary")
    return S.settled(hits, {out: spans}).drop("__dict_hit", "__dict_gaps")


# --- many forms: automaton over broadcast chunks ----------------------------------------


# Automata of this worker by chunk, the least recently used first.
_WORKER: OrderedDict[str, tuple] = OrderedDict()


def _automaton(handle):
    """The automaton of one broadcast chunk, built once per Python worker as long as the worker's
    automata stay within ``WORKER_BYTES`` of forms."""
    import ahocorasick

    chunk = handle.value
    if chunk["id"] not in _WORKER:
        auto = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for row in chunk["forms"]:
            f = Form(*row)
            entries.setdefault(fold_text(f.form), []).append(f)
        for key, forms in entries.items():
            forms.sort(key=lambda f: (f.whole_word, *f.rank))
            auto.add_word(key, (len(key), forms))
        auto.make_automaton()
        _WORKER[chunk["id"]] = (auto, chunk["bytes"])
        while len(_WORKER) > 1 and sum(size for _, size in _WORKER.values()) > WORKER_BYTES:
            _WORKER.popitem(last=False)
    _WORKER.move_to_end(chunk["id"])
    return _WORKER[chunk["id"]][0]


def _candidates(auto, text: str, scope: str | None, everything: bool) -> list[tuple]:
    """Best form at each start position of one text, as tuples in
    the order of ``CANDIDATE``."""
    best: dict[int, tuple] = {}
    for last, (n, forms) in auto.iter(fold_text(text)):
        start, end = last - n + 1, last + 1
        for f in forms:
            if not everything and f.scope not in (GLOBAL_SCOPE, scope):
                continue
            if f.whole_word and not at_edges(text, start, end, f.form[0], f.form[-1]):
                continue
            size, order, number = f.rank
            found = (start, size, f.whole_word, order, number, end, f.label)
            if start not in best or found < best[start]:
                best[start] = found
            break
    return [best[s] for s in sorted(best)]


def _candidate_column(handle, text: Column, scope: Column | None) -> Column:
    scoped = scope is not None

    @F.pandas_udf(CANDIDATE)
    def match(texts: pd.Series, scopes: pd.Series) -> pd.Series:
        auto = _automaton(handle)
        rows = [
            _candidates(auto, t, s, not scoped or s is None) if t else []
            for t, s in zip(texts, scopes)
        ]
        return pd.Series(rows)

    key = ascii_lower(scope) if scoped else F.lit(None).cast("string")
    return match(F.coalesce(text, F.lit("")), key)


def _chunk_handles(forms: DataFrame, total_bytes: int, chunk_bytes: int):
    """Yield one broadcast per chunk of forms; only one chunk is on the driver at a time."""
    context = forms.sparkSession.sparkContext
    chunks = max(1, -(-total_bytes // chunk_bytes))
    # By form and scope: a term taught in many scopes spreads over the chunks.
    slot = F.pmod(F.xxhash64(F.lower("form"), "scope"), F.lit(chunks))
    for i in range(chunks):
        part = forms if chunks == 1 else forms.where(slot == i)
        rows = [tuple(r) for r in part.select(*FORM_COLUMNS).collect()]
        if rows:
            size = sum(len(r[1]) + len(r[2]) + 200 for r in rows)
            yield context.broadcast({"id": uuid.uuid4().hex, "forms": rows, "bytes": size})


def _automaton_spans(
    df: DataFrame,
    forms: DataFrame,
    text: str,
    scope: str | None,
    out: str,
    total_bytes: int,
    chunk_bytes: int,
) -> DataFrame:
    request = F.col(scope) if scope else None
    handles = list(_chunk_handles(forms, total_bytes, chunk_bytes))
    # One pass per chunk, all in the row; a candidate carries all that its rank depends on.
    found = {f"__cand_{i}": _candidate_column(h, F.col(text), request) for i, h in enumerate(handles)}
    best = S.leftmost_longest(f"concat({', '.join(found)})", f"`{text}`")
    return S.settled(df.withColumns(found), {out: best}).drop(*found)


# --- entry point -----------------------------------------------------------------------


def with_dictionary_spans(
    df: DataFrame,
    policy: DataFrame,
    text: str = "text",
    scope: str | None = None,
    out: str = "dictionary_spans",
    key: list[str] | None = None,
    max_forms: int = MAX_PATTERN_FORMS,
    chunk_bytes: int = CHUNK_BYTES,
    chunks: bool = False,
) -> DataFrame:
    """Add the dictionary layer.  ``scope`` names the request-scope column; without one every
    entry applies.  ``chunks`` keeps a policy above ``chunk_bytes`` in broadcast chunks, as in
    streams; ``key`` is not needed any more."""
    forms = hidden_forms(policy).select(*FORM_COLUMNS)
    cost = F.octet_length("form") + F.octet_length("label") + F.lit(200)
    size = forms.agg(
        F.count("*").alias("forms"),
        F.coalesce(F.sum(cost), F.lit(0)).alias("bytes"),
    ).first()
    if size.forms == 0:
        return df.withColumn(out, S.no_spans())
    if size.forms <= max_forms and size.bytes <= chunk_bytes:
        few = [Form(*r) for r in forms.collect()]
        if len({f.scope for f in few}) <= MAX_PATTERN_SCOPES:
            return _pattern_spans(df, few, text, scope, out)
    if size.bytes > chunk_bytes and not df.isStreaming and not chunks:
        return with_indexed_spans(df, forms, text, scope, out)
    return _automaton_spans(df, forms, text, scope, out, size.bytes, chunk_bytes)

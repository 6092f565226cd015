"""Request bodies: which strings are redactable, and putting redacted ones back.

Chat bodies have a fixed depth and are walked by built-in functions (``chat_bodies``).  Block bodies and
JSON trees nest without limit; they are walked one at a time in Arrow batches.  Bodies are limited
in size before they get here, so the work per row is bounded and nothing is grouped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.operators import chat_bodies as C

_LEAVES = "array<struct<path:string,value:string>>"
_MISSING = object()


def _on_strings(node, path: str, put: Callable[[str, str], str], keys=None):
    """Apply ``put`` to every string below ``node``, objects in sorted key order."""
    if isinstance(node, str):
        return put(path, node)
    if isinstance(node, list):
        return [_on_strings(v, f"{path}[{i}]", put, keys) for i, v in enumerate(node)]
    if isinstance(node, dict):
        out = {}
        for k in sorted(node):
            if keys is not None:
                keys(f"{path}.{k}", k)
            out[k] = _on_strings(node[k], f"{path}.{k}", put, keys)
        return out
    return node


def _fields(holder, path: str, names: tuple[str, ...], put) -> None:
    """Apply ``put`` to the named string fields of an object, in place."""
    if isinstance(holder, dict):
        for name in names:
            if isinstance(holder.get(name, _MISSING), str):
                holder[name] = put(f"{path}.{name}", holder[name])


def _items(node, path: str):
    return [(v, f"{path}[{i}]") for i, v in enumerate(node)] if isinstance(node, list) else []


def _block_content(holder, here: str, put) -> None:
    """Content of a message or of a tool result, which may hold further results."""
    _fields(holder, here, ("content",), put)
    content = holder.get("content") if isinstance(holder, dict) else None
    for block, spot in _items(content, f"{here}.content"):
        kind = block.get("type") if isinstance(block, dict) else None
        if kind == "text":
            _fields(block, spot, ("text",), put)
        elif kind == "tool_use" and "input" in block:
            block["input"] = _on_strings(block["input"], f"{spot}.input", put)
        elif kind == "tool_result":
            _block_content(block, spot, put)


def _blocks(body, put) -> None:
    """A system text or text blocks, then messages made of typed content blocks."""
    if not isinstance(body, dict):
        return
    _fields(body, "", ("system",), put)
    for block, here in _items(body.get("system"), "system"):
        if isinstance(block, dict) and block.get("type") == "text":
            _fields(block, here, ("text",), put)
    for msg, at in _items(body.get("messages"), "messages"):
        _block_content(msg, at, put)


WALKS = {"blocks": _blocks}


# Deeper bodies are refused: no client sends them, and a walk must not run out of stack.
MAX_DEPTH = 200


def _depth_over(raw: str, limit: int) -> bool:
    """Whether brackets outside strings nest deeper than ``limit``."""
    depth = 0
    quoted = False
    for token in _BRACKETS.findall(raw):
        if token == '"':
            quoted = not quoted
        elif quoted or token[0] == "\\":
            continue
        elif token in "[{":
            depth += 1
            if depth > limit:
                return True
        else:
            depth -= 1
    return False


# Brackets, quotes, and each backslash with the character it escapes.
_BRACKETS = re.compile(r'\\.|["\[\]{}]', re.S)


def _read(raw: str | None) -> tuple[object, str | None]:
    """(tree, reason it cannot be used)."""
    if not raw:
        return None, "unreadable_body"
    if _depth_over(raw, MAX_DEPTH):
        return None, "body_too_deep"
    try:
        return json.loads(raw), None
    except (ValueError, RecursionError):
        return None, "unreadable_body"


def _parsed(raw: str | None):
    return _read(raw)[0]


def _refusal(raw: str | None, shape: str | None) -> str | None:
    tree, reason = _read(raw)
    if reason is None and shape is not None:
        if not isinstance(tree, dict) or not isinstance(tree.get("messages"), list):
            return "unreadable_body"
    return reason


def with_body_reason(df: DataFrame, body: str = "body", shape: str | None = None) -> DataFrame:
    """Add ``reason``: ``unreadable_body`` (no JSON, or no list of messages where ``shape`` asks for
    one), ``body_too_deep``, or null for a body that can be walked.  Such a body yields no segment
    and must be held back, not passed on as having nothing to redact."""

    if shape == "chat":
        read = C.with_tree(df, body, MAX_DEPTH, "__tree", "reason")
        why = F.coalesce("reason", F.when(~C.has_messages(F.col("__tree")), "unreadable_body"))
        return read.withColumn("reason", why).drop("__tree")

    @F.pandas_udf("string")
    def refuse(bodies: pd.Series) -> pd.Series:
        return pd.Series([_refusal(raw, shape) for raw in bodies], dtype=object)

    return df.withColumn("reason", refuse(F.col(body)))


def segments_column(body: Column, shape: str) -> Column:
    """Redactable strings of a body in walk order, as ``array<struct<path,value>>``."""
    walk = WALKS[shape]

    @F.pandas_udf(_LEAVES)
    def collect(bodies: pd.Series) -> pd.Series:
        out = []
        for raw in bodies:
            found: list[tuple[str, str]] = []
            walk(_parsed(raw), lambda p, v: found.append((p, v)) or v)
            out.append(found)
        return pd.Series(out)

    return collect(body)


def extract_segments(df: DataFrame, shape: str, *key: str, body: str = "body") -> DataFrame:
    """One row per redactable string: (key.., seg_no, path, text)."""
    if shape == "chat":
        read = C.with_tree(df.select(*key, body), body, MAX_DEPTH, "__tree", "__reason")
        found = read.select(*key, C.segments(F.col("__tree")).alias("__segs"))
    else:
        found = df.select(*key, segments_column(F.col(body), shape).alias("__segs"))
    rows = found.select(*key, F.posexplode("__segs").alias("seg_no", "s"))
    return rows.select(
        *key,
        F.col("seg_no").cast("bigint").alias("seg_no"),
        F.col("s.path").alias("path"),
        F.col("s.value").alias("text"),
    )


def rebuilt_column(body: Column, texts: Column, shape: str) -> Column:
    """The body with its redactable strings replaced by ``texts``, in the same walk order.

    Every other field is kept.  Keys come out sorted and without spaces.  A body that cannot be
    read is not rebuilt: null.
    """
    walk = WALKS[shape]

    @F.pandas_udf("string")
    def put_back(bodies: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for raw, new in zip(bodies, values):
            tree, reason = _read(raw)
            if reason is not None:
                out.append(None)
                continue
            queue = iter(new if new is not None else [])
            walk(tree, lambda _p, _v: next(queue))
            out.append(_dump(tree))
        return pd.Series(out)

    return put_back(body, texts)


def _dump(tree) -> str:
    return json.dumps(tree, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def rebuild_bodies(
    bodies: DataFrame, segments: DataFrame, shape: str, key: list[str], text: str = "redacted"
) -> DataFrame:
    """Join redacted segments back into their bodies.  A body's segments are bounded by the
    body's size.  In chat bodies each goes to its ``path``, in block bodies they follow ``seg_no``."""
    if shape == "chat":
        pairs = F.map_from_entries(F.collect_list(F.struct("path", text))).alias("__texts")
        read = C.with_tree(bodies, "body", MAX_DEPTH, "__tree", "__reason")
        joined = read.join(segments.groupBy(*key).agg(pairs), key, "left")
        texts = F.coalesce("__texts", F.create_map().cast("map<string,string>"))
        return joined.withColumn("rebuilt", C.rebuilt(F.col("__tree"), texts)).drop("__texts", "__tree", "__reason")
    lists = segments.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("seg_no", text))).alias("__t")
    ).select(*key, F.transform("__t", lambda x: x[text]).alias("__texts"))
    return (
        bodies.join(lists, key, "left")
        .withColumn("rebuilt", rebuilt_column(F.col("body"), F.col("__texts"), shape))
        .drop("__texts")
    )


def leaves_column(body: Column, with_keys: bool = False) -> Column:
    """Every string below a JSON value at any depth; ``with_keys`` adds the object keys."""

    @F.pandas_udf(_LEAVES)
    def leaves(bodies: pd.Series) -> pd.Series:
        out = []
        for raw in bodies:
            found: list[tuple[str, str]] = []
            note = lambda p, v: found.append((p, v)) or v
            _on_strings(_parsed(raw), "$", note, note if with_keys else None)
            out.append(found)
        return pd.Series(out)

    return leaves(body)


def json_leaves(
    df: DataFrame, *key: str, body: str = "body", with_keys: bool = False
) -> DataFrame:
    """One row per string of a JSON tree: (key.., leaf_no, path, value)."""
    rows = df.select(
        *key, F.posexplode(leaves_column(F.col(body), with_keys)).alias("leaf_no", "s")
    )
    return rows.select(
        *key,
        F.col("leaf_no").cast("bigint").alias("leaf_no"),
        F.col("s.path").alias("path"),
        F.col("s.value").alias("value"),
    )


# --- any depth ------------------------------------------------------------------------------------

_TOKENS = re.compile(r'[ \t\r\n]*+("(?:[^"\\\x00-\x1f]|\\.)*+"|[\[\]{},:]|[^\s\[\]{},:"]++)', re.S)


def _number_or_name(token: str) -> None:
    """Raise unless the token is a JSON number or literal."""
    if token not in ("true", "false", "null"):
        json.loads(token)


def strings_of(raw: str, with_keys: bool = False) -> list[tuple[str, str]]:
    """(path, string) of every string in a JSON text, objects in key order, without recursion.

    Raises ValueError for a text that is no JSON.  Of a key named twice the last value counts.
    """
    found: dict[tuple, str] = {}
    stack: list[list] = []  # [is an object, key or index of the current item, items so far]
    place: tuple = ()
    want = "value"

    def done() -> str:
        return "after" if stack else "end"

    at = 0
    raw = raw.rstrip(" \t\r\n")
    while at < len(raw):
        token = _TOKENS.match(raw, at)
        if token is None:
            raise ValueError("no JSON")
        at, t = token.end(), token[1]
        if want in ("key", "key or close") and t[0] == '"':
            key = json.loads(t)
            old = (*place, (key, 0))
            if stack[-1][2] and key in stack[-1][3]:
                found = {k: v for k, v in found.items() if k[: len(old)] != old}
            stack[-1][3].add(key)
            stack[-1][1], want = key, "colon"
            if with_keys:
                found[(*place, (key, -1))] = key
        elif want == "colon" and t == ":":
            place, want = (*place, (stack[-1][1], 0)), "value"
        elif want in ("value", "value or close") and t not in ("]", "}", ",", ":"):
            if stack and not stack[-1][0]:
                place = (*place, stack[-1][2])
            if stack:
                stack[-1][2] += 1
            if t in ("{", "["):
                stack.append([t == "{", None, 0, set()])
                want = "key or close" if t == "{" else "value or close"
                continue
            if t[0] == '"':
                found[place] = json.loads(t)
            else:
                _number_or_name(t)
            place, want = place[:-1], done()
        elif want == "after" and t == ",":
            want = "key" if stack[-1][0] else "value"
        elif stack and t == ("}" if stack[-1][0] else "]") and want in ("after", "key or close", "value or close"):
            stack.pop()
            place, want = place[:-1], done()
        else:
            raise ValueError("no JSON")
    if want != "end":
        raise ValueError("no JSON")

    def named(step) -> str:
        return f".{step[0]}" if isinstance(step, tuple) else f"[{step}]"

    return [("$" + "".join(map(named, k)), v) for k, v in sorted(found.items())]


@F.udtf(returnType="leaf_no bigint, path string, value string")
class JsonStrings:
    """The strings of a JSON text at any depth, one row each; no row for a text that is no JSON."""

    def eval(self, body: str, with_keys: bool):
        try:
            found = strings_of(body, with_keys) if body else []
        except ValueError:
            found = []
        for n, (path, value) in enumerate(found):
            yield n, path, value


def json_strings(df: DataFrame, *key: str, body: str = "body", with_keys: bool = False) -> DataFrame:
    """(key.., leaf_no, path, value) of every string of a body, however deep, by a lateral join."""
    rows = df.select(*key, F.col(body).alias("__body"))
    return rows.lateralJoin(JsonStrings(F.col("__body").outer(), F.lit(with_keys))).drop("__body")

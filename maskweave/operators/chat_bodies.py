"""Chat request bodies on VARIANT: reading, the redactable strings, putting redacted ones back.

A body is parsed once into a variant; messages, content parts and tool calls are arrays of variants
that built-in functions walk.  The shape has a fixed depth, so no Python is needed.

The parser of variants ignores what follows the first value.  A body counts as readable only if it
still parses as the one item of an array and as the one field of an object: text after the value
cannot be right in both.  An object that names a key twice is unreadable.  Numbers are kept by value:
``1.0`` comes back as ``1``, and an integer of more than 38 digits as a double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions import spans as S

LEAVES = "array<struct<path:string,value:string>>"
# The fields of a content part that hold text.
PART_FIELDS = ("text", "input_text", "output_text")


def _items(v: Column, path: str) -> Column:
    """The variants of an array below ``path``; null where there is none."""
    return F.try_variant_get(v, path, "array<variant>")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string(v: Column, path: str) -> Column:
    """The value below ``path`` if it is a string."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(_kind(found) == "STRING", F.try_variant_get(v, path, "string"))


def depth_over(body: Column, limit: int) -> Column:
    """Whether brackets outside strings nest deeper than ``limit``."""
    bare = F.regexp_replace(F.regexp_replace(body, r"(?s)\\.", ""), r'"[^"]*+"?', "")
    brackets = F.regexp_replace(bare, r"[^\[\]{}]++", "")
    step = lambda acc, b: F.struct(
        (acc["now"] + F.when(b.isin("[", "{"), 1).otherwise(-1)).alias("now"),
        F.greatest(acc["most"], acc["now"] + F.when(b.isin("[", "{"), 1).otherwise(-1)).alias("most"),
    )
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deepest = F.aggregate(F.split(brackets, ""), start, step, lambda acc: acc["most"])
    return F.when(F.length(brackets) > limit, deepest > limit).otherwise(False)


def with_tree(df: DataFrame, body: str, max_depth: int, out: str, reason: str) -> DataFrame:
    """Add the body as a variant, and why it cannot be used (null: it can)."""
    raw = F.coalesce(F.col(body), F.lit(""))
    deep = S.settled(df, {"__deep": depth_over(raw, max_depth)})
    in_array = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"b":'), raw, F.lit("}")))
    usable = (raw != "") & ~F.col("__deep")
    parsed = S.settled(
        deep, {"__one": F.when(usable, _items(in_array, "$")), "__right": F.when(usable, in_object.isNotNull())}
    )
    tree = F.when((F.size("__one") == 1) & F.col("__right"), F.get("__one", F.lit(0)))
    trees = S.settled(parsed, {out: tree})
    why = F.when(F.col("__deep"), "body_too_deep").when(F.col(out).isNull(), "unreadable_body")
    return trees.withColumn(reason, why).drop("__deep", "__one", "__right")


def has_messages(tree: Column) -> Column:
    return F.coalesce(_kind(tree).startswith("OBJECT") & _items(tree, "$.messages").isNotNull(), F.lit(False))


def _leaf(path: Column, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(path.alias("path"), value.alias("value")))


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def segments(tree: Column) -> Column:
    """Message content (a string, or the text of its parts), then tool-call arguments, in order."""

    def of_part(part: Column, at: Column) -> Column:
        return F.array(*[_leaf(_joined(at, f".{name}"), _string(part, f"$.{name}")) for name in PART_FIELDS])

    def of_message(message: Column, i: Column) -> Column:
        at = _joined("messages[", i, "]")
        content = _leaf(_joined(at, ".content"), _string(message, "$.content"))
        parts = F.transform(
            _items(message, "$.content"), lambda p, j: of_part(p, _joined(at, ".content[", j, "]"))
        )
        calls = F.transform(
            _items(message, "$.tool_calls"),
            lambda c, k: _leaf(
                _joined(at, ".tool_calls[", k, "].function.arguments"), _string(c, "$.function.arguments")
            ),
        )
        none = F.array().cast(LEAVES)
        return F.concat(
            F.array(content), F.coalesce(F.flatten(parts), none), F.coalesce(calls, none)
        )

    found = F.flatten(F.transform(_items(tree, "$.messages"), of_message))
    return F.coalesce(F.filter(found, lambda s: s.isNotNull()), F.array().cast(LEAVES))


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def _changed(v: Column, change) -> Column:
    """An object with ``change(name, value)`` in place of each of its values; anything else as it is."""
    fields = F.transform_values(_fields(v), change)
    return F.when(_is_object(v), F.to_variant_object(fields)).otherwise(v)


def _each(v: Column, change) -> Column:
    """An array with its items changed; anything else as it is."""
    items = _items(v, "$")
    return F.when(items.isNotNull(), F.to_variant_object(F.transform(items, change))).otherwise(v)


def rebuilt(tree: Column, texts: Column) -> Column:
    """The body as JSON with the string at each path of ``texts`` (a map) replaced; keys come out
    sorted and without spaces."""

    def put(path: Column, old: Column) -> Column:
        new = F.element_at(texts, path)
        return F.when(new.isNotNull(), new.cast("variant")).otherwise(old)

    def in_part(part: Column, at: Column) -> Column:
        return _changed(
            part, lambda name, v: F.when(name.isin(*PART_FIELDS), put(_joined(at, ".", name), v)).otherwise(v)
        )

    def in_call(call: Column, at: Column) -> Column:
        function = lambda v: _changed(
            v, lambda n, x: F.when(n == "arguments", put(_joined(at, ".function.arguments"), x)).otherwise(x)
        )
        return _changed(call, lambda name, v: F.when(name == "function", function(v)).otherwise(v))

    def in_message(message: Column, i: Column) -> Column:
        at = _joined("messages[", i, "]")

        def field(name: Column, v: Column) -> Column:
            content = F.when(_kind(v) == "STRING", put(_joined(at, ".content"), v)).otherwise(
                _each(v, lambda p, j: in_part(p, _joined(at, ".content[", j, "]")))
            )
            calls = _each(v, lambda c, k: in_call(c, _joined(at, ".tool_calls[", k, "]")))
            return F.when(name == "content", content).when(name == "tool_calls", calls).otherwise(v)

        return _changed(message, field)

    whole = _changed(tree, lambda name, v: F.when(name == "messages", _each(v, in_message)).otherwise(v))
    return F.to_json(whole)

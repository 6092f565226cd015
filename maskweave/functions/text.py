"""Scalar text functions as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(c: Column) -> Column:
    """Case fold that touches A-Z only; scopes and allow-list terms compare this way."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def stripped(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def digits(c: Column) -> Column:
    """The ASCII digits of a string."""
    return F.regexp_replace(c, "[^0-9]", "")


def placeholder(label: Column, n: Column) -> Column:
    return F.concat(F.lit("<<"), inner_name(label, n), F.lit(">>"))


def inner_name(label: Column, n: Column) -> Column:
    return F.concat(ascii_upper(label), F.lit("_"), n.cast("string"))


def segment_hash(text: Column, scope: Column | None = None) -> Column:
    """sha256 over scope, a zero byte and the text; requests without a scope hash apart."""
    no_scope = F.lit("\u0000*")
    tag = no_scope if scope is None else F.coalesce(scope, no_scope)
    return F.sha2(F.concat(tag, F.lit("\u0000"), text), 256)


def sigmoid(x: Column) -> Column:
    """Logistic function that never exponentiates a large positive number."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def label_list(c: Column) -> Column:
    """Comma-separated labels to an array: trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda v: stripped(v)), lambda v: v != "")

"""Finding, masking and restoring private values in tables and streams of text, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from maskweave.operators import audit as _audit
from maskweave.operators import delta as _delta
from maskweave.operators import detect as _detect
from maskweave.operators import dictionary as _dictionary
from maskweave.operators import model as _model
from maskweave.operators import policy as _policy
from maskweave.operators import vault as _vault
from maskweave.operators.model import DetectorPlugin
from maskweave.session import build_session
from maskweave.sources.policy_store import teach, unteach

__all__ = [
    "DetectorPlugin",
    "audit",
    "build_session",
    "detect",
    "detect_rows",
    "redact",
    "restore",
    "suggestions",
    "teach",
    "unteach",
]

suggestions = _delta.suggestions


def detect_rows(
    df: DataFrame,
    policy: DataFrame,
    key: list[str],
    scope: str | None = None,
    plugin: DetectorPlugin | None = None,
) -> DataFrame:
    """Add ``spans``, every private value in ``text``: dictionary, patterns and an optional
    plug-in, merged, less what the policy allows.  Rows stay where they are."""
    layers = ["dictionary_spans", "pattern_spans"]
    # First, since a large policy makes it read its input twice.
    rows = _dictionary.with_dictionary_spans(df, policy, scope=scope, key=key)
    rows = _detect.with_pattern_spans(rows)
    if plugin is not None:
        rows = _model.with_plugin_spans(rows, plugin)
        layers.append("plugin_spans")
    merged = _detect.with_merged(rows, *layers)
    return _policy.drop_allowed(merged, policy, key, scope=scope)


def detect(
    df: DataFrame,
    policy: DataFrame,
    key: list[str],
    scope: str | None = None,
    plugin: DetectorPlugin | None = None,
) -> DataFrame:
    """One row per private value: (key.., start, end, label, source, score, value)."""
    keep = list(dict.fromkeys([*key, *([scope] if scope else [])]))
    rows = detect_rows(df.select(*keep, "text"), policy, key, scope, plugin)
    return _detect.explode_spans(rows, *key)


def redact(
    segments: DataFrame,
    policy: DataFrame,
    conv: str | list[str] = "conv_id",
    seg: str = "seg_no",
    scope: str | None = None,
    plugin: DetectorPlugin | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(segments with ``redacted`` in place of ``text``, vault).

    Placeholders are stable within a vault: a conversation, or (request, conversation) if ``conv``
    is a list, as it should be where requests resend their history.
    """
    keys = [conv] if isinstance(conv, str) else list(conv)
    spans = detect(segments, policy, [*keys, seg], scope, plugin)
    red, vault = _vault.redact_conversations(segments, spans, keys, seg)
    return red.drop("text"), vault


def audit(
    df: DataFrame, policy: DataFrame, key: list[str], text: str = "redacted", scope: str | None = None
) -> DataFrame:
    """Add ``reason``: null when the row may leave."""
    return _audit.audit(df, policy, key, text, scope=scope)


def restore(
    replies: DataFrame, vault: DataFrame, conv: str | list[str] = "conv_id", seg: str = "seg_no"
) -> DataFrame:
    """Add ``restored`` to reply texts, each from its own conversation's vault."""
    return _vault.restore_by_join(replies, vault, conv, seg)

"""The carry rule of streamed replies: never emit half a placeholder.

Pending text is held from the last ``<<`` that has no ``>>`` after it, or from a single ``<`` at
the end.  More than ``MAX_PENDING`` bytes are not held: the text goes out as it is.
"""

from __future__ import annotations

import re

from maskweave.functions.patterns import MAX_PENDING, PLACEHOLDER

_TOKEN = re.compile(PLACEHOLDER)


def hold_from(text: str) -> int:
    """Index at which ``text`` must be held back; its length when nothing is."""
    at = text.rfind("<<")
    opened = at >= 0 and ">>" not in text[at + 2 :]
    if opened and len(text[at:].encode()) <= MAX_PENDING:
        return at
    return len(text) - 1 if text.endswith("<") else len(text)


def advance(pending: str, chunk: str) -> tuple[str, str]:
    """(text safe to emit, text still pending) after one more chunk."""
    whole = pending + chunk
    at = hold_from(whole)
    return whole[:at], whole[at:]


def fill(text: str, reals: dict[str, str]) -> str:
    """Replace known placeholders in one pass; unknown ones stay as written."""
    return _TOKEN.sub(lambda m: reals.get(m[1].strip().upper(), m[0]), text)

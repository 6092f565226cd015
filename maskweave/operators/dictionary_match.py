"""Characters of dictionary matching: folding, word edges, candidates.  No Spark in here."""

from __future__ import annotations

import functools
import unicodedata

# A match that may become a span; the order of the fields ranks those at one start.
CANDIDATE = (
    "array<struct<start:bigint,neg_bytes:bigint,whole_word:boolean,ord:bigint,form_no:bigint,"
    "end:bigint,label:string>>"
)


def asks_edge(ch: str) -> bool:
    """Whether a form's own first or last character asks for a word edge."""
    return ch.isalnum() or ch == "_"


# Circled and squared letters, the only symbols that count as alphabetic.
_ALPHABETIC_SYMBOLS = ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))


@functools.lru_cache(maxsize=1 << 16)
def in_word(ch: str) -> bool:
    """Whether a character of the text continues a word: alphabetic, mark, decimal digit,
    connector or joiner, as ``\\w`` under the U flag has it."""
    kind = unicodedata.category(ch)
    return (
        kind[0] in "LM"
        or kind in ("Nd", "Nl", "Pc")
        or ch in "\u200c\u200d"
        or any(a <= ord(ch) <= b for a, b in _ALPHABETIC_SYMBOLS)
    )


def fold_char(ch: str) -> str:
    """Simple case folding of one character.  Dotted and dotless I fold with nothing else."""
    if ch in "İı":
        return ch
    up = ch.upper()
    low = (up if len(up) == 1 else ch).lower()
    return low if len(low) == 1 else ch


@functools.cache
def fold_table() -> dict[int, str]:
    """Folding of every character that changes; keeps the length of a text."""
    cased = range(0x1F000)
    pairs = ((cp, fold_char(chr(cp))) for cp in cased if not 0xD800 <= cp <= 0xDFFF)
    return {cp: low for cp, low in pairs if low != chr(cp)}


def fold_text(text: str) -> str:
    if text.isascii():
        return text.lower()
    return text.translate(fold_table())


def at_edges(text: str, start: int, end: int, first: str, last: str) -> bool:
    """Whether no word runs over the edges; ``first`` and ``last`` are the form's own."""
    runs_in = start > 0 and asks_edge(first) and in_word(text[start - 1])
    runs_on = end < len(text) and asks_edge(last) and in_word(text[end])
    return not (runs_in or runs_on)

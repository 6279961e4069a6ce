"""Word rules shared by the corpus operators.

Both rules work on UTF-8 bytes: every byte of a non-ASCII character is >= 0x80,
so a class that only names ASCII characters can be decided byte by byte and
``bytes.translate`` / ``bytes.split`` do the work in C.
"""

from __future__ import annotations

#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a blank.
ALNUM_TABLE = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else i if i >= 128 else 32 for i in range(256))

#: The rule of ALNUM_TABLE as a regular expression over lower-cased text.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between blanks: the complement of space and U+0009..U+000D.
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ALNUM_WORD after lower-casing A-Z; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


def blank_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of BLANK_WORD, with A-Z lower-cased on request; a null text has none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def alnum_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of ``alnum_words(text)`` in the original text."""
    spans, start = [], -1
    for at, ch in enumerate(text):
        inside = ch >= "\x80" or ch.isalnum()
        if inside and start < 0:
            start = at
        elif not inside and start >= 0:
            spans.append((start, at))
            start = -1
    if start >= 0:
        spans.append((start, len(text)))
    return spans

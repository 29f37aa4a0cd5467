"""Splits texts at places no byte-level BPE pre-token can span."""

from __future__ import annotations

from collections.abc import Iterator

#: Every white-space character but the two that separate words in ordinary text.
ODD_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
ODD_ASCII = [c for c in ODD_SPACES if c.isascii()]
RUNS = ("  ", "\n\n", " \n", "\n ", "\0")
#: What a worker may keep of words it has met, and what an entry of a dictionary takes besides its strings.
CACHE_BYTES, ENTRY_BYTES = 112 << 20, 180
#: Texts are split into words for about so many characters at a time: the words take many times the room of the text.
SLICE_CHARS = 1 << 20


def slices(texts: list[str]) -> Iterator[slice]:
    """Consecutive slices of about SLICE_CHARS characters, a text at least."""
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= SLICE_CHARS:
            yield slice(start, i + 1)
            start, chars = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def split(text: str) -> list[str] | None:
    """The text cut before each space or line break, or None where that is not safe.

    With only single separators between words, each pre-token lies within one segment, so
    segments can be tokenized apart and looked up by their string. White-space runs, other
    white space and NUL make the cut unsafe; such texts are tokenized whole.
    """
    if any(x in text for x in RUNS) or any(x in text for x in (ODD_ASCII if text.isascii() else ODD_SPACES)):
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

"""Numbers for the pre-tokens of texts, so that each distinct one is handled once a task."""

from __future__ import annotations

from collections.abc import Callable

from vellum.llm import segments


class Numbers(dict):
    """segment -> the numbers of its words, as little-endian unsigned 32-bit integers; new words are numbered as they come.

    `find` splits any text into words. What is kept takes about `bytes` bytes; a caller that finds this beyond
    `segments.CACHE_BYTES` begins anew. `marks` are characters of which a run behind letters is one word; with any, letters
    of all scripts, with a blank before them or without, are one word as well.
    """

    def __init__(self, find: Callable[[str], list[str]], marks: str = "") -> None:
        super().__init__()
        self.find, self.marks, self.inner, self.fresh, self.count, self.chars = find, marks, {}, [], 0, 0

    @property
    def bytes(self) -> int:
        return 2 * self.chars + (len(self) + len(self.inner)) * segments.ENTRY_BYTES

    def _new(self, word: str) -> bytes:
        self.fresh.append(word)
        n = self.count
        self.count = n + 1
        return n.to_bytes(4, "little")

    def _number(self, word: str) -> bytes:
        n = self.get(word)
        if n is None or len(n) != 4:  # not met as a segment that is this one word
            n = self.inner.get(word)
            if n is None:
                n = self.inner[word] = self._new(word)
                self.chars += len(word)
        return n

    def __missing__(self, segment: str) -> bytes:
        self.chars += len(segment)
        word = segment.rstrip(self.marks)
        # letters of ASCII are one word, with a blank before them or without
        if (self.marks or segment.isascii()) and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            whole = len(word) == len(segment)
            found = (word, segment[len(word) :])
        else:
            found = self.find(segment)
            whole = len(found) == 1 and found[0] == segment
        out = self[segment] = (self.inner.get(segment) or self._new(segment)) if whole else b"".join(map(self._number, found))
        return out

    def of(self, text: str) -> bytes:
        """The numbers of a text's words."""
        parts = segments.split(text)
        return b"".join(map(self._number, self.find(text)) if parts is None else map(self.__getitem__, parts))

    def new(self) -> list[str]:
        """The words numbered since the last call."""
        fresh, self.fresh = self.fresh, []
        return fresh

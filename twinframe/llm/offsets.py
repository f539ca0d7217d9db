"""Rewritten texts that know where each of their characters came from."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable


class Rewritten:
    """``text`` after replacing spans; ``source(start, end)`` gives the span of the original that a span stems from.

    ``edits`` are ``(start, end, replacement)`` in order and without overlap. A character of a replacement stems from
    the whole replaced span, any other one from itself.
    """

    def __init__(self, original: str, edits: Iterable[tuple[int, int, str]]):
        parts, self._begins, self._pieces = [], [], []
        at = length = 0
        for start, end, new in edits:
            if start > at:
                self._add(length, at, start, False)
                parts.append(original[at:start])
                length += start - at
            if new:
                self._add(length, start, end, True)
                parts.append(new)
                length += len(new)
            at = end
        if at < len(original):
            self._add(length, at, len(original), False)
            parts.append(original[at:])
        self.text = "".join(parts)

    def _add(self, begin, start, end, replaced):
        self._begins.append(begin)
        self._pieces.append((start, end, replaced))

    def source(self, start: int, end: int) -> tuple[int, int]:
        first, last = bisect_right(self._begins, start) - 1, bisect_right(self._begins, end - 1) - 1
        s, _, replaced = self._pieces[first]
        begin = s if replaced else s + start - self._begins[first]
        s, e, replaced = self._pieces[last]
        return begin, e if replaced else s + end - self._begins[last]

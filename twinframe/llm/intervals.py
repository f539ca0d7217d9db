"""Intervals that tell quickly whether one of them holds another."""

from __future__ import annotations

from bisect import bisect_left, bisect_right


class Cover:
    """A growing set of intervals. Only those inside no other are kept, so their starts and ends ascend together and one
    search answers whether an interval lies in any of them."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        """Whether some interval begins at ``start`` or before and ends at ``end`` or behind."""
        at = bisect_right(self.starts, start) - 1
        return at >= 0 and self.ends[at] >= end

    def add(self, start: int, end: int) -> None:
        if self.holds(start, end):
            return
        first, last = bisect_left(self.starts, start), bisect_right(self.ends, end)
        self.starts[first:last], self.ends[first:last] = [start], [end]

"""Line differences of two texts by longest common subsequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a view shows differences of the first lines alone.
MOST_LINES = 500
#: Lines whose rows of lengths are held at once; of longer stretches the row in the middle is held.
HELD = 64
SCHEMA = "array<struct<kind:string, content:string, line_no:int>>"


class Walk:
    """The way through the table of lengths (of the common subsequence of the lines from i and from j on), without the
    table: a stretch of lines is walked with the row below it; its middle row is made first, then its halves."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.steps = a, b, []

    def row(self, i: int, below: np.ndarray, j: int) -> np.ndarray:
        """Lengths at line i, from column j on, given those at line i + 1."""
        best = np.maximum(below[:-1], np.where(self.b[j:] == self.a[i], below[1:] + 1, 0))
        return np.append(np.maximum.accumulate(best[::-1])[::-1], np.int32(0))

    def through(self, first: int, end: int, below: np.ndarray, j: int) -> int:
        """Walks lines first..end-1 from column j, and returns the column behind them; below: lengths at ``end`` from j on."""
        if end - first > HELD:
            middle, row = (first + end) // 2, below
            for i in range(end - 1, middle - 1, -1):
                row = self.row(i, row, j)
            k = self.through(first, middle, row, j)
            return self.through(middle, end, below[k - j :], k)
        rows = [below]
        for i in range(end - 1, first - 1, -1):
            rows.append(self.row(i, rows[-1], j))
        rows, start, i = rows[::-1], j, first
        while i < end:
            if j < len(self.b) and self.a[i] == self.b[j]:
                self.steps.append(("context", i))
                i, j = i + 1, j + 1
            elif j == len(self.b) or rows[i - first + 1][j - start] >= rows[i - first][j + 1 - start]:
                self.steps.append(("removed", i))
                i += 1
            else:
                self.steps.append(("added", j))
                j += 1
        return j


def differences(old: str, new: str, most: int | None = None) -> list[tuple[str, str, int]]:
    """(context, added or removed; line; place) over all lines, or the first ``most`` of each; where both would do, what
    is removed stands before what is added. Memory grows with the lines, time with their product."""
    a, b = old.split("\n")[:most], new.split("\n")[:most]
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    head, a, b = a[:same], a[same:], b[same:]
    number: dict[str, int] = {}
    walk = Walk(*(np.array([number.setdefault(x, len(number)) for x in lines], np.int32) for lines in (a, b)))
    j = walk.through(0, len(a), np.zeros(len(b) + 1, np.int32), 0)
    out = [("context", x) for x in head] + [(kind, b[i] if kind == "added" else a[i]) for kind, i in walk.steps] + [("added", x) for x in b[j:]]
    return [(kind, line, k + 1) for k, (kind, line) in enumerate(out)]


def line_diff(old: Column, new: Column, most: int | None = None) -> Column:
    @F.pandas_udf(SCHEMA)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "content": c, "line_no": n} for k, c, n in differences(x or "", y or "", most)] for x, y in zip(a, b, strict=True)])

    return run(old, new)

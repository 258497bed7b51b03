"""Greedy choice of intervals: by score, those that are not redundant beside one that was chosen before.

A group's candidates come to a task sorted by score and are streamed; what is kept in
memory is the chosen intervals of one group, in the order of their starts. A group is one
chain of decisions by nature, but never a Python list of all its rows. Intervals are
closed ranges of whole numbers; equal scores go by id. Candidates without a start, an end
or a group have nothing to be redundant with and stay; a null score is the lowest.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Redundant = Callable[[int, int, int, int], bool]
# Spans that are short, and shares of the shorter one that may be shared.
SHORT, SHORT_SHARE, SHARE, STORY_SHARE = 5, 0.33, 0.5, 0.6


def overlap(a: int, b: int, c: int, d: int) -> int:
    return max(0, min(b, d) - max(a, c) + 1)


def overlapping(a: int, b: int, c: int, d: int) -> bool:
    """Any common number."""
    return overlap(a, b, c, d) > 0


def redundant_passage(share: float = SHARE, story: bool = False) -> Redundant:
    """One inside the other; or, but for stories, both short and touching, or one short and a third of the shorter shared; or more than ``share`` of the shorter shared."""
    most = STORY_SHARE if story else share

    def test(a: int, b: int, c: int, d: int) -> bool:
        if a >= c and b <= d or c >= a and d <= b:
            return True
        both, spans = overlap(a, b, c, d), sorted((b - a + 1, d - c + 1))
        if not both:
            return False
        if not story and (spans[1] <= SHORT or spans[0] <= SHORT and both / max(spans[0], 1) >= SHORT_SHARE):
            return True
        return both / max(spans[0], 1) > most

    return test


class Chosen:
    """The chosen intervals of a group; only those that can touch a candidate are looked at."""

    def __init__(self, redundant: Redundant):
        self.redundant, self.intervals, self.longest = redundant, [], 0

    def add(self, start: int, end: int) -> bool:
        """Whether the interval is chosen."""
        first, last = bisect_left(self.intervals, (start - self.longest, start - self.longest)), bisect_right(self.intervals, (end, 1 << 62))
        if any(self.redundant(start, end, c, d) for c, d in self.intervals[first:last]):
            return False
        insort(self.intervals, (start, end))
        self.longest = max(self.longest, end - start + 1)
        return True


def greedy(df: DataFrame, group: list[str], start: str, end: str, score: str, id_col: str, redundant: Redundant = overlapping) -> DataFrame:
    """The rows of ``df`` that are chosen."""
    keys = [F.col(c) for c in group]
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*group, start, end]))
    others = df.where(" OR ".join(f"`{c}` IS NULL" for c in [*group, start, end]))
    dealt = whole.repartition(*keys).sortWithinPartitions(*keys, F.col(score).desc_nulls_last(), F.col(id_col))
    places = [df.columns.index(c) for c in (*group, start, end)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chosen = None, Chosen(redundant)
        for batch in batches:
            keep = []
            for *key, a, b in zip(*(batch.column(i).to_pylist() for i in places), strict=True):
                if key != at:
                    at, chosen = key, Chosen(redundant)
                keep.append(chosen.add(a, b))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, df.schema).unionByName(others)

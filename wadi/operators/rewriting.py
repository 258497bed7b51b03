"""Rewriting by regular expressions that keeps track of where every code point goes.

A rewrite gives the new text and, for each code point of the old one, the interval of
the new text that stands for it. What a rule changes is known from the spans of its
matches: text between them is copied, and within a match old and new are compared
piece by piece (``difflib``, on the few letters of a match):

* copied letters go to their copy;
* deleted letters are an empty interval at the place where they stood;
* replaced letters pair off in order; letters too many are deleted at the end of the
  new ones, and new letters too many belong to nobody (a gap); a replaced blank is
  deleted, and what stands in its place goes to the letter before it;
* inserted letters go to the letter before them if it is a copy of the first of them,
  else to the letter after them; at the end of the text they belong to nobody. A match
  of no width inserts.

Maps compose (``Image.then``), from the left in the order of the rules. An interval goes
from where its first letter begins to where its last one ends; it is deleted when all of
it is. Composition is associative for maps without gaps. Texts of any length work in
memory of some numbers for each code point; an empty text has an empty map, null stays null.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rule: what is searched and what replaces it, both as ``re.sub`` reads them.
Rule = tuple[str, str]
#: Code points of texts that become one batch of a task's output.
BATCH = 1 << 20


@dataclass(frozen=True)
class Image:
    """For each code point: where its interval starts and ends, and whether nothing is left of it."""

    start: np.ndarray
    end: np.ndarray
    deleted: np.ndarray

    @staticmethod
    def identity(n: int) -> Image:
        return Image(np.arange(n), np.arange(1, n + 1), np.zeros(n, bool))

    def then(self, other: Image) -> Image:
        """The map of this rewrite followed by ``other``, which starts from this one's text."""
        n = len(other.start)
        if n == 0:
            zero = np.zeros(len(self.start), np.int64)
            return Image(zero, zero, np.ones(len(zero), bool))
        last = int(other.end[-1])
        start = np.where(self.start < n, other.start[np.minimum(self.start, n - 1)], last)
        end = np.where(self.deleted, start, other.end[np.maximum(self.end, 1) - 1])
        left = np.concatenate([[0], np.cumsum(~other.deleted)])
        gone = self.deleted | (left[self.end] == left[np.minimum(self.start, n)])
        return Image(start, end, gone)


@lru_cache(maxsize=1 << 14)
def _script(old: str, new: str) -> tuple[tuple[str, int, int, int, int], ...]:
    return tuple(difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes())


def edit_script(rule: Rule, text: str) -> tuple[str, list[tuple[str, int, int, int, int]]]:
    """The new text, and what was copied, replaced, inserted and deleted: (kind, from, to, from, to) in old and new."""
    ops: list[tuple[str, int, int, int, int]] = []
    parts, old, new = [], 0, 0

    def add(kind: str, a: int, b: int, c: int, d: int) -> None:
        if kind == "equal" and ops and ops[-1][0] == "equal":
            a, c = ops[-1][1], ops.pop()[3]
        ops.append((kind, a, b, c, d))

    for m in re.finditer(rule[0], text):
        a, b = m.span()
        if a > old:
            add("equal", old, a, new, new + a - old)
            new += a - old
        put = m.expand(rule[1])
        for kind, i, j, k, l in _script(text[a:b], put):  # noqa: E741
            add(kind, a + i, a + j, new + k, new + l)
        parts += [text[old:a], put]
        old, new = b, new + len(put)
    if old < len(text):
        add("equal", old, len(text), new, new + len(text) - old)
    return "".join([*parts, text[old:]]), ops


@lru_cache(maxsize=1 << 14)
def _pieces(old: str, new: str) -> tuple[tuple[int, int, bool], ...] | None:
    """Where the letters of a match go within what replaces it; None if that depends on what stands around it."""
    out: list[tuple[int, int, bool]] = []
    for kind, a, b, c, d in _script(old, new):
        if kind == "insert" or kind == "replace" and " " in old[a:b]:
            return None
        out += [(c, c, True) if kind == "delete" else (c + i, c + i + 1, False) if c + i < d else (d, d, True) for i in range(b - a)]
    return tuple(out)


def rewrite(rule: Rule, text: str) -> tuple[str, Image]:
    """One rule over a whole text: the new text and the map to it."""
    parts, begins, moves, pieces, old = [], [], [], [], 0
    plain = rule[1] if "\\" not in rule[1] else None
    for m in re.finditer(rule[0], text):
        a, b = m.span()
        put = m.expand(rule[1]) if plain is None else plain
        own = _pieces(text[a:b], put) if a < b else None
        if own is None:
            return _rewrite_by_script(rule, text)
        parts += (text[old:a], put)
        begins.append(a)
        moves.append(len(put) - len(own))
        pieces.append(own)
        old = b
    if not begins:
        return text, Image.identity(len(text))
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins, moves = np.array(begins, np.int64), np.array(moves, np.int64)
    moved = np.zeros(len(text) + 1, np.int64)
    moved[begins + sizes] = moves
    start = np.arange(len(text)) + np.cumsum(moved)[:-1]
    end, deleted = start + 1, np.zeros(len(text), bool)
    own = np.array([p for some in pieces for p in some], np.int64).reshape(-1, 3)
    before = np.cumsum(moves) - moves
    at = np.arange(len(own)) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    base = np.repeat(begins + before, sizes)
    start[at], end[at], deleted[at] = base + own[:, 0], base + own[:, 1], own[:, 2] == 1
    return "".join([*parts, text[old:]]), Image(start, end, deleted)


def _rewrite_by_script(rule: Rule, text: str) -> tuple[str, Image]:
    """The same, step by step, where what is inserted goes to a neighbour."""
    result, ops = edit_script(rule, text)
    n = len(text)
    start, end, deleted, known = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)

    def place(i: int, a: int, b: int, gone: bool = False) -> None:
        start[i], end[i], deleted[i], known[i] = a, b, gone, True

    for k, (kind, a, b, c, d) in enumerate(ops):
        if kind == "equal":
            first = a + int(known[a])
            start[first:b] = np.arange(c + first - a, d)
            end[first:b] = start[first:b] + 1
        elif kind == "delete":
            start[a:b], end[a:b], deleted[a:b] = c, c, True
        elif kind == "replace":
            for i in range(a, b):
                if known[i]:
                    continue
                at = c + i - a
                if at >= d:
                    place(i, d, d, True)
                elif text[i] != " ":
                    place(i, at, at + 1)
                else:
                    place(i, at + 1, at + 1, True)
                    if i:
                        end[i - 1] = at + 1
        elif k and ops[k - 1][0] == "equal" and result[ops[k - 1][4] - 1] == result[c]:
            end[ops[k - 1][2] - 1] = d
        elif k + 1 < len(ops) and ops[k + 1][0] == "replace":
            _, i, j, _, to = ops[k + 1]
            place(i, c, to)
            for x in range(i + 1, j):
                place(x, to, to, True)
        elif k + 1 < len(ops) and ops[k + 1][0] == "equal":
            place(ops[k + 1][1], c, ops[k + 1][3] + 1)
    return result, Image(start, end, deleted)


def rewrite_all(rules: Sequence[Rule], text: str) -> tuple[str, Image]:
    """The rules one after another; the map leads from the first text to the last."""
    image = Image.identity(len(text))
    for rule in rules:
        if re.search(rule[0], text):
            text, step = rewrite(rule, text)
            image = image.then(step)
    return text, image


def with_map(df: DataFrame, text_col: str, rules: Sequence[Rule], id_cols: Sequence[str]) -> DataFrame:
    """``id_cols``, ``rewritten`` and ``chars`` (array of start, end, deleted by code point of the text), a row for each row."""
    rules = tuple(rules)
    ids = df.select(*id_cols).schema

    def packed(rows: list[tuple[int, str | None, Image | None]], batch: pa.RecordBatch) -> pa.RecordBatch:
        maps = [m if m is not None else Image.identity(0) for _, _, m in rows]
        offsets = np.concatenate([[0], np.cumsum([len(m.start) for m in maps])]).astype(np.int32)
        flat = [np.concatenate([getattr(m, part) for m in maps]) for part in ("start", "end", "deleted")]
        members = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(bool))], names=["start", "end", "deleted"])
        lists = pa.ListArray.from_arrays(pa.array(offsets), members, mask=pa.array([m is None for _, _, m in rows]))
        took = pa.array([i for i, _, _ in rows])
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(took) for c in range(len(id_cols))), pa.array([t for _, t, _ in rows], pa.string()), lists], names=[*id_cols, "rewritten", "chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, text in enumerate(batch.column(len(id_cols))):
                text = text.as_py()
                rows.append((i, None, None) if text is None else (i, *rewrite_all(rules, text)))
                size += len(text or "")
                if size > BATCH:
                    yield packed(rows, batch)
                    rows, size = [], 0
            if rows:
                yield packed(rows, batch)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids)
    return df.select(*id_cols, F.col(text_col).alias("_text")).mapInArrow(run, f"{fields}, rewritten string, chars array<struct<start:int,end:int,deleted:boolean>>")


def char_rows(mapped: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """A row (place, start, end, deleted) for each code point of the texts that ``with_map`` took."""
    return mapped.select(*id_cols, F.posexplode("chars").alias("place", "c")).select(*id_cols, "place", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.deleted").alias("deleted"))

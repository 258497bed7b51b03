"""Vectorised kernels on whole Arrow text columns (no per-word Python objects).

Every function works on UTF-8 bytes with numpy; batches are cut into chunks of
at most ``CHUNK_BYTES`` of text (one longer text is a chunk of its own), so a
task needs memory for a chunk, never for its partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters, digits and bytes of non-ASCII characters.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NON_ALNUM[_a:_b] = False


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.full(max(n, 1 << 16), _BASE if kind == "up" else _BASE_INV, np.uint64)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and row offsets (n + 1); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def release() -> None:
    """Gives memory that a task has freed back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each part holds at most ``limit`` bytes of ``text`` (or one row)."""
    try:
        for batch in batches:
            _, offs = text_buffer(batch.column(batch.schema.get_field_index(text)))
            start, n = 0, batch.num_rows
            while start < n:
                end = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
                end = min(max(end, start + 1), n)
                yield batch.slice(start, end - start)
                start = end
    finally:
        batch = None
        release()


class Words:
    """Words of a chunk: byte bounds, per-document offsets and 64-bit hashes.

    ``lower`` folds A-Z only. ``of`` holds word offsets by document (n + 1).
    """

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACE, lower: bool = True):
        buf, self.doc_offsets = text_buffer(column)
        n = len(buf)
        word = ~separators[buf]
        before = np.empty(n, bool)
        before[1:] = word[:-1]
        cut = self.doc_offsets[:-1]
        before[cut[cut < n]] = False
        after = np.empty(n, bool)
        after[:-1] = word[1:]
        ends = self.doc_offsets[1:]
        after[ends[ends > 0] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.of = np.searchsorted(self.starts, self.doc_offsets)
        if lower:
            buf = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
        self.buf = buf
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf] * _power("up", n), out=self._sums[1:])
        self.hashes = self.spans(self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def doc(self) -> np.ndarray:
        """The document (row in the chunk) of each word."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, equal for equal bytes wherever they stand."""
        down = _power("down", len(self.buf) + 1)
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.buf[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles by document: values (sorted in each) and offsets.

    A document with fewer than k words has its whole sequence as one shingle,
    one without words has none.
    """
    h, n_docs = words.hashes, len(words.of) - 1
    full = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        full += h[j : j + len(full)] * np.uint64(pow(int(_STEP), j, 1 << 64))
    full = mix(full)
    out, offs = [], np.zeros(n_docs + 1, np.int64)
    of = words.of.tolist()
    for d in range(n_docs):
        a, b = of[d], of[d + 1]
        if b - a >= k:
            part = np.sort(full[a : b - k + 1])
            if len(part) > 1:
                keep = np.empty(len(part), bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                part = part[keep]
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for j in range(b - a):
                whole += h[a + j : a + j + 1] * np.uint64(pow(int(_STEP), j, 1 << 64))
            part = mix(whole)
        else:
            part = np.zeros(0, np.uint64)
        out.append(part)
        offs[d + 1] = offs[d] + len(part)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), offs


"""Hierarchical multi-length packing of tokenised documents.

Each task tokenises and packs its own documents in one stream: no shuffle, no
global state, bounded buffers. A document (its ids, then the end id) is first
cut into full windows; what is left goes to the smallest tier that holds it. A
tier's sequences are filled with its own documents in order; a gap at the end
takes the largest fitting waiting rests of shorter tiers, and what no rest fits
is filled with the head of the next waiting document, whose tail is routed anew.
So every sequence is full at its tier, a power of two, but for one for each task
at the end of its input.

Sequences join step groups: each group gets sequences of any tiers up to
``STEP_TOKENS`` tokens, so all steps cost the same number of tokens.

Tokens: white space never joins two tokens of this tokenizer, so a text is cut at
spaces and line ends and every distinct piece is tokenised once while it stays
in a bounded cache.

Defined results: a null or empty text is the end id alone; repeated ids are
packed separately; a null id stays null.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wadi.llm.textcore import Words, chunks

WINDOW, TIERS, END_ID = 4096, (512, 1024, 2048, 4096), 2
STEP_TOKENS, WAITING, CACHE = 8 * WINDOW, 256, 700_000
#: Entries of the Python dictionaries beside the cache's arrays.
RECENT = 60_000
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Token ids of whole texts, through a cache of pieces between white space.

    Pieces are told apart by the hash of their bytes with A-Z as small letters
    (the tokenizer makes all letters small), so a piece seen before costs no
    Python object. Texts with ``<|`` in them may hold special tokens, which are
    told apart by case; they are tokenised whole.
    """

    def __init__(self, path: str, end_id: int = END_ID, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.end_id, self.cache = Tokenizer.from_file(path), end_id, cache
        self.closes = np.zeros(self.tok.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.clear()
        probe = "The Cat sat, on.  the\tmat\nTHE END"
        if self.encode(pa.array([probe]))[0][:-1].tolist() != self.tok.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path}: pieces between white space must be tokenised apart and without regard to case")

    def clear(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes of pieces, sorted, and their slots
        self.recent: dict[int, int] = {}  # those not yet among them
        self.plain: dict[str, int] = {}  # words and ends that pieces are made of
        self.flat = np.full(1 << 16, self.end_id, np.uint32)
        self.used, self.count = 1, 1
        self.start, self.size = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)  # slot 0: the end id

    def _put(self, ids) -> int:
        n = len(ids)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if self.count == len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        self.flat[self.used : self.used + n] = ids
        self.start[self.count], self.size[self.count] = self.used, n
        self.used += n
        self.count += 1
        return self.count - 1

    def _ids(self, slot: int) -> np.ndarray:
        return self.flat[self.start[slot] : self.start[slot] + self.size[slot]]

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        """Gives every piece a slot; plain words with a plain end are put together from word and end."""
        if len(self.plain) > RECENT:
            self.plain = {}
        plain, parts, fresh = self.plain, [], {}
        for p in pieces:
            core = p.rstrip(".,;:!?%&*#$")
            both = (core, p[len(core) :]) if core != p and core.isalpha() else (p, "")
            parts.append(both)
            for x in both:
                if x and x not in plain:
                    fresh[x] = None
        self._learn_words([x for x in fresh if x.isalpha()])
        rest = [x for x in fresh if not x.isalpha()]
        for x, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            plain[x] = self._put(e.ids)
        for h, (a, b) in zip(hashes, parts, strict=True):
            self.recent[h] = self._put(np.concatenate([self._ids(plain[a]), self._ids(plain[b])])) if b else plain[a]

    def _learn_words(self, words: list[str], together: int = 256) -> None:
        """Plain words, many in one call: the last token of each, and no other, closes a word."""
        lots = [words[i : i + together] for i in range(0, len(words), together)]
        for lot, e in zip(lots, self.tok.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(lot) and ends[-1] == len(ids):
                a = 0
                for x, b in zip(lot, ends.tolist(), strict=True):
                    self.plain[x] = self._put(ids[a:b])
                    a = b
            else:  # a letter whose small form is more than a letter
                for x in lot:
                    self.plain[x] = self._put(self.tok.encode(x, add_special_tokens=False).ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the end id, and text offsets."""
        if len(self.keys) > self.cache or self.used > 8 * self.cache:
            self.clear()
        if len(self.recent) > RECENT:
            keys = np.concatenate([self.keys, np.fromiter(self.recent.keys(), np.uint64, len(self.recent))])
            values = np.concatenate([self.values, np.fromiter(self.recent.values(), np.int64, len(self.recent))])
            order = np.argsort(keys)
            self.keys, self.values, self.recent = keys[order], values[order], {}
        words = Words(texts)
        codes, kinds = pd.factorize(words.hashes)
        slot = np.full(len(kinds), -1, np.int64)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, kinds), len(self.keys) - 1)
            hit = self.keys[i] == kinds
            slot[hit] = self.values[i[hit]]
        known = self.recent.get
        new = np.flatnonzero(slot < 0)
        slot[new] = [known(h, -1) for h in kinds[new].tolist()]
        new = new[slot[new] < 0]
        if len(new):
            first = np.zeros(len(kinds), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            self._learn(kinds[new].tolist(), [words.text(i) for i in first[new].tolist()])
            slot[new] = [known(h) for h in kinds[new].tolist()]
        own, of = slot[codes], words.of
        special = np.flatnonzero(pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False))
        if len(special):
            keep = np.ones(len(own), bool)
            for d in special.tolist():
                keep[of[d] : of[d + 1]] = False
            left = np.concatenate([[0], np.cumsum(keep)])[of]
            whole = [self._put(self.tok.encode(texts[d].as_py(), add_special_tokens=False).ids) for d in special.tolist()]
            own = np.insert(own[keep], left[special], whole)
            of = left + np.searchsorted(special, np.arange(len(of)), "left")
        n_texts = len(of) - 1
        own = np.insert(own, of[1:], 0)
        n = self.size[own]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[own] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], ends[of[1:] + np.arange(n_texts)]]) if n_texts else np.zeros(1, np.int64)


_tokens: dict[str, Tokens] = {}


def tokens_for(path: str) -> Tokens:
    """One tokenizer for each worker process."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


class Packer:
    """Streams documents in, pieces (doc, start, ids, doc_tokens, sequence, offset, tier, group) out."""

    def __init__(self, first_sequence: int = 0, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, waiting: int = WAITING, step_tokens: int = STEP_TOKENS):
        self.window, self.tiers, self.waiting, self.step_tokens = window, tiers, waiting, step_tokens
        self.sequence = self.first = first_sequence
        self.queues = {t: deque() for t in tiers}
        self.rooms: dict[int, int] = {}  # open step groups and their room
        self.groups = 0
        self.out: list[tuple] = []

    def _route(self, piece: tuple) -> None:
        n = len(piece[2])
        self.queues[next(t for t in self.tiers if t >= n)].append(piece)

    def _group(self, size: int) -> int:
        fit = [g for g, room in self.rooms.items() if room >= size]
        if fit:
            g = min(fit, key=self.rooms.get)
        else:
            g = self.first + self.groups
            self.groups += 1
            self.rooms[g] = self.step_tokens
        self.rooms[g] -= size
        if not self.rooms[g]:
            del self.rooms[g]
        return g

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        group, offset = self._group(tier), 0
        for doc, start, ids, n in pieces:
            self.out.append((doc, start, ids, n, self.sequence, offset, tier, group))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self._emit([(doc, at, ids[at : at + self.window], n)], self.window)
            at += self.window
        if at < n:
            self._route((doc, at, ids[at:], n))
        for t in self.tiers:
            while len(self.queues[t]) > self.waiting:
                self._fill(t)

    def _fill(self, tier: int) -> None:
        """One full sequence of the tier, if what waits in it and below holds as many tokens."""
        taken, room = [], tier
        while room:
            queue = self.queues[tier]
            if queue and len(queue[0][2]) <= room:
                piece = queue.popleft()
            else:
                piece = self._largest(room) or self._head(room)
                if piece is None:
                    break
            taken.append(piece)
            room -= len(piece[2])
        if taken:  # short of the tier only at the end of the input
            self._emit(taken, tier)

    def _largest(self, room: int) -> tuple | None:
        """The largest waiting rest that fits, among the first few of each shorter tier."""
        best = None
        for t in self.tiers:
            queue = self.queues[t]
            for i in range(min(len(queue), 16)):
                n = len(queue[i][2])
                if n <= room and (best is None or n > best[0]):
                    best = (n, t, i)
        if best is None:
            return None
        _, t, i = best
        piece = self.queues[t][i]
        del self.queues[t][i]
        return piece

    def _head(self, room: int) -> tuple | None:
        """The head of a waiting document of the largest tier that has one; its tail waits anew."""
        for t in reversed(self.tiers):
            if self.queues[t]:
                doc, start, ids, n = self.queues[t].popleft()
                self._route((doc, start + room, ids[room:], n))
                return doc, start, ids[:room], n
        return None

    def finish(self) -> None:
        while any(self.queues.values()):
            self._fill(self.window)

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves as array<int>."""
    path = path or tokenizer_path()
    schema = RESULT + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        cols = [
            pa.array([p[0] for p in out], pa.int64()),
            pa.array([p[1] for p in out], pa.int64()),
            pa.array([len(p[2]) for p in out], pa.int64()),
            pa.array([zlib.crc32(np.ascontiguousarray(p[2], "<u4").data) for p in out], pa.int64()),
            pa.array([p[3] for p in out], pa.int64()),
            pa.array([p[4] for p in out], pa.int64()),
            pa.array([p[5] for p in out], pa.int64()),
            pa.array([p[6] for p in out], pa.int32()),
            pa.array([p[7] for p in out], pa.int64()),
        ]
        if with_ids:
            cols.append(pa.array([p[2].astype(np.int32) for p in out], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_for(path)
        packer = Packer(TaskContext.get().partitionId() << 32)
        for part in chunks(batches, "text"):
            flat, offs = tokens.encode(part.column(1))
            offs = offs.tolist()
            for i, doc in enumerate(part.column(0).to_pylist()):
                packer.add(doc, flat[offs[i] : offs[i + 1]])
            if out := packer.drain():
                yield rows(out)
        packer.finish()
        if out := packer.drain():
            yield rows(out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

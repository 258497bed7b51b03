"""Minimal acyclic automata over sorted byte strings, built and searched as arrays."""

from __future__ import annotations

import numpy as np

from wadi.llm.textcore import mix

#: Words that are searched at a time.
STEP = 8192


def flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, the start of each and its length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths


def _slices(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of every member of slices (start, count)."""
    owner = np.repeat(np.arange(len(starts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]


class Automaton:
    """The minimal automaton of distinct words in byte order; word numbers are a perfect hash.

    The trie's nodes come level by level from the common prefixes of neighbours. Nodes
    of equal height with equal ends and equal arcs to equal states become one state;
    they are found by a hash and compared in full. An arc knows how many words lie
    before it, so that the numbers along a word's path add up to its place.
    """

    def __init__(self, words: list[bytes]):
        buf, offs, lengths = flat(words)
        n, deepest = len(words), int(lengths.max(initial=0))
        common = np.zeros(n, np.int64)
        both, d = np.arange(1, n), 0
        while len(both):
            both = both[(lengths[both - 1] > d) & (lengths[both] > d)]
            both = both[buf[offs[both - 1] + d] == buf[offs[both] + d]]
            d += 1
            common[both] = d
        parents, chars, ends, levels = [np.zeros(0, np.int64)], [np.zeros(1, np.uint8)], [np.zeros(1, bool)], [1]
        rows, at = np.arange(n), np.zeros(n, np.int64)
        for d in range(1, deepest + 1):
            on = lengths[rows] >= d
            rows, at = rows[on], at[on]
            new = common[rows] < d
            made = rows[new]
            parents.append(at[new])
            chars.append(buf[offs[made] + d - 1])
            ends.append(lengths[made] == d)
            at = levels[-1] + np.cumsum(new) - 1
            levels.append(levels[-1] + len(made))
        parent, char, end = np.concatenate(parents), np.concatenate(chars), np.concatenate(ends)
        nodes = len(char)
        # children of a node follow one another, in the order of their bytes; node 0 is the root
        first = np.searchsorted(parent, np.arange(nodes)) + 1
        degree = np.bincount(parent, minlength=nodes)
        height, count = np.zeros(nodes, np.int64), end.astype(np.int64)
        for a, b in zip(levels[-2::-1], levels[:0:-1], strict=True):
            np.maximum.at(height, parent[a - 1 : b - 1], height[a:b] + 1)
            np.add.at(count, parent[a - 1 : b - 1], count[a:b])
        state, kept = np.zeros(nodes, np.int64), []
        order = np.argsort(height, kind="stable")
        bounds = np.searchsorted(height[order], np.arange(deepest + 2))
        states = 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            some = order[a:b]
            index, of = _merged(some, first, degree, end, char, state)
            state[some] = states + of
            kept.append(some[index])
            states += len(index)
        rep = np.concatenate(kept)
        owner, child = _slices(first[rep], degree[rep])
        before = np.cumsum(count[child]) - count[child]
        opens = np.cumsum(degree[rep]) - degree[rep]
        self.root, self.end = int(state[0]), end[rep]
        self.start, self.degree = opens, degree[rep]
        self.char, self.to = char[child].astype(np.int64), state[child]
        self.skip = before - before[opens[owner]] + self.end[owner] if len(owner) else before
        self.key = owner << 8 | self.char

    def step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states have an arc of the given byte, and the arcs of those."""
        want = state << 8 | char
        arc = np.minimum(np.searchsorted(self.key, want), max(len(self.key) - 1, 0))
        there = self.key[arc] == want if len(self.key) else np.zeros(len(want), bool)
        return there, arc[there]

    def follow(self, at: np.ndarray, buf: np.ndarray, offs: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The paths (rows: word, state, position, number) that can be followed exactly to position ``stop`` of their words."""
        out = []
        while at.shape[1]:
            ready = at[2] == stop[at[0]]
            out.append(at[:, ready])
            at = at[:, ~ready]
            there, arc = self.step(at[1], buf[offs[at[0]] + at[2]].astype(np.int64))
            at = at[:, there]
            at = np.stack([at[0], self.to[arc], at[2] + 1, at[3] + self.skip[arc]])
        return np.concatenate(out, axis=1) if out else at

    def one_error(self, words: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, number): the automaton's words that begin with the first ``exact`` bytes of a word and go on with exactly one error.

        Of equal results of one word only one is made: the first byte of a run is
        deleted, a byte is inserted at the end of a run of its kind.
        """
        buf, offs, lengths = flat(words)
        found = []
        for a in range(0, len(words), STEP):
            some = np.arange(a, min(a + STEP, len(words)))
            zero = np.zeros(len(some), np.int64)
            at = self.follow(np.stack([some, zero + self.root, zero, zero]), buf, offs, exact)
            tried = [at[:, :0]]
            while at.shape[1]:
                word, state, pos, number = at
                open_ = pos < lengths[word]
                place = offs[word] + pos
                char = np.full(len(word), -1, np.int64)
                char[open_] = buf[place[open_]]
                owner, arc = _slices(self.start[state], self.degree[state])
                other = self.char[arc] != char[owner]
                owner, arc = owner[other], arc[other]
                inserted = np.stack([word[owner], self.to[arc], pos[owner], number[owner] + self.skip[arc]])
                replaced = inserted[:, open_[owner]]
                replaced[2] += 1
                first = open_ & (pos == exact[word])
                inside = np.flatnonzero(open_ & ~first)
                first[inside] = buf[place[inside]] != buf[place[inside] - 1]
                deleted = at[:, first]
                deleted[2] += 1
                tried += [inserted, replaced, deleted]
                at, char = at[:, open_], char[open_]
                there, arc = self.step(at[1], char)
                at = at[:, there]
                at = np.stack([at[0], self.to[arc], at[2] + 1, at[3] + self.skip[arc]])
            done = self.follow(np.concatenate(tried, axis=1), buf, offs, lengths)
            found.append(np.unique(done[:, self.end[done[1]]][[0, 3]], axis=1))
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return both[0], both[1]


def _merged(nodes: np.ndarray, first: np.ndarray, degree: np.ndarray, end: np.ndarray, char: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one node of each kind, and the kind of every node; kinds that only share a hash make another salt needed."""
    counts = degree[nodes]
    owner, child = _slices(first[nodes], counts)
    arcs = state[child] << 8 | char[child]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for salt in range(1, 100):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(arcs.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))])
        hashes = mix((sums[bounds[1:]] - sums[bounds[:-1]]) * np.uint64(2) + end[nodes].astype(np.uint64))
        _, index, of = np.unique(hashes, return_index=True, return_inverse=True)
        like = index[of]
        if np.array_equal(counts[like], counts) and np.array_equal(end[nodes][like], end[nodes]):
            _, twin = _slices(bounds[:-1][like], counts)
            if np.array_equal(arcs[twin], arcs):
                return index, of
    raise RuntimeError("states could not be told apart")

"""Weighted acyclic automata over words: an accepting path spells a word sequence, its weight is how often it occurs.

A `Trie` is the sorted form, level by level: arc i of a level leads to state i of the next one, arcs stand in the order
of the sequences they end. A prefix range of it is a slice of each level. `packed` freezes a trie: from the last level
up, states with the same arcs (label, weight, target) become one, as incremental construction from sorted sequences
gives it. `union` reads many packed automata at once: a state of the result is the set of their states that one prefix
reaches, weights of the arcs with the same label are summed. `weights_of` composes a set of sequences with an automaton.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from touchline.llm.text import mix


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.LargeBinaryArray:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def numbered(values: pa.LargeBinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Distinct values in byte order, and the number of each value among them."""
    coded = values.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]


def _offsets(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1))


def _runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - total + count, count)


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


@dataclass
class Trie:
    """vocab in byte order; by level: labels (numbers in vocab), weights, and the arc of the level above (0 at the top)."""

    vocab: pa.LargeBinaryArray
    labels: list[np.ndarray]
    weights: list[np.ndarray]
    parents: list[np.ndarray]

    def __len__(self) -> int:
        return sum(map(len, self.labels))

    def split(self, bound: Sequence[bytes], words: list[bytes], first: list[np.ndarray]) -> list[tuple[int, int]]:
        """By level: arcs whose sequence is less than bound, and 1 if the last of them is a proper prefix of bound.

        words: vocab as a list; first: by level, the first arc below each arc of the level above.
        """
        out, lo, hi, live = [], 0, len(self.labels[0]), bool(bound)
        for d, labels in enumerate(self.labels):
            at, hit = lo, False
            if live:
                x = bisect_left(words, bound[d])
                at = lo + int(np.searchsorted(labels[lo:hi], x))
                hit = at < hi and x < len(words) and words[x] == bound[d] and int(labels[at]) == x
            inner = int(hit and d + 1 < len(bound))
            out.append((at + inner, inner))
            live = bool(inner)
            if d + 1 < len(self.labels):
                lo = int(first[d + 1][at])
                hi = int(first[d + 1][at + 1]) if live else lo
        return out

    def firsts(self) -> list[np.ndarray]:
        return [_offsets(p, len(self.labels[d - 1]) if d else 1) for d, p in enumerate(self.parents)]

    def pieces(self, bounds: Sequence[Sequence[bytes]]) -> list[tuple[int, Trie]]:
        """The prefix ranges [bounds[i], bounds[i + 1]) that have arcs. Each also holds the proper prefixes of its lower bound, with their weights."""
        words, first = self.vocab.to_pylist(), self.firsts()
        cuts = [self.split(b, words, first) for b in bounds] + [[(len(x), 0) for x in self.labels]]
        out = []
        for i in range(len(bounds)):
            span = [(lo - inner, hi) for (lo, inner), (hi, _) in zip(cuts[i], cuts[i + 1], strict=True)]
            if any(hi > lo for lo, hi in span):
                out.append((i, self._slice(span)))
        return out

    def _slice(self, span: list[tuple[int, int]]) -> Trie:
        labels = [x[lo:hi] for x, (lo, hi) in zip(self.labels, span, strict=True)]
        parents = [p[lo:hi] - (span[d - 1][0] if d else 0) for d, (p, (lo, hi)) in enumerate(zip(self.parents, span, strict=True))]
        used, inverse = np.unique(np.concatenate(labels), return_inverse=True)
        ends = np.cumsum([len(x) for x in labels])
        return Trie(self.vocab.take(pa.array(used)), np.split(inverse, ends[:-1]), [w[lo:hi] for w, (lo, hi) in zip(self.weights, span, strict=True)], parents)

    def heavy(self, least: int) -> Trie:
        """Without arcs of less weight than least. Weights never grow along a path, so no kept arc loses its way."""
        labels, weights, parents, moved = [], [], [], None
        for d, w in enumerate(self.weights):
            keep = w >= least
            labels.append(self.labels[d][keep])
            weights.append(w[keep])
            parents.append(self.parents[d][keep] if moved is None else moved[self.parents[d][keep]])
            moved = np.cumsum(keep) - 1
        return Trie(self.vocab, labels, weights, parents)

    def packed(self) -> bytes:
        """The minimal automaton, compressed."""
        depth = len(self.labels)
        levels: list[tuple[np.ndarray, ...]] = [()] * depth
        target = np.zeros(len(self.labels[-1]), np.int64)
        for d in range(depth - 1, -1, -1):
            states = len(self.labels[d - 1]) if d else 1
            first = _offsets(self.parents[d], states)
            same = _equal_states(first, (self.labels[d], self.weights[d], target))
            chosen, group = np.unique(same, return_inverse=True)
            count = first[chosen + 1] - first[chosen]
            arcs = _runs(first[chosen], count)
            levels[d] = tuple(map(_small, (count, self.labels[d][arcs], self.weights[d][arcs], target[arcs] if d + 1 < depth else np.empty(0, np.int64))))
            target = group
        data = b"".join(self.vocab.to_pylist())
        lengths = pc.binary_length(self.vocab).to_numpy(zero_copy_only=False)
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((data, _small(lengths), levels), protocol=5))


def _equal_states(first: np.ndarray, columns: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each state (arcs first[s] to first[s + 1]) a state with equal arcs: hashes propose it, arcs are compared."""
    count = np.diff(first)
    h = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
        run = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h, out=run[1:])
        h = mix(run[first[1:]] - run[first[:-1]] + count.astype(np.uint64))
    _, at, group = np.unique(h, return_index=True, return_inverse=True)
    other = at[group]
    mine = np.arange(len(count))
    same = np.where(count[other] == count, other, mine)
    moved = np.flatnonzero(same != mine)
    a, b = _runs(first[moved], count[moved]), _runs(first[same[moved]], count[moved])
    wrong = np.zeros(len(a), bool)
    for c in columns:
        wrong |= c[a] != c[b]
    same[np.repeat(moved, count[moved])[wrong]] = np.repeat(moved, count[moved])[wrong]
    return same


@dataclass
class Automaton:
    """Read back from packed(): by level, first arc of each state, labels, weights, target states (empty at the last level)."""

    vocab: pa.LargeBinaryArray
    levels: list[tuple[np.ndarray, ...]]

    @staticmethod
    def read(blob: bytes) -> Automaton:
        data, lengths, levels = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        wide = [tuple(x.astype(np.int64) for x in level) for level in levels]
        return Automaton(binary_array(np.frombuffer(data, np.uint8), lengths.astype(np.int64)), [(np.concatenate(([0], np.cumsum(c))), *rest) for c, *rest in wide])

    def __len__(self) -> int:
        return sum(len(level[1]) for level in self.levels)


def union(parts: Sequence[Automaton]) -> Trie:
    """All sequences of the parts, with the sum of their weights."""
    vocab, ids = numbered(pa.concat_arrays([p.vocab for p in parts]))
    base = np.cumsum([0, *(len(p.vocab) for p in parts)])
    state, source = np.arange(len(parts)), np.zeros(len(parts), np.int64)  # each part's start belongs to the one start
    labels, weights, parents = [], [], []
    depth = len(parts[0].levels)
    for d in range(depth):
        level = [p.levels[d] for p in parts]
        arcs = np.cumsum([0, *(len(x[1]) for x in level)])
        begin = np.concatenate([x[0][:-1] + arcs[i] for i, x in enumerate(level)])
        count = np.concatenate([np.diff(x[0]) for x in level])[state]
        at = _runs(begin[state], count)
        label = np.concatenate([ids[base[i] + x[1]] for i, x in enumerate(level)])[at]
        key = np.repeat(source, count) * len(vocab) + label
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(new)
        labels.append(key[head] % max(len(vocab), 1))
        parents.append(key[head] // max(len(vocab), 1))
        weight = np.concatenate([x[2] for x in level])[at][order]
        weights.append(np.add.reduceat(weight, head) if len(head) else weight)
        if d + 1 < depth:
            states = np.cumsum([0, *(len(p.levels[d + 1][0]) - 1 for p in parts)])
            state = np.concatenate([x[3] + states[i] for i, x in enumerate(level)])[at][order]
            source = np.cumsum(new) - 1
    return Trie(vocab, labels, weights, parents)


def trie_of(paths: pa.ListArray, depth: int) -> tuple[Trie, list[np.ndarray]]:
    """The trie of symbol lists (of 1 to depth symbols), each of weight 1; by level, the arc of each path that is so long, or -1."""
    first = paths.offsets.to_numpy().astype(np.int64)
    vocab, ids = numbered(paths.values.slice(first[0], first[-1] - first[0]).cast(pa.large_binary()))
    first = first - first[0]
    size, source = np.diff(first), np.zeros(len(paths), np.int64)
    labels, weights, parents, arcs = [], [], [], []
    for d in range(depth):
        here = np.flatnonzero(size > d)
        key, at, n = np.unique(source[here] * max(len(vocab), 1) + ids[first[here] + d], return_inverse=True, return_counts=True)
        labels.append(key % max(len(vocab), 1))
        parents.append(key // max(len(vocab), 1))
        weights.append(n)
        arcs.append(np.full(len(paths), -1))
        arcs[-1][here] = at
        source = arcs[-1]
    return Trie(vocab, labels, weights, parents), arcs


def weights_of(paths: pa.ListArray, automaton: Automaton) -> np.ndarray:
    """Weight of each path in the automaton, 0 where it is none: the product of the paths' trie with it, state by state."""
    depth = len(automaton.levels)
    trie, arcs = trie_of(paths, depth)
    vocab = numbered(pa.concat_arrays([trie.vocab, automaton.vocab]))[1]
    mine, theirs = vocab[: len(trie.vocab)], vocab[len(trie.vocab) :]
    width = int(vocab.max()) + 1 if len(vocab) else 1
    out = np.zeros(len(paths), np.int64)
    reached = np.zeros(1, np.int64)  # the automaton's state by state of the trie, -1: none
    for d, (first, labels, weights, *target) in enumerate(automaton.levels):
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        have = owner * width + theirs[labels]  # ascending: labels of a state are in byte order
        state = reached[trie.parents[d]]
        want = state * width + mine[trie.labels[d]]
        at = np.searchsorted(have, want)
        found = (state >= 0) & (at < len(have))
        found[found] = have[at[found]] == want[found]
        weight = np.zeros(len(want), np.int64)
        weight[found] = weights[at[found]]
        ending = (arcs[d] >= 0) & (arcs[d + 1] < 0 if d + 1 < depth else True)
        out[ending] = weight[arcs[d][ending]]
        if d + 1 < depth:
            reached = np.full(len(want), -1)
            reached[found] = target[0][at[found]]
    return out

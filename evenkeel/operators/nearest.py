"""The names nearest to a name by longest common subsequence, without scoring every pair.

The target keys are the paths of a trie, kept as arrays level by level, so keys that begin alike are
scored together as far as they agree.  The score is the bit-vector recurrence of Hyyrö (2004), one
column of it per trie node, for many names at once.  A node is left when even the best end below it
scores under what is asked.  The asked score begins near 1 and falls until a name has enough
neighbours, so a name with near ones never meets the rest.  All results that a scan would rank first
are found: a node is left only when all names below it score less than the ones that are kept.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

# executors need not have this package installed
register_pickle_by_value(sys.modules[__name__])

#: states scored at once, and hits kept before they are cut to the best
STATES, HITS = 1 << 18, 1 << 20
WORD = 64
ALPHABET = 36


def _codes(keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as 0 to 25, digits as 26 to 35, one row per key; and the lengths."""
    texts = np.array([k.encode("ascii") for k in keys], dtype=bytes)
    raw = texts.view(np.uint8).reshape(len(keys), -1)
    lengths = np.count_nonzero(raw, axis=1)
    return np.where(raw >= 97, raw - 97, raw - 22).astype(np.uint8), lengths


class Trie:
    """Distinct keys, none of them empty, as nodes per level.

    A node has its character, its first child and number of children on the next level, the shortest
    and longest key below it, and the number of the key that ends in it, or -1.
    """

    def __init__(self, keys: Sequence[str]):
        self.keys = sorted(keys)
        codes, lengths = _codes(self.keys)
        common = np.full(len(self.keys), -1)  # characters shared with the key before
        if len(self.keys) > 1:
            padded = np.where(np.arange(codes.shape[1]) < lengths[:, None], codes, 255)
            common[1:] = np.argmax(padded[1:] != padded[:-1], axis=1)
        self.levels: list[tuple[np.ndarray, ...]] = []
        nodes = []
        for depth in range(codes.shape[1]):
            starts = np.flatnonzero(common <= depth)
            ends = np.append(starts[1:], len(self.keys))
            shortest = np.minimum.reduceat(lengths, starts)
            longest = np.maximum.reduceat(lengths, starts)
            deep = lengths[starts] > depth
            nodes.append([x[deep] for x in (starts, ends, shortest, longest)])
        for depth, (starts, ends, shortest, longest) in enumerate(nodes):
            below = nodes[depth + 1][0] if depth + 1 < len(nodes) else np.empty(0, int)
            first = np.searchsorted(below, starts)
            self.levels.append((
                codes[starts, depth], first, np.searchsorted(below, ends) - first, shortest, longest,
                np.where(lengths[starts] == depth + 1, starts, -1),
            ))


class _Best:
    """Found names of each asker, cut to the first ``n`` by score and name."""

    def __init__(self, names: list[np.ndarray], n: int):
        counts = np.array([len(x) for x in names])
        self.offsets, self.counts = np.cumsum(counts) - counts, counts
        self.flat, self.n = np.concatenate(names), n
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, asker: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        each, at = _expanded(self.offsets[key], self.counts[key])
        self.parts.append((asker[each], score[each], self.flat[at]))
        self.held += len(each)

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """asker, score and name of what stays, and its place among the names of the asker."""
        if not self.parts:
            return np.empty(0, int), np.empty(0), np.empty(0, int), np.empty(0, int)
        asker, score, name = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((name, -score, asker))
        asker, score, name = asker[order], score[order], name[order]
        place = np.arange(len(asker)) - np.searchsorted(asker, asker)
        kept = place < self.n
        asker, score, name, place = asker[kept], score[kept], name[kept], place[kept]
        self.parts, self.held = [(asker, score, name)], len(asker)
        return asker, score, name, place


def _expanded(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``counts`` numbers from ``first``: which range, and the number."""
    each = np.repeat(np.arange(len(counts)), counts)
    return each, np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts) + first[each]


def _bits(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: the positions of each character in each key, and all positions."""
    words = -(-codes.shape[1] // WORD)
    masks = np.zeros((words, len(codes), ALPHABET), np.uint64)
    every = np.zeros((words, len(codes)), np.uint64)
    for i in range(codes.shape[1]):
        rows = np.flatnonzero(lengths > i)
        bit = np.uint64(1) << np.uint64(i % WORD)
        masks[i // WORD, rows, codes[rows, i]] |= bit
        every[i // WORD, rows] |= bit
    return masks, every


def _step(state: list[np.ndarray], masks: list[np.ndarray]) -> list[np.ndarray]:
    """The next column of the recurrence; a sum carries into the next word."""
    out, carry = [], None
    for v, m in zip(state, masks):
        total = v + (v & m)
        over = total < v
        if carry is not None:
            more = total + carry
            over |= more < total
            total = more
        carry = over.astype(np.uint64)
        out.append(total | (v & ~m))
    return out


def _round(
    trie: Trie, askers: np.ndarray, masks: np.ndarray, every: np.ndarray, lengths: np.ndarray,
    least: np.ndarray, best: _Best,
) -> None:
    """Put into ``best`` all keys that score ``least`` of the asker; raises it where n are found."""
    words = range(len(masks))

    def scored(depth: int, asker: np.ndarray, node: np.ndarray, state: list[np.ndarray]) -> None:
        code, _, _, shortest, longest, ending = (x[node] for x in trie.levels[depth])
        state = _step(state, [masks[w][asker, code] for w in words])
        mine = lengths[asker]
        common = mine - sum(
            np.bitwise_count(state[w] & every[w][asker]).astype(np.int64) for w in words
        )
        ends = np.flatnonzero(ending >= 0)
        score = 2.0 * common[ends] / (mine[ends] + depth + 1)
        good = score >= least[asker[ends]]
        best.add(asker[ends][good], ending[ends][good], score[good])
        theirs = np.clip(mine - common + depth + 1, shortest, longest)
        most = 2.0 * np.minimum(mine, common + theirs - depth - 1) / (mine + theirs)
        able = np.flatnonzero(most >= least[asker])
        todo.append((depth, asker[able], node[able], [v[able] for v in state]))
        if best.held > HITS:
            asker, score, _, place = best.cut()
            full = place == best.n - 1
            least[asker[full]] = np.maximum(least[asker[full]], score[full])

    todo: list[tuple] = []
    roots = len(trie.levels[0][0])
    for some in np.array_split(askers, max(1, len(askers) * roots // STATES)):
        asker = np.repeat(some, roots)
        scored(0, asker, np.tile(np.arange(roots), len(some)), [every[w][asker] for w in words])
        while todo:
            depth, asker, node, state = todo.pop()
            if depth + 1 == len(trie.levels) or not len(asker):
                continue
            _, first, children, *_ = trie.levels[depth]
            counts = children[node]
            total = np.cumsum(counts)
            if total[-1] > STATES and len(asker) > 1:
                half = min(max(1, int(np.searchsorted(total, total[-1] // 2))), len(asker) - 1)
                for part in (slice(half, None), slice(None, half)):
                    todo.append((depth, asker[part], node[part], [v[part] for v in state]))
                continue
            each, child = _expanded(first[node], counts)
            if len(each):
                scored(depth + 1, asker[each], child, [v[each] for v in state])


def nearest(
    asked: Sequence[str], names: Sequence[str | None], keys: Sequence[str], low: float, n: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each asked key the ``n`` names whose keys score at least ``low``; ties by name.

    The score is twice the longest common subsequence over both lengths, 0 with an empty key.
    Returns the numbers of asked key and name, and the score.
    """
    order = sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i] or ""))
    groups: dict[str, list[int]] = {}
    for place, i in enumerate(order):
        of_key = groups.setdefault(keys[i], [])
        if len(of_key) < n:  # equal keys score alike: only the first names can be among the best
            of_key.append(place)
    empty = groups.pop("", [])
    found: list[tuple[np.ndarray, ...]] = []
    if low <= 0:
        for i, k in enumerate(asked):
            some = np.array(empty[:n] if k else range(min(n, len(order))), int)
            found.append((np.full(len(some), i), np.zeros(len(some)), some))
    lengths_of = np.array([len(k) for k in asked], int)
    wide = -(-lengths_of // WORD)
    if groups:
        trie = Trie(list(groups))
        places = [np.array(groups[k], int) for k in trie.keys]
        for words in sorted(set(wide.tolist()) - {0}):
            whose = np.flatnonzero(wide == words)
            codes, lengths = _codes([asked[i] for i in whose])
            masks, every = _bits(codes, lengths)
            open_, misses = np.arange(len(whose)), 1
            while len(open_):
                least = np.maximum(low, 1 - misses / lengths)
                last = least[open_] <= low
                best = _Best(places, n)
                _round(trie, open_, masks, every, lengths, least, best)
                asker, score, name, place = best.cut()
                done = np.zeros(len(whose), bool)
                done[asker[place == n - 1]] = True
                done[open_[last]] = True
                kept = done[asker]
                found.append((whose[asker[kept]], score[kept], name[kept]))
                open_, misses = open_[~done[open_]], 2 * misses
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    best = _Best([np.empty(0, int)], n)
    best.parts = found
    asker, score, name, _ = best.cut()
    return asker, np.array(order, int)[name], score


def nearest_cells(low: float, n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of the asked and the offered tables (``schema, table, key``) of one cell."""

    def cell(asked: pa.Table, offered: pa.Table) -> pa.Table:
        asker, name, score = nearest(
            asked["key"].to_pylist(), offered["table"].to_pylist(), offered["key"].to_pylist(), low, n
        )
        return pa.table({
            "schema": asked["schema"].take(asker), "source_table": asked["table"].take(asker),
            "target_table": offered["table"].take(name), "ratio": pa.array(score, pa.float64()),
        })

    return cell

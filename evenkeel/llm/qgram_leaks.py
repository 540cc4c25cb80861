"""Benchmark decontamination by the q-gram lemma, with verification by banded alignment.

Texts are compared as lower-case letters and digits, everything else one blank.  A benchmark item
is cut into windows of m characters every `stride`; a window may differ by k edits (a tenth of m).  By
the lemma an occurrence within k edits shares at least m - q + 1 - k * q q-grams with the window, and
all of them lie within k + 1 neighbouring diagonals.  Shared q-grams are counted twice: first in a
hashed table of cells (a band of diagonals by a stretch of the item; an occurrence lies in two by two
neighbouring cells), which drops nearly all of them, then exactly per window in diagonal bands of
2 (k + 1), each overlapping the next by half.  Bands that reach the bound are regions, and a region counts
only if a banded alignment finds the window with k edits at most.  So all occurrences of windows are
found, and every verbatim excerpt of window + stride - 1 characters (79) or more.

The benchmark is the stated query set: it is taken in blocks of at most `block_chars` characters (one
broadcast each, of about 40 bytes a character), and the documents are scanned once per block.  Equal
items and equal windows are searched once; all items of a text are reported.  Documents never cross a
shuffle; only matches do.  Long texts are walked in overlapping segments, and where many q-grams are
shared (`0 0 0 0`) segments and windows are halved until the pairs of places fit `MOST`: memory is
bounded for any text.

Items of fewer than `shortest` characters after normalising are no evidence and are not searched;
items shorter than a window are one window.  Null texts match nothing.  Rows that repeat a doc_id
count as one document; a null doc_id is a document id of its own.  Empty tables give empty results;
other columns are not read (`clean_documents` returns them as they came).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.textkeys import Powers

Q, WINDOW, STRIDE, RATE, SHORTEST = 7, 64, 16, 0.1, 24
BLOCK_CHARS = 4_000_000
SLICE_CHARS, SEGMENT_CHARS = 1 << 19, 1 << 15
MOST = 1 << 20
BITMAP_BITS, CELL_BITS = 22, 20
WHOLE = -(1 << 40)  # in place of a diagonal: the whole segment is the region
_BLANK, _CELL_STEP = 0x20, 0x9E3779B1


def budget(m: int, q: int = Q, rate: float = RATE) -> tuple[int, int]:
    """Edits allowed for a window of m characters, and the q-grams an occurrence must share."""
    k = int(m * rate)
    while k and m - q + 1 - k * q < 1:
        k -= 1
    return k, max(1, m - q + 1 - k * q)


def normal_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The normalised texts as code points, one after another, and where each begins."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begins = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in low], out=begins[1:])
    if not len(codes):
        return codes, begins
    seen = np.bincount(codes) > 0
    seen[seen] = [chr(c).isalnum() for c in np.flatnonzero(seen).tolist()]
    solid = seen[codes]
    last = np.append(solid[1:], False)  # a blank stands for a gap: at its last character ...
    gap = ~solid & last
    gap[begins[1:-1][begins[1:-1] > 0] - 1] = False  # ... unless the text ends there
    # ... or has not begun: no solid character of this text comes before
    solids = np.append(0, np.cumsum(solid))
    at = np.flatnonzero(gap)
    own = np.searchsorted(begins, at, side="right") - 1
    gap[at[solids[at] == solids[begins[own]]]] = False
    keep = solid | gap
    kept = np.append(0, np.cumsum(keep))
    return np.where(solid, codes, np.uint32(_BLANK))[keep], kept[begins]


def normal(text: str | None) -> str:
    return normal_codes([text])[0].tobytes().decode("utf-32-le", "surrogatepass")


def _grams(codes: np.ndarray, powers: Powers, q: int = Q) -> np.ndarray:
    """A number per q-gram, equal where the q-grams are equal."""
    n = len(codes) - q + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    powers.grow(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((codes.astype(np.uint64) + np.uint64(77)) * powers.up[: len(codes)], out=sums[1:])
        grams = sums[q:] - sums[:-q]
        grams *= powers.down[:n]
    return grams


def _spots(grams: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP_BITS)


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, ... (n[0] numbers), low[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(low - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)


class Index:
    """The distinct windows of a block of benchmark items and the places of their q-grams."""

    def __init__(self, items: list[tuple], window: int, stride: int, shortest: int) -> None:
        """items: key and text; `owners` are the windows' keys (several, where items share one)."""
        codes, begins = normal_codes([t for _, t in items])
        seen: dict[bytes, int] = {}
        starts, lengths, self.owners = [], [], []
        for (key, _), a, z in zip(items, begins[:-1].tolist(), begins[1:].tolist()):
            n = z - a
            if n < shortest:
                continue
            for s in [0] if n <= window else [*range(0, n - window, stride), n - window]:
                text = codes[a + s : a + min(n, s + window)].tobytes()
                if text not in seen:
                    seen[text] = len(starts)
                    starts.append(a + s)
                    lengths.append(min(n, window))
                    self.owners.append([])
                owners = self.owners[seen[text]]
                if not owners or owners[-1] != key:
                    owners.append(key)
        self.codes = codes
        self.start = np.array(starts, dtype=np.int64)
        self.length = np.array(lengths, dtype=np.int64)
        shape = [budget(m) for m in lengths]
        self.edits = np.array([k for k, _ in shape], dtype=np.int64)
        self.shared = np.array([t for _, t in shape], dtype=np.int64)
        self.span = max(1, window - Q + 1)  # q-grams of a window, at most
        self.width = int(self.edits.max(initial=0)) + 1
        self.slack = 2 * window  # more than a window with its edits
        # the places of q-grams in a window, and the windows of each place
        place = np.unique(_ranges(self.start, self.length - Q + 1)) if starts else self.start
        grams = _grams(codes, Powers())[place] if starts else np.zeros(0, dtype=np.uint64)
        order = np.lexsort((place, grams))
        self.place = place[order]
        self.grams, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(order))
        number = np.repeat(np.arange(len(self.grams)), np.diff(self.first))
        self.size = len(codes) + 1
        self.entry = number * self.size + self.place
        self.low = np.searchsorted(self.start + self.length - Q, self.place)
        self.high = np.searchsorted(self.start, self.place, side="right")
        least = np.full(len(codes) + 1, 1 << 15, dtype=np.int64)
        for at, n, t in zip(starts, lengths, self.shared.tolist()):
            least[at : at + n] = np.minimum(least[at : at + n], t)
        self.least = least[self.place].astype(np.uint16)
        self.bits = np.zeros(1 << BITMAP_BITS, dtype=bool)
        self.bits[_spots(self.grams)] = True

    def hits(self, codes: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts' q-grams that the index holds, and their numbers there."""
        grams = _grams(codes, powers)
        near = np.flatnonzero(self.bits[_spots(grams)])
        g = np.searchsorted(self.grams, grams[near])
        g[g == len(self.grams)] = 0
        hit = self.grams[g] == grams[near]
        return near[hit], g[hit]

    def bands(self, at, gram, segments, some: tuple[int, int], low: int, high: int) -> Iterator[tuple]:
        """segment, window and lowest diagonal of the regions of the windows from `low` to `high` in the
        segments (rows begin, end) from some[0] to some[1], in which the hits (at, gram) lie."""
        if low == high or not len(at):
            return
        if low == 0 and high == len(self.start):
            first, n = self.first[gram], self.first[gram + 1] - self.first[gram]
        else:
            a, z = self.start[low], self.start[high - 1] + self.length[high - 1] - Q
            first = np.searchsorted(self.entry, gram * self.size + a)
            n = np.searchsorted(self.entry, gram * self.size + z, side="right") - first
        alone = some[1] - some[0] == 1 and high - low == 1
        if int(n.sum()) > MOST and not alone:
            yield from self._halves(at, gram, segments, some, low, high)
            return
        if alone and int(n.sum()) > 2 * (segments[some[0], 1] - segments[some[0], 0]):
            yield np.array([some[0]]), np.array([low]), np.array([WHOLE])
            return
        entry, where = _ranges(first, n), np.repeat(at, n)
        able = self._crowded(where, self.place[entry]) >= self.least[entry]
        entry, where = entry[able], where[able]
        first = np.maximum(self.low[entry], low)
        n = np.maximum(np.minimum(self.high[entry], high) - first, 0)
        if int(n.sum()) > MOST and not alone:
            yield from self._halves(at, gram, segments, some, low, high)
            return
        window = _ranges(first, n)
        where, place = np.repeat(where, n), np.repeat(self.place[entry], n)
        begin = where - place + self.start[window]  # where the window would begin
        segment = np.searchsorted(segments[some[0] : some[1], 0], where, side="right") - 1 + some[0]
        # bands of all segments in one row, with room for what begins before its segment
        room = segments[some[0] : some[1], 1] - segments[some[0] : some[1], 0] + 2 * self.slack + 2
        base = np.append(0, np.cumsum(room))
        band = (begin - segments[segment, 0] + self.slack) // (self.edits[window] + 1)
        key = (base[segment - some[0]] + band + 1) * (high - low) + window - low
        key = np.concatenate([key, key - (high - low)])  # bands overlap: each q-gram lies in two
        found, shared = np.unique(key, return_counts=True)
        window = found % (high - low) + low
        reached = shared >= self.shared[window]
        found, window = found[reached], window[reached]
        row = found // (high - low)
        own = np.searchsorted(base, row, side="right") - 1
        yield own + some[0], window, (row - base[own] - 1) * (self.edits[window] + 1) - self.slack

    def _crowded(self, where: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For each pair of places an upper bound of the pairs of an occurrence that it may be part of:
        the most in two by two neighbouring cells that hold its own."""
        size = 1 << CELL_BITS
        step = _CELL_STEP & (size - 1)
        cell = ((where - place + self.size) // self.width * step + place // self.span) & (size - 1)
        count = np.minimum(np.bincount(cell, minlength=size), 1 << 13).astype(np.uint16)
        count += np.roll(count, -1)
        count += np.roll(count, -step)
        np.maximum(count, np.roll(count, 1), out=count)
        np.maximum(count, np.roll(count, step), out=count)
        return count[cell]

    def _halves(self, at, gram, segments, some, low, high) -> Iterator[tuple]:
        if some[1] - some[0] > 1:
            half = (some[0] + some[1]) // 2
            for part in ((some[0], half), (half, some[1])):
                i, j = np.searchsorted(at, [segments[part[0], 0], segments[part[1] - 1, 1]])
                yield from self.bands(at[i:j], gram[i:j], segments, part, low, high)
        else:
            middle = (low + high) // 2
            yield from self.bands(at, gram, segments, some, low, middle)
            yield from self.bands(at, gram, segments, some, middle, high)

    def occurrences(self, codes, begins, powers) -> np.ndarray:
        """Rows doc, window, fewest edits, place of the best occurrence (the first one) in the doc."""
        reach = SEGMENT_CHARS - 2 * self.slack
        parts = np.maximum(1, -(-(np.diff(begins) - 2 * self.slack) // reach))
        doc = np.repeat(np.arange(len(parts)), parts)
        turn = _ranges(np.zeros(len(parts), dtype=np.int64), parts)
        begin = begins[doc] + turn * reach
        end = np.minimum(begin + SEGMENT_CHARS, begins[doc + 1])
        at, gram = self.hits(codes, powers)
        out = [np.zeros((0, 4), dtype=np.int64)]
        for odd in (0, 1):  # the segments of a text overlap the next one only
            mine = np.flatnonzero((turn % 2 == odd) & (end > begin))
            if not len(mine):
                continue
            segments = np.stack([begin[mine], end[mine]], axis=1)
            own = np.searchsorted(segments[:, 0], at, side="right") - 1
            inside = (own >= 0) & (at + Q <= segments[own, 1])
            hits = at[inside], gram[inside]
            for regions in self.bands(*hits, segments, (0, len(mine)), 0, len(self.start)):
                for rows in self._verified(codes, segments, *regions):
                    own = mine[rows[:, 0]]
                    rows[:, 3] = np.maximum(rows[:, 3], 0) + begin[own] - begins[doc[own]]
                    rows[:, 0] = doc[own]
                    out.append(rows)
        rows = np.concatenate(out)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.any(np.diff(rows[:, :2], axis=0, prepend=-1) != 0, axis=1)
        return rows[new]

    def _verified(self, codes, segments, segment, window, low) -> Iterator[np.ndarray]:
        """Regions whose alignment stays within the budget.  The regions of a window in a segment are
        aligned from the first on, 1, 2, 4, ... at a time, until one is without edits; where they
        cover the segment anyway, it is one region."""
        order = np.lexsort((low, window, segment))
        segment, window, low = segment[order], window[order], low[order]
        new = (np.diff(segment, prepend=-1) != 0) | (np.diff(window, prepend=-1) != 0)
        first = np.flatnonzero(new)
        pair = np.cumsum(new) - 1
        turn = np.arange(len(pair)) - first[pair]
        size = np.diff(np.append(first, len(pair)))
        begin, end = segments[segment[first], 0], segments[segment[first], 1]
        exact = (low[first] == WHOLE) | (size * self._band(window[first]) > end - begin)
        done, many = 0, 1
        for f in np.flatnonzero(exact).tolist():
            at = first[f]
            edits, place = self._anywhere(codes[begin[f] : end[f]], window[at])
            if edits <= self.edits[window[at]]:
                yield np.array([[segment[at], window[at], edits, place]], dtype=np.int64)
        while done <= (int(turn.max()) if len(turn) else -1):
            now = np.flatnonzero((turn >= done) & (turn < done + many) & ~exact[pair])
            done, many = done + many, 2 * many
            if not len(now):
                continue
            edits = self._aligned(codes, segments, segment[now], window[now], low[now])
            exact[pair[now[edits == 0]]] = True
            good = edits <= self.edits[window[now]]
            now, edits = now[good], edits[good]
            yield np.stack([segment[now], window[now], edits, low[now]], axis=1)

    def _band(self, window):
        """Columns of the alignment of one region."""
        return 4 * self.edits[window] + 3

    def _anywhere(self, text: np.ndarray, window: int) -> tuple[int, int]:
        """Fewest edits of a window in a text, and about where it begins (the first such place)."""
        ramp = np.arange(len(text) + 1, dtype=np.int32)
        row = np.zeros(len(text) + 1, dtype=np.int32)
        start, m = self.start[window], int(self.length[window])
        for c in self.codes[start : start + m]:
            new = row + 1
            np.minimum(new[1:], row[:-1] + (text != c), out=new[1:])
            row = np.minimum.accumulate(new - ramp) + ramp
        end = int(row.argmin())
        return int(row[end]), end - m

    def _aligned(self, codes, segments, segment, window, low) -> np.ndarray:
        """Fewest edits of each window within its band (a free start and end in the segment)."""
        best = np.full(len(segment), 1 << 20, dtype=np.int64)
        shapes = np.stack([self.length[window], self.edits[window]], axis=1)
        for m, k in np.unique(shapes, axis=0).tolist():
            here = np.flatnonzero((shapes[:, 0] == m) & (shapes[:, 1] == k))
            for i in range(0, len(here), 4096):
                part = here[i : i + 4096]
                begin, end = segments[segment[part], 0], segments[segment[part], 1]
                best[part] = self._distance(codes, begin, end, window[part], low[part], m, k)
        return best

    def _distance(self, codes, begin, end, window, low, m, k) -> np.ndarray:
        width = 4 * k + 3
        start = begin + low - k  # the text position of column 0 in row 0
        col = np.arange(width)
        row = np.zeros((len(begin), width), dtype=np.int32)
        ramp = col.astype(np.int32)
        # the letters that the band meets, once; outside of the segment none that equals any
        reach = start[:, None] + np.arange(m + width)[None, :]
        inside = (reach >= begin[:, None]) & (reach < end[:, None])
        text = np.where(inside, codes[np.clip(reach, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
        pattern = self.codes[self.start[window][:, None] + np.arange(m)[None, :]]
        for i in range(m):
            new = row + (text[:, i : i + width] != pattern[:, i : i + 1])
            np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
            row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        return row.min(axis=1)


def _scan(index_of):
    names = ["doc_id", "key", "window", "edits", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, powers = index_of.value, Powers()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            i = 0
            while i < len(texts):
                some, size = [], 0
                while i + len(some) < len(texts) and (not some or size < SLICE_CHARS):
                    some.append(texts[i + len(some)].as_py())
                    size += len(some[-1] or "")
                codes, begins = normal_codes(some)
                if len(codes) >= Q and len(index.start):
                    rows = index.occurrences(codes, begins, powers)
                    n = [len(index.owners[w]) for w in rows[:, 1].tolist()]
                    keys = [key for w in rows[:, 1].tolist() for key in index.owners[w]]
                    rows = np.repeat(rows, n, axis=0)
                    if len(rows):
                        columns = [pa.array(rows[:, c], pa.int64()) for c in (1, 2, 3)]
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(rows[:, 0] + i)), pa.array(keys), *columns], names
                        )
                i += len(some)

    return run


def leaks(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, stride: int = STRIDE,
    shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """doc_id, item_id, n_windows (different windows of the item that the document holds), min_edits,
    first_at (about where the best occurrence begins in the normalised text, the first on ties)."""
    spark = documents.sparkSession
    # equal items are searched once and come back by the checksum of their text
    named = benchmark.filter("text IS NOT NULL").select(F.md5("text").alias("key"), "item_id", "text")
    items = named.groupBy("key").agg(F.first("text").alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    found = None
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        index = Index(sorted(tuple(r) for r in mine.collect()), window, stride, shortest)
        one = documents.select("doc_id", "text").mapInArrow(
            _scan(spark.sparkContext.broadcast(index)),
            "doc_id long, key string, window long, edits long, at long",
        )
        found = one if found is None else found.union(one)
    best = F.min(F.struct("edits", "at"))
    texts = found.groupBy("doc_id", "key").agg(
        F.count_distinct("window").alias("n_windows"), best.alias("best")
    )
    return texts.join(named.select("key", "item_id").distinct(), "key").select(
        "doc_id", "item_id", "n_windows",
        F.col("best.edits").alias("min_edits"), F.col("best.at").alias("first_at"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a match, as they came; every row is judged by its own text."""
    key = F.xxhash64("doc_id", "text")
    keyed = documents.select(key.alias("doc_id"), "text")
    dirty = leaks(keyed, benchmark, **options).select(F.col("doc_id").alias("dirty")).distinct()
    rows = documents.select(F.struct("*").alias("doc"), key.alias("r"))
    return rows.join(dirty, rows["r"] == dirty["dirty"], "left_anti").select("doc.*")

"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that is
at least max(6, 4 q) words long and that no neighbouring word extends.  So each word of a run occurs
at least four times in it, and a word that occurs less often in a segment cannot lie in a run of
that segment: it splits the segment.  The parts are counted anew, until no word is too rare any more;
of ordinary prose next to nothing survives.

The surviving segments of many documents stand one after another, parted by numbers that occur
once, and are scanned lag by lag.  The matches of a run of period q are a stretch of 3 q positions at
least, so it holds three neighbouring multiples of q: only these are looked at (n / q of them), blocks
that match by their prefix sums are compared word by word.  A block inside a known run of
smaller period belongs to that run (periodicity lemma) and is left out.  All of it is about
n log n; `ROUNDS` ends the splitting of contrived texts, which costs time only, since the scan alone
is exact.

Words are `[^\\x20\\x09-\\x0D]+`, compared exactly and as they stand.  A null or empty text has no words
and no runs, its collapsed text is empty.  Rows that repeat are treated each for itself; a null
doc_id is kept.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import let, words as word_array
from evenkeel.llm.textkeys import mix, slices, text_bytes, words

REPEATS, SHORTEST, ROUNDS = 4, 6, 64
SLICE_BYTES = 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_ids(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words one after another, and a number per word: equal where the words are."""
    mark = np.zeros(len(raw) + 1, dtype=np.int8)
    mark[first] += 1
    mark[last] -= 1
    packed = raw[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    ends = np.zeros(len(first) + 1, dtype=np.int64)
    np.cumsum(last - first, out=ends[1:])
    array = pa.Array.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(packed)]
    )
    return packed, array.dictionary_encode().indices.to_numpy().astype(np.int64)


def split(ids: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Places that can lie in a run: segments are split until no word is too rare in its own."""
    at, n_ids = np.arange(len(ids)), int(ids.max(initial=0)) + 1
    settled_at = []
    for _ in range(ROUNDS):
        if not len(at):
            break
        key = segment * n_ids + ids[at]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        often = count[which] >= REPEATS
        torn = np.zeros(int(segment[-1]) + 1, dtype=bool)
        torn[segment[~often]] = True
        settled = ~torn[segment]
        settled_at.append(at[settled])
        left = often & ~settled
        at, old = at[left], segment[left]
        segment = np.cumsum((np.diff(at, prepend=-2) != 1) | (np.diff(old, prepend=-1) != 0))
        long = np.bincount(segment, minlength=1)[segment] >= SHORTEST
        at, segment = at[long], segment[long]
    return np.sort(np.concatenate([*settled_at, at]))


def _stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist()))


class _Known:
    """The runs found so far: does one of them hold a block?"""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int]] = []
        self.starts = self.reach = np.zeros(0, dtype=np.int64)

    def add(self, new: list[tuple[int, int, int]]) -> None:
        self.runs += new
        more = np.array([(s, s + n) for s, n, _ in new], dtype=np.int64)
        starts = np.concatenate([self.starts, more[:, 0]])
        ends = np.concatenate([self.reach, more[:, 1]])
        order = np.argsort(starts, kind="stable")
        self.starts, self.reach = starts[order], np.maximum.accumulate(ends[order])

    def hold(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(len(begin), dtype=bool)
        i = np.searchsorted(self.starts, begin, side="right") - 1
        return (i >= 0) & (self.reach[i] >= end)


def lag_scan(ids: np.ndarray, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """start, length, period of all runs in the segments; `at` are the places of their words."""
    known, q = _Known(), 1
    while len(at):
        size = np.bincount(segment)
        long = size[segment] >= max(SHORTEST, REPEATS * q)
        at, segment = at[long], segment[long]
        if not len(at):
            break
        # one number that occurs nowhere else stands between two segments
        gap = np.cumsum(np.diff(segment, prepend=segment[0]) != 0)
        place = np.arange(len(at)) + gap
        x = -1 - np.arange(len(at) + int(gap[-1]) + 1, dtype=np.int64)
        x[place] = ids[at]
        word = np.zeros(len(x), dtype=np.int64)
        word[place] = at
        sums, powers = np.zeros(len(x) + 1, dtype=np.uint64), np.full(len(x) + 1, _P)
        powers[0] = 1
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(powers)
            np.cumsum(mix(x.astype(np.uint64)) * powers[:-1], out=sums[1:])
        longest = int(size.max()) // REPEATS
        for q in range(q, min(2 * q, longest + 1)):
            y = x[::q]
            same = y[1:] == y[:-1]
            a = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q
            if not len(a):
                continue
            with np.errstate(over="ignore"):
                block, moved = sums[a + 2 * q] - sums[a], sums[a + 3 * q] - sums[a + q]
                a = a[block * powers[q] == moved]
            a = a[~known.hold(word[a], word[a] + 3 * q)]
            if not len(a):
                continue
            fresh = np.diff(a, prepend=-2 * q) != q
            least = max(SHORTEST, REPEATS * q) - q
            new = []
            for low, high in zip(a[fresh], a[np.append(np.flatnonzero(fresh)[1:] - 1, len(a) - 1)]):
                low, high = max(0, int(low) - q), min(len(x) - q, int(high) + 3 * q)
                for begin, end in _stretches(x[low:high] == x[low + q : high + q], least):
                    new.append((int(word[low + begin]), end - begin + q, q))
            if new:
                known.add(new)
        q += 1
        if q > longest:
            break
    return np.array(sorted(known.runs), dtype=np.int64).reshape(-1, 3)


def find_runs(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """start (place in `ids`), length and period of all runs within documents, by start and period."""
    at = split(ids, doc)
    if not len(at):
        return np.zeros((0, 3), dtype=np.int64)
    segment = np.cumsum((np.diff(at, prepend=at[0] - 1) != 1) | (np.diff(doc[at], prepend=doc[at[0]]) != 0))
    return lag_scan(ids, at, segment)


def _joined(packed, length, keep, at) -> pa.Array:
    """Per document its kept words, joined by one space."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    kept, doc = length[keep], doc[keep]
    blank = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, dtype=bool)
    ends = np.cumsum(kept + blank)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
    solid = np.ones(len(out), dtype=bool)
    solid[ends[blank] - 1] = False
    out[solid] = packed[np.repeat(keep, length)]
    offsets = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(np.bincount(doc, kept + blank, minlength=n).astype(np.int64), out=offsets[1:])
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "runs", "collapsed"]
    for batch in batches:
        raw_all, begins_all = text_bytes(batch.column(1))
        for i, j in slices(begins_all, SLICE_BYTES):
            begins = begins_all[i : j + 1] - begins_all[i]
            raw = raw_all[begins_all[i] : begins_all[j]]
            first, last, at = words(raw, begins)
            packed, ids = word_ids(raw, first, last)
            found = find_runs(ids, np.repeat(np.arange(j - i), np.diff(at)))
            drop = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(drop, found[:, 0] + found[:, 2], 1)
            np.add.at(drop, found[:, 0] + found[:, 1], -1)
            keep = np.cumsum(drop[:-1]) == 0
            border = np.searchsorted(found[:, 0], at)
            owner = np.searchsorted(at, found[:, 0], side="right") - 1
            run = pa.StructArray.from_arrays(
                [pa.array(found[:, 0] - at[owner]), pa.array(found[:, 1]), pa.array(found[:, 2])],
                fields=list(_RUN),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array(np.diff(at), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(border, pa.int32()), run),
                    _joined(packed, last - first, keep, at),
                ],
                names,
            )


def collapse_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed: the text with one period of each run
    left, its words joined by one space.  One scan, no shuffle."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        _collapse, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string"
    )


def most_repeated(runs):
    """The run with the greatest length / period; the first one on ties, null without a run."""
    return F.reduce(
        runs,
        F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda best, r: F.when(
            best.isNull()
            | (r["length"] * best["period"] > best["length"] * r["period"]),
            r,
        ).otherwise(best),
    )


def plant_runs(documents: DataFrame) -> DataFrame:
    """Every tenth document or so (by its id's checksum) ends in repeats of some of its own words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(
            F.transform(
                F.sequence(F.lit(0).cast("long"), n - 1),
                lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")),
            ),
            " ",
        )

    whole = word_array(F.col("text"))
    text = F.when(
        h % 10 == 0, let(whole, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.col("text")))
    ).otherwise(F.col("text"))
    return documents.select("doc_id", text.alias("text"))


def run_report(documents: DataFrame) -> DataFrame:
    """Digests of collapse_runs over documents with planted runs, one row per document."""
    one = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    found = collapse_runs(plant_runs(documents)).withColumn("best", most_repeated("runs"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(one, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

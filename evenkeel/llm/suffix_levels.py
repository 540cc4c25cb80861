"""Removal of repeated byte strings with sampled suffixes and a logarithmic family of suffix arrays.

Each byte that a `length`-byte string covers goes, if that string starts anywhere else as well.

1. Sampling.  A string's anchor is the position of the smallest 16-gram hash within its middle
   `middle` starts (the first one on ties), so equal strings have equal anchors at equal distance.  All
   strings of one anchor share a core around it.  One in about 75 positions is an anchor.
2. Cores that occur once cannot lie in a repeated string; a grouping with map-side combine drops
   them.  Where all occurrences of a core have one and the same context (the bytes of all its
   strings), every string of the anchor is repeated.
3. The other contexts (the borders of copies) are compared string by string.  Contexts with a common
   core meet in one task, in batches: a new batch gets the array of its suffixes of at least
   `length` bytes, ordered by the fingerprint of their first `length` bytes (more order than that
   is not needed to find matches of that length), is merge-scanned against each level of the index
   family, and enters as the lowest level; levels of equal size merge, so there are
   logarithmically many.  A core with more than `hot` contexts is not gathered: its strings are
   counted one by one by a grouping.
4. Spans return to their documents.

Documents without border contexts are finished in the first pass over the texts; only the others
are kept for a second one.  All strings are judged on the input.

Null text: empty.  Texts shorter than `length` lose nothing.  Rows that repeat are separate occurrences,
so their strings repeat.  Empty table: empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm import textkeys
from evenkeel.llm.common import stored

LENGTH, MIDDLE, GRAM = 200, 150, 16
HOT, CHUNK, BATCH = 4096, 8192, 1024
LONG_TEXT = 4 << 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i that has so many."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(x.dtype).max, dtype=x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, begins: np.ndarray, powers: textkeys.Powers, length=LENGTH, middle=MIDDLE):
    """Per anchor: text, first and last string start (in the slice), core and context hashes, and
    the anchor's distance from the first start."""
    side = (length - middle) // 2
    count = np.maximum(np.diff(begins) - length + 1, 0)
    total = int(count.sum())
    none = np.zeros(0, dtype=np.int64)
    if not total:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    sums = textkeys.prefix_sums(raw, powers)
    i = np.arange(len(raw) - GRAM + 1)
    grams = textkeys.string_hash(sums, powers, i, i + GRAM)
    coded = (grams & ~np.uint64(0xFFFFFF)) | i.astype(np.uint64)
    low = _sliding_min(coded, middle)
    text = np.repeat(np.arange(len(count)), count)
    start = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + begins[text]
    at = (low[start + side] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.ones(total, dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], total) - 1
    lo, hi, at, text = start[head], start[tail], at[head], text[head]
    core = textkeys.string_hash(sums, powers, at - side, at + side + 1)
    context = textkeys.string_hash(sums, powers, lo, hi + length)
    shape = (at - lo).astype(np.uint64) * np.uint64(4096) + (hi - lo).astype(np.uint64)
    return text, lo, hi, core, textkeys.mix(context + shape), at - lo


def _parts(begins: np.ndarray, length: int):
    """Slices of texts; a very long text comes in pieces that overlap by length - 1 bytes."""
    for i, j in textkeys.slices(begins):
        a, z = int(begins[i]), int(begins[j])
        if j - i > 1 or z - a <= LONG_TEXT:
            yield i, a, begins[i : j + 1] - a, 0
        else:
            for b in range(a, z, LONG_TEXT):
                e = min(z, b + LONG_TEXT + length - 1)
                if e - b >= length or b == a:
                    yield i, b, np.array([0, e - b]), b - a


def _anchor_rows(length: int, middle: int):
    names = ["key", "lo", "hi", "core", "context", "shift"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textkeys.Powers()
        for batch in batches:
            raw_all, begins_all = textkeys.text_bytes(batch.column(1))
            for i, a, begins, offset in _parts(begins_all, length):
                raw = raw_all[a : a + int(begins[-1])]
                text, lo, hi, core, context, shift = anchors(raw, begins, powers, length, middle)
                inside = offset - begins[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(text + i)),
                        pa.array((lo + inside).astype(np.int32)),
                        pa.array((hi + inside).astype(np.int32)),
                        pa.array(core.view(np.int64)), pa.array(context.view(np.int64)),
                        pa.array(shift.astype(np.int32)),
                    ],
                    names,
                )

    return run


ANCHOR = "key long, lo int, hi int, core long, context long, shift int"


class Family:
    """Suffix arrays whose sizes grow geometrically; an entry is (fingerprint, owner, place)."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, prints: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
        """Insert a batch; yields the ids (of the batch and of levels) that found a match."""
        order = np.argsort(prints, kind="stable")
        prints, ids = prints[order], ids[order]
        same = prints[1:] == prints[:-1]
        yield ids[1:][same]
        yield ids[:-1][same]
        for level, owners in self.levels:
            left = np.searchsorted(level, prints, side="left")
            right = np.searchsorted(level, prints, side="right")
            hit = right > left
            yield ids[hit]
            # only the first of equal entries: the others found each other when they came together
            yield owners[left[hit]]
        while self.levels and len(self.levels[-1][0]) <= len(prints):
            level, owners = self.levels.pop()
            at = np.searchsorted(level, prints) + np.arange(len(prints))
            merged = np.empty(len(level) + len(prints), dtype=prints.dtype)
            carried = np.empty(len(merged), dtype=ids.dtype)
            rest = np.ones(len(merged), dtype=bool)
            rest[at] = False
            merged[at], merged[rest] = prints, level
            carried[at], carried[rest] = ids, owners
            prints, ids = merged, carried
        self.levels.append((prints, ids))


def _strings(contexts: list[bytes], powers: textkeys.Powers, length: int):
    """Fingerprint of every string of the contexts, and where each context's strings begin."""
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(size)])
    sums = textkeys.prefix_sums(np.frombuffer(b"".join(contexts), dtype=np.uint8), powers)
    n = size - length + 1
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(int(first[-1])) - np.repeat(first[:-1], n) + np.repeat(begins[:-1], n)
    return textkeys.string_hash(sums, powers, at, at + length), first


def _scan(length: int):
    """core, context, bytes, copies (by core) -> core, context, bits: which strings repeat."""

    def finish(rows: list[tuple], powers: textkeys.Powers) -> pa.RecordBatch:
        prints, first = _strings([r[2] for r in rows], powers, length)
        repeated = np.zeros(len(prints), dtype=bool)
        family = Family()
        for i in range(0, len(rows), BATCH):
            a, z = first[i], first[min(i + BATCH, len(rows))]
            for ids in family.add(prints[a:z], np.arange(a, z)):
                repeated[ids] = True
        for r, row in enumerate(rows):
            if row[3] > 1:
                repeated[first[r] : first[r + 1]] = True
        bits = [np.packbits(repeated[first[r] : first[r + 1]]).tobytes() for r in range(len(rows))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array(bits, pa.binary()),
            ],
            ["core", "context", "bits"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, rows = textkeys.Powers(), []
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    # cores come one after another; a chunk ends between two of them
                    if len(rows) >= CHUNK and row[0] != rows[-1][0]:
                        yield finish(rows, powers)
                        rows = []
                    rows.append(row)
        if rows:
            yield finish(rows, powers)

    return run


def _string_rows(length: int):
    """For cores with very many contexts: a row per string, counted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textkeys.Powers()
        for batch in batches:
            for i in range(0, len(batch), 256):
                core, context, data, copies = (c.to_pylist() for c in batch.slice(i, 256).columns)
                prints, first = _strings(data, powers, length)
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array(core, dtype=np.int64), n)),
                        pa.array(np.repeat(np.array(context, dtype=np.int64), n)),
                        pa.array((np.arange(len(prints)) - np.repeat(first[:-1], n)).astype(np.int32)),
                        pa.array(prints.view(np.int64)),
                        pa.array(np.repeat(np.array(copies, dtype=np.int64), n)),
                    ],
                    ["core", "context", "place", "print", "copies"],
                )

    return run


def _union(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the spans [lo, end)."""
    if not len(lo):
        return lo, end
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > end[:-1]
    head = np.flatnonzero(new)
    return lo[head], end[np.append(head[1:], len(lo)) - 1]


def _verdict(data: memoryview, lo: np.ndarray, end: np.ndarray) -> tuple[int, int, int, str]:
    a, z = _union(lo, end)
    digest = hashlib.sha256()
    at = 0
    for i, j in zip(a.tolist(), z.tolist()):
        digest.update(data[at:i])
        at = j
    digest.update(data[at:])
    return len(data), int((z - a).sum()), len(a), digest.hexdigest()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _ints(column: pa.Array, i: int) -> np.ndarray:
    value = column[i].values
    return np.zeros(0, dtype=np.int64) if value is None else value.to_numpy().astype(np.int64)


def _settle(length: int):
    """doc_id, key, text, lo, hi, open -> results; with open borders: the text and its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 512):
                batch = whole.slice(i, 512)
                raw, begins = textkeys.text_bytes(batch.column("text"))
                data = memoryview(raw.tobytes())
                done, waits, los, his = [], [], [], []
                for d in range(len(batch)):
                    lo, hi = _ints(batch.column("lo"), d), _ints(batch.column("hi"), d)
                    wait = batch.column("open")[d].as_py() or False
                    waits.append(wait)
                    los.append(lo.astype(np.int32) if wait else None)
                    his.append(hi.astype(np.int32) if wait else None)
                    mine = data[begins[d] : begins[d + 1]]
                    done.append((0, 0, 0, "") if wait else _verdict(mine, lo, hi + length))
                n, gone, runs, kept = zip(*done)
                text = batch.column("text")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("key"), pa.array(waits),
                        pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
                        pa.array(kept, pa.string()),
                        pa.array([t if w else None for t, w in zip(text, waits)], pa.string()),
                        pa.array(los, pa.list_(pa.int32())), pa.array(his, pa.list_(pa.int32())),
                    ],
                    ["doc_id", "key", "open", "n_bytes", "n_removed", "n_spans", "kept_sha256",
                     "text", "lo", "hi"],
                )

    return run


SETTLED = (
    "doc_id long, key long, open boolean, n_bytes long, n_removed long, n_spans long, "
    "kept_sha256 string, text string, lo array<int>, hi array<int>"
)


def _cut(length: int):
    """key, text, borders of it -> key, core, context, lo, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                raw, begins = textkeys.text_bytes(batch.column("text"))
                data = raw.tobytes()
                key, core, context, out = [], [], [], []
                for d in range(len(batch)):
                    at = int(begins[d])
                    for b in batch.column("borders")[d].as_py():
                        key.append(batch.column("key")[d].as_py())
                        core.append(b["core"])
                        context.append(b["context"])
                        out.append(data[at + b["lo"] : at + b["hi"] + length])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core, pa.int64()), pa.array(context, pa.int64()), pa.array(out, pa.binary())],
                    ["core", "context", "bytes"],
                )

    return run


def _finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                raw, begins = textkeys.text_bytes(batch.column("text"))
                data = memoryview(raw.tobytes())
                done = []
                for d in range(len(batch)):
                    los, ends = [_ints(batch.column("lo"), d)], [_ints(batch.column("hi"), d) + length]
                    for m in batch.column("marks")[d].as_py() or ():
                        at = np.flatnonzero(np.unpackbits(np.frombuffer(m["bits"], dtype=np.uint8)))
                        los.append(at + m["lo"])
                        ends.append(at + m["lo"] + length)
                    mine = data[begins[d] : begins[d + 1]]
                    done.append(_verdict(mine, np.concatenate(los), np.concatenate(ends)))
                n, gone, runs, kept = zip(*done)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                        pa.array(runs, pa.int64()), pa.array(kept, pa.string()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return run


def _repeated_strings(contexts: DataFrame, length: int, hot: int) -> DataFrame:
    """core, context, bits of the distinct contexts (core, context, bytes, copies)."""
    groups = contexts.groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    sized = contexts.join(groups, "core")
    columns = ["core", "context", "bytes", "copies"]
    usual = (
        sized.filter(F.col("n") <= hot).select(*columns)
        .repartition("core").sortWithinPartitions("core")
        .mapInArrow(_scan(length), "core long, context long, bits binary")
    )
    strings = sized.filter(F.col("n") > hot).select(*columns).mapInArrow(
        _string_rows(length), "core long, context long, place int, print long, copies long"
    )
    twice = (
        strings.groupBy("core", "print").agg(F.sum("copies").alias("total"))
        .filter("total > 1").select("core", "print")
    )
    # as spans of one string each; a context has at most `length` of them
    marks = (
        strings.join(twice, ["core", "print"]).groupBy("core", "context")
        .agg(F.collect_set("place").alias("places"))
    )
    bits = F.transform(
        F.sequence(F.lit(0), F.floor(F.array_max("places") / 8).cast("int")),
        lambda byte: F.aggregate(
            "places", F.lit(0),
            lambda s, p: s + F.when(
                F.floor(p / 8).cast("int") == byte, F.call_function("shiftleft", F.lit(1), 7 - p % 8)
            ).otherwise(0),
        ),
    )
    packed = F.unhex(F.array_join(F.transform(bits, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    return usual.union(marks.select("core", "context", packed.alias("bits")))


def without_repeats(
    documents: DataFrame, length: int = LENGTH, middle: int = MIDDLE, hot: int = HOT
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = documents.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("key"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    found = texts.select("key", "text").mapInArrow(_anchor_rows(length, middle), ANCHOR)
    cores = (
        found.groupBy("core")
        .agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("a"), F.max("context").alias("z"))
        .filter("n > 1").select("core", (F.col("a") != F.col("z")).alias("border"))
    )
    shared = found.join(cores.hint("merge"), "core")
    spot = F.struct("lo", "hi", "core", "context")
    per_text = shared.groupBy(F.col("key").alias("k")).agg(
        F.collect_set(F.when(~F.col("border"), F.struct("lo", "hi"))).alias("spans"),
        F.collect_set(F.when(F.col("border"), spot)).alias("borders"),
    )
    per_text = stored(per_text, "anchors")
    joined = texts.join(per_text.select("k", "spans", (F.size("borders") > 0).alias("open")),
                        texts["key"] == F.col("k"), "left")
    settled = stored(
        joined.select(
            "doc_id", "key", "text", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"),
            F.coalesce("open", F.lit(False)).alias("open"),
        ).mapInArrow(_settle(length), SETTLED),
        "settled",
    )
    results = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    waiting = settled.filter("open").select("doc_id", "key", "text", "lo", "hi")
    borders = per_text.filter(F.size("borders") > 0).select(F.col("k").alias("key"), "borders")
    contexts = stored(
        waiting.select("key", "text").join(borders, "key")
        .mapInArrow(_cut(length), "core long, context long, bytes binary")
        .groupBy("core", "context")
        .agg(F.min("bytes").alias("bytes"), F.count(F.lit(1)).alias("copies")),
        "contexts",
    )
    bits = _repeated_strings(contexts, length, hot)
    spots = borders.select("key", F.inline("borders"))
    marks = (
        spots.join(bits.hint("merge"), ["core", "context"]).groupBy(F.col("key").alias("k"))
        .agg(F.collect_list(F.struct("lo", "bits")).alias("marks"))
    )
    late = waiting.join(marks, waiting["key"] == marks["k"], "left").select(
        "doc_id", "text", "lo", "hi", "marks"
    ).mapInArrow(_finish(length), RESULT)
    return settled.filter("NOT open").select(*results).union(late)

"""Keys found in the data, when nobody names them.

A key is a column set that is unique and never NULL; a minimal one has no smaller key inside.  The
search goes level by level: sets of one column, of two, and so on.  Each level starts from names
and numbers alone and touches the data only for what is left:

1. a set with a key inside is no minimal key;
2. a set can tell apart no more rows than the product of the distinct counts of its parts, which
   come from sketches, all in one scan;
3. slices of the rows: rows equal in a set are equal in its column of most values, its anchor, so a
   slice by the hash of the anchor holds a set's duplicates together.  One scan takes the slices of
   all anchors, and only their rows are hashed set by set.  Sets that stand get larger slices, each
   about ``GROWTH`` times as large, up to one in ``LAST_SLICES``;
4. a full count of the hashes that several rows share.  None prove a key; where so few are shared
   that it may be chance (two rows may share a hash), the values of their rows are grouped.  Rows
   equal in a set are equal in its parts: where a part repeats in a few rows, only these are looked
   at for the sets around it.

So the full data is shuffled for sets that are keys or nearly so.  A level whose sets are many is
taken in chunks of ``AT_ONCE``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from math import log
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evenkeel.operators.metrics import key_candidates
from evenkeel.operators.projection import ColumnPair, quoted
from evenkeel.schema import schema
from evenkeel.sources.folders import new_folder

LONGEST, AT_ONCE = 3, 32
# sets counted in full at once: each puts a row per row into the shuffle
COUNTED_AT_ONCE = 8
SLICE_ROWS, MOST_SLICES, LAST_SLICES, GROWTH = 1024, 4096, 8, 16
# values of an anchor in a slice at least, and repeated hashes whose rows are looked up at most
SLICE_VALUES, FEW_REPEATS = 16, 1 << 13
SKETCH_ERROR = 0.02
# a sketch is trusted to this factor only (many times its standard error)
MARGIN = 1.25
KEYS_SCHEMA = schema("candidate string, n_columns int, row_count bigint")


@dataclass
class Level:
    """What became of the column sets of one size."""

    size: int
    sets: int = 0
    with_key_inside: int = 0
    too_few_values: int = 0
    refuted_by_slice: int = 0
    refuted_by_count: int = 0
    keys: int = 0


@dataclass
class KeySearch:
    """Minimal keys in the order of their size and columns, and the work that each level took."""

    row_count: int
    keys: list[tuple[str, ...]] = field(default_factory=list)
    levels: list[Level] = field(default_factory=list)


def _comparable(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.AtomicType) and not isinstance(dtype, T.VariantType)


def _hash(frame: DataFrame, names: Sequence[str]) -> Column:
    """Equal where the values are: both zeros of a float are one value."""
    floats = {f.name for f in frame.schema.fields if isinstance(f.dataType, T.FractionalType)
              and not isinstance(f.dataType, T.DecimalType)}
    return F.xxhash64(*[quoted(n) + F.lit(0.0) if n in floats else quoted(n) for n in names])


def _chunks(sets: list, size: int) -> Iterable[list]:
    return (sets[i : i + size] for i in range(0, len(sets), size))


def _sketched(frame: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], float]:
    """The most distinct values that each set has, by its sketch."""
    found = {}
    for some in _chunks(sets, AT_ONCE):
        row = frame.agg(*[
            F.approx_count_distinct(_hash(frame, s), SKETCH_ERROR).alias(f"c{i}")
            for i, s in enumerate(some)
        ]).first()
        found |= {s: n * MARGIN for s, n in zip(some, row)}
    return found


def _anchor(s: tuple[str, ...], known: dict[tuple[str, ...], float]) -> str:
    return max(s, key=lambda n: known[(n,)])


def _slices(anchor: str, known: dict[tuple[str, ...], float], wanted: int) -> int:
    """Into how many slices the rows go by the hash of ``anchor``: each should hold some values."""
    return max(1, min(wanted, int(known[(anchor,)] / MARGIN / SLICE_VALUES)))


def _tiers(slices: int) -> list[int]:
    """Numbers of slices, from ``slices`` to LAST_SLICES in equal ratios near GROWTH."""
    if slices <= LAST_SLICES:
        return [slices] if slices > 1 else []
    times = max(1, round(log(slices / LAST_SLICES, GROWTH)))
    return [round(slices * (LAST_SLICES / slices) ** (i / times)) for i in range(times + 1)]


def _sliced(
    frame: DataFrame, sets: list[tuple[str, ...]], known: dict[tuple[str, ...], float], wanted: int,
) -> dict[tuple[str, ...], tuple]:
    """Rows and distinct hashes of each set in the slice of its anchor."""
    inside = {
        a: F.pmod(_hash(frame, [a]), F.lit(_slices(a, known, wanted))) == 0
        for a in dict.fromkeys(_anchor(s, known) for s in sets)
    }
    if not inside:
        return {}
    taken = frame.select(*[quoted(n) for n in dict.fromkeys(n for s in sets for n in s)]).filter(
        reduce(or_, inside.values())
    )
    if len(sets) > AT_ONCE:
        taken = _stored(taken, "slices")
    return _hashes(taken, sets, [inside[_anchor(s, known)] for s in sets])


def _hashes(
    frame: DataFrame, sets: list[tuple[str, ...]], where: list[Column] | None = None
) -> dict[tuple[str, ...], tuple]:
    """Rows and distinct hashes of each set, of the rows that its ``where`` takes."""
    found = {}
    for some in _chunks(list(enumerate(sets)), AT_ONCE):
        each = [
            F.struct(
                F.lit(i).alias("i"),
                (F.when(where[i], _hash(frame, s)) if where else _hash(frame, s)).alias("h"),
            )
            for i, s in some
        ]
        rows = (
            frame.select(F.inline(F.array(*each))).filter(F.col("h").isNotNull())
            .groupBy("i", "h").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("i").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("hashes"))
        )
        seen = {r["i"]: (r["rows"], r["hashes"]) for r in rows.collect()}
        found |= {s: seen.get(i, (0, 0)) for i, s in some}
    return found


def _stored(frame: DataFrame, name: str) -> DataFrame:
    folder = new_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


@dataclass
class Repeats:
    """What a full count found of a set: hashes that several rows share, and rows beyond the first."""

    hashes: int
    surplus: int
    shared: DataFrame

    def rows(self, frame: DataFrame, s: tuple[str, ...], names: Iterable[str]) -> DataFrame:
        """All rows of ``frame`` whose hash of ``s`` is shared, stored."""
        return _stored(
            frame.select(*[quoted(n) for n in names]).withColumn("__h", _hash(frame, s))
            .join(self.shared, ["__h"], "left_semi").drop("__h"),
            "repeats",
        )


def _repeats(frame: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], Repeats]:
    """The hashes that rows share, of sets that are keys or nearly so.

    Nearly every hash is a group of its own, so rows are dealt out before they are grouped.
    """
    found = {}
    for some in _chunks(sets, COUNTED_AT_ONCE):
        each = [
            F.struct(F.lit(i).alias("i"), _hash(frame, s).alias("h")) for i, s in enumerate(some)
        ]
        shared = _stored(
            frame.select(F.inline(F.array(*each))).repartition("i", "h")
            .groupBy("i", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1),
            "shared",
        )
        counted = shared.groupBy("i").agg(
            F.count(F.lit(1)).alias("hashes"), F.sum(F.col("n") - 1).alias("surplus")
        )
        seen = {r["i"]: (r["hashes"], r["surplus"]) for r in counted.collect()}
        found |= {
            s: Repeats(*seen.get(i, (0, 0)),
                       shared.filter(F.col("i") == i).select(F.col("h").alias("__h")))
            for i, s in enumerate(some)
        }
    return found


def search_keys(
    frame: DataFrame, columns: Sequence[str] | None = None, longest: int = LONGEST,
    slice_rows: int = SLICE_ROWS,
) -> KeySearch:
    """Minimal keys of at most ``longest`` columns.  An empty table has none.

    Columns that hold NULL, and columns of nested types, are in no key.
    """
    fields = {f.name: f.dataType for f in frame.schema.fields}
    names = [n for n in columns or fields if _comparable(fields[n])]
    counted = frame.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(quoted(n).isNull()).alias(f"c{i}") for i, n in enumerate(names)],
    ).first()
    search = KeySearch(counted[0])
    slices = max(1, min(MOST_SLICES, search.row_count // slice_rows))
    names = [n for n, nulls in zip(names, counted[1:]) if nulls == 0]
    # upper bounds of the distinct values of sets
    known: dict[tuple[str, ...], float] = _sketched(frame, [(n,) for n in names])
    counts: dict[tuple[str, ...], Repeats] = {}
    for size in range(1, longest + 1):
        level = Level(size)
        search.levels.append(level)
        sets = list(combinations(names, size)) if search.row_count else []
        level.sets = len(sets)
        minimal = [s for s in sets if not any(set(k) <= set(s) for k in search.keys)]
        level.with_key_inside = len(sets) - len(minimal)
        known |= {s: _bound(s, known) for s in minimal if s not in known}
        able = [s for s in minimal if known[s] >= search.row_count]
        level.too_few_values = len(minimal) - len(able)
        alike, seen = able, {}
        for wanted in _tiers(slices):
            parts = {s: _slices(_anchor(s, known), known, wanted) for s in alike}
            due = [s for s in alike if 1 < parts[s] != seen.get(s)]
            seen |= parts
            refuted = {s for s, n in _sliced(frame, due, known, wanted).items() if not _may_be_key(*n)}
            alike = [s for s in alike if s not in refuted]
        level.refuted_by_slice = len(able) - len(alike)
        found = _keys_of(frame, alike, search.row_count, counts)
        level.refuted_by_count = len(alike) - len(found)
        level.keys = len(found)
        search.keys += sorted(found, key=sets.index)
    return search


def _keys_of(
    frame: DataFrame, sets: list[tuple[str, ...]], rows: int, counts: dict[tuple[str, ...], Repeats],
) -> list[tuple[str, ...]]:
    """Which sets are keys, counted in full; ``counts`` has the counted sets of smaller sizes."""
    few = {s: r for s, r in counts.items() if r.hashes <= FEW_REPEATS}
    part = {s: next((p for p in few if set(p) <= set(s)), None) for s in sets}
    found = []
    for p in dict.fromkeys(p for p in part.values() if p):
        around = [s for s in sets if part[s] == p]
        repeated = few[p].rows(frame, p, dict.fromkeys(n for s in around for n in s))
        found += [s for s, (n, hashes) in _hashes(repeated, around).items() if n == hashes]
    full = _repeats(frame, [s for s in sets if not part[s]])
    counts |= full
    for s, r in full.items():
        if r.surplus and _may_be_key(rows, rows - r.surplus):
            grouped = key_candidates(r.rows(frame, s, s), [s])
            r.surplus = 0 if grouped.first()["is_key"] else r.surplus
        if not r.surplus:
            found.append(s)
    return found


def _bound(s: tuple[str, ...], known: dict[tuple[str, ...], float]) -> float:
    """The most distinct values that a set can have: over all ways to split it in two known parts."""
    bounds = [
        known.get(part, float("inf")) * known.get(tuple(n for n in s if n not in part), float("inf"))
        for k in range(1, len(s) // 2 + 1)
        for part in combinations(s, k)
    ]
    return min(bounds)


def _may_be_key(rows: int, hashes: int) -> bool:
    """Are the missing hashes few enough to be chance?  ``rows`` hashes of 64 bits meet about
    rows^2 / 2^65 times; below 2^24 rows that is once in 10^5 searches, and not assumed."""
    return rows == hashes or rows - hashes <= (4 + rows * rows / 2**63 if rows >= 2**24 else 0)


def discover_keys(
    frame: DataFrame, columns: Sequence[str] | None = None, longest: int = LONGEST,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """candidate (names with commas), n_columns and row_count of the minimal keys."""
    found = search_keys(frame, columns, longest, slice_rows)
    rows = [(",".join(k), len(k), found.row_count) for k in found.keys]
    return frame.sparkSession.createDataFrame(rows, KEYS_SCHEMA)


def common_key(
    source: DataFrame, target: DataFrame, pairs: Iterable[ColumnPair], longest: int = LONGEST,
) -> list[str]:
    """Source names of the smallest paired columns that are a key on both sides; [] without one.

    Only the source is searched; the target confirms its keys, smallest first.
    """
    theirs = {p.source: p.target for p in pairs}
    for key in search_keys(source, list(theirs), longest).keys:
        names = [theirs[n] for n in key]
        if key_candidates(target, [names]).first()["is_key"]:
            return list(key)
    return []

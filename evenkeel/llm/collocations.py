"""Collocations by partitioned mining: shards at lowered support, union, one exact count.

A phrase that occurs `least` times in a language occurs in some shard at least `least` times the shard's
share of the language's words.  So documents are dealt into `SHARDS` shards by hash, and each shard
is mined completely at that local support: its words, then pairs of words that are both frequent in the
shard, then longer phrases all of whose pairs are.  Tasks count what they read and a shuffle adds up;
no task holds a shard, so a few shards do, and the local support stays well above one.  The union of
what is frequent somewhere is the candidate set, but for phrases whose local counts, with one less than
the support in every other shard, cannot add up to `least`.  A last scan counts all candidates in all
documents exactly, by their texts.  Each of its tasks hands on a row for every candidate that it has met,
so it has no more tasks than keep the cluster busy, however many splits the input has.

What a scan has to know of the level before travels as a bitmap of hashed phrases, `BITS` bits
whatever the size of the input, put together by Spark's bitmap aggregates.  Hashes (52 bits)
and bitmap clashes only add phrases to mining; the final counts are of texts, so nothing is lost and
nothing is miscounted.

Texts are lower-cased (A-Z) and cut at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words
`[^\\x20\\x09]+`; phrases do not cross pieces.  A null text is empty, a null language is `und`.  Rows
that repeat are counted each for itself.  Equal scores are ordered by count, then by phrase.  An empty
table gives an empty result; other columns (and doc_ids but for the choice of a shard) are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evenkeel.llm.common import small_batches, stored
from evenkeel.llm.textkeys import Powers, mix, prefix_sums, slices, string_hash, text_bytes, words

LEAST, LONGEST, SHARDS, TOP = 100, 5, 4, 2000
BITS = 27
BATCH_BYTES = 1 << 22  # of texts handed to Python at a time; the JVM holds a batch several times over
SLICE_BYTES, SLICE_DOCUMENTS = 1 << 18, 4096
HELD = 1_000_000  # counts that a task holds before it hands them on
ROUNDS = 2  # tasks of the last scan for each core, where the input has as many splits
_SHARD = 0x5851F42D4C95  # sets the bits of a phrase in one shard apart from those in another
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HASHED = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Slice:
    """The words of some texts, what language each belongs to, and how far its piece goes on."""

    def __init__(self, raw: np.ndarray, begins: np.ndarray) -> None:
        self.raw = _LOWER[raw]
        self.first, self.last, at = words(self.raw, begins, _GAP)
        n = len(self.first)
        self.doc = np.repeat(np.arange(len(begins) - 1), np.diff(at))
        cuts = np.cumsum(_BREAK[self.raw], dtype=np.int32)
        piece = cuts[self.first] if n else np.zeros(0, dtype=np.int32)
        border = np.flatnonzero(
            (np.diff(piece, append=-1) != 0) | (np.diff(self.doc, append=-1) != 0)
        )
        # words from here to the end of the piece
        self.left = border[np.searchsorted(border, np.arange(n))] - np.arange(n) + 1

    def grams(self, powers: Powers, language: np.ndarray) -> Iterator[np.ndarray]:
        """The hashes of the phrases of 1, 2, ... words that begin at each word (of no meaning where
        the piece ends before); the language takes part."""
        sums = prefix_sums(self.raw, powers, _HASHED)
        word = string_hash(sums, powers, self.first, self.last)
        with np.errstate(over="ignore"):
            gram = mix(word + language[self.doc].view(np.uint64))
            yield gram
            while True:
                word = np.append(word[1:], np.uint64(0))
                gram = mix(gram * np.uint64(3) + word)
                yield gram


def _set(bits: np.ndarray, gram: np.ndarray, shard: np.ndarray | int = 0) -> np.ndarray:
    spot = ((gram >> np.uint64(12)).view(np.int64) ^ (shard * _SHARD)) & (8 * len(bits) - 1)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def _some(begins: np.ndarray) -> Iterator[tuple[int, int]]:
    for i, j in slices(begins, SLICE_BYTES):
        yield from ((a, min(j, a + SLICE_DOCUMENTS)) for a in range(i, j, SLICE_DOCUMENTS))


class Counts:
    """Counts of phrases by shard and language.  A phrase's 52 bits and a number for its shard and
    language make one key, so that sorting keys is all there is to do."""

    def __init__(self) -> None:
        self.groups: dict[tuple[int, int], int] = {}
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def room(self, groups: set[tuple[int, int]]) -> bool:
        return len(groups - self.groups.keys()) + len(self.groups) <= SLICE_DOCUMENTS

    def numbers(self, groups: list[tuple[int, int]]) -> np.ndarray:
        return np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], dtype=np.uint64)

    def add(self, gram: np.ndarray, group: np.ndarray) -> None:
        keys = np.sort(gram & np.uint64(0xFFFFFFFFFFFFF000) | group)
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
        self.keys.append(keys[new])
        self.counts.append(np.diff(np.append(new, len(keys))))
        self.held += len(new)

    def summed(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.keys, self.counts = [keys[new]], [np.add.reduceat(counts[order], new)]
        self.held = len(new)

    def handed_on(self) -> Iterator[pa.RecordBatch]:
        """All counts as rows shard, language, gram, n; nothing is held any more."""
        if self.held:
            self.summed()
            keys, counts = self.keys[0], self.counts[0]
            group = np.array(list(self.groups), dtype=np.int64)
            for i in range(0, len(keys), 1 << 16):
                part = slice(i, i + (1 << 16))
                own = group[(keys[part] & np.uint64(0xFFF)).astype(np.int64)]
                gram = (keys[part] >> np.uint64(12)).astype(np.int64)
                columns = [own[:, 0], own[:, 1], gram, counts[part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _LEVEL)
        self.__init__()


_LEVEL = ["shard", "language", "gram", "n"]
WORDS, PAIRS, LONGER = 1, 2, 3


def _mine(level: int, longest: int, shared):
    """Rows shard, language, gram, n: of words (and rows without a gram that count all words), of pairs
    of frequent words, or of longer phrases of frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, counts = Powers(), Counts()
        bits = np.frombuffer(shared.value, dtype=np.uint8) if shared else None
        for batch in batches:
            raw_all, begins_all = text_bytes(batch.column(2))
            shards, languages = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in _some(begins_all):
                pairs = list(zip(shards[i:j].tolist(), languages[i:j].tolist()))
                if counts.held > HELD:
                    counts.summed()
                if counts.held > HELD // 2 or not counts.room(set(pairs)):
                    yield from counts.handed_on()
                begins = begins_all[i : j + 1] - begins_all[i]
                part = Slice(raw_all[begins_all[i] : begins_all[j]], begins)
                group, shard = counts.numbers(pairs)[part.doc], shards[i:j].astype(np.int64)[part.doc]
                grams = part.grams(powers, languages[i:j])
                if level == WORDS:
                    counts.add(next(grams), group)
                    own, n = np.unique(group, return_counts=True)
                    named = np.array(list(counts.groups), dtype=np.int64).reshape(-1, 2)[own.astype(np.int64)]
                    columns = [named[:, 0], named[:, 1], pa.nulls(len(own), pa.int64()), n]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _LEVEL)
                    continue
                word = next(grams)
                if level == PAIRS:
                    good = _set(bits, word, shard)
                    here = np.flatnonzero(good & np.append(good[1:], False) & (part.left > 1))
                    counts.add(next(grams)[here], group[here])
                    continue
                pair = _set(bits, next(grams), shard) & (part.left > 1)
                here = np.flatnonzero(pair)
                for m in range(3, longest + 1):
                    here = here[np.append(pair, np.zeros(longest, dtype=bool))[here + m - 2]]
                    counts.add(next(grams)[here], group[here])
        yield from counts.handed_on()

    return run


def _texts(part: Slice, begin: np.ndarray, m: int) -> pa.Array:
    """The phrases of m words that begin at these words, joined by one space."""
    length = part.last - part.first + 1
    ends = np.append(0, np.cumsum(length))
    spaced = np.full(int(ends[-1]), 0x20, dtype=np.uint8)
    solid = np.ones(len(spaced), dtype=bool)
    solid[ends[1:] - 1] = False
    mark = np.zeros(len(part.raw) + 1, dtype=np.int8)
    mark[part.first] += 1
    mark[part.last] -= 1
    spaced[solid] = part.raw[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    n = ends[begin + m] - 1 - ends[begin]
    offsets = np.append(0, np.cumsum(n))
    place = np.repeat(ends[begin] - offsets[:-1], n) + np.arange(int(offsets[-1]))
    return pa.Array.from_buffers(
        pa.string(), len(begin),
        [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(spaced[place])],
    )


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct key stands first, the number of each key, how often each occurs."""
    order = np.argsort(keys, kind="stable")
    new = np.append(True, np.diff(keys[order]) != 0)
    which = np.empty(len(keys), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order[first], which, np.diff(np.append(first, len(keys)))


def _word_numbers(part: Slice) -> np.ndarray:
    """A number per word, equal where the words are."""
    array = _texts(part, np.arange(len(part.first)), 1)
    return array.dictionary_encode().indices.to_numpy().astype(np.int64)


class Texts:
    """Counts of phrases by their texts, added up before a task hands them on."""

    names = ["lang", "n_words", "phrase", "n"]

    def __init__(self) -> None:
        self.parts: list[pa.Table] = []
        self.held = self.summed = 0  # counts in all parts, and those that have been added up already

    def add(self, lang: pa.Array, m: int, phrase: pa.Array, n: np.ndarray) -> None:
        columns = [lang, pa.array(np.full(len(n), m, dtype=np.int32)), phrase, pa.array(n, pa.int64())]
        self.parts.append(pa.Table.from_arrays(columns, self.names))
        self.held += len(n)

    def handed_on(self, most: int) -> Iterator[pa.RecordBatch]:
        """Adds up when a quarter of `most` has come since; nothing while half of it or less is left then."""
        if not self.held or most and self.held - self.summed <= most // 4:
            return
        whole = pa.concat_tables(self.parts).group_by(self.names[:3], use_threads=False).aggregate([("n", "sum")])
        whole = whole.rename_columns(self.names)
        self.parts, self.held, self.summed = [whole], len(whole), len(whole)
        if self.held > most // 2:
            yield from whole.to_batches(max_chunksize=1 << 16)
            self.parts, self.held, self.summed = [], 0, 0


def _exact(longest: int, shared):
    """Rows lang, n_words, phrase, n of all candidates, and the number of words (n_words 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits, counts = Powers(), np.frombuffer(shared.value, dtype=np.uint8), Texts()
        for batch in batches:
            raw_all, begins_all = text_bytes(batch.column(2))
            languages = batch.column(1).to_numpy(zero_copy_only=False)
            named = batch.column(0).dictionary_encode()
            lang = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in _some(begins_all):
                begins = begins_all[i : j + 1] - begins_all[i]
                part = Slice(raw_all[begins_all[i] : begins_all[j]], begins)
                if not len(part.doc):
                    continue
                own = lang[i:j][part.doc]
                count = np.bincount(own)
                some = np.flatnonzero(count)
                counts.add(named.dictionary.take(pa.array(some)), 0, pa.array([""] * len(some)), count[some])
                number = _word_numbers(part)
                size = int(number.max()) + 1
                grams = part.grams(powers, languages[i:j])
                # the exact number of the phrase that begins at each word, -1 where it is no candidate
                phrase = own * size + number
                here = np.arange(len(phrase))
                for m in range(1, longest + 1):
                    here = here[_set(bits, next(grams)[here])]
                    if not len(here):
                        break
                    one, which, n = _distinct(phrase[here])
                    langs = named.dictionary.take(pa.array(own[here[one]]))
                    counts.add(langs, m, _texts(part, here[one], m), n)
                    longer = np.full(len(phrase) + 1, -1, dtype=np.int64)
                    longer[here] = which
                    go_on = (part.left[here] > m) & (longer[here + 1] >= 0)
                    here = here[go_on]
                    phrase = np.full(len(phrase), -1, dtype=np.int64)
                    phrase[here] = longer[here] * size + number[here + m]
                yield from counts.handed_on(HELD)
        yield from counts.handed_on(0)

    return run


def _bitmap(spots: DataFrame, bits: int):
    """Broadcast bitmap of the numbers in `spot` (0 to 2^bits - 1); its size does not grow."""
    blocks = (
        spots.select((F.col("spot") + 1).alias("spot"))
        .groupBy(F.bitmap_bucket_number("spot").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    )
    whole = bytearray(1 << (bits - 3))
    for block, part in blocks.collect():
        whole[(block - 1) * 4096 : block * 4096] = part
    return spots.sparkSession.sparkContext.broadcast(bytes(whole))


def phrase_counts(
    documents: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, bits: int = BITS,
) -> DataFrame:
    """lang, n_words, phrase, n: all phrases of up to `longest` words with n >= least, counted exactly;
    the row with n_words 0 counts the words of the language."""
    mask = F.lit((1 << bits) - 1)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    dealt = documents.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"),
        F.xxhash64(lang).alias("language"),
        "text",
    )
    support = before = None
    levels = []
    for level in (WORDS, PAIRS, LONGER)[: min(longest, 3)]:
        counted = (
            dealt.mapInArrow(
                _mine(level, longest, before), "shard long, language long, gram long, n long"
            )
            .groupBy("shard", "language", "gram")
            .agg(F.sum("n").alias("n"))
        )
        if level == WORDS:
            counted = stored(counted, "words")
            words_of = counted.filter("gram IS NULL")
            all_words = words_of.groupBy("language").agg(F.sum("n").alias("all"))
            support = stored(
                words_of.join(all_words, "language").select(
                    "shard", "language", F.expr(f"({least} * n + all - 1) div all").alias("support")
                ),
                "support",
            )
            counted = counted.filter("gram IS NOT NULL")
        frequent = counted.join(support, ["shard", "language"]).filter("n >= support")
        levels.append(stored(frequent, f"level{level}"))
        spot = F.col("gram").bitwiseXOR(F.col("shard") * F.lit(_SHARD)).bitwiseAND(mask)
        before = _bitmap(levels[-1].select(spot.alias("spot")), bits)
    union = levels[0]
    for level in levels[1:]:
        union = union.union(level)
    elsewhere = support.groupBy("language").agg(F.sum(F.col("support") - 1).alias("elsewhere"))
    able = (
        union.groupBy("language", "gram").agg(F.sum(F.col("n") - F.col("support") + 1).alias("more"))
        .join(elsewhere, "language").filter(F.col("more") + F.col("elsewhere") >= least)
    )
    candidates = _bitmap(able.select(F.col("gram").bitwiseAND(mask).alias("spot")), bits)
    return (
        documents.select(lang.alias("lang"), F.xxhash64(lang).alias("language"), "text")
        .coalesce(ROUNDS * documents.sparkSession.sparkContext.defaultParallelism)
        .mapInArrow(_exact(longest, candidates), "lang string, n_words int, phrase string, n long")
        .groupBy("lang", "n_words", "phrase")
        .agg(F.sum("n").alias("n"))
        .filter((F.col("n") >= least) | (F.col("n_words") == 0))
    )


def collocations(
    documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, **options,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    a: how often the phrase occurs; n: words of the language.  The phrase is cut where floor(1000 a n /
    (l r)) is least (l, r: how often the parts occur; the earliest cut on ties).  Phrases that
    occur only within a longer one are left out.
    """
    with small_batches(documents.sparkSession, BATCH_BYTES):
        counts = stored(phrase_counts(documents, least, longest, **options), "phrases")
    phrases = counts.filter("n_words > 1")
    # a phrase is no more frequent than its parts, so a longer one that is as frequent shows in the
    # phrase longer by one word
    parts = phrases.filter("n_words > 2").select(
        "lang", "n", F.explode(F.array(
            F.expr("substring_index(phrase, ' ', n_words - 1)"),
            F.expr("substring_index(phrase, ' ', 1 - n_words)"),
        )).alias("phrase"),
    )
    within = parts.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    own = (
        phrases.join(within, ["lang", "phrase"], "left")
        .filter("longer IS NULL OR longer < n")
        .join(counts.filter("n_words = 0").select("lang", F.col("n").alias("words")), "lang")
        .select("lang", "phrase", F.col("n").alias("a"), F.col("words").alias("n"),
                F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"), "n_words")
        .withColumn("left_part", F.expr("substring_index(phrase, ' ', k)"))
        .withColumn("right_part", F.expr("substring_index(phrase, ' ', k - n_words)"))
    )
    left = counts.select("lang", F.col("phrase").alias("left_part"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right_part"), F.col("n").alias("r"))
    scored = (
        own.join(left, ["lang", "left_part"])
        .join(right, ["lang", "right_part"])
        .withColumn("score", F.expr(
            "(cast(a AS decimal(19,0)) * cast(n AS decimal(15,0)) * 1000)"
            " div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"
        ))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )

"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evenkeel.llm import collocations as c
from evenkeel.llm.common import small_batches

SCHEMA = "doc_id long, text string, lang string, n long, shard string"
LOWER = {i: i + 32 for i in range(65, 91)}


def _plain(rows, least, longest, top):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {q[i:j] for q, a in often.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1)
                if j - i < len(q) and a >= often[q[i:j]]}
        scored = []
        for p, a in often.items():
            if p not in gone:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def _rows(seed):
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcdeABé") * rng.randint(1, 2) + rng.choice(["", "x", "\x1c", "ß"]) for _ in range(14)]
    fixed = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 7))) for _ in range(6)]
    rows = []
    for i in range(150):
        bits = [rng.choice(fixed + vocabulary) for _ in range(rng.randint(0, 60))]
        text = "".join(b + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for b in bits)
        rows.append((i % 140 or None, text, rng.choice(["en", "en", "fr", None, "und"]), 1, "x"))
    rows += [(200, None, "en", 1, None), (201, "", "leer", 1, None), (202, " . ", "leer", 1, None)]
    rows += [rows[7]] * 30  # copies
    rows += [(300, "ha " * 5000, "ha", 1, None), (301, ("q w e r t z . " * 900), "en", 1, None)]
    return rows


@pytest.mark.parametrize("seed, bits, shards", [(0, 27, 4), (1, 16, 5), (2, 20, 1)])
def test_as_plain_counting(spark, seed, bits, shards):
    rows = _rows(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = c.collocations(docs, least=20, top=40, bits=bits, shards=shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == _plain(rows, 20, 5, 40)


def test_a_phrase_in_one_shard_only_is_found(spark):
    """All occurrences in one document, hence in one shard; and one spread over all of them."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(200)) + " here there.",
             "en", 1, "") for i in range(100)]
    rows.append((1000, "only once. " * 100, "en", 1, ""))
    got = c.phrase_counts(spark.createDataFrame(rows, SCHEMA), least=100).filter("n_words = 2").collect()
    assert {(r["phrase"], r["n"]) for r in got} == {("only once", 100), ("here there", 100)}


def test_products_beyond_64_bits(spark, monkeypatch):
    counts = [("en", 0, "", 9_000_000_000_000), ("en", 1, "a", 3_000_000_019), ("en", 1, "b", 7_000_000_001),
              ("en", 2, "a b", 2_999_999_999)]
    table = spark.createDataFrame(counts, "lang string, n_words int, phrase string, n long")
    monkeypatch.setattr(c, "phrase_counts", lambda *_, **__: table)
    row = c.collocations(table).collect()[0]
    assert row["score"] == 1000 * 2_999_999_999 * 9_000_000_000_000 // (3_000_000_019 * 7_000_000_001)


def test_bitmap_places(spark):
    spots = sorted(random.Random(5).sample(range(1 << 18), 3000)) + [0, (1 << 18) - 1]
    shared = c._bitmap(spark.createDataFrame([(s,) for s in spots], "spot long"), 18)
    bits = np.frombuffer(shared.value, dtype=np.uint8)
    every = np.arange(1 << 18, dtype=np.int64)
    assert set(np.flatnonzero(c._set(bits, (every << 12).view(np.uint64)))) == set(spots)


def test_empty_table(spark):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_more_splits_hand_on_no_more_counts(spark, monkeypatch):
    """Every split holds every phrase; rows of the last scan follow the cores, not the splits."""
    handed, exact = spark.sparkContext.accumulator(0), c._exact

    def watched(*args):
        run = exact(*args)

        def watched_run(batches):
            for batch in run(batches):
                handed.add(batch.num_rows)
                yield batch

        return watched_run

    monkeypatch.setattr(c, "_exact", watched)
    docs = spark.range(320).repartition(160).selectExpr(
        "id AS doc_id", "'one two three. four five' AS text", "'en' AS lang"
    )
    got = c.phrase_counts(docs, least=100).collect()
    assert len(got) == 10 and {r["n"] for r in got} == {320, 5 * 320}
    assert 0 < handed.value <= 2 * spark.sparkContext.defaultParallelism * len(got)


@pytest.mark.parametrize("scan", ["_mine", "_exact"])
def test_python_gets_texts_in_small_batches(spark, monkeypatch, scan):
    """One split of 16 MB of texts in fewer rows than Spark puts into a batch; the session's setting stays."""
    limit, made = "spark.sql.execution.arrow.maxBytesPerBatch", getattr(c, scan)
    batches, large = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def watched(*args):
        run = made(*args)

        def watched_run(given):
            def seen():
                for batch in given:
                    batches.add(1)
                    large.add(int(batch.nbytes > 6 << 20))
                    yield batch

            yield from run(seen())

        return watched_run

    monkeypatch.setattr(c, scan, watched)
    before = spark.conf.get(limit)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('one two. ', 450) AS text", "'en' AS lang")
    assert [r["a"] for r in c.collocations(docs).collect()] == [450 * 4000]
    assert batches.value >= 4 and large.value == 0
    assert spark.conf.get(limit) == before


def test_a_limit_of_the_session_stays(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(limit, "1m")
    try:
        with small_batches(spark, 1 << 22):
            assert spark.conf.get(limit) == "1m"
        assert spark.conf.get(limit) == "1m"
    finally:
        spark.conf.unset(limit)


def test_equal_counts_are_added_up_early():
    """Slices that repeat the same phrases: a task holds them once and a quarter of its limit."""
    counts, handed, held = c.Texts(), [], 0
    phrases = pa.array([f"a {i}" for i in range(100)])
    for _ in range(200):
        counts.add(pa.array(["en"] * 100), 2, phrases, np.full(100, 3))
        held = max(held, counts.held)
        handed += counts.handed_on(4000)
    assert not handed and held <= 100 + 1000 + 100
    handed += counts.handed_on(0)
    rows = pa.Table.from_batches(handed).to_pylist()
    assert len(rows) == 100 and {r["n"] for r in rows} == {600} and counts.held == 0
    assert list(counts.handed_on(0)) == []

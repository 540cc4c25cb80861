"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from evenkeel.llm import queries, word_runs

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def _runs(w):
    """All runs by definition: every lag, every stretch of equal words, smallest period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)  # the smallest lag comes first
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def _collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def _text(rng, n, letters):
    out = []
    while len(out) < n:
        piece = [rng.choice(letters) for _ in range(rng.randint(1, 7))]
        out += piece * rng.choice([1, 1, 2, 3, 4, 5, 9])
        if rng.random() < 0.3:
            out.append(str(rng.random()))
    return rng.choice([" ", "  ", "\t", " \n"]).join(out[:n])


@pytest.mark.parametrize("seed", range(3))
def test_runs_agree_with_every_lag(spark, seed):
    rng = random.Random(seed)
    texts = [_text(rng, rng.choice([0, 3, 6, 24, 90, 300]), "abcdefgh"[: rng.randint(1, 8)])
             for _ in range(150)]
    texts += [None, "", " \n", "a", "a " * 5, "a " * 6, "é x b " * 4, "A a " * 4, texts[5],
              "a b " * 9, ("a b " * 4 + "c ") * 5, "a b a b a b a b a b b b b b b b"]
    rows = [(i % 157 if i else None, t, 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(3)
    got = word_runs.collapse_runs(docs).collect()
    want = []
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        runs = _runs(w)
        want.append((i, len(w), str(runs), _collapsed(w, runs)))
    mine = [(r[0], r[1], str([tuple(x) for x in r[2]]), r[3]) for r in got]
    order = lambda r: (str(r[0]), *r[1:])
    assert sorted(mine, key=order) == sorted(want, key=order)


def test_report_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op11_word_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    n_long = 0
    for i, text in docs:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k if k < a else a + (k - a) % p] for k in range(n)]
        if n > 3000:
            n_long += 1
            continue  # the plain loop is quadratic
        runs = _runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        r = got[i]
        assert (r["n_words"], r["n_runs"]) == (n, len(runs))
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        listing = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(listing.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(_collapsed(w, runs).encode()).hexdigest()
    assert n_long < len(docs) / 10


def test_very_long_texts(spark):
    block = [f"w{i}" for i in range(50_000)]
    rows = [(1, "ha " * 300_000), (2, " ".join(block * 5 + ["end"])), (3, "x" * 1_000_000),
            (4, " ".join(str(i % 997) for i in range(200_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: r for r in word_runs.collapse_runs(docs).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 300_000, 1)] and got[1]["collapsed"] == "ha"
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 250_000, 50_000)]
    assert got[2]["collapsed"] == " ".join([*block, "end"])
    assert got[3]["runs"] == [] and got[3]["collapsed"] == "x" * 1_000_000
    assert [tuple(x) for x in got[4]["runs"]] == [(0, 200_000, 997)]


def test_splitting_that_peels_word_by_word():
    """Each round frees the next word only; the limit on rounds does not change the result."""
    w = [0] * 8
    for i in range(1, 400):
        w += [i, i - 1, i, i - 1, i, i + 1, i]
    ids = np.array(w, dtype=np.int64)
    found = word_runs.find_runs(ids, np.zeros(len(ids), dtype=np.int64))
    assert [tuple(r) for r in found.tolist()] == _runs(w)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert word_runs.run_report(docs).collect() == []

"""Decontamination against full alignment of every window, and its memory on repetitive texts."""

import random
import subprocess
import sys

import numpy as np
import pytest

from evenkeel.llm import qgram_leaks as q
from evenkeel.llm.textkeys import Powers

BENCH = "item_id long, text string"
DOCS = "doc_id long, text string"


def _edits(window, text):
    """Fewest edits of a window against any stretch of the text (full table, no band)."""
    window, text = (np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in (window, text))
    row = np.zeros(len(text) + 1, dtype=np.int64)
    ramp = np.arange(len(text) + 1)
    for i, c in enumerate(window, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


def _plain(items, docs, window, stride, shortest):
    """(doc, item) -> windows found, fewest edits."""
    found = {}
    for item, text in items:
        t = q.normal(text)
        if len(t) < shortest:
            continue
        starts = [0] if len(t) <= window else [*range(0, len(t) - window, stride), len(t) - window]
        for w in {t[s : s + window] for s in starts}:
            for doc, other in docs:
                e = _edits(w, q.normal(other))
                if e <= q.budget(len(w))[0]:
                    n, best = found.get((doc, item), (0, 99))
                    found[doc, item] = n + 1, min(best, e)
    return found


def _sentence(rng, n, letters="abcdehinost"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize("seed, window, stride", [(0, 64, 16), (1, 80, 40), (2, 40, 8)])
def test_as_full_alignment(spark, monkeypatch, seed, window, stride):
    rng = random.Random(seed)
    items = [(i, _sentence(rng, rng.randint(4, 40))) for i in range(12)]
    items += [(20, "ha " * 60), (21, "ha " * 63), (22, items[0][1].upper()), (23, "0 " * 40 + "1"),
              (24, None), (25, "few words"), (26, items[1][1] + " " + items[2][1])]
    docs = []
    for d in range(60):
        text = _sentence(rng, rng.randint(0, 40))
        if d % 2:
            t = rng.choice([x for _, x in items if x])
            a = rng.randrange(max(1, len(t) - 60))
            t = t[a : a + rng.randint(30, 200)]
            for _ in range(rng.randint(0, max(1, len(t) // 9))):
                at = rng.randrange(max(1, len(t)))
                t = t[:at] + rng.choice(["q", "", "zz", " "]) + t[at + 1 :]
            at = rng.randint(0, len(text))
            text = text[:at] + " " + t + " " + text[at:]
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, "ha " * 300), (103, "0 " * 500), (104, "h a" * 90)]
    # short segments and few pairs: everything is cut and halved, nothing may be lost
    monkeypatch.setattr(q, "SEGMENT_CHARS", 10 * window)
    monkeypatch.setattr(q, "MOST", 3000)
    bench, table = spark.createDataFrame(items, BENCH), spark.createDataFrame(docs, DOCS)
    got = q.leaks(table, bench, window=window, stride=stride).collect()
    want = _plain(items, docs, window, stride, q.SHORTEST)
    assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["min_edits"]) for r in got} == want
    assert len(got) == len(want)


def test_every_excerpt_of_79_characters_is_found(spark):
    rng = random.Random(9)
    item = _sentence(rng, 80)
    whole = q.normal(item)
    docs = [(i, f"{_sentence(rng, 9)} {whole[i : i + 79].strip()}, {_sentence(rng, 9)}")
            for i in range(len(whole) - 79) if whole[i] != " " and whole[i + 78] != " "]
    got = q.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], BENCH)).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in docs}


def test_segments_of_a_long_text():
    """An item anywhere in a text of several segments is found, at its place."""
    rng = random.Random(4)
    item = _sentence(rng, 30)
    index = q.Index([("k", item)], 64, 16, 24)
    filler = q.normal(_sentence(rng, 30_000, "uvwxyz"))
    for at in [0, *range(q.SEGMENT_CHARS - 400, q.SEGMENT_CHARS + 400, 61), len(filler)]:
        text = filler[:at] + " " + q.normal(item) + " " + filler[at:]
        codes, begins = q.normal_codes(["", text, "x"])
        rows = index.occurrences(codes, begins, Powers())
        assert sorted(rows[:, 1]) == list(range(len(index.start))) and set(rows[:, 2]) == {0}
        assert set(rows[:, 0]) == {1} and abs(rows[:, 3].min() - at) <= 20


def test_memory_on_repetitive_text():
    code = """
import resource, sys
from evenkeel.llm import qgram_leaks as q
from evenkeel.llm.textkeys import Powers
items = [(str(i), "ha " * (100 + i) + "%d" % i) for i in range(20)] + [("a", "a" * 300), ("0", "0 " * 200)]
index = q.Index(items, q.WINDOW, q.STRIDE, q.SHORTEST)
for text in ("ha " * 333_334, "a" * 1_000_000, "0 " * 500_000):
    rows = index.occurrences(*q.normal_codes([text]), Powers())
    assert len(rows) and (rows[:, 2] == 0).any()
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 1000

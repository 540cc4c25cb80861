"""Line rules, near-duplicates, decontamination and repeats against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from evenkeel.llm import chosen_path, line_quality, qgram_leaks, suffix_levels

WORD = re.compile("[^\x20\x09-\x0d]+")
ASCII = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, source string"


# --- line frequency ------------------------------------------------------------------------------

def _base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def test_line_rules(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 500)) for _ in range(n))
    rows = [(i, f"{prose(60)}\nSubscribe  to our {i % 10} letters\n{prose(9)}", "h") for i in range(30)]
    rows += [(100 + i, "\n".join(["subscribe to our 5 letters"] * 11), "h") for i in range(2)]
    rows += [(200, None, None), (201, "", "h"), (202, "a b c " * 40, "h"), (203, "\t\x0b\n \n", "h"),
             (204, "é # x\n" * 3 + prose(80), None), (205, prose(30_000), "z")]
    rows += [(300, rows[0][1], "h")] * 3  # repeated rows
    copy = "\n".join(prose(9) for _ in range(8))
    rows += [(400 + i, copy, "copies") for i in range(40)]  # copies are one document
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("clash"))
    got = line_quality.line_verdicts(docs).select(
        "doc.doc_id", "doc.text", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "removed_words", "base_failed", "kept",
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        base = _base(r["text"])
        assert tuple(r[2:7]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
    by = {r["doc_id"]: r for r in got}
    assert by[3]["removed_words"] == 5 and by[3]["kept"]
    assert by[100]["removed_words"] == 55
    assert by[300]["removed_words"] == 5 and by[400]["removed_words"] == 0 and by[400]["kept"]
    assert not by[200]["kept"] and not by[202]["kept"]
    kept = line_quality.keep_documents(docs)
    assert kept.columns == docs.columns and {r["kept"] for r in kept.collect()} == {"clash"}


def test_depleted_documents_go(spark):
    shared = [" ".join(f"s{k}_{j}" for j in range(10)) for k in range(6)]
    rng = random.Random(2)
    rows = []
    for i in range(40):
        own = " ".join(f"o{rng.random()}" for _ in range(60 if i % 2 else 5))
        rows.append((i, "\n".join([*rng.sample(shared, 6), own]), "h"))
    kept = {r["doc_id"] for r in line_quality.keep_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {i for i in range(40) if i % 2}
    assert line_quality.keep_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_that_share_the_smallest_line_hash_count_apart(spark):
    low = min((f"footer {k} of all" for k in "abcdefghij"), key=lambda x: hashlib.md5(x.encode()).hexdigest())
    rng, rows = random.Random(3), []
    while len(rows) < 40:
        own = " ".join(f"o{rng.random()}" for _ in range(60))
        plain = re.sub("[1-9]", "0", own)
        if hashlib.md5(plain.encode()).hexdigest() > hashlib.md5(low.encode()).hexdigest():
            rows.append((len(rows), f"{own}\n{low}", "h"))
    got = line_quality.line_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["removed_words"] for r in got} == {4}


# --- near-duplicates -----------------------------------------------------------------------------

def _shingles(text):
    w = WORD.findall((text or "").translate(ASCII))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _components(rows):
    sets = {i: _shingles(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def _copies(rng, n):
    words = [f"w{k}" for k in range(400)]
    rows, at = [], 0
    for group in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 45))):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((at, " ".join(w), "s"))
            at += 1
    return rows


@pytest.mark.parametrize("small", [1024, 4])
def test_near_duplicates_equal_brute_force(spark, small):
    rows = _copies(random.Random(5), 25)
    rows += [(9000, None, "s"), (9001, "", "s"), (9002, " \n", "s"), (9003, "ONE two", "s"),
             (9004, "one\tTWO", "s"), (9005, " ".join(f"v{k}" for k in range(40_000)), "s"),
             (9006, "a " * 300, "s"), (9007, "A a " * 100, "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash"))
    want = _components(rows)
    got = chosen_path.near_duplicates(docs, small=small).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_keep_one_of_each(spark):
    rows = [(1, "a b c d e f g", "s"), (2, "A b c d e f g", "s"), (2, "A b c d e f g", "s"),
            (None, "a b c d e f g", "s"), (3, "other words than those here", "s"), (4, None, "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit(1))
    kept = chosen_path.keep_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    assert chosen_path.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_and_repeated_ids_are_compared_by_text(spark):
    rng = random.Random(11)
    text = [[f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(6)]
    near = [*text[0][:50], "other", *text[0][51:]]
    rows = [(None, " ".join(t), "s") for t in text] + [(None, " ".join(near), "s")]
    rows += [(None, " ".join(text[1]), "s"), (None, None, "s"), (None, "", "s")]
    rows += [(-7, f"{' '.join(text[2])} {k}" if k else "first of its id", "s") for k in range(3)]
    rows += [(8, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50)), "s") for _ in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [(r["doc_id"], r["text"]) for r in chosen_path.keep_documents(docs).collect()]
    null = [t for i, t in kept if i is None]
    assert sorted(t or "" for t in null if not t) == ["", ""] and len(null) == 7
    assert {" ".join(t) for t in (text[1], text[3], text[4], text[5])} < set(null)
    assert len({" ".join(text[0]), " ".join(near)} & set(null)) == 1
    assert sorted(i for i, _ in kept if i is not None) == [-7, -7, 8, 8, 8]
    got = chosen_path.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert Counter(r["component_id"] for r in got) == {None: 9, -7: 4, 8: 3}


# --- decontamination -----------------------------------------------------------------------------

def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_leaks(spark):
    rng = random.Random(8)
    items = [(k, _prose(rng, rng.randint(20, 60))) for k in range(30)]
    items += [(100, "too short"), (101, None), (102, items[0][1])]
    rows, want = [], set()
    for d in range(120):
        text = _prose(rng, rng.randint(0, 200))
        if d % 3 == 0:
            k, t = items[rng.randrange(30)]
            if d % 2:  # case, punctuation and a few edits
                t = t.upper().replace(" ", ", ", 4)
                for _ in range(len(t) // 40):
                    at = rng.randrange(len(t))
                    t = t[:at] + rng.choice(["q", "", "zz"]) + t[at + 1 :]
            at = rng.randint(0, len(text))
            text = text[:at] + " " + t + " " + text[at:]
            want |= {(d, k)} | ({(d, 102)} if k == 0 else set())
        rows.append((d, text, "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "!!! ...", "s"), (503, rows[1][1], "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_chars": 900}):  # one block, many blocks
        got = {(r["doc_id"], r["item_id"]) for r in qgram_leaks.leaks(docs, bench, **options).collect()}
        assert got == want
    clean = qgram_leaks.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert qgram_leaks.leaks(docs, nothing).count() == 0
    assert qgram_leaks.leaks(spark.createDataFrame([], SCHEMA), bench).count() == 0


def test_one_dirty_row_does_not_take_others_of_its_id(spark):
    rng = random.Random(12)
    item = _prose(rng, 30)
    rows = [(i, _prose(rng, 40), "s") for i in (None, None, 5, 5)]
    rows += [(i, f"{_prose(rng, 20)} {item}", "s") for i in (None, 5)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = qgram_leaks.clean_documents(spark.createDataFrame(rows, SCHEMA), bench)
    assert sorted(r["text"] for r in clean.collect()) == sorted(t for _, t, _ in rows[:4])


def _fewest_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_alignment_equals_the_full_table(spark):
    rng = random.Random(3)
    pattern = _prose(rng, 25)[:80]
    rows, want = [], {}
    for d in range(40):
        t = pattern
        for _ in range(d % 14):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["q", "", "zz"]) + t[at + 1 :]
        text = _prose(rng, 8) + " " + t + " " + _prose(rng, 8)
        edits = _fewest_edits(qgram_leaks.normal(pattern), qgram_leaks.normal(text))
        rows.append((d, text, "s"))
        if edits <= 8:
            want[d] = edits
    bench = spark.createDataFrame([(1, pattern)], "item_id long, text string")
    docs = spark.createDataFrame(rows, SCHEMA)
    got = qgram_leaks.leaks(docs, bench, window=80, stride=40).collect()  # the item is one window
    assert {r["doc_id"]: r["min_edits"] for r in got} == want


# --- repeated byte strings -----------------------------------------------------------------------

def _without(rows, length):
    count = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats_equal_brute_force(spark, hot):
    rng = random.Random(4)
    text = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    shared = text(900, "abcdé \n")
    rows = []
    for i in range(60):
        a = rng.randint(0, 500)
        own = [text(rng.randint(0, 300), "abcdefgé \n") for _ in range(2)]
        rows.append((i, own[0] + shared[a : a + rng.randint(100, 400)] + own[1], "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, "x" * 700, "s"), (103, "y" * 250, "s"),
             (103, "y" * 250, "s"), (104, "z" * 200, "s"), (105, shared + shared[:300], "s"),
             (None, shared, "s"), (106, text(40_000, "abcd "), "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("core", F.lit("clash"))
    got = suffix_levels.without_repeats(docs, hot=hot).collect()
    assert sorted((tuple(r) for r in got), key=str) == _without(rows, 200)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    big = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, big + big[4000:4600], "s"), (2, big[100:5000], "s"), (3, big[::-1], "s")]
    monkeypatch.setattr(suffix_levels, "LONG_TEXT", 1000)
    monkeypatch.setattr(suffix_levels.textkeys, "SLICE_BYTES", 500)
    got = suffix_levels.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == _without(rows, 200)
    assert suffix_levels.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_family_finds_every_match():
    import numpy as np

    rng = np.random.default_rng(1)
    prints = rng.integers(0, 4000, 5000).astype(np.uint64)
    family, found = suffix_levels.Family(), set()
    for i in range(0, 5000, 300):
        ids = np.arange(i, min(i + 300, 5000))
        for hit in family.add(prints[ids], ids):
            found |= set(hit.tolist())
    count = Counter(prints.tolist())
    assert found == {i for i, p in enumerate(prints.tolist()) if count[p] > 1}
    sizes = [len(p) for p, _ in family.levels]
    assert sum(sizes) == 5000 and all(a > b for a, b in zip(sizes, sizes[1:]))

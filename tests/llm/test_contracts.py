"""Operators against plain per-document code, and bounds that their docstrings state."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import (
    arc_convert, chosen_path, common, licences, line_quality, subword_toxicity, textkeys, token_spans,
)
from evenkeel.llm.oracles import ORACLES

SCHEMA = "doc_id long, text string, source string"


# --- token spans: every section against a plain loop over its document's tokens ------------------

def _sections(text, kind):
    cut = r"(?<=\n)" if kind == "lines" else r"(?<=\n)|(?<=[.!?] )"
    return [s for s in re.split(cut, text) if s]


def _plain_counts(text, kind, rule, own):
    spans, at = [], 0
    for s in _sections(text, kind):
        spans.append((at, at + len(s)))
        at += len(s)
    counts, done = [0.0] * len(spans), 0
    char = [i for i, c in enumerate(text) for _ in c.encode()]  # of each byte
    for token in own.encode_ordinary(text):
        n = len(own.decode_single_token_bytes(token))
        first, last = char[done], char[done + n - 1] + 1
        done += n
        shared = [max(0, min(last, z) - max(first, a)) for a, z in spans]
        if rule == "start":
            counts[next(i for i, (a, z) in enumerate(spans) if a <= first < z)] += 1
        elif rule == "largest":
            counts[shared.index(max(shared))] += 1
        else:
            for i, part in enumerate(shared):
                counts[i] += part / sum(shared)
    return spans, counts


@pytest.mark.parametrize("kind", token_spans.SECTIONS)
@pytest.mark.parametrize("rule", token_spans.RULES)
def test_tokens_of_every_section(spark, rule, kind):
    rng = random.Random(7)
    bits = ["word", " ", " ", ".", "!", "?", "\n", "\n\n", "é", "ü", "x.y", "...", "12", " the", "ing "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 60))), "s") for i in range(150)]
    rows.append((900, "one very long text. " * 20_000, "s"))
    own, _ = token_spans.encoding(token_spans.TOKENIZER)
    got = {}
    for r in token_spans.section_tokens(spark.createDataFrame(rows, SCHEMA), rule, kind).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["start_char"], r["end_char"], r["n_tokens"]))
    for i, text, _ in rows[:-1]:
        spans, counts = _plain_counts(text, kind, rule, own)
        mine = sorted(got[i])
        assert [(a, z) for _, a, z, _ in mine] == spans
        assert [n for *_, n in mine] == pytest.approx(counts)
    assert sum(n for *_, n in got[900]) == pytest.approx(len(own.encode_ordinary(rows[-1][1])))


# --- line frequency: the DuckDB check states the operator's rule ---------------------------------

def test_line_frequency_and_its_check_on_small_hosts(spark):
    """A line in 12 of 40 documents, which share their smallest line hash in no other way."""
    rng, rows = random.Random(8), []
    for i in range(40):
        own = "\n".join(" ".join(f"w{rng.random()}" for _ in range(30)) for _ in range(3))
        rows.append((i, own + ("\nthe same last line here" if i < 12 else ""), "h"))
    rows += [(100 + i, rows[3][1], "h") for i in range(5)]  # copies count once
    rows += [(200 + i, f"{rows[20][1]}\nanother footer" if i < 9 else None, None) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = line_quality.line_verdicts(docs).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "removed_words",
    ).collect()
    assert sum(r["removed_words"] > 0 for r in got) == 12 + 5
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(ORACLES["op3_line_frequency"]).fetchall()
    assert sorted(tuple(r)[:-1] for r in got) == sorted(want)


# --- archives ------------------------------------------------------------------------------------

def test_archives_are_read_by_as_many_tasks_as_there_are_files(spark):
    rows = [(i, f"http://h/{i}", f"{i} " * 300) for i in range(200)]
    manifest = arc_convert.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"),
                                         file_bytes=20_000)
    paths = [r["path"] for r in manifest.collect()]
    assert len(paths) > 3 and all(re.match("[a-z]+://", p) for p in paths)
    files = manifest.select("path").repartition(min(max(1, manifest.count()), arc_convert.READ_TASKS))
    assert files.rdd.getNumPartitions() == len(paths)
    plan = arc_convert.read_archives(manifest)
    assert plan.count() == len(rows)


def test_a_folder_that_nobody_shares_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://elsewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session())


# --- near-duplicates -----------------------------------------------------------------------------

def test_kept_follows_the_ids(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text, "s"), (1, text + " z", "s"), (2, text + " y", "s"), (3, "other words", "s")]
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 3)}


# --- fitted models: bounds, and scores against plain code ----------------------------------------

def test_fitting_collects_no_more_rows_than_it_says(spark):
    rows = [(7, f"words of text {i}", "s") for i in range(1000)] + [(i, f"other {i}", "s") for i in range(20, 60)]
    rows.append((8, "x" * (subword_toxicity.FIT_CHARS + 1), "s"))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    found = subword_toxicity.training_rows(docs, labels, 30, 3)
    assert len(found) <= 30 and len({i for i, *_ in found}) == len(found)
    assert all(len(t) <= subword_toxicity.FIT_CHARS for _, t, _ in found)
    assert len(licences.background(docs, 10, 9)) <= 10
    long = spark.createDataFrame([(1, "many words " * 100_000, "s")], SCHEMA)
    assert len(licences.background(long, 10, 9)[0]) <= licences.LONG


def test_toxicity_scores_equal_plain_scores(spark, monkeypatch):
    rng = random.Random(1)
    model = {
        "bucket": np.random.default_rng(2).normal(0, 1, 1 << subword_toxicity.BITS).astype(np.float32),
        "bias": 0.3, "weights": {f"w{i}": 0.1 + i / 40 for i in range(30)},
    }
    rows = [(i, " ".join(rng.choice([f"w{rng.randint(0, 50)}", "Ünï", "a.b!", "(x)"]) for _ in range(n)), "s")
            for i, n in enumerate([0, 1, 2, 9, 50, 400] * 5)]
    monkeypatch.setattr(subword_toxicity, "train", lambda *_: model)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["score"] for r in subword_toxicity.toxicity(docs, labels).collect()}
    powers = textkeys.Powers()
    for i, text, _ in rows:
        total = count = 0.0
        for word in text.split():
            weight = model["weights"].get(word, 1.0)
            grams = subword_toxicity.buckets([word], powers)[1]
            total += weight * float(sum(model["bucket"][g] for g in grams))
            count += weight * len(grams)
        score = 1 / (1 + math.exp(-(total / max(count, 1e-9) + model["bias"])))
        assert got[i] == pytest.approx(score, rel=1e-6)


def test_licence_probabilities_equal_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(5)
    k = len(licences.FAMILIES)
    model = {"w": rng.normal(0, 0.4, (2 << licences.BITS, k)).astype(np.float32), "b": np.zeros(k, np.float32)}
    monkeypatch.setattr(licences, "train", lambda *_: model)
    words = [w for t in licences.TEMPLATES.values() for s in t for w in licences.tokens(s)]
    rows = [(i, "\n".join(" ".join(rng.choice(words, n)) for n in rng.integers(1, 39, 3)), "s") for i in range(60)]
    got = licences.licences(spark.createDataFrame(rows, SCHEMA), sure=0.2, alike=2.0).collect()
    found = {r["doc_id"]: (r["family"], r["n_paragraphs"], r["probability"]) for r in got}
    powers = textkeys.Powers()
    for i, text, _ in rows:
        sure = []
        for line in text.split("\n"):
            bag = licences._bag(licences.tokens(line), powers)
            z = model["w"][bag].sum(axis=0, dtype=np.float64) / np.sqrt(len(bag)) + model["b"]
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            if p[1:].max() >= 0.2:
                sure.append(p[1:].max())
        want = ("unknown", len(sure), pytest.approx(max(sure), rel=1e-4)) if sure else ("none", 0, 0)
        assert found[i] == want

"""Token spans, archives, toxicity, licences and the pipeline."""

import base64
import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from evenkeel.llm import arc_convert, licences, subword_toxicity, token_spans

SCHEMA = "doc_id long, text string, source string"


# --- token spans ---------------------------------------------------------------------------------

TEXTS = ["One two.\n\n\nThree! Four? five", "é\n\n😀😀 ünï.  x", "\n", "a", "no break " * 3000, "", None,
         ".\n.\n", " lead", "tail \n"]


@pytest.mark.parametrize("sections", token_spans.SECTIONS)
@pytest.mark.parametrize("rule", token_spans.RULES)
def test_token_counts(spark, rule, sections):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(3, "a", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("section", F.lit("clash"))
    got = token_spans.section_tokens(docs, rule, sections).collect()
    own, _ = token_spans.encoding(token_spans.TOKENIZER)
    total = defaultdict(float)
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
    for i, t in enumerate(TEXTS):
        n = len(own.encode_ordinary(t or "")) * (2 if i == 3 else 1)
        assert total.get(i, 0) == pytest.approx(n)
    for i, t in enumerate(TEXTS):
        spans = sorted((r["start_char"], r["end_char"]) for r in got if r["doc_id"] == i and i != 3)
        if t and i != 3:  # sections tile the text
            assert spans[0][0] == 0 and spans[-1][1] == len(t)
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    if sections == "sentences" and rule != "share":
        assert any(r["n_crossing"] for r in got) or rule == "start"


def test_rules_on_a_crossing_token():
    import numpy as np

    first, end, bounds = np.array([0, 3, 8]), np.array([3, 8, 10]), np.array([0, 4, 7, 10])
    assert token_spans.attribute(first, end, bounds, "start")[0].tolist() == [2, 0, 1]
    assert token_spans.attribute(first, end, bounds, "largest")[0].tolist() == [1, 1, 1]
    share = token_spans.attribute(first, end, bounds, "share")[0]
    assert share.tolist() == pytest.approx([1.2, 0.6, 1.2])


def test_no_documents_no_tokens(spark):
    assert token_spans.section_tokens(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        token_spans.section_tokens(spark.createDataFrame([], SCHEMA), "other")


# --- archives ------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def test_pages_survive_the_round_trip(spark):
    rows = [(1, "http://a b", "x\r\n\r\ny"), (2, None, "x\r\n\r\ny"), (3, "u", ""), (4, "v", None),
            (5, "w", "é\n😀"), (9, "z", "x\r\n\r\ny"), (None, "n", "only"), (11, "big", "q" * 300_000)]
    rows += [(100 + i, f"http://h/{i}", "same") for i in range(300)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash"))
    manifest = arc_convert.archive_pages(pages, file_bytes=20_000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[h or ""].append(p)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     *(("response", None) if p == top else ("revisit", top))))
    got = [tuple(r) for r in arc_convert.read_archives(manifest).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    nothing = arc_convert.archive_pages(spark.createDataFrame([], PAGES))
    assert arc_convert.read_archives(nothing).count() == 0


def test_null_and_repeated_page_ids_keep_their_own_payloads(spark):
    rows = [(None, "n1", "one"), (None, "n2", "two"), (None, "n3", "kept at 9"), (9, "nine", "kept at 9"),
            (4, "f1", "alpha"), (4, "f2", "beta"), (4, "f3", "kept at 9"), (4, "f4", "gamma")]
    pages = spark.createDataFrame(rows, PAGES).coalesce(1)
    got = arc_convert.read_archives(arc_convert.archive_pages(pages)).collect()
    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = [(p, len(h), sha(h), *(("revisit", 9) if h == "kept at 9" and p != 9 else ("response", None)))
            for p, _, h in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough")] * 2, PAGES)
    got = arc_convert.read_archives(arc_convert.archive_pages(pages, least=5)).collect()
    assert {r["record_type"] for r in got} == {"response"} and len(got) == 6


@pytest.mark.parametrize("version", [1, 2])
def test_both_arc_versions_convert(version):
    arc = io.BytesIO()
    arc.write(arc_convert.arc_version_block("f.arc", version))
    arc.write(arc_convert.arc_record(version, "f.arc", arc.tell(), "http://x/y z", "7", b"body\nURL 1 2\n"))
    plain = b"http://dns 1.2.3.4 20010101000000 text/dns 5\nabc\nd\n"
    if version == 2:
        plain = b"http://dns 1.2.3.4 20010101000000 text/dns; q=1 200 - - 0 f.arc 5\nabc\nd\n"
    arc.write(plain)
    arc.seek(0)
    records = list(arc_convert.read_warc(io.BytesIO(b"".join(arc_convert.convert_arc(arc)))))
    assert [f["WARC-Type"] for f, _ in records] == ["warcinfo", "response", "resource"]
    head, block = records[1]
    assert head["WARC-Target-URI"] == "http://x/y%20z" and head["WARC-Date"] == "2001-02-03T04:05:06Z"
    assert head["WARC-Payload-Digest"] == "sha1:" + arc_convert.base32_sha1(b"body\nURL 1 2\n")
    assert block.endswith(b"\r\n\r\nbody\nURL 1 2\n") and records[2][1] == b"abc\nd"


def test_cut_off_arc_is_an_error():
    arc = arc_convert.arc_version_block("f", 1) + arc_convert.arc_record(1, "f", 0, "u", "1", b"x" * 50)
    with pytest.raises(ValueError):
        list(arc_convert.read_arc(io.BytesIO(arc[:-20])))


# --- toxicity ------------------------------------------------------------------------------------

BAD = ["trash", "moron", "worthless", "pathetic"]


def _posts(n, seed):
    rng = random.Random(seed)
    made = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(made) for _ in range(rng.randint(20, 80))]
        toxic = int(rng.random() < 0.3)
        for _ in range(4 * toxic):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), "s"))
        marks.append((i, toxic))
    return rows, marks


def test_toxicity_on_held_out_rows(spark):
    rows, marks = _posts(600, 1)
    rows += [(9000, None, "s"), (9001, "", "s"), (9002, "trassh wortthless morron you pathettic", "s"),
             (9003, "trassh wortthless morron you pathettic", "t"), (None, "lone text", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame(marks + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in subword_toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(got[i]["predicted"], y) for i, y in marks if got[i]["held_out"]]
    assert len(held) > 80 and sum(p == y for p, y in held) / len(held) > 0.93
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i)
    assert got[9002]["score"] == got[9003]["score"] and got[9002]["predicted"] == 1
    assert got[9000]["score"] == got[9001]["score"] < 0.5 and not got[None]["held_out"]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in subword_toxicity.toxicity(docs, none).collect()] == [(0, 0)]
    assert subword_toxicity.toxicity(docs.limit(0), none).count() == 0


# --- licences ------------------------------------------------------------------------------------

def test_licences(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows, want = [], {}
    for i in range(120):
        family = rng.choice(list(licences.TEMPLATES))
        text = prose(rng.randint(5, 150))
        if i % 3 == 0:
            notice = rng.choice(licences.TEMPLATES[family])
            joint = "\n" if i % 2 else " "  # a line of its own, or inside prose
            text = text + joint + notice + joint + prose(40)
            want[i] = family
        rows.append((i, text, "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "the licence of the free public is under terms", "s"),
             (503, prose(30_000), "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("family", F.lit("clash"))
    got = defaultdict(dict)
    for r in licences.licences(docs).collect():
        got[r["doc_id"]][r["family"]] = r
    assert set(got) == {r[0] for r in rows}
    found = {i: {f for f in got[i] if f not in ("none", "unknown")} for i in got}
    hit = sum(found[i] == {f} for i, f in want.items())
    assert hit >= 0.95 * len(want)
    assert not any(found[i] for i in got if i not in want)
    assert all(r["similarity"] >= licences.ALIKE for i in want for f, r in got[i].items() if f in licences.TEMPLATES)
    assert licences.licences(spark.createDataFrame([], SCHEMA)).count() == 0


# --- pipeline ------------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(k, prose(30)) for k in range(5)]
    rows = [(i, prose(90), f"s{i % 3}") for i in range(90)]
    rows += [(200 + i, rows[i][1], "s0") for i in range(10)]  # copies
    rows += [(300 + i, prose(60) + " " + items[i][1] + " " + prose(20), "s1") for i in range(5)]  # leaks
    rows += [(400 + i, "a b c " * 30, "s2") for i in range(5)] + [(500, None, None)]  # junk
    docs = spark.createDataFrame(rows, SCHEMA).select(
        "doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = lambda x: {r["doc_id"] for r in x.select("doc_id").collect()}
    want = [set(range(90)) | set(range(200, 210)) | set(range(300, 305)),
            set(range(90)) | set(range(300, 305)), set(range(90))]
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        if k < 3:
            assert ids(at) == want[k]
        if k < 4:
            assert at.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert ids(at) <= want[2] and Counter(r["doc_id"] for r in out) == Counter(
        r["doc_id"] for r in at.collect())
    count = Counter(r["shard"] for r in out)
    assert max(count.values()) - min(count.values()) <= 1
    words = Counter()
    for r in out:
        words[r["source"]] += len(r["text"].split())
    total = 90 * 90
    assert abs(words["s0"] - total * 5 / 8) <= 1 and abs(words["s2"] - total / 8) <= 1


def test_pipeline_links_from_80(spark, tmp_path):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(100)), "s") for i in range(20)]
    for i, places in ((100, []), (101, [30, 60]), (102, [20, 50, 80])):  # 86 of 106, 81 of 111 shingles
        rows.append((i, " ".join("new" if k in places else w for k, w in enumerate(base)), "s"))
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {*range(20), 100, 102}

"""Shards and mixture against their laws on small, awkward inputs."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from evenkeel.llm import feistel_shards as shards, mixture

SCHEMA = "doc_id long, text string, source string"


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 4097])
def test_numpy_permutation_is_a_bijection(n):
    got = shards.permuted(np.arange(n), n, 7)
    assert sorted(got.tolist()) == list(range(n))
    assert (got == shards.permuted(np.arange(n), n, 7)).all()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_column_permutation_is_a_bijection(spark, n):
    rows = spark.range(n).select(mixture.permuted(F.col("id"), F.lit(n).cast("long"), "s", 3))
    assert sorted(r[0] for r in rows.collect()) == list(range(n))


def _awkward(spark):
    rows = [(i, f"text {i % 7}", "s") for i in range(100)]
    rows += [(3, "text 3", "s")] * 40 + [(None, None, None), (200, "", "t"), (201, "é" * 5000, "t")]
    return spark.createDataFrame(rows, SCHEMA)


def test_shards_follow_the_law(spark):
    docs = _awkward(spark)
    got = shards.shard(docs).collect()
    count = Counter(r["shard"] for r in got)
    assert len(got) == docs.count() and max(count.values()) - min(count.values()) <= 1
    for k in count:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(count[k]))
    by = {r["doc_id"]: r for r in got}
    assert by[201]["size"] == 10001 and by[None]["size"] == 1 and by[None]["text_crc32"] == 0
    assert by[5]["text_crc32"] == zlib.crc32(b"text 5")
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    again = shards.shard(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_of_nothing_and_clashing_columns(spark):
    docs = _awkward(spark).withColumn("shard", F.lit("mine")).withColumn("row", F.lit(1))
    out = shards.sharded_documents(docs)
    assert out.columns == ["doc_id", "text", "source", "row", "size", "text_crc32", "law", "shard",
                           "slot", "grown_shard"]
    assert out.count() == docs.count() and dict(out.dtypes)["shard"] == "int"
    assert shards.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def _targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = float(sum(sizes.values())), set()
    while True:
        total = sum(weight[s] for s in names if s not in capped)
        share = {s: left * weight[s] / total for s in names if s not in capped}
        above = [s for s in share if share[s] > most * sizes[s]]
        if not above:
            return share | {s: most * sizes[s] for s in capped}
        for s in above:
            capped.add(s)
            left -= most * sizes[s]


@pytest.mark.parametrize("block", [4, 128])
def test_mixture_meets_targets(spark, block):
    rows = [(i, "w " * (i % 50), f"s{i % 4}") for i in range(300)]
    rows += [(1000 + i, "x y z", "tiny") for i in range(3)]
    rows += [(2000, None, None), (2001, "a b c d e f", None), (2002, "  ", "empty")]
    rows += [(7, "w " * 7, "s3")] * 5
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash"))
    got = mixture.mixture(docs, block=block).select("doc.*", *[F.col(c).alias("m_" + c) for c in (
        "size", "source_size", "target", "taken")]).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["m_size"]
        taken[r["source"]] += r["m_taken"]
        assert 0 <= r["m_taken"] <= 3 * r["m_size"]
    want = _targets(sizes)
    for r in got:
        assert r["m_source_size"] == sizes[r["source"]]
        assert abs(r["m_target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixture.mixture(docs.repartition(3), block=block).select("doc.doc_id", "taken").collect()
    assert Counter((r["doc_id"], r["m_taken"]) for r in got) == Counter(map(tuple, again))


def test_mixed_documents_hold_the_taken_words(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 90)), f"s{i % 3}") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    taken = {r[0]: r[1] for r in mixture.mixture(docs, block=16).select("doc.doc_id", "taken").collect()}
    out = mixture.mixed_documents(docs, block=16)
    assert out.columns == docs.columns
    found = Counter()
    for r in out.collect():
        words = r["text"].split()
        found[r["doc_id"]] += len(words)
        assert r["n_chars"] == len(r["text"])
        assert all(w.startswith(f"w{r['doc_id']}_") for w in words) and len(set(words)) == len(words)
    assert {d: n for d, n in taken.items() if n} == dict(found)


def test_shard_counts_are_drawn(spark):
    rows = [(i, "w " * 40, f"s{i % 3}") for i in range(300)]
    _, _, parts = mixture.pieces(spark.createDataFrame(rows, SCHEMA), block=8, shard_slots=64)
    slots = parts.select("source", "shard", "slot").distinct().collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots)
    per_shard = Counter((r["shard"], r["source"]) for r in slots)
    assert len({v for (k, s), v in per_shard.items() if s == "s0"}) > 2  # drawn, not dealt evenly


def test_mixture_of_nothing(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert mixture.mixture(nothing).count() == 0 and mixture.mixed_documents(nothing).count() == 0


def test_each_text_is_read_once(spark):
    """Words are counted in one scan; the mixed texts take one more."""
    rows = [(i, f"s{i % 3}", " ".join(["w"] * (i % 60))) for i in range(120)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    docs = spark.createDataFrame(rows, "doc_id long, source string, bare string").select(
        "doc_id", counted("bare").alias("text"), "source"
    )
    assert len(mixture.mixture(docs).collect()) == len(rows)
    assert read.value == len(rows)
    assert mixture.mixed_documents(docs).collect()
    assert read.value == 3 * len(rows)

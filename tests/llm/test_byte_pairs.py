"""Byte-pair encoding against the library and against merging one piece at a time."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evenkeel.llm import byte_pairs, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _odd_texts(n):
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x300) if c not in range(0xD800, 0xE000)]
    letters += map(chr, [0x1680, 0x180E, 0x2000, 0x200B, 0x200D, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
                         0xFEFF, 0x4E00, 0x0660, 0x2160, 0x0301, 0xFFFD, 0xE000, 0x10FFFF])
    letters += ["\U0001f600", "", "<|endoftext|>", "'s", "'ll", "  ", "\n", "aaaa", "the "] * 25
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*texts, "", "a" * 100_001, "ab" * 40_000, "<|endoftext|>", " <|endoftext|><|endoftext|> x",
            "<|endoftext", "é" * 999]


def test_as_the_library_does(spark, library):
    texts = _odd_texts(4000)
    rows = [(i if i else None, t, 5) for i, t in enumerate([None, *texts, texts[0]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(5)
    got = {r["doc_id"]: r for r in byte_pairs.decode(byte_pairs.encode(docs, PATH), PATH).collect()}
    want = library.encode_batch([t or "" for _, t, _ in rows], add_special_tokens=False)
    assert len(got) == len(rows)
    for (i, text, _), w in zip(rows, want):
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == w.ids
        assert got[i]["n_tokens"] == len(w.ids) and got[i]["text"] == (text or "")


def test_report_of_the_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op13_byte_pairs(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_pieces_are_kept_between_slices_or_forgotten(library, monkeypatch):
    texts = _odd_texts(300)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = byte_pairs.Encoder(byte_pairs.load(PATH))
    for cache in (byte_pairs.CACHE, 0):
        monkeypatch.setattr(byte_pairs, "CACHE", cache)
        for some in range(0, len(texts), 37):
            ids, n = encoder.encode(texts[some : some + 37])
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want[some : some + 37]


def test_both_cutters_agree():
    any_text, latin = byte_pairs.cutters()
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(chr(rng.choice([32, 39, rng.randrange(256), rng.randrange(128)])) for _ in range(40))
        assert any_text(text) == latin(text)


def test_ids_that_spell_no_text(spark, library):
    rng = random.Random(6)
    rows = [(i, [rng.choice([rng.randrange(256), rng.randrange(50257)]) for _ in range(i % 50)])
            for i in range(200)] + [(200, None)]
    packed = [(i, len(x or []), bytearray(np.array(x, "<u4").tobytes()) if x is not None else None)
              for i, x in rows]
    made = spark.createDataFrame(packed, "doc_id long, n_tokens long, ids binary")
    got = {r["doc_id"]: r["text"] for r in byte_pairs.decode(made, PATH).collect()}
    for i, ids in rows:
        assert got[i] == library.decode(ids or [], skip_special_tokens=False)


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        byte_pairs.load(public_tokenizers.path("word_bpe_49k.json"))
    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    merges = file["model"]["merges"]
    late = next(i for i, (a, b) in enumerate(merges) if len(a) > 2)
    merges.insert(0, merges.pop(late))  # before its parts are made
    path = tmp_path / "late.json"
    path.write_text(json.dumps(file))
    with pytest.raises(ValueError, match="made later"):
        byte_pairs.load(str(path))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_pairs.decode(byte_pairs.encode(docs, PATH), PATH).collect() == []

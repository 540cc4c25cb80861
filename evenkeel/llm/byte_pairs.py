"""Byte-pair encoding and decoding with an index of pair occurrences.

A text is cut into pieces by the vocabulary's pattern (special tokens stand for themselves), and
each distinct piece of a partition's slice is encoded once.  All new pieces lie one after another
as a linked list of symbols; the index maps every pair that has a rank to all its positions.  Ranks are
taken in ascending order from a heap of active ones: every occurrence of the pair is merged at once
(of overlapping ones the first), and only the pairs to the left and right of a merge enter the lists
of other ranks.  A position whose pair has changed since is passed over when its list is taken.

That equals merging piece by piece, lowest rank first, because a merge creates a symbol that was
not there before, and only pairs of higher rank hold it; `load` verifies this of the vocabulary and
refuses one for which it isn't so.

Encoded texts are packed: ids as little-endian unsigned 32-bit integers.  A null text counts as empty
and has no tokens.  Decoding gives back each text as it was; bytes that are no UTF-8 (of ids that no
text gave) become U+FFFD.  Rows that repeat are treated each for itself, a null doc_id is kept.
An empty table gives an empty result; other columns are not read.  One scan, no shuffle; what is
broadcast is the vocabulary.  About `CACHE` pieces already encoded are kept by a task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.textkeys import slices

# Fixed value: the pattern of byte-level vocabularies of this kind
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE = r"\p{L}", r"\p{N}", r"\s"
SLICE_CHARS, SLICE_IDS = 4 << 20, 1 << 18
CACHE = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself where it is printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def cutters():
    """Functions that cut a text into pieces: of any text, and (faster) of one within Latin-1, whose
    classes are written out for the plain pattern matcher."""
    latin = "".join(map(chr, range(256)))
    classes = {
        kind: "".join(f"\\x{ord(c):02x}" for c in regex.findall(kind, latin))
        for kind in (LETTER, NUMBER, SPACE)
    }
    narrow = PATTERN.replace(r"\S", f"[^{classes[SPACE]}]")
    for kind, members in classes.items():  # within brackets first, then alone
        narrow = re.sub(r"(\[[^]]*)" + re.escape(kind), lambda m: m[1] + members, narrow)
        narrow = narrow.replace(kind, f"[{members}]")
    return regex.compile(PATTERN).findall, re.compile(narrow).findall


@dataclass
class Vocabulary:
    """What encoding and decoding need of a vocabulary file."""

    byte_ids: np.ndarray  # id of each byte
    size: int
    keys: np.ndarray  # left * size + right of every merge, ascending
    ranks: np.ndarray  # its rank
    left: np.ndarray  # by rank: the parts and the product
    right: np.ndarray
    product: np.ndarray
    special: dict[str, int]
    token_bytes: np.ndarray  # the bytes of all ids one after another
    token_ends: np.ndarray


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and not any(model.get(k) for k in (
            "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and file["normalizer"] is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and not any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    )
    if not plain:
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    vocab, letters = model["vocab"], byte_letters()
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    byte_ids = np.zeros(256, dtype=np.int64)
    for letter, byte in letters.items():
        byte_ids[byte] = vocab[letter]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
    right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
    product = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    made = np.full(size, -1, dtype=np.int64)
    made[product] = np.arange(len(pairs))
    if len(np.unique(product)) < len(pairs) or np.isin(byte_ids, product).any() or (
        np.maximum(made[left], made[right]) >= np.arange(len(pairs))
    ).any():
        raise ValueError(f"{path}: a merge uses a symbol that is made later or twice")
    keys = left * size + right
    order = np.argsort(keys)
    spelled = [b""] * size
    for token, i in {**vocab, **special}.items():
        known = all(c in letters for c in token)
        spelled[i] = bytes(letters[c] for c in token) if known else token.encode()
    ends = np.zeros(size + 1, dtype=np.int64)
    np.cumsum([len(s) for s in spelled], out=ends[1:])
    return Vocabulary(
        byte_ids, size, keys[order], order, left, right, product, special,
        np.frombuffer(b"".join(spelled), dtype=np.uint8), ends,
    )


class PairIndex:
    """Symbols of many pieces as one linked list, and the positions of every pair by its rank."""

    def __init__(self, vocabulary: Vocabulary, symbols: np.ndarray, begins: np.ndarray) -> None:
        """begins: where each piece begins, and the end; no piece is empty."""
        self.v, n = vocabulary, len(symbols)
        self.none = len(vocabulary.product)
        self.symbol = np.append(symbols, -1)
        self.next = np.arange(1, n + 2)
        self.next[begins[1:] - 1] = n
        self.before = np.arange(-1, n)
        self.before[begins[:-1]] = n
        self.rank_at = np.full(n + 1, self.none, dtype=np.int64)
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._enter(np.arange(n))
        heapify(self.active)

    def _enter(self, at: np.ndarray) -> None:
        """Rank the pairs that begin at these positions and put them into the lists of their ranks."""
        a, b = self.symbol[at], self.symbol[self.next[at]]
        key = a * self.v.size + b
        i = np.searchsorted(self.v.keys, key)
        i[i == len(self.v.keys)] = 0
        known = (self.v.keys[i] == key) & (b >= 0)
        self.rank_at[at] = self.none
        at, rank = at[known], self.v.ranks[i[known]]
        self.rank_at[at] = rank
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.diff(rank, prepend=-1))
        for r, some in zip(rank[cut].tolist(), np.split(at, cut[1:])):
            if r in self.places:
                self.places[r].append(some)
            else:
                self.places[r] = [some]
                heappush(self.active, r)

    def merge_all(self) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left, and where they stood."""
        while self.active:
            rank = heappop(self.active)
            lists = self.places.pop(rank)
            at = np.unique(np.concatenate(lists))
            at = at[self.rank_at[at] == rank]
            if not len(at):
                continue
            right = self.next[at]
            if self.v.left[rank] == self.v.right[rank]:  # of a chain every second one
                alone = np.append(True, at[1:] != right[:-1])
                head = np.flatnonzero(alone)
                turn = np.arange(len(at)) - head[np.cumsum(alone) - 1]
                at, right = at[turn % 2 == 0], right[turn % 2 == 0]
            after = self.next[right]
            self.symbol[at] = self.v.product[rank]
            self.symbol[right] = -1
            self.rank_at[right] = self.none
            self.next[at] = after
            self.before[after] = at
            around = np.concatenate([self.before[at], at])
            self._enter(around[around < len(self.symbol) - 1])
        left = np.flatnonzero(self.symbol >= 0)
        return self.symbol[left], left


def _gather(ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items of the lists `which` (list i is [ends[i], ends[i + 1])), and list lengths."""
    n = ends[which + 1] - ends[which]
    total = np.cumsum(n)
    shift = np.repeat(ends[which] - total + n, n)
    shift += np.arange(len(shift))
    return shift, n


class _Pieces(dict):
    """Numbers of pieces, given in the order in which they are met."""

    def __init__(self, special: dict[str, int]) -> None:
        super().__init__()
        self.new: list[str] = []
        self.first = len(special)

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.first
        self.first += 1
        self.new.append(piece)
        return number


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.any_text, self.latin = cutters()
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = {s: i for i, s in enumerate(names)}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self._clear()

    def _clear(self) -> None:
        self.pieces = _Pieces(self.special)
        self.tokens = np.array([self.v.special[s] for s in self.special], dtype=np.uint32)
        self.ends = np.arange(len(self.special) + 1)

    def _numbers(self, text: str) -> list[int]:
        number = self.pieces.__getitem__
        try:
            text.encode("latin-1")
            find = self.latin
        except UnicodeEncodeError:
            find = self.any_text
        if self.cut is None or not any(s in text for s in self.special):
            return list(map(number, find(text)))
        out: list[int] = []
        for i, part in enumerate(self.cut(text)):
            out += [self.special[part]] if i % 2 else map(number, find(part))
        return out

    def _learn(self) -> None:
        """Encode the pieces met since the last call."""
        new = [p.encode("utf-8", "surrogatepass") for p in self.pieces.new]
        self.pieces.new.clear()
        if not new:
            return
        begins = np.zeros(len(new) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in new], out=begins[1:])
        raw = np.frombuffer(b"".join(new), dtype=np.uint8)
        tokens, at = PairIndex(self.v, self.v.byte_ids[raw], begins).merge_all()
        ends = np.searchsorted(at, begins[1:]) + len(self.tokens)
        self.tokens = np.concatenate([self.tokens, tokens.astype(np.uint32)])
        self.ends = np.concatenate([self.ends, ends])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and the number of ids of each text."""
        if len(self.pieces) > CACHE:
            self._clear()
        numbers = [np.array(self._numbers(t), dtype=np.int64) for t in texts]
        self._learn()
        place, n = _gather(self.ends, np.concatenate(numbers))
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in numbers])
        return self.tokens[place], np.bincount(doc, n, minlength=len(texts)).astype(np.int64)


def _packed(kind: pa.DataType, data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.Array.from_buffers(
        kind, len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]
    )


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            i, texts = 0, batch.column(1)
            while i < len(texts):
                some, size = [], 0
                while i + len(some) < len(texts) and (not some or size < SLICE_CHARS):
                    some.append(texts[i + len(some)].as_py() or "")
                    size += len(some[-1])
                ids, n = encoder.encode(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, len(some)),
                        pa.array(n),
                        _packed(pa.binary(), ids.astype("<u4").view(np.uint8), 4 * n),
                    ],
                    ["doc_id", "n_tokens", "ids"],
                )
                i += len(some)

    return run


def _texts(v: Vocabulary, ids: np.ndarray, n: np.ndarray) -> pa.Array:
    place, length = _gather(v.token_ends, ids)
    doc = np.repeat(np.arange(len(n)), n)
    raw = v.token_bytes[place]
    texts = _packed(pa.string(), raw, np.bincount(doc, length, minlength=len(n)).astype(np.int64))
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in texts.cast(pa.binary()).to_pylist()], pa.string())
    return texts


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy().astype(np.int64)
            begins = np.append(0, np.cumsum(lengths))
            for i, j in slices(begins, 4 * SLICE_IDS):
                part = batch.slice(i, j - i)
                packed = b"".join(b or b"" for b in part.column(2).to_pylist())
                ids = np.frombuffer(packed, dtype="<u4").astype(np.int64)
                texts = _texts(shared.value, ids, lengths[i:j] // 4)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*batch.schema.names, "text"])

    return run


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed) of every whole text, by the vocabulary file at `path`."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(load(path))
    return documents.select("doc_id", "text").mapInArrow(
        _encode(shared), f"doc_id {kind}, n_tokens long, ids binary"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids spell."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        _decode(shared), f"doc_id {kind}, n_tokens long, ids binary, text string"
    )


def coding_report(documents: DataFrame, path: str) -> DataFrame:
    """Digests of the packed ids and of the decoded text, one row per document."""
    return decode(encode(documents, path), path).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )

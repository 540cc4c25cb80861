"""Token counts per section by offsets: whole documents are encoded once, then attributed.

Encoding sections one by one would change tokens at their borders.  Here a document is encoded as a
whole, token byte lengths give character spans, and the spans are interval-joined with the section
spans of the same document (sorted bounds, binary search).  A token that crosses a border is
allocated by rule:

- `start`: to the section of its first character,
- `largest` (default): to the section that holds most of its characters, the first one on ties,
- `share`: to every section in proportion to its characters.

Sections are lines (a line break belongs to the line it ends) or sentences (lines cut after `.`,
`!` or `?` and a blank, which belongs to the sentence it follows; tokens with a leading blank then
cross the border).  The counts of a document's sections add up to its tokens under each rule.

Null and empty texts have no section and give no row.  Rows that repeat are counted each for
itself.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)
RULES = ("start", "largest", "share")
SECTIONS = ("lines", "sentences")
ROWS = 8192


def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return own, lengths


def section_bounds(raw: np.ndarray, sections: str) -> np.ndarray:
    """Byte bounds of the sections: 0, where each but the first begins, and the end."""
    cut = raw == 10
    if sections == "sentences":
        ends = (raw == 46) | (raw == 33) | (raw == 63)
        cut[1:] |= ends[:-1] & (raw[1:] == 32)
    inner = np.flatnonzero(cut[:-1]) + 1
    return np.concatenate([[0], inner, [len(raw)]])


def attribute(
    first: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section [bounds[i], bounds[i+1]), and how many of its tokens cross a border.

    first, end: character spans of the tokens; bounds: ascending, without empty sections.
    """
    n = len(bounds) - 1
    a = np.searchsorted(bounds, first, side="right") - 1
    z = np.searchsorted(bounds, end - 1, side="right") - 1
    crossing = np.flatnonzero(a != z)
    if rule == "start":
        return np.bincount(a, minlength=n).astype(float), np.bincount(a[crossing], minlength=n)
    counts = np.bincount(a[a == z], minlength=n).astype(float)
    spread = z[crossing] - a[crossing] + 1
    token = np.repeat(np.arange(len(crossing)), spread)
    section = np.arange(int(spread.sum())) - np.repeat(np.cumsum(spread) - spread, spread)
    section += a[crossing][token]
    t = crossing[token]
    part = np.minimum(end[t], bounds[section + 1]) - np.maximum(first[t], bounds[section])
    if rule == "share":
        counts += np.bincount(section, part / (end - first)[t], minlength=n)
        return counts, np.bincount(section, minlength=n)
    order = np.lexsort((section, -part, token))
    best = order[np.flatnonzero(np.diff(token[order], prepend=-1))]
    counts += np.bincount(section[best], minlength=n)
    return counts, np.bincount(section[best], minlength=n)


def _encode(path: str, pattern: str, rule: str, sections: str):
    names = ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lengths = encoding(path, pattern)
        for batch in batches:
            out: list[list[np.ndarray]] = []
            at, rows = [], 0
            for d in range(len(batch)):
                text = batch.column(1)[d].as_py()
                if not text:
                    continue
                raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
                ids = np.asarray(own.encode_ordinary(text), dtype=np.int64)
                ends = np.cumsum(lengths[ids])
                bounds = section_bounds(raw, sections)
                # bytes to characters: a token that holds a part of a character covers it
                before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                first = before[np.concatenate([[0], ends[:-1]]) + 1] - 1
                counts, crossing = attribute(first, before[ends], before[bounds], rule)
                n = len(counts)
                edges = before[bounds]
                out.append([np.arange(n), edges[:-1], edges[1:], counts, crossing])
                at.append(np.full(n, d))
                rows += n
                if rows >= ROWS:
                    yield _rows(batch, at, out, names)
                    out, at, rows = [], [], 0
            if out:
                yield _rows(batch, at, out, names)

    return run


def _rows(batch, at, out, names) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*out)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    ids = batch.column(0).take(pa.array(np.concatenate(at)))
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c).cast(k) for c, k in zip(cols, kinds)]], names)


def section_tokens(
    documents: DataFrame, rule: str = "largest", sections: str = "sentences",
    tokenizer: str = TOKENIZER, pattern: str = PATTERN,
) -> DataFrame:
    """doc_id, section, start_char, end_char, n_tokens (double), n_crossing."""
    if rule not in RULES or sections not in SECTIONS:
        raise ValueError(f"rule must be one of {RULES}, sections one of {SECTIONS}")
    return documents.select("doc_id", "text").mapInArrow(
        _encode(tokenizer, pattern, rule, sections),
        "doc_id long, section long, start_char long, end_char long, n_tokens double, n_crossing long",
    )

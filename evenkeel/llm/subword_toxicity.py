"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with word ends marked) and itself, each a bucket with an
embedding; a document is the weighted mean of all its bags, and a linear softmax of the mean gives
the class.  Embeddings and softmax are trained together on the labelled rows.  A misspelling that was
never seen shares most n-grams with its word.  Frequent words weigh less (a / (a + frequency)).

Training takes at most `most` labelled rows with crc32(doc_id) mod 5 <> 0, the first in the order of
a seeded hash; that bound is documented and does not depend on the input.  For scoring, softmax
and mean are linear, so each bucket shrinks to one number and every whole text of all documents
is scored in tasks with a table of 2^bits numbers.

Only the text is an input of a score.  Null and empty texts have the score of the bias alone (no
evidence).  Without any labelled row of both classes every score is 0.  Rows that repeat are scored
each for itself; a null doc_id is not held out.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm import textkeys

BITS, DIM, SHORT, LONG = 17, 4, 3, 6
MOST, FIT_CHARS = 6000, 200_000
VISITS, EPOCHS, BATCH = 60_000, 60, 32
RATE, SCALE = 3.0, 50.0
RARE = 1e-3
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def buckets(words: list[str], powers: textkeys.Powers) -> tuple[np.ndarray, np.ndarray]:
    """Owner (number of the word) and bucket of every n-gram of the words, and of the words."""
    marked = [f"<{w.lower().strip(_STRIP)}>" for w in words]
    size = np.array([len(w) for w in marked], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    powers.grow(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(
            textkeys.mix(codes.astype(np.uint64) + np.uint64(77)) * powers.up[: len(codes)],
            out=sums[1:],
        )
    owner = np.repeat(np.arange(len(words)), size)
    owners, first, last = [np.arange(len(words))], [begins[:-1]], [begins[1:]]
    for n in range(SHORT, LONG + 1):
        i = np.flatnonzero(np.arange(len(codes)) + n <= begins[owner + 1])
        owners.append(owner[i])
        first.append(i)
        last.append(i + n)
    keys = textkeys.string_hash(sums, powers, np.concatenate(first), np.concatenate(last))
    return np.concatenate(owners), (keys >> np.uint64(64 - BITS)).astype(np.int64)


class Bags:
    """Documents as sparse weighted counts of buckets."""

    def __init__(self, texts: list[str]) -> None:
        seen: dict[str, int] = {}
        docs = []
        for t in texts:
            docs.append(np.array([seen.setdefault(w, len(seen)) for w in t.split()], dtype=np.int64))
        counts = np.bincount(np.concatenate(docs), minlength=len(seen)) if seen else np.zeros(0)
        share = counts / max(1, counts.sum())
        self.weights = {w: RARE / (RARE + share[i]) for w, i in seen.items()}
        heavy = np.array([self.weights[w] for w in seen])
        parts, sizes, names, powers = [], [], list(seen), textkeys.Powers()
        for i in range(0, len(names), 4096):
            owner, found = buckets(names[i : i + 4096], powers)
            parts.append(found[np.argsort(owner, kind="stable")].astype(np.int32))
            sizes.append(np.bincount(owner, minlength=min(4096, len(names) - i)))
        self.flat = np.concatenate([np.zeros(0, dtype=np.int32), *parts])
        self.size = np.concatenate([np.zeros(0, dtype=np.int64), *sizes])
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.docs = []  # distinct words with weights; n-grams are laid out batch by batch
        for d in docs:
            words, n = np.unique(d, return_counts=True)
            weight = heavy[words] * n if len(words) else np.zeros(0)
            total = float((weight * self.size[words]).sum()) or 1.0
            self.docs.append((words.astype(np.int32), (weight / total).astype(np.float32)))

    def expanded(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, weight and place in the batch of every n-gram of the picked documents."""
        words = np.concatenate([self.docs[d][0] for d in pick])
        weight = np.concatenate([self.docs[d][1] for d in pick])
        doc = np.repeat(np.arange(len(pick)), [len(self.docs[d][0]) for d in pick])
        k = self.size[words]
        place = np.repeat(self.first[words] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
        return self.flat[place], np.repeat(weight, k), np.repeat(doc, k)


def train(texts: list[str], labels: list[int], seed: int = 3) -> dict:
    """Embeddings and softmax, shrunk to one number per bucket, a bias and the word weights."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return {"bucket": np.zeros(1 << BITS, dtype=np.float32), "bias": -np.inf, "weights": {}}
    bags = Bags(texts)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (1 << BITS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    # plain gradient steps: a gram that is seen once moves little, unlike with adaptive rates
    epochs = min(EPOCHS, -(-VISITS // len(y)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs)
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            idx, val, doc = bags.expanded(pick)
            picked = emb[idx]
            mean = np.stack(
                [np.bincount(doc, picked[:, k] * val, minlength=len(pick)) for k in range(DIM)], 1
            )
            logits = SCALE * (mean @ out) + bias
            grad = np.exp(logits - logits.max(axis=1, keepdims=True))
            grad /= grad.sum(axis=1, keepdims=True)
            grad[np.arange(len(pick)), y[pick]] -= 1
            g_out, g_mean = SCALE * mean.T @ grad / len(pick), SCALE * grad @ out.T
            rows, inverse = np.unique(idx, return_inverse=True)
            emb[rows] -= rate * np.stack(
                [np.bincount(inverse, g_mean[doc, k] * val, minlength=len(rows)) for k in range(DIM)],
                1,
            ).astype(np.float32)
            out -= (0.002 * g_out / max(1.0, np.abs(g_out).max())).astype(np.float32)
            bias -= (0.05 * grad.mean(axis=0)).astype(np.float32)
    side = SCALE * (out[:, 1] - out[:, 0])
    return {
        "bucket": (emb @ side).astype(np.float32), "bias": float(bias[1] - bias[0]),
        # words as rare as unknown ones need no entry
        "weights": {w: x for w, x in bags.weights.items() if x < 0.9},
    }


def _scorer(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        bucket, bias, weights = model["bucket"], model["bias"], model["weights"]
        powers, known = textkeys.Powers(), {}
        for batch in batches:
            raw_all, begins_all = textkeys.text_bytes(batch.column(1))
            scores = np.zeros(len(batch))
            for i, j in textkeys.slices(begins_all):
                begins = begins_all[i : j + 1] - begins_all[i]
                raw = raw_all[begins_all[i] : begins_all[j]]
                first, last, at = textkeys.words(raw, begins)
                sums = textkeys.prefix_sums(raw, powers)
                keys = textkeys.string_hash(sums, powers, first, last)
                unique, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
                if len(known) > 1_000_000:
                    known.clear()
                data = raw.tobytes()
                keyed = unique.tolist()
                new = [u for u, key in enumerate(keyed) if key not in known]
                if new:
                    spans = zip(first[where[new]].tolist(), last[where[new]].tolist())
                    found = [data[a:b].decode("utf-8", "replace") for a, b in spans]
                    owner, grams = buckets(found, powers)
                    heavy = np.array([weights.get(w, 1.0) for w in found])
                    total = heavy * np.bincount(owner, bucket[grams], minlength=len(new))
                    count = heavy * np.bincount(owner, minlength=len(new))
                    known.update(zip((keyed[u] for u in new), zip(total.tolist(), count.tolist())))
                parts = np.array([known[key] for key in keyed], dtype=float).reshape(-1, 2)
                flat = np.concatenate([np.zeros((1, 2)), np.cumsum(parts[inverse], axis=0)])
                total = flat[at[1:]] - flat[at[:-1]]
                scores[i:j] = total[:, 0] / np.maximum(total[:, 1], 1e-9)
            with np.errstate(over="ignore"):
                scores = 1 / (1 + np.exp(-(scores + bias)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return run


def training_rows(documents: DataFrame, labels: DataFrame, most: int, seed: int) -> list:
    """At most `most` labelled texts outside the held-out fold (a bounded, documented sample): one text
    of a doc_id, and none of more than `FIT_CHARS` characters."""
    marked = labels.filter(
        F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text")).filter(F.length("text") <= FIT_CHARS)
    found = rows.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = found.select("doc_id", "text", "toxic")
    return sorted(tuple(r) for r in found.collect())


def toxicity(
    documents: DataFrame, labels: DataFrame, most: int = MOST, seed: int = 3
) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = training_rows(documents, labels, most, seed)
    model = train([t for _, t, _ in rows], [int(y) for _, _, y in rows], seed)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    scored = documents.select("doc_id", "text").mapInArrow(_scorer(shared), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

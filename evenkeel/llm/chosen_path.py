"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

Every document is a set of shingle hashes.  Equal sets are one class.  A class carries `TOKENS`
minwise tokens.  Independent trees branch recursively: a node chooses two token positions, and
its members go to one child per chosen position and value.  Pairs above the threshold share a
position with probability of at least the threshold, so after several trees they meet almost
surely (with 16 root choices at 0.85 a pair is missed with probability 0.15^16).

Nodes of at most `SMALL` members are compared exhaustively on their tokens (five standard
deviations below the expected agreement still count as a candidate); larger ones branch again.
Nodes whose largest child keeps over half of them are alike throughout; these, and what is still
large at the last level, meet block by block: no cap.  Nodes propose only pairs that span
their candidates, the most central members first, so no pass emits all pairs of a group:
1. the spanning pairs are confirmed; what they link is a component;
2. candidates that hang together over all trees are a cluster.  A cluster that is several components
   is compared in full, block by block, and only the links leave the task.
Pairs inside one component need no comparison, because a component is the result.

Each link is confirmed on the full shingle sets: 100 * common >= threshold * all.  The sets are made
from the texts in the groups that proposed the pairs, so a text travels once per group.

Empty texts have empty sets, n_shingles 0, and stay alone.  Rows are known by a key of doc_id and
text (`row_key`), so different texts are compared also where they repeat a doc_id or have none;
only rows equal in both are one document.  Keys sort by doc_id, so the smallest key of a component
holds its smallest doc_id.  A null doc_id sorts last: it names no component unless all members are
null.  Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm import textkeys
from evenkeel.llm.common import SEPARATORS, stored
from evenkeel.llm.components import components

TOKENS = 64
TREES = 8
BRANCHES = 2
SMALL = 1024
LEVELS = 5
WIDTH = 5
KEY = "decimal(38,0)"
HASHES = 1 << 60
NO_ID = 1 << 63  # above any doc_id
_KEYS = pa.decimal128(38, 0)


def row_key() -> Column:
    """doc_id, then 60 bits of the text's hash, in one number."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit(str(NO_ID)).cast("decimal(19,0)"))
    low = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit(HASHES - 1))
    return (doc * F.lit(HASHES).cast("decimal(19,0)") + low.cast("decimal(19,0)")).cast(KEY)


def key_doc_id(key: Column) -> Column:
    """The doc_id of a row key."""
    whole = key - F.pmod(key, F.lit(HASHES).cast(KEY))
    last = F.lit(str(NO_ID * HASHES)).cast(KEY)
    return F.when(key < last, F.call_function("div", whole, F.lit(HASHES).cast(KEY)))


def _minwise(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 1024):
            part = shingles[i : i + 1024, None] * a[None, :]
            part += b[None, :]
            np.minimum(low, part.min(axis=0), out=low)
    return (low >> np.uint64(33)).astype(np.int32)


def _signatures(width: int, tokens: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textkeys.Powers()
        a = textkeys.mix(np.arange(1, tokens + 1, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)
        b = textkeys.mix(a)
        for batch in batches:
            n, one, two, sigs = [], [], [], []
            for s in textkeys.shingle_sets(batch.column(1), powers, width):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    one.append(s.sum(dtype=np.uint64))
                    two.append(textkeys.mix(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                sigs.append(_minwise(s, a, b) if len(s) else np.zeros(0, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(one, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(two, dtype=np.uint64).view(np.int64)),
                    pa.array(sigs, pa.list_(pa.int32())),
                    pa.array([(s & 255).astype(np.uint8).tobytes() for s in sigs], pa.binary()),
                ],
                ["row", "n", "h1", "h2", "sig", "tokens"],
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns, from rows that come sorted by them."""
    key, rows = None, []
    for batch in batches:
        for i in range(0, len(batch), 4096):
            for row in zip(*(c.to_pylist() for c in batch.slice(i, 4096).columns)):
                if row[:keys] != key:
                    if rows:
                        yield key, rows
                    key, rows = row[:keys], []
                rows.append(row[keys:])
    if rows:
        yield key, rows


def _near(n: np.ndarray, sig: list[bytes], threshold: int, least: int) -> np.ndarray:
    """Which members' tokens and sizes do not rule a link out."""
    tokens = np.frombuffer(b"".join(sig), dtype=np.uint8).reshape(len(n), -1)
    equal = np.zeros((len(n), len(n)), dtype=np.uint8)
    for t in range(tokens.shape[1]):
        equal += tokens[:, t][:, None] == tokens[:, t][None, :]
    near = (equal >= least) & (
        100 * np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])
    )
    np.fill_diagonal(near, False)
    return near


def _forest(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs that span the candidate graph, most central members first: fewer than members."""
    degree = near.sum(axis=1)
    left = degree > 0
    while left.any():
        hub = int(np.where(left, degree, -1).argmax())
        left[hub] = False
        reached = [hub]
        while reached:
            reached.sort(key=lambda x: degree[x])
            x = reached.pop()
            for y in np.flatnonzero(near[x] & left).tolist():
                yield x, y
                left[y] = False
                reached.append(y)


def _propose(threshold: int, least: int):
    """Candidate pairs of each group: (node, i, j), then rep, n, block, tokens."""
    names = ["node", "i", "j", "a", "b"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), _KEYS, _KEYS]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in _groups(batches, 3):
            if len(rows) < 2:
                continue
            rows.sort()
            rep, n, block, sig = zip(*rows)
            block = np.array(block)
            near = _near(np.array(n), sig, threshold, least)
            if key[1] != key[2]:  # two blocks of a large node: only pairs between them
                near &= block[:, None] != block[None, :]
            out.extend((*key, rep[min(x, y)], rep[max(x, y)]) for x, y in _forest(near))
            if len(out) >= 8192:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return run


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= threshold * (len(x) + len(y) - common)


def _links(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KEYS) for c in zip(*found)], ["a", "b"])


def _confirm(threshold: int, width: int):
    """Links of each group (key): rep, text, partners; shingle sets are made once per member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textkeys.Powers()
        for _, rows in _groups(batches, 1):
            texts = pa.array([r[1] for r in rows], pa.large_string())
            sets = dict(zip((r[0] for r in rows), textkeys.shingle_sets(texts, powers, width)))
            found = [
                (a, b) for a, _, partners in rows for b in partners or ()
                if _linked(sets[a], sets[b], threshold)
            ]
            if found:
                yield _links(found)

    return run


def _settle(threshold: int, least: int, width: int):
    """Links between different components of each cluster: (cluster, i, j), then rep, n, block,
    tokens, part, text.  Only links leave the task, not candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textkeys.Powers()
        for key, rows in _groups(batches, 3):
            if len(rows) < 2:
                continue
            rows.sort(key=lambda r: r[0])
            rep, n, block, sig, part, texts = zip(*rows)
            codes: dict = {}
            block, part = np.array(block), np.array([codes.setdefault(p, len(codes)) for p in part])
            near = _near(np.array(n), sig, threshold, least) & (part[:, None] != part[None, :])
            if key[1] != key[2]:
                near &= block[:, None] != block[None, :]
            if not near.any():
                continue
            sets = list(textkeys.shingle_sets(pa.array(texts, pa.large_string()), powers, width))
            parts = {p: p for p in part.tolist()}  # components of the cluster that met just now

            def root(p: int) -> int:
                while parts[p] != p:
                    p = parts[p]
                return p

            found = []
            for x, y in zip(*np.nonzero(np.triu(near))):
                p, q = root(int(part[x])), root(int(part[y]))
                if p != q and _linked(sets[x], sets[y], threshold):
                    found.append((rep[x], rep[y]))
                    parts[max(p, q)] = min(p, q)
            if found:
                yield _links(found)

    return run


def _roots(classes: DataFrame, trees: int, branches: int) -> DataFrame:
    picks = [(t, (t * branches + k) % TOKENS) for t in range(trees) for k in range(branches)]
    children = F.array(
        *[F.xxhash64(F.lit(t), F.lit(i), F.get("sig", F.lit(i))) for t, i in picks]
    )
    return classes.select("rep", F.explode(children).alias("node"))


def _branched(nodes: DataFrame, classes: DataFrame, level: int, branches: int) -> DataFrame:
    """rep, parent, pm (its members), node: the children that each member goes to."""

    def child(k: int) -> Column:
        i = F.pmod(F.xxhash64("parent", F.lit(level), F.lit(k)), F.lit(TOKENS)).cast("int")
        return F.xxhash64("parent", F.lit(level), i, F.get("sig", i))

    named = nodes.select("rep", F.col("node").alias("parent"), F.col("m").alias("pm"))
    with_sig = named.join(classes.select("rep", "sig").hint("merge"), "rep")
    children = F.explode(F.array_distinct(F.array(*[child(k) for k in range(branches)])))
    return with_sig.select("rep", "parent", "pm", children.alias("node"))


def _leaves(classes: DataFrame, trees: int, levels: int, small: int) -> DataFrame:
    """rep, node, m: members of the nodes that are compared in full."""
    done, nodes = None, _roots(classes, trees, BRANCHES)
    for level in range(1, levels + 1):
        counts = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        sized = stored(nodes.join(counts.hint("merge"), "node").select("rep", "node", "m"), "nodes")
        ready = sized if level == levels else sized.filter(F.col("m") <= small)
        done = ready if done is None else done.union(ready)
        large = sized.filter(F.col("m") > small)
        if level == levels or large.isEmpty():
            return done
        children = stored(_branched(large, classes, level, BRANCHES), "children")
        # a node that keeps most members together is alike throughout: branching cannot split it
        dense = stored(
            children.groupBy("parent", "pm", "node").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("parent", "pm").agg(F.max("c").alias("top"))
            .filter(2 * F.col("top") > F.col("pm")).select("parent"),
            "dense",
        )
        alike = large["node"] == dense["parent"]
        done = done.union(large.join(dense.hint("merge"), alike, "left_semi"))
        nodes = children.join(dense.hint("merge"), "parent", "left_anti").select("rep", "node")


def _blocked(members: DataFrame, key: str, m: str, small: int, columns: list[str]) -> DataFrame:
    """Members once per pair of blocks of their group, sorted by (key, i, j) within partitions."""
    blocks = F.ceil(F.col(m) / small).cast("long")
    met = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")),
    )
    placed = members.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks"))
    )
    return (
        placed.select(key, *[c for c in columns], F.inline(met))
        .select(key, "i", "j", *columns)
        .repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")
    )


def _candidates(leaves: DataFrame, classes: DataFrame, threshold: int, least: int, small: int) -> DataFrame:
    """node, i, j, a, b: pairs that span the candidates of every node."""
    members = leaves.join(classes.select("rep", "n", "tokens").hint("merge"), "rep")
    return _blocked(members, "node", "m", small, ["rep", "n", "block", "tokens"]).mapInArrow(
        _propose(threshold, least), f"node long, i long, j long, a {KEY}, b {KEY}"
    )


def _settled(
    clusters: DataFrame, parts: DataFrame, classes: DataFrame, texts: DataFrame, threshold: int,
    least: int, small: int,
) -> DataFrame:
    """Links between components of one cluster of candidates, each cluster compared in full."""
    named = parts.select(F.col("node").alias("rep"), F.col("component").alias("p"))
    members = (
        clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
        .join(named.hint("merge"), "rep", "left").withColumn("part", F.coalesce("p", "rep"))
    )
    # clusters that are one component have nothing left; pairs were checked already
    open_ = members.groupBy("cluster").agg(
        F.min("part").alias("lowest"), F.max("part").alias("highest"), F.count(F.lit(1)).alias("m")
    ).filter("lowest <> highest AND m > 2").select("cluster", "m")
    members = (
        members.join(open_.hint("merge"), "cluster").drop("p")
        .join(classes.select("rep", "n", "tokens").hint("merge"), "rep")
        .join(texts.hint("merge"), "rep")
    )
    columns = ["rep", "n", "block", "tokens", "part", "text"]
    return _blocked(members, "cluster", "m", small, columns).mapInArrow(
        _settle(threshold, least, WIDTH), f"a {KEY}, b {KEY}"
    )


def _confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """a, b of the pairs whose full shingle sets are similar enough.  A pair is checked in one of the
    groups that proposed it; a group's members come with their texts once."""
    once = stored(
        pairs.groupBy("a", "b").agg(F.min(F.xxhash64("node", "i", "j")).alias("key")), "pairs"
    )
    members = (
        once.select("key", F.col("a").alias("rep"), F.col("b").alias("partner"))
        .union(once.select("key", F.col("b").alias("rep"), F.lit(None).cast(KEY)))
        .groupBy("key", "rep").agg(F.collect_list("partner").alias("partners"))
    )
    return (
        members.join(texts.hint("merge"), "rep").select("key", "rep", "text", "partners")
        .repartition("key").sortWithinPartitions("key")
        .mapInArrow(_confirm(threshold, WIDTH), f"a {KEY}, b {KEY}")
    )


def _verdicts(
    documents: DataFrame, threshold: int, trees: int = TREES, levels: int = LEVELS,
    small: int = SMALL, seed: int = 5,
) -> DataFrame:
    """row (its key), n_shingles, component (the key that stays): one row per document."""
    share = threshold / 100
    least = max(0, int(TOKENS * share - 5 * (TOKENS * share * (1 - share)) ** 0.5))
    narrow = documents.select(row_key().alias("row"), "text")
    signed = stored(
        narrow.mapInArrow(
            _signatures(WIDTH, TOKENS, seed),
            f"row {KEY}, n long, h1 long, h2 long, sig array<int>, tokens binary",
        ),
        "signatures",
    )
    classes = stored(
        signed.filter("n > 0").groupBy("h1", "h2", "n")
        .agg(F.min_by(F.struct("row", "sig", "tokens"), "row").alias("first"))
        .select("h1", "h2", "n", F.col("first.row").alias("rep"), "first.sig", "first.tokens"),
        "classes",
    )
    leaves = _leaves(classes, trees, levels, small)
    pairs = stored(_candidates(leaves, classes, threshold, least, small), "pairs")
    clusters = components(pairs)
    wanted = clusters.select(F.col("node").alias("w"))
    # rows of one key have one text
    texts = stored(
        narrow.join(wanted.hint("merge"), narrow["row"] == wanted["w"], "left_semi")
        .groupBy(F.col("row").alias("rep")).agg(F.min("text").alias("text")),
        "texts",
    )
    links = stored(_confirmed(pairs, texts, threshold), "links")
    parts = components(links)
    more = stored(_settled(clusters, parts, classes, texts, threshold, least, small), "links")
    if not more.isEmpty():
        parts = components(links.union(more))
    labels = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("h1").alias("l1"), F.col("h2").alias("l2"), F.col("n").alias("ln"),
        F.coalesce("component", "rep").alias("label"),
    )
    rows = signed.select("row", "n", "h1", "h2")
    same = (rows["h1"] == labels["l1"]) & (rows["h2"] == labels["l2"]) & (rows["n"] == labels["ln"])
    component = F.when(F.col("n") == 0, F.col("row")).otherwise(F.col("label"))
    return rows.join(labels, same, "left").select(
        "row", F.col("n").alias("n_shingles"), component.alias("component")
    )


def near_duplicates(documents: DataFrame, threshold: int = 85, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id): one row per document."""
    return _verdicts(documents, threshold, **options).select(
        key_doc_id(F.col("row")).alias("doc_id"), "n_shingles",
        key_doc_id(F.col("component")).alias("component_id"),
        key_doc_id(F.col("row")).eqNullSafe(key_doc_id(F.col("component"))).alias("kept"),
    )


def keep_documents(documents: DataFrame, threshold: int = 80) -> DataFrame:
    """One document of each component, with its own columns.  Rows equal in doc_id and text are one;
    rows without a doc_id and without words all stay."""
    ids = _verdicts(documents, threshold).filter("row = component").select(
        F.col("row").alias("kept_row")
    ).distinct()
    bare = F.trim(F.coalesce(F.col("text"), F.lit("")), F.lit(SEPARATORS)) == ""
    rows = documents.select(
        F.struct("*").alias("doc"), row_key().alias("r"),
        (F.col("doc_id").isNull() & bare).alias("alone"),
    )
    kept = rows.filter("NOT alone").join(ids, rows["r"] == ids["kept_row"], "left_semi")
    first = kept.groupBy("r").agg(F.first("doc").alias("doc"))
    return first.select("doc.*").union(rows.filter("alone").select("doc.*"))

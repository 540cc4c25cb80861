"""Mixing sources to target weights: packed blocks, drawn per output shard, joined by index.

1. Each source's documents, in a seeded pseudorandom order, form one stream of words; the stream
   is packed into blocks of `block` words (the last one is short).
2. A source's target is its weight's share of all words, stopped at `most` times its own size; what
   is cut off is shared again by weight.
3. A source is read in epochs.  Every whole epoch takes each block once; the last epoch takes
   the first blocks of a keyed permutation of the source's block numbers, and the last of these
   only in part, so a source's taken words meet its (rounded) target.
4. Output slots are the draws of all sources, permuted and cut into shards of `shard_slots`: each
   shard's counts per source are a multinomial draw, given the totals (drawing each shard alone
   would leave the totals to chance).
5. Draws and blocks meet by (source, block number).

The permutation is a Feistel network over a x a >= n with cycle walking: at most a*a - n values lie
outside 0 .. n-1, so that many steps always suffice, and only values outside walk at all.

DataFrame functions only.  A source's stream is cut into buckets by order key; offsets come from
bucket sums and a sum within a bucket, so no task holds a whole source.

Null text and texts without words have size 0: never taken.  A null source is a source and comes
last.  Rows that repeat count as often as they occur.  Empty tables give empty results.  Other
columns travel inside one struct.

Words are counted once: what is known of a row without its text goes to the shared folder, and all
but the mixed texts themselves is made from there (columns of types that Parquet does not hold
have to be left out before).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenkeel.llm.common import let, n_words, stored, words

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
BUCKETS = 1024
CHUNK = 1 << 14
ROUNDS = 4


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def permuted(i: Column, n: Column, *salt) -> Column:
    """The place of i in a pseudorandom permutation of 0 .. n-1 (n at least 1, below 2^62)."""
    keys = [s if isinstance(s, Column) else F.lit(s) for s in salt]

    def step(x: Column, side: Column) -> Column:
        right = x % side
        left = F.call_function("div", x - right, side)
        for r in range(ROUNDS):
            f = F.pmod(F.xxhash64(right, F.lit(r), *keys), side)
            left, right = right, (left + f) % side
        return left * side + right

    def whole(side: Column) -> Column:
        def walk(x: Column) -> Column:
            outside = F.aggregate(
                F.sequence(_long(0), side * side - n),
                x,
                lambda v, _: F.when(v < n, v).otherwise(let(v, lambda y: step(y, side))),
            )
            return F.when(x < n, x).otherwise(outside)

        return let(step(_long(i), side), walk)

    return let(_long(F.ceil(F.sqrt(n.cast("double")))), lambda a: whole(F.greatest(a, _long(1))))


def sources(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, weight, target; one row per source (sizes: source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = per.withColumn(
        "weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights))
    )
    # fill up: sources stop in the order of cap over weight
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything)
        - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / F.sum("weight").over(rest)
    cap = most * F.col("source_size")
    leveled = ranked.select(
        "*", level.cast("double").alias("_level"), F.row_number().over(fill).alias("_rank")
    )
    first_open = F.min(
        F.when(
            F.col("_level") * F.col("weight") <= cap, F.struct(F.col("_rank"), F.col("_level"))
        )
    ).over(everything)
    return leveled.withColumn("_open", first_open["_level"]).select(
        "source", "source_size", "weight",
        F.coalesce(F.least(F.col("_open") * F.col("weight"), cap.cast("double")), F.lit(0.0))
        .alias("target"),
    )


def placed(rows: DataFrame, seed: int, sizes: DataFrame | None = None) -> DataFrame:
    """Add start: where a row's words begin in its source's stream (rows: doc, source, size, key;
    sizes: the same rows without doc, where that is costly to read)."""
    order = F.xxhash64("key", F.lit(seed))
    bucket = F.pmod(F.shiftright(order, 20), F.lit(BUCKETS)).alias("_bucket")
    cut = rows.select("*", order.alias("_order"), bucket)
    bare = cut if sizes is None else sizes.select("source", "size", bucket)
    sums = bare.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sums = sums.select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy("source", "_bucket").orderBy("_order", "key", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # a filter before the window, also one on null buckets, would read and count the text again
    inner = cut.withColumn("_inner", F.coalesce(F.sum("size").over(within), F.lit(0))).filter("size > 0")
    same = inner["source"].eqNullSafe(sums["_s"]) & inner["_bucket"].eqNullSafe(sums["_b"])
    return inner.join(sums, same).withColumn("start", F.col("_before") + F.col("_inner")).drop(
        "_order", "_bucket", "_s", "_b", "_before", "_inner"
    )


def draws(per_source: DataFrame, block: int, seed: int, shard_slots: int) -> DataFrame:
    """source, block_no, epoch, take (words from the block's front), shard, slot."""
    size, want = F.col("source_size"), F.round("target").cast("long")
    blocks = F.ceil(size / block).cast("long")
    shape = (
        per_source.filter("source_size > 0 AND round(target) > 0")
        .select("source", size.alias("size"), blocks.alias("blocks"), want.alias("want"))
        .withColumn("epochs", F.expr("want div size"))
        .withColumn("left", F.expr("want % size"))
        .withColumn("part", F.ceil(F.col("left") / block).cast("long"))
        .withColumn("n", F.expr("epochs * blocks + part"))
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    shape = shape.select(
        "*",
        F.coalesce(F.sum("n").over(by_name), F.lit(0)).alias("first"),
        F.sum("n").over(Window.partitionBy()).alias("all"),
    )
    chunks = shape.select(
        "*", F.explode(F.sequence(_long(0), F.col("n") - 1, _long(CHUNK))).alias("c")
    ).repartition("source", "c")
    each = chunks.select(
        "*",
        F.explode(
            F.sequence(F.col("c"), F.least(F.col("c") + CHUNK, F.col("n")) - 1)
        ).alias("j"),
    ).withColumn("epoch", F.expr("j div blocks")).withColumn("i", F.expr("j % blocks"))
    # the short block stays at the end of every epoch, so that a part of one is exact
    full = F.col("blocks") - 1
    block_no = F.when(F.col("i") >= full, full).otherwise(
        permuted(F.col("i"), F.greatest(full, _long(1)), F.col("source"), F.col("epoch"), seed)
    )
    length = F.least(_long(block), F.col("size") - block_no * block)
    each = each.withColumn("block_no", block_no).withColumn(
        "take",
        F.when(F.col("epoch") < F.col("epochs"), length).otherwise(
            F.least(length, F.col("left") - F.col("i") * block)
        ),
    )
    place = permuted(F.col("first") + F.col("j"), F.col("all"), "slots", seed)
    return each.withColumn("_place", place).select(
        "source", "block_no", "epoch", "take",
        F.expr(f"_place div {shard_slots}").alias("shard"),
        (F.col("_place") % shard_slots).alias("slot"),
    )


def _rows(documents: DataFrame, with_text: bool) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in documents.columns if with_text or c != "text"]
    return documents.select(
        F.struct(*kept).alias("doc"), "source", n_words(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "source", "text").alias("key"),
    )


def pieces(
    documents: DataFrame, weights=WEIGHTS, most: int = 3, block: int = BLOCK_WORDS,
    seed: int = 11, shard_slots: int = SHARD_SLOTS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows without their texts, the sources with their targets, and what is taken:
    source, start, epoch, shard, slot, from, words (from: word number within the document)."""
    rows = stored(_rows(documents, with_text=False), "sizes")
    narrow = rows.select("source", "size", "key")
    per_source = stored(sources(narrow, weights, most), "targets")
    spans = placed(narrow, seed)
    last = F.col("start") + F.col("size") - 1
    spread = spans.select(
        "source", "start", "size",
        F.explode(
            F.sequence(F.expr(f"start div {block}"), F.floor(last / block).cast("long"))
        ).alias("block_no"),
    )
    drawn = draws(per_source, block, seed, shard_slots)
    same = spread["source"].eqNullSafe(drawn["source"]) & (spread["block_no"] == drawn["block_no"])
    begin = F.greatest(F.col("start"), spread["block_no"] * block)
    end = F.least(F.col("start") + F.col("size"), spread["block_no"] * block + F.col("take"))
    taken = spread.join(drawn.hint("merge"), same).select(
        spread["source"], "start", "epoch", "shard", "slot",
        (begin - F.col("start")).alias("from"), (end - begin).alias("words"),
    ).filter("words > 0")
    return rows, per_source, taken


def mixture(documents: DataFrame, **options) -> DataFrame:
    """doc (the row without its text), size, source_size, target, taken."""
    rows, per_source, taken = pieces(documents, **options)
    seed = options.get("seed", 11)
    total = taken.groupBy("source", "start").agg(F.sum("words").alias("taken"))
    spans = placed(rows, seed)
    same = spans["source"].eqNullSafe(total["source"]) & (spans["start"] == total["start"])
    with_words = spans.join(total.hint("merge"), same, "left").select(
        "doc", spans["source"], "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    without = rows.filter("size = 0").select("doc", "source", "size", _long(0).alias("taken"))
    both = with_words.unionByName(without)
    per = per_source.withColumnRenamed("source", "_s")
    return both.join(per, both["source"].eqNullSafe(per["_s"])).select(
        "doc", "size", "source_size", "target", "taken"
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row per document and epoch with the words that it takes.  A text
    taken whole stays as it is; of others the taken words are joined by one space, and n_chars
    (where there is such a column) follows the text."""
    sizes, _, taken = pieces(documents, **options)
    rows = _rows(documents, with_text=True)
    per = taken.groupBy("source", "start", "epoch").agg(
        F.sum("words").alias("taken"),
        F.sort_array(F.collect_list(F.struct("from", "words"))).alias("parts"),
    )
    spans = placed(rows, options.get("seed", 11), sizes)
    same = spans["source"].eqNullSafe(per["source"]) & (spans["start"] == per["start"])
    cut = let(
        words(F.col("doc.text")),
        lambda w: F.array_join(
            F.flatten(
                F.transform(
                    "parts", lambda p: F.slice(w, (p["from"] + 1).cast("int"), p["words"].cast("int"))
                )
            ),
            " ",
        ),
    )
    text = F.when(F.col("taken") == F.col("size"), F.col("doc.text")).otherwise(cut)
    out = spans.join(per.hint("merge"), same).select("doc", text.alias("new_text"))
    doc = F.col("doc")
    fields = []
    for name in documents.columns:
        kind = documents.schema[name].dataType
        if name == "text":
            fields.append(F.col("new_text").alias(name))
        elif name == "n_chars":
            fields.append(F.length("new_text").cast(kind).alias(name))
        else:
            fields.append(doc[name].alias(name))
    return out.select(*fields)

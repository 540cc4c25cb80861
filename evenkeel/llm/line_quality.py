"""Quality rules: cross-document line frequency on top of base counts per document.

Lines are normalised (ASCII lower case, white space collapsed, digits to 0) and hashed.  Per host
(`source`) the distinct documents of each line are counted.  A document is known by the hash of its
whole set of lines, so that copies of one document count once and a copied document does not turn
its own lines into boilerplate; documents that differ in a line count apart.  A line above both
limits (`min_documents` and `max_share` of the host's distinct documents) is removed.  A document
is depleted, and rejected, when less than `min_left` of its words remain.

DataFrame functions only.  The text never crosses a shuffle: lines travel as hashes and word
counts, counted per map task first.  Arrays within a row are bound once (`let`), so that lambdas do
not evaluate them again.

Null text: no words, n_lines 0, base_failed.  Null source: a host of its own.  Rows that repeat a
doc_id are judged one by one, rows equal in doc_id, source and text alike.  Empty table: empty
result.  Other columns travel inside one struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.llm.common import LOWER, SEPARATORS, UPPER, WORD_GAP, let, words

SYMBOLS = "#*$%&|<>"
LIMITS = {"min_documents": 5, "max_share": 0.05, "min_left": 0.3}
INDEX_BITS = 28


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def lines(text: Column) -> Column:
    """\\n-separated lines that hold a word, as they stand."""
    return F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda x: F.trim(x, F.lit(SEPARATORS)) != "",
    )


def line_key(line: Column) -> Column:
    plain = F.translate(line, UPPER + "123456789", LOWER + "0" * 9)
    return F.md5(F.regexp_replace(F.trim(plain, F.lit(SEPARATORS)), WORD_GAP, " "))


def repeated_window_words(tokens: Column, width: int = 3) -> Column:
    """Words inside windows of `width` words that the text has twice or more.

    Windows are sorted as (hash prefix, position) numbers; neighbours that agree in the whole
    64-bit hash are repeats.  Linear memory and n log n time for any length of text.
    """

    def covered(places: Column) -> Column:
        # places ascending: each adds what does not overlap the one before
        step = F.aggregate(
            places,
            F.struct(_long(0).alias("sum"), _long(-width).alias("last")),
            lambda s, p: F.struct(
                (s["sum"] + F.least(_long(width), p - s["last"])).alias("sum"), p.alias("last")
            ),
        )
        return step["sum"]

    def repeats(hashes: Column) -> Column:
        def pick(ordered: Column) -> Column:
            def at(i: Column) -> Column:
                return F.get(ordered, i).bitwiseAND(_long((1 << INDEX_BITS) - 1))

            def same(i: Column, j: Column) -> Column:
                return F.get(hashes, at(i).cast("int")) == F.get(hashes, at(j).cast("int"))

            hits = F.filter(
                F.transform(
                    ordered,
                    lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), at(i)),
                ),
                lambda x: x.isNotNull(),
            )
            return covered(F.sort_array(F.transform(hits, lambda x: F.coalesce(x, _long(0)))))

        packed = F.sort_array(
            F.transform(
                hashes,
                lambda h, i: F.coalesce(
                    F.shiftleft(h, INDEX_BITS).bitwiseOR(i.cast("long")), _long(0)
                ),
            )
        )
        return let(packed, pick)

    def windows(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - width),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]),
        )
        # all windows different is the common case and needs no sort
        return let(
            grams,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), _long(0)).otherwise(
                repeats(h)
            ),
        )

    return let(tokens, lambda w: F.when(F.size(w) < width, _long(0)).otherwise(windows(w)))


def base_columns(text: Column) -> dict[str, Column]:
    full = F.coalesce(text, F.lit(""))
    stats = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_window_words(w).alias("n_repeat_words"),
        ),
    )
    dup = let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {
        "stats": stats,
        "word_chars": F.length(F.translate(full, SEPARATORS, "")).cast("long"),
        "n_symbols": (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": dup.cast("long"),
    }


def frequent_lines(
    documents: DataFrame, min_documents: int, max_share: float
) -> DataFrame:
    """source, line: hashes of the lines above both limits."""
    keys = F.transform(lines(F.col("text")), line_key)
    # documents without lines have no key and do not count
    keyed = documents.select(
        "source", F.sort_array(F.array_distinct(keys)).alias("keys")
    ).select("source", "keys", F.when(F.size("keys") > 0, F.xxhash64("keys")).alias("document"))
    hosts = (
        keyed.select("source", "document").distinct()
        .groupBy("source").agg(F.count("document").alias("host_documents"))
    )
    counts = (
        keyed.select("source", F.explode("keys").alias("line"), "document").distinct()
        .groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > min_documents)
    )
    same_host = counts["source"].eqNullSafe(hosts["source"])
    return counts.join(hosts, same_host).filter(
        F.col("n") > max_share * F.col("host_documents")
    ).select(counts["source"], "line")


def _fingerprint() -> Column:
    return F.xxhash64("source", "text")


def removed_words(documents: DataFrame, limits: dict) -> DataFrame:
    """r_id, r_print, removed: words in frequent lines, for documents that have such lines."""
    frequent = frequent_lines(documents, limits["min_documents"], limits["max_share"])
    each = F.transform(
        lines(F.col("text")),
        lambda x, i: F.struct(
            i.alias("at"), line_key(x).alias("line"), F.size(words(x)).alias("n")
        ),
    )
    parts = documents.select(
        "source", F.col("doc_id").alias("r_id"), _fingerprint().alias("r_print"), F.inline(each)
    )
    both = parts["source"].eqNullSafe(frequent["source"]) & (parts["line"] == frequent["line"])
    return (
        parts.join(frequent, both)
        .select("r_id", "r_print", "at", "n").distinct()  # equal rows carry the same lines
        .groupBy("r_id", "r_print").agg(F.sum("n").alias("removed"))
    )


def line_verdicts(documents: DataFrame, limits: dict | None = None) -> DataFrame:
    """doc (the row as it came), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    removed_words, base_failed, kept."""
    limits = LIMITS | (limits or {})
    counted = documents.select(
        F.struct("*").alias("doc"),
        F.col("doc_id").alias("d_id"),
        _fingerprint().alias("d_print"),
        *[c.alias(n) for n, c in base_columns(F.col("text")).items()],
    )
    lost = removed_words(documents, limits)
    same = (counted["d_print"] == lost["r_print"]) & counted["d_id"].eqNullSafe(lost["r_id"])
    n, repeated = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    failed = (n < 50) | (100 * repeated > 50 * n)
    gone = F.coalesce(F.col("removed"), _long(0))
    return counted.join(lost, same, "left").select(
        "doc", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        repeated.alias("n_repeat_words"), gone.alias("removed_words"),
        failed.alias("base_failed"),
        (~failed & ((n - gone) >= limits["min_left"] * n)).alias("kept"),
    )


def keep_documents(documents: DataFrame, limits: dict | None = None) -> DataFrame:
    """The documents that pass, as they came."""
    return line_verdicts(documents, limits).filter("kept").select("doc.*")

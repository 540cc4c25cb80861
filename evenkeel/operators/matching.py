"""Column and table matching over catalogs.

Catalog frames have ``table, ordinal, name, type``.  Candidate search never pairs every
source row with every target row: the names of a table are packed into bounded chunks, every
source name meets each chunk of its table once, keeps its best few names of the chunk, and
the chunk winners are ranked.  All names are scored, so the result is exact, and a table
with very many columns is spread over its chunks.  A schema has far more tables than a table has
columns: table names are searched in tries (``operators.nearest``), with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evenkeel import fixed_values as fv
from evenkeel.functions import names as nm
from evenkeel.functions.binding import filled
from evenkeel.functions.rounding import round_even
from evenkeel.operators.nearest import nearest_cells
from evenkeel.operators.windows import top_per_key

#: target names scored together in one row, and source rows of one slice
CHUNK_NAMES = 64
SLICE_ROWS = 1024
#: target tables of one trie, and source tables that search it in one task
CHUNK_TABLES = 1 << 16
SLICE_TABLES = 1024


# --- exact matching ------------------------------------------------------------------------


def exact_match(
    source: DataFrame, target: DataFrame, configured: DataFrame | None = None
) -> DataFrame:
    """Best exact partner of every source column, or NULL.

    Order of precedence: configured pair (``table, source_column, target_column``), same name
    ignoring case, same name key.  Among target columns whose names differ in case only the
    last one counts; among equal name keys the first.
    """
    partner = F.struct(
        F.col("name").alias("name"), F.col("type").alias("type"), F.col("ordinal").alias("ordinal")
    )

    def probe(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    key = nm.name_key(F.col("name"))
    known = (
        target.select(
            "table", partner.alias("partner"),
            F.inline(F.array(probe("name", F.upper("name")), probe("key", key))),
        )
        .groupBy("table", "kind", "key")
        .agg(
            F.max_by("partner", "partner.ordinal").alias("last"),
            F.min_by("partner", "partner.ordinal").alias("first"),
        )
        .select(
            "table", "kind", "key",
            F.when(F.col("kind") == "name", F.col("last")).otherwise(F.col("first"))
            .alias("partner"),
        )
    )
    if configured is None:
        rows = source.withColumn("wish", F.lit(None).cast("string"))
    else:
        wishes = configured.groupBy("table", F.upper("source_column").alias("u_name")).agg(
            F.max(F.upper("target_column")).alias("wish")
        )
        rows = source.withColumn("u_name", F.upper("name")).join(
            wishes, ["table", "u_name"], "left"
        )
    probes = rows.select(
        "table", "ordinal", "name", "type",
        F.posexplode(
            F.array(
                probe("name", F.col("wish")), probe("name", F.upper("name")), probe("key", key)
            )
        ).alias("way", "probe"),
    ).select("table", "ordinal", "name", "type", "way", "probe.*")
    hit = F.when(F.col("partner").isNotNull(), F.col("way"))
    return (
        probes.join(known, ["table", "kind", "key"], "left")
        .groupBy("table", "ordinal", "name", "type")
        .agg(F.min_by("partner", hit).alias("p"), F.min(hit).alias("way"))
        .select(
            "table",
            "ordinal",
            F.col("name").alias("source_column"),
            F.col("type").alias("source_type"),
            F.col("p.name").alias("target_column"),
            F.col("p.type").alias("target_type"),
            F.col("p.ordinal").alias("target_ordinal"),
            F.when(F.col("way") == 0, "configured")
            .when(F.col("way") == 1, "exact")
            .when(F.col("way") == 2, "normalized_exact")
            .alias("match_method"),
        )
    )


def unmatched_targets(matches: DataFrame, target: DataFrame) -> DataFrame:
    taken = matches.filter(F.col("target_column").isNotNull()).select(
        "table", F.upper("target_column").alias("u_name")
    )
    return (
        target.withColumn("u_name", F.upper("name"))
        .join(taken, ["table", "u_name"], "left_anti")
        .drop("u_name")
    )


# --- candidate search -------------------------------------------------------------------------


def _meet_chunks(
    source: DataFrame, target: DataFrame, block: str, entry: Column, how: str = "inner"
) -> DataFrame:
    """Every source row next to every chunk of target entries of its block.

    The block is cut into a grid: targets are packed into ``entries`` arrays of about
    CHUNK_NAMES, sources into slices of about SLICE_ROWS, and rows meet on (block, chunk,
    slice).  A cell is a bounded amount of work however large the block is.  Chunk and slice
    are picked by a hash of the whole row, so equal names spread as well.  With ``how="left"``
    source rows of a block without targets stay, with ``entries`` NULL.

    Scoring costs far more than reading, so the number of partitions is fixed here: adaptive
    execution would merge the cells by their few bytes.
    """
    cells = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = [block, "chunk", "slice"]
    chunks_of = target.groupBy(block).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(float(CHUNK_NAMES))).cast("long").alias("chunks")
    )
    sizes = (
        source.groupBy(block)
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(float(SLICE_ROWS))).cast("long").alias("slices"))
        .join(chunks_of, block, how)
    )
    packed = (
        target.select(block, entry.alias("entry"))
        .join(sizes, block)
        .withColumn("chunk", F.pmod(F.xxhash64("entry"), F.col("chunks")))
        .groupBy(block, "chunk", "slices")
        .agg(F.collect_list("entry").alias("entries"))
        .withColumn("slice", F.explode(F.sequence(_long(0), F.col("slices") - 1)))
        .drop("slices")
    )
    whole_row = F.xxhash64(*[F.col(c) for c, t in source.dtypes if not t.startswith("map")])
    last = F.coalesce(F.col("chunks"), _long(1)) - 1
    asked = (
        source.join(sizes, block)
        .withColumn("slice", F.pmod(whole_row, F.col("slices")))
        .withColumn("chunk", F.explode(F.sequence(_long(0), last)))
        .drop("chunks", "slices")
    )
    return asked.repartition(cells, *grid).join(packed.repartition(cells, *grid), grid, how)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def fuzzy_candidates(
    source: DataFrame, target: DataFrame, top_n: int = fv.CANDIDATES_PER_COLUMN,
    keep_lonely: bool = False,
) -> DataFrame:
    """The ``top_n`` most similar target columns of every source column of the same table.

    Ties go to the lower target ordinal.  Source columns of tables without target columns have
    no rows, or with ``keep_lonely`` one row without a target.
    """
    entry = F.struct(
        F.col("ordinal").alias("ordinal"), F.col("name").alias("name"),
        F.col("type").alias("type"), nm.name_key(F.col("name")).alias("key"),
        nm.char_codes(nm.name_key(F.col("name"))).alias("codes"),
    )
    asked = source.select(
        "table", F.col("ordinal"), F.col("name").alias("source_column"),
        F.col("type").alias("source_type"), nm.name_key(F.col("name")).alias("source_key"),
    ).withColumn("bits", nm.name_bits(F.col("source_key")))
    met = _meet_chunks(asked, target, "table", entry, "left" if keep_lonely else "inner")
    scored = F.transform(
        "entries",
        lambda e: F.struct(
            (
                -nm.similarity(F.col("source_key"), e["key"], F.col("bits"), e["codes"])
            ).alias("minus"),
            e["ordinal"].alias("ordinal"), e["name"].alias("name"), e["type"].alias("type"),
            e["key"].alias("key"),
        ),
    )
    winners = met.select(
        "table", "ordinal", "source_column", "source_type", "source_key",
        (F.explode_outer if keep_lonely else F.explode)(
            F.slice(F.array_sort(scored), 1, top_n)
        ).alias("w"),
    ).select(
        "table", "ordinal", "source_column", "source_type", "source_key",
        F.col("w.name").alias("target_column"), F.col("w.type").alias("target_type"),
        F.col("w.key").alias("target_key"), F.col("w.ordinal").alias("target_ordinal"),
        (-F.col("w.minus")).alias("fuzzy_score"),
    )
    return top_per_key(
        winners, ["table", "ordinal", "source_column"],
        [F.desc_nulls_last("fuzzy_score"), F.asc("target_ordinal"), F.asc("target_column")],
        top_n, rank="candidate_rank",
    )


# --- decisions -----------------------------------------------------------------------------------


def learned_pairs(learned: DataFrame) -> DataFrame:
    return (
        learned.select(
            F.upper("source_column").alias("u_source"), F.upper("target_column").alias("u_target")
        )
        .filter((F.col("u_source") != "") & (F.col("u_target") != ""))
        .distinct()
    )


def score_candidates(
    candidates: DataFrame, table_sizes: DataFrame, learned: DataFrame | None = None
) -> DataFrame:
    """Confidence and its factors for candidate pairs.

    ``table_sizes`` has ``table, total_columns`` (the larger side of the table).
    """
    rows = candidates.join(table_sizes, ["table"])
    if learned is None:
        rows = rows.withColumn("learned_example", F.lit(0.0))
    else:
        seen = learned_pairs(learned).withColumn("learned_example", F.lit(1.0))
        rows = (
            rows.withColumn("u_source", F.upper("source_column"))
            .withColumn("u_target", F.upper("target_column"))
            .join(seen, ["u_source", "u_target"], "left")
            .withColumn("learned_example", F.coalesce("learned_example", F.lit(0.0)))
            .drop("u_source", "u_target")
        )
    rows = rows.withColumn(
        "type_compatibility", nm.type_compatibility(F.col("source_type"), F.col("target_type"))
    ).withColumn(
        "position_proximity",
        nm.position_proximity(F.col("ordinal"), F.col("target_ordinal"), F.col("total_columns")),
    )
    return rows.withColumn(
        "confidence",
        nm.confidence(
            F.col("fuzzy_score"), F.col("type_compatibility"), F.col("position_proximity"),
            F.col("learned_example"),
        ),
    ).withColumn(
        "reason",
        nm.confidence_reason(
            F.col("source_key"), F.col("target_key"), F.col("source_type"),
            F.col("target_type"), F.col("fuzzy_score"), F.col("type_compatibility"),
            F.col("learned_example"),
        ),
    )


def table_sizes(source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns of the larger side per table."""
    both = source.select("table", F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(
        target.select("table", F.lit(0).alias("s"), F.lit(1).alias("t"))
    )
    return both.groupBy("table").agg(
        F.greatest(F.sum("s"), F.sum("t"), F.lit(1)).alias("total_columns")
    )


def match_columns(
    source: DataFrame,
    target: DataFrame,
    configured: DataFrame | None = None,
    learned: DataFrame | None = None,
    high: float = fv.HIGH_CONFIDENCE,
    review: float = fv.REVIEW_CONFIDENCE,
) -> DataFrame:
    """One decision per source column.

    Exact partners are resolved.  The best fuzzy candidate is resolved above ``high``,
    accepted with ``needs_review`` above ``review`` and rejected below.  Load-metadata columns
    are resolved and skipped.  The mapping columns follow ``plans.mapping.MAPPING_SCHEMA``.
    """
    is_metadata = F.lower(F.col("name")).startswith(fv.LOAD_METADATA_PREFIX)
    regular = source.filter(~is_metadata)
    exact = exact_match(regular, target, configured)
    left_over = unmatched_targets(exact, target)
    open_columns = exact.filter(F.col("target_column").isNull()).select(
        "table", "ordinal", F.col("source_column").alias("name"),
        F.col("source_type").alias("type"),
    )
    best = fuzzy_candidates(open_columns, left_over, top_n=1, keep_lonely=True)
    scored = score_candidates(best, table_sizes(source, target), learned)
    found = F.col("target_column").isNotNull()
    accepted = found & (F.col("confidence") >= review)
    none = F.lit(None).cast("string")

    resolved = exact.filter(found).select(
        "table", "ordinal", "source_column", "source_type", "target_column", "target_type",
        "match_method", F.lit(0.0).alias("fuzzy_score"), F.lit(1.0).alias("confidence"),
        F.lit("resolved").alias("decision"), F.lit(False).alias("needs_review"),
        F.lit(False).alias("skip"), none.alias("skip_reason"),
        filled(fv.MATCHED_BY, method=F.col("match_method")).alias("reason"),
    )
    below = filled(
        fv.BELOW_THRESHOLD, score=round_even(F.col("confidence"), 2), least=F.lit(f"{review:.2f}")
    )
    fuzzy = scored.select(
        "table", "ordinal", "source_column", "source_type",
        F.when(accepted, F.col("target_column")).alias("target_column"),
        F.when(accepted, F.col("target_type")).alias("target_type"),
        F.when(accepted, F.lit("fuzzy")).alias("match_method"),
        F.coalesce("fuzzy_score", F.lit(0.0)).alias("fuzzy_score"),
        F.when(found, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(accepted, "resolved").otherwise("unmatched").alias("decision"),
        (accepted & (F.col("confidence") < high)).alias("needs_review"),
        (~accepted).alias("skip"),
        F.when(found & ~accepted, below)
        .when(~found, F.lit(fv.NO_CANDIDATE))
        .alias("skip_reason"),
        F.when(found, F.col("reason")).alias("reason"),
    )
    metadata = source.filter(is_metadata).select(
        "table", "ordinal", F.col("name").alias("source_column"),
        F.col("type").alias("source_type"), none.alias("target_column"),
        none.alias("target_type"), none.alias("match_method"),
        F.lit(0.0).alias("fuzzy_score"), F.lit(0.0).alias("confidence"),
        F.lit("resolved").alias("decision"), F.lit(False).alias("needs_review"),
        F.lit(True).alias("skip"),
        F.lit(fv.METADATA_COLUMN).alias("skip_reason"),
        none.alias("reason"),
    )
    return resolved.unionByName(fuzzy).unionByName(metadata)


def key_agreement(source: DataFrame, target: DataFrame) -> DataFrame:
    """Do both sides declare the same key, by name key and order?

    Input is a catalog with ``is_key`` and ``key_ordinal``; a table without a key on a side
    has ``agrees`` NULL.  The key lists are as long as the keys.
    """

    def keys(frame: DataFrame, name: str) -> DataFrame:
        part = F.struct("key_ordinal", nm.name_key(F.col("name")).alias("key"))
        return (
            frame.filter(F.col("is_key"))
            .groupBy("table")
            .agg(F.array_join(
                F.transform(F.array_sort(F.collect_list(part)), lambda p: p["key"]), ","
            ).alias(name))
        )

    both = keys(source, "source_key").join(keys(target, "target_key"), ["table"], "full_outer")
    return both.select(
        "table", "source_key", "target_key",
        (F.col("source_key") == F.col("target_key")).alias("agrees"),
        F.when(
            F.col("source_key") != F.col("target_key"),
            filled(fv.KEYS_DIFFER, source=F.col("source_key"), target=F.col("target_key")),
        ).alias("mismatch_reason"),
    )


def conflicting_targets(mapping: DataFrame) -> DataFrame:
    """Targets claimed by several sources, and sources without a target.

    ``mapping`` has ``source_table, target_table``.
    """
    target = F.coalesce(F.trim("target_table"), F.lit(""))
    return (
        mapping.groupBy(target.alias("target_table"))
        .agg(F.count(F.lit(1)).alias("source_tables"))
        .filter((F.col("source_tables") > 1) | (F.col("target_table") == ""))
        .withColumn(
            "problem",
            F.when(F.col("target_table") == "", "empty_target").otherwise("duplicate_target"),
        )
    )


# --- table matching -----------------------------------------------------------------------------


def _tables_once(frame: DataFrame) -> DataFrame:
    """One row per schema and upper-case name, with the stored name (the first by code point)."""
    return frame.groupBy("schema", F.upper("table").alias("u_name")).agg(
        F.min("table").alias("table")
    )


def _table_cells(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt out so that every source table meets every chunk of its schema's targets.

    A schema is cut into a grid of about CHUNK_TABLES targets and SLICE_TABLES sources a cell.  The
    number of partitions is fixed, as for columns: adaptive execution would merge cells by their bytes.
    """
    cells = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parts(frame: DataFrame, size: int, name: str) -> DataFrame:
        return frame.groupBy("schema").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(float(size))).cast("long").alias(name)
        )

    sizes = parts(source, SLICE_TABLES, "slices").join(
        parts(target, CHUNK_TABLES, "chunks"), ["schema"]
    )

    def dealt(frame: DataFrame, mine: str, own: str, other: str, others: str) -> DataFrame:
        return (
            frame.join(sizes, ["schema"])
            .withColumn(own, F.pmod(F.xxhash64("table"), F.col(mine)))
            .withColumn(other, F.explode(F.sequence(_long(0), F.col(others) - 1)))
            .drop("slices", "chunks")
            .repartition(cells, "schema", "chunk", "slice")
        )

    return (dealt(source, "slices", "slice", "chunk", "chunks"),
            dealt(target, "chunks", "chunk", "slice", "slices"))


def similar_tables(
    source: DataFrame, target: DataFrame, low: float = 0.30, top_n: int = 5
) -> DataFrame:
    """Most similar target tables of every source table of the same ``schema``.

    Frames have ``schema, table``.  Names are scored as columns are: twice the longest common
    subsequence of the name keys over both lengths.  ``low`` is the least ratio.  A source table
    reads only as far into the names of its schema as they can still be among its best.
    """
    key = nm.name_key(F.col("table")).alias("key")
    asked = source.select("schema", "table", key).distinct()
    offered = _tables_once(target).select("schema", "table", key)
    if low > 0:  # an empty key scores 0
        asked, offered = (frame.filter(F.col("key") != "") for frame in (asked, offered))
    left, right = (
        frame.groupBy("schema", "chunk", "slice") for frame in _table_cells(asked, offered)
    )
    text = T.StringType()
    winners = left.cogroup(right).applyInArrow(
        nearest_cells(low, top_n),
        T.StructType([
            T.StructField("schema", source.schema["schema"].dataType),
            T.StructField("source_table", text), T.StructField("target_table", text),
            T.StructField("ratio", T.DoubleType()),
        ]),
    )
    return top_per_key(
        winners, ["schema", "source_table"], [F.desc("ratio"), F.asc("target_table")], top_n,
        rank="candidate_rank",
    ).withColumn("percent", F.floor(F.col("ratio") * 100).cast("int"))


def match_tables(
    source: DataFrame, target: DataFrame, low: float = 0.30, top_n: int = 5
) -> DataFrame:
    """Exact partner (whatever the case) at 100 %, else the most similar tables of the schema."""
    named = _tables_once(target).withColumnRenamed("table", "stored")
    asked = source.select("schema", "table").distinct().withColumn("u_name", F.upper("table"))
    probed = asked.join(named, ["schema", "u_name"], "left")
    exact = probed.filter(F.col("stored").isNotNull()).select(
        "schema", F.col("table").alias("source_table"), F.col("stored").alias("target_table"),
        F.lit(1.0).alias("ratio"), F.lit(1).alias("candidate_rank"), F.lit(100).alias("percent"),
    )
    rest = probed.filter(F.col("stored").isNull()).select("schema", "table")
    return exact.unionByName(similar_tables(rest, target, low, top_n))


def suggest_targets(source: DataFrame, target: DataFrame, confirmed: DataFrame) -> DataFrame:
    """A target per source table with how it was found.

    Confirmed, else exact, else by close names: two or more are ambiguous, one is taken, none
    is not found.  Found tables come by their stored names; a schema without any target table
    proposes the upper-case name.
    """
    latest = confirmed.select("source_table", F.col("target_table").alias("confirmed_target"))
    asked = source.select("schema", F.col("table").alias("source_table")).join(
        latest, ["source_table"], "left"
    )
    named = _tables_once(target).withColumnRenamed("table", "exact_target")
    exact = (
        asked.withColumn("u_name", F.upper("source_table"))
        .join(named, ["schema", "u_name"], "left")
        .drop("u_name")
    )
    known = target.select("schema").distinct().withColumn("has_tables", F.lit(True))
    exact = exact.join(known, ["schema"], "left")
    open_tables = exact.filter(
        F.col("confirmed_target").isNull() & F.col("exact_target").isNull()
    ).select("schema", F.col("source_table").alias("table"))
    close = (
        similar_tables(open_tables, target, low=0.4, top_n=3)
        .groupBy("schema", "source_table")
        .agg(F.count(F.lit(1)).alias("close"), F.max("target_table").alias("close_target"))
    )
    joined = exact.join(close, ["schema", "source_table"], "left")
    status = (
        F.when(F.col("confirmed_target").isNotNull(), "confirmed")
        .when(F.col("exact_target").isNotNull(), "exact")
        .when(F.col("has_tables").isNull(), "no_data")
        .when(F.col("close") >= 2, "ambiguous")
        .when(F.col("close") == 1, "fuzzy")
        .otherwise("not_found")
    )
    return joined.select("schema", "source_table", "confirmed_target", "exact_target",
                         "close_target", status.alias("status")).select(
        "schema",
        "source_table",
        F.when(F.col("status") == "confirmed", F.col("confirmed_target"))
        .when(F.col("status") == "exact", F.col("exact_target"))
        .when(F.col("status") == "no_data", F.upper("source_table"))
        .when(F.col("status") == "fuzzy", F.col("close_target"))
        .otherwise(F.lit(""))
        .alias("target_table"),
        "status",
    )


# --- learned examples --------------------------------------------------------------------------


def relevant_examples(requests: DataFrame, learned: DataFrame, top_n: int = 5) -> DataFrame:
    """The ``top_n`` learned examples most relevant to each requested column.

    ``requests``: ``request_id, name, type, target_names array, target_types array``.
    ``learned``: ``seq, source_column, target_column, source_type, target_type``.
    Score: name 10, else name key 6, else one edit apart 3; source type 2; target name 4;
    target type 2.  Ties go to the lower ``seq``.

    Requests that agree in all that scoring reads are answered once.  Examples that agree in all
    that a request can score have equal scores, so only the first ``top_n`` of such a class can be
    among the best; a name that fills the log cannot multiply.  Classes are met in four ways: by
    name and target, by name, by target, by types.  Keys one edit apart meet on their one-deletion
    forms, each pair of keys once.  Of the examples that share types only, no more than ``top_n``
    are looked at per combination of asked types.  An example is carried and scored where it is
    found, so a popular one is no key of a join.
    """
    examples = (
        learned.filter(F.col("seq").isNotNull())
        .groupBy(
            "seq", "source_column", "target_column",
            F.upper("source_type").alias("u_source_type"),
            F.upper("target_type").alias("u_target_type"),
        )
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumns({
            "u_source": F.upper("source_column"), "u_target": F.upper("target_column"),
            "key": nm.name_key(F.col("source_column")),
        })
    )

    def uppers(name: str) -> Column:
        return F.transform(F.coalesce(name, F.array().cast("array<string>")), F.upper)

    asked = requests.filter(F.col("request_id").isNotNull()).select(
        "request_id", F.upper("name").alias("r_name"), nm.name_key(F.col("name")).alias("r_key"),
        F.upper("type").alias("r_type"), uppers("target_names").alias("r_targets"),
        uppers("target_types").alias("r_target_types"),
    )
    ask = _digest("r_name", "r_key", "r_type", "r_targets", "r_target_types")
    asks = asked.drop("request_id").distinct().withColumn("ask", ask).withColumn(
        "asked_types", _digest("r_type", "r_target_types")
    )
    types = ["u_source_type", "u_target_type"]

    def firsts(*extra: str) -> DataFrame:
        return top_per_key(examples, [*extra, *types], [F.asc("seq")], top_n)

    def keys_with_forms(frame: DataFrame, key: str) -> DataFrame:
        return frame.select(key).distinct().withColumn(
            "form", F.explode(nm.one_deletion_forms(F.col(key)))
        )

    near = (
        keys_with_forms(asks, "r_key").join(keys_with_forms(examples, "key"), ["form"])
        .select("r_key", "key").distinct()
        .filter(nm.within_one_edit(F.col("key"), F.col("r_key")))
    )
    by_target = asks.withColumn("u_target", F.explode(F.array_distinct("r_targets")))
    type_score = (
        F.when(F.col("u_source_type") == F.col("r_type"), 2).otherwise(0)
        + F.when(F.array_contains("r_target_types", F.col("u_target_type")), 2).otherwise(0)
    )
    score = (
        F.when(F.col("u_source") == F.col("r_name"), 10)
        .when(F.col("key") == F.col("r_key"), 6)
        .when(nm.within_one_edit(F.col("key"), F.col("r_key")), 3)
        .otherwise(0)
        + F.when(F.array_contains("r_targets", F.col("u_target")), 4).otherwise(0)
        + type_score
    )
    ways = [
        by_target.join(near.join(firsts("key", "u_source", "u_target"), ["key"]),
                       ["r_key", "u_target"]),
        asks.join(near.join(firsts("key", "u_source"), ["key"]), ["r_key"]),
        by_target.join(firsts("u_target"), ["u_target"]),
        asks.join(_of_types(asks, firsts(), type_score, top_n), ["asked_types"]),
    ]
    example = ["seq", "source_column", "target_column", *types, "copies"]
    scored = [way.select("ask", *example, score.alias("score")) for way in ways]
    found = scored[0]
    for more in scored[1:]:
        found = found.unionByName(more)
    best = (
        top_per_key(
            found.filter(F.col("score") > 0).distinct(), ["ask"],
            [F.desc("score"), F.asc("seq")], top_n,
        )
        .groupBy("ask")
        .agg(F.collect_list(
            F.struct("seq", "source_column", "target_column", "score", "copies")
        ).alias("best"))
    )
    # an example that the log holds several times, and a request that is made several times, count
    # as often
    rows = (
        asked.select("request_id", ask.alias("ask")).join(best, ["ask"])
        .select("request_id", F.inline("best"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(top_n)).cast("int"))))
        .select("request_id", "seq", "source_column", "target_column", "score")
    )
    return top_per_key(
        rows, ["request_id"], [F.desc("score"), F.asc("seq")], top_n, rank="example_rank"
    )


def _digest(*names: str) -> Column:
    """One short value for values that are equal in all of ``names`` (256 bits)."""
    return F.sha2(F.to_json(F.struct(*names)), 256)


def _of_types(asks: DataFrame, classes: DataFrame, type_score: Column, top_n: int) -> DataFrame:
    """The best ``top_n`` examples by types alone, per combination of asked types.

    ``classes`` has the first ``top_n`` examples of every pair of types.  An example that shares no
    more than types with a request stands behind all that score as much by types and come first.
    """
    asked = asks.select("asked_types", "r_type", "r_target_types").distinct()
    wanted = asked.withColumn("u_target_type", F.explode(F.array_distinct("r_target_types")))
    of_source = top_per_key(classes, ["u_source_type"], [F.asc("seq")], top_n)
    of_target = top_per_key(classes, ["u_target_type"], [F.asc("seq")], top_n)
    found = [
        asked.withColumn("u_source_type", F.col("r_type")).join(of_source, ["u_source_type"]),
        wanted.join(of_target, ["u_target_type"]),
        wanted.withColumn("u_source_type", F.col("r_type")).join(
            classes, ["u_source_type", "u_target_type"]
        ),
    ]
    columns = ["asked_types", *classes.columns]
    either = found[0].withColumn("type_score", type_score).select(*columns, "type_score")
    for way in found[1:]:
        either = either.unionByName(
            way.withColumn("type_score", type_score).select(*columns, "type_score")
        )
    return top_per_key(
        either.distinct(), ["asked_types"], [F.desc("type_score"), F.asc("seq")], top_n
    ).select(*columns)

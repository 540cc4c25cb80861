"""Exclusion policy, skip classification and status promotion."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenkeel import fixed_values as fv
from evenkeel.functions.binding import contains_any, filled, let, matches_any
from evenkeel.schema import schema

BOTH = ("source", "target")
TABLE_RULE_SCHEMA = schema(
    "table string, source_db string, column_name string, applies_to array<string>, "
    "reason string, seq int"
)


# --- exclusion policy ----------------------------------------------------------------------


@dataclass
class ExclusionPolicy:
    """Layered exclusion rules.

    The layers that come from a hand-written policy file (types, databases, compliance,
    patterns, names) are a few dozen literals and become one expression.  Table-specific
    rules may be generated for a whole warehouse, so they are a DataFrame and are joined.
    """

    table_rules: list[tuple] = field(default_factory=list)
    layers: list[tuple[str, str, Column, Column, tuple[str, ...], Column]] = field(
        default_factory=list
    )
    # layer, pattern and reason of rules whose pattern the engine does not take
    rejected: list[tuple[str, str, str]] = field(default_factory=list)

    @classmethod
    def default(cls) -> "ExclusionPolicy":
        return cls.from_config(fv.DEFAULT_POLICY)

    @classmethod
    def from_config(cls, config: dict) -> "ExclusionPolicy":
        policy = cls()
        policy._add_tables(config.get("table_specific_exclusions", {}))
        policy._add_types(config.get("type_based_exclusions", {}).get("rules", []))
        policy._add_databases(config.get("database_specific_exclusions", {}))
        policy._add_compliance(config.get("compliance_exclusions", {}))
        policy._add_patterns(config.get("pattern_exclusions", {}).get("patterns", []))
        policy._add_names(
            [
                *config.get("global_exclusions", {}).get("columns", []),
                *config.get("user_global_exclusions", []),
            ]
        )
        return policy

    def _add_tables(self, tables: dict) -> None:
        seq = 0
        for table, entry in tables.items():
            if table == "description":
                continue
            for rule in entry.get("exclusions", []):
                names = [
                    rule.get("column_name", ""),
                    *rule.get("source_column_names", []),
                    *rule.get("target_column_names", []),
                ]
                for name in filter(None, names):
                    self.table_rules.append(
                        (
                            table, entry.get("source_database"), name,
                            list(rule.get("applies_to", BOTH)),
                            rule.get("reason", "Table-specific exclusion"), seq,
                        )
                    )
                    seq += 1

    def _layer(self, rule_type, rule_name, hit, applies_to, reason) -> None:
        self.layers.append((rule_type, rule_name, hit, tuple(applies_to), F.lit(reason)))

    def _add_types(self, rules: list[dict]) -> None:
        for rule in rules:
            if not rule.get("enabled", True):
                continue
            hit = F.lower("source_type").isin(
                [t.lower() for t in rule.get("source_types", [])]
            ) & F.upper("target_type").isin([t.upper() for t in rule.get("target_types", [])])
            if "source_database" in rule:
                hit = hit & (F.lower("source_db") == rule["source_database"].lower())
            name = F.concat_ws("→", "source_type", "target_type")
            # a type pair is excluded whatever side is asked about
            self._layer("type_based", name, hit, ("any",),
                        rule.get("reason", "Type-based exclusion"))

    def _add_databases(self, databases: dict) -> None:
        for db, rules in databases.items():
            if db == "description":
                continue
            here = F.lower("source_db") == db.lower()
            for rule in rules:
                sides = rule.get("applies_to", ["source"])
                if "column_name" in rule:
                    hit = F.upper("column_name") == rule["column_name"].upper()
                    self._layer(
                        "database_specific", F.concat(F.lit(db + "."), "column_name"), here & hit,
                        sides, rule.get("reason", f"{db} specific exclusion"),
                    )
                if self._usable("database_specific_pattern", rule.get("pattern")):
                    self._layer(
                        "database_specific_pattern", F.lit(rule["pattern"]),
                        here & _at_start(F.col("column_name"), rule["pattern"]), sides,
                        rule.get("reason", f"{db} pattern exclusion"),
                    )

    def _add_compliance(self, categories: dict) -> None:
        for category, rule in categories.items():
            if category == "description" or not rule.get("enabled", False):
                continue
            for pattern in rule.get("patterns", []):
                if not self._usable("compliance", pattern):
                    continue
                self._layer(
                    "compliance", F.lit(category), F.col("column_name").rlike(f"(?i){pattern}"),
                    rule.get("applies_to", BOTH), rule.get("reason", f"{category} compliance"),
                )

    def _add_patterns(self, patterns: list[dict]) -> None:
        for rule in patterns:
            if self._usable("pattern", rule.get("pattern")):
                self._layer(
                    "pattern", F.lit(rule["pattern"]),
                    _at_start(F.col("column_name"), rule["pattern"]),
                    rule.get("applies_to", BOTH), rule.get("reason", "Pattern-based exclusion"),
                )

    def _add_names(self, columns: list[dict]) -> None:
        for rule in columns:
            self._layer(
                "global", F.col("column_name"),
                F.upper("column_name") == rule.get("column_name", "").upper(),
                rule.get("applies_to", BOTH), rule.get("reason", "Global exclusion"),
            )


    def _usable(self, layer: str, pattern: str | None) -> bool:
        """Whether the engine that runs the pattern takes it; a rejected one is kept with the reason.

        The pattern is folded as a constant while its query is planned, so no job runs.
        """
        if not pattern:
            return False
        try:
            plan = SparkSession.active().sql("SELECT '' RLIKE :p AS hit", args={"p": pattern})
            plan._jdf.queryExecution().optimizedPlan()
        except PySparkException as e:
            reason = _reason(e)
            self.rejected.append((layer, pattern, reason))
            warnings.warn(f"exclusion pattern {pattern!r} is left out: {reason}", stacklevel=2)
            return False
        return True

    def rejected_rules(self, spark: SparkSession) -> DataFrame:
        """layer, pattern, reason of the rules that were left out."""
        return spark.createDataFrame(self.rejected, schema("layer string, pattern string, reason string"))


def _reason(error: Exception) -> str:
    return str(error).strip().splitlines()[0]


def _at_start(c: Column, pattern: str) -> Column:
    return matches_any(c, [pattern], at_start=True)


def decide_exclusions(
    columns: DataFrame,
    policy: ExclusionPolicy,
    applies_to: str = "both",
    table_rules: DataFrame | None = None,
) -> DataFrame:
    """Decision per column: ``excluded, reason, rule_type, rule_name``.

    ``columns``: ``table, column_name, source_type, target_type, source_db``.  The first layer
    that hits wins: table, type pair, database, compliance, pattern, name.  ``table_rules``
    (``TABLE_RULE_SCHEMA``) adds generated rules to those of the policy.
    """
    spark = columns.sparkSession
    generated = spark.createDataFrame(policy.table_rules, TABLE_RULE_SCHEMA)
    if table_rules is not None:
        shift = F.lit(len(policy.table_rules))
        generated = generated.unionByName(
            table_rules.select(*TABLE_RULE_SCHEMA.names[:-1], (F.col("seq") + shift).alias("seq"))
        )
    if applies_to != "both":
        generated = generated.filter(F.array_contains("applies_to", applies_to))
    # one row per (table, database or any, column)
    first = generated.groupBy(
        F.upper("table").alias("u_table"), F.upper("column_name").alias("u_column"),
        F.coalesce(F.lower("source_db"), F.lit("*")).alias("rule_db"),
    ).agg(F.min_by("reason", "seq").alias("reason"), F.min("seq").alias("seq"))
    any_db = first.filter(F.col("rule_db") == "*").select(
        "u_table", "u_column", F.struct("seq", "reason").alias("any_rule")
    )
    one_db = first.filter(F.col("rule_db") != "*").select(
        "u_table", "u_column", F.col("rule_db").alias("l_db"),
        F.struct("seq", "reason").alias("db_rule"),
    )
    asked = (
        columns.withColumn("u_table", F.upper("table"))
        .withColumn("u_column", F.upper("column_name"))
        .withColumn("l_db", F.lower("source_db"))
        .join(any_db, ["u_table", "u_column"], "left")
        .join(one_db, ["u_table", "u_column", "l_db"], "left")
        .withColumn("table_rule", F.least("any_rule", "db_rule"))
    )

    def decision(rule_type: str, rule_name: Column, reason: Column) -> Column:
        return F.struct(
            reason.alias("reason"), F.lit(rule_type).alias("rule_type"),
            rule_name.alias("rule_name"),
        )

    chain = [
        F.when(
            F.col("table_rule").isNotNull(),
            decision("table_specific", F.concat_ws(".", "table", "column_name"),
                     F.col("table_rule.reason")),
        )
    ]
    for rule_type, rule_name, hit, sides, reason in policy.layers:
        if applies_to == "both" or "any" in sides or applies_to in sides:
            chain.append(F.when(hit, decision(rule_type, rule_name, reason)))
    return asked.withColumn("d", F.coalesce(*chain)).select(
        *columns.columns,
        F.col("d").isNotNull().alias("excluded"),
        F.coalesce("d.reason", F.lit("")).alias("reason"),
        F.coalesce("d.rule_type", F.lit("")).alias("rule_type"),
        F.coalesce("d.rule_name", F.lit("")).alias("rule_name"),
    )


# --- columns of one side only ----------------------------------------------------------------


def target_only_category(name: Column) -> Column:
    """Struct ``category, reason`` of a column that only the target has."""

    def kind(category: str, reason: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))

    chain = [
        F.when(matches_any(name, patterns, at_start=True), kind(category, reason))
        for category, reason, patterns in fv.TARGET_ONLY
    ]
    return F.coalesce(*chain, kind(*fv.TARGET_ONLY_OTHER))


def generated_rules(presence: DataFrame, source_db: str = "postgresql") -> DataFrame:
    """Exclusion rules for the one-sided columns of a schema presence result.

    The result fits ``table_rules`` of :func:`decide_exclusions`, plus the category.
    """
    target = F.col("presence") == "target_only"
    return presence.filter(F.col("presence").isin("source_only", "target_only")).select(
        "table", F.lit(source_db).alias("source_db"), "column_name",
        F.when(target, F.array(F.lit("target"))).otherwise(F.array(F.lit("source"))).alias(
            "applies_to"
        ),
        "reason", F.lit(0).alias("seq"), "category",
    )


# --- skipped columns ---------------------------------------------------------------------------


def classify_skips(skips: DataFrame) -> DataFrame:
    """Category, verdict and message of every skipped column; the first reason wins.

    ``skips``: ``column_name, skip_reason, data_type`` and anything else, which is kept.  A type
    that contains ``timestamp`` counts as incomparable, as row-version columns do.
    """
    given = F.coalesce("skip_reason", F.lit(""))
    facts = F.struct(
        F.lower("column_name").alias("name"), given.alias("given"),
        F.lower(given).alias("reason"),
        F.coalesce("data_type", F.lit("")).alias("shown_type"),
        F.coalesce(F.lower("data_type"), F.lit("")).alias("dtype"),
    )
    return skips.withColumn("__v", let(facts, _verdict)).select(*skips.columns, "__v.*")


def _verdict(facts: Column) -> Column:
    name, given, reason, dtype = (facts[f] for f in ("name", "given", "reason", "dtype"))

    def verdict(category: str, outcome: str, message: Column | str) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.struct(
            F.lit(category).alias("category"), F.lit(outcome).alias("verdict"),
            text.alias("message"),
        )

    return (
        F.when(
            matches_any(name, fv.SKIP_METADATA_PATTERNS),
            verdict("fivetran_metadata", "JUSTIFIED",
                    fv.SKIP_METADATA),
        )
        .when(
            contains_any(reason, fv.SKIP_CONFIG_PHRASES),
            verdict("config_exclusion", "JUSTIFIED",
                    filled(fv.SKIP_CONFIGURED, reason=given)),
        )
        .when(
            contains_any(reason, fv.SKIP_TYPE_PHRASES)
            | contains_any(dtype, fv.SKIP_INCOMPATIBLE_TYPES),
            verdict(
                "type_incompatible", "JUSTIFIED",
                F.when(
                    dtype != "",
                    filled(fv.SKIP_TYPE, type=facts["shown_type"]),
                ).otherwise(filled(fv.SKIP_TYPE_REASON, reason=given)),
            ),
        )
        .when(
            matches_any(name, fv.SKIP_AUDIT_PATTERNS),
            verdict("audit_column", "JUSTIFIED", fv.SKIP_AUDIT),
        )
        .when(
            contains_any(reason, fv.SKIP_NO_TARGET_PHRASES),
            verdict("no_target_match", "UNJUSTIFIED", fv.SKIP_NO_TARGET),
        )
        .when(
            contains_any(reason, fv.SKIP_NO_SOURCE_PHRASES),
            verdict("no_source_match", "WARN_ONLY", fv.SKIP_NO_SOURCE),
        )
        .when(
            F.trim(given) == "",
            verdict("unknown", "UNJUSTIFIED", fv.SKIP_WITHOUT_REASON),
        )
        .otherwise(
            verdict("unknown", "UNJUSTIFIED",
                    filled(fv.SKIP_UNRECOGNIZED, reason=given)),
        )
    )


def skip_counts(classified: DataFrame) -> DataFrame:
    """Skips per table by verdict, and the names of the unjustified ones."""
    verdict = F.col("verdict")
    unjustified = F.when(verdict == "UNJUSTIFIED", F.col("column_name"))
    return classified.groupBy("table").agg(
        F.count_if(verdict == "JUSTIFIED").alias("justified_skips"),
        F.count_if(verdict == "UNJUSTIFIED").alias("unjustified_skips"),
        F.count_if(verdict == "WARN_ONLY").alias("warn_only_skips"),
        F.array_join(F.array_sort(F.collect_list(unjustified)), ", ").alias(
            "unjustified_columns"
        ),
    )


def promote(results: DataFrame, skips: DataFrame) -> DataFrame:
    """PASS becomes FAIL for a table with an unjustified skip.

    ``results``: ``table, status, …``; ``skips``: output of :func:`skip_counts`.
    """
    bad = F.coalesce("unjustified_skips", F.lit(0)) > 0
    raised = bad & (F.col("status") == "PASS")
    return (
        results.join(skips.select("table", "unjustified_skips", "unjustified_columns"),
                     ["table"], "left")
        .withColumn("original_status", F.col("status"))
        .withColumn(
            "skip_promotion_reason",
            F.when(
                raised,
                F.concat(F.col("unjustified_skips").cast("string"),
                         F.lit(" unjustified skip(s) found: "), "unjustified_columns"),
            ),
        )
        .withColumn("status", F.when(raised, "FAIL").otherwise(F.col("status")))
        .drop("unjustified_skips", "unjustified_columns")
    )

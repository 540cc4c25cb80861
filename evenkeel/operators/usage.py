"""Cost analytics over usage events."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenkeel import fixed_values as fv


def price_table(spark: SparkSession, prices: dict[str, tuple[float, float]] | None = None
                ) -> DataFrame:
    rows = [(m, i, o) for m, (i, o) in (prices or fv.MODEL_PRICES).items()]
    return spark.createDataFrame(
        rows, "model string, input_per_million double, output_per_million double"
    )


def with_cost(
    events: DataFrame,
    prices: DataFrame,
    default_price: tuple[float, float] = fv.DEFAULT_MODEL_PRICE,
) -> DataFrame:
    """Events with ``cost`` in USD; unknown models cost the default price.

    Token counts that are missing count 0; a missing total is prompt + completion.  The price
    join is left to the optimizer, which broadcasts price lists below its size limit.
    """
    named = events.withColumn("model", F.coalesce("model", F.lit("unknown"))).withColumn(
        "call_type", F.coalesce("call_type", F.lit("unknown"))
    )
    prompt = F.coalesce("prompt_tokens", F.lit(0))
    completion = F.coalesce("completion_tokens", F.lit(0))
    cost_in = prompt / F.lit(1e6) * F.coalesce("input_per_million", F.lit(default_price[0]))
    cost_out = completion / F.lit(1e6) * F.coalesce(
        "output_per_million", F.lit(default_price[1])
    )
    return (
        named.join(prices, ["model"], "left")
        .withColumn("prompt_tokens", prompt)
        .withColumn("completion_tokens", completion)
        .withColumn(
            "total_tokens",
            F.coalesce("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")),
        )
        .withColumn("cost", cost_in + cost_out)
        .drop("input_per_million", "output_per_million")
    )


def usage_rollup(costed: DataFrame) -> DataFrame:
    """Calls, tokens and cost overall, by call type and by model, in one pass."""
    return (
        costed.groupingSets([[], ["call_type"], ["model"]], "call_type", "model")
        .agg(
            F.grouping_id().alias("g"),
            F.count(F.lit(1)).alias("calls"),
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("cost").alias("cost"),
        )
        .select(
            F.when(F.col("g") == 3, "overall")
            .when(F.col("g") == 1, "call_type")
            .otherwise("model")
            .alias("grouping"),
            F.coalesce("call_type", "model", F.lit("")).alias("name"),
            "calls", "prompt_tokens", "completion_tokens", "total_tokens", "cost",
        )
    )


def _in_window(costed: DataFrame, today: datetime.date, days: int) -> DataFrame:
    first = today - datetime.timedelta(days=days - 1)
    day = F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("date")
    # ISO texts sort as their times do: a range on the raw text reaches the scan and skips files, and
    # the parsed day decides among what is left
    raw = (F.col("timestamp") >= first.isoformat()) & (
        F.col("timestamp") < (today + datetime.timedelta(days=1)).isoformat()
    )
    return costed.filter(raw).withColumn("day", day).filter(
        F.col("day").between(F.lit(first), F.lit(today))
    )


def daily_cost(costed: DataFrame, today: datetime.date, days: int = 7) -> DataFrame:
    """Cost, tokens and calls per day of the trailing window; days without events are 0."""
    first = today - datetime.timedelta(days=days - 1)
    spine = costed.sparkSession.range(days).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"),
        F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("tokens"),
        F.lit(0).cast("long").alias("calls"),
    )
    spent = _in_window(costed, today, days).select(
        "day", "cost", F.col("total_tokens").cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("calls"),
    )
    return spine.unionByName(spent).groupBy("day").agg(
        F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls")
    )


def window_rollup(costed: DataFrame, today: datetime.date, days: int = 7) -> DataFrame:
    """Trailing-window totals overall, by call type and by model, with the share of today."""
    rows = _in_window(costed, today, days)
    is_today = F.col("day") == F.lit(today)
    return (
        rows.groupingSets([[], ["call_type"], ["model"]], "call_type", "model")
        .agg(
            F.grouping_id().alias("g"),
            F.count(F.lit(1)).alias("calls"),
            F.sum("total_tokens").alias("tokens"),
            F.sum("cost").alias("cost"),
            F.coalesce(F.sum(F.when(is_today, F.col("total_tokens"))), F.lit(0)).alias(
                "tokens_today"
            ),
            F.coalesce(F.sum(F.when(is_today, F.col("cost"))), F.lit(0.0)).alias("cost_today"),
        )
        .select(
            F.when(F.col("g") == 3, "overall")
            .when(F.col("g") == 1, "call_type")
            .otherwise("model")
            .alias("grouping"),
            F.coalesce("call_type", "model", F.lit("")).alias("name"),
            "calls", "tokens", "cost", "tokens_today", "cost_today",
        )
    )

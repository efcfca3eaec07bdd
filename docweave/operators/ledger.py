"""Costs of model calls as aggregates over a calls table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.types import DEFAULTS

# Price registry, dollars per million tokens in and out.
PRICES = [
    ("micro", "Micro", "cheap", 0.035, 0.14),
    ("lite", "Lite", "cheap", 0.06, 0.24),
    ("pro", "Pro", "mid", 0.80, 3.20),
    ("fast", "Fast", "cheap", 1.00, 5.00),
    ("strong", "Strong", "strong", 3.00, 15.00),
    ("embed", "Embeddings", "embedding", 0.02, 0.0),
]


class BudgetExceeded(RuntimeError):
    """Raised before a call that would pass the run's token ceiling."""


def model_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model_id string, label string, tier string, input_per_mtok double, output_per_mtok double")


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with label and usd; a model without a price costs 0, as does a cached call."""
    cost = F.col("input_tokens") / 1e6 * F.coalesce("input_per_mtok", F.lit(0.0)) + F.col("output_tokens") / 1e6 * F.coalesce("output_per_mtok", F.lit(0.0))
    joined = calls.join(F.broadcast(prices), "model_id", "left")
    return joined.withColumn("label", F.coalesce("label", F.lit("Unknown model"))).withColumn("usd", F.when(F.col("cache_hit"), 0.0).otherwise(cost))


def totals(calls: DataFrame) -> DataFrame:
    """One row over priced calls; cached calls don't count as tokens here."""
    paid = ~F.col("cache_hit")
    tokens = lambda c: F.coalesce(F.sum(F.when(paid, F.col(c))), F.lit(0))
    return calls.agg(
        tokens("input_tokens").alias("total_input_tokens"), tokens("output_tokens").alias("total_output_tokens"),
        (tokens("input_tokens") + tokens("output_tokens")).alias("total_tokens"), F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 6).alias("total_usd"),
        F.count_if(paid).alias("billable_calls"), F.count_if(F.col("cache_hit")).alias("cache_hits"),
    )


def by_stage(calls: DataFrame) -> DataFrame:
    """Per stage over priced calls; here cached calls' tokens count. models: distinct, in order of first use."""
    models = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "model_id"))), lambda x: x["model_id"]))
    return calls.groupBy("stage").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("usd"), 6).alias("usd"), models.alias("models"),
    )


def by_model(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model_id", "label").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("usd"), 6).alias("usd")
    )


def what_if(total: DataFrame, prices: DataFrame) -> DataFrame:
    """What the paid tokens would have cost on each model that answers; total is one row, prices a handful."""
    usd = F.col("total_input_tokens") / 1e6 * F.col("input_per_mtok") + F.col("total_output_tokens") / 1e6 * F.col("output_per_mtok")
    return F.broadcast(prices.filter("tier <> 'embedding'")).crossJoin(total).select("model_id", F.round(usd, 6).alias("usd"))


def cost_per_field(total: DataFrame, mapped: int) -> DataFrame:
    return total.select((F.round(F.col("total_usd") / mapped, 6) if mapped else F.lit(0.0)).alias("cost_per_mapped_field"))


def check_budget(calls: DataFrame, projected: int, ceiling: int = DEFAULTS.token_ceiling) -> None:
    used = calls.filter("not cache_hit").agg(F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0))).first()[0]
    if used + projected > ceiling:
        raise BudgetExceeded(f"The run has used {used} of {ceiling} tokens and the next call needs about {projected}; raise the ceiling to go on.")


def running_budget(calls: DataFrame, by: str, ceiling: int = DEFAULTS.token_ceiling) -> DataFrame:
    """Audit of a run's calls: tokens spent up to each and whether the ceiling held. A run is one window; ``by`` names runs."""
    w = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.sum(F.when(F.col("cache_hit"), 0).otherwise(F.col("input_tokens") + F.col("output_tokens"))).over(w)
    return calls.withColumn("spent", spent).withColumn("within", F.col("spent") <= ceiling)


def constraint_maxima(calls: DataFrame) -> DataFrame:
    """The most that any one call was shown: one row over calls with manifests."""
    typed = F.when(F.col("detail_level") == "typed", F.size("source_fields"))
    most = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long")
    return calls.agg(
        F.count(F.lit(1)).alias("total_calls"), most(F.size("source_tables")).alias("max_tables"), most(typed).alias("max_typed_fields"),
        most(F.size("source_fields")).alias("max_named_fields"), most(F.size(F.array_distinct("destination_paths"))).alias("max_paths"),
        most(F.when(F.col("stage") == "adjudicate", F.col("mappings"))).alias("max_mappings"), most("input_tokens").alias("max_input_tokens"),
    )


def whole_schema_prompts(calls: DataFrame, source_fields: int, destination_paths: int) -> DataFrame:
    """Calls that were shown both schemas whole, counted rather than claimed."""
    both = (F.size(F.array_distinct("source_fields")) >= source_fields) & (F.size(F.array_distinct("destination_paths")) >= destination_paths)
    return calls.agg(F.count_if(both & (F.col("detail_level") == "typed")).alias("prompts_with_both_schemas"))

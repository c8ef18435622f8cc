"""Tokens, prices, spending and cost estimates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.errors import BudgetExceededError
from fieldloom.functions.jsonschema import leaf_fields
from fieldloom.functions.text import tokens
from fieldloom.operators.chunking import estimate_chunks

Pricing = Mapping[str, tuple[float, float]]
#: USD for a million input and output tokens, by maker.
_OPENAI = {
    "gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6), "gpt-4.1": (2.0, 8.0), "gpt-4.1-mini": (0.4, 1.6), "gpt-4.1-nano": (0.1, 0.4),
    "gpt-5.4": (2.5, 10.0), "gpt-5.4-mini": (0.15, 0.6), "o3-mini": (1.1, 4.4),
}
_EMBEDDING = {"text-embedding-3-small": (0.02, 0.0), "text-embedding-3-large": (0.13, 0.0)}
_OTHERS = {"claude-sonnet-4-6": (3.0, 15.0), "claude-haiku-4-5": (0.8, 4.0), "claude-haiku-4-5-20251001": (0.8, 4.0), "mistral-small-latest": (0.1, 0.3)}
PRICES: dict[str, tuple[float, float]] = _OTHERS | _OPENAI | _EMBEDDING


def price_table(spark: SparkSession, pricing: Pricing | None = None) -> DataFrame:
    merged = {**PRICES, **(pricing or {})}
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in merged.items()], "price_model string, price_in double, price_out double")


def is_priced(model: str, pricing: Pricing | None = None) -> bool:
    return model in {**PRICES, **(pricing or {})}


def with_cost(calls: DataFrame, pricing: Pricing | None = None) -> DataFrame:
    """``calls`` with ``cost_usd``; a model without a price costs nothing. The price list is a dozen rows."""
    prices = F.broadcast(price_table(calls.sparkSession, pricing))
    cost = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / F.lit(1e6)
    joined = calls.drop("cost_usd").join(prices, F.col("model") == F.col("price_model"), "left")
    return joined.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("price_model", "price_in", "price_out")


def usage_report(calls: DataFrame) -> DataFrame:
    """Sums by stage, and over all (a null stage, with ``is_total``); a row is a call, or ``calls`` of them where there is such a column."""
    n = F.sum("calls").cast("bigint") if "calls" in calls.columns else F.count("*")
    sums = calls.rollup("stage").agg(
        n.alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"), F.sum("latency_ms").alias("latency_ms"), (F.grouping("stage") == 1).alias("is_total"),
    )
    return sums


def running_cost(calls: DataFrame, by: str | None = None) -> DataFrame:
    """``calls`` with ``spent``, the cost up to and with each call.

    ``by`` splits the calls into accounts of their own budget; without it the calls are one
    account, whose order is inherently one task's work (a run's calls, not a corpus).
    """
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("call_ord").rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("spent", F.sum("cost_usd").over(w))


def within_budget(calls: DataFrame, limit: float, by: str | None = None) -> DataFrame:
    """The calls made until the limit is passed; exactly reaching it is fine, and the call that passes it is the last."""
    spent = running_cost(calls, by)
    return spent.where(F.col("spent") - F.col("cost_usd") <= limit)


def check_budget(calls: DataFrame, limit: float | None) -> float:
    """The total cost; raises once it is above the limit."""
    spent = float(calls.agg(F.sum("cost_usd")).first()[0] or 0.0)
    if limit is not None and spent > limit:
        raise BudgetExceededError(spent, limit)
    return spent


def estimate_pipeline_cost(docs: DataFrame, content: str = "content", chunk_size: int = 4000, overlap: int = 200, price: float = 0.15) -> DataFrame:
    """One row: what discovery, extraction and normalization are likely to cost."""
    n = F.coalesce(F.length(content), F.lit(0))
    sums = docs.agg(
        F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum(F.floor(n / 4)), F.lit(0)).alias("t"), F.coalesce(F.sum(estimate_chunks(F.col(content), chunk_size, overlap)), F.lit(0)).alias("n_chunks")
    )
    mean = F.col("t") / F.greatest(F.col("n_documents"), F.lit(1))
    parts = sums.select(
        "n_documents", "n_chunks", mean.alias("mean_tokens"),
        (mean * 6 / F.lit(1e6) * price).alias("d"), (F.col("n_chunks") * mean * 2 / F.lit(1e6) * price).alias("e"), (F.col("n_documents") * F.lit(0.001)).alias("n"),
    )
    return parts.select(
        "n_documents", "n_chunks", F.round("mean_tokens", 4).alias("mean_tokens"), F.round("d", 4).alias("discovery_usd"), F.round("e", 4).alias("extraction_usd"),
        F.round("n", 4).alias("normalization_usd"), F.round(F.col("d") + F.col("e") + F.col("n"), 4).alias("total_usd"),
    )


def estimate_extraction_cost(
    chunks: DataFrame, prompt: Column, schema: dict, model: str, *, records_per_chunk: int = 1, provenance: bool = False, system_tokens: int = 0,
    pricing: Pricing | None = None,
) -> DataFrame:
    """One row: calls, tokens and cost of extracting from ``chunks``; ``prompt`` is the text of each call."""
    price_in, price_out = {**PRICES, **(pricing or {})}.get(model, (0.0, 0.0))
    out = max(30, 30 * leaf_fields(schema)) * records_per_chunk * (3 if provenance else 1)
    notes = [x for x, on in (("the model has no price", not is_priced(model, pricing)), ("source quotes triple the output", provenance), ("the number of records is a guess", records_per_chunk > 1)) if on]
    sums = chunks.agg(F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum(tokens(prompt) + 4 + system_tokens), F.lit(0)).alias("input_tokens"))
    with_out = sums.withColumn("output_tokens", F.col("n_calls") * out)
    cost = (F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / F.lit(1e6)
    return with_out.select(F.lit(model).alias("model"), "n_calls", "input_tokens", "output_tokens", F.round(cost, 6).alias("cost_usd"), F.array(*map(F.lit, notes)).cast("array<string>").alias("notes"))

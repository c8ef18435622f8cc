"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in the order of a keyed hash of their identifier. A document's
virtual finish time is the queue's tokens up to and with it, divided by the source's target
weight; the mix is all documents in the order of finish times, cut where the total token
budget is reached.

Both running sums are computed in two levels, so no task holds a whole source or the whole
order: sums by (source, hash prefix), respectively by a slice of the finish time range, are
accumulated as small tables, and windows add up rows within one prefix or slice. A hot
source is spread over as many tasks as there are prefixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.shared import cut, fresh

SLICES = 4096
PREFIX = 3
SEED = "mix-1"
BUDGET_SHARE = 0.9


def plan_mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    budget_tokens: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
) -> DataFrame:
    """``(doc_id, source, tokens, finish, cum_tokens)`` of the documents that the mix takes, in its order.

    A document counts ``ceil(length / 4)`` tokens. ``weights`` are by source, and positive;
    sources without one are left out. Without ``weights`` a source's weight is the square
    root of its tokens. Without ``budget_tokens`` the budget is nine tenths of all tokens of
    the sources that have a weight.

    * null text and empty text: 0 tokens, taken if the order reaches them within the budget;
    * null source: a queue of its own (given weights don't name it, so it is left out then);
    * rows that share an identifier are one document: tokens add up, the least source counts;
      all rows with a null identifier are one document too;
    * ties in finish time: by source, hash key and identifier, nulls first;
    * a budget of 0, or an empty table: no document with tokens is taken.
    """
    spark = docs.sparkSession
    base = (
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.ceil(F.coalesce(F.length(text_col), F.lit(0)) / 4).cast("bigint").alias("tokens"),
        )
        .groupBy("doc_id")
        .agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens"))
        .withColumn("key", F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 16))
        .withColumn("prefix", F.substring("key", 1, PREFIX))
    )
    if weights is not None:
        if not weights or min(weights.values()) <= 0:
            raise ValueError("weights must name at least one source, and be positive")
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        base = base.join(given, "source")
    base = cut(base)

    by_source = Window.partitionBy("source")
    sums = base.groupBy("source", "prefix").agg(F.sum("tokens").alias("t"), *([F.first("weight").alias("weight")] if weights else []))
    before = F.sum("t").over(by_source.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumn("offset", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("t").over(by_source))
    if not weights:
        offsets = offsets.withColumn("weight", F.sqrt(F.greatest(F.col("total"), F.lit(1)).cast("double")))
    offsets = offsets.select(F.col("source").alias("s"), F.col("prefix").alias("p"), "offset", "weight")

    within = Window.partitionBy("source", "prefix").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = base.select("doc_id", "source", "tokens", "key", "prefix", F.sum("tokens").over(within).alias("run"))
    timed = cut(
        running.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p"))).select(
            "doc_id", "source", "tokens", "key", ((F.col("offset") + F.col("run")).cast("double") / F.col("weight")).alias("finish")
        )
    )

    last, total = timed.agg(F.max("finish"), F.sum("tokens")).first()
    if budget_tokens is None:
        budget_tokens = int((total or 0) * BUDGET_SHARE)
    scale = SLICES / last if last else 0.0
    timed = timed.withColumn("slice", F.least(F.floor(F.col("finish") * scale), F.lit(SLICES - 1)))
    # At most SLICES rows: a fixed size, so it may be broadcast and summed up by one task.
    starts = (
        timed.groupBy("slice")
        .agg(F.sum("tokens").alias("t"))
        .select("slice", F.coalesce(F.sum("t").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        .where(F.col("start") <= budget_tokens)
    )
    order = Window.partitionBy("slice").orderBy("finish", "source", "key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mixed = timed.join(F.broadcast(starts), "slice").withColumn("cum_tokens", F.col("start") + F.sum("tokens").over(order))
    taken = mixed.where(F.col("cum_tokens") <= budget_tokens)
    return taken.orderBy("finish", "source", "key", "doc_id").select("doc_id", "source", "tokens", "finish", "cum_tokens")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``plan_mix`` takes, with all their columns, in no order.

    All rows of an identifier, or of the null identifier, are taken or left together; null and empty
    texts have no tokens, long ones count whole; null sources and ties are as in ``plan_mix``. Extra
    columns of any name pass as they are; an empty table gives an empty result.
    """
    name = fresh(docs, "taken")
    taken = plan_mix(docs, **options).select(F.col("doc_id").alias(name))
    return docs.join(taken, F.col(options.get("id_col", "doc_id")).eqNullSafe(F.col(name)), "left_semi")


SQL = f"""
WITH b AS (
  SELECT doc_id, min(source) AS source,
         CAST(sum(ceil(coalesce(length(text), 0) / 4.0)) AS BIGINT) AS tokens,
         substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key
  FROM documents GROUP BY doc_id
), f AS (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS DOUBLE)
            / sqrt(CAST(greatest(sum(tokens) OVER (PARTITION BY source), 1) AS DOUBLE)) AS finish
  FROM b
), c AS (
  SELECT *, CAST(sum(tokens) OVER (ORDER BY finish, source NULLS FIRST, key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_tokens
  FROM f
)
SELECT doc_id, source, tokens, finish, cum_tokens FROM c
WHERE cum_tokens <= (SELECT CAST(floor(coalesce(sum(tokens), 0) * CAST({BUDGET_SHARE} AS DOUBLE)) AS BIGINT) FROM b)
"""

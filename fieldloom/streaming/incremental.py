"""Documents that keep arriving: batch operators on each micro-batch, learned values merged as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.operators.cascade import LearnedDictionaryCache
from fieldloom.operators.checkpoint import cut
from fieldloom.operators.chunking import chunk_fixed


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_ord bigint, doc_id string, content string, source string", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_chunks(docs: DataFrame, chunk_size: int = 4000, overlap: int = 200) -> DataFrame:
    """Chunking is stateless, so the batch operator works on a stream as it is."""
    return chunk_fixed(docs, chunk_size, overlap)


def stream_value_counts(values: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of ``values(ts, value)`` by time window; what is later than ``delay`` is left out."""
    return values.withWatermark("ts", delay).groupBy(F.window("ts", window), "value").agg(F.count("*").alias("n")).select("window.start", "window.end", "value", "n")


def normalize_stream(values: DataFrame, strategy: object, field: str, cache: LearnedDictionaryCache, out: str, checkpoint: str, wrap: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Each micro-batch of ``values(value)`` is normalized once: known values by what was learned, the others by ``strategy``.

    Batches are written under their number and overwritten if they are repeated, so a restart doubles nothing.
    """

    def one(batch: DataFrame, number: int) -> None:
        known = cache.load_dictionary(batch.sparkSession, field)
        todo = batch
        parts = []
        if known is not None:
            got = known.normalize(batch, field)
            parts.append(got.where("confidence > 0"))
            todo = got.where("confidence = 0").select(F.col("raw").alias("value"))
        new = cut(wrap(strategy.normalize(todo, field)))
        both = parts[0].unionByName(new, allowMissingColumns=True) if parts else new
        both.write.mode("overwrite").parquet(f"{out}/batch={number}")
        cache.save(new, "stream")

    return values.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

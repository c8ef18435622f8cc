"""Cascades: what one strategy doesn't resolve goes to the next; learned dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.checkpoint import cut, versions
from fieldloom.operators.mapping import DictionaryNormalization, clusters, dictionary_table, to_dictionary

LEARN_AT = 0.80


@dataclass
class CascadeNormalization:
    """Strategies in order, each with an optional confidence threshold.

    Without thresholds a value is resolved once a step changes it; with them if the step
    changes it with at least that confidence (null counts as 0 here). Values that no step
    resolves stay as they are, with a null step. The result keeps the step's confidence in
    ``step_confidence``; ``confidence`` is null, as a cascade gives none of its own.
    """

    steps: Sequence[object]
    confidence_thresholds: Sequence[float] | None = None
    materialize: object = field(default=None, repr=False)

    def __post_init__(self):
        limits = self.confidence_thresholds
        if limits is not None and len(limits) - len(self.steps):
            raise ValueError("as many thresholds as steps are needed")

    def normalize(self, values: DataFrame, context_field: str = "") -> DataFrame:
        residual = values.where("value IS NOT NULL").select("value").distinct()
        parts: list[DataFrame] = []
        for k, step in enumerate(self.steps):
            made = step.normalize(residual, context_field)
            if self.materialize is not None:  # so that a model-backed step runs once
                made = self.materialize(made)
            resolved = F.col("canonical") != F.col("raw")
            if self.confidence_thresholds is not None:
                resolved = resolved & (F.coalesce("confidence", F.lit(0.0)) >= self.confidence_thresholds[k])
            tagged = made.withColumn("__resolved", F.coalesce(resolved, F.lit(False)))
            parts.append(
                tagged.where("__resolved").drop("__resolved").withColumn("step", F.lit(k)).withColumn("step_confidence", F.col("confidence"))
            )
            residual = tagged.where("NOT __resolved").select(F.col("raw").alias("value"))
        rest = residual.select(
            F.lit(context_field).alias("field"), F.col("value").alias("raw"), F.col("value").alias("canonical"), F.lit("cascade").alias("strategy"),
            F.lit(None).cast("int").alias("step"), F.lit(None).cast("double").alias("step_confidence"),
        )
        out = rest
        for p in parts:
            out = p.unionByName(out, allowMissingColumns=True)
        return out.withColumn("confidence", F.lit(None).cast("double"))

    @classmethod
    def default(cls, dictionary: Mapping[str, str] | None = None, model: object | None = None, ontology: object | None = None, use_confidence: bool = True) -> CascadeNormalization:
        """Dictionary (case doesn't count), then a model's canonical forms, then an ontology; what is None is left out."""
        steps = [(DictionaryNormalization(dictionary, case_insensitive=True), 1.0)] if dictionary else []
        steps += [(model, 0.80)] if model is not None else []
        steps += [(ontology, 0.90)] if ontology is not None else []
        # Steps that a model or an index backs are read twice, for what they resolve and for what they don't: they are computed once.
        return cls([s for s, _ in steps], [t for _, t in steps] if use_confidence else None, cut if model is not None or ontology is not None else None)

    def learn(self, result: DataFrame, min_confidence: float = LEARN_AT) -> CascadeNormalization:
        """A cascade that knows the result's mapping: merged into a leading dictionary, or put first as one."""
        found = to_dictionary(result, min_confidence).select(F.col("raw").alias("key"), "canonical", F.lit(1 << 40).alias("ord"))
        steps, limits = list(self.steps), None if self.confidence_thresholds is None else list(self.confidence_thresholds)
        if steps and isinstance(steps[0], DictionaryNormalization):
            old = steps[0].mapping
            old = old if isinstance(old, DataFrame) else dictionary_table(result.sparkSession, old)
            merged = old.select("key", "canonical", "ord").unionByName(found)
            steps[0] = DictionaryNormalization(merged, steps[0].case_insensitive, steps[0].passthrough_unmapped)
        else:
            steps.insert(0, DictionaryNormalization(found, case_insensitive=True))
            if limits is not None:
                limits.insert(0, 1.0)
        return CascadeNormalization(steps, limits, self.materialize)


def step_counts(result: DataFrame, n_steps: int) -> DataFrame:
    """``(step, mapped, remaining)`` for each step."""
    total = result.agg(F.count("*").alias("total"))
    steps = result.sparkSession.range(n_steps).select(F.col("id").cast("int").alias("step"))
    mapped = result.where("step IS NOT NULL").groupBy("step").agg(F.count("*").alias("n"))
    per = steps.join(mapped, "step", "left").select("step", F.coalesce("n", F.lit(0)).alias("mapped")).crossJoin(total)
    done = F.sum("mapped").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))  # n_steps rows
    return per.select("step", "mapped", (F.col("total") - done).alias("remaining"))


def upsert_learned(old: DataFrame, new: DataFrame, min_confidence: float = LEARN_AT) -> DataFrame:
    """``(field, raw, canonical, confidence, source)`` of both; an old entry gives way only to a higher confidence.

    New entries that change nothing, or are less sure than ``min_confidence``, don't count; a
    null confidence of theirs is 1.
    """
    found = new.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).where((F.col("raw") != F.col("canonical")) & (F.col("confidence") >= min_confidence))
    cols = ["field", "raw", "canonical", "confidence", "source"]
    both = old.select(*cols, F.lit(1).alias("__old")).unionByName(found.select(*cols, F.lit(0).alias("__old")))
    best = Window.partitionBy("field", "raw").orderBy(F.desc("confidence"), F.desc("__old"), "canonical")
    return both.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(*cols)


@dataclass
class LearnedDictionaryCache:
    """A persisted dictionary, versioned by folder so that no reader sees half a write."""

    path: str
    min_confidence: float = LEARN_AT

    def load_all(self, spark) -> DataFrame:
        have = versions(spark, self.path)
        if not have:
            return spark.createDataFrame([], "field string, raw string, canonical string, confidence double, source string")
        return spark.read.parquet(f"{self.path}/v={have[-1]}")

    def save(self, mapping: DataFrame, source: str = "") -> int:
        """Adds a mapping; returns the new version."""
        spark = mapping.sparkSession
        new = mapping.select("field", "raw", "canonical", "confidence", F.lit(source).alias("source"))
        version = (versions(spark, self.path) or [0])[-1] + 1
        upsert_learned(self.load_all(spark), new, self.min_confidence).write.parquet(f"{self.path}/v={version}")
        return version

    def load_dictionary(self, spark, context_field: str) -> DictionaryNormalization | None:
        rows = self.load_all(spark).where((F.col("field") == context_field) & (F.coalesce("confidence", F.lit(0.0)) >= self.min_confidence))
        if rows.isEmpty():
            return None
        return DictionaryNormalization(rows.select(F.col("raw").alias("key"), "canonical"), case_insensitive=True, name="learned")


__all__ = ["CascadeNormalization", "LearnedDictionaryCache", "clusters", "step_counts", "upsert_learned"]

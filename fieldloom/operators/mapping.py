"""Value mappings: dictionaries, their use on records, their explanation.

A mapping is a table ``field, raw, canonical, confidence, ontology_id, explanation,
strategy``; a null confidence means that its strategy gives none, which isn't 0.
Strategies take ``values(value)`` or ``values(field, value, ord)``, with repeats, and return
one row for each distinct value.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.errors import NormalizationError

#: Rows of a dictionary up to which it is worth a broadcast hint; larger ones are left to the optimizer.
BROADCAST_ROWS = 200_000
#: Entries of a mapping that are looked up in arrays in place.
INLINE_ROWS = 500


def values_of(df: DataFrame, field: str) -> DataFrame:
    """``(field, value)``: all values of a column as text, one row each; array elements count singly, nulls don't."""
    c = F.col(field)
    if isinstance(df.schema[field].dataType, T.ArrayType):
        df, c = df.select(F.explode(c).alias(field)), F.col(field)
    return df.where(c.isNotNull()).select(F.lit(field).alias("field"), c.cast("string").alias("value"))


def frequencies(values: DataFrame) -> DataFrame:
    """``(value, freq, first_ord)`` of the distinct values; ``first_ord`` is null without an ``ord`` column."""
    first = F.min("ord") if "ord" in values.columns else F.lit(None).cast("bigint")
    return values.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("freq"), first.alias("first_ord"))


def dictionary_table(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    """``(key, canonical, ord)`` in the order of the mapping."""
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(mapping.items())], "key string, canonical string, ord bigint")


@dataclass
class DictionaryNormalization:
    """Look-up. Of keys that only differ in case the last counts where case doesn't."""

    mapping: Mapping[str, str] | DataFrame
    case_insensitive: bool = False
    passthrough_unmapped: bool = True
    name: str = "dictionary"

    def normalize(self, values: DataFrame, context_field: str = "") -> DataFrame:
        spark = values.sparkSession
        table = self.mapping if isinstance(self.mapping, DataFrame) else dictionary_table(spark, self.mapping)
        small = not isinstance(self.mapping, DataFrame) and len(self.mapping) <= BROADCAST_ROWS
        fold = F.lower if self.case_insensitive else (lambda c: c)
        order = F.col("ord") if "ord" in table.columns else F.lit(0)
        keys = table.groupBy(fold(F.col("key")).alias("__key")).agg(F.max_by("canonical", F.struct(order, "canonical")).alias("__to"))
        distinct = values.where("value IS NOT NULL").select("value").distinct()
        hit = distinct.join(F.broadcast(keys) if small else keys, fold(F.col("value")) == F.col("__key"), "left")
        to = F.col("__to")
        if not self.passthrough_unmapped:
            to = F.coalesce(to, F.raise_error(F.concat(F.lit("no entry for the value "), "value")).cast("string"))
        return hit.select(
            F.lit(context_field).alias("field"), F.col("value").alias("raw"), F.coalesce(to, F.col("value")).alias("canonical"),
            F.when(F.col("__to").isNotNull(), 1.0).otherwise(0.0).alias("confidence"), F.lit(None).cast("string").alias("ontology_id"),
            F.lit(None).cast("string").alias("explanation"), F.lit(self.name).alias("strategy"),
        )


def clusters(mapping: DataFrame) -> DataFrame:
    """``(canonical, members)``, members sorted."""
    return mapping.groupBy("canonical").agg(F.array_sort(F.collect_list("raw")).alias("members"))


def apply_mapping(records: DataFrame, mapping: DataFrame, field: str, out: str | None = None) -> DataFrame:
    """``records`` with ``field`` as canonical text: scalars by look-up, arrays element by element in order.

    Nulls stay null, null elements become the text ``None``, values without an entry stay.
    For an array column a mapping of up to ``INLINE_ROWS`` entries is looked up in place; a larger one
    is joined to the exploded elements, which are put together again.
    """
    out = out or field
    m = mapping.select(F.col("raw").alias("__raw"), F.col("canonical").alias("__to")).dropDuplicates(["__raw"])
    if not isinstance(records.schema[field].dataType, T.ArrayType):
        text = F.col(field).cast("string")
        joined = records.withColumn("__text", text).join(m, F.col("__text") == F.col("__raw"), "left")
        return joined.withColumn(out, F.coalesce("__to", "__text")).drop("__text", "__raw", "__to")
    few = m.limit(INLINE_ROWS + 1).collect()
    if len(few) <= INLINE_ROWS:
        entries = F.create_map(*[F.lit(x) for r in few for x in r]) if few else F.create_map().cast("map<string,string>")
        item = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
        return records.withColumn(out, F.transform(field, lambda x: F.coalesce(F.try_element_at(entries, item(x)), item(x))))
    keyed = records.withColumn("__row", F.to_json(F.struct(field)))
    distinct = keyed.where(F.col(field).isNotNull()).select("__row", field).dropDuplicates(["__row"])
    items = distinct.select("__row", F.posexplode(field).alias("__pos", "__item"))
    items = items.withColumn("__item", F.coalesce(F.col("__item").cast("string"), F.lit("None")))
    mapped = items.join(m, F.col("__item") == F.col("__raw"), "left")
    back = mapped.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__pos", F.coalesce("__to", "__item").alias("v")))).alias("__a"))
    whole = keyed.join(back.select("__row", F.col("__a.v").alias("__new")), "__row", "left")
    new = F.when(F.col(field).isNotNull(), F.coalesce("__new", F.array().cast("array<string>")))
    return whole.withColumn(out, new).drop("__row", "__new")


def to_dictionary(mapping: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """``(raw, canonical)`` of the entries that change something; a null confidence passes any minimum."""
    return mapping.where((F.col("raw") != F.col("canonical")) & (F.coalesce("confidence", F.lit(1.0)) >= min_confidence)).select("raw", "canonical")


def explain(mapping: DataFrame, value: Column | None = None) -> DataFrame:
    """``(raw, explanation)``: the strategy's own, else the cluster it is in, else an arrow."""
    size = mapping.groupBy("canonical").agg(F.count("*").alias("__n"))
    arrow = F.concat("raw", F.lit(" → "), "canonical")
    joined = mapping.join(size, "canonical")
    grouped = F.when(F.col("__n") > 1, F.concat(arrow, F.lit(" ("), F.col("__n").cast("string"), F.lit(" spellings)")))
    return joined.select("raw", F.coalesce("explanation", grouped, arrow).alias("explanation"))


def explain_value(mapping: DataFrame, value: str) -> str:
    row = explain(mapping).where(F.col("raw") == value).first()
    return row.explanation if row else f"{value!r} is not in the mapping"


@dataclass
class CompositeNormalization:
    """Each field by its own strategy, else by the default."""

    field_strategies: Mapping[str, object]
    default: object | None = None

    def normalize(self, values: DataFrame, context_field: str = "") -> DataFrame:
        strategy = self.field_strategies.get(context_field, self.default)
        if strategy is None:
            raise NormalizationError(f"no strategy for the field {context_field!r}, and no default")
        return strategy.normalize(values, context_field)

    def normalize_all(self, values: DataFrame, fields: list[str]) -> DataFrame:
        """For ``values(field, value)``."""
        out = None
        for f in fields:
            one = self.normalize(values.where(F.col("field") == f).drop("field"), f)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise NormalizationError("no fields")
        return out

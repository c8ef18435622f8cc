"""Profiles of records: which fields are filled, which are worth normalizing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.jsonschema import string_fields
from fieldloom.operators.mapping import values_of

LOW = 0.8
EXCLUDED = tuple("comment content description email id name note summary text title url".split())


def coverage(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, filled, total, coverage)``: one pass, then one row for each field; none without fields or rows."""
    fields = list(dict.fromkeys(fields))
    if not fields:
        return records.sparkSession.createDataFrame([], "field string, filled bigint, total bigint, coverage double")
    have = [f for f in fields if f in records.columns]
    counts = records.agg(F.count(F.lit(1)).alias("total"), *[F.count(f"`{f}`").alias(f"c{i}") for i, f in enumerate(fields) if f in have])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"c{i}") if f in have else F.lit(0)).cast("bigint").alias("filled")) for i, f in enumerate(fields)])
    flat = counts.where("total > 0").select("total", F.inline(rows))
    return flat.select("field", "filled", "total", (F.col("filled") / F.col("total")).alias("coverage"))


def percent(share: Column) -> Column:
    """Whole percents, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def gaps(found: DataFrame) -> DataFrame:
    """``(field, note)`` from ``coverage``: what is thin, and what is fine; fields that are fine but empty have no row."""
    low = F.concat(F.lit("low coverage ("), "filled", F.lit("/"), "total", F.lit(" = "), percent(F.col("coverage")), F.lit("): the description may be unclear"))
    fine = F.concat(F.lit("coverage fine ("), percent(F.col("coverage")), F.lit("), sample values available"))
    note = F.when(F.col("coverage") < LOW, low).when(F.col("filled") > 0, fine)
    return found.select("field", note.alias("note")).where("note IS NOT NULL")


def coverage_listing(found: DataFrame) -> DataFrame:
    """``(line)`` for a prompt, thinnest first."""
    mark = F.when(F.col("coverage") < 0.2, " (low)").otherwise("")
    return found.orderBy("coverage", "field").select(F.concat("field", F.lit(": "), percent(F.col("coverage")), mark).alias("line"))


def candidate_fields(df: DataFrame) -> list[str]:
    """Columns of strings or arrays of strings whose name holds none of ``EXCLUDED`` (anywhere, so ``provider`` is out)."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(t, T.StringType) and not any(x in f.name.lower() for x in EXCLUDED):
            out.append(f.name)
    return out


def field_statistics(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, n_values, n_unique, unique_ratio, mean_length)``; the ratio is over records.

    One scan: fields become rows before one two-level aggregation, so no field costs its own pass.
    """
    if not fields:
        return records.sparkSession.createDataFrame([], "field string, n_values bigint, n_unique bigint, unique_ratio double, mean_length double")

    def rows_of(f: str) -> Column:
        c = F.col(f"`{f}`")
        values = c.cast("array<string>") if isinstance(records.schema[f].dataType, T.ArrayType) else F.array(c.cast("string"))
        return F.transform(values, lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))

    every = [F.coalesce(a, F.array().cast(T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("value", T.StringType())])))) for a in map(rows_of, fields)]
    values = records.select(F.inline(F.flatten(F.array(*every)))).where("value IS NOT NULL")
    by_value = values.groupBy("field", "value").agg(F.count("*").alias("n"))
    stats = by_value.groupBy("field").agg(
        F.sum("n").alias("n_values"), F.count("*").alias("n_unique"), (F.sum(F.col("n") * F.length("value")) / F.sum("n")).alias("mean_length")
    )
    total = records.agg(F.count(F.lit(1)).alias("total"))
    return stats.crossJoin(total).select("field", "n_values", "n_unique", (F.col("n_unique") / F.col("total")).alias("unique_ratio"), "mean_length")


@dataclass
class StatisticalFieldSelector:
    """Fields of few, short, repeating values."""

    min_unique: int = 3
    max_unique_ratio: float = 0.5
    max_mean_length: float = 50.0

    def passing(self, records: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
        stats = field_statistics(records, candidate_fields(records) if fields is None else fields)
        return stats.where((F.col("n_unique") >= self.min_unique) & (F.col("unique_ratio") <= self.max_unique_ratio) & (F.col("mean_length") <= self.max_mean_length))

    def select(self, records: DataFrame, schema: dict | None = None) -> list[str]:
        """In the order of the schema; at most a row for each field comes to the driver."""
        fields = candidate_fields(records)
        if schema is not None:
            known = set(string_fields(schema))
            fields = [f for f in fields if f in known]
        chosen = {r.field for r in self.passing(records, fields).collect()}
        return [f for f in fields if f in chosen]


def samples(records: DataFrame, fields: Sequence[str], k: int = 20) -> DataFrame:
    """``(field, samples)``: the first ``k`` distinct values in order, so that a sample is the same each time."""
    if not fields:
        return records.sparkSession.createDataFrame([], "field string, samples array<string>")
    every = reduce(DataFrame.unionByName, [values_of(records, f) for f in fields]).distinct()
    few = every.withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy("value"))).where(F.col("n") <= k)
    return few.groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("samples"))


def sample(docs: DataFrame, n: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """``n`` documents in the order of a hash of their identifier: the same each time."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return docs.orderBy(key, id_col).limit(n)


def head(docs: DataFrame, n: int = 10, order_col: str = "doc_ord") -> DataFrame:
    return docs.orderBy(order_col).limit(n)


def distinct_in_order(values: DataFrame) -> DataFrame:
    """``(value, ord)``: each value at its first place."""
    return values.where("value IS NOT NULL").groupBy("value").agg(F.min("ord").alias("ord"))

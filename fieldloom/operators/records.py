"""Replies to records: parsing, missing keys, nulls, repeated records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.text import strip_fences


def parse_objects(reply: Column) -> Column:
    """The JSON objects of a reply, as texts: an array of objects, or one object; null for anything else."""
    bare = F.trim(strip_fences(reply))
    one = F.when(F.startswith(bare, F.lit("{")), F.concat(F.lit("["), bare, F.lit("]"))).otherwise(bare)
    items = F.from_json(F.when(F.get_json_object(one, "$").isNotNull(), one), T.ArrayType(T.StringType()))
    objects = F.forall(items, lambda x: F.coalesce(F.startswith(F.trim(x), F.lit("{")), F.lit(False)))
    return F.when(items.isNotNull() & objects, items)


def missing_keys(record: Column, names: Sequence[str]) -> Column:
    """Which of the required keys a JSON object lacks; a key with null is there."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    return F.array_except(F.array(*map(F.lit, names)).cast("array<string>"), keys)


def parse_record(record: Column, struct: T.StructType) -> Column:
    """A JSON object as a struct. Numbers in quotes are read as numbers; what can't be read is null."""
    return F.from_json(record, struct, {"mode": "PERMISSIVE"})


def without_nulls(c: Column, t: T.DataType) -> Column:
    """Null arrays and maps become empty, within structs and arrays too; null scalars and null structs' fields stay null."""
    if isinstance(t, T.ArrayType):
        inner = F.transform(c, lambda x: without_nulls(x, t.elementType)) if isinstance(t.elementType, (T.ArrayType, T.StructType, T.MapType)) else c
        return F.coalesce(inner, F.array().cast(t))
    if isinstance(t, T.MapType):
        return F.coalesce(c, F.create_map().cast(t))
    if isinstance(t, T.StructType):
        return F.struct(*[without_nulls(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields])
    return c


def coerce_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: without_nulls(F.col(c), df.schema[c].dataType) for c in columns})


def record_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """Text that is equal for equal records: fields in the order of their names, map entries in the order of keys."""

    def plain(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.MapType):
            return F.array_sort(F.map_entries(c))
        if isinstance(t, T.StructType):
            return F.struct(*[plain(c.getField(f.name), f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)])
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.MapType)):
            return F.transform(c, lambda x: plain(x, t.elementType))
        return c

    return F.to_json(F.struct(*[plain(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def dedup_records(df: DataFrame, columns: Sequence[str], ord_col: str = "ord", spans_col: str | None = None) -> DataFrame:
    """The first of equal records; with ``spans_col`` it takes over the spans of the others, in their order, as ``merge_spans`` does, or ``merge_field_spans`` where they are a map.

    The key is hashed to 256 bits for the shuffle, so records as long as documents stay small; without
    spans equal records are already one before the shuffle, however many there are. Spans are rows until
    equal ones are one, so a record that very many documents hold takes no longer than as many records.
    """
    keyed = df.withColumn("__key", F.sha2(record_key(df, columns), 256))
    rest = [c for c in df.columns if c != spans_col]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), ord_col).alias("__r")
    if spans_col is None:
        return keyed.groupBy("__key").agg(first).select("__r.*")
    kind = df.schema[spans_col].dataType
    by_field = isinstance(kind, T.MapType)
    firsts = keyed.groupBy("__key").agg(first, F.bool_or(F.col(f"`{spans_col}`").isNotNull()).alias("__any"))
    given = keyed.where(F.col(f"`{spans_col}`").isNotNull()).select("__key", F.col(ord_col).alias("o"), F.col(f"`{spans_col}`").alias("s"))
    if by_field:
        lists = given.select("__key", "o", F.posexplode(F.map_entries("s")).alias("f", "e")).select("__key", "o", "f", F.col("e.key").alias("field"), F.col("e.value").alias("s"))
    else:
        lists = given.select("__key", "o", F.lit(0).alias("f"), F.lit("").alias("field"), "s")
    spans = lists.select("__key", "field", "o", "f", "s", F.posexplode_outer("s").alias("p", "span"))
    # Which of the equal spans of its own list each is: repeats within the first list stay.
    again = F.when(F.size("s") > 1, F.size(F.filter(F.slice("s", 1, F.coalesce("p", F.lit(0))), lambda x: x.eqNullSafe(F.col("span"))))).otherwise(0)
    state = F.when(F.col("s").isNull(), 0).when(F.size("s") == 0, 1).otherwise(2)
    each = spans.select("__key", "field", "span", again.alias("again"), state.alias("state"), F.struct("o", "f", "p").alias("at"))
    each = each.groupBy("__key", "field", "span", "again", "state").agg(F.min("at").alias("at"))
    fields = each.groupBy("__key", "field").agg(
        F.min(F.struct("at.o", "at.f")).alias("seen"), F.min(F.when(F.col("state") > 0, F.col("at.o"))).alias("base"), F.max("state").alias("state"),
        F.array_sort(F.collect_list(F.when(F.col("state") == 2, F.struct("at", "again", "span")))).alias("l"),
    )
    kept = F.transform(F.filter("l", lambda x: (x["again"] == 0) | (x["at"]["o"] == F.col("base"))), lambda x: x["span"])
    fields = fields.select("__key", "field", "seen", F.when(F.col("state") > 0, kept).alias("s"))
    if by_field:
        fields = fields.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("seen", "field", "s")), _by_seen).alias("l"))
        fields = fields.select("__key", F.map_from_entries(F.transform("l", lambda x: F.struct(x["field"], x["s"]))).alias("s"))
        merged = F.when(F.col("__any"), F.coalesce("s", F.create_map().cast(kind)))
    else:
        merged = F.col("s")
    return firsts.join(fields.select("__key", "s"), "__key", "left").select("__r.*", merged.alias(spans_col)).select(*[f"`{c}`" for c in df.columns])


def _by_seen(a: Column, b: Column) -> Column:
    """Spans have maps or structs within, so only the places are compared."""
    return F.when(a["seen"] < b["seen"], -1).when(a["seen"] > b["seen"], 1).otherwise(0)

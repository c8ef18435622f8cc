"""Column types of the tables that operators exchange."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

Json = dict[str, object]

SPAN = T.StructType(
    [
        T.StructField("quote", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("confidence", T.StringType()),
    ]
)
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_ord", T.LongType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
MAPPING = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("canonical", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("ontology_id", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("strategy", T.StringType()),
    ]
)
ONTOLOGY = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("synonyms", T.ArrayType(T.StringType()))]
)
USAGE = T.StructType(
    [
        T.StructField("call_ord", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("cost_usd", T.DoubleType()),
    ]
)


@dataclass
class Schema:
    """A discovered or given record schema; lives on the driver, it is a few kilobytes."""

    json_schema: Json
    field_metadata: dict[str, Json] = field(default_factory=dict)
    lineage: list = field(default_factory=list)

    @property
    def struct(self) -> T.StructType:
        from fieldloom.functions.jsonschema import to_struct

        return to_struct(self.json_schema)

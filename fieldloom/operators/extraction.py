"""Documents to records by a model, checked against the schema, with sources of each field."""

from __future__ import annotations

import json
import time
from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldloom.errors import ExtractionError, ProviderError
from fieldloom.functions import jsonschema
from fieldloom.functions.batches import pieces
from fieldloom.functions.plain import parse_object, parse_objects
from fieldloom.functions.text import EDGES, attempt_confidence, document_label
from fieldloom.operators.chunking import chunk_fixed, effective_chunk_size
from fieldloom.operators.checkpoint import cut
from fieldloom.operators.provenance import find_loosely
from fieldloom.operators.usage import estimate_extraction_cost
from fieldloom.operators.records import dedup_records, parse_record, without_nulls
from fieldloom.providers import LLMClient, in_flight
from fieldloom.schemas import SPAN

REPLIES = (
    "doc_ord bigint, doc_id string, source string, chunk_id string, chunk_index int, char_start int, char_end int, record_ord int, record string, attempt int, "
    "field_spans map<string,array<struct<quote:string,document_id:string,start:int,end:int,confidence:string>>>, "
    "input_tokens bigint, output_tokens bigint, latency_ms double, calls int, model string, error_type string, error string"
)


def conforms(value: Any, t: T.DataType) -> bool:
    """Whether a JSON value can be read as a type; numbers and truth values in quotes can, null always."""
    if value is None:
        return True
    if isinstance(t, T.StringType):
        return isinstance(value, str)
    if isinstance(t, T.BooleanType):
        return isinstance(value, bool) or value in (0, 1) or (isinstance(value, str) and value.lower() in ("true", "false", "yes", "no", "on", "off", "1", "0"))
    if isinstance(t, (T.LongType, T.DoubleType)):
        try:
            number = Decimal(value.strip()) if isinstance(value, str) else Decimal(value)
        except (TypeError, ValueError, InvalidOperation):
            return False
        if isinstance(t, T.DoubleType):
            return True
        return number.is_finite() and abs(number) < 1 << 63 and number == int(number)
    if isinstance(t, T.ArrayType):
        return isinstance(value, list) and all(conforms(x, t.elementType) for x in value)
    if isinstance(t, T.StructType):
        return isinstance(value, dict) and all(conforms(value.get(f.name), f.dataType) for f in t.fields)
    return isinstance(value, dict)


def lax(value: Any, t: T.DataType) -> Any:
    """The value as the type's JSON."""
    if value is None:
        return None
    if isinstance(t, T.BooleanType) and not isinstance(value, bool):
        return str(value).lower() in ("true", "yes", "on", "1")
    if isinstance(t, T.LongType):  # without a float in between, which holds 53 bits
        return int(Decimal(value.strip())) if isinstance(value, str) else int(value)
    if isinstance(t, T.DoubleType):
        return float(value)
    if isinstance(t, T.ArrayType):
        return [lax(x, t.elementType) for x in value]
    if isinstance(t, T.StructType):
        return {f.name: lax(value.get(f.name), f.dataType) for f in t.fields}
    return value


def locate(quote: str, text: str, doc_id: str, shift: int) -> tuple:
    """A span in document offsets: exact, loose, or none."""
    q = quote.strip(EDGES)
    if not q:
        return (quote, doc_id, None, None, "inferred")
    at = text.find(q)
    if at >= 0:
        return (quote, doc_id, shift + at, shift + at + len(q), "exact")
    found = find_loosely(q, text)
    return (quote, doc_id, shift + found[0], shift + found[1], "fuzzy") if found else (quote, doc_id, None, None, "unresolved")


def prompt(schema_text: str, content: str, hint: str = "") -> str:
    return f"Extract {hint or 'a record'} of this JSON schema. Reply with JSON only.\n{schema_text}\n---\n{content}\n---"


@dataclass
class LLMDirectExtraction:
    """One model call a chunk; a reply that can't be used is asked for again with the error, up to ``max_retries`` times.

    ``on_error``: ``raise`` fails the query, ``skip`` leaves failed chunks out, ``collect``
    returns them as rows with an error, whatever the client raises. A task has up to
    ``concurrency`` calls in flight.
    """

    client: LLMClient
    chunk_size: int = -1
    overlap: int = 200
    chunking: Any = None
    multi_record: bool = False
    record_hint: str = ""
    deduplicate: bool = True
    provenance: bool = False
    max_retries: int = 3
    on_error: str = "collect"
    concurrency: int = 8

    def chunks(self, docs: DataFrame) -> DataFrame:
        """The pieces, each with its document's label: it travels with the text, so identifiers needn't be unique or there at all."""
        named = docs.withColumn("source", document_label(F.col("source"), F.col("doc_id")))
        return self.chunking.chunk(named) if self.chunking is not None else chunk_fixed(named, effective_chunk_size(self.chunk_size, self.multi_record), self.overlap)

    def asked(self, schema: dict) -> dict:
        """The schema that a reply must follow."""
        one = jsonschema.with_sources(schema) if self.provenance else schema
        return {"type": "array", "items": one} if self.multi_record else one

    def prompts(self, docs: DataFrame, schema: dict) -> DataFrame:
        """The chunks, with ``prompt``: the text of each one's first call, to the letter."""
        before, after = prompt(json.dumps(self.asked(schema)), "\0", self.record_hint).split("\0")
        return self.chunks(docs).withColumn("prompt", F.concat(F.lit(before), "content", F.lit(after)))

    def estimate_cost(self, docs: DataFrame, schema: dict, model: str, records_per_chunk: int | None = None, pricing: dict | None = None) -> DataFrame:
        """One row: calls, tokens and cost of ``extract``, from the exact prompts."""
        many = records_per_chunk or (3 if self.multi_record else 1)
        return estimate_extraction_cost(self.prompts(docs, schema), F.col("prompt"), schema, model, records_per_chunk=many, provenance=self.provenance, pricing=pricing)

    def replies(self, docs: DataFrame, schema: dict) -> DataFrame:
        """A row for each record, or for each chunk that failed; calls and their tokens are columns."""
        return self.chunks(docs).mapInArrow(self._caller(schema), REPLIES)

    def _caller(self, schema: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        struct, need = jsonschema.to_struct(schema), jsonschema.required(schema)
        asked = self.asked(schema)
        text, client, multi, hint, tries, sources, at_once = json.dumps(asked), self.client, self.multi_record, self.record_hint, self.max_retries + 1, self.provenance, self.concurrency

        def check(raw: dict) -> tuple[dict, dict]:
            values, quotes = jsonschema.without_sources(raw) if sources else (raw, {})
            lacking = [k for k in need if k not in values]
            if lacking:
                raise ValueError(f"missing: {', '.join(lacking)}")
            wrong = [f.name for f in struct.fields if not conforms(values.get(f.name), f.dataType)]
            if wrong:
                raise ValueError(f"wrong type: {', '.join(wrong)}")
            return {f.name: lax(values.get(f.name), f.dataType) for f in struct.fields}, quotes

        def one(c: Any) -> list[tuple]:
            head = (c.doc_ord, c.doc_id, c.source, c.chunk_id, c.chunk_index, c.char_start, c.char_end)
            messages = [{"role": "user", "content": prompt(text, c.content, hint)}]
            tokens_in = tokens_out = calls = 0
            spent, model, said, kind = 0.0, None, "", ""
            for attempt in range(tries):
                began, r = time.perf_counter(), None
                try:
                    calls += 1
                    try:
                        r = client.complete(messages, schema=asked)
                    finally:
                        spent += 1000 * (time.perf_counter() - began)
                    tokens_in, tokens_out, model = tokens_in + r.input_tokens, tokens_out + r.output_tokens, r.model
                    found = [check(x) for x in (parse_objects(r.content) if multi else [parse_object(r.content)])]
                except ProviderError as e:
                    said, kind = str(e), "ProviderError"
                    break
                except Exception as e:  # noqa: BLE001 - one bad reply, or one bad call, must not lose the others
                    said, kind = str(e) or type(e).__name__, "ExtractionError" if isinstance(e, ValueError) else type(e).__name__
                    if r is None:
                        break
                    messages = [messages[0], dict(role="assistant", content=r.content), dict(role="user", content=f"That can't be used ({e}). Reply again with JSON only.\n{messages[0]['content']}")]
                    continue
                rows = []
                for k, (values, quotes) in enumerate(found):
                    spans = {f: [locate(q, c.content, c.doc_id, head[5] or 0) for q in qs] for f, qs in quotes.items()} if sources else None
                    first = (tokens_in, tokens_out, spent, calls) if k == 0 else (0, 0, 0.0, 0)
                    rows.append((*head, k, json.dumps(values, ensure_ascii=False), 0 if multi else attempt, spans, *first, model, None, None))
                return rows
            return [(*head, 0, None, tries - 1, None, tokens_in, tokens_out, spent, calls, model, kind, said)]

        kinds = to_arrow_schema(T.StructType.fromDDL(REPLIES))
        spans = T.StructType.fromDDL(REPLIES).fieldNames().index("field_spans")

        def told(row: tuple) -> tuple:
            found = row[spans]
            return row if found is None else (*row[:spans], {f: [dict(zip(SPAN.names, x)) for x in v] for f, v in found.items()}, *row[spans + 1 :])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A piece of a batch at a time: a document may become many records, each with its evidence."""
            for batch in batches:
                chunk = namedtuple("Chunk", batch.schema.names)
                for some in pieces(batch, "content"):
                    rows = [told(r) for made in in_flight(one, [chunk(*x) for x in zip(*(c.to_pylist() for c in some.columns))], at_once) for r in made]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

        return run

    def extract(self, docs: DataFrame, schema: dict) -> DataFrame:
        """``doc_ord, doc_id, chunk_id, record_ord, record, provenance, error``, and the tokens of each call."""
        struct = jsonschema.to_struct(schema)
        got = self.replies(docs, schema)
        if self.on_error == "skip":
            got = got.where("error IS NULL")
        elif self.on_error == "raise":
            got = got.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("extraction failed: "), "error")).cast("string")))
        elif self.on_error != "collect":
            raise ExtractionError(f"on_error can't be {self.on_error!r}")
        record = without_nulls(parse_record(F.col("record"), struct), struct)
        origin = F.struct(
            F.col("source").alias("source_document"), "chunk_index", "char_start", "char_end",
            F.when(F.lit(self.multi_record), F.lit(1.0)).otherwise(attempt_confidence(F.col("attempt"))).alias("confidence"), "field_spans",
        )
        out = got.select(
            "doc_ord", "doc_id", "chunk_id", "chunk_index", "record_ord", F.when(F.col("error").isNull(), record).alias("record"), F.when(F.col("error").isNull(), origin).alias("provenance"),
            F.when(F.col("error").isNotNull(), F.struct(F.col("error_type").alias("type"), F.col("error").alias("message"))).alias("error"), "input_tokens", "output_tokens", "latency_ms", "calls", "model",
        )
        if not (self.multi_record and self.deduplicate):
            return out
        out = cut(out)  # it is read twice, and each call is made once
        ordered = out.where("error IS NULL").withColumn("__ord", F.struct(F.coalesce("doc_ord", F.lit(-1)), F.coalesce("doc_id", F.lit("")), F.coalesce("chunk_index", F.lit(0)), "record_ord"))
        if self.provenance:
            spans = ordered.withColumn("__spans", F.col("provenance.field_spans"))
            first = dedup_records(spans, ["record"], "__ord", "__spans")
            first = first.withColumn("provenance", F.col("provenance").withField("field_spans", F.col("__spans"))).drop("__spans")
        else:
            first = dedup_records(ordered, ["record"], "__ord")
        return first.drop("__ord").unionByName(out.where("error IS NOT NULL"))


def records_of(result: DataFrame) -> DataFrame:
    return result.where("error IS NULL").select("doc_ord", "doc_id", "chunk_id", "record_ord", "record.*")


def errors_of(result: DataFrame) -> DataFrame:
    return result.where("error IS NOT NULL").select("doc_id", "chunk_id", "error.*")


def usage_of(result: DataFrame, stage: str = "extraction") -> DataFrame:
    """Usage rows of the calls behind the rows of a result; a ``Meter`` also counts those whose records were repeats."""
    return result.where("calls > 0").select(F.xxhash64("chunk_id").alias("call_ord"), F.lit(stage).alias("stage"), "model", "calls", "input_tokens", "output_tokens", "latency_ms")


__all__ = ["LLMDirectExtraction", "conforms", "errors_of", "lax", "records_of", "usage_of"]

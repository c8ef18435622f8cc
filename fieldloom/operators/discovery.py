"""Schemas from sample documents. The samples are a few dozen rows; corpus-wide counts stay tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.errors import DiscoveryError
from fieldloom.functions import jsonschema
from fieldloom.functions.plain import parse_object
from fieldloom.functions.text import or_default, truncate
from fieldloom.operators.checkpoint import cut
from fieldloom.operators.extraction import LLMDirectExtraction
from fieldloom.operators.profile import coverage, coverage_listing, gaps, head, sample
from fieldloom.providers import LLMClient
from fieldloom.schemas import Schema


def field_lines_rule(prompt: str) -> str:
    """An offline model for discovery: a schema of the ``key: value`` lines in the prompt's documents."""
    props = {}
    for line in prompt.split("\n"):
        key, sep, value = line.partition(":")
        name = key.strip().lower().replace(" ", "_")
        if not sep or not name.isidentifier() or not value.strip() or len(name) > 40:
            continue
        v = value.strip()
        kind = "integer" if v.lstrip("-").isdigit() else "number" if v.replace(".", "", 1).lstrip("-").isdigit() else "boolean" if v.lower() in ("true", "false") else "string"
        old = props.get(name, {}).get("type", kind)
        props[name] = {"type": kind if old == kind else "number" if {old, kind} == {"integer", "number"} else "string"}
    return json.dumps(dict(type="object", properties=props))


def field_lines_extract(prompt: str) -> str:
    """An offline model for extraction: the ``key: value`` lines between the prompt's rules."""
    body = prompt.split("\n---\n", 1)[-1].rsplit("\n---", 1)[0]
    out = {}
    for line in body.split("\n"):
        key, sep, value = line.partition(":")
        if sep and key.strip().lower().replace(" ", "_").isidentifier() and value.strip():
            out[key.strip().lower().replace(" ", "_")] = value.strip()
    return json.dumps(out)


def _with_ids(docs: DataFrame, prefix: str) -> DataFrame:
    return docs.withColumn("doc_id", or_default(F.col("doc_id"), F.concat(F.lit(prefix), F.col("doc_ord"))))


def _texts(docs: DataFrame, max_doc_chars: int) -> list[str]:
    return [r.c for r in docs.orderBy("doc_ord").select(truncate(F.coalesce("content", F.lit("")), max_doc_chars, "\n... [cut]").alias("c")).collect()]


@dataclass
class SinglePassDiscovery:
    """One call on a sample of documents."""

    client: LLMClient
    num_samples: int = 5
    max_doc_chars: int = 30_000
    focus: str = ""
    max_fields: int | None = None
    suggested_fields: tuple[str, ...] = ()
    temperature: float = 0.3
    seed: int = 42

    def discover(self, docs: DataFrame, domain_hint: str = "") -> Schema:
        texts = _texts(sample(docs, self.num_samples, self.seed), self.max_doc_chars)
        if not texts:
            raise DiscoveryError("there are no documents")
        asks = [x for x in (domain_hint and f"Domain {domain_hint}.", self.focus and f"Focus on {self.focus}.", self.max_fields and f"Use at most {self.max_fields} fields.", self.suggested_fields and "Consider " + ", ".join(self.suggested_fields) + ".") if x]
        prompt = " ".join(["Reply with a JSON Schema for one record of these documents.", *asks]) + "".join(f"\n\n{t}" for t in texts)
        found = jsonschema.parse_schema(self.client.complete([{"role": "user", "content": prompt}], temperature=self.temperature).content)
        if not found.get("properties"):
            raise DiscoveryError("the schema has no fields")
        jsonschema.to_struct(found)
        return Schema(found, {}, ["SinglePassDiscovery"])


def probe(docs: DataFrame, schema: dict, client: LLMClient) -> DataFrame:
    """Records of sample documents, by document identifier; documents that fail have nulls, so that they count."""
    got = LLMDirectExtraction(client, chunk_size=0, on_error="collect").extract(docs, schema)
    return got.select("doc_id", "doc_ord", "record.*")


@dataclass
class ThreeStageDiscovery:
    """A first schema, changed after a look at what it extracts, then widened on more documents.

    With fewer than ``min_samples_for_removal`` documents in the second stage, and always in
    the third, fields are only added. ``human_review`` stops after the second stage.
    """

    client: LLMClient
    stage1_samples: int = 3
    stage2_samples: int = 10
    stage3_samples: int = 50
    min_samples_for_removal: int = 5
    human_review: bool = False
    max_doc_chars: int = 30_000
    seed: int = 42
    reports: dict[str, Any] = field(default_factory=dict)

    def _refined(self, schema: dict, docs: DataFrame, additive: bool, stage: int) -> tuple[dict, DataFrame]:
        records = cut(probe(docs, schema, self.client))
        found = coverage(records, list(schema["properties"]))
        lines = [r.line for r in coverage_listing(found).collect()]
        shown = [r.asDict(True) for r in records.orderBy("doc_ord").limit(3).collect()]
        prompt = "Reply with add_fields, remove_fields, modify_fields for this schema as JSON.\n" + "\n".join([json.dumps(schema), *lines, json.dumps(shown, default=str)])
        try:
            changes = parse_object(self.client.complete([{"role": "user", "content": prompt}]).content)
        except ValueError:
            changes = {}
        self.reports[f"stage{stage}"] = {r.field: r.coverage for r in found.collect()}
        return jsonschema.apply_changes(schema, changes, additive), records

    def discover(self, docs: DataFrame, domain_hint: str = "") -> Schema:
        docs = _with_ids(docs, "_discovery_doc_")
        first = SinglePassDiscovery(self.client, self.stage1_samples, self.max_doc_chars, seed=self.seed).discover(docs, domain_hint)
        some = cut(sample(docs, self.stage2_samples, self.seed))
        schema, _ = self._refined(first.json_schema, some, some.count() < self.min_samples_for_removal, 2)
        lineage = ["ThreeStageDiscovery:stage1", "ThreeStageDiscovery:stage2"]
        if not self.human_review:
            schema, records = self._refined(schema, sample(docs, self.stage3_samples, self.seed), True, 3)
            lineage.append("ThreeStageDiscovery:stage3")
            self.reports["final"] = {r.field: r.coverage for r in coverage(records, list(schema["properties"])).collect()}
        return Schema(schema, {}, lineage)


@dataclass
class SchemaOptimizer:
    """Descriptions, examples and synonyms of fields, from what a schema extracts; the fields stay as they are."""

    client: LLMClient
    num_iterations: int = 5
    max_docs_per_iteration: int = 10

    def optimize(self, schema: Schema, docs: DataFrame) -> Schema:
        some = head(_with_ids(docs, "_optimizer_doc_"), self.max_docs_per_iteration)
        metadata = {k: dict(v) for k, v in schema.field_metadata.items()}
        lineage = list(schema.lineage)
        for k in range(1, self.num_iterations + 1):
            described = dict(schema.json_schema)
            described["properties"] = {n: {**p, **({"description": metadata[n]["description"]} if metadata.get(n, {}).get("description") else {})} for n, p in schema.json_schema["properties"].items()}
            notes = gaps(coverage(probe(some, described, self.client), list(described["properties"]))).collect()
            prompt = "Enrich the fields; reply with fields: {name: {description, examples, synonyms}} as JSON.\n" + json.dumps(described) + "".join(f"\n{r.field}: {r.note}" for r in notes)
            try:
                got = parse_object(self.client.complete([{"role": "user", "content": prompt}]).content).get("fields") or {}
            except ValueError:
                got = {}
            for name, extra in got.items():
                if name in schema.json_schema["properties"] and isinstance(extra, dict):
                    metadata.setdefault(name, {}).update(extra)
            lineage.append(f"SchemaOptimizer:iter{k}")
        return Schema(schema.json_schema, metadata, lineage)


EDITS = ("add_fields", "remove_fields", "modify_fields")


@dataclass
class SchemaFeedback:
    """Edits of a schema: explicit ones, and an instruction that a model turns into edits."""

    add_fields: dict[str, dict] = field(default_factory=dict)
    remove_fields: list[str] = field(default_factory=list)
    modify_fields: dict[str, dict] = field(default_factory=dict)
    instruction: str = ""


def refine_schema(schema: Schema, feedback: SchemaFeedback, client: LLMClient | None = None) -> Schema:
    """The instruction first, explicit edits after it; what is known of fields stays with those that stay."""
    out, lineage = schema.json_schema, list(schema.lineage)
    if feedback.instruction:
        if client is None:
            raise DiscoveryError("an instruction needs a model")
        prompt = f"Reply with add_fields, remove_fields, modify_fields as JSON. {feedback.instruction}\n{json.dumps(out)}"
        out = jsonschema.apply_changes(out, parse_object(client.complete([{"role": "user", "content": prompt}]).content))
        lineage.append("refine:instruction")
    if any(getattr(feedback, k) for k in EDITS):
        out = jsonschema.apply_changes(out, {k: getattr(feedback, k) for k in EDITS})
        lineage.append("refine:explicit")
    if len(lineage) == len(schema.lineage):
        lineage.append("refine:noop")
    return Schema(out, {k: v for k, v in schema.field_metadata.items() if k in out.get("properties", {})}, lineage)


def choose_fields(reply: str, known: list[str]) -> list[str]:
    """Known field names of a reply, repeats kept; none if the reply isn't a list."""
    try:
        got = json.loads(reply.strip().removeprefix("```json").removesuffix("```"))
    except ValueError:
        return []
    return [x for x in got if isinstance(x, str) and x in known] if isinstance(got, list) else []


@dataclass
class LLMFieldSelector:
    """A model's choice of fields to normalize, by samples of their values; without string fields no call is made."""

    client: LLMClient
    shown: int = 10

    def select(self, records: DataFrame, schema: dict) -> list[str]:
        from fieldloom.operators.profile import samples

        fields = [f for f in jsonschema.string_fields(schema) if f in records.columns]
        if not fields:
            return []
        known = {r.field: list(r.samples) for r in samples(records, fields).collect()}
        prompt = "Which fields hold spellings of the same things? Reply with a JSON list of names." + "".join(f"\n{f}: {', '.join(known.get(f, [])[: self.shown])}" for f in fields)
        return choose_fields(self.client.complete([{"role": "user", "content": prompt}]).content, fields)


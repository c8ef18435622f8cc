"""Queries over operators that ask models, by offline ones whose answers SQL can give too."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import jsonschema
from fieldloom.functions.jsonschema import object_of
from fieldloom.operators import clustering, ontology, registry
from fieldloom.operators.cascade import CascadeNormalization
from fieldloom.operators.canonical import LLMCanonicalization
from fieldloom.operators.chunking import chunk_semantically
from fieldloom.operators.discovery import LLMFieldSelector, SchemaFeedback, SchemaOptimizer, SinglePassDiscovery, ThreeStageDiscovery, probe, refine_schema
from fieldloom.operators.extraction import LLMDirectExtraction, errors_of
from fieldloom.operators.profile import sample
from fieldloom.pipeline import Pipeline
from fieldloom.plans.tables import documents, table
from fieldloom.plans.text_plans import _EDGES, CHUNKS
from fieldloom.providers import RuleClient, embed_column, embed_distinct, resolve_provider


@dataclass
class LetterCounts:
    """Embeddings that SQL can compute: how often each letter from a to z occurs."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [[float(t.lower().count(chr(97 + k))) for k in range(26)] for t in texts]


def _letters(text: str) -> str:
    return f"list_transform(range(97, 123), lambda i: CAST(length({text}) - length(replace(lower({text}), chr(CAST(i AS INTEGER)), '')) AS DOUBLE))"


def _said(prompt: str) -> str:
    return prompt.split("\n---\n", 1)[1].removesuffix("\n---")


def embedding_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct part name embedded once."""
    got = embed_distinct(table(spark, sf_dir, "part").select("p_name"), LetterCounts(), "p_name")
    return got.select("p_name", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("letters"))


EMBEDDING_MEMO = f"SELECT DISTINCT p_name, array_to_string(list_transform({_letters('p_name')}, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',') AS letters FROM part WHERE p_name IS NOT NULL"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, a third of them misspelled."""
    p = table(spark, sf_dir, "part").where("p_name IS NOT NULL")
    odd = F.when(F.col("p_size") % 3 == 0, F.regexp_replace("p_name", "e", "ee")).otherwise(F.col("p_name"))
    return p.select(odd.alias("value"), F.col("p_partkey").alias("ord"))


def ontology_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.concat(F.lit("P:"), F.min("p_partkey").cast("string")).alias("id"), F.array_sort(F.collect_set("p_type")).alias("synonyms"))
    got = ontology.OntologyMapping(terms, LetterCounts()).normalize(_names(spark, sf_dir), "p_name")
    return got.select("raw", "canonical", "ontology_id", F.round("confidence", 6).alias("confidence"), "explanation")


_VALUES = "v AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN replace(p_name, 'e', 'ee') ELSE p_name END AS raw FROM part WHERE p_name IS NOT NULL)"


def _best(synonyms: str) -> str:
    """The best entry of each value: the highest cosine over all index texts, the least identifier on ties."""
    return f"""
t AS (SELECT p_name AS name, 'P:' || CAST(min(p_partkey) AS VARCHAR) AS id, {synonyms} AS syn FROM part GROUP BY 1),
x AS (SELECT id, name, syn, unnest(list_prepend(name, syn)) AS text FROM t),
n AS (SELECT lower(text) AS low, count(DISTINCT id) AS n FROM x GROUP BY 1),
s AS (SELECT id, name, CASE WHEN n > 1 THEN text || CASE WHEN len(syn) > 0 THEN ' (also known as: ' || array_to_string(syn[1:3], ', ') || '; [' ELSE ' ([' END || id || '])' ELSE text END AS shown FROM x JOIN n ON low = lower(text)),
c AS (SELECT raw, id, name, round(list_cosine_similarity({_letters('raw')}, {_letters('shown')}), 12) AS score FROM v CROSS JOIN s),
b AS (SELECT raw, arg_min(id, (-score, id)) AS id, arg_min(name, (-score, id)) AS name, max(score) AS score FROM c GROUP BY 1)"""


ONTOLOGY_MAPPING = f"""
WITH {_VALUES}, {_best("list_sort(list(DISTINCT p_type))")}
SELECT raw, name AS canonical, id AS ontology_id, round(score, 6) AS confidence, '→ ' || name || ' (' || id || '), confidence=' || printf('%.3f', score) AS explanation FROM b
"""


def cascade_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary, then an ontology, by confidence."""
    terms = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.concat(F.lit("P:"), F.min("p_partkey").cast("string")).alias("id"), F.array().cast("array<string>").alias("synonyms"))
    steps = CascadeNormalization.default({"RED BOLT": "crimson screw"}, ontology=ontology.OntologyMapping(terms, LetterCounts()))
    return steps.normalize(_names(spark, sf_dir), "p_name").select("raw", "canonical", "step")


CASCADE_DEFAULT = f"""
WITH {_VALUES}, {_best("CAST([] AS VARCHAR[])")}
SELECT raw, CASE WHEN lower(raw) = 'red bolt' THEN 'crimson screw' WHEN score >= 0.9 THEN name ELSE raw END AS canonical,
       CAST(CASE WHEN lower(raw) = 'red bolt' THEN 0 WHEN score >= 0.9 AND name <> raw THEN 1 END AS INTEGER) AS step FROM b
"""


def agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and the same words the other way round, which have the same letters: one cluster each."""
    p = table(spark, sf_dir, "part").where("p_name IS NOT NULL")
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    values = p.select(F.when(F.col("p_size") % 3 == 0, turned).otherwise(F.col("p_name")).alias("value"), F.col("p_partkey").alias("ord"))
    return clustering.EmbeddingClustering(LetterCounts(), similarity_threshold=1 - 1e-9).normalize(values, "p_name").select("raw", "canonical")


AGGLOMERATIVE = f"""
WITH v AS (SELECT CASE WHEN p_size % 3 = 0 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') ELSE p_name END AS raw, p_partkey FROM part WHERE p_name IS NOT NULL),
f AS (SELECT raw, count(*) AS n, min(p_partkey) AS o FROM v GROUP BY 1), k AS (SELECT *, {_letters('raw')} AS letters FROM f)
SELECT raw, first_value(raw) OVER (PARTITION BY letters ORDER BY n DESC, o, raw) AS canonical FROM k
"""


def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits where the letters of neighbouring sentences differ."""
    made = chunk_semantically(documents(spark, sf_dir), embed_column(LetterCounts()), 0.7531)
    return made.select("doc_ord", "chunk_id", "chunk_index", "char_start", "char_end", F.md5("content").alias("digest"))


CHUNK_SEMANTIC = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
p AS (SELECT doc_id, list_filter(regexp_extract_all(body, '[^.!?\n]*(?:[.!?]+["'')\\]]*[ \t\r\n\f\v]*|\n+|$)'), lambda x: length(x) > 0) AS l FROM t),
q AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [''] ELSE l END AS l FROM p),
u AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM q),
e AS (SELECT doc_id, s, i, {_letters('s')} AS v FROM u),
w AS (SELECT *, lag(v) OVER d AS b, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, CASE WHEN b IS NOT NULL AND CASE WHEN list_sum(v) = 0 OR list_sum(b) = 0 THEN 0 ELSE list_cosine_similarity(b, v) END < 0.7531 THEN 1 ELSE 0 END AS x FROM w),
k AS (SELECT *, sum(x) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT doc_id AS doc_ord, CAST(doc_id AS VARCHAR) || '__chunk_' || CAST(k AS VARCHAR) AS chunk_id, CAST(k AS INTEGER) AS chunk_index, CAST(min(a) AS INTEGER) AS char_start,
       CAST(max(a + length(s)) AS INTEGER) AS char_end, md5(string_agg(s, '' ORDER BY i)) AS digest FROM k GROUP BY doc_id, k
"""

RECORD = object_of("first", "length", first="string", length="integer")


def _record(prompt: str) -> str:
    said = _said(prompt)
    return json.dumps({"first": said[:12], "length": len(said)})


def extract_awkward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which a seventh has no identifier and the others share a hundred: each is there once."""
    odd = F.when(F.col("doc_ord") % 7 != 0, F.col("doc_ord") % 100)
    docs = documents(spark, sf_dir).withColumn("doc_ord", odd).withColumn("doc_id", F.col("doc_ord").cast("string"))
    got = LLMDirectExtraction(RuleClient(_record)).extract(docs, RECORD)
    return got.select("doc_ord", "chunk_id", F.col("provenance.source_document").alias("source"), "record.first", "record.length")


EXTRACT_AWKWARD = f"""
WITH {CHUNKS}, o AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 100 END AS o, coalesce(nullif(source, ''), CAST(CASE WHEN doc_id % 7 <> 0 THEN doc_id % 100 END AS VARCHAR), 'unknown') AS source FROM documents)
SELECT o AS doc_ord, CASE WHEN chunk_index IS NULL THEN CAST(o AS VARCHAR) ELSE coalesce(CAST(o AS VARCHAR), 'doc') || '__chunk_' || CAST(chunk_index AS VARCHAR) END AS chunk_id, source,
       substring(content, 1, 12) AS first, CAST(length(content) AS BIGINT) AS length FROM c JOIN o ON c.doc_ord = o.doc_id
"""


def _sourced(prompt: str) -> str:
    said = _said(prompt)
    return json.dumps({"first": {"value": said[20:32], "source_quotes": [said[20:32]]}, "length": {"value": str(len(said)), "source_quotes": []}})


def extract_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in the whole document each field was quoted."""
    got = LLMDirectExtraction(RuleClient(_sourced), provenance=True).extract(documents(spark, sf_dir), RECORD)
    span = F.try_element_at(F.try_element_at("provenance.field_spans", F.lit("first")), F.lit(1))
    return got.select("doc_ord", "chunk_id", "record.first", "record.length", span["start"].alias("start"), span["end"].alias("end"), span["confidence"].alias("confidence"))


EXTRACT_PROVENANCE = f"""
WITH {CHUNKS}, q AS (SELECT *, substring(content, 21, 12) AS first, trim(substring(content, 21, 12), {_EDGES}) AS q FROM c)
SELECT doc_ord, chunk_id, first, CAST(length(content) AS BIGINT) AS length, CAST(CASE WHEN q <> '' THEN coalesce(char_start, 0) + strpos(content, q) - 1 END AS INTEGER) AS start,
       CAST(CASE WHEN q <> '' THEN coalesce(char_start, 0) + strpos(content, q) - 1 + length(q) END AS INTEGER) AS "end", CASE WHEN first = '' THEN NULL WHEN q = '' THEN 'inferred' ELSE 'exact' END AS confidence FROM q
"""


def _lines(prompt: str) -> str:
    return json.dumps([{"line": {"value": x, "source_quotes": [x]}} for x in _said(prompt).split("\n")])


def extract_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line a record, equal ones once, with the evidence of all documents that hold it."""
    got = LLMDirectExtraction(RuleClient(_lines), multi_record=True, provenance=True).extract(documents(spark, sf_dir), object_of(line="string"))
    spans = F.try_element_at("provenance.field_spans", F.lit("line"))
    return got.select("doc_ord", F.md5("record.line").alias("digest"), F.size(spans).alias("n_spans"), F.size(F.array_distinct(F.transform(spans, lambda s: s["document_id"]))).alias("n_documents"))


EXTRACT_EVIDENCE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT min(doc_id) AS doc_ord, md5(line) AS digest, CAST(CASE WHEN line = '' THEN 0 ELSE count(DISTINCT doc_id) END AS INTEGER) AS n_spans, CAST(CASE WHEN line = '' THEN 0 ELSE count(DISTINCT doc_id) END AS INTEGER) AS n_documents FROM l GROUP BY line
"""


def _fails_at_times(prompt: str) -> str:
    said = _said(prompt)
    if len(said) % 5 == 0:
        return '{"first": Infinity'
    if len(said) % 5 == 1 or (len(said) % 5 == 2 and not prompt.startswith("That can't be used")):
        return json.dumps({"first": said[:3], "length": "many"})
    return json.dumps({"first": said[:3], "length": len(said)})


def extract_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that aren't JSON, that never fit the schema, and that do when asked for again."""
    got = LLMDirectExtraction(RuleClient(_fails_at_times), chunk_size=0, max_retries=2).extract(documents(spark, sf_dir), RECORD)
    return got.select("doc_ord", "record.first", "record.length", F.col("error.type").alias("error"), "provenance.confidence", "calls")


EXTRACT_FAILURES = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) % 5 AS m FROM documents)
SELECT doc_id AS doc_ord, CASE WHEN m > 1 THEN substring(body, 1, 3) END AS first, CAST(CASE WHEN m > 1 THEN length(body) END AS BIGINT) AS length, CASE WHEN m <= 1 THEN 'ExtractionError' END AS error,
       CASE WHEN m = 2 THEN 0.7::DOUBLE WHEN m > 2 THEN 1.0::DOUBLE END AS confidence, CAST(CASE WHEN m <= 1 THEN 3 WHEN m = 2 THEN 2 ELSE 1 END AS INTEGER) AS calls FROM d
"""


def extraction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors as a table, and what is left of them where they are skipped."""
    kinds = {}
    for mode in ("collect", "skip"):
        got = LLMDirectExtraction(RuleClient(_fails_at_times), chunk_size=0, max_retries=0, on_error=mode).extract(documents(spark, sf_dir), RECORD)
        kinds[mode] = errors_of(got).groupBy(F.lit(mode).alias("mode"), "type").agg(F.count("*").alias("n"))
    return kinds["collect"].unionByName(kinds["skip"])


EXTRACTION_ERRORS = "SELECT 'collect' AS mode, 'ExtractionError' AS type, count(*) AS n FROM documents WHERE length(coalesce(text, '')) % 5 <= 2"

_PROMPTING = LLMDirectExtraction(RuleClient(_record), record_hint="the first words", provenance=True)


def extraction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _PROMPTING.prompts(documents(spark, sf_dir), RECORD).select("doc_ord", "chunk_id", F.md5("prompt").alias("digest"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_BEFORE = f"Extract the first words of this JSON schema. Reply with JSON only.\n{json.dumps(jsonschema.with_sources(RECORD))}\n---\n"
_PROMPT = f"{_quoted(_BEFORE)} || content || chr(10) || '---'"
EXTRACTION_PROMPTS = f"WITH {CHUNKS} SELECT doc_ord, chunk_id, md5({_PROMPT}) AS digest FROM c"


def extraction_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the exact prompts, schema and all."""
    return _PROMPTING.estimate_cost(documents(spark, sf_dir), RECORD, "gpt-4o-mini").withColumn("notes", F.array_join("notes", "; "))


EXTRACTION_COST_ESTIMATE = f"""
WITH {CHUNKS}, z AS (SELECT count(*) AS n, CAST(coalesce(sum(ceil(length({_PROMPT}) / 4.0) + 4), 0) AS BIGINT) AS t FROM c)
SELECT 'gpt-4o-mini' AS model, CAST(n AS BIGINT) AS n_calls, t AS input_tokens, CAST(n * 180 AS BIGINT) AS output_tokens,
       round((t * 0.15::DOUBLE + n * 180 * 0.6::DOUBLE) / 1e6::DOUBLE, 6) AS cost_usd, 'source quotes triple the output' AS notes FROM z
"""


def augmented_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other wordings of part names, in batches of thirty; those that the model doesn't know have none."""
    def more(prompt: str) -> str:
        return json.dumps({v: [v.upper(), v[::-1], ""] for v in (x[2:] for x in prompt.split("\n")[1:]) if len(v) % 3})

    return ontology.augment(table(spark, sf_dir, "part").where("p_name IS NOT NULL").select(F.col("p_name").alias("value")), RuleClient(more))


AUGMENTED_VALUES = "SELECT value, unnest([upper(value), reverse(value)]) AS phrase FROM (SELECT DISTINCT p_name AS value FROM part WHERE length(p_name) % 3 <> 0)"


def rerank_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the three dearest parts of each supplier a model takes the last by name, or answers something else."""
    def choose(prompt: str) -> str:
        ids = sorted(line.split(": ", 1)[0] for line in prompt.split("\n")[1:])
        return "no idea" if len(ids[0]) % 2 else json.dumps({"id": ids[-1] if len(ids[-1]) % 2 else "unknown", "confidence": 0.5, "rationale": "last"})

    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("value"), F.col("l_partkey").cast("string").alias("id")).agg((F.max("l_extendedprice") / 1e6).alias("score"))
    top = ontology.top_candidates(items.withColumn("name", F.lit("part")), 3)
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.array("p_brand").alias("synonyms"))
    return ontology.rerank(top, names, RuleClient(choose)).select("value", "id", F.round("confidence", 6).alias("confidence"), "rationale")


RERANK_CHOICE = """
WITH i AS (SELECT CAST(l_suppkey AS VARCHAR) AS value, CAST(l_partkey AS VARCHAR) AS id, max(l_extendedprice) / 1e6::DOUBLE AS score FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, id) AS n FROM i),
g AS (SELECT value, list(id ORDER BY n) AS by_rank, list_sort(list(id)) AS ids, max(score) AS best FROM r WHERE n <= 3 GROUP BY 1)
SELECT value, CASE WHEN length(ids[1]) % 2 = 1 OR length(ids[-1]) % 2 = 0 THEN by_rank[1] ELSE ids[-1] END AS id,
       round(CASE WHEN length(ids[1]) % 2 = 1 THEN best WHEN length(ids[-1]) % 2 = 0 THEN 0 ELSE 0.5 END, 6) AS confidence, CASE WHEN length(ids[1]) % 2 = 1 THEN NULL ELSE 'last' END AS rationale FROM g
"""


def _discoverer(prompt: str) -> str:
    if prompt.startswith("Extract"):
        said = _said(prompt)
        return json.dumps({"first": said[:1], "odd": said[:3] if len(said) % 2 else None, "words": said.count(" ")})
    if prompt.startswith("Reply with add_fields"):
        return json.dumps({"add_fields": {"words": {"type": "integer"}, "no": "object"}})
    return "```json\n" + json.dumps({"schema": object_of(first="string", odd="string")}) + "\n```"


def three_stage_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage that the last stage found over its fifty documents (the stages look at samples by design)."""
    strategy = ThreeStageDiscovery(RuleClient(_discoverer))
    found = strategy.discover(documents(spark, sf_dir))
    rows = [(f, p["type"], strategy.reports["final"][f], ",".join(found.lineage[-1:])) for f, p in found.json_schema["properties"].items()]
    return spark.createDataFrame(rows, "field string, type string, coverage double, stage string")


_SAMPLE = "SELECT doc_id, coalesce(text, '') AS body FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR) LIMIT 50"
THREE_STAGE_DISCOVERY = f"""
WITH s AS ({_SAMPLE}), c AS (SELECT avg(length(body) % 2) AS odd FROM s)
SELECT field, type, CASE WHEN field = 'odd' THEN odd ELSE 1.0::DOUBLE END AS coverage, 'ThreeStageDiscovery:stage3' AS stage FROM c, (VALUES ('first', 'string'), ('odd', 'string'), ('words', 'integer')) AS v(field, type)
"""


def probe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a schema extracts from each document, failed ones with nulls."""
    def half(prompt: str) -> str:
        said = _said(prompt)
        return json.dumps({"first": said[:5]}) if len(said) % 2 else "no"

    return probe(documents(spark, sf_dir), object_of(first="string"), RuleClient(half)).select("doc_ord", "doc_id", "first")


PROBE_DOCUMENTS = "SELECT doc_id AS doc_ord, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(text) % 2 = 1 THEN substring(text, 1, 5) END AS first FROM documents"


def sample_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: its limit is the feature."""
    return sample(documents(spark, sf_dir), 20).select("doc_ord", "doc_id")


SAMPLE_DOCUMENTS = "SELECT doc_id AS doc_ord, CAST(doc_id AS VARCHAR) AS doc_id FROM documents ORDER BY md5('42:' || CAST(documents.doc_id AS VARCHAR)), CAST(documents.doc_id AS VARCHAR) LIMIT 20"


def schema_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery in one pass, enrichment, an instruction and explicit edits: the fields that are left, with what is known of them."""
    docs = documents(spark, sf_dir)

    def model(prompt: str) -> str:
        if prompt.startswith("Enrich"):
            return json.dumps({"fields": {"first": {"description": "how it begins", "examples": ["A"]}, "ghost": {"description": "no such field"}}})
        return _discoverer(prompt)

    client = RuleClient(model)
    found = SchemaOptimizer(client, num_iterations=2).optimize(SinglePassDiscovery(client).discover(docs), docs)
    feedback = SchemaFeedback(add_fields={"extra": {"type": "number"}}, remove_fields=["odd"], modify_fields={"words": {"type": "number"}}, instruction="count words")
    out = refine_schema(found, feedback, client)
    rows = [(f, p["type"], out.field_metadata.get(f, {}).get("description"), " > ".join(out.lineage), registry.auto_name(out)) for f, p in out.json_schema["properties"].items()]
    return spark.createDataFrame(rows, "field string, type string, description string, lineage string, auto_name string")


SCHEMA_REFINEMENT = """
SELECT field, type, CASE WHEN field = 'first' THEN 'how it begins' END AS description, 'SinglePassDiscovery > SchemaOptimizer:iter1 > SchemaOptimizer:iter2 > refine:instruction > refine:explicit' AS lineage,
       'singlepassdiscovery' AS auto_name FROM (VALUES ('first', 'string'), ('words', 'number'), ('extra', 'number')) AS v(field, type)
"""


def model_field_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's choice among string fields, by their first values; a field that isn't there is left out."""
    def choose(prompt: str) -> str:
        lines = [line.split(": ", 1) for line in prompt.split("\n")[1:]]
        return json.dumps([f for f, shown in lines if len(shown.split(", ")) <= 5] + ["ghost"])

    records = table(spark, sf_dir, "documents").select("lang", "source", "n_chars")
    schema = object_of(lang="string", source="string", n_chars="integer")
    fields = LLMFieldSelector(RuleClient(choose)).select(records, schema)
    return spark.createDataFrame([(f,) for f in fields], "field string")


MODEL_FIELD_CHOICE = "SELECT 'lang' AS field FROM documents HAVING count(DISTINCT lang) BETWEEN 1 AND 5 UNION ALL SELECT 'source' FROM documents HAVING count(DISTINCT source) BETWEEN 1 AND 5"


def table_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' schemas as JSON Schema, and read back as Spark types."""
    rows = []
    for name in ("nation", "customer", "part", "orders", "embeddings", "documents", "labels"):
        made = jsonschema.from_struct(table(spark, sf_dir, name).schema)
        again = jsonschema.to_struct(made)
        rows += [(name, f, p["type"], again[f].dataType.simpleString(), jsonschema.leaf_fields(made)) for f, p in made["properties"].items()]
    return spark.createDataFrame(rows, "table_name string, field string, json_type string, spark_type string, leaves int")


TABLE_SCHEMAS = """
WITH c AS (SELECT DISTINCT table_name, column_name, data_type FROM information_schema.columns WHERE table_name IN ('nation', 'customer', 'part', 'orders', 'embeddings', 'documents', 'labels')),
j AS (SELECT *, CASE WHEN data_type LIKE '%[]' THEN 'array' WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'number' ELSE 'string' END AS t FROM c)
SELECT table_name, column_name AS field, t AS json_type, CASE t WHEN 'array' THEN 'array<double>' WHEN 'integer' THEN 'bigint' WHEN 'number' THEN 'double' ELSE 'string' END AS spark_type,
       CAST(count(*) OVER (PARTITION BY table_name) AS INTEGER) AS leaves FROM j
"""


def provider_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = ("openai/gpt-4o", "ollama/llama3", "mistral/small", "gpt-4o", "other/model")
    return spark.createDataFrame([(m, *resolve_provider(m)) for m in models], "asked string, model string, base_url string, key_name string")


PROVIDER_ROUTES = """
SELECT * FROM (VALUES ('openai/gpt-4o', 'gpt-4o', 'https://api.openai.com/v1', 'OPENAI_API_KEY'), ('ollama/llama3', 'llama3', 'http://localhost:11434/v1', ''),
  ('mistral/small', 'small', 'https://api.mistral.ai/v1', 'MISTRAL_API_KEY'), ('gpt-4o', 'gpt-4o', 'https://api.openai.com/v1', 'OPENAI_API_KEY'),
  ('other/model', 'other/model', 'https://api.openai.com/v1', 'OPENAI_API_KEY')) AS v(asked, model, base_url, key_name)
"""


def pipeline_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of all stages of a run, from discovery to normalization."""
    def model(prompt: str) -> str:
        if prompt.startswith("Extract"):
            return json.dumps({"opening": _said(prompt)[:1]})
        if prompt.startswith("Which fields"):
            return '["opening"]'
        if prompt.startswith("Group"):
            return '{"groups": []}'
        return json.dumps(object_of(opening="string"))

    client = RuleClient(model)
    flow = Pipeline(SinglePassDiscovery(client), LLMDirectExtraction(client), LLMCanonicalization(client, max_values_per_prompt=1000), LLMFieldSelector(client), pricing={"rules": (1.0, 1.0)})
    return flow.run(spark, documents(spark, sf_dir)).report().select("stage", "calls", "is_total", (F.col("latency_ms") > 0).alias("timed"))


PIPELINE_USAGE = f"""
WITH {CHUNKS}, u AS (SELECT 'extraction' AS stage, count(*) AS calls FROM c UNION ALL SELECT 'discovery', 1 UNION ALL SELECT 'selection', 1 UNION ALL SELECT 'normalization', 1)
SELECT stage, CAST(sum(calls) AS BIGINT) AS calls, grouping(stage) = 1 AS is_total, true AS timed FROM u GROUP BY ROLLUP (stage)
"""

QUERIES = {f.__name__: f for f in (
    embedding_memo, ontology_mapping, cascade_default, agglomerative, chunk_semantic, extract_awkward, extract_provenance, extract_evidence, extract_failures, extraction_errors,
    extraction_prompts, extraction_cost_estimate, augmented_values, rerank_choice, three_stage_discovery, probe_documents, sample_documents, schema_refinement, model_field_choice,
    table_schemas, provider_routes, pipeline_usage,
)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}

"""Queries over texts: chunks, tokens, costs, quotes, replies and records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.functions.jsonschema import object_of
from fieldloom.operators import chunking, extraction, provenance, records, usage
from fieldloom.plans.tables import documents, table
from fieldloom.providers import RuleClient
from fieldloom.streaming.incremental import stream_value_counts

BLANK = text.BLANK


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_fixed(documents(spark, sf_dir)).select("doc_ord", "chunk_id", "chunk_index", "char_start", "char_end", F.md5("content").alias("digest"))


CHUNKS = """
t AS (SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, body, n, unnest(CASE WHEN n > 4000 THEN range(0, n, 3800) ELSE [0] END) AS a FROM t),
c AS (
  SELECT doc_id AS doc_ord, CAST(doc_id AS VARCHAR) || CASE WHEN n > 4000 THEN '__chunk_' || CAST(a // 3800 AS VARCHAR) ELSE '' END AS chunk_id,
         CAST(CASE WHEN n > 4000 THEN a // 3800 END AS INTEGER) AS chunk_index, CAST(CASE WHEN n > 4000 THEN a END AS INTEGER) AS char_start,
         CAST(CASE WHEN n > 4000 THEN least(a + 4000, n) END AS INTEGER) AS char_end, CASE WHEN n > 4000 THEN substring(body, a + 1, 4000) ELSE body END AS content
  FROM s
)"""
CHUNK_FIXED = f"WITH {CHUNKS} SELECT doc_ord, chunk_id, chunk_index, char_start, char_end, md5(content) AS digest FROM c"


def chunk_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_ord", chunking.estimate_chunks(F.col("content")).alias("n_chunks"))


CHUNK_ESTIMATE = """
SELECT doc_id AS doc_ord, CAST(CASE WHEN coalesce(length(text), 0) <= 4000 THEN 1 ELSE (length(text) - 1) // 3800 + 1 END AS BIGINT) AS n_chunks FROM documents
"""


def _digests(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_ord", "chunk_id", "chunk_index", "char_start", "char_end", F.md5("content").alias("digest"))


def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(chunking.chunk_tokens(documents(spark, sf_dir)))


CHUNK_TOKENS = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract(coalesce(text, ''), '^[ \t\r\n\f]*') AS lead FROM documents),
p AS (SELECT *, regexp_extract_all(body, '(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\r\n\f])[ \t\r\n\f]*') AS l FROM t),
k AS (SELECT *, unnest(range(CAST(greatest(ceil((len(l) - 512) / 448.0), 0) AS BIGINT) + 1)) AS k FROM p),
c AS (
  SELECT doc_id, k, CASE WHEN len(l) = 0 THEN body ELSE CASE WHEN k = 0 THEN lead ELSE '' END || array_to_string(l[k * 448 + 1 : k * 448 + 512], '') END AS content,
         CASE WHEN k = 0 THEN 0 ELSE length(lead) + length(array_to_string(l[1 : k * 448], '')) END AS a FROM k
)
SELECT doc_id AS doc_ord, CAST(doc_id AS VARCHAR) || '__chunk_' || CAST(k AS VARCHAR) AS chunk_id, CAST(k AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS char_start,
       CAST(a + length(content) AS INTEGER) AS char_end, md5(content) AS digest FROM c
"""


def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(chunking.chunk_sentences(documents(spark, sf_dir)))


CHUNK_SENTENCES = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
s AS (SELECT doc_id, body, list_filter(regexp_extract_all(body, '[^.!?\n]*(?:[.!?]+["'')\]]*[ \t\r\n\f\v]*|\n+|$)'), lambda x: length(x) > 0) AS l FROM t),
e AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i, len(l) AS n FROM s),
u AS (
  SELECT doc_id, i, n, coalesce(sum(length(x)) OVER w, 0) AS a, coalesce(sum(length(x)) OVER w, 0) + length(x) AS b,
         coalesce(sum(ceil(length(x) / 4.0)) OVER w, 0) AS p, coalesce(sum(ceil(length(x) / 4.0)) OVER w, 0) + ceil(length(x) / 4.0) AS q
  FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
j AS (SELECT x.doc_id, x.i, max(y.i) + 1 AS j FROM u x JOIN u y ON x.doc_id = y.doc_id AND y.i >= x.i AND (y.i = x.i OR y.q - x.p <= 512) GROUP BY 1, 2),
k AS (SELECT j.doc_id, j.i, j.j, f.a, g.b, g.q, g.n FROM j JOIN u f ON f.doc_id = j.doc_id AND f.i = j.i JOIN u g ON g.doc_id = j.doc_id AND g.i = j.j - 1),
h AS (SELECT k.doc_id, k.i, min(z.i) AS i2 FROM k JOIN u z ON z.doc_id = k.doc_id AND z.i > k.i AND z.i <= k.j AND k.q - z.p <= 64 WHERE k.j < k.n GROUP BY 1, 2),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, 0 AS c FROM s WHERE len(l) > 0
  UNION ALL
  SELECT w.doc_id, h.i2, w.c + 1 FROM walk w JOIN h ON h.doc_id = w.doc_id AND h.i = w.i
),
o AS (
  SELECT walk.doc_id, c, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, body FROM walk JOIN k ON k.doc_id = walk.doc_id AND k.i = walk.i JOIN s ON s.doc_id = walk.doc_id
  UNION ALL SELECT doc_id, 0, 0, 0, body FROM s WHERE len(l) = 0
)
SELECT doc_id AS doc_ord, CAST(doc_id AS VARCHAR) || '__chunk_' || CAST(c AS VARCHAR) AS chunk_id, CAST(c AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS char_start,
       CAST(b AS INTEGER) AS char_end, md5(substring(body, a + 1, b - a)) AS digest FROM o
"""


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(chunking.chunk_recursively(documents(spark, sf_dir)))


def pipeline_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.estimate_pipeline_cost(documents(spark, sf_dir))


PIPELINE_COST_ESTIMATE = """
WITH s AS (
  SELECT count(*) AS n, coalesce(sum(coalesce(length(text), 0) // 4), 0) AS t,
         coalesce(sum(CASE WHEN coalesce(length(text), 0) <= 4000 THEN 1 ELSE (length(text) - 1) // 3800 + 1 END), 0) AS c FROM documents
), p AS (
  SELECT n, c, CAST(t AS DOUBLE) / greatest(n, 1) AS m FROM s
), q AS (
  SELECT n, c, m, m * 6 / 1e6::DOUBLE * 0.15::DOUBLE AS d, c * m * 2 / 1e6::DOUBLE * 0.15::DOUBLE AS e, n * 0.001::DOUBLE AS z FROM p
)
SELECT CAST(n AS BIGINT) AS n_documents, CAST(c AS BIGINT) AS n_chunks, round(m, 4) AS mean_tokens, round(d, 4) AS discovery_usd,
       round(e, 4) AS extraction_usd, round(z, 4) AS normalization_usd, round(d + e + z, 4) AS total_usd FROM q
"""

RECORD = object_of("first", "length", first="string", length="integer")


def prompt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.message_tokens(F.col("text"), F.col("role")).alias("tokens"))


PROMPT_TOKENS = """
SELECT conv_id, turn, CAST(ceil(coalesce(length(text), 0) / 4.0) + ceil(coalesce(length(role), 0) / 4.0) + 4 AS BIGINT) AS tokens FROM conversations
"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a model call of its role's stage."""
    model = F.when(F.col("role") == "user", "gpt-4o").when(F.col("role") == "assistant", "gpt-4o-mini").otherwise("a model without a price")
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("call_ord"), F.col("role").alias("stage"), model.alias("model"), text.tokens(F.col("text")).alias("input_tokens"),
        text.tokens(F.col("role")).alias("output_tokens"), F.col("turn").cast("double").alias("latency_ms"),
    )
    return usage.with_cost(turns)


CALLS = """
k AS (
  SELECT conv_id, turn AS call_ord, role AS stage, CAST(ceil(coalesce(length(text), 0) / 4.0) AS BIGINT) AS input_tokens,
         CAST(ceil(coalesce(length(role), 0) / 4.0) AS BIGINT) AS output_tokens, CAST(turn AS DOUBLE) AS latency_ms,
         CASE role WHEN 'user' THEN 2.5::DOUBLE WHEN 'assistant' THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS pi,
         CASE role WHEN 'user' THEN 10::DOUBLE WHEN 'assistant' THEN 0.6::DOUBLE ELSE 0::DOUBLE END AS po FROM conversations
), calls AS (SELECT * EXCLUDE (pi, po), (input_tokens * pi + output_tokens * po) / 1e6::DOUBLE AS cost_usd FROM k)"""


def llm_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("conv_id", "call_ord", "input_tokens", "output_tokens", F.round("cost_usd", 8).alias("cost_usd"))


LLM_COST = f"WITH {CALLS} SELECT conv_id, call_ord, input_tokens, output_tokens, round(cost_usd, 8) AS cost_usd FROM calls"


def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_report(calls(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 6))


USAGE_REPORT = f"""
WITH {CALLS}
SELECT stage, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       round(sum(cost_usd), 6) AS cost_usd, sum(latency_ms) AS latency_ms, grouping(stage) = 1 AS is_total FROM calls GROUP BY ROLLUP (stage)
"""


def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.within_budget(calls(spark, sf_dir), 0.0005, by="conv_id").select("conv_id", "call_ord", F.round("spent", 8).alias("spent"))


BUDGET_CUTOFF = f"""
WITH {CALLS}, r AS (SELECT conv_id, call_ord, cost_usd, sum(cost_usd) OVER (PARTITION BY conv_id ORDER BY call_ord ROWS UNBOUNDED PRECEDING) AS spent FROM calls)
SELECT conv_id, call_ord, round(spent, 8) AS spent FROM r WHERE spent - cost_usd <= 0.0005::DOUBLE
"""


def fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("  ```json\n"), F.col("text"), F.lit("\n ```\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_fences(fenced)).alias("fenced"), F.md5(text.strip_fences(F.col("text"))).alias("bare"))


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


FENCE_STRIP = f"""
WITH s AS (SELECT doc_id, {_strip_sql("'```json' || chr(10) || text || chr(10) || ' ```'")} AS fenced, {_strip_sql("text")} AS bare FROM documents)
SELECT doc_id, {", ".join(f"md5(CASE WHEN starts_with({c}, '```') THEN array_to_string(list_filter(string_split({c}, chr(10)), lambda x: NOT starts_with({_strip_sql('x')}, '```')), chr(10)) ELSE {c} END) AS {c}" for c in ("fenced", "bare"))} FROM s
"""


def sanitize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.sanitize(F.col("text")).alias("value"))


SANITIZE_VALUES = f"""
WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{text.CONTROL}', ' ', 'g'), '{BLANK}+', ' ', 'g'), ' ') AS v FROM documents)
SELECT doc_id, CASE WHEN length(v) > 200 THEN substring(v, 1, 200) || '...' ELSE v END AS value FROM s
"""


def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.folded(F.col("text"), ascii_only=True)).alias("digest"))


FOLDED_TEXT = f"SELECT doc_id, md5(lower(regexp_replace(text, '{BLANK}+', ' ', 'g'))) AS digest FROM documents"


def folded_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.folded(F.col("text"))).alias("digest"))


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a discovery prompt shows of each document, and what it calls it."""
    return documents(spark, sf_dir).select(
        "doc_ord", F.md5(text.truncate(F.col("content"), 300, "\n... [cut]")).alias("digest"), text.document_label(F.col("source"), F.col("doc_id")).alias("label")
    )


PROMPT_TEXTS = """
SELECT doc_id AS doc_ord, md5(CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || chr(10) || '... [cut]' ELSE text END) AS digest,
       coalesce(nullif(source, ''), nullif(CAST(doc_id AS VARCHAR), ''), 'unknown') AS label FROM documents
"""


def attempt_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.attempt_confidence(F.col("turn")).alias("confidence"))


ATTEMPT_CONFIDENCE = "SELECT conv_id, turn, round(greatest(0.1::DOUBLE, 1.0::DOUBLE - 0.3::DOUBLE * turn), 2) AS confidence FROM conversations"


def span_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return provenance.locate_across(quotes, documents(spark, sf_dir)).select("item_id", "doc_id", "start", "end")


_EDGES = "' ' || chr(9) || chr(10) || chr(13) || '.,;:!?\"''`()[]{}<>—–-'"
SPAN_EXACT = f"""
WITH q AS (SELECT item_id, text, trim(text, {_EDGES}) AS q FROM benchmark),
h AS (SELECT text AS quote, q, min(doc_id) AS doc_id FROM (SELECT DISTINCT text, q FROM q) JOIN (SELECT doc_id, text AS body FROM documents) ON q <> '' AND contains(body, q) GROUP BY 1, 2)
SELECT item_id, CAST(h.doc_id AS VARCHAR) AS doc_id, CAST(strpos(d.text, h.q) - 1 AS INTEGER) AS start, CAST(strpos(d.text, h.q) - 1 + length(h.q) AS INTEGER) AS "end"
FROM q LEFT JOIN h ON q.text = h.quote LEFT JOIN documents d ON d.doc_id = h.doc_id
"""


def span_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that are exact, exact but for blanks, cut away, or empty."""
    spaced = F.regexp_replace(F.substring("content", 11, 60), " ", "  ")
    cases = {"spaced": spaced, "same": F.substring("content", 5, 40), "other": F.concat(F.substring("content", 1, 20), F.lit("~~~x")), "empty": F.lit(" ")}
    every = F.array(*[F.struct(F.lit(k).alias("kind"), q.alias("quote")) for k, q in cases.items()])
    quotes = documents(spark, sf_dir).select("doc_ord", "content", F.inline(every))
    return provenance.locate(quotes).select("doc_ord", "kind", "confidence")


SPAN_STATUS = f"""
WITH q AS (
  SELECT doc_id AS doc_ord, text, unnest(['spaced', 'same', 'other', 'empty']) AS kind,
         unnest([regexp_replace(substring(text, 11, 60), ' ', '  ', 'g'), substring(text, 5, 40), substring(text, 1, 20) || '~~~x', ' ']) AS quote FROM documents
), b AS (SELECT doc_ord, kind, quote, text, trim(coalesce(quote, ''), {_EDGES}) AS bare FROM q)
SELECT doc_ord, kind, CASE WHEN bare = '' THEN 'inferred' WHEN contains(text, bare) THEN 'exact'
       WHEN contains(lower(regexp_replace(text, '{BLANK}+', ' ', 'g')), trim(lower(regexp_replace(bare, '{BLANK}+', ' ', 'g')), ' ')) THEN 'fuzzy' ELSE 'unresolved' END AS confidence FROM b
"""


def json_parse_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as records; an array that is missing becomes empty, a scalar stays null."""
    struct = "k bigint, name string, tags array<string>"
    objects = table(spark, sf_dir, "events").select("event_id", F.explode(records.parse_objects(F.concat(F.lit("```\n"), "props", F.lit("\n```")))).alias("o"))
    kind = spark.createDataFrame([], struct).schema
    parsed = objects.select("event_id", records.without_nulls(records.parse_record(F.col("o"), kind), kind).alias("r"), records.missing_keys(F.col("o"), ["k", "name"]).alias("missing"))
    return parsed.select("event_id", "r.k", "r.name", F.size("r.tags").alias("n_tags"), F.array_join("missing", ",").alias("missing"))


JSON_PARSE_COERCE = """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.name') AS name, CAST(coalesce(json_array_length(props, '$.tags'), 0) AS INTEGER) AS n_tags,
       concat_ws(',', CASE WHEN NOT json_exists(props, '$.k') THEN 'k' END, CASE WHEN NOT json_exists(props, '$.name') THEN 'name' END) AS missing FROM events
"""


def record_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.dedup_records(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["text", "lang"], "doc_id").select("doc_id")


RECORD_DEDUP = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1"


def record_dedup_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal texts, with the spans of all of them."""
    span = F.struct(F.substring("text", 1, 5).alias("quote"), F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("exact").alias("confidence"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(span).alias("spans"))
    out = records.dedup_records(docs, ["text"], "doc_id", "spans")
    return out.select("doc_id", F.size("spans").alias("n_spans"), F.array_join(F.array_sort(F.transform("spans", lambda s: F.lpad(s["document_id"], 12, "0"))), ",").alias("of"))


RECORD_DEDUP_SPANS = """
SELECT min(doc_id) AS doc_id, CAST(count(*) AS INTEGER) AS n_spans, string_agg(lpad(CAST(doc_id AS VARCHAR), 12, '0'), ',' ORDER BY doc_id) AS "of" FROM documents GROUP BY text
"""


def _body(prompt: str) -> str:
    return prompt.split("\n---\n", 1)[1].removesuffix("\n---")


def _first_and_length(prompt: str) -> str:
    body = _body(prompt)
    return json.dumps({"first": body[:12], "length": str(len(body))})


def _lines(prompt: str) -> str:
    return json.dumps([{"line": x} for x in _body(prompt).split("\n")])


def extract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of each chunk by an offline model."""
    got = extraction.LLMDirectExtraction(RuleClient(_first_and_length)).extract(documents(spark, sf_dir), RECORD)
    return got.where("error IS NULL").select("doc_ord", "chunk_id", "record.first", "record.length", "provenance.confidence")


EXTRACT_RULES = f"WITH {CHUNKS} SELECT doc_ord, chunk_id, substring(content, 1, 12) AS first, CAST(length(content) AS BIGINT) AS length, 1.0::DOUBLE AS confidence FROM c"


def extract_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line a record, equal ones once."""
    schema = object_of(line="string")
    got = extraction.LLMDirectExtraction(RuleClient(_lines), multi_record=True).extract(documents(spark, sf_dir), schema)
    return got.where("error IS NULL").select("doc_ord", F.col("record_ord").cast("bigint").alias("line_number"), F.md5("record.line").alias("digest"))


EXTRACT_MULTI = """
WITH l AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT doc_id AS doc_ord, k AS line_number, md5(line) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS n FROM l) WHERE n = 1
"""


def windowed_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed count of the streaming extension, over a bounded table."""
    return stream_value_counts(table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("value"))).select(F.col("start").alias("begins"), "value", "n")


WINDOWED_VALUE_COUNTS = """
SELECT time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') AS begins, event_type AS value, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL
"""

QUERIES = {f.__name__: f for f in (
    chunk_fixed, chunk_estimate, chunk_tokens, chunk_sentences, chunk_recursive, pipeline_cost_estimate, prompt_tokens, llm_cost,
    usage_report, budget_cutoff, fence_strip, sanitize_values, folded_text, folded_nfkc, prompt_texts, attempt_confidence, span_exact, span_status, json_parse_coerce,
    record_dedup, record_dedup_spans, extract_rules, extract_multi, windowed_value_counts,
)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}

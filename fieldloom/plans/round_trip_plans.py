"""Queries that write tables and read them again: sinks, sources, checkpoints, registries and stores."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.jsonschema import object_of
from fieldloom.operators import ontology, registry
from fieldloom.operators.cascade import LearnedDictionaryCache
from fieldloom.operators.checkpoint import Checkpoint, checkpoint_dir, unprocessed
from fieldloom.operators.extraction import LLMDirectExtraction
from fieldloom.pipeline import Pipeline
from fieldloom.plans.model_plans import LetterCounts
from fieldloom.plans.tables import documents, table
from fieldloom.providers import RuleClient
from fieldloom.schemas import Schema
from fieldloom.sources import documents as files
from fieldloom.sources import ontologies, sinks


def _folder(spark: SparkSession) -> str:
    """A new folder in the session's shared one."""
    return f"{checkpoint_dir(spark)}/plan-{uuid.uuid4().hex}"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.array("lang", "source").alias("labels"))


_WRITTEN = "SELECT doc_id, md5(text) AS digest, {labels} AS labels FROM documents"


def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.to_parquet(_texts(spark, sf_dir), path)
    return spark.read.parquet(path).select("doc_id", F.md5("text").alias("digest"), F.array_join("labels", "|").alias("labels"))


SINK_PARQUET = _WRITTEN.format(labels="concat_ws('|', lang, source)")


def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays become JSON; texts with line breaks and quotes come back as they were."""
    path = _folder(spark)
    sinks.to_csv(_texts(spark, sf_dir), path)
    back = sinks.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("digest"), "labels")


SINK_CSV = _WRITTEN.format(labels="""'["' || lang || '","' || source || '"]'""")


def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.to_json(_texts(spark, sf_dir), path)
    back = spark.read.json(path, schema="doc_id bigint, text string, labels array<string>")
    return back.select("doc_id", F.md5("text").alias("digest"), F.array_join("labels", "|").alias("labels"))


SINK_JSON = SINK_PARQUET


def glob_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in text files, read as documents: each line once for each pattern that matches its file."""
    path = _folder(spark)
    table(spark, sf_dir, "part").where("p_name IS NOT NULL").select("p_name").repartition(16, "p_name").write.text(f"{path}/deep/er")
    docs = files.resolve(spark, [f"{path}/deep/er/*.txt", f"{path}/**/*.txt"])
    lines = docs.select(F.explode(F.split(F.rtrim(F.regexp_replace("content", "\n$", "")), "\n")).alias("name"), F.col("source").endswith(F.col("doc_id")).alias("named"))
    return lines.groupBy("name", "named").agg(F.count("*").alias("n"))


GLOB_DOCUMENTS = "SELECT p_name AS name, true AS named, count(*) * 2 AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("synonyms"))


_TERMS = "SELECT 'P:' || CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand || '|' || p_type AS synonyms FROM part"


def _joined(terms: DataFrame) -> DataFrame:
    return terms.select("id", "name", F.array_join("synonyms", "|").alias("synonyms"))


def csv_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/terms.csv"
    _terms(spark, sf_dir).withColumn("synonyms", F.array_join("synonyms", " ; ")).write.csv(path, header=True, escape='"')
    return _joined(ontologies.load_ontology(spark, path))


CSV_ONTOLOGY = _TERMS


def json_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array in each of several files: a line a file, as the terms of a file are one row in a partition of its own."""
    path = f"{_folder(spark)}/terms.json"
    array = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("id", "name", "synonyms"))), ", "), F.lit("]"))
    by_file = _terms(spark, sf_dir).groupBy(F.pmod(F.xxhash64("id"), F.lit(8)).alias("file")).agg(array.alias("value"))
    by_file.write.partitionBy("file").text(path)
    return _joined(ontologies.JSONSource(f"{path}/file=*").load(spark))


JSON_ONTOLOGY = _TERMS


def obo_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms as stanzas; every fifth is obsolete and left out."""
    path = f"{_folder(spark)}/terms.obo"
    t = _terms(spark, sf_dir)
    synonyms = F.array_join(F.transform("synonyms", lambda s: F.concat(F.lit('synonym: "'), s, F.lit('" EXACT []\n'))), "")
    old = F.when(F.substring("id", -1, 1).isin("0", "5"), F.lit("is_obsolete: true\n")).otherwise("")
    stanza = F.concat(F.lit("[Term]\nid: "), "id", F.lit("\nname: "), "name", F.lit("\n"), synonyms, old)
    t.select(F.concat(F.lit("format-version: 1.2\n\n"), stanza).alias("value")).write.text(path)
    return _joined(ontologies.load_ontology(spark, path))


OBO_ONTOLOGY = _TERMS + " WHERE p_partkey % 5 <> 0"

LETTERS = object_of("first", first="string")


def _first_letter(prompt: str) -> str:
    said = prompt.split("\n---\n", 1)[1].removesuffix("\n---")
    return json.dumps({"first": said[:1]}) if len(said) % 10 else "no record"


def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in two halves: documents that gave records aren't read again, those that failed are, and records of both are one table."""
    saved = Checkpoint(spark, _folder(spark))
    saved.save_schema(Schema(LETTERS, {}, []))
    strategy, docs = LLMDirectExtraction(RuleClient(_first_letter), chunk_size=0, max_retries=0), documents(spark, sf_dir)
    saved.append(strategy.extract(docs.where("doc_ord % 2 = 0"), saved.load_schema().json_schema))
    saved.append(strategy.extract(unprocessed(docs, saved.processed()), LETTERS))
    n = saved.load_records().groupBy("doc_ord", "record.first", F.col("error.type").alias("error")).agg(F.count("*").alias("n_rows"))
    done = saved.processed().select(F.col("doc_id").cast("bigint").alias("doc_ord"), F.lit(1).alias("done"))
    return n.join(done, "doc_ord", "left").select("doc_ord", "first", "error", "n_rows", F.coalesce("done", F.lit(0)).alias("done"))


CHECKPOINT_RESUME = """
SELECT doc_id AS doc_ord, CASE WHEN length(coalesce(text, '')) % 10 <> 0 THEN substring(text, 1, 1) END AS first, CASE WHEN length(coalesce(text, '')) % 10 = 0 THEN 'ExtractionError' END AS error,
       CAST(CASE WHEN length(coalesce(text, '')) % 10 = 0 AND doc_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_rows, CASE WHEN length(coalesce(text, '')) % 10 <> 0 THEN 1 ELSE 0 END AS done FROM documents
"""


def pipeline_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one object: the second run finds nothing left to do but the failed documents."""
    flow = Pipeline(extraction=LLMDirectExtraction(RuleClient(_first_letter), chunk_size=0, max_retries=0), checkpoint_path=_folder(spark))
    docs = documents(spark, sf_dir)
    flow.run(spark, docs, schema=LETTERS)
    again = flow.run(spark, docs)
    counts = (again.report().where("is_total").first().calls, again.to_dataframe().count(), again.errors.count())
    return spark.createDataFrame([counts], "calls bigint, records bigint, errors bigint")


PIPELINE_CHECKPOINT = """
WITH b AS (SELECT count(*) FILTER (length(coalesce(text, '')) % 10 = 0) AS bad, count(*) AS n FROM documents)
SELECT CAST(bad AS BIGINT) AS calls, n - bad AS records, 2 * bad AS errors FROM b
"""


def learned_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three mappings of the same parts, saved one after the other: an entry gives way only to a higher confidence."""
    cache = LearnedDictionaryCache(_folder(spark))
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("raw")).agg(F.max("p_size").alias("size"))
    for k, add in enumerate((0, 17, 34)):
        sure = 0.7 + F.pmod(F.col("size") + add, F.lit(30)) / 100
        cache.save(p.select(F.lit("name").alias("field"), "raw", F.concat(F.upper("raw"), F.lit(f" {k}")).alias("canonical"), sure.alias("confidence")), f"run {k}")
    known = cache.load_dictionary(spark, "name").normalize(p.select(F.col("raw").alias("value"))).select("raw", F.col("canonical").alias("used"))
    kept = cache.load_all(spark).select("raw", "canonical", F.round("confidence", 6).alias("confidence"), "source")
    return known.join(kept, "raw", "left")


LEARNED_CACHE = """
WITH p AS (SELECT p_name AS raw, max(p_size) AS size FROM part WHERE p_name IS NOT NULL GROUP BY 1),
r AS (SELECT raw, k, 0.7::DOUBLE + ((size + a) % 30) / 100::DOUBLE AS c FROM p, (VALUES (0, 0), (1, 17), (2, 34)) AS v(k, a)),
b AS (SELECT raw, arg_min(k, (-c, k)) AS k, max(c) AS c FROM r WHERE c >= 0.8::DOUBLE GROUP BY 1)
SELECT p.raw, coalesce(upper(p.raw) || ' ' || CAST(k AS VARCHAR), p.raw) AS used, upper(p.raw) || ' ' || CAST(k AS VARCHAR) AS canonical, round(c, 6) AS confidence, 'run ' || CAST(k AS VARCHAR) AS source
FROM p LEFT JOIN b ON p.raw = b.raw
"""


def index_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index whose vectors are stored for half of the terms, then for all; each vector's length and sum."""
    path = _folder(spark)
    t = _terms(spark, sf_dir)
    ontology.build_stored_index(t.where("id LIKE '%1'"), LetterCounts(), path)
    index = ontology.build_stored_index(t, LetterCounts(), path)
    return index.select("id", "text_ord", F.size("embedding").alias("dim"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("letters"))


INDEX_STORE = """
WITH t AS (SELECT 'P:' || CAST(p_partkey AS VARCHAR) AS id, p_brand || ', ' || p_type AS syn, unnest([p_name, p_brand, p_type]) AS text, unnest([0, 1, 2]) AS text_ord FROM part),
n AS (SELECT lower(text) AS low, count(DISTINCT id) AS n FROM t GROUP BY 1),
s AS (SELECT id, text_ord, CASE WHEN n > 1 THEN text || ' (also known as: ' || syn || '; [' || id || '])' ELSE text END AS shown FROM t JOIN n ON low = lower(text))
SELECT id, CAST(text_ord AS INTEGER) AS text_ord, CAST(26 AS INTEGER) AS dim, CAST(length(regexp_replace(lower(shown), '[^a-z]', '', 'g')) AS DOUBLE) AS letters FROM s
"""


def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema for each region, registered twice with a field more; what is listed, and what the latest and the first have."""
    reg = registry.SchemaRegistry(spark, _folder(spark))
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():  # five rows
        for extra in (0, 1):
            fields = {f"f{k}": "string" for k in range(r.r_regionkey + 1 + extra)}
            reg.register(Schema(object_of(**fields), {}, [f"{r.r_name}:stage1"]), "" if r.r_regionkey % 2 else r.r_name, float(extra))
    listed = reg.list_schemas().select("name", "version", "timestamp", "n_fields", F.element_at("lineage", 1).alias("origin"))
    names = [x.name for x in listed.select("name").distinct().collect()]
    found = [(n, len(reg.get(n).json_schema["properties"]), len(reg.get(n, 1).json_schema["properties"]), ",".join(reg.diff(reg.get(n, 1), reg.get(n))["added"])) for n in names]
    return listed.join(spark.createDataFrame(found, "name string, latest_fields int, first_fields int, added string"), "name")


REGISTRY_LISTING = """
WITH r AS (SELECT r_regionkey AS k, r_name, CASE WHEN r_regionkey % 2 = 1 THEN lower(r_name) ELSE r_name END AS name FROM region)
SELECT name, CAST(e + 1 AS INTEGER) AS version, CAST(e AS DOUBLE) AS timestamp, CAST(k + 1 + e AS INTEGER) AS n_fields, r_name || ':stage1' AS origin,
       CAST(k + 2 AS INTEGER) AS latest_fields, CAST(k + 1 AS INTEGER) AS first_fields, 'f' || CAST(k + 1 AS VARCHAR) AS added FROM r, (VALUES (0), (1)) AS v(e)
"""


def sample_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in sample documents."""
    out = None
    for name in files.SAMPLES:
        one = files.load_samples(spark, name).select("source", "doc_ord", "doc_id", "content")
        out = one if out is None else out.unionByName(one)
    return out


SAMPLE_SETS = "SELECT * FROM (VALUES " + ", ".join(
    f"('samples:{n}', CAST({k} AS BIGINT), '{n}_{k}', '{t.replace(chr(10), '|')}')" for n, ts in files.SAMPLES.items() for k, t in enumerate(ts)
) + ") AS v(source, doc_ord, doc_id, c)"
SAMPLE_SETS = f"SELECT source, doc_ord, doc_id, replace(c, '|', chr(10)) AS content FROM ({SAMPLE_SETS})"

QUERIES = {f.__name__: f for f in (
    sink_parquet, sink_csv, sink_json, glob_documents, csv_ontology, json_ontology, obo_ontology, checkpoint_resume, pipeline_checkpoint, learned_cache, index_store,
    registry_listing, sample_sets,
)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}

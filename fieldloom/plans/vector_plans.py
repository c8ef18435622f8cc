"""Queries over vectors: search, clusters, ontologies; and the whole flow."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.jsonschema import object_of
from fieldloom.operators import clustering, mapping, ontology, profile
from fieldloom.operators.chunking import chunk_fixed
from fieldloom.operators.extraction import LLMDirectExtraction
from fieldloom.pipeline import Pipeline
from fieldloom.plans.tables import documents, table
from fieldloom.plans.text_plans import CHUNKS
from fieldloom.providers import HashEmbeddings, RuleClient


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, and all vectors under the label as its texts."""
    v = _vectors(spark, sf_dir)
    return v.select(F.col("label").cast("string").alias("id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"), F.col("vec_id").cast("int").alias("text_ord"), "embedding")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector the nearest three labels among its nine nearest vectors: as matrix products."""
    queries = _vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("value"), "embedding")
    return ontology.search_matrix(queries, _index(spark, sf_dir), 3).select("value", "id", "name", F.round("score", 6).alias("score"), "rank")


_SCORES = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS value, t.label, t.vec_id, list_cosine_similarity(q.v, t.v) AS score FROM e q CROSS JOIN e t),
w AS (SELECT value, label, score FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, CAST(label AS VARCHAR), vec_id) AS n FROM s) WHERE n <= 9),
r AS (SELECT value, label, max(score) AS score FROM w GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, CAST(label AS VARCHAR)) AS rank FROM r)"""
COSINE_TOPK = f"""
WITH {_SCORES} SELECT CAST(value AS VARCHAR) AS value, CAST(label AS VARCHAR) AS id, 'label ' || CAST(label AS VARCHAR) AS name, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 3
"""


def cosine_topk_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by built-in expressions against the mean vector of each label."""
    queries = _vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("value"), "embedding")
    index = _centroids(spark, sf_dir).select(F.col("k").cast("string").alias("id"), F.lit("mean").alias("name"), F.lit(0).alias("text_ord"), F.col("c").alias("embedding"))
    return ontology.search(queries, index, 2).select("value", "id", F.round("score", 6).alias("score"), "rank")


_MEANS = """
p AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM p WHERE label IS NOT NULL GROUP BY 1, 2),
c AS (SELECT label AS k, list(x ORDER BY i) AS c FROM m GROUP BY 1)"""
COSINE_TOPK_EXPRESSIONS = f"""
WITH {_MEANS}, s AS (SELECT vec_id, k, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS score FROM embeddings CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, CAST(k AS VARCHAR)) AS rank FROM s)
SELECT CAST(vec_id AS VARCHAR) AS value, CAST(k AS VARCHAR) AS id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2
"""


def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that suppliers offer, by price and by quantity: the best three of both lists."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("value"), F.col("l_partkey").cast("string").alias("id"), F.lit("part").alias("name"), "l_extendedprice", "l_quantity")
    return ontology.merge_candidates(items.withColumn("score", F.col("l_extendedprice") / 1e5), items.withColumn("score", F.col("l_quantity") / 50), 3).select("value", "id", "score", "rank")


CANDIDATE_MERGE = """
WITH b AS (SELECT l_suppkey AS value, l_partkey AS id, max(greatest(l_extendedprice / 1e5::DOUBLE, l_quantity / 50)) AS score FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, CAST(id AS VARCHAR)) AS rank FROM b)
SELECT CAST(value AS VARCHAR) AS value, CAST(id AS VARCHAR) AS id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
"""


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each label, as the update step of k-means."""
    v = _vectors(spark, sf_dir).where("label IS NOT NULL").select(F.col("label").alias("k"), F.col("embedding").alias("v"))
    start = v.groupBy("k").agg(F.first("v").alias("c"))
    return clustering.update(v, start)


def kmeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centroids(spark, sf_dir).select("k", F.posexplode("c").alias("i", "x")).select("k", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


KMEANS_UPDATE = f"WITH {_MEANS} SELECT label AS k, i, round(x, 6) AS x FROM m"


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return clustering.assign(points, _centroids(spark, sf_dir)).select("id", "k", F.round("distance", 6).alias("distance"))


KMEANS_ASSIGN = f"""
WITH {_MEANS}, d AS (SELECT p.vec_id AS id, m.label AS k, sum((p.x - m.x) * (p.x - m.x)) AS d FROM p JOIN m ON p.i = m.i GROUP BY 1, 2)
SELECT id, arg_min(k, (d, k)) AS k, round(min(d), 6) AS distance FROM d GROUP BY 1
"""


def silhouette_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("k"), F.col("embedding").alias("v"))
    return clustering.silhouette(points).select("id", F.round("silhouette", 6).alias("silhouette"))


SILHOUETTE_PAIRS = """
WITH e AS (SELECT vec_id AS id, label AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id, a.k, b.k AS k2, avg(list_distance(a.v, b.v)) AS m FROM e a JOIN e b ON a.id <> b.id GROUP BY 1, 2, 3),
s AS (SELECT id, max(m) FILTER (k = k2) AS a, min(m) FILTER (k <> k2) AS b FROM d GROUP BY 1)
SELECT id, round(coalesce(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END END, 0), 6) AS silhouette FROM s
"""


def mode_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of each size, size 1 being noise."""
    label = F.when(F.col("p_size") == 1, F.lit(-1)).otherwise(F.col("p_size")).alias("label")
    members = table(spark, sf_dir, "part").groupBy(label, F.col("p_brand").alias("value")).agg(F.count("*").alias("freq"), F.min("p_partkey").alias("first_ord"))
    return clustering.mode_canonical(members)


MODE_CANONICAL = """
WITH m AS (SELECT CASE WHEN p_size = 1 THEN -1 ELSE p_size END AS label, p_brand AS value, count(*) AS n, min(p_partkey) AS o FROM part GROUP BY 1, 2)
SELECT label, value, CASE WHEN label >= 0 THEN first_value(value) OVER (PARTITION BY label ORDER BY n DESC, o) ELSE value END AS canonical FROM m
"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as ontology entries: the name, with brand and type as synonyms."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("synonyms"))


def index_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.index_texts(_terms(spark, sf_dir)).select("id", "text_ord", "text", "shown")


INDEX_TEXTS = """
WITH t AS (SELECT 'P:' || CAST(p_partkey AS VARCHAR) AS id, p_brand || ', ' || p_type AS syn, unnest([p_name, p_brand, p_type]) AS text, unnest([0, 1, 2]) AS text_ord FROM part),
n AS (SELECT lower(text) AS low, count(DISTINCT id) AS n FROM t GROUP BY 1)
SELECT id, CAST(text_ord AS INTEGER) AS text_ord, text, CASE WHEN n > 1 THEN text || ' (also known as: ' || syn || '; [' || id || '])' ELSE text END AS shown FROM t JOIN n ON low = lower(text)
"""


def homonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = ontology.index_texts(_terms(spark, sf_dir))
    return shown.where("shown <> text").groupBy(F.lower("text").alias("text")).agg(F.count_distinct("id").alias("n_entries"))


HOMONYMS = "WITH t AS (SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS text FROM part) SELECT lower(text) AS text, count(DISTINCT p_partkey) AS n_entries FROM t GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, a third of them misspelled."""
    p = table(spark, sf_dir, "part").where("p_name IS NOT NULL")
    odd = F.when(F.col("p_size") % 3 == 0, F.regexp_replace("p_name", "e", "ee")).otherwise(F.col("p_name"))
    return p.select(odd.alias("value"), F.col("p_partkey").alias("ord"))


def hdbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.EmbeddingClustering(HashEmbeddings(), algorithm="hdbscan").normalize(_names(spark, sf_dir), "p_name").select("raw", "canonical", "cluster_id")


def kllmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.KLLMeansClustering(HashEmbeddings(), num_clusters=8).normalize(_names(spark, sf_dir), "p_name").select("raw", "canonical", "cluster_id")


LANGUAGES = {"en": "English", "DE": "German", "fr": "French"}


def _head_word(prompt: str) -> str:
    body = prompt.split("\n---\n", 1)[1].removesuffix("\n---")
    return json.dumps({"opening": body.split(" ", 1)[0], "words": body.count(" ")})


HEAD = object_of(opening="string", words="integer")


def pipeline_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given schema, extraction, and normalization of a field, as one run."""
    flow = Pipeline(extraction=LLMDirectExtraction(RuleClient(_head_word)), normalization={"opening": mapping.DictionaryNormalization({"La": "THE", "The": "THE", "Das": "THE"})})
    return flow.run(spark, documents(spark, sf_dir), schema=HEAD, normalize_fields=["opening"]).normalized_records().select("doc_ord", "chunk_id", "opening", "words")


PIPELINE_FLOW = f"""
WITH {CHUNKS}, o AS (SELECT doc_ord, chunk_id, string_split(content, ' ')[1] AS w, length(content) - length(replace(content, ' ', '')) AS words FROM c)
SELECT doc_ord, chunk_id, CASE WHEN w IN ('La', 'The', 'Das') THEN 'THE' ELSE w END AS opening, CAST(words AS BIGINT) AS words FROM o
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks, chunks to records by rules, fields to normalize by their statistics, values by a dictionary, records to counts."""
    docs = documents(spark, sf_dir)
    kept = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_ord"), "lang", F.col("source").alias("origin"))
    chunks = chunk_fixed(docs).select("doc_ord", F.length("content").alias("size"), F.regexp_extract("content", "([A-Z][a-z]+)", 1).alias("capitalized"))
    records = chunks.join(kept, "doc_ord")
    fields = profile.StatisticalFieldSelector().select(records)
    if "lang" in fields:
        made = mapping.DictionaryNormalization(LANGUAGES, case_insensitive=True).normalize(mapping.values_of(records, "lang").drop("field"), "lang")
        records = mapping.apply_mapping(records, made, "lang")
    return records.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_ord").alias("n_documents"), F.sum("size").alias("n_chars"), F.count_distinct("capitalized").alias("n_names"))


FLAGSHIP = f"""
WITH {CHUNKS}, m AS (SELECT * FROM (VALUES ('en', 'English'), ('de', 'German'), ('fr', 'French')) AS v(k, v))
SELECT coalesce(m.v, d.lang) AS lang, count(*) AS n_chunks, count(DISTINCT c.doc_ord) AS n_documents, CAST(sum(length(content)) AS BIGINT) AS n_chars,
       count(DISTINCT regexp_extract(content, '([A-Z][a-z]+)', 1)) AS n_names
FROM c JOIN documents d ON d.doc_id = c.doc_ord LEFT JOIN m ON m.k = lower(d.lang) GROUP BY 1
"""

QUERIES = {f.__name__: f for f in (
    flagship, cosine_topk, cosine_topk_expressions, candidate_merge, kmeans_update, kmeans_assign, silhouette_pairs, mode_canonical, index_texts, homonyms, 
    hdbscan, kllmeans, pipeline_flow,
)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}

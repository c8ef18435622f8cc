"""Queries over values: profiles, dictionaries, cascades, learned mappings, groups, versions."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import canonical, cascade, mapping, profile, registry
from fieldloom.operators.checkpoint import unprocessed
from fieldloom.plans.tables import documents, table
from fieldloom.providers import RuleClient

BRANDS = {f"Brand#{i}": f"House {i % 7}" for i in range(1, 20)}
KINDS = {"economy": "Budget", "ECONOMY": "Low cost", "small": "Compact", "Promo": "Offer", "LARGE": "LARGE"}
WORDS = {"red": "crimson", "small": "little", "bolt": "screw", "hot": "warm"}


def _values(rows: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(rows.items())) + ") AS m(o, k, v)"


def _part_values(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return mapping.values_of(table(spark, sf_dir, "part"), column).drop("field")


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.DictionaryNormalization(BRANDS).normalize(_part_values(spark, sf_dir, "p_brand"), "p_brand")


BRAND_SQL = f"""
m AS (SELECT * FROM {_values(BRANDS)}),
b AS (SELECT p_brand AS raw, coalesce(v, p_brand) AS canonical, CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence
      FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL) LEFT JOIN m ON k = p_brand)"""


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of a text, a number and an array column, with how often each occurs."""
    part = table(spark, sf_dir, "part").withColumn("words", F.split("p_name", " "))
    every = [mapping.values_of(part, c).transform(lambda v, c=c: mapping.frequencies(v).withColumn("field", F.lit(c))) for c in ("p_brand", "p_size", "words")]
    return every[0].unionByName(every[1]).unionByName(every[2]).select("field", "value", "freq")


FIELD_VALUES = """
SELECT 'p_brand' AS field, p_brand AS value, count(*) AS freq FROM part WHERE p_brand IS NOT NULL GROUP BY 2
UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part WHERE p_size IS NOT NULL GROUP BY 2
UNION ALL SELECT 'words', w, count(*) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 2
"""


def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_in_order(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("ord")))


DISTINCT_IN_ORDER = "SELECT o_orderpriority AS value, min(o_orderkey) AS ord FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1"


def dict_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brands(spark, sf_dir).select("raw", "canonical", "confidence")


DICT_EXACT = f"WITH {BRAND_SQL} SELECT raw, canonical, confidence FROM b"


def dict_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.DictionaryNormalization(KINDS, case_insensitive=True).normalize(_part_values(spark, sf_dir, "p_type")).select("raw", "canonical", "confidence")


DICT_CI = f"""
WITH m AS (SELECT lower(k) AS k, arg_max(v, o) AS v FROM {_values(KINDS)} GROUP BY 1)
SELECT p_type AS raw, coalesce(v, p_type) AS canonical, CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence
FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL) LEFT JOIN m ON k = lower(p_type)
"""


def dict_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.clusters(_brands(spark, sf_dir)).select("canonical", F.array_join("members", ",").alias("members"))


DICT_CLUSTERS = f"WITH {BRAND_SQL} SELECT canonical, string_agg(raw, ',' ORDER BY raw) AS members FROM b GROUP BY 1"


def apply_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.apply_mapping(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), _brands(spark, sf_dir), "p_brand")


APPLY_SCALAR = f"WITH m AS (SELECT * FROM {_values(BRANDS)}) SELECT p_partkey, coalesce(v, p_brand) AS p_brand FROM part LEFT JOIN m ON k = p_brand"


def apply_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_partkey", F.array_append(F.split("p_name", " "), F.lit(None).cast("string")).alias("words"))
    made = mapping.DictionaryNormalization(WORDS).normalize(mapping.values_of(words, "words").drop("field"))
    return mapping.apply_mapping(words, made, "words").select("p_partkey", F.array_join("words", " ").alias("words"))


APPLY_ARRAY = f"""
WITH w AS (SELECT p_partkey, unnest(list_append(string_split(p_name, ' '), 'None')) AS w, unnest(range(len(string_split(p_name, ' ')) + 1)) AS i FROM part),
m AS (SELECT * FROM {_values(WORDS)})
SELECT p_partkey, string_agg(coalesce(v, w), ' ' ORDER BY i) AS words FROM w LEFT JOIN m ON k = w GROUP BY 1
"""


def explain_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.explain(_brands(spark, sf_dir))


EXPLAIN_MAPPING = f"""
WITH {BRAND_SQL}, n AS (SELECT canonical, count(*) AS n FROM b GROUP BY 1)
SELECT raw, raw || ' → ' || canonical || CASE WHEN n > 1 THEN ' (' || CAST(n AS VARCHAR) || ' spellings)' ELSE '' END AS explanation FROM b JOIN n USING (canonical)
"""


def to_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.to_dictionary(_brands(spark, sf_dir), 0.5)


TO_DICTIONARY = f"WITH {BRAND_SQL} SELECT raw, canonical FROM b WHERE raw <> canonical AND coalesce(confidence, 1) >= 0.5"


def composite_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    values = mapping.values_of(part, "p_brand").unionByName(mapping.values_of(part, "p_type"))
    routes = mapping.CompositeNormalization({"p_brand": mapping.DictionaryNormalization(BRANDS)}, mapping.DictionaryNormalization(KINDS, case_insensitive=True))
    return routes.normalize_all(values, ["p_brand", "p_type"]).select("field", "raw", "canonical")


COMPOSITE_ROUTE = f"WITH x AS ({DICT_EXACT}), y AS ({DICT_CI}) SELECT 'p_brand' AS field, raw, canonical FROM x UNION ALL SELECT 'p_type', raw, canonical FROM y"


@dataclass
class Fixed:
    """A dictionary whose hits have one confidence, or none."""

    rows: dict[str, str]
    confidence: float | None

    def normalize(self, values: DataFrame, context_field: str = "") -> DataFrame:
        made = mapping.DictionaryNormalization(self.rows).normalize(values, context_field)
        return made.withColumn("confidence", F.when(F.col("confidence") > 0, F.lit(self.confidence).cast("double")).otherwise(F.col("confidence")))


STEPS = ({f"Brand#{i}": f"A{i}" for i in range(1, 9)} | {"Brand#10": "Brand#10"}, {f"Brand#{i}": f"B{i}" for i in range(5, 15)}, {f"Brand#{i}": f"C{i}" for i in range(3, 20)})


def cascade_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cascade.CascadeNormalization([mapping.DictionaryNormalization(s) for s in STEPS]).normalize(_part_values(spark, sf_dir, "p_brand"), "p_brand")
    return got.select("raw", "canonical", "step")


_STEP_TABLES = ", ".join(f"s{i} AS (SELECT * FROM {_values(s)})" for i, s in enumerate(STEPS))
_STEP_JOINS = "(SELECT DISTINCT p_brand AS raw FROM part WHERE p_brand IS NOT NULL) " + " ".join(f"LEFT JOIN s{i} ON s{i}.k = raw" for i in range(3))
CASCADE_IDENTITY = f"""
WITH {_STEP_TABLES}, j AS (SELECT raw, nullif(s0.v, raw) AS a, nullif(s1.v, raw) AS b, nullif(s2.v, raw) AS c FROM {_STEP_JOINS})
SELECT raw, coalesce(a, b, c, raw) AS canonical, CAST(CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 WHEN c IS NOT NULL THEN 2 END AS INTEGER) AS step FROM j
"""


def _confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [Fixed(STEPS[0], 0.5), Fixed(STEPS[1], None), Fixed(STEPS[2], 0.95)]
    return cascade.CascadeNormalization(steps, [0.8, 0.1, 0.9]).normalize(_part_values(spark, sf_dir, "p_brand"), "p_brand")


def cascade_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step isn't sure enough, the second says nothing of it, so only the third resolves."""
    return _confident(spark, sf_dir).select("raw", "canonical", "step", "step_confidence")


CASCADE_CONFIDENCE = f"""
WITH {_STEP_TABLES} SELECT raw, coalesce(s2.v, raw) AS canonical, CAST(CASE WHEN s2.v IS NOT NULL THEN 2 END AS INTEGER) AS step,
CASE WHEN s2.v IS NOT NULL THEN 0.95::DOUBLE END AS step_confidence FROM {_STEP_JOINS}
"""


def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.step_counts(_confident(spark, sf_dir), 3)


CASCADE_COUNTS = f"""
WITH r AS ({CASCADE_CONFIDENCE}), n AS (SELECT unnest([0, 1, 2]) AS step), p AS (SELECT n.step, count(r.raw) AS mapped FROM n LEFT JOIN r ON r.step = n.step GROUP BY 1)
SELECT CAST(step AS INTEGER) AS step, mapped, CAST((SELECT count(*) FROM r) - sum(mapped) OVER (ORDER BY step) AS BIGINT) AS remaining FROM p
"""


def learned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by their mean size as an old entry, by their rarest type as a new one."""
    part = table(spark, sf_dir, "part").where("p_brand IS NOT NULL")
    brand, conf = F.col("p_brand").alias("raw"), (F.col("p_size") % 10 / 10).alias("confidence")
    old = part.groupBy("p_brand").agg(F.min("p_size").alias("p_size")).select(F.lit("brand").alias("field"), brand, F.lit("old").alias("canonical"), conf, F.lit("a").alias("source"))
    new = part.select(F.lit("brand").alias("field"), brand, F.col("p_type").alias("canonical"), conf, F.lit("b").alias("source"))
    return cascade.upsert_learned(old, new, 0.8).select("raw", "canonical", "confidence", "source")


LEARNED_UPSERT = """
WITH o AS (SELECT p_brand AS raw, 'old' AS canonical, min(p_size) % 10 / 10::DOUBLE AS confidence, 'a' AS source, 1 AS old FROM part WHERE p_brand IS NOT NULL GROUP BY 1),
n AS (SELECT p_brand, p_type, coalesce(p_size % 10 / 10::DOUBLE, 1), 'b', 0 FROM part WHERE p_brand IS NOT NULL AND p_brand <> p_type AND coalesce(p_size % 10 / 10::DOUBLE, 1) >= 0.8),
u AS (SELECT * FROM o UNION ALL SELECT * FROM n)
SELECT raw, canonical, confidence, source FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY confidence DESC NULLS LAST, old DESC, canonical) AS k FROM u) WHERE k = 1
"""


def learn_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cascade that has learned from its second step resolves all of it in the first."""
    values = _part_values(spark, sf_dir, "p_brand")
    first = cascade.CascadeNormalization([mapping.DictionaryNormalization(STEPS[0]), mapping.DictionaryNormalization(STEPS[1])])
    return first.learn(first.normalize(values)).normalize(values).select("raw", "canonical", "step")


LEARN_MERGE = f"""
WITH {_STEP_TABLES}, j AS (SELECT raw, coalesce(nullif(s0.v, raw), nullif(s1.v, raw)) AS v FROM {_STEP_JOINS})
SELECT raw, coalesce(v, raw) AS canonical, CAST(CASE WHEN v IS NOT NULL THEN 0 END AS INTEGER) AS step FROM j
"""


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unprocessed(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


RESUME_ANTI = "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.coverage(_labelled(spark, sf_dir), ["lang", "quality", "toxic", "not there"])


_PER_FIELD = "unnest(['lang', 'quality', 'toxic', 'not there']) AS field, unnest([count(lang), count(quality), count(toxic), 0]) AS filled, count(*) AS total"
_COVERAGE = f"c AS (SELECT {_PER_FIELD} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
FIELD_COVERAGE = f"WITH {_COVERAGE} SELECT field, CAST(filled AS BIGINT) AS filled, CAST(total AS BIGINT) AS total, CAST(filled AS DOUBLE) / total AS coverage FROM c"


def gap_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.gaps(field_coverage(spark, sf_dir))


_PERCENT = "CAST(CAST(round_even(CAST(filled AS DOUBLE) / total * 100, 0) AS INTEGER) AS VARCHAR) || '%'"
GAP_ANALYSIS = f"""
WITH {_COVERAGE} SELECT field, CASE WHEN CAST(filled AS DOUBLE) / total < 0.8::DOUBLE
  THEN 'low coverage (' || CAST(filled AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ' = ' || {_PERCENT} || '): the description may be unclear'
  ELSE 'coverage fine (' || {_PERCENT} || '), sample values available' END AS note FROM c WHERE filled > 0 OR total > 0
"""


def coverage_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.coverage_listing(field_coverage(spark, sf_dir))


COVERAGE_LISTING = f"WITH {_COVERAGE} SELECT field || ': ' || {_PERCENT} || CASE WHEN CAST(filled AS DOUBLE) / total < 0.2::DOUBLE THEN ' (low)' ELSE '' END AS line FROM c"

_PROFILED = {"part": ("p_brand", "p_type"), "customer": ("c_mktsegment",), "orders": ("o_orderstatus", "o_orderpriority"), "documents": ("lang", "source")}


def field_select_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all candidate fields of four tables, and which of them the selector takes."""
    out = None
    for name in _PROFILED:
        rows = table(spark, sf_dir, name)
        stats = profile.field_statistics(rows, profile.candidate_fields(rows))
        chosen = (F.col("n_unique") >= 3) & (F.col("unique_ratio") <= 0.5) & (F.col("mean_length") <= 50)
        one = stats.select(F.lit(name).alias("table_name"), "field", "n_values", "n_unique", F.round("unique_ratio", 8).alias("unique_ratio"), F.round("mean_length", 6).alias("mean_length"), chosen.alias("selected"))
        out = one if out is None else out.unionByName(one)
    return out


FIELD_SELECT_STATS = "WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS field, count({c}) AS n_values, count(DISTINCT {c}) AS n_unique, CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) AS r, avg(length({c})) AS m FROM {t}"
    for t, cs in _PROFILED.items() for c in cs
) + """) SELECT table_name, field, n_values, n_unique, round(r, 8) AS unique_ratio, round(m, 6) AS mean_length, n_unique >= 3 AND r <= 0.5 AND m <= 50 AS selected FROM s WHERE n_values > 0"""


def field_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.samples(table(spark, sf_dir, "documents"), ["lang", "source"], 5).select("field", F.array_join("samples", ",").alias("samples"))


FIELD_SAMPLES = " UNION ALL ".join(
    f"SELECT '{c}' AS field, string_agg(v, ',' ORDER BY v) AS samples FROM (SELECT DISTINCT {c} AS v FROM documents WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 5)" for c in ("lang", "source")
)


def head_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.head(documents(spark, sf_dir), 10).select("doc_ord", "doc_id")


HEAD_DOCUMENTS = "SELECT doc_id AS doc_ord, CAST(doc_id AS VARCHAR) AS doc_id FROM documents ORDER BY documents.doc_id LIMIT 10"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part in a group named by its type, the case depending on its size."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") > 25, F.concat(F.lit(" "), F.lower("p_type"), F.lit("\t"))).otherwise(F.col("p_type"))
    return p.select(F.col("p_partkey").alias("ord"), name.alias("canonical"), F.split("p_name", " ").alias("members"), F.concat(F.lit("r"), F.col("p_size").cast("string")).alias("rationale"))


def group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = canonical.merge_groups(_groups(spark, sf_dir))
    return got.select("ord", "canonical", F.array_join(F.array_sort("members"), ",").alias("members"), F.md5("rationale").alias("reasons"))


_GROUP_SQL = """
g AS (SELECT p_partkey AS ord, CASE WHEN p_size > 25 THEN ' ' || lower(p_type) || chr(9) ELSE p_type END AS canonical, p_name, 'r' || CAST(p_size AS VARCHAR) AS rationale FROM part)"""
GROUP_MERGE = f"""
WITH {_GROUP_SQL}, k AS (SELECT *, lower(regexp_replace(canonical, '^\\s+|\\s+$', '', 'g')) AS key FROM g),
h AS (SELECT key, min(ord) AS ord, arg_min(canonical, ord) AS canonical, md5(string_agg(rationale, '; ' ORDER BY ord)) AS reasons FROM k GROUP BY 1),
m AS (SELECT DISTINCT key, unnest(string_split(p_name, ' ')) AS w FROM k)
SELECT h.ord, h.canonical, string_agg(w, ',' ORDER BY w) AS members, h.reasons FROM h JOIN m USING (key) GROUP BY 1, 2, 4
"""

ORDERS = [(0, "Cheap", ["ECONOMY", "SMALL", "missing"]), (1, "Other", ["SMALL", "PROMO"])]


def hier_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_type IS NOT NULL")
    groups = p.groupBy(F.col("p_type").alias("canonical")).agg(F.min("p_partkey").alias("ord"), F.array_sort(F.collect_set("p_brand")).alias("members")).withColumn("rationale", F.lit(""))
    told = spark.createDataFrame(ORDERS, "ord bigint, canonical string, merge array<string>")
    got = canonical.merge_by_instructions(groups.select("ord", "canonical", "members", "rationale"), told)
    return got.select("ord", "canonical", F.array_join(F.array_sort("members"), ",").alias("members"))


HIER_MERGE = """
WITH g AS (SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'Cheap' WHEN p_type = 'PROMO' THEN 'Other' ELSE p_type END AS canonical, p_partkey, p_brand FROM part WHERE p_type IS NOT NULL)
SELECT min(p_partkey) AS ord, canonical, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS members FROM g GROUP BY 2
"""


def _same_when_folded(prompt: str) -> str:
    groups: dict[str, list[str]] = {}
    for line in prompt.split("\n"):
        if line.startswith("- "):
            groups.setdefault(line[2:].lower(), []).append(line[2:])
    return json.dumps({"groups": [{"canonical": v[0], "members": v} for v in groups.values()]})


def canonicalize_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings that only differ in case, by an offline model: in batches, merged by name."""
    p = table(spark, sf_dir, "part").where("p_name IS NOT NULL")
    spelled = p.select(F.explode(F.array("p_name", F.upper("p_name"), F.initcap("p_name"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)")))).alias("value"))
    got = canonical.LLMCanonicalization(RuleClient(_same_when_folded)).normalize(spelled, "p_name")
    return got.select("raw", "canonical", "confidence")


CANONICALIZE_RULES = """
WITH s AS (SELECT DISTINCT unnest([p_name, upper(p_name), array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' '), upper(p_name[1]) || p_name[2:]]) AS raw FROM part WHERE p_name IS NOT NULL)
SELECT raw, min(raw) OVER w AS canonical, CASE WHEN raw = min(raw) OVER w THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM s WINDOW w AS (PARTITION BY lower(raw))
"""

_FIELDS_A, _FIELDS_B = {"a": "int", "b": "string", "d": "x"}, {"b": "double", "c": "int", "d": "x"}


def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = lambda d: spark.createDataFrame(list(d.items()), "field string, definition string")
    return registry.diff_fields(fields(_FIELDS_A), fields(_FIELDS_B))


SCHEMA_DIFF = """
SELECT coalesce(a.f, b.f) AS field, CASE WHEN a.f IS NULL THEN 'added' WHEN b.f IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (VALUES ('a', 'int'), ('b', 'string'), ('d', 'x')) AS a(f, x) FULL JOIN (VALUES ('b', 'double'), ('c', 'int'), ('d', 'x')) AS b(f, y) ON a.f = b.f WHERE a.f IS NULL OR b.f IS NULL OR x <> y
"""


def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as versions of one schema; the latest of each."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("name"), F.col("s_acctbal").alias("timestamp"), F.col("s_name").alias("json_schema"))
    return registry.latest(s).select("name", "version", "json_schema")


SCHEMA_VERSIONS = """
WITH v AS (SELECT CAST(s_nationkey AS VARCHAR) AS name, s_name AS json_schema, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_name) AS version, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT name, CAST(version AS INTEGER) AS version, json_schema FROM v WHERE version = n
"""


QUERIES = {f.__name__: f for f in (
    field_values, distinct_in_order, dict_exact, dict_ci, dict_clusters, apply_scalar, apply_array, explain_mapping, to_dictionary, composite_route, cascade_identity,
    cascade_confidence, cascade_counts, learned_upsert, learn_merge, resume_anti, field_coverage, gap_analysis, coverage_listing, field_select_stats, field_samples,
    head_documents, group_merge, hier_merge, canonicalize_rules, schema_diff, schema_versions, 
)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}

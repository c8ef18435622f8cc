"""Documents from files, tables and built-in samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.mapping import BROADCAST_ROWS
from fieldloom.operators.numbering import numbered
from fieldloom.schemas import DOCUMENTS

_REVIEWS = (
    ("lamp", 4, "Lumo", "bright"), ("kettle", 2, "Heatwell", "leaks"), ("desk", 5, "lumo", "solid"), ("chair", 3, "Sitwell", "fine"), ("fan", 1, "HEATWELL", "loud"),
    ("stool", 4, "sitwell", "light"), ("heater", 5, "Heatwell", "warm"), ("torch", 2, "LUMO", "dim"), ("bench", 3, "Sitwell", "hard"), ("toaster", 4, "heatwell", "even"),
)
_TICKETS = (
    ("cannot log in", "high", "true"), ("wrong invoice", "low", "false"), ("app crashes", "High", "false"), ("slow search", "medium", "true"), ("no reply", "LOW", "true"),
    ("export is empty", "high", "false"), ("two charges", "High", "true"), ("broken link", "low", "true"), ("missing mail", "Medium", "false"), ("odd totals", "medium", "false"),
)
_CASES = (
    ("A-17", 41, "Seizure", "stable"), ("A-18", 7, "ataxia", "improved"), ("B-02", 63, "SEIZURE", "stable"), ("B-09", 29, "Fever", "resolved"), ("B-11", 3, "fever", "resolved"),
    ("C-01", 52, "Ataxia", "stable"), ("C-04", 19, "rash", "improved"), ("C-05", 34, "Rash", "resolved"), ("D-12", 70, "seizure", "improved"), ("D-13", 11, "FEVER", "resolved"),
)
SAMPLES = {
    "reviews": [f"product: {p}\nrating: {r}\nbrand: {b}\nverdict: {v}" for p, r, b, v in _REVIEWS],
    "tickets": [f"subject: {s}\npriority: {p}\nresolved: {r}" for s, p, r in _TICKETS],
    "cases": [f"case: {c}\nage: {a}\nfinding: {f}\noutcome: {o}" for c, a, f, o in _CASES],
}


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCUMENTS)


def from_table(df: DataFrame, content: str = "text", doc_id: str = "doc_id", source: str | None = "source") -> DataFrame:
    """A table as documents, in the order of its identifier."""
    none = F.lit(None).cast("string")
    return df.select(
        F.col(doc_id).cast("bigint").alias("doc_ord"), F.col(doc_id).cast("string").alias("doc_id"), F.col(content).alias("content"),
        (F.col(source).cast("string") if source else none).alias("source"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


def load_glob(spark: SparkSession, pattern: str, ordinal: int = 0) -> DataFrame:
    """A document for each file that matches, named by its file name; files that aren't UTF-8 are left out.

    ``**`` stands for any depth of folders. ``doc_ord`` is the place in the order of paths: these are
    listed and numbered first, without reading a file, and the numbers travel to the contents.
    """
    root, deep, rest = pattern.partition("**/")
    reader = spark.read.format("binaryFile")
    if deep:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", rest.rsplit("/", 1)[-1] or "*")
    try:
        files = reader.load(root.rstrip("/") or "/" if deep else pattern)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return _empty(spark)
        raise
    valid = files.where(F.is_valid_utf8(F.col("content").cast("string")))
    places = numbered(files.select(F.col("path").alias("p")), "p", out="place")
    few = places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = valid.select("path", F.col("content").cast("string").alias("content"))
    ranked = texts.join(F.broadcast(places) if few else places, F.col("path") == F.col("p"))
    name = F.element_at(F.split("path", "/"), -1)
    where = F.regexp_replace("path", "^file:(//)?", "")
    return ranked.select(
        (F.col("place") + F.lit(ordinal << 48)).alias("doc_ord"), name.alias("doc_id"), "content", where.alias("source"), F.create_map().cast("map<string,string>").alias("metadata")
    )


def load_globs(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Patterns in their order; a file that several match is there several times."""
    parts = [load_glob(spark, p, i) for i, p in enumerate(patterns)]
    return reduce(DataFrame.unionByName, parts) if parts else _empty(spark)


def from_strings(spark: SparkSession, texts: list[str], name: str = "doc") -> DataFrame:
    return spark.createDataFrame([(i, f"{name}_{i}", t, None, {}) for i, t in enumerate(texts)], DOCUMENTS)


def load_samples(spark: SparkSession, name: str = "reviews") -> DataFrame:
    if name not in SAMPLES:
        raise ValueError(f"no samples {name!r}; there are {', '.join(SAMPLES)}")
    return from_strings(spark, SAMPLES[name], name).withColumn("source", F.lit(f"samples:{name}"))


def resolve(spark: SparkSession, documents: DataFrame | list) -> DataFrame:
    """Documents as they are, or a list of globs."""
    if isinstance(documents, DataFrame):
        return documents
    return load_globs(spark, list(documents))

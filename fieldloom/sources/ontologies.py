"""Ontologies: tables ``id, name, synonyms`` from CSV, JSON and OBO files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.errors import NormalizationError


@dataclass(frozen=True)
class CSVSource:
    path: str

    def load(self, spark: SparkSession) -> DataFrame:
        """Needs the columns ``id`` and ``name``; ``synonyms`` are separated by ``;``."""
        df = spark.read.csv(self.path, header=True, multiLine=True, escape='"')
        if not {"id", "name"} <= set(df.columns):
            raise ValueError(f"{self.path}: the columns id and name are needed, there are {', '.join(df.columns)}")
        syn = F.filter(F.transform(F.split(F.col("synonyms"), ";"), lambda x: F.trim(x)), lambda x: x != "") if "synonyms" in df.columns else F.array().cast("array<string>")
        return df.select("id", "name", F.coalesce(syn, F.array().cast("array<string>")).alias("synonyms"))


@dataclass(frozen=True)
class JSONSource:
    path: str

    def load(self, spark: SparkSession) -> DataFrame:
        """One JSON array of objects with ``id`` and ``name``."""
        whole = spark.read.text(self.path, wholetext=True)
        items = F.from_json("value", "array<string>")
        rows = whole.select(F.trim("value").alias("value")).select(F.posexplode_outer(F.when(F.startswith("value", F.lit("[")), items)).alias("i", "e"))
        keys = F.json_object_keys("e")
        bad = F.when(F.col("i").isNull(), F.lit("the file isn't a JSON array with entries")).when(
            keys.isNull() | ~(F.array_contains(keys, "id") & F.array_contains(keys, "name")), F.concat(F.lit("entry "), F.col("i").cast("string"), F.lit(" needs id and name"))
        )
        checked = rows.withColumn("e", F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("e")))
        e = checked.select(F.from_json("e", "id string, name string, synonyms array<string>").alias("e")).select("e.*")
        return e.select("id", "name", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"))


@dataclass(frozen=True)
class OBOSource:
    path: str

    def load(self, spark: SparkSession) -> DataFrame:
        """Terms that aren't obsolete, read stanza by stanza by Spark's own text source."""
        stanzas = spark.read.text(self.path, lineSep="\n[Term]\n").select(F.concat(F.lit("\n"), F.split("value", "\n\\[Typedef\\]\n").getItem(0)).alias("s"))
        line = lambda key: F.trim(F.regexp_extract("s", rf"\n{key}: ([^\n]*)", 1))
        terms = stanzas.where(F.col("s").rlike(r"\nid: ") & ~F.col("s").rlike(r"\nis_obsolete: true"))
        return terms.select(
            line("id").alias("id"), line("name").alias("name"), F.regexp_extract_all("s", F.lit(r'\nsynonym: "((?:[^"\\]|\\.)*)"'), F.lit(1)).alias("synonyms")
        )


def resolve_ontology(ontology: str | DataFrame | object) -> DataFrame | CSVSource | JSONSource | OBOSource | object:
    """A table as it is, a source as it is, a path by its ending."""
    if not isinstance(ontology, str):
        return ontology
    for ending, kind in ((".csv", CSVSource), (".json", JSONSource), (".obo", OBOSource)):
        if ontology.lower().endswith(ending):
            return kind(ontology)
    raise NormalizationError(f"no source for {ontology!r}: give a .csv, .json or .obo file")


def load_ontology(spark: SparkSession, ontology: str | DataFrame | object) -> DataFrame:
    source = resolve_ontology(ontology)
    return source if isinstance(source, DataFrame) else source.load(spark)

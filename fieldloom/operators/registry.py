"""Versioned schemas, appended to a table; versions come from the order of registration."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import jsonschema
from fieldloom.schemas import Schema

ROW = "name string, timestamp double, json_schema string, field_metadata string, lineage array<string>"


def versions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``version``, from 1 for each name by time."""
    return rows.withColumn("version", F.row_number().over(Window.partitionBy("name").orderBy("timestamp", "json_schema")))


def latest(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("name").orderBy(F.desc("version"))
    return versions(rows).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def diff_fields(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(field, change)`` of two tables ``field, definition``: added, removed or changed."""
    j = a.select("field", F.col("definition").alias("x")).join(b.select("field", F.col("definition").alias("y")), "field", "full_outer")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return j.select("field", change.alias("change")).where("change IS NOT NULL")


def auto_name(schema: Schema) -> str:
    head = next(iter(schema.lineage), "")
    if head:
        return head.lower().partition(":")[0]
    n = len(schema.json_schema.get("properties", {}))
    return f"schema_{n}fields" if n else "unnamed"


@dataclass
class SchemaRegistry:
    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(self.path)

    def register(self, schema: Schema, name: str = "", timestamp: float | None = None) -> str:
        name = name or auto_name(schema)
        row = (name, time.time() if timestamp is None else timestamp, json.dumps(schema.json_schema), json.dumps(schema.field_metadata), schema.lineage)
        self.spark.createDataFrame([row], ROW).write.mode("append").parquet(self.path)
        return f"{name}:v{versions(self.rows()).where(F.col('name') == name).count()}"

    def get(self, name, version=None) -> Schema | None:
        rows = (latest(self.rows()) if version is None else versions(self.rows()).where(F.col("version") == version)).where(F.col("name") == name)
        r = rows.first()
        return Schema(json.loads(r.json_schema), json.loads(r.field_metadata), list(r.lineage)) if r else None

    def list_schemas(self) -> DataFrame:
        n = F.size(F.json_object_keys(F.get_json_object("json_schema", "$.properties")))
        return versions(self.rows()).select("name", "version", "timestamp", n.alias("n_fields"), "lineage").orderBy("name", "version")

    def diff(self, a: Schema, b: Schema) -> dict[str, list[str]]:
        return jsonschema.diff(a.json_schema, b.json_schema)

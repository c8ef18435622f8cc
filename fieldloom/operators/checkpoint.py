"""Resuming a run: what was done is appended to tables, and left out the next time."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.schemas import Schema


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only where none is set, and only on one machine: it goes with the program."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from here on, so that no lost executor makes a model answer twice."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the folders ``v=N`` that were written to their end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def unprocessed(docs: DataFrame, processed: DataFrame) -> DataFrame:
    """Documents whose identifier isn't among ``processed(doc_id)``; a missing one counts as empty text."""
    done = processed.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__done")).distinct()
    return docs.join(done, F.coalesce(F.col("doc_id").cast("string"), F.lit("")) == F.col("__done"), "left_anti")


@dataclass
class Checkpoint:
    """Folders ``records`` and ``state`` of Parquet, and the schema as a text file.

    Only documents that gave records are marked as done, so failed ones are tried again.
    """

    spark: SparkSession
    path: str

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def save_schema(self, schema: Schema) -> None:
        text = json.dumps(asdict(schema))
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")

    def load_schema(self) -> Schema | None:
        """None if there is none, or if it can't be read."""
        if not self._exists("schema"):
            return None
        try:
            return Schema(**json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/schema").collect())))
        except (ValueError, TypeError):
            return None

    def append(self, result: DataFrame) -> None:
        """Records and errors of an extraction; the state is written last."""
        result.write.mode("append").parquet(f"{self.path}/records")
        good = self.load_records().where("error IS NULL").select("doc_id").distinct()
        unprocessed(good, self.processed()).write.mode("append").parquet(f"{self.path}/state")

    def processed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/state") if self._exists("state") else self.spark.createDataFrame([], "doc_id string")

    def load_records(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/records") if self._exists("records") else None

"""Records to files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def to_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Texts as they are, blanks at their ends too; a null is nothing, an empty text a pair of quotes."""
    out = flat(df)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(path, header=True, escape='"', charToEscapeQuoteEscaping='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What ``to_csv`` wrote, as text columns. A null is known by a name that no text has, so that empty texts stay."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', charToEscapeQuoteEscaping='"', nullValue=uuid.uuid4().hex, emptyValue="")


def to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def to_json(df: DataFrame, path: str) -> None:
    """One object a line."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def to_json_array(df: DataFrame, path: str) -> None:
    """One JSON array in a local file; rows come to the driver a partition at a time, so their number isn't bounded."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for k, r in enumerate(rows.toLocalIterator()):
            f.write(",\n" * (k > 0) + r.j)
        f.write("]\n")

"""Exact dedup by sorting content.

Texts are normalised (runs of blank ASCII characters become one space, ends trimmed). A
compact key, the first bytes of the normalised text and the hash of all of it, is sampled
for splitters and range-partitions the rows; within a partition an external sort by key,
whole normalised text and identifier makes equal texts adjacent, and a window whose groups
are formed by comparing whole neighbouring texts keeps the smallest identifier. Splitters
are sampled from the compact key only, so what reaches the driver doesn't grow with texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = r"[ \t\r\n\f]+"


def normalised(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def _ranked(df: DataFrame) -> DataFrame:
    """``(id, text, rest, first, rank)`` of ``df(id, text, rest)``'s rows with a text: the least identifier, and the place, within equal texts."""
    norm = normalised(F.col("text"))
    keyed = (
        df.where(F.col("text").isNotNull())
        .withColumn("head", F.substring(norm, 1, 24))
        .withColumn("hash", F.xxhash64(norm))
        .repartitionByRange("head", "hash")
        .withColumn("norm", norm)
    )
    group = Window.partitionBy("head", "hash", "norm").orderBy(F.col("id").asc_nulls_last())
    seen = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return keyed.withColumn("first", F.first("id").over(seen)).withColumn("rank", F.row_number().over(group))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, kept_id, is_kept)``, a row for each row of ``docs``.

    ``kept_id`` is the smallest identifier whose normalised text is the same.

    * null text: never equal to another, kept, ``kept_id`` is its own identifier;
    * empty or blank texts: equal to each other;
    * null identifiers sort last: such a row is kept only if no equal row has an identifier;
    * repeated rows and repeated identifiers: one row of each group of equal texts is kept;
    * empty table: empty result; other columns are ignored.
    """
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sorted_ = _ranked(df).select(F.col("id").alias("doc_id"), F.col("first").alias("kept_id"), (F.col("rank") == 1).alias("is_kept"))
    return sorted_.unionByName(
        df.where("text IS NULL").select(F.col("id").alias("doc_id"), F.col("id").alias("kept_id"), F.lit(True).alias("is_kept"))
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns, in no order.

    Rows with a null text stay; of empty and blank texts one row stays; of equal rows with a null
    identifier one stays, if none with an identifier is equal; ties and repeated rows: one stays.
    The row travels as one struct, so extra columns of any name pass as they are. Long texts are
    compared whole; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"))
    kept = _ranked(rows).where("rank = 1").select(*[(F.col("text") if c == text_col else F.col("rest").getField(c)).alias(c) for c in docs.columns])
    return kept.unionByName(docs.where(F.col(f"`{text_col}`").isNull()))


SQL = f"""
WITH n AS (
  SELECT doc_id, trim(regexp_replace(text, '{BLANKS}', ' ', 'g'), ' ') AS norm FROM documents WHERE text IS NOT NULL
)
SELECT doc_id,
       first_value(doc_id) OVER w AS kept_id,
       row_number() OVER w = 1 AS is_kept
FROM n WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST)
UNION ALL
SELECT doc_id, doc_id, true FROM documents WHERE text IS NULL
"""

"""Line dedup over overlapping windows of three lines.

Texts split at newlines; each run of three consecutive lines (blanks at line ends don't
count) is hashed to 128 bits. Of all windows with the same hash in the whole corpus the
first by (doc_id, line number) stays; every later one marks its three lines, and marked
lines that no first occurrence covers are removed. Merging covered positions is a running
maximum over the document's windows, so overlapping hits become one removed run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3


def _windows(df: DataFrame) -> DataFrame:
    """``(doc_id, pos, h1, h2)``: a row for each window that has a line that isn't blank."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"[\t\r\f]", " ")))
    at = df.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", lines.alias("l")).where(F.size("l") >= SIZE)
    joined = F.transform(
        F.sequence(F.lit(1), F.size("l") - (SIZE - 1)),
        lambda i: F.struct(
            (i - 1).alias("pos"),
            F.concat_ws("\n", *[F.element_at(F.col("l"), (i + k).cast("int")) for k in range(SIZE)]).alias("w"),
        ),
    )
    w = at.select("doc_id", F.inline(joined)).where(F.length("w") > SIZE - 1)
    return w.select("doc_id", "pos", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("w"), "w", F.lit(1)).alias("h2"))


def _removed(df: DataFrame) -> DataFrame:
    """``(doc_id, gone)``: the sorted numbers of the lines to remove, for documents that have any."""
    w = _windows(df)
    repeated = (
        w.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    )
    hit = w.join(repeated, ["h1", "h2"]).select(
        "doc_id", "pos", ((F.col("doc_id") == F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))).alias("stays")
    )
    reach = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda p: F.sequence(p, p + (SIZE - 1)))))
    by_doc = hit.groupBy("doc_id").agg(
        F.collect_set(F.when(~F.col("stays"), F.col("pos"))).alias("later"),
        F.collect_set(F.when(F.col("stays"), F.col("pos"))).alias("first"),
    )
    gone = F.array_sort(F.array_except(reach(F.col("later")), reach(F.col("first"))))
    return by_doc.select("doc_id", gone.alias("gone")).where(F.size("gone") > 0)


def _mask(gone: Column) -> Column:
    """A byte for each line up to the last in ``gone`` (ascending), 1 for those that go: looked up in constant time, unlike an array's members."""
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(gone, i - 1))
    return F.unhex(F.array_join(F.transform(gone, lambda p, i: F.concat(F.repeat(F.lit("00"), p - before(i) - 1), F.lit("01"))), ""))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, clean_text, removed_lines)``, a row for each row of ``docs``.

    * null identifier or null text: the text stays as it is, ``removed_lines`` is 0;
    * fewer than three lines, and windows of blank lines only: nothing is removed;
    * a text whose lines all repeat becomes empty, not null;
    * repeated identifiers: their rows count as one document (equal windows of theirs are
      the same occurrence), so what is removed from one is removed from each;
    * ties: there are none, (doc_id, line number) is unique after the rule above.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = _removed(df).select("doc_id", _mask(F.col("gone")).alias("mask"))
    marked = df.join(gone, "doc_id", "left")
    # Rows that share an identifier share a mask, and may have fewer lines than it.
    kept = F.filter(F.split("text", "\n"), lambda x, i: F.substring("mask", i + 1, F.lit(1)) != F.lit(b"\x01"))
    touched = F.col("mask").isNotNull() & F.col("text").isNotNull()
    clean = F.when(touched, F.array_join(kept, "\n")).otherwise(F.col("text"))
    count = F.when(touched, F.size(F.split("text", "\n")) - F.size(kept)).otherwise(F.lit(0))
    return marked.select("doc_id", clean.alias("clean_text"), count.cast("bigint").alias("removed_lines"))


SQL = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), flat AS (
  SELECT doc_id, unnest(range(len(raw))) AS pos, unnest(raw) AS line FROM l
), w AS (
  SELECT doc_id, pos, line,
         rtrim(regexp_replace(line, '[\t\r\f]', ' ', 'g'), ' ') AS t,
         lead(rtrim(regexp_replace(line, '[\t\r\f]', ' ', 'g'), ' '), 1) OVER d AS t1,
         lead(rtrim(regexp_replace(line, '[\t\r\f]', ' ', 'g'), ' '), 2) OVER d AS t2
  FROM flat WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), win AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY t, t1, t2 ORDER BY doc_id, pos) AS rn,
         count(*) OVER (PARTITION BY t, t1, t2) AS n
  FROM w WHERE t2 IS NOT NULL AND length(t) + length(t1) + length(t2) > 0
), cover AS (
  SELECT DISTINCT doc_id, pos + k AS pos, rn = 1 AS stays FROM win, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1
), gone AS (
  SELECT doc_id, pos FROM cover GROUP BY doc_id, pos HAVING NOT bool_or(stays)
), clean AS (
  SELECT f.doc_id, string_agg(f.line, chr(10) ORDER BY f.pos) FILTER (g.pos IS NULL) AS clean_text,
         count(g.pos) AS removed_lines
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.pos = g.pos GROUP BY f.doc_id
)
SELECT doc_id, coalesce(clean_text, '') AS clean_text, CAST(removed_lines AS BIGINT) AS removed_lines FROM clean
UNION ALL
SELECT doc_id, text, CAST(0 AS BIGINT) FROM documents WHERE doc_id IS NULL OR text IS NULL
"""

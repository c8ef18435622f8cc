"""Where in a document a quote is: exact by built-in search, loosely in Python for what misses."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.text import EDGES, strip_blank

#: Characters of the quotes that one pass looks for.
QUOTE_CHARS = 4 << 20
SPAN_TYPE = "struct<start:int,end:int,confidence:string>"


class _Folds(dict):
    """What a character is in folded text, looked up once each."""

    def __missing__(self, n: int) -> str:
        self[n] = found = "".join(" " if c.isspace() else c for c in unicodedata.normalize("NFKC", chr(n)).lower())
        return found


_FOLDS = _Folds()


def fold(body: str) -> str:
    """Text composed (by character), lower-cased, with single blanks."""
    return re.sub("  +", " ", body.translate(_FOLDS))


def fold_with_places(body: str, most: int | None = None):
    """``fold``, and for each of its characters where it came from; only the first ``most`` of them and a few more, if given."""
    out: list[str] = []
    places: list[int] = []
    blank = False
    for i, ch in enumerate(body):
        if most is not None and len(places) >= most:
            break
        for c in _FOLDS[ord(ch)]:
            if c == " ":
                if not blank:
                    out.append(" ")
                    places.append(i)
                blank = True
            else:
                out.append(c)
                places.append(i)
                blank = False
    return "".join(out), places


def find_loosely(quote: str, text: str) -> tuple[int, int] | None:
    """Bounds of ``quote`` in ``text``, both folded; offsets are those of the text as it is, traced only up to the place."""
    want = fold(quote).strip()
    if not want:
        return None
    at = fold(text).find(want)
    if at < 0:
        return None
    places = fold_with_places(text, at + len(want))[1]
    return places[at], places[at + len(want) - 1] + 1


def bare(quote: Column) -> Column:
    return F.btrim(quote, F.lit(EDGES))


def exact_span(quote: Column, content: Column) -> Column:
    """``start, end, confidence`` of a quote: ``exact``, ``inferred`` if it is blank, else null."""
    q = bare(F.coalesce(quote, F.lit("")))
    place = F.call_function("instr", content, q)
    none = F.lit(None).cast("int")
    blank = strip_blank(F.coalesce(quote, F.lit(""))) == ""
    hit = (F.length(q) > 0) & (place > 0)
    return (
        F.when(blank | (F.length(q) == 0), F.struct(none.alias("start"), none.alias("end"), F.lit("inferred").alias("confidence")))
        .when(hit, F.struct((place - 1).alias("start"), (place - 1 + F.length(q)).alias("end"), F.lit("exact").alias("confidence")))
        .cast(SPAN_TYPE)
    )


@F.udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("confidence", T.StringType())]), useArrow=False)
def _loose(quote: str, content: str | None) -> tuple[int | None, int | None, str]:
    found = find_loosely(quote.strip(EDGES), content or "")
    return (*found, "fuzzy") if found else (None, None, "unresolved")


def locate(quotes: DataFrame) -> DataFrame:
    """``quotes(…, quote, content)`` with ``start, end, confidence``; only exact misses go to Python."""
    tried = quotes.withColumn("__s", exact_span(F.col("quote"), F.col("content")))
    hit = tried.where("__s IS NOT NULL")
    miss = tried.where("__s IS NULL").withColumn("__s", _loose("quote", "content"))
    return hit.unionByName(miss).select(*quotes.columns, "__s.start", "__s.end", "__s.confidence")


def _first_places(quotes: list[str]):
    """For each quote of some documents the first of them that holds it: one pass over a text finds all quotes."""
    automaton = ahocorasick.Automaton()
    for q in quotes:
        automaton.add_word(q, q)
    automaton.make_automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[int, str | None, int]] = {}
        for batch in batches:
            for order, doc, content in zip(*(c.to_pylist() for c in batch.columns)):
                seen = set()
                for end, q in automaton.iter(content) if content and order is not None else ():
                    if q not in seen:
                        seen.add(q)
                        if q not in best or order < best[q][0]:
                            best[q] = (order, doc, end + 1 - len(q))
        rows = list(best.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([q for q, _ in rows], pa.string()), *[pa.array([x[i] for _, x in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32()))]], ["__q", "doc_ord", "doc_id", "start"]
        )

    return run


def locate_across(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """``quotes(quote)`` found in the first document (by ``doc_ord``) that holds them exactly; ``doc_id`` is null for none.

    Substrings have no equality to join on, so the quotes travel to the documents as one
    automaton that finds all of them in a single pass over each text. Quotes of more than
    ``QUOTE_CHARS`` characters together go in several passes, each of about that many.
    """
    q = quotes.select("quote", bare(F.col("quote")).alias("__q")).where("__q <> ''").distinct()
    parts = max(1, -(-int(q.agg(F.sum(F.length("__q"))).first()[0] or 0) // QUOTE_CHARS))
    found = None
    for p in range(parts):
        mine = [r[0] for r in q.where(F.pmod(F.xxhash64("__q"), F.lit(parts)) == p).select("__q").distinct().collect()]  # about QUOTE_CHARS
        if mine:
            one = docs.select(F.col("doc_ord").cast("bigint"), F.col("doc_id").cast("string"), "content").mapInArrow(_first_places(mine), "__q string, doc_ord bigint, doc_id string, start int")
            found = one if found is None else found.unionByName(one)
    if found is None:
        none = F.lit(None)
        return quotes.select("*", none.cast("string").alias("doc_id"), none.cast("int").alias("start"), none.cast("int").alias("end"))
    first = found.groupBy("__q").agg(F.min_by(F.struct("doc_id", "start"), "doc_ord").alias("h"))
    hits = q.join(first, "__q").select("quote", "h.doc_id", "h.start", (F.col("h.start") + F.length("__q")).alias("end"))
    return quotes.join(hits, "quote", "left").select(*quotes.columns, "doc_id", "start", "end")


def merge_spans(a: Column, b: Column) -> Column:
    """Spans of ``a``, with those of ``b`` that it hasn't; repeats within ``a`` stay. A null side counts as absent."""
    fresh = F.filter(F.array_distinct(b), lambda x: ~F.array_contains(a, x))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, fresh))


def merge_field_spans(a: Column, b: Column) -> Column:
    """``merge_spans`` by field, over maps of field to spans."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_zip_with(a, b, lambda _, x, y: merge_spans(x, y)))

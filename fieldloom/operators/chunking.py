"""Chunking: documents to overlapping or bounded pieces with code-point offsets.

All strategies return ``doc_ord, doc_id, chunk_id, chunk_index, char_start, char_end, content``
for input ``doc_ord, doc_id, content``; a column ``source`` of the input stays. Null content counts as empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.text import or_default
from fieldloom.functions.vectors import cosine, doubles

COLUMNS = ["doc_ord", "doc_id", "chunk_id", "chunk_index", "char_start", "char_end", "content"]


def _text(df: DataFrame) -> DataFrame:
    return df.select("doc_ord", "doc_id", F.coalesce("content", F.lit("")).alias("content"), *_source(df))


def _source(df: DataFrame) -> list[str]:
    return ["source"] if "source" in df.columns else []


def chunk_fixed(docs: DataFrame, chunk_size: int = 4000, overlap: int = 200) -> DataFrame:
    """Pieces of ``chunk_size`` characters, each starting ``overlap`` before the end of the last.

    A document of at most ``chunk_size`` is one row without chunk columns, under its own
    identifier; so is any document if ``chunk_size`` is 0 or less.
    """
    df = _text(docs)
    if chunk_size <= 0:
        return _whole(df)
    step = max(chunk_size - overlap, 1)
    n = F.length("content")
    starts = F.when(n > chunk_size, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array(F.lit(0)))
    cut = df.select("*", n.alias("n"), F.posexplode(starts).alias("k", "at"))
    long = F.col("n") > chunk_size
    name = F.concat(or_default(F.col("doc_id"), "doc"), F.lit("__chunk_"), F.col("k"))
    return cut.select(
        "doc_ord", "doc_id",
        F.when(long, name).otherwise(F.col("doc_id")).alias("chunk_id"),
        F.when(long, F.col("k")).alias("chunk_index"),
        F.when(long, F.col("at")).alias("char_start"),
        F.when(long, F.least(F.col("at") + chunk_size, F.col("n"))).alias("char_end"),
        F.when(long, F.substring("content", F.col("at") + 1, F.lit(chunk_size))).otherwise(F.col("content")).alias("content"), *_source(df),
    )


def _whole(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int")
    return df.select("doc_ord", "doc_id", F.col("doc_id").alias("chunk_id"), none.alias("chunk_index"), none.alias("char_start"), none.alias("char_end"), "content", *_source(df))


def estimate_chunks(content: Column, chunk_size: int = 4000, overlap: int = 200) -> Column:
    """How many rows ``chunk_fixed`` makes of a document, in closed form."""
    step = max(chunk_size - overlap, 1)
    n = F.coalesce(F.length(content), F.lit(0))
    if chunk_size <= 0:
        return F.lit(1).cast("bigint")
    return F.when(n <= chunk_size, F.lit(1)).otherwise(F.floor((n - 1) / step) + 1).cast("bigint")


#: A token, a word or a single sign, with the blanks behind it.
TOKEN = r"(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\r\n\f])[ \t\r\n\f]*"


_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+[\"')\]]*[ \t\r\n\f\v]*|\n+|$)")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _SENTENCE.finditer(text) if m.end() > m.start()]


def _tokens(n: int) -> int:
    return -(-n // 4)


def pack_sentences(text: str, chunk_size: int, overlap: int) -> list[tuple[int, int]]:
    """Runs of whole sentences within the token budget; the next run repeats up to ``overlap`` tokens of the last."""
    spans = sentence_spans(text)
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(spans):
        j, used = i, 0
        while j < len(spans) and (j == i or used + _tokens(spans[j][1] - spans[j][0]) <= chunk_size):
            used += _tokens(spans[j][1] - spans[j][0])
            j += 1
        out.append((spans[i][0], spans[j - 1][1]))
        if j == len(spans):
            break
        back, i = 0, j
        while i - 1 > 0 and spans[i - 1][0] > out[-1][0] and back + _tokens(spans[i - 1][1] - spans[i - 1][0]) <= overlap:
            i -= 1
            back += _tokens(spans[i][1] - spans[i][0])
    return out or [(0, len(text))]


DELIMITERS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
#: Delimiters for kinds of text, by name.
RECIPES = {
    "default": DELIMITERS,
    "markdown": ("\n# ", "\n## ", "\n### ", "\n```", "\n\n", "\n- ", "\n", ". ", " "),
    "lines": ("\n\n", "\n"),
}


def split_recursively(text: str, chunk_size: int, delimiters: tuple[str, ...] = DELIMITERS) -> list[tuple[int, int]]:
    """Pieces within the token budget: split at the first delimiter, pack neighbours, go on to the next for what is too long."""

    def visit(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if _tokens(b - a) <= chunk_size:
            return [(a, b)]
        if level == len(delimiters):
            size = chunk_size * 4
            return [(i, min(i + size, b)) for i in range(a, b, size)]
        cuts, at = [a], a
        while (k := text.find(delimiters[level], at, b)) >= 0:
            at = k + len(delimiters[level])
            cuts.append(at)
        if cuts[-1] != b:
            cuts.append(b)
        out: list[tuple[int, int]] = []
        for x, y in zip(cuts, cuts[1:]):
            if out and _tokens(y - out[-1][0]) <= chunk_size:
                out[-1] = (out[-1][0], y)
            elif _tokens(y - x) <= chunk_size:
                out.append((x, y))
            else:
                out += visit(x, y, level + 1)
        return out

    return visit(0, len(text), 0) or [(0, 0)]


def _in_python(docs: DataFrame, spans: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    df = _text(docs).withColumn("row", F.monotonically_increasing_id())
    keep = [c for c in df.columns if c != "content"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [spans(c) for c in pdf.content]
            out = pdf.loc[pdf.index.repeat([len(f) for f in found]), keep].reset_index(drop=True)
            out["k"] = [k for f in found for k in range(len(f))]
            out["a"], out["b"] = [a for f in found for a, _ in f], [b for f in found for _, b in f]
            out["content"] = [c[a:b] for c, f in zip(pdf.content, found) for a, b in f]
            yield out

    made = df.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", k int, a int, b int, content string")
    name = F.concat(or_default(F.col("doc_id"), "doc"), F.lit("__chunk_"), F.col("k"))
    return made.select("doc_ord", "doc_id", name.alias("chunk_id"), F.col("k").alias("chunk_index"), F.col("a").alias("char_start"), F.col("b").alias("char_end"), "content", *_source(df), "row")


def chunk_tokens(docs: DataFrame, chunk_size: int = 512, overlap: int = 64) -> DataFrame:
    """Pieces of ``chunk_size`` tokens, ``overlap`` of them shared; a text without tokens is one piece.

    Blanks go with the token before them, those before the first token with that. Places are sums
    over steps of tokens, so a long text takes linear time.
    """
    df, step = _text(docs), max(chunk_size - overlap, 1)
    lead = F.regexp_extract("content", r"^[ \t\r\n\f]*", 0)
    pieces = df.withColumn("p", F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0))).withColumn("lead", F.length(lead)).withColumn("n", F.size("p"))
    text = lambda at, size: F.array_join(F.slice("p", at + 1, size), "")
    last = F.greatest(F.ceil((F.col("n") - chunk_size) / step), F.lit(0)).cast("int")
    steps = F.transform(F.sequence(F.lit(0), last), lambda k: F.length(text(k * step, F.lit(step))))
    before = lambda k: F.aggregate(F.slice("w", 1, k), F.lit(0), lambda x, y: x + y)
    made = pieces.withColumn("w", steps).select("*", F.posexplode("w").alias("k", "x"))
    body = text(F.col("k") * step, F.lit(chunk_size))
    first = F.col("k") == 0
    content = F.when(F.col("n") == 0, F.col("content")).when(first, F.concat(lead, body)).otherwise(body)
    begin = F.when(first, F.lit(0)).otherwise(F.col("lead") + before(F.col("k")))
    out = made.select("*", content.alias("c"), begin.cast("int").alias("a"))
    name = F.concat(or_default(F.col("doc_id"), "doc"), F.lit("__chunk_"), F.col("k"))
    return out.select(
        "doc_ord", "doc_id", name.alias("chunk_id"), F.col("k").alias("chunk_index"), F.col("a").alias("char_start"), (F.col("a") + F.length("c")).alias("char_end"), F.col("c").alias("content"), *_source(df)
    )


def chunk_sentences(docs: DataFrame, chunk_size: int = 512, overlap: int = 64) -> DataFrame:
    """Greedy packing needs a sum that resets, which windows can't express: Arrow batches in Python."""
    return _in_python(docs, lambda t: pack_sentences(t, chunk_size, overlap)).drop("row")


def chunk_recursively(docs: DataFrame, chunk_size: int = 512, delimiters: tuple[str, ...] = DELIMITERS) -> DataFrame:
    return _in_python(docs, lambda t: split_recursively(t, chunk_size, delimiters)).drop("row")


def chunk_semantically(docs: DataFrame, embed: Callable[[Column], Column], threshold: float = 0.5) -> DataFrame:
    """Splits where neighbouring sentences are less similar than ``threshold``; ``embed`` maps text to a vector."""
    sentences = _in_python(docs, lambda t: sentence_spans(t) or [(0, 0)])
    distinct = sentences.select("content").distinct().withColumn("v", doubles(embed(F.col("content"))))
    with_v = sentences.join(distinct, "content")
    order = Window.partitionBy("row").orderBy("chunk_index")
    before = F.lag("v").over(order)
    broken = F.when(before.isNotNull() & (cosine(before, F.col("v")) < threshold), 1).otherwise(0)
    cut = with_v.withColumn("x", broken).withColumn("k", F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    groups = cut.groupBy("row", "doc_ord", "doc_id", "k", *_source(cut)).agg(
        F.min("char_start").alias("a"), F.max("char_end").alias("b"), F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("s")
    )
    name = F.concat(or_default(F.col("doc_id"), "doc"), F.lit("__chunk_"), F.col("k"))
    return groups.select(
        "doc_ord", "doc_id", name.alias("chunk_id"), F.col("k").cast("int").alias("chunk_index"), F.col("a").alias("char_start"),
        F.col("b").alias("char_end"), F.array_join(F.col("s.content"), "").alias("content"), *_source(groups),
    )


@dataclass(frozen=True)
class FixedSizeChunking:
    chunk_size: int = 4000
    overlap: int = 200

    def chunk(self, docs: DataFrame) -> DataFrame:
        return chunk_fixed(docs, self.chunk_size, self.overlap)

    chunk_batch = chunk

    def estimate_chunks(self, docs: DataFrame) -> int:
        return int(docs.agg(F.sum(estimate_chunks(F.col("content"), self.chunk_size, self.overlap))).first()[0] or 0)


class _Counted:
    def chunk_batch(self, docs: DataFrame) -> DataFrame:
        return self.chunk(docs)

    def estimate_chunks(self, docs: DataFrame) -> int:
        return self.chunk(docs).count()


@dataclass(frozen=True)
class TokenChunking(_Counted):
    chunk_size: int = 512
    overlap: int = 64

    def chunk(self, docs: DataFrame) -> DataFrame:
        return chunk_tokens(docs, self.chunk_size, self.overlap)


@dataclass(frozen=True)
class SentenceChunking(_Counted):
    chunk_size: int = 512
    overlap: int = 64

    def chunk(self, docs: DataFrame) -> DataFrame:
        return chunk_sentences(docs, self.chunk_size, self.overlap)


@dataclass(frozen=True)
class RecursiveChunking(_Counted):
    chunk_size: int = 512
    delimiters: tuple[str, ...] | None = None
    recipe: str = "default"

    def __post_init__(self):
        if self.recipe not in RECIPES:
            raise ValueError(f"no recipe {self.recipe!r}; there are {', '.join(RECIPES)}")

    def chunk(self, docs: DataFrame) -> DataFrame:
        return chunk_recursively(docs, self.chunk_size, self.delimiters or RECIPES[self.recipe])


@dataclass(frozen=True)
class SemanticChunking(_Counted):
    embed: Callable[[Column], Column]
    threshold: float = 0.5

    def chunk(self, docs: DataFrame) -> DataFrame:
        return chunk_semantically(docs, self.embed, self.threshold)


def effective_chunk_size(chunk_size: int = -1, multi_record: bool = False) -> int:
    """-1 stands for 4000, or no chunking where a document gives several records."""
    return chunk_size if chunk_size != -1 else 0 if multi_record else 4000

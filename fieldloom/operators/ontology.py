"""Mapping values to ontology entries by vector search, with augmented queries and reranking."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.errors import NormalizationError
from fieldloom.functions.batches import loaded, matrix, one_batch
from fieldloom.functions.plain import strip_fences
from fieldloom.functions.vectors import cosine, doubles
from fieldloom.operators.checkpoint import cut, versions
from fieldloom.providers import EmbeddingClient, LLMClient, embed_distinct, in_flight

#: Bytes of index vectors that the matrix search sends to every task; a larger index is searched in parts.
INDEX_BYTES = 64 << 20
#: Index texts up to which the search by expressions takes them along as a list.
LISTED = 2000
#: Index texts whose products with some queries a task holds at a time.
TILE = 4096
AUGMENT_BELOW = 0.95


def index_texts(ontology: DataFrame) -> DataFrame:
    """``(id, name, text_ord, text, shown)`` for each name and synonym.

    Where different entries share a text (case doesn't count), ``shown`` tells them apart by up
    to three synonyms and the identifier; elsewhere it is the text.
    """
    every = F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    rows = ontology.select("id", "name", "synonyms", F.posexplode(every).alias("text_ord", "text"))
    shared = rows.groupBy(F.lower("text").alias("__low")).agg(F.count_distinct("id").alias("__n")).where("__n > 1")
    marked = rows.join(shared, F.lower("text") == F.col("__low"), "left")
    tag = F.concat(F.lit("["), "id", F.lit("]"))
    syn = F.array_join(F.slice(F.coalesce("synonyms", F.array().cast("array<string>")), 1, 3), ", ")
    told = F.when(syn != "", F.concat("text", F.lit(" (also known as: "), syn, F.lit("; "), tag, F.lit(")"))).otherwise(F.concat("text", F.lit(" ("), tag, F.lit(")")))
    return marked.select("id", "name", "text_ord", "text", F.when(F.col("__n").isNotNull(), told).otherwise(F.col("text")).alias("shown"))


def build_index(ontology: DataFrame, client: EmbeddingClient, stored: DataFrame | None = None) -> DataFrame:
    """``index_texts`` with ``embedding``; texts that ``stored(shown, embedding)`` has aren't embedded again.

    The store is keyed by the text itself, so it can't serve another text's vector.
    """
    texts = index_texts(ontology)
    wanted = texts.select("shown").distinct()
    if stored is None:
        vectors = embed_distinct(wanted, client, "shown")
    else:
        fresh = embed_distinct(wanted.join(stored, "shown", "left_anti"), client, "shown")
        vectors = stored.select("shown", "embedding").join(wanted, "shown", "left_semi").unionByName(fresh)
    return texts.join(vectors, "shown")


def load_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete store of ``(shown, embedding)`` in a folder; None if there is none."""
    have = versions(spark, path)
    return spark.read.parquet(f"{path}/v={have[-1]}") if have else None


def build_stored_index(ontology: DataFrame, client: EmbeddingClient, path: str) -> DataFrame:
    """``build_index`` with a store in a folder: what it lacks is embedded once and written to a new version, so that no reader sees half of it."""
    spark = ontology.sparkSession
    stored = load_vectors(spark, path)
    texts = index_texts(ontology)
    wanted = texts.select("shown").distinct()
    lacking = wanted if stored is None else wanted.join(stored, "shown", "left_anti")
    if stored is None or not lacking.isEmpty():
        fresh = embed_distinct(lacking, client, "shown")
        version = (versions(spark, path) or [0])[-1] + 1
        (fresh if stored is None else stored.select("shown", "embedding").unionByName(fresh)).write.parquet(f"{path}/v={version}")
    return texts.join(load_vectors(spark, path), "shown")


def _best(scored: DataFrame, top_k: int) -> DataFrame:
    """Best ``3·top_k`` texts of a value, then its best ``top_k`` entries among them (there may be fewer)."""
    by_text = Window.partitionBy("value").orderBy(F.desc("score"), "id", "text_ord")
    window = scored.withColumn("__n", F.row_number().over(by_text)).where(F.col("__n") <= 3 * top_k)
    entries = window.groupBy("value", "id").agg(F.first("name").alias("name"), F.max("score").alias("score"))
    return top_candidates(entries, top_k)


def top_candidates(entries: DataFrame, top_k: int) -> DataFrame:
    by_entry = Window.partitionBy("value").orderBy(F.desc("score"), "id")
    return entries.withColumn("rank", F.row_number().over(by_entry)).where(F.col("rank") <= top_k)


def search(queries: DataFrame, index: DataFrame, top_k: int = 5) -> DataFrame:
    """``(value, id, name, score, rank)`` for ``queries(value, embedding)`` by cosine, in built-in expressions.

    The index goes to the queries' tasks as one list, of at most ``LISTED`` texts; a larger one is
    searched by ``search_matrix``.
    """
    if index.limit(LISTED + 1).count() > LISTED:
        return search_matrix(queries, index, top_k)
    q = queries.select("value", doubles(F.col("embedding")).alias("__q"))
    terms = index.agg(F.collect_list(F.struct("id", "name", "text_ord", doubles(F.col("embedding")).alias("t"))).alias("__terms")).withColumn("__one", F.lit(1))
    met = q.withColumn("__one", F.lit(1)).join(F.broadcast(terms), "__one").select("value", "__q", F.explode("__terms").alias("e"))
    return _best(met.select("value", "e.id", "e.name", "e.text_ord", cosine(F.col("__q"), F.col("e.t")).alias("score")), top_k)


def _lengths(rows: np.ndarray) -> np.ndarray:
    """As a column; 1 for a zero vector."""
    n = np.sqrt((rows**2).sum(axis=1))[:, None]
    return np.where(n == 0, 1, n)


def _nearest(q: np.ndarray, m: np.ndarray, keep: int, best: tuple[np.ndarray, np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` best of ``best`` (scores, places) and of the products with ``m``, whose places count from ``first``; ties go to the lower place."""
    for a in range(0, len(m), TILE):
        s = q @ m[a : a + TILE].T
        scores, places = best
        have = scores.shape[1]
        if have >= keep:  # later ones that tie with the last of the best come behind it
            floor = scores[:, -1] + 4e-13
        else:
            floor = np.partition(s, -keep, axis=1)[:, -keep] - 2e-12 if s.shape[1] > keep else np.full(len(s), -np.inf)
            floor = np.where(np.isnan(floor), -np.inf, floor) if have == 0 else np.full(len(s), -np.inf)
        row, col = np.nonzero(s > floor[:, None])
        if not len(row):
            continue
        # Equal vectors tie, whatever the order of additions.
        row, score, place = np.concatenate([np.repeat(np.arange(len(q)), have), row]), np.concatenate([scores.ravel(), np.round(s[row, col], 12)]), np.concatenate([places.ravel(), first + a + col])
        order = np.lexsort((place, -score, row))
        row, score, place = row[order], score[order], place[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        width = min(keep, int(nth.max()) + 1)
        best = np.full((len(q), width), -np.inf), np.full((len(q), width), -1, dtype=np.int64)
        top = nth < width
        best[0][row[top], nth[top]], best[1][row[top], nth[top]] = score[top], place[top]
    return best


def search_matrix(queries: DataFrame, index: DataFrame, top_k: int = 5) -> DataFrame:
    """As ``search``, as matrix products in Arrow batches against parts of the index of about ``INDEX_BYTES``, names and all.

    Parts are broadcasts: a task goes through them one after another with a batch of queries, a tile of
    products at a time, and gives the best texts of each query. The index is read once for each part,
    and once for its size: give it as a table, or cut.
    """
    size = F.coalesce(F.sum(8 * F.size("embedding") + F.coalesce(F.length("id"), F.lit(0)) + F.coalesce(F.length("name"), F.lit(0)) + 16), F.lit(0))
    total = index.agg(size).first()[0]
    spark = queries.sparkSession
    if not total:
        return spark.createDataFrame([], "value string, id string, name string, score double, rank int")
    parts = -(-total // INDEX_BYTES)
    kept, texts = [], [F.col("id").cast("string").alias("id"), F.col("name").cast("string").alias("name"), F.col("text_ord").cast("int").alias("text_ord")]
    for p in range(parts):
        mine = index.where(F.pmod(F.xxhash64("id", "text_ord"), F.lit(parts)) == p).orderBy("id", "text_ord").select(*texts, doubles(F.col("embedding")).alias("embedding")).toArrow()
        if mine.num_rows:
            mine = one_batch(mine)
            m = matrix(mine.column("embedding"))
            kept.append(spark.sparkContext.broadcast((m / _lengths(m), mine.select(["id", "name", "text_ord"]))))
    keep = 3 * top_k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("embedding"))
            q /= _lengths(q)
            for part in kept if len(q) else ():
                m, told = loaded(part)
                for a in range(0, len(q), 256):
                    none = np.empty((len(q[a : a + 256]), 0)), np.empty((len(q[a : a + 256]), 0), dtype=np.int64)
                    scores, places = _nearest(q[a : a + 256], m, keep, none, 0)
                    row, nth = np.nonzero(places >= 0)
                    found = told.take(pa.array(places[row, nth]))
                    yield pa.RecordBatch.from_arrays([batch.column("value").take(pa.array(a + row)), *found.columns, pa.array(scores[row, nth])], ["value", "id", "name", "text_ord", "score"])

    # Each query meets the whole index, so a few of them are a task's work.
    spread = queries.select(F.col("value").cast("string").alias("value"), "embedding").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    return _best(spread.mapInArrow(run, "value string, id string, name string, text_ord int, score double"), top_k)


def merge_candidates(a: DataFrame, b: DataFrame, top_k: int) -> DataFrame:
    """Of two candidate lists the best ``top_k`` entries, each at its higher score."""
    both = a.select("value", "id", "name", "score").unionByName(b.select("value", "id", "name", "score"))
    return top_candidates(both.groupBy("value", "id").agg(F.first("name").alias("name"), F.max("score").alias("score")), top_k)


def augment(weak: DataFrame, client: LLMClient, phrasings: int = 5, batch: int = 30, concurrency: int = 8) -> DataFrame:
    """``(value, phrase)`` from a model, for values whose best score is low; a failed call gives none."""

    def ask(some: list[str]) -> list[tuple[str, str]]:
        prompt = "Give other wordings of these terms as a JSON object of lists:\n" + "\n".join(f"- {v}" for v in some)
        try:
            got = json.loads(strip_fences(client.complete([{"role": "user", "content": prompt}]).content))
        except Exception:  # noqa: BLE001 - without other wordings the value keeps its candidates
            return []
        return [(v, str(p)) for v in some if isinstance(got, dict) and isinstance(got.get(v), list) for p in got[v][:phrasings] if p]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = pdf.value.tolist()
            made = in_flight(ask, [values[a : a + batch] for a in range(0, len(values), batch)], concurrency)
            yield pd.DataFrame([r for rows in made for r in rows], columns=["value", "phrase"])

    return weak.select("value").distinct().mapInPandas(run, "value string, phrase string")


def parse_rerank(reply: str | None, candidates: Sequence[dict]) -> tuple[str | None, float, str | None]:
    """The chosen identifier, its confidence and the reason. No JSON: the best by score; no or an unknown choice: the best with 0."""
    if not candidates:
        return None, 0.0, None
    best = candidates[0]
    try:
        got = json.loads(strip_fences(reply or ""))
        assert isinstance(got, dict)
    except (ValueError, AssertionError):
        return best["id"], float(best["score"]), None
    if got.get("id") in {c["id"] for c in candidates}:
        return got["id"], float(got.get("confidence") or 0.0), got.get("rationale")
    return best["id"], 0.0, got.get("rationale")


def rerank(candidates: DataFrame, synonyms: DataFrame, client: LLMClient, concurrency: int = 8) -> DataFrame:
    """``(value, id, confidence, rationale)``: a model's choice among the candidates of each value, with up to ``concurrency`` calls in flight in a task."""
    with_syn = candidates.join(synonyms.select("id", F.slice(F.coalesce("synonyms", F.array().cast("array<string>")), 1, 5).alias("syn")), "id")
    lists = with_syn.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "name", "score", "syn"))).alias("c"))

    def ask(item: tuple) -> tuple:
        value, c = item
        some = [{"id": x["id"], "name": x["name"], "score": x["score"], "syn": list(x["syn"])} for x in c]
        lines = "\n".join(f"{x['id']}: {x['name']}" + (f" ({', '.join(x['syn'])})" if x["syn"] else "") for x in some)
        try:
            reply = client.complete([{"role": "user", "content": f"Which entry means {value!r}? Reply with id, confidence and rationale as JSON.\n{lines}"}]).content
        except Exception:  # noqa: BLE001 - the best by score stands in
            reply = None
        return (value, *parse_rerank(reply, some))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(in_flight(ask, list(zip(pdf.value, pdf.c)), concurrency), columns=["value", "id", "confidence", "rationale"])

    return lists.mapInPandas(run, "value string, id string, confidence double, rationale string")


@dataclass
class OntologyMapping:
    """Distinct values to entries: embed, search, optionally augment and rerank; no match keeps the value.

    What a model answered is cut, so that each question is put once however often a table is read.
    ``index``: a table of ``build_index``, or ``index_path``: a folder that keeps vectors between runs.
    """

    ontology: DataFrame
    embeddings: EmbeddingClient
    llm: LLMClient | None = None
    top_k: int = 5
    use_rerank: bool = False
    augment_queries: bool = False
    confidence_threshold: float = 0.0
    index: DataFrame | None = None
    index_path: str | None = None
    concurrency: int = 8

    def _index(self) -> DataFrame:
        if self.index is None:
            self.index = build_stored_index(self.ontology, self.embeddings, self.index_path) if self.index_path else cut(build_index(self.ontology, self.embeddings))
        return self.index

    def normalize(self, values: DataFrame, context_field: str = "") -> DataFrame:
        if (self.use_rerank or self.augment_queries) and self.llm is None:
            raise NormalizationError("reranking and augmentation need a model")
        index = self._index()
        vectors = cut(embed_distinct(values, self.embeddings, "value"))
        found = cut(search_matrix(vectors, index, self.top_k))
        if self.augment_queries:
            weak = found.where((F.col("rank") == 1) & (F.col("score") < AUGMENT_BELOW))
            more = cut(augment(weak, self.llm, concurrency=self.concurrency))
            phrases = cut(embed_distinct(more, self.embeddings, "phrase").withColumnRenamed("phrase", "value"))
            again = search_matrix(phrases, index, self.top_k)
            back = more.join(again.withColumnRenamed("value", "phrase"), "phrase").select("value", "id", "name", "score")
            found = cut(merge_candidates(found, back, self.top_k))
        best = found.where("rank = 1")
        if self.use_rerank:
            chosen = cut(rerank(found, self.ontology, self.llm, self.concurrency))
            names = self.ontology.select("id", "name").dropDuplicates(["id"])
            picked = chosen.join(names, "id").join(best.select("value", F.col("score").alias("best")), "value")
        else:
            picked = best.select("value", "id", "name", F.col("score").alias("confidence"), F.lit(None).cast("string").alias("rationale"), F.col("score").alias("best"))
        distinct = values.where("value IS NOT NULL").select("value").distinct()
        rows = distinct.join(picked, "value", "left")
        ok = F.col("id").isNotNull() & (F.col("confidence") >= self.confidence_threshold)
        why = F.when(F.coalesce("rationale", F.lit("")) != "", F.concat(F.lit(": "), "rationale")).otherwise("")
        text = F.concat(F.lit("→ "), "name", F.lit(" ("), "id", F.lit("), confidence="), F.format_string("%.3f", F.col("confidence")), why)
        return rows.select(
            F.lit(context_field).alias("field"), F.col("value").alias("raw"), F.when(ok, F.col("name")).otherwise(F.col("value")).alias("canonical"),
            F.coalesce(F.when(ok, F.col("confidence")), F.col("best"), F.lit(0.0)).alias("confidence"), F.when(ok, F.col("id")).alias("ontology_id"),
            F.when(ok, text).alias("explanation"), F.lit("ontology").alias("strategy"),
        )

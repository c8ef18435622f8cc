"""Clusters of values: k-means steps as joins, hierarchical and density clustering in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.errors import NormalizationError
from fieldloom.functions.batches import loaded, matrix, one_batch
from fieldloom.functions.vectors import doubles, squared_distance
from fieldloom.operators.checkpoint import cut
from fieldloom.operators.mapping import frequencies
from fieldloom.providers import EmbeddingClient, LLMClient, embed_distinct

#: Distinct values of one field that hierarchical clustering takes: its distance matrix grows with their square.
LARGEST = 8000
#: Bytes of points that all others are compared with at a time.
BLOCK_BYTES = 16 << 20
#: Sums, of a point and a cluster, that a task holds.
SUMS = 4 << 20


def mode_canonical(members: DataFrame) -> DataFrame:
    """``(label, value, canonical)`` for ``members(label, value, freq, first_ord)``.

    The most frequent value of a cluster, of equally frequent ones the first seen; label -1 is
    noise, whose values stay as they are.
    """
    best = members.where("label >= 0").groupBy("label").agg(F.max_by("value", F.struct("freq", -F.col("first_ord"))).alias("canonical"))
    joined = members.join(best, "label", "left")
    return joined.select("label", "value", F.coalesce("canonical", "value").alias("canonical"))


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """``points(id, v)`` with ``k`` and ``distance`` of the nearest of ``centroids(k, c)``; ties go to the lowest ``k``.

    A few centroids meet every point, so they are packed into one row and points don't move.
    """
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("k", doubles(F.col("c")).alias("c")))).alias("__cs"))
    d = F.transform("__cs", lambda x: F.struct(squared_distance(doubles(F.col("v")), x["c"]).alias("d"), x["k"].alias("k")))
    return points.crossJoin(packed).withColumn("__best", F.array_min(d)).select(*points.columns, "__best.k", F.col("__best.d").alias("distance"))


def update(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """The mean of each cluster's points; a cluster without points keeps its centroid."""
    parts = assigned.select("k", F.posexplode(doubles(F.col("v"))).alias("pos", "x")).groupBy("k", "pos").agg(F.avg("x").alias("m"))
    means = parts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("p")).select("k", F.col("p.m").alias("new"))
    return centroids.join(means, "k", "left").select("k", F.coalesce("new", doubles(F.col("c"))).alias("c"))


def silhouette(points: DataFrame) -> DataFrame:
    """``(id, silhouette)`` for ``points(id, v, k)`` by Euclidean distance; a cluster of one point scores 0.

    All points meet blocks of all points, as matrix products. Blocks of about ``BLOCK_BYTES``, ordered by
    cluster, are broadcasts: a task goes through them one after another with some of the points and keeps
    a sum for each of these and each cluster. Neither vectors, distances nor sums are shuffled, and no
    task holds more than a block, a tile of distances and ``SUMS`` sums.
    """
    kind = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    spark = points.sparkSession
    mine = cut(points.select("id", "k", doubles(F.col("v")).alias("v")))
    clustered = mine.where("k IS NOT NULL")  # points without a cluster score 0
    size = clustered.agg(F.sum(8 * F.size("v") + 32)).first()[0] or 0
    blocks, kept, place, counts = max(1, -(-int(size) // BLOCK_BYTES)), [], {}, []
    for b in range(blocks):
        block = clustered.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("k", "v").toArrow()  # about BLOCK_BYTES
        if not block.num_rows:
            continue
        block = one_batch(block)
        code = np.array([place.setdefault(c, len(place)) for c in block.column("k").to_pylist()])
        order = np.argsort(code, kind="stable")
        kept.append(spark.sparkContext.broadcast((matrix(block.column("v"))[order], code[order])))
        counts += [0] * (len(place) - len(counts))
        for c, n in zip(*np.unique(code, return_counts=True)):
            counts[c] += int(n)
    clusters = spark.sparkContext.broadcast((place, np.array(counts, dtype=np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n = clusters.value
        step = max(1, min(4096, SUMS // max(1, len(n))))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                own = np.array([place.get(c, -1) for c in some.column("k").to_pylist()])
                x = matrix(some.column("v"))
                sums = np.zeros((len(x), len(n)))
                for block in kept if (own >= 0).any() else ():
                    _add_distances(sums, x, *loaded(block))
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(_scores(sums, own, n))], ["id", "silhouette"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return mine.repartition(tasks).mapInArrow(run, f"id {kind['id']}, silhouette double")  # each point meets all, so a few of them are a task's work


def _add_distances(sums: np.ndarray, x: np.ndarray, y: np.ndarray, code: np.ndarray) -> None:
    """Adds the distances of ``x`` to ``y`` to their sums by cluster, a tile that a processor's cache holds at a time."""
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    left, right = np.column_stack([-2 * x, xx, np.ones(len(x))]), np.column_stack([y, np.ones(len(y)), yy])  # squares come with the products
    for c in range(0, len(y), 1024):
        starts = np.flatnonzero(np.diff(code[c : c + 1024], prepend=-1))
        names = code[c : c + 1024][starts]
        tile, squares = right[c : c + 1024].T.copy(), yy[c : c + 1024]
        for r in range(0, len(x), 128):
            d = left[r : r + 128] @ tile
            here = xx[r : r + 128]
            for i in np.flatnonzero(d.min(axis=1) < 1e-12 * (here + squares.max())):
                d[i][d[i] < 1e-12 * (here[i] + squares)] = 0  # a point and itself, or its like, are at no distance
            np.sqrt(d, out=d)
            sums[r : r + 128, names] += np.add.reduceat(d, starts, axis=1)


def _scores(sums: np.ndarray, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Silhouettes from the sums of distances to each cluster's points, and these points' number."""
    if len(counts) < 2:
        return np.zeros(len(sums))
    rows = np.arange(len(sums))
    with np.errstate(divide="ignore", invalid="ignore"):
        a = sums[rows, own] / (counts[own] - 1)
        means = sums / counts
        means[rows, own] = np.inf
        b = means.min(axis=1)
        most = np.maximum(a, b)
        s = np.where(most == 0, 0.0, (b - a) / most)
    return np.where((own < 0) | (counts[own] < 2), 0.0, s)


def kmeans_pp(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """k-means++ centres; once all points are centres (all the same, say) the next are drawn evenly."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
        centres.append(x[rng.choice(len(x), p=p)])
    return np.array(centres)


def draw_centres(points: DataFrame, k: int, seed: int = 42) -> list[list[float]]:
    """k-means++ centres from all of ``points(id, v)``: each next one with a chance in proportion to its squared distance.

    A draw is the least of exponential variates (from a hash of identifier and round) over their rates:
    one aggregate a centre. Once all points are centres the least hash is drawn.
    """
    spark = points.sparkSession
    unit = lambda i: (F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(1 << 52)).cast("double") + 1) / float((1 << 52) + 1)
    first = points.agg(F.min_by("v", F.struct(unit(0), "id"))).first()[0]
    centres = [list(first)]
    while len(centres) < k:
        table = spark.createDataFrame(list(enumerate(centres)), "k int, c array<double>")
        away = assign(points.select("id", "v"), table)
        rate = F.when(F.col("distance") > 1e-12, -F.log(unit(len(centres))) / F.col("distance")).otherwise(F.lit(float("inf")))
        best = away.select("id", rate.alias("wait"), unit(len(centres)).alias("u")).agg(F.min_by("id", F.struct("wait", "u", "id")).alias("id"))
        centres.append(list(points.join(F.broadcast(best), "id").first().v))  # one row
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]).argmin(axis=1)


def distances(x: np.ndarray) -> np.ndarray:
    """Of all pairs, by the products of rows: n x n numbers, whatever the dimension."""
    squares = (x**2).sum(axis=1)
    d = np.sqrt(np.maximum(squares[:, None] - 2 * x @ x.T + squares[None, :], 0))
    np.fill_diagonal(d, 0)
    return d


def silhouette_score(x: np.ndarray, labels: np.ndarray, d: np.ndarray | None = None) -> float:
    """The mean silhouette; ``d``: the points' distances, where they are known."""
    names = np.unique(labels)
    if len(names) < 2 or len(names) >= len(x):
        return -1.0
    d = distances(x) if d is None else d
    sums = np.stack([d[:, labels == n].sum(axis=1) for n in names], axis=1)
    size = np.array([(labels == n).sum() for n in names])
    own = np.searchsorted(names, labels)
    a = sums[np.arange(len(x)), own] / np.maximum(size[own] - 1, 1)
    mean = sums / size
    mean[np.arange(len(x)), own] = np.inf
    b = mean.min(axis=1)
    top = np.maximum(a, b)
    return float(np.where((size[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0).mean())


def auto_k(x: np.ndarray, seed: int = 42) -> int:
    """The number of clusters, up to 20, whose first assignment has the best silhouette (the least on ties)."""
    most = max(2, min(int(math.sqrt(len(x))), 20))
    if most <= 2:
        return 2
    d = distances(x)
    scores = [silhouette_score(x, nearest(x, kmeans_pp(x, k, seed)), d) for k in range(2, most + 1)]
    return 2 + int(np.argmax(scores))


def agglomerative(x: np.ndarray, threshold: float) -> np.ndarray:
    """Average linkage by cosine distance, up to ``threshold``; labels in the order of first members."""
    n = len(x)
    if n == 1:
        return np.zeros(1, dtype=int)
    unit = x / np.where((m := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, m)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, alive, parent = np.ones(n), np.ones(n, bool), np.arange(n)
    for _ in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        if not d[i, j] <= threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[[i, j]] = np.inf
        row[~alive] = np.inf
        d[i, :] = d[:, i] = row
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        parent[parent == j] = i
    return np.unique(parent, return_inverse=True)[1]


def hdbscan(x: np.ndarray, min_cluster_size: int = 5) -> np.ndarray:
    """Density clusters by excess of mass on the mutual-reachability tree; -1 is noise."""
    n = len(x)
    size = min(min_cluster_size, max(2, n // 3))
    if n < size or n < 3:
        return np.full(n, -1)
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1)[None, :], 0))
    core = np.sort(d, axis=1)[:, min(size, n) - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    edges, best, link, left = [], reach[0].copy(), np.zeros(n, int), np.ones(n, bool)
    left[0] = False
    for _ in range(n - 1):
        j = int(np.where(left, best, np.inf).argmin())
        edges.append((best[j], int(link[j]), j))
        left[j] = False
        closer = left & (reach[j] < best)
        best[closer], link[closer] = reach[j][closer], j
    # single-linkage tree
    top, kids, dist, count = list(range(n)), {}, {}, [1] * n
    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i
    for w, a, b in sorted(edges):
        a, b = root(a), root(b)
        m = len(top)
        top.append(m)
        top[a] = top[b] = m
        kids[m], dist[m] = (a, b), w
        count.append(count[a] + count[b])
    def leaves(m: int) -> list[int]:
        out, todo = [], [m]
        while todo:
            k = todo.pop()
            if k < n:
                out.append(k)
            else:
                todo += kids[k]
        return out
    labels, found = np.full(n, -1), []
    def condense(m: int, born: float) -> tuple[float, list[int]]:
        """Stability of the best choice at or below ``m``, and the roots of the chosen clusters."""
        stable, k = 0.0, m
        while True:
            if k < n:
                return stable, [m]
            a, b = kids[k]
            lam = 1 / max(dist[k], 1e-12)
            big = [c for c in (a, b) if count[c] >= size]
            if len(big) == 2:
                stable += count[k] * (lam - born)
                below = [condense(c, lam) for c in (a, b)]
                deep = sum(s for s, _ in below)
                return (deep, [r for _, rs in below for r in rs]) if deep > stable else (stable, [m])
            lost = sum(count[c] for c in (a, b) if c not in big)
            stable += lost * (lam - born)
            if not big:
                return stable, [m]
            k = big[0]
    whole = len(top) - 1
    k = whole
    while k >= n and not all(count[c] >= size for c in kids[k]):  # the root isn't a cluster, only its first split is
        big = [c for c in kids[k] if count[c] >= size]
        if not big:
            return labels
        k = big[0]
    if k >= n:
        lam = 1 / max(dist[k], 1e-12)
        for c in kids[k]:
            found += condense(c, lam)[1]
    for i, m in enumerate(sorted(found, key=lambda r: min(leaves(r)))):
        labels[leaves(m)] = i
    return labels


def reduce_dimensions(x: np.ndarray, most: int = 32) -> np.ndarray:
    """Principal components, where there are more than ``most`` dimensions and at least 10 points."""
    if x.shape[1] <= most or len(x) < 10:
        return x
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    k = min(most, len(x) - 1)
    return u[:, :k] * s[:k]


@dataclass
class EmbeddingClustering:
    """Clusters of the values of each field in numpy, a field a task; the most frequent value of a cluster is its name."""

    embeddings: EmbeddingClient
    algorithm: str = "agglomerative"
    similarity_threshold: float = 0.8
    min_cluster_size: int = 2
    reduce: bool = False

    def normalize(self, values: DataFrame, context_field: str = "") -> DataFrame:
        return self.normalize_fields(values.withColumn("field", F.lit(context_field)))

    def normalize_fields(self, values: DataFrame) -> DataFrame:
        """For ``values(field, value, ord)``; several fields are clustered side by side."""
        if self.algorithm not in ("agglomerative", "hdbscan"):
            raise NormalizationError(f"unknown algorithm {self.algorithm!r}")
        first = F.min("ord") if "ord" in values.columns else F.min(F.lit(0))
        freq = values.where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("freq"), first.alias("first_ord"))
        largest = freq.groupBy("field").count().agg(F.max("count")).first()[0] or 0
        if largest > LARGEST:
            raise NormalizationError(f"{largest} distinct values; hierarchical clustering takes {LARGEST}: resolve frequent ones by a dictionary first")
        vectors = embed_distinct(freq.select("value"), self.embeddings, "value")
        algorithm, cut, least, reduce = self.algorithm, 1 - self.similarity_threshold, self.min_cluster_size, self.reduce

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["first_ord", "value"], ignore_index=True)
            if len(pdf) == 1:
                pdf["label"] = -1
            else:
                x = np.asarray(pdf.embedding.tolist(), dtype=np.float64)
                x = reduce_dimensions(x) if reduce else x
                pdf["label"] = agglomerative(x, cut) if algorithm == "agglomerative" else hdbscan(x, least)
            return pdf[["field", "value", "freq", "first_ord", "label"]]

        labelled = freq.join(vectors, "value").groupBy("field").applyInPandas(run, "field string, value string, freq bigint, first_ord bigint, label int")
        w = Window.partitionBy("field", "label").orderBy(F.desc("freq"), "first_ord", "value")
        name = F.when(F.col("label") >= 0, F.first("value").over(w)).otherwise(F.col("value"))
        none = F.lit(None).cast("string")
        return labelled.select("field", F.col("value").alias("raw"), name.alias("canonical"), F.lit(None).cast("double").alias("confidence"), none.alias("ontology_id"), none.alias("explanation"), F.lit(self.algorithm).alias("strategy"), F.col("label").alias("cluster_id"))


@dataclass
class KLLMeansClustering:
    """k-means whose centroids are, every third round, replaced by the vectors of a model's summaries.

    Points stay distributed; a round is a join with ``k`` centroids and a grouped mean, and initial
    centres are drawn from all points. Where ``num_clusters`` isn't given it is chosen by the
    silhouettes of up to ``sample_values`` points, as these take the distances of all pairs.
    """

    embeddings: EmbeddingClient
    llm: LLMClient | None = None
    num_clusters: int | None = None
    max_iterations: int = 10
    summarize_every: int = 3
    seed: int = 42
    sample_values: int = 2000

    def normalize(self, values: DataFrame, context_field: str = "") -> DataFrame:
        spark = values.sparkSession
        freq = frequencies(values)
        few = [r.value for r in freq.orderBy("first_ord", "value").limit(3).collect()]
        if len(few) <= 2:
            return self._result(freq.select("value", F.col("value").alias("canonical"), F.lit(None).cast("int").alias("k")), context_field)
        points = freq.join(embed_distinct(freq, self.embeddings, "value"), "value").select(F.col("value").alias("id"), "freq", F.coalesce("first_ord", F.lit(0)).alias("first_ord"), doubles(F.col("embedding")).alias("v"))
        points = cut(points)
        k = min(self.num_clusters or self._choose_k(points), points.count())
        table = lambda c: spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(c)], "k int, c array<double>")
        centroids = table(draw_centres(points, k, self.seed))
        before = None
        for round_ in range(1, self.max_iterations + 1):
            assigned = assign(points, centroids)
            now = assigned.agg(F.sum(F.xxhash64("id", "k").cast("decimal(38,0)"))).first()[0]
            if round_ > 1 and now == before:
                break
            before = now
            new = {r.k: r.c for r in update(assigned, centroids).collect()}  # k rows
            if self.llm is not None and round_ % self.summarize_every == 0:
                for i, text in self._texts(assigned).items():
                    new[i] = [float(z) for z in self.embeddings.embed([self._say("Summarize in a few words", text, text[0])])[0]]
            centroids = table([new[i] for i in range(k)])
        final = assign(points, centroids)
        names = self._texts(final)
        named = [(i, (t[0] if len(t) == 1 or self.llm is None else self._say("Name the group", t, t[0]))) for i, t in names.items()]
        out = final.join(F.broadcast(spark.createDataFrame(named, "k int, canonical string")), "k").select(F.col("id").alias("value"), "canonical", "k")
        return self._result(out, context_field)

    def _choose_k(self, points: DataFrame) -> int:
        some = points.orderBy(F.xxhash64("id", F.lit(self.seed)), "id").limit(self.sample_values).select("v").toPandas()
        return auto_k(np.asarray(some.v.tolist(), dtype=np.float64), self.seed)

    def _texts(self, assigned: DataFrame, most: int = 20) -> dict[int, list[str]]:
        """The most frequent members of each cluster, for prompts."""
        w = Window.partitionBy("k").orderBy(F.desc("freq"), "first_ord", "id")
        rows = assigned.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).orderBy("k", "n").select("k", "id").collect()
        out: dict[int, list[str]] = {}
        for r in rows:
            out.setdefault(r.k, []).append(r.id)
        return out

    def _say(self, what: str, texts: list[str], otherwise: str) -> str:
        try:
            return self.llm.complete([{"role": "user", "content": f"{what}:\n" + "\n".join(f"- {t}" for t in texts)}]).content.strip() or otherwise
        except Exception:  # a model that fails must not lose the clusters
            return otherwise

    def _result(self, rows: DataFrame, context_field: str) -> DataFrame:
        none = F.lit(None).cast("string")
        return rows.select(F.lit(context_field).alias("field"), F.col("value").alias("raw"), "canonical", F.lit(None).cast("double").alias("confidence"), none.alias("ontology_id"), none.alias("explanation"), F.lit("kllmeans").alias("strategy"), F.col("k").alias("cluster_id"))

"""Best-fit packing of documents into fixed-size training sequences by a grouping genetic algorithm.

Documents are spread over blocks of about ``BLOCK`` by a hash; each block is a packing
problem that several islands evolve independently from different seeds. After an epoch
every island receives the elite of the next island of its block, and a second epoch follows;
the best individual of a block is its packing. A document longer than a sequence is cut into
full sequences and a rest, so all of its tokens are packed.

Crossover injects whole well-filled bins of one parent into the other, removes the bins that
then hold duplicates, and best-fits the documents that were displaced. Fitness is the number
of bins, then the mean squared fill: at the least number of bins, evolution goes on to gather
what room is left into few bins, and only ends early once all of it is in one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.shared import cut

CAPACITY = 2048
BLOCK = 4096
ISLANDS = 2
POPULATION = 4
GENERATIONS = 40
ELITE = 2
#: Problems that a task solves, one after the other.
PROBLEMS = 2


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, assign: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Put the items of ``order`` into the fullest bin with room, in place; returns the room of all bins."""
    free = sorted((int(r), b) for b, r in enumerate(room) if r >= 0)
    bins = list(room)
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        k = bisect_left(free, (s, -1))
        if k < len(free):
            r, b = free.pop(k)
        else:
            r, b = capacity, len(bins)
            bins.append(capacity)
        assign[i], bins[b] = b, r - s
        insort(free, (r - s, b))
    return np.asarray(bins, dtype=np.int64)


def _compact(assign: np.ndarray) -> np.ndarray:
    return np.unique(assign, return_inverse=True)[1].astype(np.int32)


def fitness(sizes: np.ndarray, assign: np.ndarray, capacity: int) -> tuple[int, float]:
    """Smaller is better."""
    fill = np.bincount(assign, weights=sizes)
    return len(fill), -float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``a`` with whole well-filled bins of ``b``."""
    fill = np.bincount(b, weights=sizes)
    good = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = np.zeros(len(fill), dtype=bool)
    chosen[rng.choice(good, size=max(1, len(good) // 4), replace=False)] = True
    injected = chosen[b]
    broken = np.zeros(int(a.max()) + 1, dtype=bool)
    broken[a[injected]] = True
    worst = np.argsort(np.bincount(a, weights=sizes), kind="stable")[: max(1, len(broken) // 50)]
    broken[worst] = True
    child = a.astype(np.int64)
    child[injected] = len(broken) + b[injected]
    loose = broken[a] & ~injected
    room = np.full(len(broken) + len(fill), -1, dtype=np.int64)
    held = np.bincount(child[~loose], minlength=len(room)), np.bincount(child[~loose], weights=sizes[~loose], minlength=len(room))
    room[held[0] > 0] = capacity - held[1][held[0] > 0].astype(np.int64)
    out = np.flatnonzero(loose)
    best_fit(sizes, out[np.argsort(-sizes[out], kind="stable")], capacity, child, room)
    return _compact(child)


def ideal(sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """The fitness that none can surpass: full bins, and one that holds the rest."""
    full, rest = divmod(int(sizes.sum()), capacity)
    bins = max(1, full + (rest > 0))
    return bins, -(full + (rest / capacity) ** 2) / bins


def evolve(sizes: np.ndarray, capacity: int, seed: int, start: list[np.ndarray], generations: int = GENERATIONS) -> list[np.ndarray]:
    """The best individuals, best first. ``start``: individuals to begin with."""
    rng = np.random.default_rng(seed)
    none = np.zeros(0, dtype=np.int64)

    def fresh(noise: float) -> np.ndarray:
        assign = np.zeros(len(sizes), dtype=np.int64)
        best_fit(sizes, np.argsort(-sizes * (1 + noise * rng.standard_normal(len(sizes))), kind="stable"), capacity, assign, none)
        return _compact(assign)

    goal = ideal(sizes, capacity)
    done = lambda f: f[0] <= goal[0] and f[1] <= goal[1] + 1e-12
    population = [*start] or [fresh(0.0)]
    scored = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    while len(scored) < POPULATION and not done(scored[0][0]):
        p = fresh(0.1 * len(scored))
        scored.append((fitness(sizes, p, capacity), len(scored), p))
    scored.sort(key=lambda x: x[:2])
    for g in range(generations):
        if done(scored[0][0]) or len(scored) < 2:
            break
        i, j = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[i][2], scored[j][2], sizes, capacity, rng)
        f = fitness(sizes, child, capacity)
        if f < scored[-1][0] and all(f != other for other, *_ in scored):  # an equal one adds nothing to the population
            scored[-1] = (f, 100 + g, child)
            scored.sort(key=lambda x: x[:2])
    return [p for _, _, p in scored[:ELITE]]


def _epoch(capacity: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, island = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                sizes = np.asarray(batch.column(2)[k].values, dtype=np.int64)
                start = [np.asarray(p.values, dtype=np.int32) for p in batch.column(3)[k]] if batch.column(3)[k].is_valid else []
                found = evolve(sizes, capacity, hash((block, island, epoch)) & 0x7FFFFFFF, start)
                bins, fill = fitness(sizes, found[0], capacity)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([island], pa.int32()), pa.array([bins], pa.int32()), pa.array([fill], pa.float64()), pa.array([[p.tolist() for p in found]], pa.list_(pa.list_(pa.int32())))],
                    ["block", "island", "bins", "fill", "plans"],
                )

    return run


_RESULT = "block bigint, island int, bins int, fill double, plans array<array<int>>"


def pack(
    docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, piece, tokens, bin)``: where each piece of each document goes; ``bin`` is a name.

    A document counts ``ceil(length / 4)`` tokens, cut into pieces of ``capacity`` and a rest.

    * null text and empty text: one piece of 0 tokens, in some bin;
    * null identifiers and repeated rows: packed like any other row; where rows of one identifier
      and length would overfill a block, its rows are spread over several by their place in the input;
    * ties: individuals of the same fitness by age, so the result follows from the input rows;
    * very long texts: cut into full sequences and a rest, no token is left out;
    * empty table: empty result; other columns are ignored.
    """
    items = (
        docs.select(F.col(id_col).alias("doc_id"), F.ceil(F.coalesce(F.length(text_col), F.lit(0)) / 4).cast("bigint").alias("n"))
        .withColumn("full", F.greatest(F.floor((F.col("n") - 1) / capacity), F.lit(0)).cast("int"))
        .withColumn("rest", (F.col("n") - F.col("full") * capacity).cast("int"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    items = cut(items)
    blocks = max(1, -(-items.count() // block))
    spread = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "n", F.lit("pack")), F.lit(blocks)))
    # Only repeated rows make a block much larger than the mean: such a block is several.
    crowded = spread.groupBy("block").agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * block)
    spread = spread.join(crowded, "block", "left").withColumn(
        "block", F.when(F.col("rows").isNull(), F.col("block")).otherwise(F.col("block") + blocks * (1 + F.pmod(F.xxhash64("row"), F.ceil(F.col("rows") / block))))
    )
    problems = cut(
        spread.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("rest", "doc_id", "full"))).alias("items"))
    )
    seeds = problems.select("block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.col("items.rest").alias("sizes"))
    # A given number of partitions isn't coalesced for their few bytes: the work in them is large.
    tasks = max(1, min(problems.count() * islands // PROBLEMS, 1 << 15))
    seeds = seeds.repartition(tasks, "block", "island")
    empty = F.lit(None).cast("array<array<int>>")
    first = cut(seeds.withColumn("start", empty).mapInArrow(_epoch(capacity, 1), _RESULT))
    ring = Window.partitionBy("block").orderBy("island")
    elite = F.coalesce(F.lead("plans").over(ring), F.first("plans").over(ring))
    moved = first.select("block", "island", F.concat("plans", F.slice(elite, 1, 1)).alias("start"))
    again = seeds.join(moved, ["block", "island"]).select("block", "island", "sizes", "start").repartition(tasks, "block", "island")
    second = again.mapInArrow(_epoch(capacity, 2), _RESULT)
    best = cut(second).groupBy("block").agg(F.min_by("plans", F.struct("bins", "fill", "island")).alias("plans"))
    rows = problems.join(best, "block").select("block", F.inline(F.arrays_zip("items", F.element_at("plans", 1).alias("plan"))))
    rows = rows.toDF("block", "item", "slot")
    rest = rows.select(
        F.col("item.doc_id").alias("doc_id"), F.col("item.full").alias("piece"), F.col("item.rest").alias("tokens"),
        F.concat_ws("-", F.lit("b"), "block", "slot").alias("bin"),
    )
    whole = items.where("full > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    # A bin of its own for each full piece; rows that repeat an identifier need different names.
    name = F.concat_ws("-", F.lit("f"), "doc_id", "piece", F.row_number().over(Window.partitionBy("doc_id", "piece").orderBy("piece")))
    return rest.unionByName(whole.select("doc_id", "piece", F.lit(capacity).alias("tokens"), name.alias("bin")))

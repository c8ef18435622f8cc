"""MinHash near-dedup with an LSH forest.

Signatures. A document's shingles are its runs of ``SHINGLE`` words (ASCII case folded; a
shorter document is one shingle). ``HASHES`` min-hashes of the shingle set are kept: a byte
of each as a sketch, and 16 mixed bits of each in ``TREES`` labels of ``DEPTH`` values.
Documents with the same shingle set are one entry from here on.

Forest. For every tree the entries are sorted by label and then by the sketch (turned so that
it begins with the next tree's bytes), so that entries with long common prefixes are
neighbours. A region is a run with the same first value; a region of more than ``CROWD``
entries is split at the next value, and so on, so depth adapts to how dense a region is, from
one value to the whole signature. All pairs in a region of up to ``CROWD`` entries are
candidates, and so are each entry and its ``NEIGHBOURS`` nearest in the order that share the
first value. Two documents of similarity s share the first value of a tree with probability s.

Verification. The sketches give an unbiased estimate of the Jaccard similarity; pairs of at
least ``threshold`` are linked. Links only matter up to connectivity, so pairs that are
connected already are skipped, and a spanning forest leaves the task: a region of thousands
of near copies costs a few comparisons an entry rather than all pairs.

Spread. The orders are range-partitioned by their whole key, so that a region of any size is
spread evenly, and a task goes through its part in lots. What spans two lots or two parts is
seen whole in a lot of its own, of the last and the first ``EDGE`` entries: a region of up
to ``CROWD`` entries, and neighbours, always fit in there. So candidates don't depend on
where lots and parts begin.

Groups are the connected components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.shared import connected_components, cut, fresh, setting
from fieldloom.llm.textbytes import mix, slices, words

SHINGLE = 3
HASHES = 128
TREES = 16
DEPTH = HASHES // TREES
CROWD = 512
NEIGHBOURS = 16
THRESHOLD = 0.5
#: Entries that a task holds at a time, and how many of them the next lot repeats.
HELD = 1 << 16
EDGE = CROWD + 1
#: Parts of the orders: of about so many entries, up to so many parts.
PART_ROWS, PARTS = 1 << 16, 1 << 14
#: Keys a part that the driver sees to choose where parts begin: they are long, and parts needn't be of one size.
SPLITTER_SAMPLE = 20

_rng = np.random.default_rng(7)
_MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
#: Minima are small numbers; times this, their upper bits are spread evenly.
_SPREAD = np.uint32(0x9E3779B1)


def shingle_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in the order of rows, and the bounds of each row's shingles."""
    _, _, row, h = words(data, offs)
    n = np.bincount(row, minlength=len(offs) - 1)
    at = np.concatenate([[0], np.cumsum(n)])
    g = h.copy()
    for k in range(1, min(SHINGLE, len(h))):
        nxt = np.zeros_like(h)
        nxt[:-k] = h[k:]
        inside = np.zeros(len(h), dtype=bool)
        inside[:-k] = row[k:] == row[:-k]
        g = np.where(inside, mix(g * np.uint64(31) + nxt), g)
    ordinal = np.arange(len(h)) - at[row]
    keep = ordinal < np.maximum(1, n[row] - (SHINGLE - 1))
    return g[keep], np.concatenate([[0], np.cumsum(np.where(n > 0, np.maximum(1, n - (SHINGLE - 1)), 0))])


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """``HASHES`` 32-bit minima over a document's shingle hashes."""
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(x), 512):
        y = x[None, a : a + 512] * _MULTIPLY + _ADD
        y ^= y >> np.uint32(15)
        np.minimum(low, y.min(axis=1), out=low)
    return low


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column(1)):
            shingles, at = shingle_hashes(data, offs)
            sets, sketches, labels = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if a == b:
                    sets.append(None), sketches.append(None), labels.append(None)
                    continue
                own = np.unique(shingles[a:b])
                m = min_hashes(own)
                with np.errstate(over="ignore"):
                    sets.append(np.array([own.sum(), mix(own).sum(), len(own)], dtype=np.uint64).tobytes())
                sketches.append((m & 0xFF).astype(np.uint8).tobytes())
                labels.append((m * _SPREAD >> np.uint32(16)).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], pa.array(sets, pa.binary()), pa.array(sketches, pa.binary()), pa.array(labels, pa.binary())],
                ["doc_id", "set_key", "sketch", "labels"],
            )


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of sketches (chance agreement of single bytes taken out)."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def shared_values(key: np.ndarray) -> np.ndarray:
    """How many of the first values (columns) each row shares with the row before; 0 for the first row."""
    out = np.zeros(len(key), dtype=np.int64)
    for a in range(0, len(key) - 1, 1 << 14):
        other = key[a : a + (1 << 14) + 1]
        differs = other[1:] != other[:-1]
        out[a + 1 : a + 1 + len(differs)] = np.where(differs.any(axis=1), differs.argmax(axis=1), key.shape[1])
    return out


def _ends(first: np.ndarray) -> np.ndarray:
    """For each row the end of its run; ``first`` marks the rows that begin one."""
    begin = np.flatnonzero(first)
    return np.repeat(np.append(begin[1:], len(first)), np.diff(np.append(begin, len(first))))


def regions(shared: np.ndarray, values: int, open_start: bool, open_end: bool) -> np.ndarray:
    """For each row the end of its region of at most ``CROWD`` rows, or its own place: it has none.

    Depth grows from one value to all. Where an end is open, the runs of at most ``CROWD`` rows that touch
    it have no region: another lot sees them whole.
    """
    n = len(shared)
    end, left = np.arange(n), np.arange(n)
    for depth in range(1, values + 1):
        if not len(left):
            break
        # Rows left at this depth come as whole runs of the depth before.
        first = np.append(True, (shared[left[1:]] < depth) | (left[1:] != left[:-1] + 1))
        stop = _ends(first)
        begin = np.flatnonzero(first)[np.cumsum(first) - 1]
        small = stop - begin <= CROWD
        whole = small.copy()
        if open_start:
            whole &= left[begin] > 0
        if open_end:
            whole &= left[stop - 1] < n - 1
        end[left[whole]] = left[stop[whole] - 1] + 1
        left = left[~small]
    return end


def lot_links(key: np.ndarray, sketch: np.ndarray, threshold: float, open_start: bool = False, open_end: bool = False) -> list[tuple[int, int]]:
    """A spanning forest of the links of a lot, in the order of ``key`` (tree, label and sketch); pairs of places."""
    n = len(key)
    least = (threshold * (1 - 1 / 256) + 1 / 256) * HASHES
    shared = np.maximum(shared_values(key) - 1, -1)  # not the tree's number
    shared[:1] = -1
    near, deep = _ends(shared < 1), regions(shared, key.shape[1] - 1, open_start, open_end)
    part, links = np.arange(n), []
    for s in range(1, n):
        reach = np.maximum(near, deep) if s <= NEIGHBOURS else deep
        at = np.flatnonzero(reach[: n - s] > np.arange(s, n))
        if not len(at) and s >= NEIGHBOURS:
            break
        at = at[part[at] != part[at + s]]
        joins: dict[int, int] = {}

        def root(i: int) -> int:
            while i in joins:
                i = joins[i]
            return i

        for a in range(0, len(at), 1 << 14):
            some = at[a : a + (1 << 14)]
            for i in some[(sketch[some] == sketch[some + s]).sum(axis=1) >= least].tolist():
                u, v = root(int(part[i])), root(int(part[i + s]))
                if u != v:
                    joins[max(u, v)] = min(u, v)
                    links.append((i, i + s))
        if joins:
            new = np.arange(n)
            for i in joins:
                new[i] = root(i)
            part = new[part]
    return links


_ENTRY = "tree int, rep bigint, label binary, sketch binary"
_FOUND = f"u bigint, v bigint, seam int, held bigint, {_ENTRY}"


def _entries(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Identifiers and keys (tree, values of the label, bytes of the sketch) of a batch of entries."""
    n = batch.num_rows
    tree = np.asarray(batch.column(0), dtype=np.uint16)[:, None]
    label = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=">u2").reshape(n, DEPTH).astype(np.uint16)
    sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(n, HASHES)
    return [np.asarray(batch.column(1), dtype=np.int64), np.concatenate([tree, label, sketch], axis=1)]


def _sketch(key: np.ndarray) -> np.ndarray:
    return key[:, 1 + DEPTH :].astype(np.uint8)


def _rows(links: list[tuple[int, int]], ids: np.ndarray) -> tuple[list[int], list[int]]:
    return [int(ids[i]) for i, _ in links], [int(ids[j]) for _, j in links]


def _found(**columns) -> pa.RecordBatch:
    """A batch with these columns, the others null."""
    schema = [("u", pa.int64()), ("v", pa.int64()), ("seam", pa.int32()), ("held", pa.int64()), ("tree", pa.int32()), ("rep", pa.int64()), ("label", pa.binary()), ("sketch", pa.binary())]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), k) for c, k in schema], [c for c, _ in schema])


def _link(threshold: float, parts: int):
    """Links within a part of the orders; of its edges also the entries, under the number of the seam they lie at, and the number of entries."""

    def edge(key: np.ndarray, ids: np.ndarray, seam: int) -> pa.RecordBatch:
        return _found(
            rep=ids.tolist(), seam=[seam] * len(ids), tree=key[:, 0].tolist(),
            label=[x.tobytes() for x in key[:, 1 : 1 + DEPTH].astype(">u2")], sketch=[x.tobytes() for x in _sketch(key)],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids, key = np.zeros(0, np.int64), np.zeros((0, 1 + DEPTH + HASHES), np.uint16)
        seen, begun = 0, part > 0
        waiting: list[list[np.ndarray]] = []

        def lot(last: bool) -> pa.RecordBatch:
            u, v = _rows(lot_links(key, _sketch(key), threshold, begun, not last or part < parts - 1), ids)
            return _found(u=u, v=v)

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(_entries(batch))
            if seen < EDGE and part > 0:  # the first entries of the part
                yield edge(waiting[-1][1][: EDGE - seen], waiting[-1][0][: EDGE - seen], part - 1)
            seen += batch.num_rows
            if len(ids) + sum(len(w[0]) for w in waiting) > HELD:
                ids, key = (np.concatenate([old, *[w[k] for w in waiting]]) for k, old in enumerate((ids, key)))
                waiting = []
                yield lot(False)
                ids, key, begun = ids[-EDGE:], key[-EDGE:], True
        ids, key = (np.concatenate([old, *[w[k] for w in waiting]]) for k, old in enumerate((ids, key)))
        yield lot(True)
        if part < parts - 1:
            yield edge(key[-EDGE:], ids[-EDGE:], part)
        yield _found(held=[seen])

    return run


def _seams(threshold: float):
    """Links across the seams between parts: a lot for each, of entries that come by seam and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def lots(upto: np.ndarray) -> Iterator[pa.RecordBatch]:
            seam, ids, key = held
            for a, b in zip(upto[:-1], upto[1:]):
                u, v = _rows(lot_links(key[a:b], _sketch(key[a:b]), threshold, True, True), ids[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(batch.column(4), dtype=np.int64), *_entries(batch)]
            held = [np.concatenate(x) for x in zip(held, now)] if held else now
            change = np.flatnonzero(np.diff(held[0])) + 1
            if len(change):
                yield from lots(np.append(0, change))
                held = [x[change[-1] :] for x in held]
        if held:
            yield from lots(np.array([0, len(held[0])]))

    return run


def forest_links(entries: DataFrame, threshold: float) -> DataFrame:
    """``(u, v)``: links that connect all similar candidates of ``entries(rep, labels, sketch)``, as a checkpointed table."""
    width = 2 * DEPTH
    turned = f"concat(substring(sketch, (tree + 1) * {DEPTH} + 1), substring(sketch, 1, (tree + 1) * {DEPTH}))"
    trees = entries.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "rep", "labels", "sketch").select(
        "tree", "rep", F.expr(f"substring(labels, tree * {width} + 1, {width})").alias("label"), F.expr(turned).alias("sketch")
    )
    order = ["tree", "label", "sketch", "rep"]
    parts = max(1, min(entries.count() * TREES // PART_ROWS, PARTS))
    while True:
        with setting(entries.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition", str(SPLITTER_SAMPLE)):
            forest = trees.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            found = cut(forest.mapInArrow(_link(threshold, parts), _FOUND))
        # A part that is shorter than an edge would hide what lies behind it.
        if parts == 1 or (found.where("held IS NOT NULL").agg(F.min("held")).first()[0] or 0) >= EDGE:
            break
        parts //= 2
    links = found.where("u IS NOT NULL").select("u", "v")
    if parts > 1:
        edges = found.where("seam IS NOT NULL").select("tree", "rep", "label", "sketch", "seam")
        lots = edges.repartition(max(1, parts // 16), "seam").sortWithinPartitions("seam", *order)
        links = links.union(lots.mapInArrow(_seams(threshold), "u bigint, v bigint"))
    return links


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, group_id, is_kept)``, a row for each identifier; identifiers are integers, others are a ``TypeError``.

    ``group_id`` is the least identifier of the group of near duplicates, which is the one
    that is kept; a document without near duplicates is a group of its own.

    * null, empty and wordless texts: never near duplicates, groups of their own;
    * null identifiers: they can't be linked, so they have no row;
    * repeated identifiers: one row; rows with the same identifier count as linked;
    * texts with the same shingles are one group; ties don't arise, identifiers differ;
    * very long texts: all of their shingles count;
    * empty table: empty result; other columns are ignored.
    """
    _check(docs, id_col)
    df = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    signed = cut(df.mapInArrow(_sign, "doc_id bigint, set_key binary, sketch binary, labels binary"))
    entries = cut(
        signed.where("set_key IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("labels").alias("labels"))
    )
    # Copies follow their entry and take no part in the search for components, so a set of thousands is no hot node.
    member = signed.where("set_key IS NOT NULL").select("doc_id", "set_key").join(entries.select("set_key", "rep"), "set_key").select("doc_id", "rep")
    own = member.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    several = own.where("rep < other").select("doc_id", F.col("rep").alias("u"))  # identifiers that repeat with other texts
    same = member.join(several, "doc_id").select("u", F.col("rep").alias("v"))
    groups = connected_components(forest_links(entries, threshold).union(same))
    placed = own.join(groups, own.rep == groups.node, "left").select("doc_id", F.coalesce("root", "rep").alias("group"))
    everyone = signed.select("doc_id").distinct().join(placed, "doc_id", "left")
    return everyone.select("doc_id", F.coalesce("group", "doc_id").alias("group_id"), F.coalesce(F.col("group") == F.col("doc_id"), F.lit(True)).alias("is_kept"))


def _check(docs: DataFrame, id_col: str) -> None:
    kind = docs.select(id_col).schema[0].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"identifiers must be integers; {id_col} is {kind.simpleString()}")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but those of documents that aren't kept, with all columns.

    Rows with a null identifier stay, and so do all rows of a kept identifier that repeats and rows
    whose text is null, empty or wordless; extra columns of any name pass as they are.
    """
    name = fresh(docs, "gone")
    gone = near_duplicates(docs, threshold, id_col, text_col).where("NOT is_kept").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col(id_col).cast("bigint") == F.col(name), "left_anti")

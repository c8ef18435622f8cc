"""Document fingerprints: digests of improbable features.

Every window of ``WINDOW`` bytes of a text has an entropy, in thousandths of its maximum. A
first pass over the whole corpus counts how often each entropy occurs; the rarer it is, the
lower its rank. In each run of ``FRAME`` successive windows the lowest rank (the leftmost on
ties) gets a point, and windows with ``POINTS`` points or more are the text's features;
windows of very low entropy (runs of a few bytes) never are. Feature hashes go into a chain of
Bloom filters of ``BITS`` bits, ``PART`` features each. Two digests are compared by the bits
that each filter of the shorter one shares with a run of ``JOINED`` successive filters of the
longer one, less what chance would give, over the filter's bits. A copied passage's filter
has at most ``PART`` features (and a few more beside the passage's ends), so wherever
it lies in the longer text one of the runs holds it whole.

Entropies slide: a window's sum of c*log2(c) over its byte counts changes by what enters and
what leaves, and how often a byte occurs in the bytes of a window before or after it is the
number of equal bytes at distances below ``WINDOW``, computed for all positions at once and shared by both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import cut
from fieldloom.llm.textbytes import slices, span_hash

WINDOW = 32
FRAME = 16
POINTS = 3
BITS = 2048
HASHES = 5
PER_FILTER = 160
#: Filters are laid in parts, so that those compared as one, of PER_FILTER features at most, overlap.
JOINED = 3
PART = PER_FILTER // JOINED
LOWEST = 100
LEVELS = 1001
#: Reference digests that one pass compares with; more take several passes.
REFERENCE_BYTES = 8 << 20
#: Filters of two sides that are compared at a time.
TILE = (64, 4096)
#: A digest of fewer features is not told from chance: a full filter has a third of its bits set,
#: so one feature is found in it by chance once in 240 times, three once in 10**7.
LEAST_FEATURES = 3
#: Least overlap of a match: a copied passage has 1, or a little less beside its ends.
MATCH = 0.9

_SCALE = 1 << 16
_C = np.arange(WINDOW + 1, dtype=np.float64)
_SUM = np.rint(_C * np.log2(np.maximum(_C, 1)) * _SCALE).astype(np.int64)
_GAIN = np.diff(_SUM).astype(np.int32)
_SUM = _SUM.astype(np.int32)


def entropies(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, the level of the window that begins there, and whether that window lies within its text."""
    n = len(data)
    level, whole = np.zeros(n, dtype=np.int16), np.zeros(n, dtype=bool)
    if n < WINDOW:
        return level, whole
    length = np.diff(offs)
    place = np.arange(n, dtype=np.int64)
    place -= np.repeat(offs[:-1], length)
    near = np.minimum(place, 255).astype(np.uint8)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):
        same = ((data[k:] == data[:-k]) & (near[k:] >= k)).view(np.uint8)
        back[k:] += same
        ahead[:-k] += same
    # Running sums may wrap; the differences taken below fit 32 bits.
    enters, leaves = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    np.cumsum(_GAIN[back], out=enters[1:])
    np.cumsum(_GAIN[ahead], out=leaves[1:])
    m = n - WINDOW + 1
    total = enters[WINDOW:] - leaves[:m] - np.repeat(enters[offs[:-1]] - leaves[offs[:-1]], length)[:m]
    whole[:m] = np.arange(m) + WINDOW <= np.repeat(offs[1:], length)[:m]
    level[:m] = np.where(whole[:m], np.rint((_SUM[WINDOW] - total) * np.float64((LEVELS - 1) / _SUM[WINDOW])), 0)
    return level, whole


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each level, 0 the rarest; levels below ``LOWEST`` and those that don't occur come last."""
    order = np.lexsort((np.arange(LEVELS), counts))
    order = order[(counts[order] > 0) & (order >= LOWEST)]
    out = np.full(LEVELS, 1023, dtype=np.int64)
    out[order] = np.arange(len(order))
    return out


def feature_hashes(data: np.ndarray, offs: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the selected windows in the order of texts and places, and each one's row."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    level, whole = entropies(data, offs)
    wide = np.uint32 if n <= 1 << 22 else np.uint64
    shift = wide(22 if wide is np.uint32 else 40)
    own = np.where(whole, rank[level], 1023)
    key = (own.astype(wide) << shift) | np.arange(n, dtype=wide)
    low = key
    for s in (1 << k for k in range(FRAME.bit_length() - 1)):  # FRAME is a power of two
        low = np.minimum(low[:-s], low[s:]) if len(low) > s else low[:0]
    length = np.diff(offs)
    room = np.repeat(offs[1:], length)[: len(low)] - np.arange(len(low)) >= FRAME - 1 + WINDOW
    points = np.bincount((low[room] & ((wide(1) << shift) - wide(1))).astype(np.int64), minlength=n)
    chosen = points >= POINTS
    for r in np.flatnonzero((length >= WINDOW) & (length < FRAME - 1 + WINDOW)):
        a, b = int(offs[r]), int(offs[r + 1]) - WINDOW + 1
        chosen[a + int(np.argmin(key[a:b]))] = True
    at = np.flatnonzero(chosen & (own < 1023))
    return span_hash(data, at, at + WINDOW), np.searchsorted(offs, at, side="right") - 1


def chain(hashes: np.ndarray) -> tuple[int, bytes]:
    """How many distinct features there are, and the filters that all of them fill, in the order given.

    A feature that occurs again is in the filter of each place: a passage is whole where it lies.
    """
    h = hashes
    if not len(h):
        return 0, b""
    filters = -(-len(h) // PART)
    bits = np.zeros(filters * BITS, dtype=np.uint8)
    base = np.arange(len(h)) // PART * BITS
    for k in range(HASHES):
        bits[base + ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return len(np.unique(h)), np.packbits(bits).tobytes()


def _filters(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All filters as rows of 64-bit words, and the bounds of each digest's."""
    n = np.array([len(d) // (BITS // 8) for d in digests], dtype=np.int64)
    return np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, BITS // 64), np.concatenate([[0], np.cumsum(n)])


def _joined(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unions of each ``JOINED`` successive filters of a digest (of all, if it has fewer), and the bounds of each digest's."""
    end = np.repeat(at[1:], np.diff(at))
    first = np.repeat(at[:-1], np.diff(at))
    row = np.arange(len(x))
    out = x.copy()
    for k in range(1, JOINED):
        fits = row[row + k < end]
        out[fits] |= x[fits + k]
    keep = (row + JOINED <= end) | (row == first)
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share, from 0 (chance) to 1, of the bits of each filter in ``a`` that each in ``b`` has too."""
    na, nb = np.bitwise_count(a).sum(axis=1, dtype=np.int64)[:, None], np.bitwise_count(b).sum(axis=1, dtype=np.int64)[None, :]
    both = np.zeros((len(a), len(b)), dtype=np.uint16)
    for w in range(a.shape[1]):
        both += np.bitwise_count(a[:, w, None] & b[None, :, w])
    chance = na * nb / BITS
    return np.clip((both - chance) / np.maximum(na - chance, 1e-9), 0.0, 1.0)


def _held(x: np.ndarray, ax: np.ndarray, y: np.ndarray, ay: np.ndarray) -> np.ndarray:
    """For each digest of ``x`` and each of ``y``, the mean over the former's bits of its filters' best overlap with the latter.

    ``TILE`` filters of either side are compared at a time, however many a digest has.
    """
    u, au = _joined(y, ay)
    bits = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    owner, held_by = np.repeat(np.arange(len(ax) - 1), np.diff(ax)), np.repeat(np.arange(len(au) - 1), np.diff(au))
    total = np.zeros((len(ax) - 1, len(au) - 1))
    for a in range(0, len(x), TILE[0]):
        own, best = owner[a : a + TILE[0]], np.zeros((min(TILE[0], len(x) - a), len(au) - 1))
        for c in range(0, len(u), TILE[1]):
            by = held_by[c : c + TILE[1]]
            first = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
            some = np.maximum.reduceat(overlaps(x[a : a + TILE[0]], u[c : c + TILE[1]]), first, axis=1)
            best[:, by[first]] = np.maximum(best[:, by[first]], some)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        total[own[first]] += np.add.reduceat(best * bits[a : a + TILE[0], None], first, axis=0)
    return total / np.add.reduceat(bits, ax[:-1])[:, None]


def scores(digests: list[bytes], reference: list[bytes]) -> np.ndarray:
    """How much of the shorter of each digest and each reference digest is found in the other; all have features."""
    x, ax = _filters(digests)
    y, ay = _filters(reference)
    nx, ny = (np.add.reduceat(np.bitwise_count(f).sum(axis=1, dtype=np.int64), at[:-1]) for f, at in ((x, ax), (y, ay)))
    return np.where(nx[:, None] <= ny[None, :], _held(x, ax, y, ay), _held(y, ay, x, ax).T)


def compare(a: bytes, b: bytes) -> float | None:
    """The score of two digests; None without features."""
    return float(scores([a], [b])[0, 0]) if a and b else None


def matches(digests: list[bytes], reference: list[bytes], least: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each digest with features, the place of the reference digest most like it (the first on ties), their score, and the places of all whose score is at least ``least``; -1 otherwise."""
    place, score, every = np.full(len(digests), -1), np.zeros(len(digests)), [np.zeros(0, np.int64)] * len(digests)
    have, ref = [k for k, d in enumerate(digests) if d], [k for k, d in enumerate(reference) if d]
    if not have or not ref:
        return place, score, every
    both = scores([digests[k] for k in have], [reference[k] for k in ref])
    best = both.argmax(axis=1)
    place[have], score[have] = np.array(ref)[best], both[np.arange(len(have)), best]
    for k, s in zip(have, both):
        every[k] = np.array(ref)[s >= least]
    return place, score, every


def level_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each entropy level occurs over all windows of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS, dtype=np.int64)
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0)):
                if len(data):
                    level, whole = entropies(data, offs)
                    counts += np.bincount(level[whole], minlength=LEVELS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], ["level", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n"))
    out = np.zeros(LEVELS, dtype=np.int64)
    for r in sums.collect():  # at most LEVELS rows
        out[r.level] = r.n
    return out


def fingerprint(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_features, digest)``, a row for each row of ``docs``.

    * null texts, and texts of fewer than ``WINDOW`` bytes: no features, an empty digest;
    * null identifiers and repeated rows pass as they are; equal texts have equal digests;
    * texts are read whole, however long; empty table: empty result; other columns are ignored.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                h, row = feature_hashes(data, offs, rank)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                made = [chain(h[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())],
                    ["doc_id", "n_features", "digest"],
                )

    return df.mapInArrow(run, f"doc_id {kind}, n_features int, digest binary")


def match(digests: DataFrame, reference: DataFrame, least: float = MATCH) -> DataFrame:
    """``digests`` with ``overlap``, that with the most similar row of ``reference(item_id, n_features, digest)``, and ``nearest``, that row's identifier if the overlap is at least ``least``; ``matches`` has the identifiers of all rows whose overlap is, ascending.

    Rows of either side with fewer than ``LEAST_FEATURES`` features aren't compared: their
    ``nearest``, ``overlap`` and ``matches`` are null, as they are if the reference has no other rows or
    ``digests`` comes of null or empty texts. Rows with a null identifier and repeated rows of ``digests``
    pass as they are; those of the reference with a null one aren't compared. Digests of very long texts
    are compared in tiles; an empty table gives an empty result; other columns must not be there. Ties
    go to the least identifier; repeated identifiers are one in ``matches``. The reference is held in memory in parts of ``REFERENCE_BYTES``: if it is
    larger, each part is a pass of its own over the digests and the best of all parts counts.
    """
    held = cut(reference.where(f"item_id IS NOT NULL AND n_features >= {LEAST_FEATURES}").select(F.col("item_id").cast("bigint"), "digest"))
    total = held.agg(F.sum(F.length("digest"))).first()[0] or 0
    parts = max(1, -(-total // REFERENCE_BYTES))
    kind = digests.schema["doc_id"].dataType.simpleString()
    if parts > 1:
        digests = cut(digests.withColumn("__row", F.monotonically_increasing_id()))

    def one(part: int) -> DataFrame:
        mine = held.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else held
        rows = mine.orderBy("item_id").collect()  # about REFERENCE_BYTES
        items, known = [r.item_id for r in rows], [bytes(r.digest) for r in rows]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    some = batch.slice(lo, 64)
                    own = [d if n >= LEAST_FEATURES else b"" for n, d in zip(some.column(1).to_pylist(), some.column(2).to_pylist())]
                    place, score, every = matches(own, known, least)
                    near = pa.array([items[p] if p >= 0 and x >= least else None for p, x in zip(place, score)], pa.int64())
                    found = pa.array([sorted({items[q] for q in qs}) if p >= 0 else None for p, qs in zip(place, every)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*some.columns, near, pa.array(np.where(place < 0, np.nan, score), from_pandas=True), found], [*some.schema.names, "nearest", "overlap", "matches"])

        extra = ", __row bigint" if parts > 1 else ""
        return digests.mapInArrow(run, f"doc_id {kind}, n_features int, digest binary{extra}, nearest bigint, overlap double, matches array<bigint>")

    if parts == 1:
        return one(0)
    every = one(0)
    for p in range(1, parts):
        every = every.unionByName(one(p))
    best = F.max_by(F.struct("doc_id", "n_features", "digest", "nearest", "overlap"), F.struct(F.coalesce("overlap", F.lit(-1.0)), F.coalesce(-F.col("nearest"), F.lit(-(1 << 62)))))
    found = F.array_sort(F.flatten(F.collect_list("matches")))  # no identifier is in two parts
    return every.groupBy("__row").agg(best.alias("b"), found.alias("m")).select("b.*", F.when(F.col("b.overlap").isNotNull(), F.col("m")).alias("matches"))

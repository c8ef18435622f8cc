"""Whole Arrow text columns as byte arrays: slices, words, word hashes.

All passes are vectorised over the concatenated UTF-8 of many documents. Memory follows
``SLICE`` (or the longest single document), never the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV_R = np.uint64(pow(int(_R), -1, 1 << 64))
_C1, _C2, _C3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x2545F4914F6CDD1D)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def slices(column: pa.Array, limit: int = SLICE, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(lo, hi, bytes, offsets)`` for runs of up to ``rows`` rows of about ``limit`` bytes; nulls count as empty."""
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, off, buf = column.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, lo + rows, len(column))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            size = max(n, 1 << 16)
            for name, r in (("_pow", _R), ("_inv", _INV_R)):
                a = np.full(size, r, dtype=np.uint64)
                a[0] = 1
                globals()[name] = np.multiply.accumulate(a)
    return _pow, _inv


def span_hash(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> np.ndarray | list[np.ndarray]:
    """64-bit content hashes of ``data[starts:ends]``; starts ascend. With several ``ends``, a list."""
    out = [np.zeros(len(starts), dtype=np.uint64) for _ in ends]
    cuts = np.searchsorted(starts, np.arange(0, int(starts[-1]) + SLICE, SLICE)) if len(starts) else []
    for a, b in zip(cuts, [*cuts[1:], len(starts)]):
        if a == b:
            continue
        base, top = int(starts[a]), max(int(e[a:b].max()) for e in ends)
        power, inverse = _powers(top - base + 1)
        total = np.zeros(top - base + 1, dtype=np.uint64)
        np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * power[: top - base], out=total[1:])
        s = starts[a:b] - base
        before, back = total[s], inverse[s]
        for h, end in zip(out, ends):
            e = end[a:b] - base
            h[a:b] = mix((total[e] - before) * back + (e - s).astype(np.uint64) * _C3)
    return out[0] if len(ends) == 1 else out


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word: a run of ASCII letters, digits and non-ASCII bytes."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    is_word = WORD[data]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = is_word[:-1], is_word[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_spans`` and the hash of each word with ASCII case folded."""
    starts, ends, row = word_spans(data, offs)
    return starts, ends, row, span_hash(FOLD[data], starts, ends)


def text_hash(text: str) -> int:
    """The hash that ``words`` gives a single word."""
    data = FOLD[np.frombuffer(text.encode(), dtype=np.uint8)]
    return int(span_hash(data, np.array([0]), np.array([len(data)]))[0])

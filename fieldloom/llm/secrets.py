"""Secret scans: a character convolutional network over every candidate and its context.

Candidates are all runs of at least ``SHORTEST`` of the characters that keys are written in,
and, of any length and characters, every value behind ``=`` or ``:`` (assignments, headers,
the password of a URL) or behind a word for credentials; quoted values go to the quote, others
to the next blank or quote. Each is seen with ``BEFORE`` bytes of context before and ``AFTER``
behind it; a run of more than ``PIECE`` bytes is seen in pieces, and its score is the highest
of its pieces. Long values within values are candidates by parts (``_values``), but are
reported whole (``Scanner.find``). The network looks bytes up in a small alphabet (with a flag
for bytes of the candidate itself), convolves them, takes the maximum and the mean over
positions, and ends in a dense layer. It is trained in numpy on labelled findings; a second part of them
calibrates the scores (isotonic), and a third sets the threshold: that of the best F2 among
those that find ``RECALL`` of the secrets; a secret that no candidate holds is a miss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import findings
from fieldloom.llm.textbytes import slices
from fieldloom.llm.trees import isotonic

SHORTEST = 12
BEFORE, PIECE, AFTER = 28, 56, 12
SPAN = BEFORE + PIECE + AFTER
WIDTH, FILTERS = 5, 24
EXAMPLES = 30_000
RECALL = 0.995

_KEY = np.zeros(256, dtype=bool)
_KEY[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.=~:@%"]] = True
#: What stands before a value, and the value (of one without quotes the first byte): only the former is consumed, so that values within values are found too.
_VALUE = re.compile(
    rb"""(?:[:=]>?[ \t]*|(?i:passw(?:or)?d|passphrase|secret(?:_key)?|token|api_?key|private_key|access_key|credentials?|authorization|bearer|basic)["']?[ \t]+)"""
    rb"""(?:"(?=([^"\n]+)")|'(?=([^'\n]+)')|["']?(?=([^\s:="'])))"""
)
_STOP = re.compile(rb"""[\s"']""")
#: The first so many bytes of a value within another one are a candidate; how its other bytes are seen, ``_values`` says. The outer one is one whole.
NESTED = 256

#: Bytes to classes: lower-case letters by letter, capitals and digits by a few groups, signs by sign.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = 27
_CLASS[list(b"AEIOU")] = 28
_CLASS[48:58] = 29
_CLASS[128:] = 30
for _k, _ch in enumerate(b"=:\"'-_/.+@ \n,#;({<$"):
    _CLASS[_ch] = 31 + _k
CLASSES = 31 + _k + 1
_PAD = 2 * CLASSES
_TABLE = 2 * CLASSES + 1


def _values(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the values as they are seen, and where they really end.

    A value within another one that has more than ``NESTED`` bytes is seen that far, and once
    more to the next value that ends where it does, which holds the bytes from there on, or,
    behind the last such value, to its end: all bytes are seen, in room linear in the text.
    """
    text, found, upto = data.tobytes(), [], 0
    inner = np.flatnonzero(np.diff(offs))
    for row in inner:
        lo, hi = int(offs[row]), int(offs[row + 1])
        stop = lo
        for m in _VALUE.finditer(text, lo, hi):
            a, whole = m.span(m.lastindex)
            if m.lastindex == 3:
                if stop <= a:
                    stop = end.start() if (end := _STOP.search(text, a, hi)) else hi
                whole = stop
            b = whole
            if a < upto and b - a > NESTED:
                b = a + NESTED
                while text[b] & 0xC0 == 0x80:
                    b -= 1
            upto = max(upto, b)
            found.append((a, b, whole))
    at = np.array(found, dtype=np.int64).reshape(-1, 3)
    a, b, whole = at[np.lexsort((at[:, 0], at[:, 2]))].T
    until = np.where(np.append(whole[1:] == whole[:-1], np.zeros(min(1, len(a)), bool)), np.append(a[1:], a[:1]), whole)
    more = until > b
    return np.concatenate([a, a[more]]), np.concatenate([b, until[more]]), np.concatenate([whole, whole[more]])


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all candidates of some texts, by start and end, and where the value that each begins really ends."""
    n = len(data)
    empty = np.zeros(0, dtype=np.int64)
    if not n:
        return empty, empty, empty, empty
    key = _KEY[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = key[:-1], key[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(key & ~before), np.flatnonzero(key & ~after) + 1
    long = ends - starts >= SHORTEST
    a, b, whole = _values(data, offs)
    every = np.unique(np.stack([np.concatenate([starts[long], a]), np.concatenate([ends[long], b]), np.concatenate([ends[long], whole])], axis=1), axis=0)
    last = np.append((every[1:, :2] != every[:-1, :2]).any(axis=1), np.ones(min(1, len(every)), bool))
    starts, ends, whole = every[last].T
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1, whole


def candidates(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all candidates of some texts, by start and end."""
    return spans(data, offs)[:3]


def narrowest(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of some spans, ascending by start and end, hold no other one: of findings within findings the inner ones."""
    keep = np.ones(len(starts), dtype=bool)
    least = np.iinfo(np.int64).max
    for k in range(len(starts) - 1, -1, -1):
        keep[k] = ends[k] < least
        least = min(least, int(ends[k]))
    for k in range(1, len(starts)):
        if starts[k] == starts[k - 1]:
            keep[k] = False
    return keep


def next_within(starts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where the next of some findings begins whose value ends where that of each does, or else that end."""
    order = np.lexsort((starts, whole))
    out, same = whole[order], np.flatnonzero(whole[order][1:] == whole[order][:-1])
    out[same] = starts[order][same + 1]
    back = np.empty_like(out)
    back[order] = out
    return back


def views(data: np.ndarray, lows: np.ndarray, highs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The network's inputs for candidates in texts ``data[lows:highs]``, and the candidate each belongs to."""
    pieces = np.maximum(1, -(-(ends - starts) // PIECE))
    owner = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = starts[owner] + nth * PIECE
    place = at[:, None] + np.arange(-BEFORE, PIECE + AFTER)[None, :]
    inside = (place >= lows[owner, None]) & (place < highs[owner, None])
    c = _CLASS[data[np.clip(place, 0, len(data) - 1)]] if len(data) else np.zeros_like(place)
    own = (place >= starts[owner, None]) & (place < ends[owner, None])
    return np.where(inside, c + CLASSES * own, _PAD), owner


@dataclass
class CharConv:
    """Tables of the convolution (offset, class, filter), its bias, and the dense layer over maxima and means."""

    table: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: float

    def _conv(self, x: np.ndarray) -> np.ndarray:
        p = x.shape[1] - WIDTH + 1
        out = np.broadcast_to(self.bias, (len(x), p, FILTERS)).copy()
        for k in range(WIDTH):
            out += self.table[k][x[:, k : k + p]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for a in range(0, len(x), 512):
            z = np.maximum(self._conv(x[a : a + 512]), 0)
            out[a : a + 512] = np.concatenate([z.max(axis=1), z.mean(axis=1)], axis=1) @ self.dense + self.dense_bias
        return out


def _fit(x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> CharConv:
    """Adam on the logistic loss; gradients of the tables are sums of one-hot products."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.15, (WIDTH, _TABLE, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            xb, yb = x[order[a : a + batch]], y[order[a : a + batch]]
            net = CharConv(params[0], params[1], params[2], float(params[3][0]))
            conv = net._conv(xb)
            z = np.maximum(conv, 0)
            top = z.argmax(axis=1)
            h = np.concatenate([z.max(axis=1), z.mean(axis=1)], axis=1)
            q = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            d = (q - yb) / len(xb)
            dh = d[:, None] * params[2][None, :]
            p = conv.shape[1]
            dz = np.repeat(dh[:, None, FILTERS:] / p, p, axis=1)
            dz[np.arange(len(xb))[:, None], top, np.arange(FILTERS)[None, :]] += dh[:, :FILTERS]
            dz *= conv > 0
            flat = dz.reshape(-1, FILTERS)
            grad_table = np.zeros_like(params[0])
            for k in range(WIDTH):
                key = (xb[:, k : k + p].reshape(-1)[:, None] * FILTERS + np.arange(FILTERS)[None, :]).reshape(-1)
                grad_table[k] = np.bincount(key, weights=flat.reshape(-1), minlength=_TABLE * FILTERS).reshape(_TABLE, FILTERS)
            grads = [grad_table, flat.sum(axis=0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            step += 1
            lr = rate * (0.5 ** (epoch // 2))
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - lr * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return CharConv(params[0].astype(np.float32), params[1].astype(np.float32), params[2], float(params[3][0]))


@dataclass
class Scanner:
    net: CharConv
    x_cal: np.ndarray
    y_cal: np.ndarray
    threshold: float

    def score(self, data: np.ndarray, lows: np.ndarray, highs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        best = np.full(len(starts), -np.inf)
        for a in range(0, len(starts), 4096):
            some = slice(a, a + 4096)
            x, owner = views(data, lows[some], highs[some], starts[some], ends[some])
            np.maximum.at(best[some], owner, self.net.score(x))
        return best

    def find(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, rows and scores of the findings of some texts, by start.

        Of findings within findings the inner ones stay. A value that was seen in parts then goes
        to its end (whatever else is found behind what was seen), or to a finding within it that
        goes on to that end; in this case what is before that finding has to reach the threshold.
        """
        starts, ends, row, whole = spans(data, offs)
        score = self.score(data, offs[row], offs[row + 1], starts, ends)
        hit = np.flatnonzero(score >= self.threshold)
        starts, ends, row, whole, score = starts[hit], ends[hit], row[hit], whole[hit], score[hit]
        value = np.unique(np.stack([starts, whole], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        best = np.full(len(hit), -np.inf)
        np.maximum.at(best, value, score)
        keep = narrowest(starts, ends)
        starts, ends, row, whole, score = starts[keep], ends[keep], row[keep], whole[keep], best[value[keep]]
        upto = next_within(starts, whole)
        part = np.flatnonzero((ends < whole) & (upto < whole))
        own = self.score(data, offs[row[part]], offs[row[part] + 1], starts[part], upto[part])
        keep = np.ones(len(starts), dtype=bool)
        keep[part], score[part] = own >= self.threshold, own
        starts, row, whole, score = starts[keep], row[keep], whole[keep], score[keep]
        return starts, next_within(starts, whole), row, score

    def probability(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x_cal, self.y_cal)


def _encode(found: Sequence[tuple[str, int, int, bool]]) -> tuple[np.ndarray, ...]:
    texts = [t.encode() for t, *_ in found]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    a = np.array([offs[i] + len(t[:s].encode()) for i, (t, s, _, _) in enumerate(found)])
    b = np.array([offs[i] + len(t[:e].encode()) for i, (t, _, e, _) in enumerate(found)])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offs[:-1], offs[1:], a, b, np.array([f[3] for f in found], dtype=float)


def held(data: np.ndarray, lows: np.ndarray, highs: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Candidates of labelled texts: starts, ends, the finding each is in the text of, and whether it holds that finding whole."""
    starts, ends, row = candidates(data, np.append(lows, highs[-1:]))
    return starts, ends, row, (starts <= a[row]) & (ends >= b[row])


def score_held(scan: Scanner, data: np.ndarray, lows: np.ndarray, highs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The best score of the candidates that hold each finding whole; -inf, which no threshold finds, if none does."""
    starts, ends, row, whole = held(data, lows, highs, a, b)
    out, row = np.full(len(a), -np.inf), row[whole]
    np.maximum.at(out, row, scan.score(data, lows[row], highs[row], starts[whole], ends[whole]))
    return out


def choose_threshold(score: np.ndarray, y: np.ndarray, recall: float) -> float:
    """Of the thresholds that find ``recall`` of the secrets that of the best F2 (a miss weighs more than a false alarm), the lowest on ties.

    It lies half-way to the next lower score.
    """
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    last = np.append(s[1:] != s[:-1], True)
    fine = last & np.isfinite(s) & (hit >= recall * max(1, y.sum()))
    if not fine.any() or not y.any():
        return 0.0
    f2 = np.where(fine, 5 * hit / (4 * y.sum() + np.arange(1, len(s) + 1)), -1)
    at = int(np.flatnonzero(f2 == f2.max())[-1])
    return float((s[at] + s[at + 1]) / 2 if at + 1 < len(s) and np.isfinite(s[at + 1]) else s[at])


def train(found: Sequence[tuple[str, int, int, bool]], recall: float = RECALL) -> Scanner:
    """From labelled findings: three fifths for the network, a fifth each for calibration and the threshold, by turns.

    The network sees the candidates of their texts, those that hold no finding as harmless.
    """
    turn = np.arange(len(found)) // 2 % 5
    part = lambda keep: _encode([f for f, k in zip(found, keep) if k])
    data, lows, highs, a, b, y = part(turn < 3)
    starts, ends, row, whole = held(data, lows, highs, a, b)
    x, owner = views(data, lows[row], highs[row], starts, ends)
    net = _fit(x, np.where(whole, y[row], 0.0)[owner])
    data, lows, highs, a, b, y = part(turn == 3)
    scan = Scanner(net, np.zeros(1), np.zeros(1), 0.0)
    scan.x_cal, scan.y_cal = isotonic((s := score_held(scan, data, lows, highs, a, b))[np.isfinite(s)], y[np.isfinite(s)])
    data, lows, highs, a, b, y = part(turn == 4)
    scan.threshold = choose_threshold(score_held(scan, data, lows, highs, a, b), y, recall)
    return scan


@lru_cache(maxsize=1)
def default_scanner() -> Scanner:
    return train(findings.labelled(EXAMPLES))


def scan_secrets(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, finding, probability)``: the candidates that reach the threshold.

    ``start`` (from 0) and ``length`` count characters.

    * null and empty texts: no findings; null identifiers: findings with a null identifier;
    * repeated rows: their findings repeat; runs of any length are scored whole;
    * empty table: empty result; other columns are ignored.
    """
    scanner = scanner or default_scanner()
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "finding", "probability"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                starts, ends, row, score = scanner.find(data, offs)
                if not len(starts):
                    continue
                begins = (data & 0xC0) != 0x80
                chars = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
                at = chars[starts] - chars[offs[row]]
                found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + row)), pa.array(at, pa.int32()), pa.array(chars[ends] - chars[starts], pa.int32()), pa.array(found, pa.string()), pa.array(scanner.probability(score))],
                    names,
                )

    return df.mapInArrow(run, f"doc_id {kind}, start int, length int, finding string, probability double")

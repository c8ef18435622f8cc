"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows are taken in the order of a hash of their identifier, up to ``TRAIN_ROWS``
(the documented bound of the training sample; scoring and everything else reads all rows).
The lexicon holds words and word beginnings, by hash, that are far more common in toxic than
in other documents, besides a built-in list. Everything is cross-fitted over ``FOLDS`` folds
of distinct texts: a training row's features come from the lexicon of the other folds, and
the calibration is fitted on margins of trees that didn't see the row.

Features of a whole text: densities of lexicon words and beginnings, their summed log odds,
the share of the text's blocks that hold any, lexicon words near a second-person pronoun,
second-person density, capitals, words in capitals, exclamation and question marks, other
punctuation, digits, words with digits or signs between letters, runs of one character, and
the length. They are computed for many texts at once from byte classes and word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.textbytes import FOLD, WORD, slices, span_hash, text_hash, word_spans
from fieldloom.llm.trees import Boosted, boost, isotonic

TRAIN_ROWS = 12_000
REJECT = 0.3
PREFIXES = (4, 5, 6, 7)
FOLDS = 4
NEAR_WORDS = 8
BLOCK_WORDS = 64

SEEDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "dumb", "hate", "filth", "vermin", "retard", "bastard")
SECOND = ("you", "your", "yours", "yourself", "u", "ur", "thou", "du", "dich", "dir", "dein", "ihr", "euch", "tu", "te", "toi", "vous", "votre", "usted", "ustedes", "vosotros", "ti", "tú")
FEATURES = (
    "lexicon", "beginnings", "log_odds", "blocks", "near_second", "second", "capitals", "shouted",
    "exclaimed", "asked", "signs", "digits", "obfuscated", "repeated", "log_words",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SIGN = ~WORD.copy()
_SIGN[:33] = False


@dataclass
class Lexicon:
    """Sorted hashes and log odds of words, and of word beginnings (one table for each length in ``PREFIXES``)."""

    words: np.ndarray
    odds: np.ndarray
    beginnings: tuple[np.ndarray, ...]


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts, ends, rows and hashes of words, and the hashes of their beginnings (0: the word isn't longer)."""
    starts, ends, row = word_spans(data, offs)
    whole, *begun = span_hash(FOLD[data], starts, ends, *[np.minimum(ends, starts + k) for k in PREFIXES])
    for k, h in zip(PREFIXES, begun):
        h[ends - starts <= k] = 0
    return starts, ends, row, whole, begun


def _lookup(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions in the sorted ``table``, -1 for what isn't there."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def features(data: np.ndarray, offs: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """A row of ``FEATURES`` for each text; an empty text has zeros."""
    rows = len(offs) - 1
    out = np.zeros((rows, len(FEATURES)))
    if not len(data):
        return out
    starts, ends, row, whole, begun = word_hashes(data, offs)
    n = np.bincount(row, minlength=rows)
    per = np.maximum(n, 1)
    size = np.maximum(np.diff(offs), 1)
    hit = _lookup(lexicon.words, whole)
    found = hit >= 0
    out[:, 0] = np.bincount(row[found], minlength=rows) / per
    early = np.zeros(len(row), dtype=bool)
    for table, h in zip(lexicon.beginnings, begun):
        early |= _lookup(table, h) >= 0
    out[:, 1] = np.bincount(row[early], minlength=rows) / per
    out[:, 2] = np.bincount(row[found], weights=lexicon.odds[hit[found]], minlength=rows) / per
    ordinal = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n)])[row]
    marked = found | early
    blocks = np.unique(np.stack([row[marked], ordinal[marked] // BLOCK_WORDS]), axis=1)[0] if marked.any() else np.zeros(0, np.int64)
    out[:, 3] = np.bincount(blocks, minlength=rows) / np.maximum(1, -(-n // BLOCK_WORDS))
    you = _lookup(_SECOND_HASHES, whole) >= 0
    if marked.any() and you.any():
        ys, hs = np.flatnonzero(you), np.flatnonzero(marked)
        k = np.searchsorted(ys, hs)
        near = np.zeros(len(hs), dtype=bool)
        for side in (np.minimum(k, len(ys) - 1), np.maximum(k - 1, 0)):
            near |= (np.abs(ys[side] - hs) <= NEAR_WORDS) & (row[ys[side]] == row[hs])
        out[:, 4] = np.bincount(row[hs[near]], minlength=rows) / per
    out[:, 5] = np.bincount(row[you], minlength=rows) / per

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offs[1:]] - total[offs[:-1]]) / size

    upper = _UPPER[data]
    out[:, 6] = share(upper)
    caps = np.concatenate([[0], np.cumsum(upper)])
    shouted = (ends - starts > 2) & (caps[ends] - caps[starts] == ends - starts)
    out[:, 7] = np.bincount(row[shouted], minlength=rows) / per
    out[:, 8], out[:, 9], out[:, 10], digit = share(data == 33), share(data == 63), share(_SIGN[data]), _DIGIT[data]
    out[:, 11] = share(digit)
    letter, odd = _LETTER[data], digit | _SIGN[data]
    inside = np.zeros(len(data), dtype=bool)
    inside[1:-1] = letter[:-2] & odd[1:-1] & letter[2:]
    held = offs[:-1][np.diff(offs) > 0]
    inside[held] = inside[offs[1:][np.diff(offs) > 0] - 1] = False  # neighbours are other texts there
    out[:, 12] = share(inside)
    again = np.zeros(len(data), dtype=bool)
    again[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    again[held] = again[np.minimum(held + 1, len(data) - 1)] = False
    out[:, 13] = share(again)
    out[:, 14] = np.log1p(n)
    return out


_SECOND_HASHES = np.sort(np.array([text_hash(w) for w in SECOND], dtype=np.uint64))
_SEED_HASHES = np.sort(np.array([text_hash(w) for w in SEEDS], dtype=np.uint64))


def _telling(sets: list[np.ndarray], y: np.ndarray, least_docs: int = 3, least_odds: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that ``least_docs`` toxic documents hold and whose smoothed log odds are high, with these."""
    toxic, other = [s for s, t in zip(sets, y) if t], [s for s, t in zip(sets, y) if not t]
    empty = np.zeros(0, dtype=np.uint64)
    h, n = np.unique(np.concatenate(toxic or [empty]), return_counts=True)
    h, n = h[n >= least_docs], n[n >= least_docs]
    g, m = np.unique(np.concatenate(other or [empty]), return_counts=True)
    at = _lookup(g, h)
    seen = np.where(at >= 0, m[np.maximum(at, 0)] if len(m) else 0, 0)
    odds = np.log((n + 0.5) / (len(toxic) + 1)) - np.log((seen + 0.5) / (len(other) + 1))
    keep = (odds >= least_odds) & (h != 0)
    return h[keep], odds[keep]


def _hash_sets(column: pa.Array, toxic: np.ndarray, least_docs: int = 3) -> list[list[np.ndarray]]:
    """The distinct hashes of each text, of words, then of beginnings; only those that ``least_docs`` toxic texts hold, as no others can be telling."""

    def sets(texts: pa.Array, known: list[np.ndarray] | None) -> list[list[np.ndarray]]:
        out: list[list[np.ndarray]] = [[] for _ in range(1 + len(PREFIXES))]
        for lo, hi, data, offs in slices(texts):
            _, _, row, whole, begun = word_hashes(data, offs)
            for k, (table, h) in enumerate(zip(out, (whole, *begun))):
                r = row
                if known is not None:
                    here = _lookup(known[k], h) >= 0
                    h, r = h[here], row[here]
                at = np.searchsorted(r, np.arange(hi - lo + 1))
                table.extend(np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:]))
        return out

    often = []
    for table in sets(column.filter(pa.array(toxic)), None):
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *table]), return_counts=True)
        often.append(h[n >= least_docs])
    return sets(column, often)


def fit_lexicon(sets: list[list[np.ndarray]], y: np.ndarray, use: np.ndarray) -> Lexicon:
    """From the texts that ``use`` marks."""
    pick = [[s for s, u in zip(table, use) if u] for table in sets]
    h, odds = _telling(pick[0], y[use])
    extra = _SEED_HASHES[~np.isin(_SEED_HASHES, h)]
    h, odds = np.concatenate([h, extra]), np.concatenate([odds, np.full(len(extra), 3.0)])
    order = np.argsort(h)
    return Lexicon(h[order], odds[order], tuple(_telling(s, y[use])[0] for s in pick[1:]))


@dataclass
class Toxicity:
    lexicon: Lexicon
    model: Boosted | None
    prior: float

    def probability(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full(len(offs) - 1, self.prior)
        p = self.model.probability(features(data, offs, self.lexicon))
        return np.where(np.diff(offs) > 0, p, 0.0)


def train(texts: list[str] | pa.Array, toxic: np.ndarray) -> Toxicity:
    """Distinct texts with labels, in any order; the folds are by the hash of a text's last 64 characters and its length."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    toxic = np.asarray(toxic, dtype=bool)
    prior = float(toxic.mean()) if len(toxic) else 0.0
    fold = np.array([text_hash(t[-64:] + str(len(t))) % FOLDS if t else 0 for t in (x.as_py() for x in column)], dtype=np.int64)
    sets, everything = _hash_sets(column, toxic), np.ones(len(column), dtype=bool)
    lexicon = fit_lexicon(sets, toxic, everything)
    if any(min(toxic[m].sum(), (~toxic[m]).sum()) < 3 for m in (fold == k for k in range(FOLDS))):
        return Toxicity(lexicon, None, prior)
    x = np.zeros((len(column), len(FEATURES)))
    for k in range(FOLDS):
        own = fit_lexicon(sets, toxic, fold != k)
        x[fold == k] = np.concatenate([features(d, o, own) for _, _, d, o in slices(column.filter(pa.array(fold == k)))])
    margin = np.zeros(len(column))
    for k in range(FOLDS):
        margin[fold == k] = boost(x[fold != k], toxic[fold != k].astype(float)).margin(x[fold == k])
    model = boost(x, toxic.astype(float))
    model.x_cal, model.y_cal = isotonic(margin, toxic.astype(float))
    return Toxicity(lexicon, model, prior)


def train_from(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """``train`` on at most ``rows`` labelled documents; null labels, texts and identifiers don't count.

    The sample is of fixed size, so its identifiers may be broadcast and its texts come to the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    some = (
        known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64("id", F.lit("toxicity")), "id").limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    sample = texts.join(F.broadcast(some), "id").groupBy("t").agg(F.max("y").alias("y")).toArrow()
    order = pc.sort_indices(sample, [("t", "ascending")])
    column = sample.column("t").take(order).cast(pa.large_string()).combine_chunks()
    y = sample.column("y").take(order).to_numpy() > 0
    del sample
    return train(column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks or [pa.array([], pa.large_string())]), y)


def _score(model: Toxicity, reject: float, keep_only: bool, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(text_at)):
                p = model.probability(data, offs)
                part = batch.slice(lo, hi - lo)
                if keep_only:
                    yield part.filter(pa.array(~(p >= reject)))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(p >= reject)], ["doc_id", "probability", "toxic"])

    return run


def classify(docs: DataFrame, model: Toxicity, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, probability, toxic)``, a row for each row of ``docs``; ``toxic``: probability of at least ``reject``.

    * null and empty texts: probability 0; null identifiers and repeated rows pass as they are;
    * no labels, or too few of a class to fit trees: every text gets the share of toxic
      labels (0 without labels) as its probability;
    * texts are read whole, however long; empty table: empty result; other columns are ignored.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(_score(model, reject, False, 1), f"doc_id {kind}, probability double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Toxicity, reject: float = REJECT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``classify`` doesn't call toxic, with all columns, of any names.

    Rows with a null or empty text stay; each row is judged on its own whole text, so null identifiers,
    ties and repeated rows make no difference; an empty table gives an empty result.
    """
    return docs.mapInArrow(_score(model, reject, True, docs.columns.index(text_col)), docs.schema)

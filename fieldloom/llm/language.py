"""Language identification by compression.

Each language has a raw-content zstandard dictionary, made of whole sample documents. A
text, with ASCII case folded and signs and digits as blanks, is encoded in blocks of ``BLOCK`` bytes, each on its own and with every dictionary in
turn, so that the whole text counts and a long text can't become its own dictionary. The
language whose dictionary gives the smallest total wins; if the runner-up's total isn't at
least ``MARGIN`` larger, the text is rejected as ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.shared import cut
from fieldloom.llm.textbytes import FOLD, slices

UNKNOWN = "und"
BLOCK = 2048
MARGIN = 0.005
#: Greedy matching of at least four bytes tells close languages apart best for its cost.
PARAMETERS = {"strategy": zstd.STRATEGY_GREEDY, "min_match": 4, "search_log": 4}
#: Labelled documents of a language that its dictionary is made of, and the lengths, in characters, of those that may be.
SAMPLE_DOCS = 24
SAMPLE_LENGTHS = (41, 16_384)
#: More than so many language labels are taken for a mistake.
LANGUAGES = 1000

PLAIN = FOLD.copy()
PLAIN[:65] = PLAIN[91:97] = PLAIN[123:128] = 32


def plain(text: str) -> bytes:
    return PLAIN[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes()


class Compressors:
    """A prepared compressor for each language; made once in each worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.each = []
        for name in self.names:
            log = max(16, len(dictionaries[name]).bit_length())  # all of the dictionary is within the window and has its own places in the tables
            how = zstd.ZstdCompressionParameters(
                write_checksum=False, write_content_size=False, write_dict_id=False, window_log=log + 1, hash_log=log, chain_log=log, **PARAMETERS
            )
            d = zstd.ZstdCompressionDict(dictionaries[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.each.append(zstd.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, text: bytes | memoryview) -> list[int]:
        parts = [text[a : a + BLOCK] for a in range(0, len(text), BLOCK)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.each]


def decide(names: list[str], sizes: list[int], margin: float = MARGIN) -> tuple[str, float]:
    """The language and the margin by which the runner-up is larger; ties go to the earlier name, with margin 0."""
    if not sizes or min(sizes) == 0:
        return UNKNOWN, 0.0
    if len(sizes) == 1:
        return names[0], 1.0
    order = sorted(range(len(sizes)), key=lambda k: (sizes[k], names[k]))
    by = sizes[order[1]] / sizes[order[0]] - 1
    return (names[order[0]] if by >= margin and by > 0 else UNKNOWN), by


def train_dictionaries(
    docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict[str, bytes]:
    """A dictionary for each language that labelled documents name: the whole texts of ``sample_docs`` of them.

    They are taken in the order of a hash of their identifier, from the rows that have a language, an
    identifier and a text of ``SAMPLE_LENGTHS`` characters; of rows that share both language and
    identifier the least text counts. A language without such rows has no dictionary. The sample is
    bounded by these parameters, so its identifiers may be broadcast and its texts come to the driver.
    """
    lo, hi = SAMPLE_LENGTHS
    known = (
        docs.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.length("text").between(lo, hi))
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit("language")), "id")
    ids = known.select("lang", "id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_docs)
    some = cut(ids)
    if (found := some.where("n = 1").count()) > LANGUAGES:
        raise ValueError(f"{lang_col} has {found} values; at most {LANGUAGES} languages are told apart")
    rows = known.join(F.broadcast(some), ["lang", "id"]).groupBy("lang", "n").agg(F.min("text").alias("text")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.n)):
        out[r.lang] = out.get(r.lang, b"") + plain(r.text) + b" "
    return out


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, language, margin)``, a row for each row of ``docs``.

    * null and empty texts, and any text without dictionaries: ``und``, margin 0;
    * ties: ``und``; null identifiers and repeated rows pass as they are;
    * texts are read whole, however long; empty table: empty result; other columns are ignored.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(dictionaries)
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                view, at = memoryview(PLAIN[data]), offs.tolist()
                found = [decide(c.names, c.sizes(view[a:b]) if b > a else [], margin) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    ["doc_id", "language", "margin"],
                )

    return df.mapInArrow(run, f"doc_id {kind}, language string, margin double")

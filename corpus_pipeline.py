"""From documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, written as Parquet and read again. All but
the last return the columns of the documents, whatever other columns there are and whatever
they are called. An empty table goes through all stages and gives an empty result.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import content_sort, fair_mix, lsh_forest, packing, toxicity
from fieldloom.llm.shared import checkpoint_dir, delete, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier fitted on the labelled ones doesn't reject.

    Null and empty texts stay; long texts are judged whole; rows are judged one by one, so null or
    repeated identifiers and repeated rows make no difference there; without labels all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train_from(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (blanks normalised) the row with the smallest identifier.

    Null texts stay, of empty and blank ones one row stays; null identifiers come last; of rows that
    tie or repeat one stays.
    """
    return content_sort.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest identifier.

    Null, empty and wordless texts and null identifiers stay; rows that share an identifier stay or go together.
    """
    return lsh_forest.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fit the token budget in weighted fair order of their sources.

    A null source is a source of its own; null and empty texts have no tokens; rows that share an
    identifier, also a null one, are one document; ties go by source, hash and identifier.
    """
    return fair_mix.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, piece, tokens, bin)``: where each piece of each document goes.

    Every row is packed, also with a null identifier or a repeated one; null and empty texts are a
    piece of no tokens; long texts are cut into full sequences and a rest.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier, sketches and a genetic algorithm have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; their results go to the shared folder of the session.

    What a stage has read and checkpointed is removed once its result is written, and the last result at the end of the program.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        if spark._jsc.sc().isStopped():
            return
        delete(spark, folder)
    except Exception:  # noqa: BLE001 - the gateway is gone: nothing can be removed any more
        pass

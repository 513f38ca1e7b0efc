"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bandloom.llm import decontaminate, minhash, packing, personal_data, toxicity
from bandloom.llm.common import Cuts, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the training fold.

    Null and empty texts score as the empty one. Rows with one text stay or go together,
    whatever their ids; without documents or labels nothing goes.
    """
    return toxicity.remove_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id.

    Rows are judged by their texts, whatever their ids: of repeated rows one stays, as it does
    of copies without ids. Null and empty texts all stay.
    """
    return minhash.remove_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one within the edits allowed, go.

    Null and empty texts stay; without items nothing goes.
    """
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind, ``n_chars`` follows; no document goes.

    Null and empty texts stay as they are, repeated rows and ids are rows like any other.
    """
    return personal_data.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document with its place in a sequence of 4,096 tokens.

    A null or empty text is one piece, its end mark. Rows that repeat an id are packed each.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]
#: Learned models and token ids cannot be put in SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), Cuts(spark)
    for _, stage in STAGES[:-1]:
        cut = Cuts(spark)
        docs = cut(stage(spark, docs, sf_dir))
        before.clear()
        before = cut
    packed = written(STAGES[-1][1](spark, docs, sf_dir))
    before.clear()
    return packed

"""Stages of the corpus pipeline (see ``corpus_pipeline.py``).

Every stage works on all rows that the stage before it kept and returns the
columns of ``documents``, except the last, which returns packed pieces.

- toxicity: documents that the operator predicts toxic go. It learns from
  ``labels`` and the documents it is given.
- language: documents without a letter go, and those whose text no learned
  language explains: under the best one a character has on average a log
  probability below ``FLOOR``. The fixture's own texts have -1.3 to -4.0, a web
  address -6.8 and a Chinese sentence -13.9 there, so such documents are mostly
  of other scripts, symbols or keys hit at random. Where nothing could be
  learned, all texts with letters stay.
- near duplicates: texts whose sets of word shingles are alike by ``ALIKE``
  percent or more are linked (the operator's own query has a threshold of its
  own); the document with the smallest id of each group stays; rows with a null
  id stay.
- repeated passages: the bytes that the operator removes go from the texts (a
  character cut in two by a removed run goes whole); the count of characters
  follows. A document that loses all of its text goes; one that was empty
  before stays.
- packing: the pieces of the texts that are left, with their places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.llm import language, near_dedup, packing, passages, toxicity
from tripcast.llm.common import documents, drop_written, package_on_workers, read_table, written

FLOOR = -8.0  # of the log probability of a character in the language stage
ALIKE = 80  # percent; of the stage on word shingles

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    scored = toxicity.score_documents(docs, read_table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select("row.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    return language.identify_documents(docs).filter(F.col("fit") >= FLOOR).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    gone = near_dedup.near_duplicates(docs, ALIKE).filter("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    return passages.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    package_on_workers(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeats),
    ("best_fit_packing", pack_sequences),
]

# Models, sets of shingles and token ids are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is a written table that the next
    stage reads."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
            drop_written(before)  # a table of the stage before; inputs stay
    return docs

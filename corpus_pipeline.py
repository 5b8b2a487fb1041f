"""From raw documents to packed sequences: the stages of a training corpus, each written before the next reads it.

Every stage takes (spark, docs, sf_dir) and all but the last return the columns of docs, whatever these are named. Rows
with nulls in any column, empty texts and texts of any length pass by each stage's own rule below. A stage given an empty
table gives an empty one. docs that are no plain scan of files are written first, so that all scans see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixsieve.llm import exact_dedup, langid, mixing, near_dedup, packing
from helixsieve.llm.common import Scratch, settled, table, with_uid
from helixsieve.llm.queries import tokenizer_path


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Settled docs without the rows whose uid is in dropped; the join is a merge at every size."""
    rows = with_uid(docs.select(F.struct("*").alias("row")))
    return rows.join(dropped.select("uid").hint("merge"), "uid", "left_anti").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those whose text is null or without a letter go, as do all if nothing is labelled.

    Repeated rows are judged alike; ties between languages go by the smaller name.
    """
    docs = settled(docs)
    return langid.identify(docs, langid.fit(docs)).where("langid.lang_pred != 'und'").select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: the longest, then of the smallest doc_id.

    Null texts count as empty, and a null doc_id is last. Of rows that tie in both the first by file and place stays.
    """
    docs = settled(docs)
    return _without(docs, exact_dedup.exact_dedup(docs).where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that of the smallest doc_id, a null doc_id last, then by file and place.

    Rows without words are no copies of any other and stay, all of them.
    """
    docs = settled(docs)
    return _without(docs, near_dedup.near_dedup(docs).where("not first"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order; a document that is taken twice is two rows, one that the cut meets keeps its first words.

    A null source is a source of its own, the last. Rows without words have nothing to be taken, and go.
    """
    return mixing.emit(settled(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document. A null text is empty: its piece is the end token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The first stage learns a model and the last needs a tokenizer: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

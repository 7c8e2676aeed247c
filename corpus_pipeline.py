"""Corpus pipeline: quality, repeated lines, near copies, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.llm import line_dedup, mixing, ngram_join, packing, quality
from quirewise.llm.common import scratch, table, written


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage changed it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are judged like all others; null ids and repeated rows are rows like others;
    where no label can be learnt from, all stay.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go from the texts; no document goes.

    A null text comes back empty; a null id sorts last; rows that repeat an id lose the same lines.
    """
    done = line_dedup.dedup_lines(docs)
    return _counted(done.select("row.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, similarity 0.8) the smallest id stays.

    Texts without words are no copies and stay; a null id stays only where its class has no other; of rows
    that repeat an id in one class, one stays.
    """
    return ngram_join.one_of_each_class(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its schedule.

    Texts without words go; a null source is a source, a null id an id; rows that repeat an id in one source share
    what is taken of them.
    """
    return _counted(mixing.mixed_documents(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the sequences.

    A null or empty text is the end id alone; null ids and repeated rows are packed like others.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", source_mix),
    ("packing", packed_sequences),
]

#: SQL can't express the trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written before the next reads it; intermediates of a stage go with it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)

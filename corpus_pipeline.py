"""A training corpus from documents: five stages, each written and read again.

Every stage works on all rows that its predecessor kept. All but the last return the
columns of documents; the last adds how often a document goes into the mix. Extra
columns of documents ride along whatever their names. Null texts count as empty; texts
of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import Scratch, table, temporary
from postmill.llm.decontamination import decontaminate
from postmill.llm.line_dedup import line_dedup
from postmill.llm.mixing import mix
from postmill.llm.ngram_join import one_of_each
from postmill.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; null and empty texts, null ids and repeated rows are judged by their text alone."""
    judged = toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return judged.where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a later document keeps; n_chars is that of the new text.

    Null texts become empty ones. Rows of one doc_id are one document; those with a null
    one keep no repeated line.
    """
    done = line_dedup(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least doc_id (null last); all rows without words stay."""
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; rows of one doc_id, null included, go or stay together."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with copies (1 to 3) and taken, the words of all copies.

    A null source is a source. Repeated rows are drawn one by one; rows without words
    are never taken.
    """
    return mix(docs, keep=True).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: SQL cannot express the classifier or the draws; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; what a stage returns is written to the shared folder and read by the next.

    What a stage wrote besides, and what the next one has read, is deleted.
    """
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary():
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs

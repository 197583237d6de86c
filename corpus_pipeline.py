"""From documents to a training mix: each stage is one operator, written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depdelver.llm import decontamination, jaccard_join, language, line_dedup, mixing
from depdelver.llm.rows import unpacked
from depdelver.session import settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the labels in ``lang`` train the text model.

    Null and empty texts, and those without letters, are rejected: they are in no language. Texts of
    any length are read whole; ties go as in ``language.identify``; repeated rows and ids are judged row by
    row, a null id too; an empty table, or one without labels, keeps nothing. All columns are returned as they were.
    """
    return unpacked(language.of_documents(docs, docs).where("keep"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of three-line windows; n_chars follows the text.

    No document goes, though one may be left with an empty text. Nulls, ties, repeated rows and ids,
    long texts and empty tables as ``line_dedup.dedup_lines`` has them; of a null text n_chars becomes null.
    """
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: that of the smallest id, as ``jaccard_join.one_of_each`` has it.

    Null and empty texts are linked with nothing and stay, each by itself; of equal rows one stays.
    """
    return jaccard_join.one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are the benchmark's, as ``decontamination.remove_contaminated`` has it.

    Null and empty texts have no words and stay; repeated rows are judged row by row; an empty benchmark removes nothing.
    """
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each remaining document the mix takes: a row a document, with nulls, ties, repeated rows,
    sources that are null and empty tables as ``mixing.mix_sources`` has them."""
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix),
]

#: The first stage has a trained model; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))  # what it wrote on its way goes
    return STAGES[-1][1](spark, docs, sf_dir)

"""A cleaning pipeline over documents: toxicity, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last have the columns of documents. `run` writes each stage's result as
Parquet below the folder that all executors share, reads it again for the next, and deletes it once that is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from benefactor.llm import line_dedup, mixing, ngram_join, packing, toxicity
from benefactor.llm.common import remove_folder, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from all labels."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines that many sites hold go from all texts; no document goes."""
    return line_dedup.clean_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.take_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", clean_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The classifier and the tokenizer are beyond SQL: a test holds each stage's rows against a model in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """All stages on documents; the last one's rows. keep: leave the folders of the stages before it."""
    base = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last and not keep:
            remove_folder(spark, last)
        last = path
    return docs

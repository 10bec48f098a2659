"""The corpus pipeline: each stage reads what the one before it kept.

Every stage takes all rows of its input. Rows are documents (doc_id, text, lang, source, n_chars, and whatever else the
input has); the last stage returns pieces of packed sequences. Null and empty texts pass all stages. Repeated rows, that
is the same id and the same text, leave the second stage as one document unless they have no words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden.llm import bootstrap, crf, group_matrix, packing
from sitewarden.llm.tables import read, run_folder, saved


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger takes for toxic go."""
    labels = read(spark, sf_dir, "labels").where(~crf.held_out())
    scored = crf.score(docs, crf.train(docs, labels), scored="__score", spans="__spans")
    return scored.where("__score < 0.5").drop("__score", "__spans")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return group_matrix.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; all documents stay."""
    found = bootstrap.find_personal(docs, out="__personal")
    clean = found.withColumn("text", F.when(F.col("text").isNotNull(), bootstrap.masked(F.col("text"), F.col("__personal"))))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("__personal") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts as pieces of sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", pack)]

#: Learned taggers, learned vocabularies and linear programs have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's rows are written and read again by the next."""
    folder, docs = run_folder(spark), read(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = saved(docs, f"{folder}/{n}-{name}")
    return docs

"""Corpus pipeline: the stages that a document passes on its way into a training set.

Each stage takes docs with the columns DOCUMENT, which may be null in any row, and returns these columns (the last one
some more); further columns are left behind, whatever their names. Null, empty and very long texts pass like others and are
read whole; repeated rows are judged each by itself, but for the second stage; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import materialise, remainder, table
from tagloom.llm.pii_sanitisation import sanitise
from tagloom.llm.simhash_golay import keep_one
from tagloom.llm.source_mixing import described, mix
from tagloom.llm.template_decontamination import decontaminate
from tagloom.llm.toxicity import reject_toxic

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by models of the labels outside fold 1 of 3. Without labels of both classes all stay."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"), train=remainder(F.col("doc_id"), 3) != 1).select(*DOCUMENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; of rows with one id one. Texts without words are one group; rows with a null id stay if a group has no other."""
    return keep_one(docs).select(*DOCUMENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows with a null id or text stay; an empty benchmark keeps all."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENT)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars set to the new length; null texts stay null."""
    return sanitise(docs).select(*DOCUMENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, sampled to tempered marginals of source, language and topic, with weight and probability. Documents without tokens go; nulls are a value like any other; rows with one id fall alike."""
    features = described(docs)
    counted = materialise(features.select("source", "lang", "topic", "n_tokens"), "described")
    return mix(features, counted=counted).where("sampled").select(*DOCUMENT, "topic", "n_tokens", "weight", "probability")


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: Learned scores, XXH64 fingerprints and raking rounds are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

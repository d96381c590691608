"""The corpus pipeline: five stages from raw documents to token records.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever these are. Rows may have null ids, null, empty or
very long texts, and be repeated; tables may be empty; what each stage makes of that its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from entityspark.llm.common import materialize, table
from entityspark.llm.decontaminate import drop_leaks
from entityspark.llm.jaccard import keep_one
from entityspark.llm.mixing import take_copies
from entityspark.llm.records import encode_corpus
from entityspark.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. Null and empty texts hold no evidence and stay; rows with null ids
    and repeated rows are judged by their texts; without labels of both kinds all have the one label there is, or stay."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least id. Texts without words, null ones included,
    are in no group and all stay; of rows repeated with their id one stays; null ids give way to others."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay; rows with null ids and repeated rows
    are judged by their texts; with no items all stay."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it, up to three times. Null and empty texts carry no words and stay as
    often as the whole part of their source's rate; a null source is a source; repeated rows share their copies."""
    return take_copies(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the records written, read back from their files. Null and empty texts have the
    end id alone; null ids come first; each copy of a document has a record of its own."""
    return encode_corpus(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_records", token_records),
]

#: No stage but a plain filter could be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

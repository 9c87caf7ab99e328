"""A corpus pipeline over ``documents``: language, exact copies, near copies, source mix, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. All but the last
return the columns of documents.

- language: drops texts in which no language can be told, those without letters.
- exact: keeps the row with the largest doc_id of each group of equal texts.
- near: keeps the document with the smallest doc_id of each group of near copies (five-word shingles, 0.8).
- mix: each document as many times as the source mix takes it.
- pieces: doc_id, the SentencePiece ids of each text and their number.

SQL cannot express the learned and sketched stages; tests hold each stage against a brute-force version.

Defined results: a null text is an empty one, which has no letters and goes in the first stage, as do texts of digits or marks alone; a
null doc_id never wins over another one, and such rows are told apart by their texts; rows that share an id but not a text are
documents of their own; of wholly repeated rows one stays; without labelled languages no text is identified and
all go; a null source is a source of its own; very long texts are treated whole; empty tables give empty results; further columns are carried along to
the last stage, whatever their names (those that begin with q_ are taken).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Staging, table
from quire.llm.exact_dedup import drop_exact_copies
from quire.llm.language_id import drop_unidentified
from quire.llm.mixing import mixed_documents
from quire.llm.near_dedup import drop_near_copies
from quire.llm.sentencepieces import encode_pieces

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_pieces(docs).withColumn("n_pieces", F.size("ids"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Staging(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage.table(step(spark, docs, sf_dir), name)
    return docs

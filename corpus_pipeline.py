"""A corpus pipeline of five operators, each stage written as Parquet and read again by the next.

quality         documents that the quality classifier rejects go
near_duplicates one document of each near-duplicate component stays, that of the smallest id
substrings      words of passages of twenty words and more that started earlier go
mixing          documents are repeated or left out so that the sources meet their target words
pieces          texts become SentencePiece ids, decoded again and compared

Defined results: a null text is empty; it is scored like any other, kept or rejected by its score, near to nothing, and
a document of size 0 in the mix, which is kept once. Rows are told apart by id and text: rows without an id, or of one
id with different texts, are documents of their own in every stage; rows that share both are copies, of which the second
stage keeps the one whose other columns are smallest. Of equally small ids in a component the smallest hash of the text
stays; of equally early passages the first by id, hash of the text, and start. A null source is a source of its own, the last. Without labels
of both kinds the classifier's score is the share of label 1 (0.5 without labels, so that nothing is kept). Columns
other than those of documents are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, neardup, pieces, quality, substring
from tessera.llm.common import cut, settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return neardup.keep_one(docs.select(*COLUMNS))


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    left = substring.dedup(docs, "lang", "source", untouched=True)
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return mixing.take(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return pieces.encode_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", drop_substrings),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: No stage but the near duplicates can be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

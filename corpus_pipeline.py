"""A training corpus in five stages, each on all that its predecessor kept.

For every stage: columns other than those of documents are left out at its start, so names cannot clash; an empty table
gives an empty result; texts may be of any length; null columns other than text pass through unchanged. What null texts,
ties and repeated rows mean is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import exact_dedup, mixing, packing, simhash, toxicity
from loomstone.llm.common import Tables, like, table
from loomstone.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; the score learns from all labelled documents.

    Null and empty texts stay. A score of exactly one half is rejected. Repeated rows go or stay together.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return like(docs.where(~toxicity.rejected(docs, model)), COLUMNS)


def exact_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the smallest id's, of repeated rows with it one, a null id's only if there is no other.

    Null texts count as empty ones, so one row of all these stays.
    """
    return exact_dedup.drop_duplicates(like(docs, COLUMNS))


def similar_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five words, similarity 0.8) one document stays, the smallest id's of a group.

    Null texts and texts without words stay. Rows that repeat an id stay or go together; so do rows with a null id, which stay.
    """
    return simhash.drop_similar(like(docs, COLUMNS), shingle=5)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows repeat for each epoch, the row that a budget ends in is cut there.

    Null sources are one source, the last. Null texts have no words, so they are not taken. Equal hashes are ordered by id.
    """
    return mixing.mixed(like(docs, COLUMNS), share=1.5, most=2.0, weights=(5, 2, 1))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of 2048 tokens. Null texts are empty ones: a document of its end token. Repeated rows are each packed."""
    return packing.pack(docs, vocabulary(), capacity=2048, end=1)


STAGES = [("toxicity", toxic_out), ("exact_dedup", exact_out), ("simhash_near_dedup", similar_out), ("mixing", weighted), ("packing", packed)]

#: The lexicon, the fingerprints and the tokeniser are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each gives is written as Parquet in the shared folder and read again, and removed once the next is there.

    The last one's table stays until the session ends, since the result reads it.
    """
    store = Tables(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, store.cut(stage(spark, docs, sf_dir))
        store.drop(before)
    return docs

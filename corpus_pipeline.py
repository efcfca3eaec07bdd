"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

toxicity -> line dedup -> near-duplicate removal -> mixing to target weights -> packing. The first four return the
columns of documents, the last one a row per piece with its sequence and offset.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, an empty table and extra columns of any
name: what it does with them is said below, and columns that it does not need are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm.common import scratch, session, table
from docweave.llm.line_dedup import rebuild
from docweave.llm.mixing import take_documents
from docweave.llm.packing import pack_documents
from docweave.llm.simhash import keep_first
from docweave.llm.toxicity import keep_clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go.

    Null and empty texts have no match and stay; very long texts are scored whole; repeated rows stay or go alike; a null doc_id has no
    label. An empty table gives an empty one, and without labels nothing goes.
    """
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller doc_id holds go.

    Null texts stay null, empty ones empty, and a document all of whose lines go keeps an empty text; very long texts are read whole;
    rows that share a doc_id are one document; a null doc_id sorts last. An empty table gives an empty one.
    """
    session(docs)
    return rebuild(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of like texts (five-word shingles, similarity 0.8 or more) stays: the smallest doc_id's.

    Null and empty texts and those of white space are one group; very long texts are compared whole; repeated rows are copies; null
    doc_ids sort last, and of texts that share the smallest id the one with the least hash stays. An empty table gives an empty one.
    """
    return keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a source repeat or go until the source has its target share of words.

    Null and empty texts have no words and go; a very long text is taken whole or not at all; a null source is a source like any
    other; repeated rows share what is taken of them; null doc_ids hash like an id of their own. An empty table gives an empty one.
    """
    return take_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 1024 tokens.

    Null and empty texts are the end mark alone; very long texts give as many pieces as they need; repeated rows are packed each;
    a null doc_id stays null; pieces of one length go in any order. An empty table gives no piece.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned weights, 64-bit hashes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from raw documents: language, near duplicates, repeated passages, packing.

Each stage takes what the one before it kept, written as Parquet and read again, and all but the
last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import langid, likeness, packing, substring
from tracewell.llm.common import small_workers, staged


#: The languages of the corpus, as ``lang`` names them.
LANGUAGES = ("en",)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network recognizes as one of LANGUAGES, with a score of one half or more.

    The network learns from ``lang`` of the documents that are not held out and judges texts alone.
    Null texts and texts without a letter go; equal texts, repeated rows and null ids are judged alike.
    An empty table, or one without any ``lang``, gives no rows.
    """
    small_workers(spark)
    return langid.accepted(docs, languages=LANGUAGES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, likeness 0.8 or more): that with the smallest doc_id.

    Null, empty and blank texts are copies of each other. A null doc_id counts as larger than any
    other, of repeated rows one stays, and an empty table gives no rows.
    """
    small_workers(spark)
    return likeness.near_copies_keep(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of 13-word windows that start in a smaller document too.

    Where words go, the text becomes the words left, joined by one space, and n_chars its length;
    a document that repeats others throughout stays with an empty text. Other texts stay as they are,
    null and empty ones too. Rows without a doc_id neither lose words nor make others lose any, rows
    that share one are no repeats of each other, and an empty table gives no rows.
    """
    small_workers(spark)
    found = substring.substring_dedup(docs)
    changed = F.col("n_removed") > 0
    own = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return found.select(*[own.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence of at most 1024 tokens and its place there.

    A null or empty text is one piece, the end token. Null ids and repeated rows stay, each with a
    place of its own; an empty table gives no rows.
    """
    small_workers(spark)
    found = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("sequences", sequences)]

#: SQL can neither train the network nor encode text; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: stages over ``documents``, each one operator of ``sensortracks.llm``.

    language    rank-order profiles; documents without a learned language (``und``) go
    quality     base counts and the rule cascade; documents that it rejects go
    near_dup    LSH forest; one document of each group stays
    pii         personal data becomes its kind in brackets; n_chars follows the text
    packing     vector best fit; the pieces of every document with their sequences

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``; all but the last return the
columns of ``documents``.  Models (profiles, the field) are learned from the stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensortracks.llm.common import held_out, prepare, table, written
from sensortracks.llm.langid import identify, language_profiles
from sensortracks.llm.neardup import deduplicated
from sensortracks.llm.pack import pack_documents
from sensortracks.llm.pii import learn_field, redacted
from sensortracks.llm.quality import quality_verdict
from sensortracks.llm.queries import bpe_path

MIN_SCORE = 0.2
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null texts, texts without a letter and those far from every profile go."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    profiles = language_profiles(docs.filter(~held_out("doc_id", 4)))
    return identify(docs, profiles).filter(
        (F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and every rule of the cascade."""
    prepare(spark)
    return quality_verdict(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies."""
    prepare(spark)
    return deduplicated(docs.select(*COLUMNS)).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every personal span of the text replaced by its kind."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    return redacted(docs, learn_field(docs)).withColumn(
        "n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    prepare(spark)
    return pack_documents(docs.select("doc_id", "text"), bpe_path())


STAGES = [("language", language), ("quality", quality), ("near_dup", near_dup), ("pii", pii), ("packing", packing)]
#: Learned profiles, signatures and token ids have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet in the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs

"""From documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept, written as Parquet and read again. All but the last
return the columns of ``documents``. Stages set the session's Arrow batches to ``BATCH_ROWS`` rows at most, where they
are larger: texts are copied from executor to worker and back by the batch, in memory outside the heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, mixing, packing, secrets, simhash
from tidemark.llm.common import discard, made, table, written


BATCH_ROWS, _ROWS = 2048, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _bounded(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the labelled rows; rows without a letter or of an ambiguous language go."""
    _bounded(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: groups of five-word shingle sets with a similarity of 0.8 or more."""
    _bounded(spark)
    return simhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are redacted; every document stays."""
    _bounded(spark)
    return secrets.redact_documents(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights; a row for each run of a document's words that the mix takes."""
    _bounded(spark)
    return mixing.mix_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    _bounded(spark)
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("pack_windows", pack_windows)]
#: Trained models, tokens and pseudorandom draws are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs, before = table(spark, sf_dir, "documents"), made(spark)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        discard(spark, [f for f in made(spark)[:-1] if f not in before])  # what the stage, and the one before, left
    return STAGES[-1][1](spark, docs, sf_dir)

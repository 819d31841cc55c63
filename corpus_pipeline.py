"""From raw documents to token ids: quality, near copies, benchmark leaks, secrets, pieces.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; stages work on all rows the one before kept. All but the last
return the columns of ``documents``; the last returns ``doc_id, lang, source, n_chars, n_ids, ids, round_trip``.

Defined results, besides those of the operators: a null or empty text is judged by the quality network like any other, is
never a near copy, a leak or a secret, and ends with no ids; a row with a null id passes the stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import common, leak_match, near_copies, quality_network, secret_scan, sentence_pieces
from framelake.llm.workload import tokenizer
from framelake.session import staging_path

#: SQL cannot express the network, the signatures or the piece search.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality network accepts. It learns from labelled documents outside the held-out fold."""
    net = quality_network.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality_network.keep_good(docs, net)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return near_copies.drop_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within its edit budget."""
    return leak_match.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; ``n_chars`` counts the new text."""
    return secret_scan.redact_secrets(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, decoded again and compared."""
    return sentence_pieces.encode_rows(docs, tokenizer("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("quality_network", quality), ("near_copies", near_dedup), ("leak_match", decontaminate), ("secret_scan", mask_secrets), ("sentence_pieces", to_pieces),
]


#: Rows that a task hands to Python at once; texts are long, so Spark's default of 10,000 holds tens of megabytes on both sides.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        for name, stage in STAGES:
            path = staging_path(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return docs

"""The corpus pipeline: documents in, clean deduplicated documents as token digests out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages
the rows are written as Parquet and read again. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, jaccard, language, lines, queries, winnow
from docloom.llm.common import settle, table

#: A text whose best language has less than this pooled probability has no language to train on.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those that no learned language fits."""
    return language.drop_unknown(docs, language.train(docs), LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out; a document that had nothing else goes."""
    return lines.dedup_lines(docs).filter(F.trim("text") != "").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each linked group."""
    return jaccard.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a span with a benchmark item."""
    return winnow.drop_hit(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of the token ids and of the decoded text."""
    return bpe.encode_decode(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("bpe", encode)]

#: No SQL: a trained network decides in the first stage. tests/llm (test_pipeline_against_plain_python) holds the
#: stages after it against plain Python, given the rows that the network keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests (see ``bpe.encode_decode``) of the documents that all stages keep, in no order.

    Null texts, empty ones and those without a letter go in the first stage. Of rows repeated under one id
    with one text the near-duplicate stage keeps all or none; of other linked rows one stays. Null ids are ids
    of their own. Texts of any length pass whole; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

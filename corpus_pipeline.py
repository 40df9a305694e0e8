"""A training corpus from ``documents``: language identification, toxicity, repeated lines, near-duplicates, packing.

Every stage reads what the stage before it kept, written as Parquet. All but the last return the columns of
``documents``; the last returns the packed pieces. Null texts are rejected by the first stage; a document whose every
line is a later copy is dropped by the third; of each group of near-duplicates one row stays, that of the smallest
doc_id (any id comes before none; of rows that share it the first stored). An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, line_dedup, packing, simhash, toxicity
from tessera.llm.common import ROW, prepare, scratch, table, with_row
from tessera.llm.queries import PACKING_TOKENIZER


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents in no learned language go."""
    return langid.keep_identified(docs, docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents predicted toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: later copies of repeated line runs are cut out of the texts; documents of nothing else go."""
    return line_dedup.without_later_copies(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one row of each group of near-duplicates stays, the smallest doc_id. Rows are grouped by a number of
    their own, so repeated rows and rows without doc_id are copies like any other."""
    rows = with_row(docs)
    verdicts = simhash.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), words=4, bits=4)
    ids = rows.select(ROW, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW).alias("place"))
    first = (verdicts.select(F.col("doc_id").alias(ROW), "component_id").join(ids, ROW)
             .groupBy("component_id").agg(F.min("place").alias("first")).select(F.col(f"first.{ROW}").alias(ROW)))
    return rows.join(first, ROW, "left_semi").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents' tokens in sequences of 2048."""
    return packing.pack(docs, PACKING_TOKENIZER)


STAGES = [("language_id", language_stage), ("toxicity", toxicity_stage), ("line_dedup", line_stage),
          ("simhash_near_dedup", near_duplicate_stage), ("packing", packing_stage)]

#: Learned filters and tokens cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the ``documents`` of ``sf_dir``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

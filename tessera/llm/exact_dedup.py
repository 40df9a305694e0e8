"""Exact duplicates through a persistent digest index.

The index is a Parquet table in the shared folder, bucketed and sorted by digest: one row per distinct normalised text.
A batch is reduced to digests, pre-aggregated per digest, and checked against the index by a sort-merge anti-join that
reads the index bucket by bucket without shuffling it; what is new is appended in the same layout. DataFrame functions
only.

Normalisation: A-Z become a-z, nothing else; a null text counts as empty. Of equal texts in a batch the row with the
largest ``doc_id`` stays (any id before none; of rows that share it the one stored first), and only that row is kept. A text
that the index already holds keeps the row that entered it: no row of a later batch is. Extra columns of the input are
ignored; an empty batch appends nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_LOWER, ASCII_UPPER, ROW, partitions_for, scratch, stored


def normalised(text):
    """``text`` with A-Z lower-cased; other letters stay. Pure ASCII texts take the faster ``lower``."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, ASCII_UPPER, ASCII_LOWER))


class DigestIndex:
    """Distinct texts seen so far: (digest, keep_id, group_size, batch that entered it) at ``path``, in ``buckets`` sorted
    buckets. ``close`` takes the table out of the catalog; its files stay and can be opened again by their path."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"create table {self.name} (digest binary, keep_id bigint, group_size bigint, batch string) using parquet "
                  f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.path}'")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")

    def add(self, docs: DataFrame) -> DataFrame:
        """Append the new texts of ``docs`` and return one row per document: doc_id, keep_id, group_size (rows of its
        text in the batch that entered it), kept, digest."""
        batch = uuid.uuid4().hex
        digests = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                     F.monotonically_increasing_id().alias(ROW),
                                     F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")), "digests")
        # written, or the optimizer would move the anti-join below the aggregation and shuffle every row of a hot digest
        first = F.max_by(F.col(ROW), F.struct(F.col("doc_id").isNotNull(), "doc_id", -F.col(ROW)))
        groups = stored(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), first.alias("first"),
                                                      F.count(F.lit(1)).cast("long").alias("group_size")), "groups")
        fresh = groups.drop("first").withColumn("batch", F.lit(batch)).join(
            self.entries().hint("merge"), "digest", "left_anti")
        (fresh.repartition(self.buckets, "digest").write.format("parquet").mode("append")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))
        # read as plain files: both sides of these joins are then shuffled, so that a hot digest can be split
        index = self.spark.read.schema(self.entries().schema).parquet(self.path)
        verdicts = stored(groups.select("digest", "first").join(index, "digest").select(
            "digest", "keep_id", "group_size", F.when(F.col("batch") == batch, F.col("first")).alias("first")), "verdicts")
        return digests.join(verdicts, "digest").select(
            "doc_id", "keep_id", "group_size", F.col(ROW).eqNullSafe(F.col("first")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Verdict per document against ``index`` (a scratch one if none is given)."""
    if index is not None:
        return index.add(docs)
    own = DigestIndex(docs.sparkSession, buckets=partitions_for(docs))
    out = own.add(docs)
    own.close()
    return out

"""Input layout and intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Re-split an input that a plain scan would read in fewer partitions than the cluster can run at once (e.g. one
    large Parquet row group) before CPU-heavy per-row work such as tokenizing or embedding. Only the planned scan is
    looked at, no job runs; an input that was shuffled already is left alone (its layout is adaptive), and at scale a
    scan yields many more splits than cores."""
    sc = df.sparkSession.sparkContext
    try:
        plan = df._jdf.queryExecution().sparkPlan()
        if any(word in plan.toString() for word in ("Exchange", "Aggregate", "Join", "Window", "Sort")):
            return df
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no plan or RDD view (e.g. Spark Connect): leave the layout alone
        return df
    return df.repartition(sc.defaultParallelism * factor) if n < sc.defaultParallelism else df


def dealt(df: DataFrame, col: str, size: int, each: int, factor: int = 2) -> DataFrame:
    """``df`` of ``size`` bytes hash-partitioned by ``col`` for CPU-heavy work per row: ``factor`` × the cluster's parallelism
    partitions, or more where they would hold more than ``each`` bytes (the number is given, since a few megabytes of text
    would else be joined into one or two tasks)."""
    return df.repartition(max(factor * df.sparkSession.sparkContext.defaultParallelism, -(-size // each)), col)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, in the shared folder: every later reader sees the same rows, also after a lost executor."""
    from tessera.session import scratch_path
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Position of each row inside its key, and the previous row, without putting a key's rows into one task.

``Window.partitionBy(key)`` sends every row of a key to one task; a key holding a third of all rows becomes one
straggler. Here rows are range-partitioned on (key, order) — a hot key spans many partitions — and each row's
0-based rank inside its key is its offset in the partition plus the row counts of the key in earlier partitions
(a small per-(partition, key) table). The previous row is a ``lag`` inside the partition and, for a partition's first
row of a key, the last row that an earlier partition holds of it (one boundary row per partition and key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sorted_with_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, tagged with their partition id and a row id that grows
    with the sort order inside the partition. The result is stored once with a reliable checkpoint (in the
    shared checkpoint folder): the per-partition counts and the rows then read the very same partitions, even
    if a stage is retried after a lost executor or the range bounds would be sampled again."""
    from tessera.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    s = (df.repartitionByRange(*[F.col(c) for c in order])
         .sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    return s.checkpoint(eager=True)


def _join_partition(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join per-(partition, key) values to the rows; null keys match null keys."""
    side = small.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
                        *[c for c in small.columns if c not in (*keys, "_pid")])
    same = F.col("_pid") == F.col("_p")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(side, on=same, how="inner").drop("_p", *[f"_k{i}" for i in range(len(keys))])


def rank_within(df: DataFrame, keys: list[str], order: list[str], rank_col: str = "_rank") -> DataFrame:
    """``df`` plus ``rank_col``: 0-based position of the row inside its key by ``order`` (ties: any order)."""
    k = list(keys)
    s = sorted_with_ids(df, k + list(order))
    stats = s.groupBy("_pid", *k).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = (Window.partitionBy(*k) if k else Window.partitionBy(F.lit(0))).orderBy("_pid")
    stats = stats.withColumn("_before", F.sum("_cnt").over(w) - F.col("_cnt")).drop("_cnt")
    out = _join_partition(s, stats, k)
    return out.withColumn(rank_col, F.col("_before") + F.col("_mid") - F.col("_first")) \
        .drop("_pid", "_mid", "_first", "_before")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` + ``out``: running total of ``value`` inside each key in ``order`` (current row included). The sum
    of earlier partitions comes from the small per-(partition, key) totals; inside a partition the running sum is
    a window over (partition, key), so a hot key is summed by many tasks in parallel."""
    k = list(keys)
    s = sorted_with_ids(df, k + list(order))
    stats = s.groupBy("_pid", *k).agg(F.sum(value).alias("_psum"))
    w = (Window.partitionBy(*k) if k else Window.partitionBy(F.lit(0))).orderBy("_pid")
    stats = stats.withColumn("_before", F.sum("_psum").over(w) - F.col("_psum")).drop("_psum")
    inner = Window.partitionBy("_pid", *k).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    local = s.withColumn("_local", F.sum(value).over(inner))
    return (_join_partition(local, stats, k)
            .withColumn(out, F.col("_before") + F.col("_local"))
            .drop("_pid", "_mid", "_local", "_before"))


def _with_neighbour(df: DataFrame, keys: list[str], order: list[str], cols: list[str], prefix: str,
                    back: bool) -> DataFrame:
    """The neighbouring row's ``cols`` in the key: inside a partition by ``lag`` over (partition, key) — contiguous rows
    of a hot key lie in many partitions — and across partitions from one boundary row per (partition, key)."""
    k, step = list(keys), F.lag if back else F.lead
    s = sorted_with_ids(df, k + list(order))
    inner = Window.partitionBy("_pid", *k).orderBy("_mid")
    # the row that a partition hands to the next one holding the key: its last (or first) of the key
    edge = (F.max_by if back else F.min_by)(F.struct(*cols), "_mid")
    bounds = s.groupBy("_pid", *k).agg(edge.alias("_edge"))
    outer = (Window.partitionBy(*k) if k else Window.partitionBy(F.lit(0))).orderBy("_pid")
    bounds = bounds.select("_pid", *k, step("_edge").over(outer).alias("_across"))
    local = _join_partition(s.withColumn("_inside", step(F.struct(*cols)).over(inner)), bounds, k)
    near = F.coalesce(F.col("_inside"), F.col("_across"))
    return local.select(*df.columns, *[near[c].alias(prefix + c) for c in cols])


def with_previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str],
                  prefix: str = "prev_") -> DataFrame:
    """``df`` plus ``prev_<col>`` of the previous row in the key by ``order`` (null for the first row)."""
    return _with_neighbour(df, keys, order, cols, prefix, back=True)


def segments(df: DataFrame, keys: list[str], order: list[str], col: str, new_after: Column, out: str) -> DataFrame:
    """``df`` + ``out``: how many rows of the key up to this one begin a new segment. ``new_after`` says so from ``col`` and
    its value in the key's previous row, ``_before`` (null in the first row, which begins none). One sorted copy serves both
    steps: inside a partition by windows over (partition, key); across partitions by one row per (partition, key) with its
    first and last value and the number of segments begun inside, from which the rest follows."""
    k = list(keys)
    s = sorted_with_ids(df, k + list(order))
    inner = Window.partitionBy("_pid", *k).orderBy("_mid")
    flag = F.when(F.col("_before").isNull(), 0).when(new_after, 1).otherwise(0)
    marked = s.withColumn("_before", F.lag(col).over(inner)).withColumn("_new", flag).drop("_before")
    edges = marked.groupBy("_pid", *k).agg(F.min_by(col, "_mid").alias(col), F.max_by(col, "_mid").alias("_last"),
                                           F.sum("_new").alias("_begun"))
    outer = (Window.partitionBy(*k) if k else Window.partitionBy(F.lit(0))).orderBy("_pid")
    edges = (edges.withColumn("_before", F.lag("_last").over(outer)).withColumn("_first", flag)
             .withColumn("_sofar", F.sum(F.col("_begun") + F.col("_first")).over(outer) - F.col("_begun"))
             .select("_pid", *k, "_sofar"))
    local = marked.withColumn("_local", F.sum("_new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return (_join_partition(local, edges, k).withColumn(out, F.col("_sofar") + F.col("_local"))
            .select(*df.columns, out))


def with_next(df: DataFrame, keys: list[str], order: list[str], cols: list[str], prefix: str = "next_") -> DataFrame:
    """``df`` plus ``next_<col>`` of the next row in the key by ``order`` (null for the last row)."""
    return _with_neighbour(df, keys, order, cols, prefix, back=False)

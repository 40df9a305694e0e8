"""Exact interpolated percentiles (``percentile_cont``) that never put a whole group into one task.

Rows are first counted per (group, value), combined map-side: equal values collapse, however many rows hold them. The
counts are summed up in value order by the skew-safe running sum, and only the one or two values at the target ranks of
a group are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import running_sum


def counted_up(vals: DataFrame, group_cols: list[str]) -> DataFrame:
    """(group columns, _v, _c rows of the value, _upto rows up to and with it). ``vals`` is computed once (the sorted
    counts are stored), and group sizes are sums of the counts."""
    counts = vals.groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return running_sum(counts, list(group_cols), ["_v"], "_c", "_upto")


def value_at(upto: DataFrame, group_cols: list[str], targets: DataFrame, out: str) -> DataFrame:
    """Per group of ``targets`` (group columns, _k) the value at 0-based rank _k of ``counted_up`` rows."""
    same = F.lit(True)
    for i, c in enumerate(group_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    own = targets.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], "_k")
    inside = (F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c"))
    return upto.join(own, on=same, how="inner").where(inside).select(*group_cols, F.col("_v").alias(out))


def exact_percentile(df: DataFrame, group_cols: list[str], value_col: str, p: float = 0.5,
                     out: str = "percentile", with_count: str | None = None) -> DataFrame:
    """One row per group: ``out`` = percentile_cont(p) of the non-null values (double), optional row count."""
    g = list(group_cols)
    vals = df.select(*[F.col(c) for c in g], F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    upto = counted_up(vals, g)
    sizes = upto.groupBy(*g).agg(F.sum("_c").alias("_n"))
    pos = (F.col("_n") - 1) * F.lit(float(p))
    sizes = sizes.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(g)], "_n", F.floor(pos).alias("_klo"),
                         F.ceil(pos).alias("_khi"), (pos - F.floor(pos)).alias("_frac"))
    same = F.lit(True)
    for i, c in enumerate(g):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))

    def holds(k: str):
        return (F.col(k) < F.col("_upto")) & (F.col(k) >= F.col("_upto") - F.col("_c"))
    if g:
        near = upto.join(sizes, on=same, how="inner")
    else:
        near = upto.withColumns({c: sizes.select(c).scalar() for c in ("_n", "_klo", "_khi", "_frac")})
    agg = near.where(holds("_klo") | holds("_khi")).groupBy(*g).agg(
        F.max(F.when(holds("_klo"), F.col("_v"))).alias("_lo"), F.max(F.when(holds("_khi"), F.col("_v"))).alias("_hi"),
        F.max("_frac").alias("_frac"), F.max("_n").alias("_n"))
    res = agg.select(*g, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias(out), F.col("_n"))
    return res.withColumnRenamed("_n", with_count) if with_count else res.drop("_n")

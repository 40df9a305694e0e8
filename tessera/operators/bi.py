"""Dashboard aggregates: notice counts by month / modality / state / category / status / year, top organizations,
medians per year / region / state over the latest row per municipality and year, distinct reporting counts,
item-level counts with parent values added once, and deadline buckets.

Each function is one groupBy (partial aggregation map-side, one shuffle on the group key). Money is summed as
exact decimals so the result does not depend on partition order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.quantile import counted_up, exact_percentile, value_at

# Labels for missing categories.
NOT_INFORMED = "Not informed"
NOT_CLASSIFIED = "Not classified"

MONEY = "decimal(38,2)"


def money(col):
    """Double or decimal → 2 decimals, half away from zero. The value is first made an exact decimal with 10
    places, so engines that cast doubles differently still round the same number."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("decimal(38,10)"), 2).cast(MONEY)


def _money_sum(col: str):
    return F.round(F.sum(F.col(col).cast(MONEY)), 2).cast(MONEY)


def notices_by_month(df: DataFrame, ts: str = "published_at") -> DataFrame:
    return (df.where(F.col(ts).isNotNull())
            .groupBy(F.date_trunc("month", F.col(ts)).cast("date").alias("month"))
            .agg(F.count(F.lit(1)).alias("notices")))


def _count_by_label(df: DataFrame, col: str, label: str, out: str) -> DataFrame:
    return (df.groupBy(F.coalesce(F.col(col), F.lit(label)).alias(out))
            .agg(F.count(F.lit(1)).alias("notices")))


def notices_by_modality(df: DataFrame, col: str = "modality") -> DataFrame:
    return _count_by_label(df, col, NOT_INFORMED, "modality")


def notices_by_category(df: DataFrame, col: str = "category") -> DataFrame:
    return _count_by_label(df, col, NOT_CLASSIFIED, "category")


def notices_by_status(df: DataFrame, col: str = "status") -> DataFrame:
    return _count_by_label(df, col, NOT_INFORMED, "status")


def notices_by_uf(df: DataFrame, uf: str = "uf", value: str = "estimated_value") -> DataFrame:
    return (df.where(F.col(uf).isNotNull()).groupBy(F.col(uf).alias("uf"))
            .agg(F.count(F.lit(1)).alias("notices"), _money_sum(value).alias("estimated_value")))


def value_by_year(df: DataFrame, year: str = "purchase_year", value: str = "estimated_value") -> DataFrame:
    return (df.where(F.col(year).isNotNull()).groupBy(F.col(year).alias("year"))
            .agg(F.count(F.lit(1)).alias("notices"), _money_sum(value).alias("estimated_value")))


def top_organizations(df: DataFrame, col: str = "organization", k: int = 25) -> DataFrame:
    """The k most frequent names; ties broken by name so the cut is deterministic (TakeOrderedAndProject:
    each partition keeps its own top k, only k rows per partition reach the final merge)."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("organization"))
            .agg(F.count(F.lit(1)).alias("notices"))
            .orderBy(F.col("notices").desc(), F.col("organization").asc()).limit(k))


def latest_per_key(df: DataFrame, keys: list[str], order: str, tiebreak: str) -> DataFrame:
    """One row per key: the highest ``order`` with NULL counting as highest (row-store DESC puts NULL first);
    equal orders → highest ``tiebreak``. An aggregate (``max_by`` over an ordering struct), not a window: rows are
    combined map-side, so a key holding a third of all rows never lands whole in one task."""
    rest = [c for c in df.columns if c not in keys]
    rank_key = F.struct(F.col(order).isNull().alias("_n"), F.col(order).alias("_o"), F.col(tiebreak).alias("_t"))
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), rank_key).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def median_by_year(latest: DataFrame, year: str = "yr", value: str = "amount") -> DataFrame:
    m = exact_percentile(latest, [year], value, 0.5, out="_m", with_count="municipalities")
    return m.select(F.col(year).cast("string").alias("year"),
                    money("_m").alias("median_value"),
                    "municipalities")


def _median_for_year(latest: DataFrame, group: str, out: str, year_col: str, year: int, value: str) -> DataFrame:
    m = exact_percentile(latest.where(F.col(year_col) == year), [group], value, 0.5, out="_m")
    return m.select(F.col(group).alias(out), money("_m").alias("median_value"))


def median_by_region(latest: DataFrame, year: int, region: str = "region", year_col: str = "yr",
                     value: str = "amount") -> DataFrame:
    return _median_for_year(latest, region, "region", year_col, year, value)


def median_by_uf(latest: DataFrame, year: int, uf: str = "uf", year_col: str = "yr",
                 value: str = "amount") -> DataFrame:
    return _median_for_year(latest, uf, "uf", year_col, year, value)


def reporting_by_year(df: DataFrame, year: str = "yr", entity: str = "municipality",
                      approximate: bool = False) -> DataFrame:
    """Distinct entities per year. Exact form is rewritten by Catalyst into a two-level aggregate
    (year, entity) → year, so no per-group set is held; ``approximate`` uses HyperLogLog++ instead."""
    agg = F.approx_count_distinct(entity) if approximate else F.countDistinct(entity)
    return df.groupBy(F.col(year).cast("string").alias("year")).agg(agg.alias("municipalities_reporting"))


def parent_value_once(items: DataFrame, parent_key: str, value: str, group: str) -> DataFrame:
    """Item-level table: count items, count parents, add each parent's value once. Parents are deduplicated by
    key (one shuffle on the parent key) before the value is summed."""
    per_parent = (items.groupBy(group, parent_key)
                  .agg(F.count(F.lit(1)).alias("_items"), F.max(F.col(value).cast(MONEY)).alias("_value")))
    return (per_parent.groupBy(group)
            .agg(F.sum("_items").alias("items"), F.count(F.lit(1)).alias("parents"),
                 F.sum("_value").cast(MONEY).alias("value")))


def deadline_counts(df: DataFrame, ts: str, grain: str = "month") -> DataFrame:
    """Rows without a deadline are left out, not put in a bucket."""
    return (df.where(F.col(ts).isNotNull())
            .groupBy(F.date_trunc(grain, F.col(ts)).cast("date").alias(grain))
            .agg(F.count(F.lit(1)).alias("rows")))


def size_by_group(df: DataFrame, group: str, value: str, total_label: str = "total") -> DataFrame:
    """Size per group plus one total row (rollup), largest first."""
    r = df.rollup(group).agg(F.sum(F.col(value)).cast("bigint").alias("bytes"))
    return r.select(F.coalesce(F.col(group).cast("string"), F.lit(total_label)).alias("name"), "bytes") \
        .orderBy(F.col("bytes").desc(), F.col("name"))


def size_by_db(df: DataFrame, group: str, value: str) -> DataFrame:
    """Size per database, largest first, with a total row."""
    return size_by_group(df, group, value)


def cache_hit_ratio(df: DataFrame, hit: str, read: str, digits: int = 2) -> DataFrame:
    """100·hit/(hit+read) over all rows; 100 when there is nothing to divide."""
    h, r = F.sum(F.col(hit)), F.sum(F.col(read))
    pct = F.round(F.try_divide(F.lit(100.0) * h, (h + r).cast("double")), digits)
    return df.agg(F.coalesce(pct, F.lit(100.0)).alias("hit_pct"))


def nearest_rank_p95(df: DataFrame, group: str, value: str, ok: str, p: float = 0.95) -> DataFrame:
    """Successful rows per group and the value at 0-based index int(n·p)−1 of the sorted successful values
    (index −1 means the last one, as a Python list would read it; null values count as rows and sort first). Equal values
    are counted before they are sorted, so neither a big group nor a value that very many rows hold is sorted in one task;
    the sizes of the groups are the sums of those counts."""
    okd = df.where(F.col(ok)).select(F.col(group), F.col(value).cast("double").alias("_v"))
    upto = counted_up(okd, [group])
    sizes = upto.groupBy(group).agg(F.sum("_c").alias("ok_rows"))
    idx = F.floor(F.col("ok_rows") * F.lit(p)).cast("long") - 1
    targets = sizes.withColumn("_k", F.when(idx < 0, F.col("ok_rows") - 1).otherwise(idx))
    picked = value_at(upto, [group], targets, "p95").withColumnRenamed(group, "_g")
    return targets.join(picked, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "ok_rows", "p95")

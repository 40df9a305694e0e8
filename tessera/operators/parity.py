"""Two tables compared by bucket before row by row.

Keys are dealt into buckets by their hash; of each bucket the number of rows, the sum and the exclusive or of the row hashes
are taken, whatever the order. Buckets whose sums agree hold the same rows. The others are divided again, level by level,
while that still sorts out most of them, and only the rows of the buckets left are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import broadcast_checked, table_diff
from tessera.operators.layout import written_once

FAN, LEVELS = 1024, 3
#: Buckets are divided again while at most this share of them differs.
SPARSE = 0.25


def _row_hash(columns: list[str]) -> Column:
    """64 bits of a row; a null differs from every value and from a null elsewhere."""
    return F.xxhash64(*columns, F.concat(*[F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")) for c in columns]))


def bucket_of(keys: list[str], level: int) -> Column:
    """Bucket of a key at a level; each level has a hash of its own."""
    return F.pmod(F.xxhash64(*keys, F.lit(level)), F.lit(FAN)).cast("int")


def bucket_sums(df: DataFrame, keys: list[str], values: list[str], by: list[str]) -> DataFrame:
    """(bucket columns, n, sum, xor) of ``df``: one scan, combined map-side, at most FAN rows per bucket above."""
    h = _row_hash([*keys, *values])
    return df.withColumn("_h", h).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_h").cast("decimal(38,0)"))
                                                   .alias("sum"), F.bit_xor("_h").alias("xor"))


def differing_buckets(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], levels: int = LEVELS) -> tuple:
    """(stored bucket table, its columns) of the buckets that differ at the finest level looked at; (None, []) if the
    tables are equal."""
    by: list[str] = []
    narrowed = None
    for level in range(levels):
        by = [*by, f"_b{level}"]
        sums = []
        for side in (left, right):
            own = _with_buckets(side, keys, by)
            if narrowed is not None:
                own = own.join(broadcast_checked(narrowed), by[:-1], "left_semi")
            sums.append(bucket_sums(own, keys, values, by))
        a, b = (s.select(*by, F.struct("n", "sum", "xor").alias(c)) for s, c in zip(sums, ("_a", "_b")))
        both = written_once(a.join(b, by, "full_outer").select(
            *by, F.col("_a").eqNullSafe(F.col("_b")).alias("same")), "bucket-parity")
        counts = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("same")).alias("differ")).first()
        narrowed = both.where(~F.col("same")).select(*by)
        if not counts["differ"]:
            return None, []
        if counts["differ"] > SPARSE * counts["n"]:
            break
    return narrowed, by


def _with_buckets(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    return df.withColumns({c: bucket_of(keys, int(c[2:])) for c in by})


def table_parity(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], levels: int = LEVELS) -> DataFrame:
    """The rows of ``table_diff`` (keys unique and not null on each side): keys of equal buckets are ``match`` without a
    join, and the full outer join runs inside the differing buckets only."""
    differ, by = differing_buckets(left, right, keys, values, levels)
    if differ is None:
        return left.select(*keys, F.lit("match").alias("status"))
    small = broadcast_checked(differ)
    a, b = _with_buckets(left, keys, by), _with_buckets(right, keys, by)
    joined = table_diff(a.join(small, by, "left_semi"), b.join(small, by, "left_semi"), keys, values)
    same = a.join(small, by, "left_anti").select(*keys, F.lit("match").alias("status"))
    return joined.unionByName(same)

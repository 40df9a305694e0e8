"""Sorts, limits and top-k: dashboard cards, chart series, newest comments per article, cheapest offer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _orderings(order):
    out = []
    for c, d in order:
        col = F.col(c)
        out.append(col.desc_nulls_last() if d == "desc" else col.asc_nulls_last())
    return out


def card_topk(view_df: DataFrame, columns: list[str], order: list[tuple[str, str]], k: int | None = None) -> DataFrame:
    """Card query: selected columns, explicit order with a tie-break, optional limit (TakeOrderedAndProject)."""
    out = view_df.select(*columns).orderBy(*_orderings(order))
    return out.limit(k) if k else out


def card_series(view_df: DataFrame, columns: dict[str, str | None], order: list[tuple[str, str]]) -> DataFrame:
    """Ordered chart series; columns mapped to a type (e.g. year shown as text) or kept as they are."""
    cols = [F.col(c).cast(t).alias(c) if t else F.col(c) for c, t in columns.items()]
    return view_df.select(*cols).orderBy(*_orderings(order))


def recent_comments(df: DataFrame, slug: str = "slug", ts: str = "created_at", id_col: str = "id",
                    n: int = 200) -> DataFrame:
    """Newest ``n`` comments per article (created_at desc, id desc) with their rank."""
    return recent_per_key(df, slug, ts, id_col, n)


def recent_per_key(df: DataFrame, key: str, ts: str, id_col: str, n: int = 200) -> DataFrame:
    """Newest ``n`` rows per key (ts desc, id desc) with their rank.

    A window partitioned by key: every key's rows are sorted in one task, but ``row_number <= n`` lets Spark use
    a group limit (WindowGroupLimit) before the shuffle, so each map task forwards at most ``n`` rows per key —
    a hot key costs n rows per map task, not all its rows."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(id_col).desc())
    return (df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .withColumn("rank", F.col("rank").cast("bigint")))

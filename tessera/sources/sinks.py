"""Sinks: full refresh of a table or Parquet folder, stored aggregates and aggregates over them, the JSON divergence
report, and insert-if-absent. A refresh takes the place of the old rows in one step when it is complete (``versions``)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.versions import read_refreshed, write_version, write_version_table


def _is_path(name_or_path: str) -> bool:
    return "/" in name_or_path or ":" in name_or_path


def full_refresh_sink(df: DataFrame, name_or_path: str, partition_by: Iterable[str] = ()) -> None:
    """Replace the target: a catalog name (``db.table``, a view over its current version) or a folder (read it with
    ``read_refreshed``). The new rows are written whole beside the old ones and take their place in one step, so a job
    that breaks off anywhere leaves the old rows or the new ones (``df`` may read the target itself). Column comments in
    field metadata are kept by the catalog form."""
    if _is_path(name_or_path):
        write_version(df, name_or_path, list(partition_by))
    else:
        write_version_table(df, name_or_path, list(partition_by))


def materialize_view(df: DataFrame, name_or_path: str) -> DataFrame:
    """A named aggregate recomputed by full refresh only; returns the stored result for reuse."""
    full_refresh_sink(df, name_or_path)
    spark = df.sparkSession
    return read_refreshed(spark, name_or_path) if _is_path(name_or_path) else spark.table(name_or_path)


@dataclass(frozen=True)
class View:
    """A stored aggregate: ``build`` gets the frames of ``parents`` (other views, or sources) by name."""

    name: str
    parents: tuple[str, ...]
    build: Callable[[dict[str, DataFrame]], DataFrame]


def refresh_views(spark: SparkSession, views: Iterable[View], sources: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Refresh the views below ``root``, parents first. A view that several others read is computed and stored once; they
    read the stored rows. A view that fails keeps its old rows, and the views above it are left as they are. Returns what
    became of each: ``refreshed``, ``failed: …`` or ``skipped: <parent>``."""
    by_name = {v.name: v for v in views}
    unknown = {p for v in by_name.values() for p in v.parents} - set(by_name) - set(sources)
    if unknown or set(by_name) & set(sources):
        raise ValueError(f"unknown parents {sorted(unknown)}, or views named as sources are")
    order = TopologicalSorter({n: [p for p in v.parents if p in by_name] for n, v in by_name.items()}).static_order()
    out: dict[str, str] = {}
    for name in order:  # a cycle is an error before anything is written
        view = by_name[name]
        broken = [p for p in view.parents if p in by_name and out[p] != "refreshed"]
        if broken:
            out[name] = f"skipped: {broken[0]}"
            continue
        frames = {p: read_refreshed(spark, f"{root}/{p}") if p in by_name else sources[p] for p in view.parents}
        try:
            full_refresh_sink(view.build(frames), f"{root}/{name}")
            out[name] = "refreshed"
        except Exception as exc:  # noqa: BLE001 - one view's failure is reported, the others go on
            out[name] = f"failed: {type(exc).__name__}: {exc}"
    return out


def insert_if_absent(target_df: DataFrame, new_df: DataFrame, keys: list[str],
                     order: list[str] | None = None) -> DataFrame:
    """Rows of ``new_df`` whose key is not in ``target_df`` are added (ON CONFLICT DO NOTHING). Of new rows that share a
    key the first by the columns ``order`` is added (by all other columns if none are given)."""
    fresh = new_df.join(target_df.select(*keys), on=keys, how="left_anti")
    rest = [c for c in new_df.columns if c not in keys]
    by = list(order or rest)
    if by:
        first = F.min_by(F.struct(*rest) if rest else F.lit(None), F.struct(*by))
        fresh = fresh.groupBy(*keys).agg(first.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    else:
        fresh = fresh.distinct()
    return target_df.unionByName(fresh)


def report_frame(divergences: DataFrame, orders: DataFrame, now: Column | str,
                 account_col: str = "account", products: DataFrame | None = None,
                 kind_col: str = "kind") -> DataFrame:
    """The report header as one row: time, order count per account, divergence count per kind, products read.

    Counts are aggregated on executors and only the per-account / per-kind maps (bounded by the number of
    accounts and kinds) meet in one row. The divergences themselves are never gathered: ``report_sink`` writes
    them as distributed JSON lines next to the header."""
    now_c = F.lit(now) if isinstance(now, str) else now
    counts = (orders.groupBy(account_col).agg(F.count(F.lit(1)).alias("n"))
              .agg(F.map_from_entries(F.collect_list(F.struct(F.col(account_col), F.col("n")))).alias("orders")))
    kinds = (divergences.groupBy(kind_col).agg(F.count(F.lit(1)).alias("n"))
             .agg(F.map_from_entries(F.collect_list(F.struct(F.col(kind_col), F.col("n"))))))
    cols = [now_c.cast("string").alias("at"), "orders", kinds.scalar().alias("divergences")]   # scalar subqueries
    if products is not None:
        cols.append(products.agg(F.sort_array(F.collect_set("product"))).scalar().alias("products_read"))
    return counts.select(*cols)


def report_sink(divergences: DataFrame, orders: DataFrame, path: str, now: str,
                products: DataFrame | None = None) -> DataFrame:
    """Write ``path/divergences`` (one JSON line per divergence, evaluated once) and ``path/header`` (one JSON line,
    counted from the written divergences); returns the stored header."""
    spark = divergences.sparkSession
    divergences.write.mode("overwrite").json(f"{path}/divergences")
    stored = spark.read.schema(divergences.schema).json(f"{path}/divergences")
    rep = report_frame(stored, orders, now, products=products)
    rep.coalesce(1).write.mode("overwrite").json(f"{path}/header")
    return spark.read.schema(rep.schema).json(f"{path}/header")


def report_rows(header: DataFrame) -> DataFrame:
    """The header as flat rows (section, name, n): orders per account, divergences per kind, products read."""
    parts = [header.select(F.lit(c).alias("section"), F.explode(c).alias("name", "n"))
             for c in ("orders", "divergences") if c in header.columns]
    if "products_read" in header.columns:
        parts.append(header.select(F.lit("products_read").alias("section"), F.explode("products_read").alias("name"),
                                   F.lit(1).cast("bigint").alias("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

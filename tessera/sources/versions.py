"""Whole outputs that switch in one step.

A folder target keeps its rows in version folders; a version counts once its marker exists, and the newest marked version is
the current one. A catalog target is a view over the newest version table. In both forms a version is written whole, then
made current by one step (an empty file, one catalog statement), and only then are versions older than the one before
removed: whatever breaks off, readers find the old rows or the new ones, and a reader still under way keeps its files. A
target has one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.folders import Folder

PREFIX, MARK = "version-", "_PUBLISHED"
#: Current version and the one before it, which readers may still hold.
KEPT = 2


def published(spark: SparkSession, target: str) -> list[str]:
    """Names of the published versions of a folder, oldest first."""
    at = target.rstrip("/")
    return [n for n in Folder(spark, at).names() if n.startswith(PREFIX) and Folder(spark, f"{at}/{n}/{MARK}").exists()]


def read_refreshed(spark: SparkSession, target: str, schema=None) -> DataFrame:
    """The current rows of a folder target (of a plain Parquet folder if it holds no versions)."""
    have = published(spark, target)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{target.rstrip('/')}/{have[-1]}" if have else target)


def write_version(df: DataFrame, target: str, partition_by: list[str]) -> None:
    """Write the rows as a new version, publish it, remove what is no longer needed (also what an earlier writer left
    unpublished)."""
    spark, at = df.sparkSession, target.rstrip("/")
    last = published(spark, at)
    serial = int(last[-1].split("-")[1]) + 1 if last else 1
    name = f"{PREFIX}{serial:012d}-{uuid.uuid4().hex[:8]}"
    df.write.partitionBy(*partition_by).parquet(f"{at}/{name}")
    Folder(spark, f"{at}/{name}/{MARK}").touch()
    keep = set(published(spark, at)[-KEPT:])
    for n in Folder(spark, at).names():
        if n.startswith(PREFIX) and n not in keep and int(n.split("-")[1]) <= serial:
            Folder(spark, f"{at}/{n}").remove()


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def version_tables(spark: SparkSession, name: str) -> list[str]:
    """Version tables of a catalog target, oldest first."""
    db, _, table = name.rpartition(".")
    where = f"IN {db} " if db else ""
    rows = spark.sql(f"SHOW TABLES {where}LIKE '{table.lower()}__v*'").collect()
    return [f"{db}.{r['tableName']}" if db else r["tableName"] for r in sorted(rows, key=lambda r: r["tableName"])]


def write_version_table(df: DataFrame, name: str, partition_by: list[str]) -> None:
    """The same for a catalog target. Column comments and the table comment (field metadata) go with the view."""
    spark = df.sparkSession
    have = version_tables(spark, name)
    serial = int(have[-1].rsplit("__v", 1)[1].split("_")[0]) + 1 if have else 1
    fresh = f"{name}__v{serial:09d}_{uuid.uuid4().hex[:8]}"
    df.write.format("parquet").partitionBy(*partition_by).saveAsTable(fresh)
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        # a table from before versions: it becomes the oldest one (the only time that the name is away for a moment)
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}__v{0:09d}_{uuid.uuid4().hex[:8]}")
    comments = {f.name: (f.metadata or {}).get("comment") for f in df.schema.fields}
    columns = ", ".join(f"`{f}`" + (f" COMMENT {_literal(c)}" if c else "") for f, c in comments.items())
    table_comment = next((f.metadata["table_comment"] for f in df.schema.fields
                          if f.metadata and f.metadata.get("table_comment")), None)
    about = f" COMMENT {_literal(table_comment)}" if table_comment else ""
    order = ", ".join(f"`{c}`" for c in df.columns)
    spark.sql(f"CREATE OR REPLACE VIEW {name} ({columns}){about} AS SELECT {order} FROM {fresh}")
    for old in [t for t in version_tables(spark, name) if t <= fresh.lower()][:-KEPT]:
        spark.sql(f"DROP TABLE IF EXISTS {old}")

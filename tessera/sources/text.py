"""Text and semi-structured sources: metric exposition lines, usage reports, KEY=value files, tab-separated
lists, JSON-lines ledgers and landed JSON orders. All parsing is JVM-side regex / split on DataFrames read with
``spark.read.text`` / ``csv`` / ``json`` (explicit schemas, no inference pass)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Exposition line pattern (name, optional {labels}, value) and the object-store listing line.
METRIC_LINE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{[^}]*\})? ([0-9.e+]+)$"
BUCKET_LINE = r"^(\S+)\s+(\d+) objects?\s+(\S*)"
# Usage-report tenant prefix and block size.
TENANT_PREFIX = "rt_"
BLOCK_BYTES = 1024
# A key is letters / digits once the underscores are taken out (and not empty).
KEY_PATTERN = r"^_*[\p{L}\p{N}][\p{L}\p{N}_]*$"


def parse_metric_text(lines_df: DataFrame, line: str = "value") -> DataFrame:
    """Exposition lines → (metric, labels, value); lines that do not match are left out."""
    m = F.col(line)
    out = lines_df.select(F.regexp_extract(m, METRIC_LINE, 1).alias("metric"),
                          F.regexp_extract(m, METRIC_LINE, 2).alias("labels"),
                          F.regexp_extract(m, METRIC_LINE, 3).alias("_v"))
    return (out.where(F.col("metric") != "")
            .select("metric", F.when(F.col("labels") == "", None).otherwise(F.col("labels")).alias("labels"),
                    F.col("_v").try_cast("double").alias("value")))


def sum_metrics(parsed: DataFrame) -> DataFrame:
    """Total per metric over all label sets (partial sums map-side)."""
    return parsed.groupBy("metric").agg(F.sum("value").alias("total"))


def parse_bucket_listing(lines_df: DataFrame, line: str = "value") -> DataFrame:
    """'<size> <n> objects <bucket>' lines → (bucket, size, objects); lines without a bucket name are skipped."""
    m = F.regexp_replace(F.col(line), "\t", " ")
    out = lines_df.select(F.regexp_extract(m, BUCKET_LINE, 3).alias("bucket"),
                          F.regexp_extract(m, BUCKET_LINE, 1).alias("size"),
                          F.regexp_extract(m, BUCKET_LINE, 2).alias("_n"))
    return out.where(F.col("bucket") != "").select("bucket", "size", F.col("_n").cast("long").alias("objects"))


def parse_usage_report(lines_df: DataFrame, prefix: str = TENANT_PREFIX, line: str = "value") -> DataFrame:
    """Whitespace-split report lines with at least 4 fields whose first field has the tenant prefix →
    (tenant, used_bytes, hard_bytes); counts are 1 KiB blocks."""
    parts = F.split(F.regexp_replace(F.col(line), r"^\s+|\s+$", ""), r"\s+")
    p = lines_df.select(parts.alias("p"))
    p = p.where((F.size("p") >= 4) & F.col("p")[0].startswith(prefix))
    return p.select(F.substring(F.col("p")[0], len(prefix) + 1, 1 << 30).alias("tenant"),
                    (F.col("p")[1].try_cast("long") * BLOCK_BYTES).alias("used_bytes"),
                    (F.col("p")[3].try_cast("long") * BLOCK_BYTES).alias("hard_bytes"))


def parse_key_values(lines_df: DataFrame, line_no_col: str, line: str = "value") -> DataFrame:
    """KEY=value lines → (key, value). Blank lines, comments ('#') and lines without '=' are skipped; the line is
    split at the first '='; the key is trimmed and must be letters/digits/underscores; the value is kept as is;
    for a repeated key the last line wins (``max_by`` over the line number, combined map-side)."""
    ln = F.col(line)
    ok = (F.trim(ln) != "") & ~F.regexp_replace(ln, r"^\s+", "").startswith("#") & (F.instr(ln, "=") > 0)
    kv = lines_df.where(ok).select(
        F.col(line_no_col).alias("_ln"),
        F.regexp_replace(F.substring_index(ln, "=", 1), r"^\s+|\s+$", "").alias("key"),
        F.expr(f"substr(`{line}`, instr(`{line}`, '=') + 1)").alias("value"))
    kv = kv.where(F.col("key").rlike(KEY_PATTERN))
    return kv.groupBy("key").agg(F.max_by("value", "_ln").alias("value"))


# The site list columns (tab separated, no header).
SITES_SCHEMA = T.StructType([T.StructField("website_id", T.StringType()), T.StructField("name", T.StringType()),
                             T.StructField("domain", T.StringType())])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = SITES_SCHEMA) -> DataFrame:
    """Tab-separated rows with a fixed schema; rows with a blank first field are skipped."""
    df = spark.read.csv(path, sep="\t", schema=schema, header=False)
    first = schema.fields[0].name
    return df.where(F.col(first).isNotNull() & (F.trim(F.col(first)) != ""))


@dataclass(frozen=True)
class ParsedLines:
    """What a reader of JSON lines has found: ``rows`` with the asked fields, and ``unreadable`` lines as (file, line,
    reason). Every line that is not blank is in one of the two."""

    rows: DataFrame
    unreadable: DataFrame


def read_json_lines(spark: SparkSession, path: str, fields: dict[str, str], required: tuple[str, ...] = ()) -> ParsedLines:
    """JSON lines with ``fields`` (name → type). A line is unreadable if it is not JSON, not an object, lacks a
    ``required`` field, or holds a value that is not of its field's type; the others are not touched by it. Lines are
    parsed into variants, so a field may be a scalar in one line and an object in the next (``scalar_or_member``)."""
    lines = (spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
             .where(F.trim("line") != "").withColumn("v", F.try_parse_json("line")))
    reason = F.when(F.col("v").isNull(), F.lit("not JSON")).when(
        ~F.schema_of_variant("v").startswith("OBJECT"), F.lit("not an object"))
    for name, kind in fields.items():
        raw = F.try_variant_get("v", f"$.{name}", "variant")
        there = raw.isNotNull() & ~F.is_variant_null(raw)
        if name in required:
            reason = reason.when(~there, F.lit(f"{name}: missing"))
        if kind != "variant":
            reason = reason.when(there & F.try_variant_get("v", f"$.{name}", kind).isNull(), F.lit(f"{name}: not a {kind}"))
    judged = lines.withColumn("reason", reason)
    rows = judged.where(F.col("reason").isNull()).select(
        *[F.try_variant_get("v", f"$.{name}", kind).alias(name) for name, kind in fields.items()])
    return ParsedLines(rows, judged.where(F.col("reason").isNotNull()).select("file", "line", "reason"))


def scalar_or_member(value: Column | str, member: str) -> Column:
    """Text of a variant that is either a scalar or an object with ``member``; null for an object without it."""
    inside = F.schema_of_variant(value).startswith("OBJECT")
    return F.when(inside, F.try_variant_get(value, f"$.{member}", "string")).otherwise(F.try_variant_get(value, "$", "string"))


LEDGER_FIELDS = {"key": "string", "status": "string", "seq": "bigint"}


def read_ledger_lines(spark: SparkSession, path: str) -> ParsedLines:
    """The ledger with its unreadable lines apart: a line cut short by a crash costs that line only."""
    return read_json_lines(spark, path, LEDGER_FIELDS, required=("key",))


LEDGER_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("status", T.StringType()),
                              T.StructField("seq", T.LongType())])


def read_ledger(spark: SparkSession, path: str, schema: T.StructType = LEDGER_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


ORDER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("refId", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("product", T.StringType()),      # scalar or object: kept as JSON text
    T.StructField("product_name", T.StringType()),
    T.StructField("customer", T.StructType([T.StructField("email", T.StringType())])),
    T.StructField("subscription", T.StringType()), T.StructField("subscription_id", T.StringType()),
    T.StructField("parent_order", T.StringType()),
    T.StructField("orders", T.ArrayType(T.StringType())),
])


def read_json_orders(spark: SparkSession, dirs: dict[str, str], kind: str = "order",
                     schema: T.StructType = ORDER_SCHEMA) -> DataFrame:
    """Landed order files of several accounts → (account, kind, order fields…, product_is_object,
    product_name resolved from the product object or the flat field). Scalar-or-object fields are read as JSON
    text (a string field keeps the raw JSON of an object) and resolved with ``get_json_object``."""
    out = None
    for account, path in dirs.items():
        df = spark.read.schema(schema).json(path)
        df = df.withColumn("account", F.lit(account)).withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    prod = F.col("product")
    is_obj = F.coalesce(F.trim(prod).startswith("{"), F.lit(False))

    def filled(c):      # an empty id or name falls through to the next field
        return F.nullif(c, F.lit(""))
    name = F.coalesce(filled(F.when(is_obj, F.get_json_object(prod, "$.name"))), F.col("product_name"))
    return out.select("account", "kind", F.coalesce(filled(F.col("id")), F.col("refId")).alias("order_id"),
                      "status", is_obj.alias("product_is_object"), name.alias("product_name"),
                      F.col("customer.email").alias("email"), "subscription", "subscription_id", "parent_order",
                      "orders")

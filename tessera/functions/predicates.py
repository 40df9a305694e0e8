"""Filters and projections: null guards, default labels, filters given as data, derived prices, night windows,
status classes, nested output records, monitor rules, comment moderation and key formats."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status sets of the payment provider (compared after lower-casing).
PAID_STATUSES = ("paid", "approved", "authorized", "active", "completed")
RETURNED_STATUSES = ("refunded", "chargedback", "chargeback", "canceled", "cancelled", "refused")

# Storage price rule (GB charged per offer, hours per month).
STORAGE_GB = 50
HOURS_PER_MONTH = 720

# Comment moderation limits and key formats.
NAME_MIN, NAME_MAX = 1, 60
BODY_MIN, BODY_MAX = 2, 2000
MAX_LINKS = 2
SLUG_PATTERN = r"^[a-z0-9][a-z0-9-]{2,90}$"
VOTER_PATTERN = r"^[a-f0-9-]{16,64}$"


def filter_not_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return df.filter(cond)


def default_label(df: DataFrame, col: str, label: str) -> DataFrame:
    """Null → ``label`` (empty strings are kept as they are)."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(label)))


def filter_conjunction(df: DataFrame, equals: dict, positive: str | None = None) -> DataFrame:
    conds = [F.col(k) == F.lit(v) for k, v in equals.items()]
    if positive:
        conds.append(F.col(positive) > 0)
    return df.filter(reduce(lambda a, b: a & b, conds))


_OPS = {
    "eq": lambda c, v: c == F.lit(v),
    "neq": lambda c, v: c != F.lit(v),
    "in": lambda c, v: c.isin(list(v)),
    "gte": lambda c, v: c >= F.lit(v),
    "gt": lambda c, v: c > F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
}


def spec_condition(spec: dict[str, dict]) -> Column:
    """``{col: {op: value}}`` → one conjunctive Column (pushed to the scan like any literal filter)."""
    conds = []
    for col, ops in spec.items():
        for op, v in ops.items():
            if op not in _OPS:
                raise ValueError(f"unknown filter op {op!r}")
            conds.append(_OPS[op](F.col(col), v))
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def filter_spec(df: DataFrame, spec: dict[str, dict]) -> DataFrame:
    return df.filter(spec_condition(spec))


def price_expr(base: str, storage: str, gb: float = STORAGE_GB, hours: float = HOURS_PER_MONTH) -> Column:
    return (F.coalesce(F.col(base), F.lit(0.0)) + F.coalesce(F.col(storage), F.lit(0.0)) * F.lit(gb) / F.lit(hours))


def derived_price(df: DataFrame, base: str, storage: str, gb: float = STORAGE_GB,
                  hours: float = HOURS_PER_MONTH) -> DataFrame:
    """price = base + storage × gb / hours, nulls as 0."""
    return df.withColumn("price", price_expr(base, storage, gb, hours))


def night_window(df: DataFrame, ts: str, offset_hours: int = -3, start: int = 0, end: int = 6) -> DataFrame:
    """is_night: local hour (UTC + offset) in [start, end)."""
    local_hour = F.hour(F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(offset_hours)))
    return df.withColumn("is_night", (local_hour >= start) & (local_hour < end))


def status_class_expr(col: Column, paid: Sequence[str] = PAID_STATUSES,
                      returned: Sequence[str] = RETURNED_STATUSES) -> Column:
    s = F.lower(F.coalesce(col.cast("string"), F.lit("")))
    return F.when(s.isin(list(paid)), F.lit("paid")).when(s.isin(list(returned)), F.lit("returned")) \
        .otherwise(F.lit("ignore"))


def status_class(df: DataFrame, col: str, paid: Sequence[str] = PAID_STATUSES,
                 returned: Sequence[str] = RETURNED_STATUSES) -> DataFrame:
    return df.withColumn("status_class", status_class_expr(F.col(col), paid, returned))


def valid_key_format(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.withColumn("valid", F.coalesce(F.col(col).rlike(pattern), F.lit(False)))


# Every Unicode space, and the four separators that count as spaces when a text is split into words.
ANY_SPACE = r"(?U:[\s\x1c-\x1f])"


def moderate_comments(df: DataFrame, name: str = "name", body: str = "body", honeypot: str | None = None,
                      max_links: int = MAX_LINKS, name_len=(NAME_MIN, NAME_MAX),
                      body_len=(BODY_MIN, BODY_MAX)) -> DataFrame:
    """Comment intake rules, in order: raw name / body length outside the limits → rejected; honeypot filled →
    dropped without error (``accepted`` true, ``stored`` false); name with white-space runs collapsed and
    trimmed, body trimmed; empty name or body shorter than 2 → rejected; more than ``max_links`` http(s) links →
    rejected. Adds clean_name, clean_body, links, reason, accepted, stored."""
    raw_n, raw_b = F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(body), F.lit(""))
    n = F.regexp_replace(F.regexp_replace(raw_n, f"{ANY_SPACE}+", " "), r"^ | $", "")
    b = F.regexp_replace(raw_b, f"^{ANY_SPACE}+|{ANY_SPACE}+$", "")
    links = F.regexp_count(b, F.lit(r"https?://"))
    hp = F.lit(False) if honeypot is None else (F.coalesce(F.length(F.col(honeypot)), F.lit(0)) > 0)
    reason = (F.when((F.length(raw_n) < name_len[0]) | (F.length(raw_n) > name_len[1]), F.lit("name_length"))
              .when((F.length(raw_b) < body_len[0]) | (F.length(raw_b) > body_len[1]), F.lit("body_length"))
              .when(hp, F.lit("honeypot"))
              .when((F.length(n) == 0) | (F.length(b) < 2), F.lit("required"))
              .when(links > max_links, F.lit("too_many_links")))
    return (df.withColumn("clean_name", n).withColumn("clean_body", b)
            .withColumn("links", links.cast("int"))
            .withColumn("reason", reason)
            .withColumn("accepted", reason.isNull() | (reason == "honeypot"))
            .withColumn("stored", reason.isNull()))


# Record kinds that get an admin link and the status page every record links to.
ADMIN_KINDS = ("product", "variant", "testing")


def nested_projection(registry_df: DataFrame, sources_df: DataFrame, service: str = "service",
                      monitor_url: str = "https://status.example.org/") -> DataFrame:
    """Registry record → output record with a struct of links, each present only where its source exists: product
    and admin from the first host (admin only for some kinds), repository / readme / release from the repository,
    deploy only when the service has a release source (left join on a deduplicated source list)."""
    src = sources_df.select(F.col(service).alias("_svc")).where(F.col("_svc").isNotNull()).distinct()
    j = registry_df.join(src, registry_df[service] == src["_svc"], "left")
    host = F.try_element_at(F.col("hosts"), F.lit(1))
    has_host = host.isNotNull() & (host != "")
    repo = F.col("repository")
    has_repo = repo.isNotNull() & (repo != "")
    links = F.struct(
        F.when(has_host, F.concat(F.lit("https://"), host, F.lit("/"))).alias("product"),
        F.when(has_host & F.col("kind").isin(list(ADMIN_KINDS)),
               F.concat(F.lit("https://"), host, F.lit("/admin"))).alias("admin"),
        F.when(has_repo, F.concat(F.lit("https://github.com/"), repo)).alias("github"),
        F.when(has_repo, F.concat(F.lit("https://github.com/"), repo, F.lit("#readme"))).alias("readme"),
        F.when(F.col("_svc").isNotNull(), F.lit("deploy")).alias("deploy"),
        F.when(has_repo, F.concat(F.lit("https://github.com/"), repo, F.lit("/actions"))).alias("release"),
        F.lit(monitor_url).alias("monitor"),
    )
    return j.select("id", "name", "kind", links.alias("links"))


_MONITOR = "struct<group:string,name:string,type:string,target:string>"


def expand_rules(df: DataFrame, type_col: str = "kind", name_col: str = "name", host_col: str = "host",
                 group: str = "Products", fixed_df: DataFrame | None = None) -> DataFrame:
    """Each record gives 0, 1 or 2 monitor rows by its kind, in one ``explode`` over a conditional array (no
    join, no shuffle): 'product' → health and files checks on its first host; 'testing' → one health check marked
    as testing; other kinds → none. Fixed rows (platform, infrastructure, push signals) are appended."""
    def mon(name_c, path):
        return F.struct(F.lit(group).alias("group"), name_c.alias("name"), F.lit("http").alias("type"),
                        F.concat(F.lit("https://"), F.col(host_col), F.lit(path)).alias("target"))
    arr = (F.when(F.col(type_col) == "product",
                  F.array(mon(F.col(name_col), "/health"),
                          mon(F.concat(F.col(name_col), F.lit(" (files)")), "/health/files")))
           .when(F.col(type_col) == "testing", F.array(mon(F.concat(F.col(name_col), F.lit(" (testing)")), "/health")))
           .otherwise(F.array().cast(f"array<{_MONITOR}>")))
    out = df.select(F.explode(arr).alias("m")).select("m.*")
    if fixed_df is not None:
        out = out.unionByName(fixed_df.select("group", "name", "type", "target"))
    return out

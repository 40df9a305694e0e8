"""Join operators: anti / semi joins for resume and exclusion, enrichment joins, desired-vs-existing and
table diffs, and last/first row per key.

Strategy is left to Catalyst and AQE. An explicit broadcast is used only through ``broadcast_checked``, which
reads the optimizer's size estimate (file sizes and column widths, no job) and refuses to broadcast above a bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bound for an explicit broadcast side (bytes, optimizer estimate). The estimate starts from compressed file sizes
# and does not see that a generator multiplies rows, so the bound is a fraction of what an executor can hold, and a
# smaller one still below a generator.
BROADCAST_LIMIT = 16 * 1024 * 1024
GENERATED_SHARE = 8


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a DataFrame's optimized plan (no job runs)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - e.g. Spark Connect: no JVM handle, treat as unknown/large
        return 1 << 62


def _generates(df: DataFrame) -> bool:
    try:
        return "Generate " in df._jdf.queryExecution().optimizedPlan().toString()
    except Exception:  # noqa: BLE001 - no plan to look at: be careful
        return True


# Row bound used when the optimizer has no size estimate (e.g. a DataFrame built from local rows).
BROADCAST_MAX_ROWS = 100_000


def within_bound(df: DataFrame, limit: int = BROADCAST_LIMIT, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """True when ``df`` is provably small: the optimizer's estimate is within ``limit`` bytes, or — when there is
    no estimate — a bounded count (reads at most ``max_rows + 1`` rows) stays within ``max_rows``."""
    est = estimated_bytes(df)
    if est <= (limit // GENERATED_SHARE if _generates(df) else limit):
        return True
    if est >= (1 << 62) or est == 9223372036854775807:
        return df.limit(max_rows + 1).count() <= max_rows
    return False


def rows_at_most(df: DataFrame, max_rows: int) -> bool:
    """Proof that ``df`` has at most ``max_rows`` rows: a bounded count that reads at most ``max_rows + 1``."""
    return df.limit(max_rows + 1).count() <= max_rows


# Rule tables up to this many rows are compiled into literal expressions; larger ones are joined or taken in blocks.
RULES_MAX_ROWS = 1000


def compiled_rules(df: DataFrame, max_rows: int | None = None) -> list | None:
    """The rows of a small rule table (prefix lists, named patterns), to be compiled into literal expressions; None if it
    has more than ``max_rows`` rows (at most one more is read)."""
    most = RULES_MAX_ROWS if max_rows is None else max_rows
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_LIMIT, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only when the side is provably small; otherwise the plain side (a shuffle join)."""
    return F.broadcast(df) if within_bound(df, limit, max_rows) else df


def anti_done(df: DataFrame, done: DataFrame, keys: list[str] | str) -> DataFrame:
    """Rows whose key is not already done (resume)."""
    return df.join(done.select(keys if isinstance(keys, list) else [keys]), on=keys, how="left_anti")


def anti_excluded(df: DataFrame, blacklist: DataFrame, owned: DataFrame, key_black: str, key_owned: str) -> DataFrame:
    """Rows not in the blacklist and not already owned. Null keys are kept, as a ``not in`` set test keeps them."""
    b = blacklist.select(F.col(key_black).alias("_b")).where(F.col("_b").isNotNull()).distinct()
    o = owned.select(F.col(key_owned).alias("_o")).where(F.col("_o").isNotNull()).distinct()
    out = df.join(b, df[key_black] == b["_b"], "left_anti")
    return out.join(o, out[key_owned] == o["_o"], "left_anti")


def semi_known(df: DataFrame, other: DataFrame, keys: list[str] | str) -> DataFrame:
    return df.join(other.select(keys if isinstance(keys, list) else [keys]), on=keys, how="left_semi")


def semi_articles(df: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    return semi_known(df, articles, key)


def left_enrich(df: DataFrame, dim: DataFrame, on: Column | list[str], present: str | None = None,
                link_cols: dict[str, Column] | None = None) -> DataFrame:
    """Left join; link columns are set only where the dimension row exists (``present`` non-null)."""
    out = df.join(broadcast_checked(dim), on=on, how="left")
    for name, expr in (link_cols or {}).items():
        out = out.withColumn(name, F.when(F.col(present).isNotNull(), expr))
    return out


def municipality_dim(df: DataFrame, dim: DataFrame, on: Column | list[str]) -> DataFrame:
    """Equi join to a dimension table; broadcast when the dimension is within the checked size."""
    return df.join(broadcast_checked(dim), on=on, how="inner")


def desired_state_diff(desired: DataFrame, existing: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Desired × existing by key: 'add' (not there), 'edit' (some compared field differs, null-safe), 'keep'."""
    e = existing.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_e_{c}") for c in compare])
    j = desired.join(e, desired[key] == e["_k"], "left")
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in compare])
    action = F.when(F.col("_k").isNull(), "add").when(differs, "edit").otherwise("keep")
    return j.select(F.col(key), action.alias("action"))


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join on keys: status 'match', 'missing' (only left), 'extra' (only right), 'differs'."""
    l_ = left.select(*keys, *[F.col(v).alias(f"_l_{v}") for v in values]).withColumn("_lp", F.lit(True))
    r_ = right.select(*keys, *[F.col(v).alias(f"_r_{v}") for v in values]).withColumn("_rp", F.lit(True))
    j = l_.join(r_, on=keys, how="full_outer")
    same = reduce(lambda a, b: a & b, [F.col(f"_l_{v}").eqNullSafe(F.col(f"_r_{v}")) for v in values])
    status = (F.when(F.col("_rp").isNull(), "missing").when(F.col("_lp").isNull(), "extra")
              .when(same, "match").otherwise("differs"))
    return j.select(*keys, status.alias("status"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _pick_per_key(df: DataFrame, keys: list[str], order: list[str], last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order])
    payload = F.struct(*[F.col(c) for c in rest])
    agg = F.max_by(payload, ordering) if last else F.min_by(payload, ordering)
    return df.groupBy(*keys).agg(agg.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def dedupe_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Duplicate keys: keep the last row by an explicit order (Spark has no physical row address). An
    aggregate, combined map-side, so hot keys do not collect in one task."""
    return _pick_per_key(df, keys, order, last=True)


def first_seen_dedupe(df: DataFrame, keys: list[str], order: list[str], nonempty: list[str] = ()) -> DataFrame:
    """First occurrence of each key by an explicit order; rows with an empty key or empty listed field are
    skipped first."""
    cond = reduce(lambda a, b: a & b,
                  [(F.col(c).isNotNull() & (F.col(c).cast("string") != "")) for c in list(keys) + list(nonempty)])
    return _pick_per_key(df.where(cond), keys, order, last=False)


def join_entitlements(subs: DataFrame, users: DataFrame, sub_user: str = "user_id", user_id: str = "id") -> DataFrame:
    """Subscription ⨝ user → (email, order_id, status, until)."""
    j = subs.join(users, subs[sub_user] == users[user_id])
    return j.select(users["email"], subs["order_id"], subs["status"], subs["until"])


def provider_subscriptions(subs: DataFrame, accounts: DataFrame, provider: str, sub_account: str = "account_id",
                           account_id: str = "id") -> DataFrame:
    """Remote subscription ⨝ account, only the given provider → (email, order_id, status)."""
    j = subs.where(subs["provider"] == provider).join(accounts, subs[sub_account] == accounts[account_id])
    return j.select(accounts["email"], subs["external_id"].alias("order_id"), subs["status"])

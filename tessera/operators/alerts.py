"""Health signals: thresholds per signal, silent keys, counts per tumbling window (batch forms; the streaming
forms live in ``tessera.streaming``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.joins import broadcast_checked
from tessera.operators.ranking import with_next

# Alert limits (signal, limit, comparison that means healthy, whether a missing value is healthy).
THRESHOLDS = [
    ("disk_pct", 92.0, "<", False),
    ("pg_connections_pct", 85.0, "<", False),
    ("pg_cache_pct", 93.0, ">=", False),
    ("pg_longest_tx_s", 1800.0, "<", False),
    ("store_5xx_pct", 5.0, "<", True),
    ("backup_hours", 50.0, "<", False),
]
# Signals without a numeric limit: readiness (boolean value 1/0) and the collector's own heartbeat.
BOOLEAN_SIGNALS = ("store_ready",)
HEARTBEAT_SIGNALS = ("collector",)


def limits_frame(spark: SparkSession) -> DataFrame:
    from tessera.sources.tables import literal_frame
    return literal_frame(spark, THRESHOLDS, "signal string, limit double, op string, missing_ok boolean")


SIGNALS = (*[t[0] for t in THRESHOLDS], *BOOLEAN_SIGNALS, *HEARTBEAT_SIGNALS)


def threshold_alerts(signals_df: DataFrame, limits_df: DataFrame, expected: tuple = SIGNALS) -> DataFrame:
    """Long-format samples (sample_id, signal, value) × limits (signal, limit, op, missing_ok) → ok flag, one row for
    every sample and every ``expected`` signal: a signal without a row is a missing value (the largest value counts if a
    signal is repeated). '<' and '>=' compare against the limit; a missing value is an alert unless the limit says
    otherwise; readiness signals are ok when 1; heartbeat signals are always ok. One aggregate per sample lines its
    signals up, no join; the limit table is tiny and broadcast."""
    value = {s: F.max(F.when(F.col("signal") == s, F.col("value"))).alias(f"_v{i}") for i, s in enumerate(expected)}
    by_sample = signals_df.groupBy("sample_id").agg(*value.values())
    rows = by_sample.select("sample_id", F.inline(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(f"_v{i}").alias("value")) for i, s in enumerate(expected)])))
    j = rows.join(broadcast_checked(limits_df), on="signal", how="left")
    v = F.col("value")
    ok = (F.when(F.col("signal").isin(*HEARTBEAT_SIGNALS), F.lit(True))
          .when(F.col("signal").isin(*BOOLEAN_SIGNALS), F.coalesce(v == 1, F.lit(False)))
          .when(v.isNull(), F.coalesce(F.col("missing_ok"), F.lit(False)))
          .when(F.col("op") == "<", v < F.col("limit"))
          .when(F.col("op") == ">=", v >= F.col("limit"))
          .otherwise(F.lit(False)))
    return j.select("sample_id", "signal", "value", ok.alias("ok"))


def silent_key_alert(df: DataFrame, key: str, ts: str, limit_seconds: int, now: str,
                     tiebreak: str | None = None) -> DataFrame:
    """Every stretch longer than ``limit_seconds`` in which a key sent nothing: between two consecutive
    signals, and from the last signal until ``now``. The next signal is found without gathering a key, so a key with
    a third of all rows is spread over many tasks."""
    order = [ts] + ([tiebreak] if tiebreak else [])
    n = with_next(df.select(key, *order), [key], order, [ts])
    end = F.coalesce(F.col(f"next_{ts}"), F.lit(now).cast(df.schema[ts].dataType))
    secs = F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    out = n.select(F.col(key).alias("key"), F.col(ts).alias("silent_from"),
                   (secs / F.lit(1_000_000.0)).alias("silent_seconds"))
    return out.where(F.col("silent_seconds") > limit_seconds)


def window_rates(df: DataFrame, ts: str, key: str, minutes: int = 5) -> DataFrame:
    """Events and events per second in tumbling ``minutes`` windows per key (epoch-aligned)."""
    w = F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes")
    agg = df.groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("events"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "key", "events",
                      F.round(F.col("events") / F.lit(minutes * 60.0), 6).alias("rate"))

"""Per-key ordered logic: counter rates, snapshot retention, latest valid release, first valid ticket claim,
device presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import broadcast_checked
from tessera.operators.ranking import with_previous


def _secs(c):
    return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)


def counter_rate(df: DataFrame, series: str, ts: str, counter: str, digits: int = 2,
                 tiebreak: str | None = None, error_counter: str | None = None) -> DataFrame:
    """Per series and sample: change from the previous sample ÷ max(1 s, elapsed seconds), rounded. Counter
    resets give negative rates (kept, as the collector does). The first sample of a series has no rate. With
    ``error_counter`` also error_pct = 100·Δerrors/Δcounter (0 when the counter did not grow)."""
    order = [ts] + ([tiebreak] if tiebreak else [])
    extra = [error_counter] if error_counter else []
    p = with_previous(df.select(series, *order, counter, *extra), [series], order, [ts, counter, *extra])
    seconds = F.greatest(F.lit(1.0), _secs(F.col(ts)) - _secs(F.col(f"prev_{ts}")))
    delta = F.col(counter) - F.col(f"prev_{counter}")
    cols = [F.col(series).alias("series"), F.col(ts).alias("ts"), delta.alias("delta"),
            F.round(seconds, 6).alias("seconds"), F.round(delta / seconds, digits).alias("rate")]
    if error_counter:
        d_err = F.col(error_counter) - F.col(f"prev_{error_counter}")
        cols.append(error_pct(d_err, delta).alias("error_pct"))
    return p.where(F.col(f"prev_{ts}").isNotNull()).select(*cols)


def error_pct(d_err, d_req, digits: int = 2):
    """100·Δerrors/Δrequests, 0 when there were no new requests."""
    return F.when(d_req > 0, F.round(F.lit(100.0) * d_err / d_req, digits)).otherwise(F.lit(0.0))


def retention_gfs(df: DataFrame, snapshot: str, ts: str, daily: int = 7, weekly: int = 4,
                  monthly: int = 6) -> DataFrame:
    """Grandfather-father-son retention flags: the last snapshot of each of the newest ``daily`` days,
    ``weekly`` ISO weeks and ``monthly`` months that have snapshots. Per-bucket picks are aggregates
    (``max_by``, combined map-side); the newest buckets are a top-n over the bucket table; the kept ids
    (at most daily + weekly + monthly rows) are joined back by broadcast."""
    base = df.select(F.col(snapshot).alias("snapshot"), F.col(ts).alias("taken_at"))
    out = base
    for name, unit, n in (("keep_daily", "day", daily), ("keep_weekly", "week", weekly),
                          ("keep_monthly", "month", monthly)):
        bucket = F.date_trunc(unit, F.col("taken_at"))
        last = base.groupBy(bucket.alias("_b")).agg(
            F.max_by("snapshot", F.struct("taken_at", "snapshot")).alias("_s"))
        kept = last.orderBy(F.col("_b").desc()).limit(n).select(F.col("_s").alias("snapshot"),
                                                                 F.lit(True).alias(name))
        out = out.join(F.broadcast(kept), on="snapshot", how="left")   # at most n rows: bounded by the limit
    return out.select("snapshot", "taken_at", *[F.coalesce(F.col(c), F.lit(False)).alias(c)
                                                 for c in ("keep_daily", "keep_weekly", "keep_monthly")])


# Manifest checks of a release.
MANIFEST_SCHEMA = 1
ARTIFACT_TYPE = "docker-archive"
SHA256_PATTERN = r"^[0-9a-f]{64}$"
IMAGE_ID_PATTERN = r"^sha256:[0-9a-f]{64}$"


def latest_version(releases_df: DataFrame, sources_df: DataFrame, lock_df: DataFrame) -> DataFrame:
    """Per service: the newest non-draft release whose tag has the service's prefix; its manifest is checked
    (schema, repository among the allowed names, service, artifact type, hash formats, asset present, version
    equals tag). An invalid newest release is reported invalid — there is no fall-back to an older one.
    ``changed``: valid and the image differs from the lock (null-safe); ``previous_version`` from the lock."""
    src = broadcast_checked(sources_df.select("service", F.col("repo").alias("_repo"),
                                              F.coalesce("aliases", F.array().cast("array<string>")).alias("_aliases"),
                                              F.coalesce("tag_prefix", F.lit("")).alias("_prefix")))
    r = releases_df.join(src, on="service", how="inner")
    r = r.where(~F.coalesce(F.col("draft"), F.lit(False)) & F.col("tag").startswith(F.col("_prefix")))
    fields = [c for c in r.columns if c != "service"]
    newest = (r.groupBy("service")
              .agg(F.max_by(F.struct(*[F.col(c) for c in fields]), F.struct("published_at", "release_id")).alias("_r"))
              .select("service", "_r.*"))
    allowed = F.array_union(F.array(F.col("_repo")), F.col("_aliases"))
    valid = ((F.col("schema") == MANIFEST_SCHEMA) & F.array_contains(allowed, F.col("manifest_repo"))
             & (F.col("manifest_service") == F.col("service")) & (F.col("artifact_type") == ARTIFACT_TYPE)
             & F.coalesce(F.col("sha256").rlike(SHA256_PATTERN), F.lit(False))
             & F.coalesce(F.col("image_id").rlike(IMAGE_ID_PATTERN), F.lit(False))
             & F.coalesce(F.col("asset_present"), F.lit(False)) & (F.col("version") == F.col("tag")))
    lock = lock_df.select("service", F.col("version").alias("previous_version"),
                          F.col("image_id").alias("_lock_image"))
    j = newest.withColumn("valid", F.coalesce(valid, F.lit(False))).join(lock, on="service", how="left")
    changed = F.col("valid") & ~F.col("image_id").eqNullSafe(F.col("_lock_image"))
    return j.select("service", F.col("tag").alias("version"), "valid", changed.alias("changed"),
                    "previous_version")


def first_valid_claim(claims_df: DataFrame, tickets_df: DataFrame, devices_df: DataFrame,
                      life: str | None = None) -> DataFrame:
    """A one-time ticket is consumed by its first claim made before it expires, unless the ticket's device is
    revoked (then no claim consumes it); with ``life`` (an interval) no claim counts that was made longer than that before
    the expiry, when the ticket was not there yet. Claims are filtered by a join to their ticket, and the first one per
    token is an aggregate (``min_by``, combined map-side)."""
    t = tickets_df.join(devices_df.select(F.col("device_id"), F.col("status").alias("_dev_status")),
                        on="device_id", how="left")
    t = t.where(F.col("_dev_status").isNotNull() & (F.col("_dev_status") != "revoked"))
    c = claims_df.join(t, on="token", how="inner").where(F.col("claimed_at") < F.col("expires_at"))
    if life:
        c = c.where(F.col("claimed_at") >= F.col("expires_at") - F.expr(f"INTERVAL {life}"))
    first = c.groupBy("token").agg(F.min_by(F.struct("device_id", "claimed_at"),
                                            F.struct("claimed_at", "claim_id")).alias("_c"))
    return first.select("token", F.col("_c.device_id").alias("device"), F.col("_c.claimed_at").alias("claimed_at"))


def presence_state(events_df: DataFrame, key: str, ts: str, kind: str = "kind") -> DataFrame:
    """Per device: 'revoked' once any revoke happened (terminal), else the state of the last connect /
    disconnect; last_seen = time of the last connect. One aggregate per device."""
    k = F.col(kind)
    agg = events_df.groupBy(F.col(key).alias("device")).agg(
        F.max(F.when(k == "revoke", F.lit(1)).otherwise(F.lit(0))).alias("_rev"),
        F.max_by(k, F.when(k.isin("connect", "disconnect"), F.struct(F.col(ts), F.lit(1)))).alias("_last"),
        F.max(F.when(k == "connect", F.col(ts))).alias("last_seen"))
    status = (F.when(F.col("_rev") == 1, "revoked").when(F.col("_last") == "connect", "connected")
              .when(F.col("_last") == "disconnect", "disconnected").otherwise("unknown"))
    return agg.select("device", status.alias("status"), "last_seen")

"""Streaming and sequential-state queries. Streams read the events table as a file stream, run with
``availableNow`` into a fault-tolerant sink under the checkpoint folder, and the sink is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import sequential as Q
from tessera.plans.registry import query
from tessera.plans.standins import Tables, with_standins
from tessera.session import scratch_path
from tessera.streaming import jobs as J

RATE_N, RATE_WINDOW_S = 3, 86_400
BUDGET_N, BUDGET_WINDOW_S = 2, 43_200
TRACKER_NOW = "2024-01-31 00:00:00"
WATERMARK = "10 minutes"
SILENCE_LIMIT_S = 6 * 3600
# The test events span 30 days: a shorter retention than the default 90 days, so that it removes something.
KEEP_DAYS = 20


def _out(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("sample_stream", oracle=(
    "select event_id, ts, event_type, value from events where cast(ts as date) >= (select max(cast(ts as date)) "
    "from events) - interval 20 days"))
def q_sample_stream(spark, sf):
    path = _out(spark, "samples")
    src = J.file_stream(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    J.run_available(J.sample_stream(src, path, keep_days=KEEP_DAYS))
    return spark.read.parquet(path).select("event_id", "ts", "event_type", "value")


@query("window_rates_stream", oracle=(
    "select time_bucket(interval 5 minutes, ts) as window_start, event_type as key, count(*) as events, "
    "round(count(*) / 300.0, 6) as rate from events group by 1, 2 having time_bucket(interval 5 minutes, ts) + "
    "interval 5 minutes <= (select max(ts) from events) - interval 10 minutes"))
def q_window_rates_stream(spark, sf):
    path = _out(spark, "rates")
    src = J.file_stream(spark, sf, "events")
    J.run_available(J.to_parquet(J.window_rates_stream(src, "ts", "event_type", 5, WATERMARK), path))
    return spark.read.parquet(path)


@query("upsert_votes_stream", oracle=with_standins(
    "select slug, voter, vote as value, ts as updated_at from (select *, row_number() over (partition by slug, "
    "voter order by ts desc, seq desc) as rn from vote_events) v where rn = 1 and vote <> 0", "vote_events"))
def q_upsert_votes_stream(spark, sf):
    path = _out(spark, "votes")
    ev = J.file_stream(spark, sf, "events")
    votes = ev.select(F.concat(F.lit("a"), (F.col("event_id") % 7).cast("string")).alias("slug"),
                      F.col("user_id").alias("voter"),
                      F.when(F.col("event_type").isin("click", "view"), 1).when(F.col("event_type") == "error", -1)
                      .otherwise(0).alias("vote"), "ts", F.col("event_id").alias("seq"))
    J.run_available(J.upsert_votes_stream(votes, path))
    return J.current_votes(spark, path)


def _replay_sql(n: int, window_s: int, inclusive: bool) -> str:
    """Recursive replay of the acceptance rule per user (the list holds accepted times still in the window)."""
    keep = f"x >= e.t - {window_s}" if inclusive else f"x > e.t - {window_s}"
    kept = f"list_filter(r.acc, lambda x: {keep})"
    return (
        "with recursive e as (select user_id, event_id, ts, epoch_us(ts) / 1000000.0 as t, row_number() over "
        "(partition by user_id order by ts, event_id) as rn from events), r(user_id, rn, event_id, ts, acc, "
        "granted) as (select user_id, rn, event_id, ts, [t], true from e where rn = 1 union all select e.user_id, "
        f"e.rn, e.event_id, e.ts, case when len({kept}) < {n} then list_append({kept}, e.t) else {kept} end, "
        f"len({kept}) < {n} from r join e on e.user_id = r.user_id and e.rn = r.rn + 1) "
        "select event_id, user_id, ts, granted from r")


@query("sliding_rate_limit", oracle=_replay_sql(RATE_N, RATE_WINDOW_S, True))
def q_sliding_rate_limit(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", "user_id", "ts")
    return Q.sliding_rate_limit(ev, "user_id", "ts", RATE_N, RATE_WINDOW_S, inclusive=True, tiebreak="event_id")


@query("attempt_budget", oracle=_replay_sql(BUDGET_N, BUDGET_WINDOW_S, False))
def q_attempt_budget(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", "user_id", "ts")
    return Q.attempt_budget(ev, "user_id", "ts", BUDGET_N, BUDGET_WINDOW_S, tiebreak="event_id")


@query("rate_limit_stream", oracle=(
    f"select user_id as key, event_id as id, ts, granted from ({_replay_sql(RATE_N, RATE_WINDOW_S, True)}) x"))
def q_rate_limit_stream(spark, sf):
    path = _out(spark, "ratelimit")
    src = J.file_stream(spark, sf, "events")
    J.run_available(J.to_parquet(J.rate_limit_stream(src, "user_id", "ts", "event_id", RATE_N, RATE_WINDOW_S), path))
    return spark.read.parquet(path)


def tracker_events(df):
    et = F.col("event_type")
    ev = (F.when(et == "signup", "start").when(et == "click", "ssh_fail").when(et == "view", "ssh_ok")
          .when(et == "purchase", "ready").when(et == "error", "probe_fail"))
    return df.select("user_id", "ts", "event_id", ev.alias("event"))


def _tracker_sql(final: bool = True, until: str | None = None) -> str:
    """Recursive replay of the phase / deadline state machine per user. ``final`` adds the closing verdicts at
    ``TRACKER_NOW``; ``until`` keeps only verdicts at or before that time (the stream's final watermark)."""
    b, p, s = Q.BOOT_LIMIT_S, Q.PREPARE_LIMIT_S, Q.SSH_FAIL_LIMIT_S

    def deadline(ph, si, sf_):
        return (f"case when {ph} = 'booting' then (case when {sf_} is not null and {sf_} + {s} < {si} + {b} then "
                f"{sf_} + {s} else {si} + {b} end) when {ph} = 'preparing' then {si} + {p} end")

    def why(ph, si, sf_):
        return (f"case when {ph} = 'booting' then (case when {sf_} is not null and {sf_} + {s} < {si} + {b} then "
                f"'ssh_timeout' else 'boot_timeout' end) when {ph} = 'preparing' then 'prepare_timeout' end")

    ev = ("case event_type when 'signup' then 'start' when 'click' then 'ssh_fail' when 'view' then 'ssh_ok' "
          "when 'purchase' then 'ready' when 'error' then 'probe_fail' end")
    d = deadline("r.phase", "r.since", "r.sshf")
    exp = f"coalesce({d} < e.t, false)"
    p0 = f"case when {exp} then null else r.phase end"
    s0 = f"case when {exp} then null else r.since end"
    f0 = f"case when {exp} then null else r.sshf end"
    fin = "e.ev in ('ready', 'probe_fail')"
    sql = (
        "with recursive e as (select user_id, epoch_us(ts) / 1000000.0 as t, " + ev + " as ev, row_number() over "
        "(partition by user_id order by ts, event_id) as rn from events), "
        "r(user_id, rn, phase, since, sshf, v1_phase, v1_reason, v1_at, v2_verdict, v2_at) as ("
        "select distinct user_id, 0, cast(null as varchar), cast(null as double), cast(null as double), "
        "cast(null as varchar), cast(null as varchar), cast(null as double), cast(null as varchar), "
        "cast(null as double) from e union all select e.user_id, e.rn, "
        f"case when e.ev = 'start' and ({p0}) is null then 'booting' when ({p0}) = 'booting' and e.ev = 'ssh_ok' "
        f"then 'preparing' when ({p0}) = 'preparing' and {fin} then null else ({p0}) end, "
        f"case when e.ev = 'start' and ({p0}) is null then e.t when ({p0}) = 'booting' and e.ev = 'ssh_ok' then e.t "
        f"when ({p0}) = 'preparing' and {fin} then null else ({s0}) end, "
        f"case when e.ev = 'start' and ({p0}) is null then null when ({p0}) = 'booting' and e.ev = 'ssh_fail' then "
        f"coalesce(({f0}), e.t) when ({p0}) = 'preparing' and {fin} then null else ({f0}) end, "
        f"case when {exp} then r.phase end, case when {exp} then {why('r.phase', 'r.since', 'r.sshf')} end, "
        f"case when {exp} then {d} end, "
        f"case when ({p0}) = 'preparing' and {fin} then (case when e.ev = 'ready' then 'ready' else 'failed' end) end, "
        f"case when ({p0}) = 'preparing' and {fin} then e.t end "
        "from r join e on e.user_id = r.user_id and e.rn = r.rn + 1), "
        "v as (select user_id as key, v1_phase as phase, 'failed' as verdict, v1_reason as reason, v1_at as vat "
        "from r where v1_at is not null union all select user_id, 'preparing', v2_verdict, case when v2_verdict = "
        "'failed' then 'probe_failed' end, v2_at from r where v2_at is not null")
    if final:
        now = f"epoch(timestamp '{TRACKER_NOW}')"
        last = "(select * from r where rn = (select max(rn) from r r2 where r2.user_id = r.user_id))"
        dl = deadline("l.phase", "l.since", "l.sshf")
        sql += (f" union all select user_id, phase, case when {dl} < {now} then 'failed' else 'pending' end, "
                f"case when {dl} < {now} then {why('l.phase', 'l.since', 'l.sshf')} end, case when {dl} < {now} "
                f"then {dl} else since end from {last} l where phase is not null")
    sql += (") select key, phase, verdict, reason, make_timestamp(cast(round(vat * 1000000) as bigint)) as \"at\" "
            "from v" + (f" where vat <= {until}" if until else ""))
    return sql


@query("deadline_tracker", oracle=_tracker_sql())
def q_deadline_tracker(spark, sf):
    return Q.deadline_tracker(tracker_events(Tables(spark, sf).events), "user_id", "ts", "event", TRACKER_NOW,
                              tiebreak="event_id")


@query("deadline_tracker_stream", oracle=(
    f"select * from ({_tracker_sql()}) t where verdict <> 'pending' and \"at\" <= (select max(ts) from events)"))
def q_deadline_tracker_stream(spark, sf):
    path = _out(spark, "tracker")
    src = tracker_events(J.file_stream(spark, sf, "events"))
    J.run_available(J.to_parquet(J.deadline_tracker_stream(src, "user_id", "ts", "event", tiebreak="event_id"), path))
    return spark.read.parquet(path)


@query("silent_key_stream", oracle=(
    "select user_id as key, ts as silent_from, case when nxt is null then cast(" + str(SILENCE_LIMIT_S) + " as double) "
    "else (epoch_us(nxt) - epoch_us(ts)) / 1000000.0 end as silent_seconds from (select user_id, ts, lead(ts) over "
    "(partition by user_id order by ts, event_id) as nxt from events) e where (nxt is not null and epoch_us(nxt) - "
    f"epoch_us(ts) > {SILENCE_LIMIT_S * 1_000_000}) or (nxt is null and epoch_us(ts) + {SILENCE_LIMIT_S * 1_000_000} < "
    "(select epoch_us(max(ts)) from events))"))
def q_silent_key_stream(spark, sf):
    path = _out(spark, "silence")
    src = J.file_stream(spark, sf, "events")
    J.run_available(J.to_parquet(J.silent_key_stream(src, "user_id", "ts", SILENCE_LIMIT_S), path))
    return spark.read.parquet(path)


# How long a ticket lives in the claim stream.
TICKET_LIFE = "20 minutes"


@query("first_valid_claim_stream", oracle=(
    "with c as (select 'tk' || cast(cast(floor(event_id / 4) as bigint) as varchar) as token, ts as claimed_at, event_id as "
    "claim_id from events), t as (select 'tk' || cast(cast(floor(event_id / 4) as bigint) as varchar) as token, user_id as "
    "device_id, ts + interval 20 minutes as expires_at from events where event_id % 4 = 0), d as (select c_custkey as "
    "device_id, case when c_custkey % 10 = 0 then 'revoked' else 'connected' end as status from customer), ok as (select "
    "c.token, t.device_id, c.claimed_at, c.claim_id, t.expires_at from c join t on c.token = t.token join d on d.device_id = "
    "t.device_id where d.status <> 'revoked' and c.claimed_at < t.expires_at and c.claimed_at >= t.expires_at - interval 20 "
    "minutes) select token, arg_min(device_id, (claimed_at, claim_id)) as device, min(claimed_at) as claimed_at from ok where "
    "expires_at <= (select least(max(ts), max(case when event_id % 4 = 0 then ts + interval 20 minutes end)) from events) - "
    "interval 40 minutes group by token"))
def q_first_valid_claim_stream(spark, sf):
    """Tickets whose expiry lies two ticket lives before the end of both streams: the watermarks have closed them."""
    path, t = _out(spark, "claims"), Tables(spark, sf)
    k = F.col("event_id")
    token = F.concat(F.lit("tk"), F.floor(k / 4).cast("string")).alias("token")
    claims = J.file_stream(spark, sf, "events").select(token, F.col("ts").alias("claimed_at"), k.alias("claim_id"))
    tickets = J.file_stream(spark, sf, "events").where(k % 4 == 0).select(
        token, F.col("user_id").alias("device_id"), (F.col("ts") + F.expr(f"INTERVAL {TICKET_LIFE}")).alias("expires_at"))
    devices = t.customer.select(F.col("c_custkey").alias("device_id"),
                                F.when(F.col("c_custkey") % 10 == 0, "revoked").otherwise("connected").alias("status"))
    J.run_available(J.to_parquet(J.first_valid_claim_stream(claims, tickets, devices, TICKET_LIFE, "0 seconds"), path))
    ts, life = F.col("ts").cast("timestamp"), F.expr(f"INTERVAL {TICKET_LIFE}")
    last = t.events.agg(F.least(F.max(ts), F.max(F.when(k % 4 == 0, ts + life)))).scalar()
    out = spark.read.parquet(path)
    return out.where(F.col("expires_at") <= last - F.expr("INTERVAL 40 MINUTES")).select("token", "device", "claimed_at")

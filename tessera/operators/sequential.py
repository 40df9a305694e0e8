"""Sequential per-key rules: sliding-window acceptance (rate limit, attempt budget) and the phase / deadline
tracker. Acceptance depends on earlier acceptances, so each key is a fold over its events in time order.

Batch form: rows are hash-partitioned by key and sorted by (key, time) inside each partition; one
``mapInPandas`` pass then streams through the sorted rows carrying only the state of the current key (at most N
timestamps, or one phase record). A hot key is a single ordered pass with bounded memory — it is never loaded
whole into memory as ``applyInPandas`` would. The stream form (``tessera.streaming``) keeps the same state in
the state store. Both use the step functions below, so they decide identically.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Write limits (count per window seconds) and the restart budget.
COMMENT_LIMIT = (6, 600)
VOTE_LIMIT = (40, 600)
ATTEMPT_BUDGET = (3, 3600)


# ---- sliding-window acceptance --------------------------------------------------------------------------------
class AcceptedTimes:
    """Whether a time is accepted when at most ``n`` may be within the window: the last n accepted times lie in a ring,
    and only the oldest of them matters — if it has left the window, at most n - 1 are still inside. ``inclusive``: a
    time exactly ``window_s`` old still counts (rate limit); otherwise it no longer counts (attempt budget)."""

    __slots__ = ("ring", "at", "window_s", "inclusive")

    def __init__(self, n: int, window_s: float, inclusive: bool, held=()):
        self.ring, self.at = [None] * max(0, n - len(held)) + list(held)[-n:] if n else [], 0
        self.window_s, self.inclusive = window_s, inclusive

    def offer(self, now: float) -> bool:
        if not self.ring:
            return False
        oldest = self.ring[self.at]
        age = None if oldest is None else now - oldest
        if age is not None and (age <= self.window_s if self.inclusive else age < self.window_s):
            return False
        self.ring[self.at] = now
        self.at = (self.at + 1) % len(self.ring)
        return True

    def times(self) -> list[float]:
        """The accepted times held, oldest first."""
        return [t for t in self.ring[self.at:] + self.ring[:self.at] if t is not None]


def _epoch_s(col):
    return F.unix_micros(F.col(col).cast("timestamp")) / F.lit(1_000_000.0)


def idle_segments(df: DataFrame, key: str, order: list[str], t_col: str, idle_s: float, strict: bool) -> DataFrame:
    """``df`` + ``_seg``: a new segment of a key starts after an idle gap longer than ``idle_s`` (or equal to it,
    when ``strict`` is false). The table is sorted and stored once for it."""
    from tessera.operators.ranking import segments
    gap = F.col(t_col) - F.col("_before")
    return segments(df, [key], order, t_col, gap > idle_s if strict else gap >= idle_s, "_seg")


def sliding_rate_limit(df: DataFrame, key: str, ts: str, n: int, window_s: float, inclusive: bool = True,
                       tiebreak: str | None = None, split_idle: bool = True) -> DataFrame:
    """``df`` + ``granted``: a row is accepted when fewer than ``n`` accepted rows of its key fall in the
    last ``window_s`` seconds; refused rows do not count.

    With ``split_idle`` a key's timeline is cut at idle gaps longer than the window: every earlier acceptance
    has left the window there, so the fold restarts from empty state and each (key, segment) is folded
    independently — a bursty hot key spreads over many tasks, with exactly the same decisions."""
    order = [ts] + ([tiebreak] if tiebreak else [])
    base = df.withColumn("_t", _epoch_s(ts))
    part = [key]
    if split_idle:
        base = idle_segments(base, key, order, "_t", window_s, strict=inclusive)
        part = [key, "_seg"]
    s = base.repartition(*[F.col(c) for c in part]).sortWithinPartitions(*part, *order)
    schema = T.StructType(list(s.schema.fields) + [T.StructField("granted", T.BooleanType())])

    def fold(batches):
        cur, ring = object(), None
        for pdf in batches:
            keys = list(zip(*[pdf[c].to_numpy(dtype=object) for c in part]))
            t = pdf["_t"].to_numpy(dtype=float)
            out = np.empty(len(pdf), dtype=bool)
            for i in range(len(pdf)):
                if keys[i] != cur:
                    cur, ring = keys[i], AcceptedTimes(n, window_s, inclusive)
                out[i] = ring.offer(t[i])
            yield pdf.assign(granted=out)

    return s.mapInPandas(fold, schema).drop("_t", "_seg")


def attempt_budget(df: DataFrame, key: str, ts: str, n: int = ATTEMPT_BUDGET[0], window_s: float = ATTEMPT_BUDGET[1],
                   tiebreak: str | None = None, split_idle: bool = True) -> DataFrame:
    """At most ``n`` granted attempts per key within ``window_s`` seconds, boundary exclusive."""
    return sliding_rate_limit(df, key, ts, n, window_s, inclusive=False, tiebreak=tiebreak, split_idle=split_idle)


# ---- phase / deadline tracker ---------------------------------------------------------------------------------
# Phase limits in seconds (boot, prepare, SSH failing since first failure).
BOOT_LIMIT_S = 35 * 60
PREPARE_LIMIT_S = 50 * 60
SSH_FAIL_LIMIT_S = 8 * 60

# What ends the preparing phase: verdict and reason.
PREPARE_ENDS = {"ready": ("ready", None), "slow": ("failed", "too_slow"), "probe_fail": ("failed", "probe_failed")}

TRACKER_OUT = "key {kt}, phase string, verdict string, reason string, at timestamp_ntz"


class Tracker:
    """State of one entity: phase ('booting' / 'preparing' / None when no cycle is open), when the phase began,
    when SSH first failed. Events: start, ssh_fail, ssh_ok, no_space, ready, slow, probe_fail, vanished.

    A protected entity is never failed: it has no boot deadline, and what would fail its preparing phase sends it back
    to booting."""

    __slots__ = ("phase", "since", "ssh_fail_since", "protected")

    def __init__(self, phase=None, since=None, ssh_fail_since=None, protected=False):
        self.phase, self.since, self.ssh_fail_since, self.protected = phase, since, ssh_fail_since, protected

    def deadline(self):
        if self.phase == "preparing":
            return self.since + PREPARE_LIMIT_S, "prepare_timeout"
        if self.phase == "booting" and not self.protected:
            d, why = self.since + BOOT_LIMIT_S, "boot_timeout"
            if self.ssh_fail_since is not None and self.ssh_fail_since + SSH_FAIL_LIMIT_S < d:
                d, why = self.ssh_fail_since + SSH_FAIL_LIMIT_S, "ssh_timeout"
            return d, why
        return None, None

    def _end(self, verdict: str, reason: str | None, at: float):
        if verdict == "failed" and self.protected:
            self.phase, self.since, self.ssh_fail_since = "booting", at, None
            return None
        out = (self.phase, verdict, reason, at)
        self.phase = self.since = self.ssh_fail_since = None
        return out

    def expire(self, now: float):
        """Verdict row when the open phase's deadline is before ``now`` (the cycle is then closed)."""
        d, why = self.deadline()
        return self._end("failed", why, d) if d is not None and d < now else None

    def step(self, event: str, t: float):
        """Apply one event at time ``t`` (after ``expire``); returns a verdict row or None."""
        if self.phase is None:
            if event == "start":
                self.phase, self.since, self.ssh_fail_since = "booting", t, None
        elif event == "vanished":
            return self._end("gone", "vanished", t)
        elif self.phase == "booting":
            if event == "ssh_fail" and self.ssh_fail_since is None:
                self.ssh_fail_since = t
            elif event == "ssh_ok":
                self.phase, self.since = "preparing", t
            elif event == "no_space" and not self.protected:
                return self._end("failed", "no_space", t)
        elif event in PREPARE_ENDS:
            return self._end(*PREPARE_ENDS[event], t)
        return None


def deadline_tracker(df: DataFrame, key: str, ts: str, event: str, now: str, tiebreak: str | None = None,
                     split_idle: bool = True, protected: str | None = None) -> DataFrame:
    """Verdicts per entity: (key, phase, verdict 'ready' / 'failed' / 'gone' / 'pending', reason, at). A deadline that
    passed before the next event (or before ``now``) fails the phase at the deadline; an entity still inside
    its limits at ``now`` is reported 'pending' with its phase.

    With ``split_idle`` an entity's events are cut at idle gaps longer than the longest limit: any open phase
    has expired by then, so each (entity, segment) folds independently and a busy entity spreads over tasks
    (a segment that is not the last closes at ``now`` with the same failed-at-deadline verdict). ``protected`` names a
    boolean column that is constant per entity; protected entities have no boot deadline, so theirs are not cut."""
    now_s = pd.Timestamp(now).timestamp()
    safe = F.coalesce(F.col(protected), F.lit(False)) if protected else F.lit(False)
    cols = [F.col(key).alias("key"), _epoch_s(ts).alias("_t"), F.col(event).alias("event"), safe.alias("_safe")]
    order = ["_t"] + (["_tb"] if tiebreak else [])
    if tiebreak:
        cols.append(F.col(tiebreak).alias("_tb"))
    base = df.select(*cols)
    part = ["key"]
    if split_idle:
        base = idle_segments(base, "key", order, "_t", max(BOOT_LIMIT_S, PREPARE_LIMIT_S, SSH_FAIL_LIMIT_S),
                             strict=True)
        base = base.withColumn("_seg", F.when(F.col("_safe"), 0).otherwise(F.col("_seg")))
        part = ["key", "_seg"]
    s = base.repartition(*[F.col(c) for c in part]).sortWithinPartitions(*part, *order)
    kt = df.schema[key].dataType.simpleString()

    def emit(rows, k, v):
        phase, verdict, reason, at = v
        rows.append((k, phase, verdict, reason, pd.Timestamp(int(round(at * 1e6)), unit="us")))

    def fold(batches):
        cur, st, rows = object(), None, []
        for pdf in batches:
            groups = list(zip(*[pdf[c].to_numpy(dtype=object) for c in part]))
            for g, t, ev, safe_ in zip(groups, pdf["_t"].to_numpy(dtype=float), pdf["event"].to_numpy(dtype=object),
                                       pdf["_safe"].to_numpy(dtype=bool)):
                k = g[0]
                if g != cur:
                    if st is not None:
                        _close(rows, cur[0], st, now_s, emit)
                    cur, st = g, Tracker(protected=bool(safe_))
                v = st.expire(t)
                if v:
                    emit(rows, k, v)
                v = st.step(ev, t)
                if v:
                    emit(rows, k, v)
            if rows:
                yield pd.DataFrame(rows, columns=["key", "phase", "verdict", "reason", "at"])
                rows = []
        if st is not None:
            _close(rows, cur[0], st, now_s, emit)
        if rows:
            yield pd.DataFrame(rows, columns=["key", "phase", "verdict", "reason", "at"])

    return s.mapInPandas(fold, TRACKER_OUT.format(kt=kt))


def _close(rows, k, st: Tracker, now_s: float, emit):
    v = st.expire(now_s)
    if v:
        emit(rows, k, v)
    elif st.phase is not None:
        emit(rows, k, (st.phase, "pending", None, st.since))

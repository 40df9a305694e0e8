"""Structured Streaming forms: file-source streams, retained sample table, windowed rates, vote upserts, and
stateful rules (rate limit / attempt budget, silent keys, deadline tracker) with ``transformWithStateInPandas``.

Every query writes to a fault-tolerant sink (Parquet file sink or ``foreachBatch`` keyed by batch id) with a
checkpoint under the shared checkpoint folder, so a lost executor or a restarted query resumes exactly where it
stopped. ``run_available`` drives a query with ``availableNow`` (all data present now, then stop).
"""

from __future__ import annotations

import uuid
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.sequential import AcceptedTimes, Tracker
from tessera.session import scratch_path

# Rows per frame that a stateful step gives out.
ROWS_OUT = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ensure_rocksdb(spark: SparkSession) -> None:
    """``transformWithStateInPandas`` needs the RocksDB state store; set it only when the session has none."""
    cur = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    if not cur or "HDFSBackedStateStoreProvider" in cur:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# Files that one micro-batch takes up at most, unless the caller says otherwise.
FILES_PER_BATCH = 64


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None,
                max_files: int = FILES_PER_BATCH) -> DataFrame:
    """One table of ``folder`` as a stream (explicit schema: no inference per batch). The table is either one Parquet
    file ``<name>.parquet``, or a folder of that name with part files; a micro-batch takes ``max_files`` files."""
    table = f"{folder.rstrip('/')}/{name}.parquet"
    schema = schema or spark.read.parquet(table).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if _is_folder(spark, table):
        return reader.parquet(table)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def new_checkpoint(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex}")


def run_available(writer, spark: SparkSession | None = None, state_partitions: int | None = None) -> None:
    """Run a query over all data available now, then stop. The number of state / shuffle partitions of a new
    query is fixed in its checkpoint when it first starts; it is sized here from the cluster's parallelism
    (2 × cores, unless given) instead of the fixed session default, and the session value is restored after."""
    spark = spark or SparkSession.getActiveSession()
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key) if spark is not None else None
    if spark is not None:
        spark.conf.set(key, str(state_partitions or 2 * spark.sparkContext.defaultParallelism))
    try:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    finally:
        if spark is not None and old is not None:
            spark.conf.set(key, old)


# ---- sample table with retention ------------------------------------------------------------------------------
def sample_stream(stream_df: DataFrame, path: str, ts: str = "ts", keep_days: int = 90,
                  checkpoint: str | None = None):
    """Add samples partitioned by (day, batch id); after each batch, day partitions older than ``keep_days``
    before the newest sample are dropped (Hadoop FileSystem delete of whole partition folders — no rewrite).
    Dynamic partition overwrite makes a replayed batch replace exactly its own partitions (idempotent)."""
    spark = stream_df.sparkSession
    checkpoint = checkpoint or new_checkpoint(spark, "samples")

    def write(batch: DataFrame, batch_id: int):
        from pyspark.sql import Observation
        seen = Observation()
        b = batch.withColumn("day", F.to_date(F.col(ts))).withColumn("batch_id", F.lit(batch_id))
        # the newest day is observed while the batch is written: one evaluation
        (b.observe(seen, F.max("day").alias("newest")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(path))
        newest = seen.get["newest"]
        if newest is not None:
            _drop_old_days(spark, path, newest, keep_days)

    return stream_df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _drop_old_days(spark: SparkSession, path: str, newest, keep_days: int) -> None:
    import datetime as dt
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return
    horizon = newest - dt.timedelta(days=keep_days)
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("day="):
            try:
                day = dt.date.fromisoformat(name[4:])
            except ValueError:
                continue
            if day < horizon:
                fs.delete(st.getPath(), True)


def retained(df: DataFrame, ts: str = "ts", keep_days: int = 90) -> DataFrame:
    """Batch form of the retention rule: rows on or after the day ``keep_days`` before the newest row's day."""
    newest = df.agg(F.max(F.to_date(F.col(ts)))).scalar()   # scalar subquery: one value, no join
    return df.where(F.to_date(F.col(ts)) >= F.date_sub(newest, keep_days))


# ---- windowed rates -------------------------------------------------------------------------------------------
def window_rates_stream(stream_df: DataFrame, ts: str, key: str, minutes: int = 5,
                        watermark: str = "10 minutes") -> DataFrame:
    """Events per key in tumbling windows, emitted once the watermark closes the window (append mode); rows
    later than the watermark are dropped."""
    s = stream_df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    agg = s.groupBy(F.window("_ts", f"{minutes} minutes").alias("w"), F.col(key).alias("key")) \
        .agg(F.count(F.lit(1)).alias("events"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "key", "events",
                      F.round(F.col("events") / F.lit(minutes * 60.0), 6).alias("rate"))


# ---- vote upserts ---------------------------------------------------------------------------------------------
def upsert_votes_stream(stream_df: DataFrame, changes_path: str, keys=("slug", "voter"), value: str = "vote",
                        ts: str = "ts", seq: str = "seq", checkpoint: str | None = None):
    """Last vote per (article, voter) kept in the state store (update mode); each batch appends the changed keys
    with their batch id. ``current_votes`` compacts the change log into the live table (0 removes a vote)."""
    spark = stream_df.sparkSession
    checkpoint = checkpoint or new_checkpoint(spark, "votes")
    k = list(keys)
    agg = stream_df.groupBy(*k).agg(F.max_by(F.struct(F.col(value).alias("value"), F.col(ts).alias("updated_at")),
                                             F.struct(F.col(ts), F.col(seq))).alias("_v"))
    out = agg.select(*k, "_v.value", "_v.updated_at")

    def write(batch: DataFrame, batch_id: int):
        # the batch id makes a replayed batch land in the same folder (overwrite), so replays are idempotent
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .parquet(f"{changes_path}/batch={batch_id:010d}")

    return out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def into_keyed_table(stream_df: DataFrame, table, merge, checkpoint: str | None = None):
    """Every micro-batch merged into a ``KeyedTable`` under its batch number: only the buckets of its keys are rewritten,
    and a batch that is delivered again after a crash changes nothing."""
    checkpoint = checkpoint or new_checkpoint(stream_df.sparkSession, "keyed")
    return stream_df.writeStream.foreachBatch(lambda batch, batch_id: table.apply(batch, merge, batch_id) and None) \
        .option("checkpointLocation", checkpoint)


def current_votes(spark: SparkSession, changes_path: str, keys=("slug", "voter")) -> DataFrame:
    k = list(keys)
    log = spark.read.parquet(changes_path)
    last = log.groupBy(*k).agg(F.max_by(F.struct("value", "updated_at"), F.col("batch_id")).alias("_v"))
    return last.select(*k, "_v.value", "_v.updated_at").where(F.col("value") != 0)


def compact_votes(spark: SparkSession, changes_path: str, keys=("slug", "voter")) -> None:
    """Replace the change log by its last change per key, removals included, so that reading the live table does not
    grow with the number of batches. The last changes are added as a folder of their own, and the folders they were
    taken from are removed after that: since a key's last change wins, the log gives the same votes at every step, also
    while a later batch appends beside it or an earlier one is replayed."""
    from tessera.sources.folders import Folder
    old = [n for n in Folder(spark, changes_path).names() if n.startswith("batch=")]
    last = spark.read.parquet(changes_path).groupBy(*keys).agg(
        F.max_by(F.struct("value", "updated_at", "batch_id"), F.col("batch_id")).alias("_v"))
    last.select(*keys, "_v.*").write.parquet(f"{changes_path}/batch=compacted-{uuid.uuid4().hex}")
    for name in old:
        Folder(spark, f"{changes_path}/{name}").remove()


# ---- stateful processors --------------------------------------------------------------------------------------
def _micros(times: pd.Series) -> np.ndarray:
    """Microseconds since the epoch, whatever unit the frame came in."""
    return pd.to_datetime(times).to_numpy().astype("datetime64[us]").astype(np.int64)


class RateLimitProcessor(StatefulProcessor):
    """Sliding-window acceptance per key; state = the last accepted times (at most n). The rows of a key come in Arrow
    chunks; only their times and ids are held while a micro-batch is put in order."""

    def __init__(self, n: int, window_s: float, inclusive: bool, id_col: str, ts_col: str):
        self.n, self.window_s, self.inclusive, self.id_col, self.ts_col = n, window_s, inclusive, id_col, ts_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getListState("accepted", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, ids = zip(*[(_micros(pdf[self.ts_col]), pdf[self.id_col].to_numpy()) for pdf in rows])
        us, ids = np.concatenate(us), np.concatenate(ids)
        order = np.lexsort((ids, us))
        held = sorted(t for (t,) in self.accepted.get()) if self.accepted.exists() else []
        ring = AcceptedTimes(self.n, self.window_s, self.inclusive, held)
        for at in range(0, len(order), ROWS_OUT):
            some = order[at:at + ROWS_OUT]
            granted = [ring.offer(t) for t in (us[some] / 1e6).tolist()]
            yield pd.DataFrame({"key": [key[0]] * len(some), "id": ids[some],
                                "ts": us[some].astype("datetime64[us]"), "granted": granted})
        self.accepted.put([(t,) for t in ring.times()])

    def close(self) -> None:
        pass


def rate_limit_stream(stream_df: DataFrame, key: str, ts: str, id_col: str, n: int, window_s: float,
                      inclusive: bool = True) -> DataFrame:
    """Stream form of ``sliding_rate_limit``: rows of a micro-batch are decided in time order after the rows of
    earlier batches. Output (key, id, ts, granted)."""
    ensure_rocksdb(stream_df.sparkSession)
    kt = stream_df.schema[key].dataType.simpleString()
    it = stream_df.schema[id_col].dataType.simpleString()
    tt = stream_df.schema[ts].dataType.simpleString()
    return (stream_df.select(key, ts, id_col).groupBy(key).transformWithStateInPandas(
        statefulProcessor=RateLimitProcessor(n, window_s, inclusive, id_col, ts),
        outputStructType=f"key {kt}, id {it}, ts {tt}, granted boolean", outputMode="Append", timeMode="None"))


def _us(x) -> int:
    return int(pd.Timestamp(x).value // 1_000)


class SilenceProcessor(StatefulProcessor):
    """Per key: last event time (microseconds) and an event-time timer at last + limit (timers are in
    milliseconds: rounded up). Gaps longer than the limit between events of a batch are reported directly; a key
    that stays silent is reported when the watermark passes its timer."""

    def __init__(self, limit_s: float, ts_col: str):
        self.limit_us, self.ts_col = int(limit_s * 1_000_000), ts_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(_us(t) for pdf in rows for t in pdf[self.ts_col])
        prev = self.last.get()[0] if self.last.exists() else None
        out = []
        for t in times:
            if prev is not None and t - prev > self.limit_us:
                out.append((key[0], prev, (t - prev) / 1e6))
            prev = t if prev is None or t > prev else prev
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.last.update((prev,))
        self.handle.registerTimer(-(-(prev + self.limit_us) // 1000))
        if out:
            yield _silence_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        prev = self.last.get()[0]
        yield _silence_frame([(key[0], prev, self.limit_us / 1e6)])

    def close(self) -> None:
        pass


def _silence_frame(rows):
    return pd.DataFrame({"key": [r[0] for r in rows],
                         "silent_from": pd.to_datetime([r[1] for r in rows], unit="us"),
                         "silent_seconds": [float(r[2]) for r in rows]})


def silent_key_stream(stream_df: DataFrame, key: str, ts: str, limit_seconds: float,
                      watermark: str = "0 seconds") -> DataFrame:
    """Stream form of ``silent_key_alert``: (key, silent_from, silent_seconds); a still-open silence is reported
    with the limit as its length (it is only known to be at least that long)."""
    ensure_rocksdb(stream_df.sparkSession)
    kt = stream_df.schema[key].dataType.simpleString()
    # names with a leading underscore do not reach the Python processor under their own name: use a plain one
    s = stream_df.select(key, F.col(ts).cast("timestamp").alias("event_ts")).withWatermark("event_ts", watermark)
    return s.groupBy(key).transformWithStateInPandas(
        statefulProcessor=SilenceProcessor(limit_seconds, "event_ts"),
        outputStructType=f"key {kt}, silent_from timestamp_ntz, silent_seconds double",
        outputMode="Append", timeMode="EventTime")


class IdleProcessor(StatefulProcessor):
    """Per key: the last event time, and when by the clock of the machine it came. The timer runs on that clock, so it
    fires although the whole source has stopped."""

    def __init__(self, limit_s: float, ts_col: str):
        self.limit_ms, self.ts_col = int(limit_s * 1000), ts_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, heard_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(_micros(pdf[self.ts_col]).max()) for pdf in rows)
        if self.last.exists():
            newest = max(newest, self.last.get()[0])
        now = timerValues.getCurrentProcessingTimeInMs()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.last.update((newest, now))
        self.handle.registerTimer(now + self.limit_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        us, heard = self.last.get()
        yield _silence_frame([(key[0], us, (timerValues.getCurrentProcessingTimeInMs() - heard) / 1000.0)])

    def close(self) -> None:
        pass


def idle_key_stream(stream_df: DataFrame, key: str, ts: str, limit_seconds: float) -> DataFrame:
    """(key, silent_from, silent_seconds): a key from which nothing has come for ``limit_seconds`` by the clock, once per
    silence, whether other keys send or the whole source stands still (run it with a processing-time trigger: every trigger
    looks at the timers). ``silent_from`` is its last event time, ``silent_seconds`` how long nothing has come."""
    ensure_rocksdb(stream_df.sparkSession)
    kt = stream_df.schema[key].dataType.simpleString()
    s = stream_df.select(key, F.col(ts).cast("timestamp").alias("event_ts"))
    return s.groupBy(key).transformWithStateInPandas(
        statefulProcessor=IdleProcessor(limit_seconds, "event_ts"),
        outputStructType=f"key {kt}, silent_from timestamp_ntz, silent_seconds double",
        outputMode="Append", timeMode="ProcessingTime")


def first_valid_claim_stream(claims: DataFrame, tickets: DataFrame, devices: DataFrame, life: str,
                             watermark: str = "10 minutes") -> DataFrame:
    """Stream form of ``first_valid_claim``: (token, device, claimed_at). Claims (token, claimed_at, claim_id) and tickets
    (token, device_id, expires_at) are two streams, joined on the token while the claim lies within ``life`` before the
    expiry: both sides keep rows only until the watermarks rule a partner out. Of the matches of a ticket the earliest is
    given out when the watermark has passed its expiry, whatever the order in which claims came. ``devices`` is a table."""
    t = tickets.join(devices.select("device_id", F.col("status").alias("device_status")), "device_id", "inner")
    t = t.where(F.col("device_status").isNotNull() & (F.col("device_status") != "revoked"))
    t = (t.select(F.col("token").alias("ticket"), "device_id", F.col("expires_at").cast("timestamp").alias("expires_at"))
         .withWatermark("expires_at", watermark))
    c = (claims.select("token", F.col("claimed_at").cast("timestamp").alias("claimed_at"), "claim_id")
         .withWatermark("claimed_at", watermark))
    within = ((F.col("token") == F.col("ticket")) & (F.col("claimed_at") < F.col("expires_at"))
              & (F.col("claimed_at") >= F.col("expires_at") - F.expr(f"INTERVAL {life}")))
    first = F.min_by(F.struct("device_id", "claimed_at"), F.struct("claimed_at", "claim_id")).alias("first")
    return (c.join(t, within, "inner").groupBy("token", "expires_at").agg(first)
            .select("token", F.col("first.device_id").alias("device"),
                    F.col("first.claimed_at").cast("timestamp_ntz").alias("claimed_at"), "expires_at"))


class TrackerProcessor(StatefulProcessor):
    """Phase / deadline tracker; the open phase's deadline is an event-time timer."""

    def __init__(self, ts_col: str, event_col: str, id_col: str | None = None, safe_col: str | None = None):
        self.ts_col, self.event_col, self.id_col, self.safe_col = ts_col, event_col, id_col, safe_col

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tracker", "phase string, since double, ssh double, safe boolean")

    def _load(self, safe: bool = False) -> Tracker:
        if self.state.exists():
            return Tracker(*self.state.get())
        return Tracker(protected=safe)

    def _save(self, st: Tracker) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if st.phase is None:
            self.state.clear()
            return
        self.state.update((st.phase, st.since, st.ssh_fail_since, bool(st.protected)))
        d, _ = st.deadline()
        if d is not None:  # a protected entity may boot for as long as it takes
            self.handle.registerTimer(int(d * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunks = [(_micros(pdf[self.ts_col]), pdf[self.event_col].to_numpy(dtype=object),
                   pdf[self.id_col].to_numpy() if self.id_col else np.zeros(len(pdf)),
                   pdf[self.safe_col].to_numpy(dtype=bool) if self.safe_col else np.zeros(len(pdf), bool)) for pdf in rows]
        us, events, ids, safe = (np.concatenate(x) for x in zip(*chunks))
        order = np.lexsort((ids, us))
        st, out = self._load(bool(safe[0])), []
        for t, ev in zip((us[order] / 1e6).tolist(), events[order].tolist()):
            for v in (st.expire(t), st.step(ev, t)):
                if v:
                    out.append((key[0],) + v)
        self._save(st)
        if out:
            yield _tracker_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        st = self._load()
        v = st.expire(expiredTimerInfo.getExpiryTimeInMs() / 1000.0)
        self._save(st)
        if v:
            yield _tracker_frame([(key[0],) + v])

    def close(self) -> None:
        pass


def _tracker_frame(rows):
    return pd.DataFrame({"key": [r[0] for r in rows], "phase": [r[1] for r in rows], "verdict": [r[2] for r in rows],
                         "reason": [r[3] for r in rows],
                         "at": pd.to_datetime([int(round(r[4] * 1e6)) for r in rows], unit="us")})


def deadline_tracker_stream(stream_df: DataFrame, key: str, ts: str, event: str, watermark: str = "0 seconds",
                            tiebreak: str | None = None, protected: str | None = None) -> DataFrame:
    """Stream form of ``deadline_tracker``: verdict rows (ready / failed) as they happen; a deadline fails its
    phase when the watermark passes it. Events of equal time are taken in the order of ``tiebreak``. ``protected`` names a
    boolean column that is constant per entity (for instance from a join with a table of them)."""
    ensure_rocksdb(stream_df.sparkSession)
    kt = stream_df.schema[key].dataType.simpleString()
    extra = [F.col(tiebreak).alias("event_order")] if tiebreak else []
    extra += [F.coalesce(F.col(protected), F.lit(False)).alias("event_safe")] if protected else []
    s = stream_df.select(key, F.col(ts).cast("timestamp").alias("event_ts"), event, *extra) \
        .withWatermark("event_ts", watermark)
    return s.groupBy(key).transformWithStateInPandas(
        statefulProcessor=TrackerProcessor("event_ts", event, "event_order" if tiebreak else None,
                                           "event_safe" if protected else None),
        outputStructType=f"key {kt}, phase string, verdict string, reason string, at timestamp_ntz",
        outputMode="Append", timeMode="EventTime")


def to_parquet(stream_out: DataFrame, path: str, checkpoint: str | None = None):
    """Append-mode Parquet file sink (exactly-once through its commit log)."""
    spark = stream_out.sparkSession
    return (stream_out.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint or new_checkpoint(spark, "sink")))

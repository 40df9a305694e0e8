"""Stream forms: claims joined as streams, silence by the clock, protected entities, segments on one sorted copy."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import bi, ranking, sequential, windows
from tessera.session import scratch_path
from tessera.streaming import jobs

LIFE = "20 minutes"


def landed(spark, df, name, files=1):
    """``df`` as a folder table; its files are read in the order of their writing."""
    folder = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    for i in range(files):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")
        time.sleep(0.01)
    return folder


@pytest.mark.parametrize("files", [1, 5])
def test_claim_stream_equals_the_batch_in_one_and_in_many_batches(spark, files):
    import datetime as dt
    import random
    rnd, begin = random.Random(files), dt.datetime(2024, 5, 1)
    at = lambda m: begin + dt.timedelta(minutes=m)
    tickets = [(f"t{i}", i % 6, at(i * 3 + 20), i * files // 60) for i in range(60)]
    claims = [(f"t{i}", at(i * 3 + rnd.choice([-30, -1, 0, 4, 19, 20, 25])), 10 * i + n, i * files // 60)
              for i in range(62) for n in range(4) if i % 9]
    claims += [("t5", at(15 + 7), 9001, 0), ("t5", at(15 + 7), 9000, 0), ("zz", at(1), 9002, 0)]
    end = at(2000)
    tickets += [("last", 1, end, files - 1)]
    claims += [("last", end, 9999, files - 1)]
    t = spark.createDataFrame(tickets, "token string, device_id long, expires_at timestamp, part int")
    c = spark.createDataFrame(claims, "token string, claimed_at timestamp, claim_id long, part int")
    devices = spark.createDataFrame([(i, "revoked" if i == 4 else None if i == 3 else "connected") for i in range(5)],
                                    "device_id long, status string")
    want = windows.first_valid_claim(c.drop("part"), t.drop("part"), devices, LIFE).where("token <> 'last'")
    path = scratch_path(spark, f"claims-{uuid.uuid4().hex}")
    c_in, t_in = landed(spark, c, "claims", files), landed(spark, t, "tickets", files)
    out = jobs.first_valid_claim_stream(jobs.file_stream(spark, c_in, "claims", max_files=1),
                                        jobs.file_stream(spark, t_in, "tickets", max_files=1), devices, LIFE, "3 hours")
    jobs.run_available(jobs.to_parquet(out, path), spark, 4)
    got = sorted((r["token"], r["device"], r["claimed_at"]) for r in spark.read.parquet(path).collect())
    assert got == sorted((r["token"], r["device"], r["claimed_at"]) for r in want.collect()) and len(got) > 15


def test_a_source_that_stands_still_is_reported_by_the_clock(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:05"), (1, "2024-01-01 00:00:09"), (2, "2024-01-01 00:00:02")],
                               "host long, ts string").withColumn("ts", F.to_timestamp("ts")).withColumn("part", F.lit(0))
    folder, path = landed(spark, df, "beats"), scratch_path(spark, f"idle-{uuid.uuid4().hex}")
    stream = jobs.idle_key_stream(jobs.file_stream(spark, folder, "beats"), "host", "ts", 1.0)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = jobs.to_parquet(stream, path).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):  # no row comes any more: only the clock moves
            time.sleep(0.5)
            rows = spark.read.parquet(path).collect() if query.lastProgress and query.lastProgress["batchId"] > 1 else []
            if len(rows) == 2 or query.exception():
                break
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = {r["key"]: (str(r["silent_from"]), r["silent_seconds"]) for r in spark.read.parquet(path).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "2024-01-01 00:00:09", 2: "2024-01-01 00:00:02"}
    assert all(1.0 <= v[1] < 60 for v in got.values())


def test_protected_entities_may_boot_for_as_long_as_it_takes(spark):
    rows = [(k, t, e, i) for i, (k, t, e) in enumerate(
        (k, t, e) for k in (1, 2) for t, e in ((0, "start"), (100_000, "ssh_ok"), (100_060, "ready")))]
    rows += [(3, 200_000, "start", 99)]
    df = spark.createDataFrame(rows, "host long, s long, event string, n long").withColumn(
        "ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).withColumn("part", F.lit(0))
    safe = spark.createDataFrame([(2, True)], "host long, safe boolean")
    batch = sequential.deadline_tracker(df.join(safe, "host", "left"), "host", "ts", "event", "2023-11-17 08:00:00",
                                        tiebreak="n", protected="safe")
    want = sorted((r["key"], r["verdict"]) for r in batch.where("verdict <> 'pending'").collect())
    folder, path = landed(spark, df, "machines"), scratch_path(spark, f"safe-{uuid.uuid4().hex}")
    source = jobs.file_stream(spark, folder, "machines").join(safe, "host", "left")
    jobs.run_available(jobs.to_parquet(jobs.deadline_tracker_stream(source, "host", "ts", "event", tiebreak="n",
                                                                    protected="safe"), path), spark, 2)
    got = sorted((r["key"], r["verdict"]) for r in spark.read.parquet(path).collect())
    assert (1, "failed") in got and (2, "ready") in got and (2, "failed") not in got
    assert got == [w for w in want if w[0] < 3]


def test_segments_equal_a_plain_count_over_many_partitions(spark):
    import random
    rnd = random.Random(8)
    rows = [(0 if rnd.random() < 0.6 else rnd.randint(1, 9), rnd.randint(0, 4000), i) for i in range(3000)]
    rows += [(None, 5, 9000), (None, 90, 9001), (77, 1, 9002)]
    df = spark.createDataFrame(rows, "k long, t long, i long").repartition(6)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r["i"]: r["seg"] for r in ranking.segments(df, ["k"], ["t", "i"], "t", F.col("t") - F.col("_before") > 3,
                                                          "seg").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want, last = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        before, seg = last.get(k, (t, 0))
        last[k] = (t, seg + (t - before > 3))
        want[i] = last[k][1]
    assert got == want and len(set(want.values())) > 20


def test_equal_values_are_counted_before_they_are_ranked(spark):
    df = spark.createDataFrame([("a", 1.0, True)] * 400 + [("a", float(i), True) for i in range(2, 42)] + [("b", 3.0, True),
                               ("b", 9.0, False), (None, 4.0, True), ("c", None, True), ("c", 2.0, True)],
                               "g string, v double, ok boolean")
    got = {r["g"]: (r["ok_rows"], r["p95"]) for r in bi.nearest_rank_p95(df, "g", "v", "ok").collect()}
    assert got == {"a": (440, sorted([1.0] * 400 + [float(i) for i in range(2, 42)])[417]), "b": (1, 3.0), None: (1, 4.0),
                   "c": (2, None)}
    upto = bi.counted_up(df.select("g", F.col("v").alias("_v")), ["g"])
    assert upto.count() == 41 + 2 + 1 + 2

"""Stored tables: the switch of a refresh, views over views, keyed upserts, done keys, parity by bucket."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins, parity
from tessera.plans.dashboards import MEDIAN_VIEWS
from tessera.plans.standins import Tables, indicators
from tessera.session import scratch_path
from tessera.sources import keyed, sinks, versions
from tessera.sources.folders import Folder
from tests.conftest import SMALL


class Killed(Exception):
    pass


def killed_at(monkeypatch, step):
    """The ``step``-th of the file system's changes from now on, and every later one, is not made."""
    left = [step]

    def guard(name):
        real = getattr(Folder, name)

        def run(self, *args):
            left[0] -= 1
            if left[0] < 0:
                raise Killed(name)
            return real(self, *args)
        monkeypatch.setattr(Folder, name, run)
    for name in ("touch", "remove", "put"):
        guard(name)


@pytest.mark.parametrize("step", range(4))
def test_a_folder_refresh_killed_at_any_step_leaves_old_or_new(spark, monkeypatch, step):
    target = scratch_path(spark, f"switch-{uuid.uuid4().hex}")
    for n in (1, 2, 3):
        sinks.full_refresh_sink(spark.range(n), target)
    killed_at(monkeypatch, step)
    try:
        sinks.full_refresh_sink(spark.range(10), target)
    except Killed:
        pass
    monkeypatch.undo()
    assert sinks.read_refreshed(spark, target).count() == (3 if step == 0 else 10)
    sinks.full_refresh_sink(spark.range(20, 24), target)
    assert sinks.read_refreshed(spark, target).count() == 4
    names = [n for n in Folder(spark, target).names() if n.startswith(versions.PREFIX)]
    assert len(names) == versions.KEPT == len(versions.published(spark, target))


def test_a_catalog_refresh_switches_in_one_statement(spark, monkeypatch):
    name = f"switched_{uuid.uuid4().hex[:10]}"
    two = spark.range(2).withColumn("id", F.col("id").alias("id", metadata={"comment": "the key", "table_comment": "It's two"}))
    sinks.full_refresh_sink(two, name)
    assert [c.description for c in spark.catalog.listColumns(name)] == ["the key"]
    assert spark.catalog.getTable(name).description == "It's two"
    for at in ("CREATE OR REPLACE VIEW", "DROP TABLE"):
        rows, real = spark.table(name).count(), type(spark).sql
        monkeypatch.setattr(type(spark), "sql", lambda self, q, *a, _at=at, **k: (_ for _ in ()).throw(Killed(_at))
                            if q.startswith(_at) else real(self, q, *a, **k))
        sinks_before = len(versions.version_tables(spark, name))
        try:
            sinks.full_refresh_sink(spark.range(rows + 5).withColumn("more", F.lit("x")), name)
        except Killed:
            pass
        monkeypatch.undo()
        assert spark.table(name).count() == (rows if at.startswith("CREATE") else rows + 5)
        assert len(versions.version_tables(spark, name)) == sinks_before + 1
    sinks.full_refresh_sink(spark.table(name).where("id < 3"), name)     # reads what it replaces, another schema
    assert spark.table(name).columns == ["id", "more"] and spark.table(name).count() == 3
    assert len(versions.version_tables(spark, name)) == versions.KEPT
    plain = f"plain_{uuid.uuid4().hex[:10]}"
    spark.range(4).withColumn("day", F.lit(1)).write.saveAsTable(plain)   # a table from before versions
    sinks.full_refresh_sink(spark.table(plain).where("id > 1"), plain, ["day"])
    assert sorted(r["id"] for r in spark.table(plain).collect()) == [2, 3]
    for n in (name, plain):
        for t in versions.version_tables(spark, n):
            spark.sql(f"drop table {t}")
        spark.sql(f"drop view {n}")


def test_views_are_refreshed_in_order_and_shared_ones_once(spark):
    root, built = scratch_path(spark, f"graph-{uuid.uuid4().hex}"), []

    def view(name, parents, fn=None):
        def build(frames):
            built.append(name)
            return (fn or (lambda f: next(iter(f.values()))))(frames)
        return sinks.View(name, parents, build)
    views = [view("c", ("a", "b"), lambda f: f["a"].unionByName(f["b"])), view("a", ("src",)), view("b", ("a",)),
             view("d", ("c",)), view("other", ("src",))]
    states = sinks.refresh_views(spark, views, {"src": spark.range(3)}, root)
    assert set(states.values()) == {"refreshed"} and sorted(built) == ["a", "b", "c", "d", "other"]
    assert built.index("a") < built.index("b") < built.index("c") < built.index("d")
    bad = [v if v.name != "b" else view("b", ("a",), lambda f: f["a"].select(F.raise_error(F.lit("broken view")).alias("id")))
           for v in views]
    states = sinks.refresh_views(spark, bad, {"src": spark.range(5)}, root)
    assert states["a"] == states["other"] == "refreshed" and "broken view" in states["b"]
    assert states["c"] == "skipped: b" and states["d"] == "skipped: c"
    counts = {n: sinks.read_refreshed(spark, f"{root}/{n}").count() for n in states}
    assert counts == {"a": 5, "other": 5, "b": 3, "c": 6, "d": 6}         # old rows stay, as a whole
    with pytest.raises(ValueError):
        sinks.refresh_views(spark, [view("x", ("nowhere",))], {}, root)
    with pytest.raises(Exception, match="ycle"):
        sinks.refresh_views(spark, [view("x", ("y",)), view("y", ("x",))], {}, root)


def test_medians_read_the_source_once(spark):
    """Only the shared view reads the source; the medians read its stored rows."""
    rows, root = spark.sparkContext.accumulator(0), scratch_path(spark, f"once-{uuid.uuid4().hex}")
    source = indicators(Tables(spark, SMALL))
    n = source.count()

    def seen(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b
    counted = source.mapInArrow(seen, source.schema)
    assert set(sinks.refresh_views(spark, MEDIAN_VIEWS, {"indicators": counted}, root).values()) == {"refreshed"}
    assert rows.value == n


def table_of(spark, buckets=8):
    schema = spark.createDataFrame([], "k long, v string, seq long").schema
    return keyed.KeyedTable(spark, scratch_path(spark, f"keyed-{uuid.uuid4().hex}"), schema, ("k",), buckets)


def batch(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, seq long")


def test_a_batch_rewrites_only_its_buckets_and_is_replay_safe(spark):
    table, merge = table_of(spark), keyed.last_write(["k"], ["seq"])
    table.apply(batch(spark, [(i, f"v{i}", 1) for i in range(200)]), merge, 0)
    before = table.manifest()["buckets"]
    touched = table.apply(batch(spark, [(3, "new", 2), (3, "newer", 3), (500, "five", 1), (4, "older", 0)]), merge, 1)
    after = table.manifest()["buckets"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert changed == set(map(str, touched)) and 1 <= len(changed) <= 3 < len(after) == 8
    want = {**{i: f"v{i}" for i in range(200)}, 3: "newer", 500: "five"}
    assert {r["k"]: r["v"] for r in table.rows().collect()} == want
    assert table.apply(batch(spark, [(3, "replayed", 9)]), merge, 1) == []       # delivered again
    assert table.manifest()["buckets"] == after and {r["k"]: r["v"] for r in table.rows().collect()} == want
    plan = table.rows()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    first = keyed.first_write(["k"], ["seq"])
    table.apply(batch(spark, [(3, "late", 0), (900, "b", 2), (900, "a", 1)]), first, 2)
    got = {r["k"]: r["v"] for r in table.rows().collect()}
    assert got == {**want, 900: "a"} and table.apply(batch(spark, []), merge, 3) == [] and table.manifest()["batch"] == 3
    with pytest.raises(ValueError):
        keyed.KeyedTable(spark, table.path, table.schema, ("k",), 9).rows()


@pytest.mark.parametrize("step", range(4))
def test_a_keyed_batch_killed_at_any_step_can_be_delivered_again(spark, monkeypatch, step):
    table, merge = table_of(spark, 4), keyed.last_write(["k"], ["seq"])
    for n in range(3):
        table.apply(batch(spark, [(i, f"v{n}", n) for i in range(40)]), merge, n)
    killed_at(monkeypatch, step)
    try:
        table.apply(batch(spark, [(1, "fresh", 9)]), merge, 3)
    except Killed:
        pass
    monkeypatch.undo()
    rows = {r["k"]: r["v"] for r in table.rows().collect()}
    assert rows == {**{i: "v2" for i in range(40)}, 1: "v2" if step == 0 else "fresh"}
    table.apply(batch(spark, [(1, "fresh", 9)]), merge, 3)
    table.apply(batch(spark, [(2, "last", 9)]), merge, 4)
    rows = {r["k"]: r["v"] for r in table.rows().collect()}
    assert rows == {**{i: "v2" for i in range(40)}, 1: "fresh", 2: "last"}


def test_a_stream_writes_into_a_keyed_table(spark):
    from tessera.streaming import jobs
    folder, table = scratch_path(spark, f"in-{uuid.uuid4().hex}"), table_of(spark)
    batch(spark, [(i % 50, f"v{i}", i) for i in range(500)]).repartition(5).write.parquet(f"{folder}/changes.parquet")
    stream = jobs.file_stream(spark, folder, "changes", max_files=1)
    jobs.run_available(jobs.into_keyed_table(stream, table, keyed.last_write(["k"], ["seq"])), spark)
    assert {r["k"]: r["v"] for r in table.rows().collect()} == {i: f"v{450 + i}" for i in range(50)}
    assert table.manifest()["batch"] >= 4


def test_only_the_new_side_of_a_resume_is_shuffled(spark):
    name = f"done_{uuid.uuid4().hex}"
    done = keyed.DoneTable(spark, name, "id", 8, scratch_path(spark, name))
    done.add(spark.range(0, 1000, 2))
    done.add(spark.range(1000, 1500))
    source = spark.range(1600).withColumn("text", F.lit("x"))
    out = done.todo(source)
    assert sorted(r["id"] for r in out.collect()) == [*range(1, 1000, 2), *range(1500, 1600)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") - plan.count("BroadcastExchange") - plan.count("ReusedExchange") == 1
    described = {r["info_name"]: r["info_value"] for r in spark.sql(f"describe extended {name} id").collect()}
    assert described["num_nulls"] == "0" and described["distinct_count"] not in (None, "NULL")
    spark.sql(f"drop table {name}")


def test_parity_gives_the_rows_of_the_diff_and_joins_only_what_differs(spark):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 5).alias("a"),
                                      F.when(F.col("id") % 3 == 0, F.lit("x")).alias("b"))
    right = left.where("id not in (5, 777)").withColumn("a", F.when(F.col("id") == 9000, 99).otherwise(F.col("a"))).unionByName(
        spark.createDataFrame([(30_000, 1, None)], "id long, a long, b string"))
    got = parity.table_parity(left, right, ["id"], ["a", "b"]).collect()
    want = joins.table_diff(left, right, ["id"], ["a", "b"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    buckets, by = parity.differing_buckets(left, right, ["id"], ["a", "b"])
    assert buckets.count() == 4 and len(by) == 3                  # sorted out level by level
    equal = parity.table_parity(left, left.repartition(3), ["id"], ["a", "b"])
    assert "Join" not in equal._jdf.queryExecution().executedPlan().toString() and equal.count() == 20_000
    swapped = left.select("id", F.col("b").alias("a"), F.col("a").cast("string").alias("b"))
    assert parity.differing_buckets(left.select("id", F.col("a").cast("string").alias("a"), "b"), swapped, ["id"],
                                    ["a", "b"])[0] is not None    # a null elsewhere is another row
    empty = left.limit(0)
    assert {r["status"] for r in parity.table_parity(left, empty, ["id"], ["a", "b"]).collect()} == {"missing"}
    assert parity.table_parity(empty, empty, ["id"], ["a", "b"]).count() == 0


def test_unreadable_lines_are_kept_apart_and_counts_add_up(spark):
    from tessera.sources import text
    path = scratch_path(spark, f"lines-{uuid.uuid4().hex}")
    lines = ['{"key": "a", "status": "ok", "seq": 1}', '{"key": "b", "seq": null, "extra": [1]}', '{"key": "c", "sta', "", "  ",
             '"text"', "7", "null", '{"key": null, "seq": 2}', '{"key": "d", "seq": "x"}', '{"key": 5, "seq": 3}', "{}"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    got = text.read_ledger_lines(spark, path)
    rows = sorted(map(tuple, got.rows.collect()))
    assert rows == [("5", None, 3), ("a", "ok", 1), ("b", None, None)]
    bad = {r["line"]: r["reason"] for r in got.unreadable.collect()}
    assert bad == {'{"key": "c", "sta': "not JSON", '"text"': "not an object", "7": "not an object", "null": "not an object",
                   '{"key": null, "seq": 2}': "key: missing", '{"key": "d", "seq": "x"}': "seq: not a bigint",
                   "{}": "key: missing"}
    assert len(rows) + len(bad) == sum(bool(x.strip()) for x in lines)
    assert all(path.split("/")[-1] in r["file"] for r in got.unreadable.collect())
    either = spark.createDataFrame([('"flat"',), ('{"name": "inner"}',), ('{"other": 1}',), ("3",)], "j string").select(
        text.scalar_or_member(F.parse_json("j"), "name").alias("t"))
    assert [r["t"] for r in either.collect()] == ["flat", "inner", None, "3"]

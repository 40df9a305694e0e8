"""Rules that hold at any size or on awkward input: large rule tables, empty and missing rows, failed refreshes, folder
tables in streams, workers started elsewhere, hot values."""

import os
import subprocess
import sys
import textwrap
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tessera.operators import alerts, checks, joins, offers, progress, reconcile
from tessera.operators.quantile import exact_percentile
from tessera.operators.ranking import with_next, with_previous
from tessera.session import scratch_path
from tessera.sources import sinks, tables, text
from tessera.streaming import jobs

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run_elsewhere(tmp_path, code, **env):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | env
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=clean, text=True,
                          capture_output=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_queries_import_without_a_jar_folder_or_session(tmp_path):
    out = run_elsewhere(tmp_path, f"""
        import sys, glob, zipfile
        sys.path.insert(0, {REPO!r})
        def gone(*a, **k):
            raise FileNotFoundError("no jars here")
        glob.glob = zipfile.ZipFile.__init__ = gone
        import __spark_entry__ as e
        print(len(e.queries()), len(e.oracle_sql()))""")
    q, o = map(int, out.split())
    assert q >= 120 and o >= 120


def test_python_worker_queries_run_from_another_folder(tmp_path):
    out = run_elsewhere(tmp_path, f"""
        import sys
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
            "spark.sql.shuffle.partitions", "4").getOrCreate()
        sys.path.insert(0, {REPO!r})
        import __spark_entry__ as e
        q = e.queries()
        for name in ("batch_embed", "sliding_rate_limit", "deadline_tracker", "rate_limit_stream"):
            print(name, q[name](spark, {SMALL!r}).count())""", TMPDIR=str(tmp_path))
    assert len(out.strip().splitlines()) == 4


def test_a_local_session_leaves_no_checkpoint_files(tmp_path):
    out = run_elsewhere(tmp_path, f"""
        import sys, os
        sys.path.insert(0, {REPO!r})
        from tessera.session import build_session, checkpoint_dir
        spark = build_session("local[2]", 4, extra={{"spark.sql.warehouse.dir": {str(tmp_path)!r}}})
        from tessera.plans import QUERIES, load_all
        load_all()
        QUERIES["median_by_year"](spark, {SMALL!r}).count()
        made = checkpoint_dir(spark)
        assert os.listdir(made.removeprefix("file:"))
        print(made)""", TMPDIR=str(tmp_path))
    assert not os.path.exists(out.strip().splitlines()[-1].removeprefix("file:"))


@pytest.mark.parametrize("most", [1000, 3])
def test_prefix_rules_compiled_and_joined_agree(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "RULES_MAX_ROWS", most)
    rules = spark.createDataFrame([(1, "Café pro", "a"), (2, "cafe", "b"), (3, "x", "c"), (4, "xy", "d"), (5, "", "e")],
                                  "rank int, prefix string, target string")
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["Café Pro max", "CAFE", "xyz", "zzz", "", None])],
                                  "i int, name string")
    got = {r["i"]: r["target"] for r in reconcile.prefix_lookup(names, "name", rules).collect()}
    assert got == {0: "a", 1: "b", 2: "c", 3: "e", 4: "e", 5: "e"}    # a null name counts as empty


def test_a_thousand_and_one_rules(spark):
    rules = spark.createDataFrame([(i, f"product {i:04d} ", f"t{i}") for i in range(1001)],
                                  "rank int, prefix string, target string")
    names = spark.createDataFrame([("Product 0007 gold",), ("product 1000 x",), ("other",)], "name string")
    got = {r["name"]: r["target"] for r in reconcile.prefix_lookup(names, "name", rules).collect()}
    assert got == {"Product 0007 gold": "t7", "product 1000 x": "t1000", "other": None}


def test_document_rules_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "alpha beta gamma"), (4, None)],
                                 "id int, body string")
    rules = spark.createDataFrame([(1, "A", "alpha"), (2, "B", "beta"), (3, "C", "gamma")],
                                  "rank int, name string, pattern string")
    whole = sorted(map(tuple, checks.document_rules(docs, "id", "body", rules).collect()))
    assert whole == [(1, "C"), (2, "A"), (4, "A; B; C")]
    monkeypatch.setattr(joins, "RULES_MAX_ROWS", 2)
    monkeypatch.setattr(checks, "RULES_MAX_ROWS", 2)
    assert sorted(map(tuple, checks.document_rules(docs, "id", "body", rules).collect())) == whole


def test_readme_rules_of_given_domains(spark):
    docs = spark.createDataFrame([(1, "see https://shop.example.org"), (2, "see https://other.net")], "id int, t string")
    rules = [(i, n, p) for i, (n, p) in enumerate(checks.readme_rules(("shop.example.org",)))]
    got = {r["doc_id"]: r["missing"] for r in checks.document_rules(
        docs, "id", "t", spark.createDataFrame(rules, "rank int, name string, pattern string")).collect()}
    assert "onde está no ar" not in got[1] and "onde está no ar" in got[2]


def test_empty_required_table_is_found(spark):
    counts = progress.table_counts({"region": spark.range(0), "nation": spark.range(25)})
    expected = spark.createDataFrame([("region", 5), ("nation", 25)], "table string, expected long")
    required = tables.literal_frame(spark, [("region",), ("nation",)], "table string")
    got = {r["table"]: r["status"] for r in progress.row_count_audit(counts, expected, required).collect()}
    assert got == {"region": "empty_required", "nation": "ok"}


def test_absent_signals_are_alerts(spark):
    got = alerts.threshold_alerts(spark.createDataFrame([(1, "disk_pct", 50.0)],
                                                        "sample_id long, signal string, value double"),
                                  alerts.limits_frame(spark)).collect()
    assert {r["signal"]: r["ok"] for r in got} == {
        "disk_pct": True, "pg_connections_pct": False, "pg_cache_pct": False, "pg_longest_tx_s": False,
        "store_5xx_pct": True, "backup_hours": False, "store_ready": False, "collector": True}


def test_coverage_completes_by_an_empty_pass(spark):
    def complete(done, last):
        return progress.coverage_ratio(spark.range(done), spark.range(1000), last_pass=last).first()["complete"]
    assert complete(995, None) and not complete(900, None)
    assert complete(900, spark.range(0)) and not complete(900, spark.range(3))


def test_unreadable_record_is_its_own_problem(spark):
    runs = spark.createDataFrame([("a", "ok", None, True, None), ("b", "ok", "2024-01-01 00:00:00", True, None)],
                                 "subject string, kind string, finished_at string, flag boolean, reason string")
    got = {r["subject"]: r["problems"] for r in checks.freshness_alert(
        runs.withColumn("finished_at", F.to_timestamp("finished_at")), "2024-01-01 05:00:00").collect()}
    assert got == {"a": "unreadable run record", "b": ""}


@pytest.mark.parametrize("kind", ["folder", "table"])
def test_a_failing_refresh_leaves_the_old_rows(spark, kind):
    name = scratch_path(spark, f"refresh-{uuid.uuid4().hex}") if kind == "folder" else f"refresh_{uuid.uuid4().hex}"
    read = (lambda at: sinks.read_refreshed(spark, at)) if kind == "folder" else spark.table
    sinks.full_refresh_sink(spark.range(3), name)
    bad = spark.range(2000).withColumn("id", F.when(F.col("id") < 1500, F.col("id")).otherwise(
        F.raise_error(F.lit("broken row")).cast("long")))
    with pytest.raises(Exception, match="broken row"):
        sinks.full_refresh_sink(bad, name)
    assert sorted(r["id"] for r in read(name).collect()) == [0, 1, 2]
    sinks.full_refresh_sink(read(name).select((F.col("id") + 10).alias("id")), name)     # reads what it replaces
    assert sorted(r["id"] for r in read(name).collect()) == [10, 11, 12]


def test_insert_if_absent_keeps_the_first_new_row(spark):
    target = spark.createDataFrame([(1, "old", 0)], "k long, v string, seq long")
    new = spark.createDataFrame([(2, "late", 9), (2, "first", 1), (1, "again", 1)], "k long, v string, seq long")
    got = sorted(map(tuple, sinks.insert_if_absent(target, new, ["k"], order=["seq"]).collect()))
    assert got == [(1, "old", 0), (2, "first", 1)]


def test_catalog_errors_are_whole_and_do_not_stop_others(spark):
    good = tables.TableSpec(f"{SMALL}/nation.parquet")
    long_name = "/nowhere/" + "x" * 400
    got = {r["table"]: r for r in tables.load_catalog(spark, {"bad": tables.TableSpec(long_name), "good": good}).collect()}
    assert got["good"]["rows"] == 25 and got["bad"]["rows"] is None and long_name in got["bad"]["error"]


def test_offer_limits_and_emergency(spark):
    rows = spark.createDataFrame([(1, 10, 2.0, 0.0), (2, 11, 3.0, 0.0)],
                                 "offer_id long, machine_id long, base_cost double, storage_cost double")
    none = spark.createDataFrame([], "machine_id long")

    def accept(current, **kw):
        return offers.cheapest_offer(rows, none, none, {}, current, **kw).first()["accept"]
    assert accept(3.0) and not accept(1.0)
    assert accept(3.0, live=spark.range(1)) and not accept(3.0, live=spark.range(2))
    assert accept(1.0, emergency=True, in_test=spark.range(1), live=spark.range(5))
    assert not accept(1.0, emergency=True, in_test=spark.range(2))


def test_empty_ids_and_names_fall_through(spark):
    path = scratch_path(spark, f"orders-{uuid.uuid4().hex}")
    spark.createDataFrame([('{"id": "", "refId": "r1", "product": {"name": ""}, "product_name": "flat"}',)],
                          "value string").write.text(path)
    row = text.read_json_orders(spark, {"one": path}).first()
    assert (row["order_id"], row["product_name"]) == ("r1", "flat")


def test_streams_read_folder_tables_in_one_or_many_batches(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = scratch_path(spark, f"tables-{uuid.uuid4().hex}")
    events.repartition(5).write.parquet(f"{folder}/events.parquet")
    results = []
    for source, files in ((SMALL, 64), (folder, 64), (folder, 1)):
        path = scratch_path(spark, f"out-{uuid.uuid4().hex}")
        stream = jobs.file_stream(spark, source, "events", max_files=files).select("event_id", "ts", "event_type", "value")
        jobs.run_available(jobs.sample_stream(stream, path, keep_days=400), spark)
        results.append(sorted(r["event_id"] for r in spark.read.parquet(path).collect()))
    assert len(results[0]) == events.count() and results[0] == results[1] == results[2]


def test_compacted_votes_stay_the_same(spark):
    path = scratch_path(spark, f"votes-{uuid.uuid4().hex}")
    changes = [(0, [("a", 1, 1), ("a", 2, -1)]), (1, [("a", 1, 0), ("b", 1, 1)]), (2, [("a", 2, 1)])]
    for n, rows in changes:
        (spark.createDataFrame([(*r, n, n) for r in rows], "slug string, voter long, value int, updated_at long, batch_id int")
         .write.parquet(f"{path}/batch={n:010d}"))
    before = sorted(map(tuple, jobs.current_votes(spark, path).collect()))
    assert before == [("a", 2, 1, 2), ("b", 1, 1, 1)]
    jobs.compact_votes(spark, path)
    assert sorted(map(tuple, jobs.current_votes(spark, path).collect())) == before
    assert spark.read.parquet(path).count() == 3
    spark.createDataFrame([("b", 1, 0, 3, 3)], "slug string, voter long, value int, updated_at long, batch_id int") \
        .write.parquet(f"{path}/batch=0000000003")
    jobs.compact_votes(spark, path)
    assert sorted(map(tuple, jobs.current_votes(spark, path).collect())) == [("a", 2, 1, 2)]


def test_percentile_with_one_value_in_a_third_of_the_rows(spark):
    rng = np.random.default_rng(0)
    values = [0.0] * 1000 + rng.normal(size=2000).round(2).tolist()
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)] + [(None, 5.0), (0, None)], "g long, v double")
    got = {r["g"]: (r["percentile"], r["n"]) for r in exact_percentile(df, ["g"], "v", 0.37, with_count="n").collect()}
    for g in (0, 1):
        own = values[g::2]
        assert got[g] == (pytest.approx(np.quantile(own, 0.37)), len(own))
    assert got[None] == (5.0, 1)
    assert exact_percentile(df, [], "v", 0.5).first()[0] == pytest.approx(np.median(values + [5.0]))


def test_neighbours_cross_partitions(spark):
    rows = [(0 if i % 3 else i % 5, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, t long")
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted(t for x, t in rows if x == k)
        want |= {t: (own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None) for i, t in enumerate(own)}
    back = {r["t"]: r["prev_t"] for r in with_previous(df, ["k"], ["t"], ["t"]).collect()}
    ahead = {r["t"]: r["next_t"] for r in with_next(df, ["k"], ["t"], ["t"]).collect()}
    assert {t: (back[t], ahead[t]) for t in want} == want


def test_comments_are_split_and_trimmed_at_every_unicode_space(spark):
    from tessera.functions import predicates
    rows = spark.createDataFrame([("\u00a0Ana\u2003\u2003Maria \x1c", "\u3000 a body \x85"), ("Bo\tB", "\u2028x\u2029y\u2028")],
                                 "name string, body string")
    got = [(r["clean_name"], r["clean_body"]) for r in predicates.moderate_comments(rows).collect()]
    assert got == [(" ".join(n.split()), b.strip()) for n, b in (("\u00a0Ana\u2003\u2003Maria \x1c", "\u3000 a body \x85"),
                                                                 ("Bo\tB", "\u2028x\u2029y\u2028"))]

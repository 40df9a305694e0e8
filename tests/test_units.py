"""Unit checks on hand-made rows: type rules, vector dimension check, comments, parsers, moderation, images,
secrets, exact percentiles with a hot group, skew-safe ranking."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.functions import predicates as P
from tessera.functions import scalar as S
from tessera.operators import checks as C
from tessera.operators.quantile import exact_percentile
from tessera.operators.ranking import rank_within, with_previous
from tessera.sources import tables, text


def test_conform_schema_type_rules(spark):
    schema = T.StructType([T.StructField("a", T.ShortType()), T.StructField("b", T.FloatType()),
                           T.StructField("c", T.ArrayType(T.IntegerType())), T.StructField("d", T.DecimalType(20, 0)),
                           T.StructField("e", T.StructType([T.StructField("x", T.IntegerType())])),
                           T.StructField("f", T.BinaryType()), T.StructField("g", T.LongType()),
                           T.StructField("h", T.StringType())])
    df = spark.createDataFrame([], schema)
    out = tables.conform_schema(df, dropped={"h"})
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [
        ("a", "int"), ("b", "double"), ("d", "decimal(20,0)"), ("g", "bigint")]


def test_load_vectors_rejects_wrong_dimension(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, v array<float>")
    with pytest.raises(Exception, match="wrong dimension"):
        tables.load_vectors(df, "id", "v", 2).collect()


def test_carry_comments_cut(spark):
    df = spark.createDataFrame([(1,)], "a long")
    out = tables.carry_comments(df, "t" * 2000, {"a": "c" * 900})
    meta = out.schema["a"].metadata
    assert len(meta["comment"]) == 500 and len(meta["table_comment"]) == 1000


def test_parsers(spark):
    lines = spark.createDataFrame([("reqs_total{code=\"200\"} 10",), ("reqs_total 5",), ("# HELP x",),
                                   ("bad line",)], "value string")
    got = {r["metric"]: r["total"] for r in text.sum_metrics(text.parse_metric_text(lines)).collect()}
    assert got == {"reqs_total": 15.0}
    kv = spark.createDataFrame([(1, "A=1"), (2, " # c=2"), (3, "B = x=y"), (4, "A=3"), (5, "bad key=1"), (6, "")],
                               "n long, value string")
    assert {r["key"]: r["value"] for r in text.parse_key_values(kv, "n").collect()} == {"A": "3", "B": " x=y"}
    usage = spark.createDataFrame([("rt_acme 10 0 20 0",), ("rt_x 1",), ("other 1 2 3 4",)], "value string")
    assert [tuple(r) for r in text.parse_usage_report(usage).collect()] == [("acme", 10240, 20480)]


def test_moderation(spark):
    rows = [("Ana", "ok body", ""), ("  A   b ", " hi ", ""), ("", "body", ""), ("Bob", "x", ""),
            ("Bot", "hello", "filled"), ("Eve", "http://a http://b https://c", ""), ("N" * 61, "body", "")]
    df = spark.createDataFrame(rows, "name string, body string, site string")
    out = {r["body"]: (r["reason"], r["accepted"], r["clean_name"]) for r in
           P.moderate_comments(df, honeypot="site").collect()}
    assert out["ok body"] == (None, True, "Ana")
    assert out[" hi "] == (None, True, "A b")
    assert out["body"][0] in ("name_length",)
    assert out["x"][0] == "body_length"
    assert out["hello"][:2] == ("honeypot", True)
    assert out["http://a http://b https://c"][0] == "too_many_links"


def test_image_links_and_secrets(spark):
    docs = spark.createDataFrame([(1, "![a](docs/img/x.png) and <img class=\"c\" src=\"https://h/y.png\">"),
                                  (2, "no images"), (3, "password: abcdefghijklmnopqrst and token=your-token-here-xx")],
                                 "id long, t string")
    imgs = sorted((r["doc_id"], r["target"], r["is_local"]) for r in C.image_links(docs, "id", "t").collect()
                  if r["target"])
    assert imgs == [(1, "docs/img/x.png", True), (1, "https://h/y.png", False)]
    assert {r["doc_id"] for r in C.image_links(docs, "id", "t").collect() if r["target"] is None} == {2, 3}
    sec = C.secret_scan(docs, "id", "t").collect()
    assert [(r["doc_id"], r["key_name"], r["hits"]) for r in sec] == [(3, "password", 1)]


def test_strip_accents_and_first_sentence(spark):
    df = spark.createDataFrame([("Ação Métrica ÅØß", "**Sistema** de `busca`. Segunda frase.")], "a string, b string")
    r = df.select(S.strip_accents("a").alias("x"), S.first_sentence("b").alias("y")).first()
    assert r["x"] == "acao metrica aøß"
    assert r["y"] == "Sistema de busca."


def test_exact_percentile_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.random() * 100) for _ in range(3000)] + [(f"g{i % 7}", rnd.random()) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(16)
    got = {r["g"]: r["m"] for r in exact_percentile(df, ["g"], "v", 0.5, out="m").collect()}
    for g in got:
        vals = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx(float(np.percentile(vals, 50)), abs=1e-9)


def test_rank_within_and_previous(spark):
    rows = [(k, i) for k in ("a", "b") for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long").repartition(7)
    r = rank_within(df, ["k"], ["t"]).collect()
    assert all(x["_rank"] == x["t"] for x in r)
    p = with_previous(df, ["k"], ["t"], ["t"]).collect()
    assert all((x["prev_t"] is None and x["t"] == 0) or x["prev_t"] == x["t"] - 1 for x in p)


def test_night_window(spark):
    # UTC 02:00 is 23:00 local (not night), 08:00 is 05:00 (night), 09:00 is 06:00 (end excluded)
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 2, 0),), (dt.datetime(2024, 1, 1, 8, 0),),
                                (dt.datetime(2024, 1, 1, 9, 0),)], "ts timestamp_ntz")
    assert [r["is_night"] for r in P.night_window(df, "ts").collect()] == [False, True, False]


def test_retention_keeps_recent_days(spark):
    from tessera.streaming.jobs import retained
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=d),) for d in range(0, 200, 10)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    kept = sorted(r["ts"] for r in retained(df, "ts", 90).collect())
    assert kept[0] == dt.datetime(2024, 1, 1) + dt.timedelta(days=100) and len(kept) == 10

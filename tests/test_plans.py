"""Plan shape: pruning and pushdown reach the scan, dimensions are broadcast, and no query plan holds a
nested-loop join, a Cartesian product or a row-at-a-time Python UDF."""

import pytest

import __spark_entry__ as E
from conftest import SMALL
from tools.check_plans import BAD, plan_text

QUERIES = E.queries()
STREAMING = {"sample_stream", "window_rates_stream", "upsert_votes_stream", "rate_limit_stream",
             "deadline_tracker_stream", "silent_key_stream", "report_sink", "load_catalog", "hybrid_search",
             "ivf_search", "resume_embed", "batch_embed"}


def test_pruned_scan_reads_only_kept_columns(spark):
    p = plan_text(QUERIES["load_table"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in p


def test_filter_spec_is_pushed_to_the_scan(spark):
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")   # show the whole scan description
    try:
        p = plan_text(QUERIES["filter_spec"](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    assert "GreaterThanOrEqual(p_size,10)" in p and "In(p_brand, [Brand#19,Brand#2,Brand#4])" in p
    assert "LessThan(p_retailprice,1500.0)" in p


def test_dimensions_are_broadcast(spark):
    p = plan_text(QUERIES["notices_by_uf"](spark, SMALL))
    assert p.count("BroadcastHashJoin") >= 2


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_no_non_scaling_operators(spark, name):
    p = plan_text(QUERIES[name](spark, SMALL))
    assert not [b for b in BAD if b in p]


def test_stored_index_is_pruned_by_bucket(spark):
    from pyspark.sql import functions as F
    from tessera.operators import textindex as T
    from tessera.plans.retrieval import stored_index
    from tessera.plans.standins import Tables
    t = Tables(spark, SMALL)
    index = stored_index(spark, SMALL)
    one = t.documents.where("doc_id = 1").select(F.lit(1).alias("query_id"), F.substring_index("text", " ", 2).alias("text"))
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")   # show the whole scan description
    try:
        terms, postings, _ = T._asked(index, one, "portuguese", None, ["tf"])
        p = plan_text(index.postings.where(F.col("bucket").isin([1, 2])))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    # what was read of the index is the postings of the asked terms, and only those
    assert {r["token"] for r in postings.select("token").distinct().collect()} == {
        r["token"] for r in terms.select("token").distinct().collect()}
    assert postings.columns == ["bucket", "token", "doc_id", "tf"]
    scans = [x for x in p.split("FileScan") if "/postings" in x]
    assert scans and all("bucket" in x.split("PartitionFilters: ")[1].split("]")[0] for x in scans)

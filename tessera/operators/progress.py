"""Job progress and bookkeeping: ledger state, pending work, completeness ratio, votes, check summaries,
row-count audits, grouped lists and missing names. Every per-key step is an aggregate (combined map-side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.joins import broadcast_checked

# Failure budget per key and completeness ratio of a reindex pass.
MAX_FAILS = 6
COVERAGE_RATIO = 0.995


def ledger_state(df: DataFrame, key: str = "key", seq: str = "seq", status: str = "status") -> DataFrame:
    """Last record per key (by ``seq``) and the number of failed records of the key."""
    return df.groupBy(F.col(key).alias("key")).agg(
        F.max_by(F.col(status), F.col(seq)).alias("status"),
        F.count_if(F.col(status) == "failed").alias("fails"))


def pending_work(expected_df: DataFrame, state_df: DataFrame, max_fails: int = MAX_FAILS,
                 key: str = "key") -> DataFrame:
    """Expected keys not yet published and with fewer than ``max_fails`` failures; unknown keys are pending."""
    j = expected_df.select(F.col(key).alias("key")).distinct().join(state_df, on="key", how="left")
    fails = F.coalesce(F.col("fails"), F.lit(0))
    return (j.where(~F.coalesce(F.col("status") == "published", F.lit(False)) & (fails < max_fails))
            .select("key", "status", fails.cast("bigint").alias("fails")))


def coverage_ratio(done_df: DataFrame, source_df: DataFrame, ratio: float = COVERAGE_RATIO,
                   last_pass: DataFrame | None = None) -> DataFrame:
    """done, total, target = floor(total × ratio), complete = done ≥ target (two counts, one row). With ``last_pass``,
    the rows that the last pass added, a pass that added none also completes the job: every source row is done."""
    d = done_df.agg(F.count(F.lit(1)).alias("done"))
    total = source_df.agg(F.count(F.lit(1))).scalar()   # scalar subquery: one value, no join
    target = F.floor(F.col("total").cast("decimal(20,0)") * F.lit(ratio).cast("decimal(10,6)")).cast("bigint")
    nothing_new = F.lit(False) if last_pass is None else last_pass.agg(F.count(F.lit(1)) == 0).scalar()
    return (d.select("done", total.alias("total"))
            .select("done", "total", target.alias("target"))
            .withColumn("complete", (F.col("done") >= F.col("target")) | nothing_new))


def upsert_votes(df: DataFrame, keys=("slug", "voter"), value: str = "vote", ts: str = "ts",
                 seq: str = "seq") -> DataFrame:
    """One vote per (article, voter): the last write wins; a final 0 removes the vote."""
    k = list(keys)
    last = df.groupBy(*k).agg(F.max_by(F.struct(F.col(value).alias("value"), F.col(ts).alias("updated_at")),
                                       F.struct(F.col(ts), F.col(seq))).alias("_v"))
    return last.select(*k, "_v.value", "_v.updated_at").where(F.col("value") != 0)


def vote_counts(votes_df: DataFrame, voter=None, slug: str = "slug") -> DataFrame:
    """Likes and dislikes per article (0 when none) and the given voter's own vote (0 if none)."""
    mine = (F.max(F.when(F.col("voter") == F.lit(voter), F.col("value"))) if voter is not None
            else F.lit(None))
    return votes_df.groupBy(slug).agg(
        F.count_if(F.col("value") == 1).alias("likes"), F.count_if(F.col("value") == -1).alias("dislikes"),
        F.coalesce(mine, F.lit(0)).cast("int").alias("my_vote"))


def check_summary(checks_df: DataFrame) -> DataFrame:
    """PASS/FAIL per check plus the overall flag (all passed), as a column on every row."""
    overall = checks_df.agg(F.coalesce(F.bool_and(F.col("ok")), F.lit(True))).scalar()   # scalar subquery
    return checks_df.select("id", "title", F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("result"),
                            "evidence", overall.alias("overall"))


# Restored-file shortfall tolerated when many files are expected.
FILE_SHORTFALL = 0.75
FILE_SHORTFALL_MIN = 200


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows): one exact count per table (each a partial count per task, merged once), as one frame."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


def row_count_audit(counts_df: DataFrame, expected_df: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Found rows per table vs expected. ``counts_df`` (table, rows) is the union of exact per-table counts;
    ``expected_df`` (table, expected). Status: 'missing' (expected, not found), 'empty_required' (required but
    0 rows), 'short' (below 75 % of expected when more than 200 are expected), 'extra' (found, not expected),
    'ok'."""
    j = counts_df.join(expected_df, on="table", how="full_outer")
    req = F.lit(False)
    if required is not None:
        j = j.join(broadcast_checked(required.select("table").distinct().withColumn("_req", F.lit(True))),
                   on="table", how="left")
        req = F.coalesce(F.col("_req"), F.lit(False))
    status = (F.when(F.col("rows").isNull(), "missing")
              .when(req & (F.col("rows") <= 0), "empty_required")
              .when(F.col("expected").isNull(), "extra")
              .when((F.col("expected") > FILE_SHORTFALL_MIN)
                    & (F.col("rows") < F.lit(FILE_SHORTFALL) * F.col("expected")), "short")
              .otherwise("ok"))
    return j.select("table", "rows", "expected", status.alias("status"))


def group_to_lists(df: DataFrame, group: str, host: str, service: str, kind: str, order: str,
                   max_hosts: int = 3) -> DataFrame:
    """Per group: first ``max_hosts`` distinct hosts (sorted), distinct services (sorted), a state label from
    the first record's kind, as joined text ('-' when empty). Distinct values are deduplicated by a
    (group, value) aggregate before they are listed, so the list size is the number of distinct values."""
    hosts = df.select(group, F.col(host).alias("h")).where(F.col("h").isNotNull()).distinct()
    # the group limit keeps the first hosts per task before the shuffle, so a list never exceeds max_hosts
    first = Window.partitionBy(group).orderBy("h")
    hosts = (hosts.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max_hosts)
             .groupBy(group).agg(F.sort_array(F.collect_list("h")).alias("_hosts")))
    svcs = (df.select(group, F.col(service).alias("s")).where(F.col("s").isNotNull() & (F.col("s") != ""))
            .distinct().groupBy(group).agg(F.sort_array(F.collect_list("s")).alias("_svcs")))
    state = df.groupBy(group).agg(F.min_by(F.col(kind), F.col(order)).alias("_kind"))
    label = (F.when(F.col("_kind").isin("product", "variant"), "live").when(F.col("_kind") == "testing", "testing")
             .when(F.col("_kind") == "preparing", "preparing").otherwise("live"))
    out = state.join(hosts, on=group, how="left").join(svcs, on=group, how="left")
    joined = lambda c: F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, F.array_join(F.col(c), ", ")).otherwise("-")
    return out.select(group, label.alias("state"), joined("_hosts").alias("hosts"), joined("_svcs").alias("services"))


def missing_names(required_df: DataFrame, found_df: DataFrame, col: str) -> DataFrame:
    """Required names that were not found (distinct)."""
    return (required_df.select(F.col(col).alias("name")).distinct()
            .join(found_df.select(F.col(col).alias("name")), on="name", how="left_anti"))

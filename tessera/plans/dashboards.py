"""Dashboard queries (aggregate views, medians, cards) on the stand-in tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.predicates import filter_conjunction
from tessera.operators import bi, topk
from tessera.plans.registry import query
from tessera.plans.standins import Tables, indicators, notices, with_standins
from tessera.session import scratch_path
from tessera.sources.sinks import View, read_refreshed, refresh_views

MEDIAN_YEAR = 1995  # the single-year median views use this year of the test data


@query("notices_by_uf", bench=True, oracle=with_standins(
    "select uf, count(*) as notices, cast(round(sum(cast(estimated_value as decimal(38,2))), 2) as decimal(38,2)) "
    "as estimated_value from notices where uf is not null group by uf", "notices"))
def q_notices_by_uf(spark, sf):
    return bi.notices_by_uf(notices(Tables(spark, sf)))


@query("notices_by_month", bench=True, oracle=with_standins(
    "select cast(date_trunc('month', published_at) as date) as month, count(*) as notices from notices "
    "where published_at is not null group by 1", "notices"))
def q_notices_by_month(spark, sf):
    return bi.notices_by_month(notices(Tables(spark, sf)))


@query("notices_by_modality", oracle=with_standins(
    "select coalesce(modality, 'Not informed') as modality, count(*) as notices from notices group by 1",
    "notices"))
def q_notices_by_modality(spark, sf):
    return bi.notices_by_modality(notices(Tables(spark, sf)))


@query("notices_by_category", oracle=with_standins(
    "select coalesce(category, 'Not classified') as category, count(*) as notices from notices group by 1",
    "notices"))
def q_notices_by_category(spark, sf):
    return bi.notices_by_category(notices(Tables(spark, sf)))


@query("notices_by_status", oracle=with_standins(
    "select coalesce(status, 'Not informed') as status, count(*) as notices from notices group by 1", "notices"))
def q_notices_by_status(spark, sf):
    return bi.notices_by_status(notices(Tables(spark, sf)))


@query("value_by_year", oracle=with_standins(
    "select cast(purchase_year as integer) as year, count(*) as notices, "
    "cast(round(sum(cast(estimated_value as decimal(38,2))), 2)"
    " as decimal(38,2)) as estimated_value from notices where purchase_year is not null group by 1", "notices"))
def q_value_by_year(spark, sf):
    return bi.value_by_year(notices(Tables(spark, sf)))


@query("top_organizations", bench=True, oracle=with_standins(
    "select organization, count(*) as notices from notices where organization is not null group by 1 "
    "order by notices desc, organization asc limit 25", "notices"))
def q_top_organizations(spark, sf):
    return bi.top_organizations(notices(Tables(spark, sf)))


_LATEST_SQL = ("select municipality, cast(yr as integer) as yr, cast(period as integer) as period, row_id, amount, "
               "sphere, uf, region from ("
               "select *, row_number() over (partition by municipality, yr order by period desc nulls first, "
               "row_id desc) as rn from indicators where sphere = 'Municipal' and amount > 0) t where rn = 1")


def latest_indicators(spark, sf):
    ind = filter_conjunction(indicators(Tables(spark, sf)), {"sphere": "Municipal"}, positive="amount")
    return bi.latest_per_key(ind, ["municipality", "yr"], order="period", tiebreak="row_id")


@query("latest_per_key", bench=True, oracle=with_standins(_LATEST_SQL, "indicators"))
def q_latest_per_key(spark, sf):
    return latest_indicators(spark, sf)


def _median_sql(group_sql: str, out: str, where: str = "", count: bool = False) -> str:
    extra = ", count(*) as municipalities" if count else ""
    return with_standins(
        f"select {group_sql} as {out}, cast(round(cast(quantile_cont(amount, 0.5) as decimal(38,10)), 2) "
        f"as decimal(38,2)) as median_value{extra} from ({_LATEST_SQL}) l {where} group by 1", "indicators")


@query("median_by_year", bench=True, oracle=_median_sql("cast(yr as varchar)", "year", count=True))
def q_median_by_year(spark, sf):
    return bi.median_by_year(latest_indicators(spark, sf))


@query("median_by_region", oracle=_median_sql("region", "region", f"where yr = {MEDIAN_YEAR}"))
def q_median_by_region(spark, sf):
    return bi.median_by_region(latest_indicators(spark, sf), MEDIAN_YEAR)


@query("median_by_uf", oracle=_median_sql("uf", "uf", f"where yr = {MEDIAN_YEAR}"))
def q_median_by_uf(spark, sf):
    return bi.median_by_uf(latest_indicators(spark, sf), MEDIAN_YEAR)


#: The stored aggregates over the latest indicator rows: one shared view, three that read it.
MEDIAN_VIEWS = (
    View("latest", ("indicators",), lambda f: bi.latest_per_key(
        filter_conjunction(f["indicators"], {"sphere": "Municipal"}, positive="amount"), ["municipality", "yr"],
        order="period", tiebreak="row_id")),
    View("by_year", ("latest",), lambda f: bi.median_by_year(f["latest"])),
    View("by_region", ("latest",), lambda f: bi.median_by_region(f["latest"], MEDIAN_YEAR)),
    View("by_uf", ("latest",), lambda f: bi.median_by_uf(f["latest"], MEDIAN_YEAR)))


def _all_medians_sql() -> str:
    parts = [("by_year", "cast(yr as varchar)", ""), ("by_region", "region", f"where yr = {MEDIAN_YEAR}"),
             ("by_uf", "uf", f"where yr = {MEDIAN_YEAR}")]
    return with_standins(" union all ".join(
        f"select '{name}' as family, {g} as member, cast(round(cast(quantile_cont(amount, 0.5) as decimal(38,10)), 2) as "
        f"decimal(38,2)) as median_value from ({_LATEST_SQL}) l {where} group by 2" for name, g, where in parts), "indicators")


@query("median_views", oracle=_all_medians_sql)
def q_median_views(spark, sf):
    """The three medians as stored views over one stored view of the latest rows."""
    root = scratch_path(spark, f"views-{uuid.uuid4().hex}")
    states = refresh_views(spark, MEDIAN_VIEWS, {"indicators": indicators(Tables(spark, sf))}, root)
    if set(states.values()) != {"refreshed"}:
        raise RuntimeError(f"views not refreshed: {states}")
    out = None
    for name, member in (("by_year", "year"), ("by_region", "region"), ("by_uf", "uf")):
        part = read_refreshed(spark, f"{root}/{name}").select(F.lit(name).alias("family"), F.col(member).alias("member"),
                                                              "median_value")
        out = part if out is None else out.unionByName(part)
    return out


@query("reporting_by_year", oracle=with_standins(
    "select cast(yr as varchar) as year, count(distinct municipality) as municipalities_reporting "
    "from indicators where sphere = 'Municipal' group by 1", "indicators"))
def q_reporting_by_year(spark, sf):
    ind = indicators(Tables(spark, sf)).where(F.col("sphere") == "Municipal")
    return bi.reporting_by_year(ind)


@query("parent_value_once", bench=True, oracle=(
    "select o_orderstatus, cast(sum(n) as bigint) as items, count(*) as parents, "
    "cast(sum(v) as decimal(38,2)) as value from (select o_orderstatus, o_orderkey, count(*) as n, "
    "max(cast(o_totalprice as decimal(38,2))) as v from orders join lineitem on l_orderkey = o_orderkey "
    "group by 1, 2) t group by 1"))
def q_parent_value_once(spark, sf):
    t = Tables(spark, sf)
    items = t.lineitem.select("l_orderkey").join(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"),
                                                 F.col("l_orderkey") == F.col("o_orderkey"))
    return bi.parent_value_once(items, "o_orderkey", "o_totalprice", "o_orderstatus")


@query("deadline_counts", oracle=(
    "select cast(date_trunc('month', d) as date) as month, count(*) as rows from ("
    "select case when l_linenumber = 1 then null else l_shipdate end as d from lineitem) t "
    "where d is not null group by 1"))
def q_deadline_counts(spark, sf):
    li = Tables(spark, sf).lineitem.select(
        F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("l_shipdate")).alias("d"))
    return bi.deadline_counts(li, "d")


@query("card_topk", oracle=with_standins(
    "select uf, notices from (select uf, count(*) as notices from notices where uf is not null group by uf) v "
    "order by notices desc, uf limit 10", "notices"))
def q_card_topk(spark, sf):
    view = bi.notices_by_uf(notices(Tables(spark, sf)))
    return topk.card_topk(view, ["uf", "notices"], [("notices", "desc"), ("uf", "asc")], k=10)


@query("card_series", oracle=with_standins(
    "select cast(year as varchar) as year, notices from (select purchase_year as year, count(*) as notices "
    "from notices where purchase_year is not null group by 1) v order by year", "notices"))
def q_card_series(spark, sf):
    view = bi.value_by_year(notices(Tables(spark, sf)))
    return topk.card_series(view, {"year": "string", "notices": None}, [("year", "asc")])

"""Join, aggregate, window, top-k and set queries on the test tables and stand-ins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.predicates import price_expr
from tessera.operators import bi, joins as J, offers as O, progress as G, topk, windows as W
from tessera.operators.parity import table_parity
from tessera.plans.registry import query
from tessera.session import scratch_path
from tessera.sources.keyed import DoneTable, KeyedTable, last_write
from tessera.sources.tables import literal_frame
from tessera.plans.standins import (TABLES, Tables, ledger, offers, samples, snapshots, vote_events,
                                    with_standins)

# ---- joins ----------------------------------------------------------------------------------------------------


@query("anti_done", oracle="select doc_id, lang from documents d where not exists "
                           "(select 1 from labels l where l.doc_id = d.doc_id)")
def q_anti_done(spark, sf):
    t = Tables(spark, sf)
    return J.anti_done(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("anti_done_stored", oracle="select doc_id, lang from documents d where not exists "
                                  "(select 1 from labels l where l.doc_id = d.doc_id)")
def q_anti_done_stored(spark, sf):
    """The same against a stored table of done keys, bucketed and sorted by key: only the source is shuffled."""
    t = Tables(spark, sf)
    name = f"done_{uuid.uuid4().hex}"
    done = DoneTable(spark, name, "doc_id", 2 * spark.sparkContext.defaultParallelism, scratch_path(spark, name))
    done.add(t.labels.select("doc_id"))
    out = done.todo(t.documents.select("doc_id", "lang"))
    spark.sql(f"drop table {name}")  # out of the catalog; the plan above reads its files
    return out


def _blacklist(t):
    return t.lineitem.where(F.col("l_returnflag") == "R").select((F.col("l_suppkey") % 397).alias("machine_id"))


def _owned(t):
    return offers(t).where(F.col("offer_id") % 97 == 0).select("machine_id")


_BLACK_SQL = "select l_suppkey % 397 as machine_id from lineitem where l_returnflag = 'R'"
_OWNED_SQL = "select machine_id from offers where offer_id % 97 = 0"


@query("anti_excluded", oracle=with_standins(
    f"select offer_id, machine_id from offers o where not exists (select 1 from ({_BLACK_SQL}) b where "
    f"b.machine_id = o.machine_id) and not exists (select 1 from ({_OWNED_SQL}) w where w.machine_id = "
    "o.machine_id)", "offers"))
def q_anti_excluded(spark, sf):
    t = Tables(spark, sf)
    return J.anti_excluded(offers(t).select("offer_id", "machine_id"), _blacklist(t), _owned(t),
                           "machine_id", "machine_id")


@query("semi_known", bench=True, oracle="select o_orderkey, o_orderstatus from orders o where exists (select 1 from "
                                        "lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')")
def q_semi_known(spark, sf):
    t = Tables(spark, sf)
    known = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.semi_known(t.orders.select("o_orderkey", "o_orderstatus"), known, "o_orderkey")


@query("join_entitlements", oracle=(
    "select lower(c_name) || '@x.com' as email, o_orderkey as order_id, o_orderstatus as status, o_orderdate as "
    "until from orders join customer on o_custkey = c_custkey"))
def q_join_entitlements(spark, sf):
    t = Tables(spark, sf)
    subs = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("order_id"),
                           F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("until"))
    users = t.customer.select(F.col("c_custkey").alias("id"),
                              F.concat(F.lower("c_name"), F.lit("@x.com")).alias("email"))
    return J.join_entitlements(subs, users)


@query("provider_subscriptions", oracle=(
    "select lower(c_name) || '@x.com' as email, 's' || cast(o_orderkey as varchar) as order_id, o_orderstatus as "
    "status from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT'"))
def q_provider_subscriptions(spark, sf):
    t = Tables(spark, sf)
    subs = t.orders.select(F.col("o_custkey").alias("account_id"),
                           F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("external_id"),
                           F.col("o_orderstatus").alias("status"),
                           F.when(F.col("o_orderpriority") == "1-URGENT", "pay1").otherwise("pay2").alias("provider"))
    accounts = t.customer.select(F.col("c_custkey").alias("id"),
                                 F.concat(F.lower("c_name"), F.lit("@x.com")).alias("email"))
    return J.provider_subscriptions(subs, accounts, "pay1")


@query("left_enrich", oracle=(
    "select c_custkey, c_name, case when last_order is not null then 'https://orders.example/' || "
    "cast(c_custkey as varchar) end as link from customer left join (select o_custkey, max(o_orderdate) as "
    "last_order from orders group by o_custkey) o on o_custkey = c_custkey"))
def q_left_enrich(spark, sf):
    t = Tables(spark, sf)
    dim = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_order"))
    out = J.left_enrich(t.customer.select("c_custkey", "c_name"), dim, ["c_custkey"], present="last_order",
                        link_cols={"link": F.concat(F.lit("https://orders.example/"),
                                                    F.col("c_custkey").cast("string"))})
    return out.select("c_custkey", "c_name", "link")


@query("semi_articles", oracle=(
    "select event_id, 'a' || cast(event_id % 7 as varchar) as slug from events where 'a' || cast(event_id % 7 as "
    "varchar) in (select distinct 'a' || cast(n_nationkey % 5 as varchar) from nation)"))
def q_semi_articles(spark, sf):
    t = Tables(spark, sf)
    ev = t.events.select("event_id", F.concat(F.lit("a"), (F.col("event_id") % 7).cast("string")).alias("slug"))
    articles = t.nation.select(F.concat(F.lit("a"), (F.col("n_nationkey") % 5).cast("string")).alias("slug")).distinct()
    return J.semi_articles(ev, articles, "slug")


@query("desired_state_diff", oracle=(
    "with e as (select p_partkey, case when p_partkey % 7 = 0 then p_size + 1 else p_size end as p_size, "
    "p_retailprice from part where p_partkey % 10 <> 0) select d.p_partkey, case when e.p_partkey is null then "
    "'add' when d.p_size is distinct from e.p_size or d.p_retailprice is distinct from e.p_retailprice then "
    "'edit' else 'keep' end as action from part d left join e on d.p_partkey = e.p_partkey"))
def q_desired_state_diff(spark, sf):
    p = Tables(spark, sf).part
    existing = p.where(F.col("p_partkey") % 10 != 0).select(
        "p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"),
        "p_retailprice")
    return J.desired_state_diff(p, existing, "p_partkey", ["p_size", "p_retailprice"])


@query("municipality_dim", oracle="select c_custkey, n_name, r_name from customer join nation on c_nationkey = "
                                  "n_nationkey join region on n_regionkey = r_regionkey")
def q_municipality_dim(spark, sf):
    t = Tables(spark, sf)
    dim = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return J.municipality_dim(t.customer.select("c_custkey", "c_nationkey"), dim, ["c_nationkey"]) \
        .select("c_custkey", "n_name", "r_name")


_RIGHT_SUPPLIER_SQL = ("select s_suppkey, s_name, case when s_suppkey % 7 = 0 then s_acctbal + 1 else s_acctbal end "
                       "as s_acctbal from supplier where s_suppkey % 10 <> 0 union all select s_suppkey + 1000000, "
                       "s_name, s_acctbal from supplier where s_suppkey % 13 = 0")


@query("table_diff", oracle=(
    f"with r as ({_RIGHT_SUPPLIER_SQL}) select coalesce(l.s_suppkey, r.s_suppkey) as s_suppkey, case when "
    "r.s_suppkey is null then 'missing' when l.s_suppkey is null then 'extra' when l.s_name is not distinct from "
    "r.s_name and l.s_acctbal is not distinct from r.s_acctbal then 'match' else 'differs' end as status "
    "from supplier l full outer join r on l.s_suppkey = r.s_suppkey"))
def q_table_diff(spark, sf):
    return J.table_diff(*_supplier_sides(spark, sf), ["s_suppkey"], ["s_name", "s_acctbal"])


def _supplier_sides(spark, sf):
    s = Tables(spark, sf).supplier.select("s_suppkey", "s_name", "s_acctbal")
    right = s.where(F.col("s_suppkey") % 10 != 0).select(
        "s_suppkey", "s_name",
        F.when(F.col("s_suppkey") % 7 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("s_acctbal")
    ).unionByName(s.where(F.col("s_suppkey") % 13 == 0).select((F.col("s_suppkey") + 1000000).alias("s_suppkey"),
                                                                "s_name", "s_acctbal"))
    return s, right


@query("table_parity", oracle=(
    f"with r as ({_RIGHT_SUPPLIER_SQL}) select coalesce(l.s_suppkey, r.s_suppkey) as s_suppkey, case when "
    "r.s_suppkey is null then 'missing' when l.s_suppkey is null then 'extra' when l.s_name is not distinct from "
    "r.s_name and l.s_acctbal is not distinct from r.s_acctbal then 'match' else 'differs' end as status "
    "from supplier l full outer join r on l.s_suppkey = r.s_suppkey"))
def q_table_parity(spark, sf):
    """``table_diff`` with bucket sums first."""
    left, right = _supplier_sides(spark, sf)
    return table_parity(left, right, ["s_suppkey"], ["s_name", "s_acctbal"])


@query("table_parity_orders", oracle=(
    "select o_orderkey, case when o_orderkey % 5003 = 7 then 'missing' when o_orderkey % 4001 = 3 then 'differs' else 'match' "
    "end as status from orders"))
def q_table_parity_orders(spark, sf):
    """Two copies of the orders that differ in a few rows: most buckets agree and are not joined."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    copy = o.where(F.col("o_orderkey") % 5003 != 7).withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 4001 == 3, F.lit("?")).otherwise(F.col("o_orderstatus")))
    return table_parity(o, copy, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("dedupe_keep_last", oracle=(
    "select user_id, event_id, ts, event_type, value, props from (select *, row_number() over (partition by "
    "user_id order by ts desc, event_id desc) as rn from events) e where rn = 1"))
def q_dedupe_keep_last(spark, sf):
    return J.dedupe_keep_last(Tables(spark, sf).events, ["user_id"], ["ts", "event_id"])


# ---- aggregates -----------------------------------------------------------------------------------------------
_VOTES_SQL = ("select slug, voter, vote as value, ts as updated_at from (select *, row_number() over (partition by "
              "slug, voter order by ts desc, seq desc) as rn from vote_events) v where rn = 1 and vote <> 0")


@query("upsert_votes_table", oracle=with_standins(_VOTES_SQL, "vote_events"))
def q_upsert_votes_table(spark, sf):
    """The same kept in a stored table: every batch rewrites only the buckets of its keys (the second one comes twice)."""
    votes = vote_events(Tables(spark, sf)).select("slug", "voter", "vote", "ts", "seq")
    table = KeyedTable(spark, scratch_path(spark, f"votes-{uuid.uuid4().hex}"), votes.schema, ("slug", "voter"), buckets=16)
    merge = last_write(["slug", "voter"], ["ts", "seq"])
    for n, part in enumerate((0, 1, 1, 2)):
        table.apply(votes.where(F.col("seq") % 3 == part), merge, (0, 1, 1, 2)[n])
    return table.rows().where(F.col("vote") != 0).select("slug", "voter", F.col("vote").alias("value"),
                                                         F.col("ts").alias("updated_at"))


@query("upsert_votes", oracle=with_standins(_VOTES_SQL, "vote_events"))
def q_upsert_votes(spark, sf):
    return G.upsert_votes(vote_events(Tables(spark, sf)))


@query("vote_counts", oracle=with_standins(
    f"select slug, count(*) filter (where value = 1) as likes, count(*) filter (where value = -1) as dislikes, "
    f"cast(coalesce(max(case when voter = 7 then value end), 0) as integer) as my_vote from ({_VOTES_SQL}) v "
    "group by slug", "vote_events"))
def q_vote_counts(spark, sf):
    return G.vote_counts(G.upsert_votes(vote_events(Tables(spark, sf))), voter=7)


_LEDGER_STATE_SQL = ("select key, arg_max(status, seq) as status, count(*) filter (where status = 'failed') as fails "
                     "from ledger group by key")


@query("ledger_state", oracle=with_standins(_LEDGER_STATE_SQL, "ledger"))
def q_ledger_state(spark, sf):
    return G.ledger_state(ledger(Tables(spark, sf)))


@query("pending_work", oracle=with_standins(
    f"select e.key, s.status, coalesce(s.fails, 0) as fails from (select distinct 'k' || cast(c_custkey as varchar) "
    f"as key from customer) e left join ({_LEDGER_STATE_SQL}) s on e.key = s.key where coalesce(s.status = "
    "'published', false) = false and coalesce(s.fails, 0) < 6", "ledger"))
def q_pending_work(spark, sf):
    t = Tables(spark, sf)
    expected = t.customer.select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"))
    return G.pending_work(expected, G.ledger_state(ledger(t)))


@query("coverage_ratio", oracle=(
    "select d.done, s.total, cast(floor(s.total * 0.995) as bigint) as target, d.done >= cast(floor(s.total * 0.995)"
    " as bigint) as complete from (select count(*) as done from labels) d, (select count(*) as total from "
    "documents) s"))
def q_coverage_ratio(spark, sf):
    t = Tables(spark, sf)
    return G.coverage_ratio(t.labels, t.documents)


@query("coverage_after_empty_pass", oracle=(
    "select d.done, s.total, cast(floor(s.total * 0.995) as bigint) as target, true as complete from (select count(*) as "
    "done from labels) d, (select count(*) as total from documents) s"))
def q_coverage_after_empty_pass(spark, sf):
    """The last pass found nothing left to do (no document with a negative id): the job is complete."""
    t = Tables(spark, sf)
    return G.coverage_ratio(t.labels, t.documents, last_pass=t.documents.where(F.col("doc_id") < 0))


@query("cache_hit_ratio", oracle=(
    "select coalesce(round(100.0 * sum(l_quantity) / nullif(sum(l_quantity) + sum(l_discount * 100), 0), 2), "
    "100.0) as hit_pct from lineitem"))
def q_cache_hit_ratio(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_quantity", (F.col("l_discount") * 100).alias("reads"))
    return bi.cache_hit_ratio(li, "l_quantity", "reads")


@query("size_by_db", oracle="select coalesce(source, 'total') as name, cast(sum(n_chars) as bigint) as bytes "
                            "from documents group by rollup(source)")
def q_size_by_db(spark, sf):
    return bi.size_by_db(Tables(spark, sf).documents, "source", "n_chars")


_AUDIT_TABLES = TABLES


@query("row_count_audit", oracle=(
    "with c as (" + " union all ".join(f"select '{x}' as \"table\", count(*) as \"rows\" from {x}"
                                       for x in _AUDIT_TABLES) + "), "
    "e as (select \"table\", case when \"table\" = 'documents' then \"rows\" * 2 else \"rows\" end as expected "
    "from c where \"table\" <> 'benchmark' union all select 'archive', (select count(*) from orders)), "
    "r as (select * from (values ('region'), ('nation'), ('labels')) r(\"table\")) "
    "select coalesce(c.\"table\", e.\"table\") as \"table\", c.\"rows\", e.expected, case when c.\"rows\" is null "
    "then 'missing' when r.\"table\" is not null and c.\"rows\" <= 0 then 'empty_required' when e.expected is null "
    "then 'extra' when e.expected > 200 and c.\"rows\" < 0.75 * e.expected then 'short' else 'ok' end as status "
    "from c full outer join e on c.\"table\" = e.\"table\" left join r on r.\"table\" = coalesce(c.\"table\", "
    "e.\"table\")"))
def q_row_count_audit(spark, sf):
    t = Tables(spark, sf)
    counts = G.table_counts({x: getattr(t, x) for x in _AUDIT_TABLES})
    expected = (counts.where(F.col("table") != "benchmark")
                .select("table", F.when(F.col("table") == "documents", F.col("rows") * 2)
                        .otherwise(F.col("rows")).alias("expected"))
                .unionByName(t.orders.agg(F.count(F.lit(1)).alias("expected"))
                             .select(F.lit("archive").alias("table"), "expected")))
    required = literal_frame(spark, [("region",), ("nation",), ("labels",)], "table string")
    return G.row_count_audit(counts, expected, required)


_SUPPLIER_REG_SQL = ("select n_name as grp, s_suppkey, case when s_suppkey % 4 <> 0 then lower(replace(s_name, '#', "
                     "'')) || '.example.org' end as host, case s_suppkey % 3 when 0 then 'web' when 1 then 'api' else "
                     "'' end as service, case when s_suppkey % 5 = 0 then 'testing' else 'product' end as kind from "
                     "supplier join nation on s_nationkey = n_nationkey")


@query("group_to_lists", oracle=(
    f"with s as ({_SUPPLIER_REG_SQL}), st as (select grp, arg_min(kind, s_suppkey) as k from s group by grp), "
    "h as (select grp, list_slice(list_sort(list(distinct host)), 1, 3) as hs from s where host is not null group "
    "by grp), v as (select grp, list_sort(list(distinct service)) as vs from s where service <> '' group by grp) "
    "select st.grp, case when k in ('product', 'variant') then 'live' when k = 'testing' then 'testing' when k = "
    "'preparing' then 'preparing' else 'live' end as state, case when len(coalesce(hs, [])) > 0 then "
    "array_to_string(hs, ', ') else '-' end as hosts, case when len(coalesce(vs, [])) > 0 then "
    "array_to_string(vs, ', ') else '-' end as services from st left join h on st.grp = h.grp left join v on "
    "st.grp = v.grp"))
def q_group_to_lists(spark, sf):
    t = Tables(spark, sf)
    k = F.col("s_suppkey")
    s = t.supplier.join(J.broadcast_checked(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("grp"), "s_suppkey",
        F.when(k % 4 != 0, F.concat(F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit(""))),
                                    F.lit(".example.org"))).alias("host"),
        F.when(k % 3 == 0, "web").when(k % 3 == 1, "api").otherwise("").alias("service"),
        F.when(k % 5 == 0, "testing").otherwise("product").alias("kind"))
    return G.group_to_lists(s, "grp", "host", "service", "kind", order="s_suppkey")


@query("nearest_rank_p95", oracle=(
    "with ok as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as rk, "
    "count(*) over (partition by event_type) as n from events where value > 10) select event_type, n as ok_rows, "
    "value as p95 from ok where rk = case when floor(n * 0.95) - 1 < 0 then n - 1 else floor(n * 0.95) - 1 end"))
def q_nearest_rank_p95(spark, sf):
    ev = Tables(spark, sf).events.withColumn("ok", F.col("value") > 10)
    return bi.nearest_rank_p95(ev, "event_type", "value", "ok")


@query("check_summary", oracle=(
    "with c as (select 'q1' as id, 'orders loaded' as title, count(*) > 0 as ok, 'rows=' || cast(count(*) as "
    "varchar) as evidence from orders union all select 'q2', 'labels cover documents', (select count(*) from "
    "labels) >= (select count(*) from documents), 'labels=' || cast((select count(*) from labels) as varchar) "
    "union all select 'q3', 'no negative prices', count(*) filter (where o_totalprice < 0) = 0, 'negative=' || "
    "cast(count(*) filter (where o_totalprice < 0) as varchar) from orders) select id, title, case when ok then "
    "'PASS' else 'FAIL' end as result, evidence, (select bool_and(ok) from c) as overall from c"))
def q_check_summary(spark, sf):
    t = Tables(spark, sf)
    n_orders = t.orders.agg(F.count(F.lit(1)).alias("n"),
                            F.count_if(F.col("o_totalprice") < 0).alias("neg"))
    n_labels = t.labels.agg(F.count(F.lit(1)).alias("nl"))
    n_docs = t.documents.agg(F.count(F.lit(1)).alias("nd"))
    q1 = n_orders.select(F.lit("q1").alias("id"), F.lit("orders loaded").alias("title"), (F.col("n") > 0).alias("ok"),
                         F.concat(F.lit("rows="), F.col("n").cast("string")).alias("evidence"))
    q2 = n_labels.select(F.lit("q2").alias("id"), F.lit("labels cover documents").alias("title"),
                         (F.col("nl") >= n_docs.scalar()).alias("ok"),
                         F.concat(F.lit("labels="), F.col("nl").cast("string")).alias("evidence"))
    q3 = n_orders.select(F.lit("q3").alias("id"), F.lit("no negative prices").alias("title"),
                         (F.col("neg") == 0).alias("ok"),
                         F.concat(F.lit("negative="), F.col("neg").cast("string")).alias("evidence"))
    return G.check_summary(q1.unionByName(q2).unionByName(q3))


# ---- windows --------------------------------------------------------------------------------------------------
@query("counter_rate", bench=True, oracle=with_standins(
    "select series, ts, delta, round(seconds, 6) as seconds, round(delta / seconds, 2) as rate from (select series, "
    "ts, cast(counter - lag(counter) over w as bigint) as delta, greatest(1.0, epoch_us(ts) / 1000000.0 - epoch_us(lag(ts) over w) "
    "/ 1000000.0) as seconds, lag(ts) over w as pts from samples window w as (partition by series order by ts, "
    "event_id)) x where pts is not null", "samples"))
def q_counter_rate(spark, sf):
    return W.counter_rate(samples(Tables(spark, sf)), "series", "ts", "counter", tiebreak="event_id")


def collector_samples(t: Tables):
    """Collector samples every 5 minutes: cumulative request and error counters of one collector series (a
    single series holding every sample — the hot-key case), summed by the skew-safe running sum."""
    from tessera.operators.ranking import running_sum
    per = (t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "5 minutes").alias("w"))
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
           .select(F.lit("collector").alias("series"), F.col("w.end").cast("timestamp_ntz").alias("ts"), "n", "e"))
    c = running_sum(per, ["series"], ["ts"], "n", "requests")
    return running_sum(c, ["series"], ["ts"], "e", "errors").drop("n", "e")


@query("counter_error_rate", oracle=(
    "with b as (select time_bucket(interval 5 minutes, ts) + interval 5 minutes as ts, count(*) as n, count(*) filter "
    "(where event_type = 'error') as e from events group by 1), c as (select ts, cast(sum(n) over (order by ts) as "
    "bigint) as req, cast(sum(e) over (order by ts) as bigint) as err from b), d as (select ts, req - lag(req) over "
    "(order by ts) as dreq, err - lag(err) over (order by ts) as derr, greatest(1.0, epoch_us(ts) / 1000000.0 - "
    "epoch_us(lag(ts) over (order by ts)) / 1000000.0) as sec from c) select 'collector' as series, ts, dreq as "
    "delta, round(sec, 6) as seconds, round(dreq / sec, 3) as rate, case when dreq > 0 then round(100.0 * derr / "
    "dreq, 2) else 0.0 end as error_pct from d where dreq is not null"))
def q_counter_error_rate(spark, sf):
    return W.counter_rate(collector_samples(Tables(spark, sf)), "series", "ts", "requests", digits=3,
                          error_counter="errors")


@query("first_seen_dedupe", oracle=(
    "select k, doc_id, lang, source from (select sha256(text) as k, doc_id, lang, source, row_number() over "
    "(partition by sha256(text) order by doc_id) as rn from documents where text is not null and text <> '') d "
    "where rn = 1"))
def q_first_seen_dedupe(spark, sf):
    d = Tables(spark, sf).documents.select(F.sha2(F.col("text"), 256).alias("k"), "doc_id", "lang", "source", "text")
    return J.first_seen_dedupe(d, ["k"], ["doc_id"], nonempty=["text"]).drop("text")


def _gfs_sql(unit: str, n: int, name: str) -> str:
    return (f"{name} as (select arg_max(snapshot_id, (taken_at, snapshot_id)) as snapshot_id from snapshots "
            f"group by date_trunc('{unit}', taken_at) order by date_trunc('{unit}', taken_at) desc limit {n})")


@query("retention_gfs", oracle=with_standins(
    f"select 1", "snapshots")[:-len(" select 1")] + ", " + ", ".join(
        [_gfs_sql("day", 7, "d"), _gfs_sql("week", 4, "w"), _gfs_sql("month", 6, "m")]) +
    " select s.snapshot_id as snapshot, s.taken_at, s.snapshot_id in (select snapshot_id from d) as keep_daily, "
    "s.snapshot_id in (select snapshot_id from w) as keep_weekly, s.snapshot_id in (select snapshot_id from m) as "
    "keep_monthly from snapshots s")
def q_retention_gfs(spark, sf):
    return W.retention_gfs(snapshots(Tables(spark, sf)), "snapshot_id", "taken_at")


def _release_frames(t: Tables):
    ev = t.events
    k = F.col("event_id")
    pfx = F.when(F.col("event_type") == "view", "web-").otherwise("")
    tag = F.when(k % 11 == 0, F.concat(F.lit("other-v"), k.cast("string"))).otherwise(
        F.concat(pfx, F.lit("v"), k.cast("string")))
    rel = ev.select(
        F.col("event_type").alias("service"), k.alias("release_id"), F.col("ts").alias("published_at"),
        tag.alias("tag"), (F.col("value") < 5).alias("draft"),
        F.when(k % 13 == 0, 2).otherwise(1).alias("schema"),
        F.when(k % 17 == 0, F.concat(F.lit("org/old-"), F.col("event_type")))
        .otherwise(F.concat(F.lit("org/"), F.col("event_type"))).alias("manifest_repo"),
        F.col("event_type").alias("manifest_service"), F.lit("docker-archive").alias("artifact_type"),
        F.when(k % 23 == 0, F.lit("bad")).otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"),
        F.concat(F.lit("sha256:"), F.sha2((k % 50).cast("string"), 256)).alias("image_id"),
        (k % 29 != 0).alias("asset_present"),
        F.when(k % 19 == 0, F.lit("x")).otherwise(tag).alias("version"))
    sources = ev.select("event_type").distinct().select(
        F.col("event_type").alias("service"), F.concat(F.lit("org/"), F.col("event_type")).alias("repo"),
        F.array(F.concat(F.lit("org/old-"), F.col("event_type"))).alias("aliases"),
        F.when(F.col("event_type") == "view", "web-").otherwise("").alias("tag_prefix"))
    lock = (ev.where(k % 50 == 7).groupBy(F.col("event_type").alias("service"))
            .agg(F.max_by(F.struct(F.concat(F.lit("v"), k.cast("string")).alias("version"),
                                   F.concat(F.lit("sha256:"), F.sha2((k % 50).cast("string"), 256)).alias("image_id")),
                          k).alias("_l")).select("service", "_l.version", "_l.image_id"))
    return rel, sources, lock


@query("latest_version", oracle=(
    "with rel as (select event_type as service, event_id as release_id, ts as published_at, case when event_id % 11 "
    "= 0 then 'other-v' || cast(event_id as varchar) else case when event_type = 'view' then 'web-' else '' end || "
    "'v' || cast(event_id as varchar) end as tag, value < 5 as draft, case when event_id % 13 = 0 then 2 else 1 end "
    "as schema, case when event_id % 17 = 0 then 'org/old-' || event_type else 'org/' || event_type end as "
    "manifest_repo, case when event_id % 23 = 0 then 'bad' else sha256(cast(event_id as varchar)) end as sha256, "
    "'sha256:' || sha256(cast(event_id % 50 as varchar)) as image_id, event_id % 29 <> 0 as asset_present, "
    "event_id % 19 = 0 as bad_version from events), "
    "n as (select service, arg_max(rel, (published_at, release_id)) as r from rel where not draft and starts_with("
    "tag, case when service = 'view' then 'web-' else '' end) group by service), "
    "lk as (select event_type as service, arg_max('v' || cast(event_id as varchar), event_id) as version, "
    "arg_max('sha256:' || sha256(cast(event_id % 50 as varchar)), event_id) as image_id from events where "
    "event_id % 50 = 7 group by event_type), "
    "v as (select service, r.tag as tag, r.image_id as image_id, coalesce(r.schema = 1 and r.manifest_repo in "
    "('org/' || service, 'org/old-' || service) and regexp_matches(r.sha256, '^[0-9a-f]{64}$') and "
    "regexp_matches(r.image_id, '^sha256:[0-9a-f]{64}$') and r.asset_present and not r.bad_version, false) as "
    "valid from n) "
    "select v.service, v.tag as version, v.valid, v.valid and (v.image_id is distinct from lk.image_id) as "
    "changed, lk.version as previous_version from v left join lk on v.service = lk.service"))
def q_latest_version(spark, sf):
    rel, sources, lock = _release_frames(Tables(spark, sf))
    return W.latest_version(rel, sources, lock)


def _claim_frames(t: Tables):
    ev = t.events
    k = F.col("event_id")
    claims = ev.select(F.concat(F.lit("tk"), F.floor(k / 4).cast("string")).alias("token"),
                       F.col("ts").alias("claimed_at"), k.alias("claim_id"))
    tickets = ev.where(k % 4 == 0).select(F.concat(F.lit("tk"), F.floor(k / 4).cast("string")).alias("token"),
                                          F.col("user_id").alias("device_id"),
                                          (F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("expires_at"))
    devices = t.customer.select(
        F.col("c_custkey").alias("device_id"),
        F.when(F.col("c_custkey") % 10 == 0, "revoked").otherwise("connected").alias("status"))
    return claims, tickets, devices


@query("first_valid_claim", oracle=(
    "with c as (select 'tk' || cast(cast(floor(event_id / 4) as bigint) as varchar) as token, ts as claimed_at, event_id as claim_id "
    "from events), t as (select 'tk' || cast(cast(floor(event_id / 4) as bigint) as varchar) as token, user_id as device_id, ts + "
    "interval 20 minutes as expires_at from events where event_id % 4 = 0), d as (select c_custkey as device_id, "
    "case when c_custkey % 10 = 0 then 'revoked' else 'connected' end as status from customer), ok as (select "
    "c.token, t.device_id, c.claimed_at, c.claim_id from c join t on c.token = t.token join d on d.device_id = "
    "t.device_id where d.status <> 'revoked' and c.claimed_at < t.expires_at) select token, arg_min(device_id, "
    "(claimed_at, claim_id)) as device, min(claimed_at) as claimed_at from ok group by token"))
def q_first_valid_claim(spark, sf):
    claims, tickets, devices = _claim_frames(Tables(spark, sf))
    return W.first_valid_claim(claims, tickets, devices)


_PRESENCE_SQL = ("select user_id as device, ts, case when event_type in ('click', 'view', 'signup') then 'connect' "
                 "when event_type = 'error' then 'disconnect' when value > 480 then 'revoke' else 'noop' end as kind "
                 "from events")


@query("presence_state", oracle=(
    f"with e as ({_PRESENCE_SQL}) select device, case when max(case when kind = 'revoke' then 1 else 0 end) = 1 "
    "then 'revoked' when arg_max(kind, ts) filter (where kind in ('connect', 'disconnect')) = 'connect' then "
    "'connected' when arg_max(kind, ts) filter (where kind in ('connect', 'disconnect')) = 'disconnect' then "
    "'disconnected' else 'unknown' end as status, max(ts) filter (where kind = 'connect') as last_seen from e "
    "group by device"))
def q_presence_state(spark, sf):
    ev = Tables(spark, sf).events
    kind = (F.when(F.col("event_type").isin("click", "view", "signup"), "connect")
            .when(F.col("event_type") == "error", "disconnect").when(F.col("value") > 480, "revoke")
            .otherwise("noop"))
    return W.presence_state(ev.select(F.col("user_id").alias("device"), "ts", kind.alias("kind")), "device", "ts")


# ---- sorts / top-k / sets -------------------------------------------------------------------------------------
@query("recent_comments", oracle=(
    "select slug, id, created_at, rank from (select 'a' || cast(user_id as varchar) as slug, event_id as id, ts as "
    "created_at, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events) e "
    "where rank <= 20"))
def q_recent_comments(spark, sf):
    ev = Tables(spark, sf).events.select(F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("slug"),
                                         F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    # n = 20 instead of the 200 in use: users here have ~66 events, so 200 would never cut anything
    return topk.recent_comments(ev, "slug", "created_at", "id", n=20).select("slug", "id", "created_at",
                                                                             F.col("rank").cast("bigint"))


@query("recent_comments_page", oracle=(
    "select slug, id, created_at, rank from (select event_type as slug, event_id as id, ts as created_at, row_number() "
    "over (partition by event_type order by ts desc, event_id desc) as rank from events) e where rank <= 200"))
def q_recent_comments_page(spark, sf):
    """The page size in use (200), over articles with many comments."""
    ev = Tables(spark, sf).events.select(F.col("event_type").alias("slug"), F.col("event_id").alias("id"),
                                         F.col("ts").alias("created_at"))
    return topk.recent_comments(ev, "slug", "created_at", "id").select("slug", "id", "created_at",
                                                                       F.col("rank").cast("bigint"))


OFFER_SPEC = {"disk": {"gte": 10}, "model": {"in": ["Brand#4", "Brand#19", "Brand#2", "Brand#17"]}}
CURRENT_PRICE = 1.8
MARGIN = 0.01


@query("cheapest_offer", oracle=with_standins(
    f"with p as (select offer_id, machine_id, coalesce(base_cost, 0) + coalesce(storage_cost, 0) * 50 / 720 as "
    "price from offers where disk >= 10 and model in ('Brand#4', 'Brand#19', 'Brand#2', 'Brand#17') and not exists "
    f"(select 1 from ({_BLACK_SQL}) b where b.machine_id = offers.machine_id) and not exists (select 1 from "
    f"({_OWNED_SQL}) w where w.machine_id = offers.machine_id)), cand as (select coalesce(base_cost, 0) + "
    "coalesce(storage_cost, 0) * 50 / 720 as price from offers where offer_id % 89 = 0), best as (select * from p "
    f"order by price, offer_id limit 1) select offer_id, round(price, 9) as price, round(least({CURRENT_PRICE}, "
    f"(select min(price) from cand)) - {MARGIN}, 9) as ceiling, price <= least({CURRENT_PRICE}, (select min(price) "
    f"from cand)) - {MARGIN} as accept from best", "offers"))
def q_cheapest_offer(spark, sf):
    t = Tables(spark, sf)
    o = offers(t)
    cands = o.where(F.col("offer_id") % 89 == 0).select(price_expr("base_cost", "storage_cost").alias("price"))
    best = O.cheapest_offer(o, _blacklist(t), _owned(t), OFFER_SPEC, CURRENT_PRICE, cands, MARGIN)
    return best.select("offer_id", F.round("price", 9).alias("price"), F.round("ceiling", 9).alias("ceiling"),
                       "accept")


@query("missing_names", oracle=(
    "select distinct p_brand as name from part where p_brand not in (select p_brand from part join lineitem on "
    "l_partkey = p_partkey where l_quantity >= 50 and l_discount >= 0.1)"))
def q_missing_names(spark, sf):
    t = Tables(spark, sf)
    found = t.part.join(t.lineitem.where((F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.1)), F.col("l_partkey") == F.col("p_partkey"),
                        "left_semi")
    return G.missing_names(t.part, found, "p_brand")

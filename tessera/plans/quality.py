"""Data-check and health-signal queries: registry rules, document rules, secrets, images, backup freshness,
thresholds, silent keys and windowed rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import alerts as A, checks as C
from tessera.plans.registry import query
from tessera.plans.standins import Tables

FRESHNESS_NOW = "2024-01-31 00:00:00"
SILENCE_NOW = "2024-01-31 00:00:00"
SILENCE_LIMIT_S = 6 * 3600


@query("required_fields", oracle=(
    "with c as (select cast(c_custkey as varchar) as key, c_name, nullif(c_mktsegment, 'MACHINERY') as segment, "
    "case when c_acctbal < 0 then '' else 'x' end as phone from customer) "
    "select 'required' as rule, key, 'segment' as detail from c where segment is null or trim(segment) = '' "
    "union all select 'required', key, 'phone' from c where phone is null or trim(phone) = '' "
    "union all select 'required', key, 'c_name' from c where c_name is null or trim(c_name) = ''"))
def q_required_fields(spark, sf):
    c = Tables(spark, sf).customer.select(
        "c_custkey", "c_name", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("segment"),
        F.when(F.col("c_acctbal") < 0, "").otherwise("x").alias("phone"))
    return C.required_fields(c, "c_custkey", ["c_name", "segment", "phone"])


@query("unique_key", oracle=(
    "select 'unique' as rule, cast(l_partkey as varchar) || '|' || cast(l_suppkey as varchar) as key, "
    "cast(count(*) as varchar) as detail from lineitem group by l_partkey, l_suppkey having count(*) > 1"))
def q_unique_key(spark, sf):
    return C.unique_key(Tables(spark, sf).lineitem, ["l_partkey", "l_suppkey"])


_DOC_HOSTS_SQL = ("select cast(doc_id as varchar) as owner, unnest(list_distinct(list_filter([lower(source) || "
                  "'.example.org', case when doc_id % 50 = 0 then 'shared.example.org' end, lang || '-' || "
                  "cast(doc_id as varchar) || '.example.org'], lambda x: x is not null))) as value from documents")


@query("unique_exploded", oracle=(
    f"with p as (select distinct owner, value from ({_DOC_HOSTS_SQL}) x), s as (select value from p group by value "
    "having count(*) > 1) select 'unique_value' as rule, value as key, owner as detail from p where value in "
    "(select value from s)"))
def q_unique_exploded(spark, sf):
    d = Tables(spark, sf).documents.select(
        "doc_id", F.array_distinct(F.array_compact(F.array(
            F.concat(F.lower("source"), F.lit(".example.org")),
            F.when(F.col("doc_id") % 50 == 0, F.lit("shared.example.org")),
            F.concat(F.col("lang"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".example.org"))))).alias("hosts"))
    return C.unique_exploded(d, "doc_id", "hosts")


@query("foreign_key", oracle=(
    "select 'customer_exists' as rule, cast(o_orderkey as varchar) as key, coalesce(cast(o_custkey as varchar), "
    "'null') as detail from orders where o_custkey not in (select c_custkey from customer) union all "
    "select 'pending_needs_base_segment', cast(o_orderkey as varchar), cast(o_custkey as varchar) from orders "
    "where o_orderstatus = 'P' and o_custkey not in (select c_custkey from customer where c_mktsegment in "
    "('BUILDING', 'AUTOMOBILE')) union all select 'nation_exists', cast(c_custkey as varchar), "
    "cast(c_nationkey as varchar) from customer where c_nationkey not in (select n_nationkey from nation)"))
def q_foreign_key(spark, sf):
    t = Tables(spark, sf)
    o, c = t.orders, t.customer
    a = C.foreign_key(o, "o_orderkey", "o_custkey", c, "c_custkey", "customer_exists")
    b = C.foreign_key(o, "o_orderkey", "o_custkey", c.where(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")),
                      "c_custkey", "pending_needs_base_segment", when=F.col("o_orderstatus") == "P")
    n = C.foreign_key(c, "c_custkey", "c_nationkey", t.nation, "n_nationkey", "nation_exists")
    return a.unionByName(b).unionByName(n)


@query("secret_scan", oracle=(
    "with h as (select doc_id, unnest(regexp_extract_all(text, '(?i)(senha|password|secret|token)\\s*[:=]\\s*"
    "[\"'']?([A-Za-z0-9_\\-]{16,})', 1)) as n, unnest(regexp_extract_all(text, '(?i)(senha|password|secret|token)"
    "\\s*[:=]\\s*[\"'']?([A-Za-z0-9_\\-]{16,})', 2)) as v from documents) select doc_id, string_agg(distinct "
    "lower(n), ',' order by lower(n)) as key_name, cast(count(*) as integer) as hits from h where not "
    "regexp_matches(v, '(?i)your|change|exemplo|example|xxx|placeholder|default|endpoint-proxy|seu-|sua-') "
    "group by doc_id"))
def q_secret_scan(spark, sf):
    return C.secret_scan(Tables(spark, sf).documents, "doc_id", "text")


def _rules_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, n.replace("'", "''"), p.replace("'", "''"))
                     for i, (n, p) in enumerate(C.DOCUMENT_RULES, 1))
    return f"select * from (values {rows}) r(rank, name, pattern)"


@query("document_rules", oracle=(
    f"with r as ({_rules_sql()}), m as (select d.doc_id, r.rank, r.name from documents d, r where not "
    "regexp_matches(coalesce(d.text, ''), '(?i)' || r.pattern)) select doc_id, string_agg(name, '; ' order by "
    "rank) as missing from m group by doc_id"))
def q_document_rules(spark, sf):
    from tessera.sources.tables import literal_frame
    rules = literal_frame(spark, [(i, n, p) for i, (n, p) in enumerate(C.DOCUMENT_RULES, 1)],
                                  "rank int, name string, pattern string")
    return C.document_rules(Tables(spark, sf).documents, "doc_id", "text", rules)


@query("image_links", oracle=(
    "with i as (select page_id as doc_id, unnest(case when len(t) = 0 then [null] else t end) as target from "
    "(select page_id, list_filter(list_transform(list_zip(regexp_extract_all(coalesce(html, ''), "
    "'!\\[[^\\]]*\\]\\(([^)\\s]+)\\)|<img [^>]*src=\"([^\"]+)\"', 1), regexp_extract_all(coalesce(html, ''), "
    "'!\\[[^\\]]*\\]\\(([^)\\s]+)\\)|<img [^>]*src=\"([^\"]+)\"', 2)), lambda z: case when z[1] <> '' then z[1] else z[2] "
    "end), lambda x: x <> '') as t from pages) p) select doc_id, target, case when target is not null then not "
    "starts_with(target, 'http') end as is_local from i"))
def q_image_links(spark, sf):
    return C.image_links(Tables(spark, sf).pages, "page_id", "html")


def _runs(t: Tables):
    ev = t.events
    kind = (F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "fail")
            .when(F.col("event_type") == "signup", "verify"))
    return ev.select(F.concat(F.lit("job"), (F.col("user_id") % 10).cast("string")).alias("subject"),
                     # successful runs of one hour have lost their time: unreadable records
                     kind.alias("kind"), F.when(~((kind == "ok") & (F.hour("ts") == 3)) | (kind != "ok"), F.col("ts"))
                     .alias("finished_at"), (F.col("value") > 20).alias("flag"),
                     F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("reason")) \
        .where(F.col("kind").isNotNull())


@query("freshness_alert", oracle=(
    "with r as (select 'job' || cast(user_id % 10 as varchar) as subject, case event_type when 'purchase' then 'ok' "
    "when 'error' then 'fail' when 'signup' then 'verify' end as kind, ts as finished_at, value > 20 as flag, "
    "event_type || ' ' || props as reason from events), r2 as (select subject, kind, case when kind = 'ok' and "
    "hour(finished_at) = 3 then null else finished_at end as finished_at, flag, reason from r where kind is not null), "
    "a as (select subject, max(finished_at) filter (where kind = 'ok') as ok_at, arg_max(flag, finished_at) filter "
    "(where kind = 'ok') as ok_flag, max(finished_at) filter (where kind = 'fail') as fail_at, arg_max(reason, "
    "finished_at) filter (where kind = 'fail') as fail_reason, arg_max(flag, finished_at) filter (where kind = "
    "'verify') as verify_flag, count(*) filter (where kind = 'ok' and finished_at is null) as unreadable from r2 group "
    "by subject), p as (select subject, list_filter([case when unreadable > 0 then 'unreadable run record' end, case "
    "when ok_at is null and unreadable = 0 then 'no successful run' end, case when ok_at is not null and (epoch(timestamp '" + FRESHNESS_NOW + "') - "
    "epoch(ok_at)) / 3600 > 26 then 'last successful run ' || cast(cast(floor((epoch(timestamp '" + FRESHNESS_NOW +
    "') - epoch(ok_at)) / 3600) as bigint) as varchar) || 'h ago' end, case when ok_at is not null and not "
    "coalesce(ok_flag, false) then 'ok record not ok' end, case when fail_at is not null and (ok_at is null or "
    "fail_at > ok_at) then 'failed at ' || strftime(fail_at, '%Y-%m-%d %H:%M:%S') || ': ' || coalesce(fail_reason, "
    "'') end, case when verify_flag is not null and not verify_flag then 'restore verification failed' end], lambda x: x "
    "is not null) as pr from a) select subject, len(pr) > 0 as alert, array_to_string(pr, '; ') as problems "
    "from p"))
def q_freshness_alert(spark, sf):
    return C.freshness_alert(_runs(Tables(spark, sf)), FRESHNESS_NOW)


_SIGNALS_SQL = ("select event_id as sample_id, case event_type when 'click' then 'disk_pct' when 'view' then "
                "'pg_connections_pct' when 'error' then 'store_5xx_pct' when 'purchase' then 'backup_hours' else "
                "'pg_cache_pct' end as signal, case when event_id % 37 = 0 then null when event_type = 'click' then "
                "value / 5 when event_type = 'view' then value / 5 when event_type = 'error' then value / 50 when "
                "event_type = 'purchase' then value / 5 else 100 - value / 10 end as value from events union all "
                "select event_id, 'store_ready', case when value > 30 then 1.0 else 0.0 end from events where "
                "event_type = 'view' union all select event_id, 'collector', null from events where event_type = "
                "'signup'")


@query("threshold_alerts", oracle=(
    f"with s as ({_SIGNALS_SQL}), l as (select * from (values ('disk_pct', 92.0, '<', false), "
    "('pg_connections_pct', 85.0, '<', false), ('pg_cache_pct', 93.0, '>=', false), ('pg_longest_tx_s', 1800.0, "
    "'<', false), ('store_5xx_pct', 5.0, '<', true), ('backup_hours', 50.0, '<', false)) l(signal, lim, op, "
    "missing_ok)), g as (select sample_id, n.signal from (select distinct sample_id from s) d, (values ('disk_pct'), "
    "('pg_connections_pct'), ('pg_cache_pct'), ('pg_longest_tx_s'), ('store_5xx_pct'), ('backup_hours'), "
    "('store_ready'), ('collector')) n(signal)), v as (select g.sample_id, g.signal, max(value) as value from g left "
    "join s on s.sample_id = g.sample_id and s.signal = g.signal group by 1, 2) select sample_id, v.signal, value, case when v.signal = 'collector' then true when v.signal = "
    "'store_ready' then coalesce(value = 1, false) when value is null then coalesce(missing_ok, false) when op = "
    "'<' then value < lim when op = '>=' then value >= lim else false end as ok from v left join l on v.signal = "
    "l.signal"))
def q_threshold_alerts(spark, sf):
    ev = Tables(spark, sf).events
    et, v, k = F.col("event_type"), F.col("value"), F.col("event_id")
    sig = (F.when(et == "click", "disk_pct").when(et == "view", "pg_connections_pct")
           .when(et == "error", "store_5xx_pct").when(et == "purchase", "backup_hours").otherwise("pg_cache_pct"))
    val = (F.when(k % 37 == 0, F.lit(None)).when(et.isin("click", "view", "purchase"), v / 5)
           .when(et == "error", v / 50).otherwise(100 - v / 10))
    main = ev.select(k.alias("sample_id"), sig.alias("signal"), val.cast("double").alias("value"))
    ready = ev.where(et == "view").select(k.alias("sample_id"), F.lit("store_ready").alias("signal"),
                                          F.when(v > 30, 1.0).otherwise(0.0).alias("value"))
    beat = ev.where(et == "signup").select(k.alias("sample_id"), F.lit("collector").alias("signal"),
                                           F.lit(None).cast("double").alias("value"))
    return A.threshold_alerts(main.unionByName(ready).unionByName(beat), A.limits_frame(spark))


@query("silent_key_alert", bench=True, oracle=(
    "select user_id as key, ts as silent_from, s as silent_seconds from (select user_id, ts, (epoch_us(coalesce(lead("
    f"ts) over (partition by user_id order by ts, event_id), timestamp '{SILENCE_NOW}')) - epoch_us(ts)) / 1000000.0"
    f" as s from events) e where s > {SILENCE_LIMIT_S}"))
def q_silent_key_alert(spark, sf):
    return A.silent_key_alert(Tables(spark, sf).events, "user_id", "ts", SILENCE_LIMIT_S, SILENCE_NOW,
                              tiebreak="event_id")


@query("window_rates", oracle=(
    "select time_bucket(interval 5 minutes, ts) as window_start, event_type as key, count(*) as events, "
    "round(count(*) / 300.0, 6) as rate from events group by 1, 2"))
def q_window_rates(spark, sf):
    return A.window_rates(Tables(spark, sf).events, "ts", "event_type")

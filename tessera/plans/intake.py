"""Source and sink queries: pruned loads, schema conforming, catalog loads, comments, sinks, vectors and the text
parsers, each on data derived from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.plans.standins import TABLES, Tables, ledger, notices, with_standins
from tessera.session import scratch_path
from tessera.sources import keyed, sinks, tables, text
from tessera.operators import bi


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("load_table", oracle="select doc_id, lang, source, n_chars from documents")
def q_load_table(spark, sf):
    return tables.load_table(spark, Tables(spark, sf).path("documents"), dropped={"text"})


@query("conform_schema", oracle="select vec_id, label from embeddings")
def q_conform_schema(spark, sf):
    return tables.conform_schema(Tables(spark, sf).embeddings)


@query("load_catalog", oracle=" union all ".join(
    f"select '{t}' as \"table\", count(*) as \"rows\", cast(null as varchar) as error from {t}" for t in TABLES))
def q_load_catalog(spark, sf):
    t = Tables(spark, sf)
    specs = {name: tables.TableSpec(t.path(name)) for name in TABLES}
    return tables.load_catalog(spark, specs, target=_scratch(spark, "catalog")).select("table", "rows", "error")


@query("drop_ingestion_columns", oracle="select * from events")
def q_drop_ingestion_columns(spark, sf):
    ev = Tables(spark, sf).events
    landed = ev.withColumn("dt_carga", F.col("ts")).withColumn("data_carga", F.to_date("ts"))
    return tables.drop_ingestion_columns(landed)


@query("carry_comments", oracle="select * from nation")
def q_carry_comments(spark, sf):
    n = Tables(spark, sf).nation
    return tables.carry_comments(n, "Nations of the test schema. " * 60,
                                 {"n_name": "Nation name", "n_regionkey": "Region key " * 80})


@query("full_refresh_sink", oracle="select * from nation")
def q_full_refresh_sink(spark, sf):
    path = _scratch(spark, "refresh")
    n = Tables(spark, sf).nation
    sinks.full_refresh_sink(n.where(F.col("n_nationkey") < 5), path)   # first load
    sinks.full_refresh_sink(n, path)                                   # full refresh replaces it
    return sinks.read_refreshed(spark, path)


@query("materialize_view", oracle=with_standins(
    "select uf, count(*) as notices, cast(round(sum(cast(estimated_value as decimal(38,2))), 2) as decimal(38,2)) "
    "as estimated_value from notices where uf is not null group by uf", "notices"))
def q_materialize_view(spark, sf):
    return sinks.materialize_view(bi.notices_by_uf(notices(Tables(spark, sf))), _scratch(spark, "bi_by_uf"))


@query("load_vectors", oracle="select vec_id as id, embedding as vector from embeddings")
def q_load_vectors(spark, sf):
    return tables.load_vectors(Tables(spark, sf).embeddings, "vec_id", "embedding", 64)


def _metric_lines(t: Tables):
    ev = t.events
    line = (F.when(F.col("event_type") == "signup", F.concat(F.lit("# HELP signup "), F.col("user_id").cast("string")))
            .otherwise(F.concat(F.col("event_type"), F.lit("_total"),
                                F.when(F.col("event_id") % 3 == 0, F.lit(""))
                                .otherwise(F.concat(F.lit('{user="'), F.col("user_id").cast("string"), F.lit('"}'))),
                                F.lit(" "), F.round(F.col("value") * 100).cast("bigint").cast("string"))))
    return ev.select(line.alias("value"))


_METRIC_LINES_SQL = ("select case when event_type = 'signup' then '# HELP signup ' || cast(user_id as varchar) "
                     "else event_type || '_total' || case when event_id % 3 = 0 then '' else '{user=\"' || "
                     "cast(user_id as varchar) || '\"}' end || ' ' || cast(cast(round(value * 100) as bigint) as "
                     "varchar) end as value from events")


@query("parse_metric_text", oracle=(
    f"with l as ({_METRIC_LINES_SQL}), p as (select regexp_extract(value, "
    "'^([A-Za-z_:][A-Za-z0-9_:]*)(\\{[^}]*\\})? ([0-9.e+]+)$', 1) as metric, regexp_extract(value, "
    "'^([A-Za-z_:][A-Za-z0-9_:]*)(\\{[^}]*\\})? ([0-9.e+]+)$', 3) as v from l) "
    "select metric, sum(try_cast(v as double)) as total from p where metric <> '' group by metric"))
def q_parse_metric_text(spark, sf):
    return text.sum_metrics(text.parse_metric_text(_metric_lines(Tables(spark, sf))))


_USAGE_LINES_SQL = ("select case when s_suppkey % 10 = 0 then 'Project ID   Used   Soft   Hard' "
                    "when s_suppkey % 10 = 1 then '  rt_short ' || cast(s_suppkey as varchar) "
                    "else '  rt_' || lower(replace(s_name, '#', '')) || '   ' || cast(s_suppkey * 7 as varchar) || "
                    "'  0   ' || cast(s_nationkey * 1000 + 10 as varchar) || '  00 [--------]' end as value "
                    "from supplier")


@query("parse_usage_report", oracle=(
    f"with l as ({_USAGE_LINES_SQL}), p as (select regexp_split_to_array(trim(value), '\\s+') as p from l) "
    "select substring(p[1], 4) as tenant, try_cast(p[2] as bigint) * 1024 as used_bytes, "
    "try_cast(p[4] as bigint) * 1024 as hard_bytes from p where len(p) >= 4 and starts_with(p[1], 'rt_')"))
def q_parse_usage_report(spark, sf):
    s = Tables(spark, sf).supplier
    k = F.col("s_suppkey")
    line = (F.when(k % 10 == 0, F.lit("Project ID   Used   Soft   Hard"))
            .when(k % 10 == 1, F.concat(F.lit("  rt_short "), k.cast("string")))
            .otherwise(F.concat(F.lit("  rt_"), F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit(""))),
                                F.lit("   "), (k * 7).cast("string"), F.lit("  0   "),
                                (F.col("s_nationkey") * 1000 + 10).cast("string"), F.lit("  00 [--------]"))))
    return text.parse_usage_report(s.select(line.alias("value")))


_KV_LINES_SQL = ("select c_custkey as line_no, case c_custkey % 7 when 0 then '   ' when 1 then '  # ' || c_name "
                 "when 2 then 'BAD KEY=' || cast(c_custkey as varchar) when 3 then 'NO_EQUALS_' || "
                 "cast(c_custkey as varchar) else ' KEY_' || cast(c_custkey % 40 as varchar) || ' =' || c_name || "
                 "'=' || c_mktsegment end as value from customer")


@query("parse_key_values", oracle=(
    f"with l as ({_KV_LINES_SQL}), kv as (select line_no, regexp_replace(split_part(value, '=', 1), "
    "'^\\s+|\\s+$', '', 'g') as key, substring(value, instr(value, '=') + 1) as value from l where trim(value) <> '' "
    "and not starts_with(regexp_replace(value, '^\\s+', ''), '#') and instr(value, '=') > 0) "
    "select key, arg_max(value, line_no) as value from kv where regexp_matches(key, '^_*[\\p{L}\\p{N}][\\p{L}\\p{N}_]*$') "
    "group by key"))
def q_parse_key_values(spark, sf):
    c = Tables(spark, sf).customer
    k = F.col("c_custkey")
    line = (F.when(k % 7 == 0, F.lit("   "))
            .when(k % 7 == 1, F.concat(F.lit("  # "), F.col("c_name")))
            .when(k % 7 == 2, F.concat(F.lit("BAD KEY="), k.cast("string")))
            .when(k % 7 == 3, F.concat(F.lit("NO_EQUALS_"), k.cast("string")))
            .otherwise(F.concat(F.lit(" KEY_"), (k % 40).cast("string"), F.lit(" ="), F.col("c_name"), F.lit("="),
                                F.col("c_mktsegment"))))
    return text.parse_key_values(c.select(k.alias("line_no"), line.alias("value")), "line_no")


@query("read_tsv", oracle=(
    "select website_id, name, domain from (select case when n_nationkey % 5 = 0 then '' else 'w' || "
    "cast(n_nationkey as varchar) end as website_id, n_name as name, lower(n_name) || '.example' as domain "
    "from nation) t where website_id <> ''"))
def q_read_tsv(spark, sf):
    n = Tables(spark, sf).nation
    path = _scratch(spark, "sites")
    n.select(F.when(F.col("n_nationkey") % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit("w"), F.col("n_nationkey").cast("string"))).alias("website_id"),
        F.col("n_name").alias("name"), F.concat(F.lower("n_name"), F.lit(".example")).alias("domain")) \
        .write.mode("overwrite").csv(path, sep="\t", emptyValue="")
    return text.read_tsv(spark, path)


@query("read_ledger", oracle=with_standins("select key, status, seq from ledger", "ledger"))
def q_read_ledger(spark, sf):
    path = _scratch(spark, "ledger")
    ledger(Tables(spark, sf)).write.mode("overwrite").json(path)
    return text.read_ledger(spark, path).select("key", "status", "seq")


def _broken_ledger(spark, sf) -> text.ParsedLines:
    """The ledger with lines cut short, lines that are no objects, lines without a key and lines with a wrong type."""
    path, k = _scratch(spark, "broken-ledger"), F.col("seq")
    whole = F.to_json(F.struct("key", "status", "seq"))
    line = (F.when(k % 11 == 0, F.substring(whole, F.lit(1), F.length(whole) - 5)).when(k % 13 == 0, F.lit("[1, 2]"))
            .when(k % 17 == 0, F.to_json(F.struct("status", "seq")))
            .when(k % 19 == 0, F.replace(whole, F.concat(F.lit('"seq":'), k.cast("string")), F.lit('"seq":"soon"')))
            .when(k % 23 == 0, F.lit("  ")).otherwise(whole))
    ledger(Tables(spark, sf)).select(line.alias("value")).write.text(path)
    return text.read_ledger_lines(spark, path)


_BROKEN_SQL = ("select *, case when seq % 11 = 0 then 'not JSON' when seq % 13 = 0 then 'not an object' when seq % 17 = 0 then "
               "'key: missing' when seq % 19 = 0 then 'seq: not a bigint' when seq % 23 = 0 then 'blank' end as reason from "
               "ledger")


@query("read_ledger_lines", oracle=with_standins(
    f"select key, status, seq from ({_BROKEN_SQL}) t where reason is null", "ledger"))
def q_read_ledger_lines(spark, sf):
    return _broken_ledger(spark, sf).rows


@query("unreadable_lines", oracle=with_standins(
    f"select reason, count(*) as n from ({_BROKEN_SQL}) t where reason <> 'blank' group by reason", "ledger"))
def q_unreadable_lines(spark, sf):
    return _broken_ledger(spark, sf).unreadable.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("read_json_orders", oracle=(
    "select case when o_orderkey % 2 = 0 then 'one' else 'two' end as account, 'order' as kind, cast(o_orderkey as "
    "varchar) as order_id, o_orderstatus as status, o_orderkey % 4 = 0 as product_is_object, case when o_orderkey "
    "% 4 = 0 then o_orderpriority end as product_name, 'c' || cast(o_custkey as varchar) || '@x.com' as email, "
    "'o' || cast(o_orderkey as varchar) as orders from orders"))
def q_read_json_orders(spark, sf):
    return _landed_orders(spark, sf).select(
        "account", "kind", "order_id", "status", "product_is_object", "product_name", "email",
        F.array_join("orders", ",").alias("orders"))


def _landed_orders(spark, sf):
    o = Tables(spark, sf).orders
    k = F.col("o_orderkey")
    raw = o.select(
        k.cast("string").alias("id"), F.col("o_orderstatus").alias("status"),
        F.when(k % 4 == 0, F.to_json(F.struct(F.col("o_orderpriority").alias("name"))))
        .otherwise(F.col("o_orderpriority")).alias("product"),
        F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@x.com")).alias("email"))
        .alias("customer"), F.array(F.concat(F.lit("o"), k.cast("string"))).alias("orders"))
    base = _scratch(spark, "orders")
    raw.where(k % 2 == 0).write.mode("overwrite").json(f"{base}/one")
    raw.where(k % 2 == 1).write.mode("overwrite").json(f"{base}/two")
    return text.read_json_orders(spark, {"one": f"{base}/one", "two": f"{base}/two"})


def _report_sql() -> str:
    from tessera.plans.registry import ORACLES
    return with_standins("select 'orders' as section, account as name, count(*) as n from payments group by account "
                         f"union all select 'divergences', kind, count(*) from ({ORACLES['reconcile']}) d group by kind",
                         "payments")


@query("report_sink", oracle=_report_sql)
def q_report_sink(spark, sf):
    from tessera.plans.reconciliation import q_reconcile, _orders
    header = sinks.report_sink(q_reconcile(spark, sf), _orders(Tables(spark, sf)), _scratch(spark, "report"),
                               "2001-01-01 04:30:00")
    return sinks.report_rows(header)


_BUCKET_LINES_SQL = ("select case when s_suppkey % 9 = 0 then 'total ' || cast(s_suppkey as varchar) when s_suppkey % 4 "
                     "= 0 then cast(s_suppkey as varchar) || 'GiB' || chr(9) || cast(s_nationkey as varchar) || "
                     "' objects' || chr(9) || lower(replace(s_name, '#', '-')) else cast(s_suppkey as varchar) || 'KiB ' "
                     "|| cast(s_nationkey as varchar) || ' object ' end as value from supplier")


@query("parse_bucket_listing", oracle=(
    f"with l as (select replace(value, chr(9), ' ') as v from ({_BUCKET_LINES_SQL}) x), p as (select regexp_extract(v, "
    "'^(\\S+)\\s+(\\d+) objects?\\s+(\\S*)', ['size', 'n', 'bucket']) as m from l) select m.bucket as bucket, m.size as "
    "size, cast(m.n as bigint) as objects from p where m.bucket <> ''"))
def q_parse_bucket_listing(spark, sf):
    s = Tables(spark, sf).supplier
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    line = (F.when(F.col("s_suppkey") % 9 == 0, F.concat(F.lit("total "), k))
            .when(F.col("s_suppkey") % 4 == 0, F.concat(k, F.lit("GiB\t"), n, F.lit(" objects\t"),
                                                        F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-")))))
            .otherwise(F.concat(k, F.lit("KiB "), n, F.lit(" object "))))
    return text.parse_bucket_listing(s.select(line.alias("value")))


@query("insert_if_absent", oracle=(
    "select * from customer where c_custkey % 2 = 0 union all "
    "select * from customer where c_custkey % 3 = 0 and c_custkey % 2 <> 0"))
def q_insert_if_absent(spark, sf):
    c = Tables(spark, sf).customer
    return sinks.insert_if_absent(c.where(F.col("c_custkey") % 2 == 0), c.where(F.col("c_custkey") % 3 == 0),
                                  ["c_custkey"])


@query("insert_if_absent_table", oracle=(
    "select * from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0"))
def q_insert_if_absent_table(spark, sf):
    """The same into a stored table: the second batch rewrites only the buckets of its keys."""
    c = Tables(spark, sf).customer
    table = keyed.KeyedTable(spark, _scratch(spark, "customers"), c.schema, ("c_custkey",), buckets=16)
    merge = keyed.first_write(["c_custkey"], ["c_name"])
    table.apply(c.where(F.col("c_custkey") % 2 == 0), merge, 0)
    table.apply(c.where(F.col("c_custkey") % 3 == 0), merge, 1)
    return table.rows()

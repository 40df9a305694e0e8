"""Projection, filter and scalar-function queries (filters given as data, prices, night windows, status classes,
nested records, monitor rules, comment moderation, key formats, text and hash helpers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.functions import scalar as S
from tessera.plans.registry import query
from tessera.plans.standins import Tables, offers, payments, releases, with_standins

AGE_NOW = "2024-02-01 00:00:00"
SALT = "s3cr3t-salt"


def _orders_nullified(t: Tables):
    return t.orders.select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("modality"))


@query("filter_not_null", oracle="select o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') as modality "
                                 "from orders where nullif(o_orderpriority, '4-NOT SPECIFIED') is not null")
def q_filter_not_null(spark, sf):
    return P.filter_not_null(_orders_nullified(Tables(spark, sf)), ["modality"])


@query("default_label", oracle="select o_orderkey, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), "
                               "'Not informed') as modality from orders")
def q_default_label(spark, sf):
    return P.default_label(_orders_nullified(Tables(spark, sf)), "modality", "Not informed")


@query("filter_conjunction", oracle=(
    "select event_id, event_type, size_class, value from (select *, case when value > 100 then 'big' else 'small' "
    "end as size_class from events) e where event_type = 'click' and size_class = 'small' and value > 0"))
def q_filter_conjunction(spark, sf):
    ev = Tables(spark, sf).events.withColumn("size_class", F.when(F.col("value") > 100, "big").otherwise("small"))
    return P.filter_conjunction(ev, {"event_type": "click", "size_class": "small"}, positive="value") \
        .select("event_id", "event_type", "size_class", "value")


FILTER_SPEC = {"p_brand": {"in": ["Brand#4", "Brand#19", "Brand#2"]}, "p_size": {"gte": 10},
               "p_retailprice": {"lt": 1500.0}}


@query("filter_spec", oracle="select * from part where p_brand in ('Brand#4', 'Brand#19', 'Brand#2') "
                             "and p_size >= 10 and p_retailprice < 1500.0")
def q_filter_spec(spark, sf):
    return P.filter_spec(Tables(spark, sf).part, FILTER_SPEC)


@query("derived_price", oracle=with_standins(
    "select offer_id, round(coalesce(base_cost, 0) + coalesce(storage_cost, 0) * 50 / 720, 9) as price "
    "from offers", "offers"))
def q_derived_price(spark, sf):
    o = P.derived_price(offers(Tables(spark, sf)), "base_cost", "storage_cost")
    return o.select("offer_id", F.round("price", 9).alias("price"))


@query("night_window", oracle="select event_id, hour(ts - interval 3 hour) >= 0 and hour(ts - interval 3 hour) < 6 "
                              "as is_night from events")
def q_night_window(spark, sf):
    return P.night_window(Tables(spark, sf).events, "ts").select("event_id", "is_night")


@query("status_class", oracle=with_standins(
    "select order_id, case when lower(status) in ('paid', 'approved', 'authorized', 'active', 'completed') then "
    "'paid' when lower(status) in ('refunded', 'chargedback', 'chargeback', 'canceled', 'cancelled', 'refused') "
    "then 'returned' else 'ignore' end as status_class from payments", "payments"))
def q_status_class(spark, sf):
    return P.status_class(payments(Tables(spark, sf)), "status").select("order_id", "status_class")


def _registry(t: Tables):
    n, r = t.nation, t.region
    k = F.col("n_nationkey")
    from tessera.operators.joins import broadcast_checked
    reg = n.join(broadcast_checked(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return reg.select(
        k.alias("id"), F.col("n_name").alias("name"),
        F.when(k % 4 == 0, "product").when(k % 4 == 1, "variant").when(k % 4 == 2, "testing")
        .otherwise("internal").alias("kind"),
        F.when(k % 5 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lower("n_name"), F.lit(".example.org")))).alias("hosts"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("org/"), F.lower("r_name"))).alias("repository"),
        F.col("r_name").alias("service"))


_REGISTRY_SQL = ("select n_nationkey as id, n_name as name, case n_nationkey % 4 when 0 then 'product' when 1 then "
                 "'variant' when 2 then 'testing' else 'internal' end as kind, case when n_nationkey % 5 = 0 then "
                 "null else lower(n_name) || '.example.org' end as host, case when n_nationkey % 3 = 0 then null "
                 "else 'org/' || lower(r_name) end as repository, r_name as service from nation join region on "
                 "n_regionkey = r_regionkey")


@query("nested_projection", oracle=(
    f"with reg as ({_REGISTRY_SQL}), src as (select distinct r_name as svc from region where r_regionkey % 2 = 0) "
    "select id, name, kind, case when host is not null then 'https://' || host || '/' end as link_product, "
    "case when host is not null and kind in ('product', 'variant', 'testing') then 'https://' || host || '/admin' "
    "end as link_admin, case when repository is not null then 'https://github.com/' || repository end as "
    "link_github, case when svc is not null then 'deploy' end as link_deploy from reg left join src on "
    "reg.service = src.svc"))
def q_nested_projection(spark, sf):
    t = Tables(spark, sf)
    sources = t.region.where(F.col("r_regionkey") % 2 == 0).select(F.col("r_name").alias("service"),
                                                                   F.lit("org/releases").alias("repo"))
    out = P.nested_projection(_registry(t), sources)
    return out.select("id", "name", "kind", F.col("links.product").alias("link_product"),
                      F.col("links.admin").alias("link_admin"), F.col("links.github").alias("link_github"),
                      F.col("links.deploy").alias("link_deploy"))


# Monitors that do not come from records (stand-ins for platform and infrastructure checks).
FIXED_MONITORS = [("Platform", "Site", "http", "https://www.example.org/"),
                  ("Infrastructure", "Database", "port", "db:5432"),
                  ("Health", "Health: disk", "push", "disk")]


@query("expand_rules", oracle=(
    "with s as (select s_name as name, case s_suppkey % 3 when 0 then 'product' when 1 then 'testing' else "
    "'other' end as kind, lower(replace(s_name, '#', '-')) || '.example.org' as host from supplier) "
    "select 'Products' as \"group\", name, 'http' as type, 'https://' || host || '/health' as target from s "
    "where kind = 'product' union all select 'Products', name || ' (files)', 'http', 'https://' || host || "
    "'/health/files' from s where kind = 'product' union all select 'Products', name || ' (testing)', 'http', "
    "'https://' || host || '/health' from s where kind = 'testing' union all select * from (values "
    "('Platform', 'Site', 'http', 'https://www.example.org/'), ('Infrastructure', 'Database', 'port', "
    "'db:5432'), ('Health', 'Health: disk', 'push', 'disk')) f(\"group\", name, type, target)"))
def q_expand_rules(spark, sf):
    s = Tables(spark, sf).supplier
    rec = s.select(F.col("s_name").alias("name"),
                   F.when(F.col("s_suppkey") % 3 == 0, "product").when(F.col("s_suppkey") % 3 == 1, "testing")
                   .otherwise("other").alias("kind"),
                   F.concat(F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-"))), F.lit(".example.org"))
                   .alias("host"))
    from tessera.sources.tables import literal_frame
    fixed = literal_frame(spark, FIXED_MONITORS, "group string, name string, type string, target string")
    return P.expand_rules(rec, fixed_df=fixed)


@query("moderate_comments", oracle=(
    "with c as (select conv_id, turn, role as name, text as body, case when turn % 17 = 5 then 'x' else '' end "
    "as website from conversations), n as (select *, regexp_replace(regexp_replace(coalesce(name, ''), '\\s+', ' ', "
    "'g'), '^ | $', '', 'g') as cn, regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g') as cb from c) "
    "select conv_id, turn, case when length(coalesce(name, '')) < 1 or length(coalesce(name, '')) > 60 then "
    "'name_length' when length(coalesce(body, '')) < 2 or length(coalesce(body, '')) > 2000 then 'body_length' "
    "when length(website) > 0 then 'honeypot' when length(cn) = 0 or length(cb) < 2 then 'required' when "
    "len(regexp_extract_all(cb, 'https?://')) > 2 then 'too_many_links' end as reason from n"))
def q_moderate_comments(spark, sf):
    c = Tables(spark, sf).conversations.select(
        "conv_id", "turn", F.col("role").alias("name"), F.col("text").alias("body"),
        F.when(F.col("turn") % 17 == 5, "x").otherwise("").alias("website"))
    return P.moderate_comments(c, honeypot="website").select("conv_id", "turn", "reason")


@query("valid_key_format", oracle=(
    "select page_id, slug, coalesce(regexp_matches(slug, '^[a-z0-9][a-z0-9-]{2,90}$'), false) as valid from "
    "(select page_id, lower(regexp_extract(url, '//([^./]+)', 1)) as slug from pages) p"))
def q_valid_key_format(spark, sf):
    p = Tables(spark, sf).pages.select("page_id", F.lower(F.regexp_extract("url", r"//([^./]+)", 1)).alias("slug"))
    return P.valid_key_format(p, "slug", P.SLUG_PATTERN)


# ---- scalar functions -----------------------------------------------------------------------------------------
@query("strip_accents", oracle="select doc_id, lower(strip_accents(text)) as folded from documents")
def q_strip_accents(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", S.strip_accents("text").alias("folded"))


@query("event_root_id", oracle=with_standins(
    "select event_id, split_part(event_id, ':', 1) as root_id from releases", "releases"))
def q_event_root_id(spark, sf):
    return releases(Tables(spark, sf)).select("event_id", S.event_root_id("event_id").alias("root_id"))


@query("round_money", oracle="select o_orderkey, cast(round(cast(o_totalprice as decimal(38,10)), 2) as "
                             "decimal(38,2)) as value from orders")
def q_round_money(spark, sf):
    return Tables(spark, sf).orders.select("o_orderkey", S.round_money("o_totalprice").alias("value"))


@query("truncate_text", oracle="select doc_id, substring(text, 1, 800) as text800 from documents")
def q_truncate_text(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", S.truncate_text("text").alias("text800"))


@query("concat_search_text", oracle="select doc_id, concat_ws(' ', coalesce(nullif(source, 'src1'), ''), "
                                    "coalesce(lang, ''), coalesce(cast(n_chars as varchar), '')) as search_text "
                                    "from documents")
def q_concat_search_text(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", S.concat_search_text(F.nullif(F.col("source"), F.lit("src1")), "lang",
                                                   F.col("n_chars").cast("string")).alias("search_text"))


@query("salted_hash", oracle=f"select event_id, sha256('{SALT}' || cast(user_id as varchar)) as hashed from events")
def q_salted_hash(spark, sf):
    return Tables(spark, sf).events.select("event_id", S.salted_hash("user_id", SALT).alias("hashed"))


@query("first_sentence", oracle=(
    "with t as (select doc_id, regexp_replace(regexp_replace(text, '[*`]', '', 'g'), '^\\s+|\\s+$', '', 'g') as s "
    "from documents), h as (select doc_id, s, regexp_extract(s, '(?s)^(.*?[.!?])\\s', 1) as head from t) "
    "select doc_id, replace(substring(case when head = '' then s else head end, 1, 140), '|', '/') as sentence "
    "from h"))
def q_first_sentence(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", S.first_sentence("text").alias("sentence"))


@query("age_hours", oracle=(
    f"select event_id, coalesce(round((epoch_us(timestamp '{AGE_NOW}') / 1000000.0 - epoch_us(ts) / 1000000.0) "
    "/ 3600.0, 1), 9999.0) as age from (select event_id, case when event_id % 9 = 0 then null else ts end as ts "
    "from events) e"))
def q_age_hours(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", F.when(F.col("event_id") % 9 == 0, None)
                                         .otherwise(F.col("ts")).alias("ts"))
    return ev.select("event_id", S.age_hours("ts", AGE_NOW).alias("age"))


@query("pct_used", oracle="select l_orderkey, l_linenumber, round(100.0 * l_quantity / nullif(l_extendedprice, 0), 1)"
                          " as pct from lineitem")
def q_pct_used(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.select("l_orderkey", "l_linenumber", S.pct_used("l_quantity", "l_extendedprice").alias("pct"))


@query("json_path", oracle="select event_id, coalesce(json_extract_string(props, '$.k'), '-') as k, "
                           "coalesce(json_extract_string(props, '$.missing'), '-') as missing from events")
def q_json_path(spark, sf):
    ev = Tables(spark, sf).events
    return ev.select("event_id", S.json_path("props", "$.k", "-").alias("k"),
                     S.json_path("props", "$.missing", "-").alias("missing"))

"""Reconciliation queries on the payments / entitlements / releases stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import reconcile as R
from tessera.plans.registry import query
from tessera.plans.standins import (ENTITLEMENT_NOW, Tables, entitlements, payments, prefixes, releases,
                                    with_standins)

NOW = ENTITLEMENT_NOW


def _orders(t: Tables):
    """Payments as provider orders: every row is an order; a missing product name stands for a product that is
    not an object (skipped by the rules)."""
    return payments(t).withColumn("kind", F.lit("order")) \
        .withColumn("product_is_object", F.col("product_name").isNotNull())


def _active(t: Tables):
    return R.latest_entitlement(entitlements(t), None, NOW)


def _base(t: Tables):
    return entitlements(t).select("product").unionByName(releases(t).select("product")).distinct()


def _ids(t: Tables):
    return R.known_ids(payments(t), ["order_id"])


# ---- oracle building blocks (DuckDB) -------------------------------------------------------------------------
_ACTIVE = ("active as (select product, email, order_id, until from (select product, lower(coalesce(email, '')) "
           "as email, order_id, active_until as until, row_number() over (partition by product, "
           "lower(coalesce(email, '')) order by src desc, seq desc) as rn from (select *, 0 as src from "
           "entitlements) e where active_until is not null and active_until > timestamp '" + NOW + "') x "
           "where rn = 1)")
_OT = ("ot as (select o.*, (select p.target from prefixes p where starts_with(lower(strip_accents("
       "o.product_name)), p.prefix) order by p.rank limit 1) as target from (select account, order_id, "
       "lower(coalesce(email, '')) as email, case when lower(status) in ('paid', 'approved', 'authorized', "
       "'active', 'completed') then 'paid' when lower(status) in ('refunded', 'chargedback', 'chargeback', "
       "'canceled', 'cancelled', 'refused') then 'returned' else 'ignore' end as sc, coalesce(product_name, '') "
       "as product_name from payments where product_name is not null) o)")
_BASE = "base as (select product from entitlements union select product from releases)"
_ROOTS = "roots as (select distinct product, split_part(event_id, ':', 1) as order_id from releases)"
_KNOWN = "known as (select distinct order_id from payments where order_id is not null and order_id <> '')"

_PNR = ("select 'paid_not_released' as kind, account, order_id, target as product, email from ot "
        "where target is not null and target in (select product from base) and sc = 'paid' "
        "and not exists (select 1 from roots r where r.product = ot.target and r.order_id = ot.order_id) "
        "and not exists (select 1 from active a where a.product = ot.target and a.email = ot.email)")
_RSA = ("select 'refunded_still_active' as kind, ot.account, ot.order_id, ot.target as product, ot.email from ot "
        "join active a on a.product = ot.target and a.email = ot.email and a.order_id = ot.order_id "
        "where ot.sc = 'returned' and ot.target in (select product from base)")
_UNR = ("select 'unregistered_product' as kind, account, order_id, product_name as product, email from ot "
        "where target is null and account not in ('two')")
_RWP = ("select 'released_without_payment' as kind, cast(null as varchar) as account, order_id, product, email "
        "from active a where order_id is not null and order_id <> '' and not starts_with(order_id, 'qa-') "
        "and not exists (select 1 from known k where k.order_id = a.order_id)")


def _oracle(body: str) -> str:
    sql = with_standins("select 1", "payments", "entitlements", "releases", "prefixes")
    ctes = sql[len("with "):-len(" select 1")]
    return f"with {ctes}, {_ACTIVE}, {_OT}, {_BASE}, {_ROOTS}, {_KNOWN} {body}"


@query("prefix_lookup", oracle=_oracle("select order_id, product_name, target from ot"))
def q_prefix_lookup(spark, sf):
    t = Tables(spark, sf)
    o = payments(t).where(F.col("product_name").isNotNull()).select("order_id", "product_name")
    return R.prefix_lookup(o, "product_name", prefixes(spark)).select("order_id", "product_name", "target")


@query("latest_entitlement", oracle=with_standins(
    "select product, email, order_id, until from (select product, lower(coalesce(email, '')) as email, order_id, "
    "active_until as until, row_number() over (partition by product, lower(coalesce(email, '')) order by "
    "src desc, seq desc) as rn from (select *, case when seq % 2 = 0 then 1 else 0 end as src from entitlements)"
    f" e where active_until is not null and active_until > timestamp '{NOW}') x where rn = 1", "entitlements"))
def q_latest_entitlement(spark, sf):
    e = entitlements(Tables(spark, sf))
    return R.latest_entitlement(e.where(F.col("seq") % 2 == 1), e.where(F.col("seq") % 2 == 0), NOW)


@query("paid_not_released", bench=True, oracle=_oracle(_PNR))
def q_paid_not_released(spark, sf):
    t = Tables(spark, sf)
    return R.paid_not_released(_orders(t), releases(t), _active(t), prefixes(spark), _base(t))


@query("refunded_still_active", oracle=_oracle(_RSA))
def q_refunded_still_active(spark, sf):
    t = Tables(spark, sf)
    return R.refunded_still_active(_orders(t), _active(t), prefixes(spark), _base(t))


@query("unregistered_product", oracle=_oracle(_UNR))
def q_unregistered_product(spark, sf):
    t = Tables(spark, sf)
    return R.unregistered_product(_orders(t), prefixes(spark))


@query("released_without_payment", oracle=_oracle(_RWP))
def q_released_without_payment(spark, sf):
    t = Tables(spark, sf)
    return R.released_without_payment(_active(t), _ids(t))


@query("reconcile", bench=True, oracle=_oracle(f"{_PNR} union all {_RSA} union all {_UNR} union all {_RWP}"))
def q_reconcile(spark, sf):
    t = Tables(spark, sf)
    return R.reconcile(_orders(t), releases(t), _active(t), prefixes(spark), _ids(t), base_products=_base(t))


@query("union_accounts", oracle=(
    "select 'one' as account, 'order' as kind, o_orderkey, o_orderstatus from orders where o_orderkey % 2 = 0 "
    "union all select 'two', 'order', o_orderkey, o_orderstatus from orders where o_orderkey % 2 = 1 "
    "union all select 'two', 'subscription', o_orderkey, null from orders where o_orderkey % 10 = 3"))
def q_union_accounts(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus")
    orders = R.union_accounts({"one": o.where(F.col("o_orderkey") % 2 == 0),
                               "two": o.where(F.col("o_orderkey") % 2 == 1)}, kind="order")
    subs = R.union_accounts({"two": o.where(F.col("o_orderkey") % 10 == 3).select("o_orderkey")},
                            kind="subscription")
    return orders.unionByName(subs, allowMissingColumns=True).select("account", "kind", "o_orderkey",
                                                                     "o_orderstatus")


_KNOWN_IDS_SRC = ("select cast(l_orderkey as varchar) as id, case when l_linenumber % 2 = 0 then "
                  "'{\"id\": \"s' || cast(l_suppkey as varchar) || '\"}' end as subscription, "
                  "case when l_linenumber = 1 then cast(l_partkey as varchar) end as parent_order, "
                  "[cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar), "
                  "'{\"id\": \"n' || cast(l_linenumber as varchar) || '\"}'] as orders from lineitem")


@query("known_ids", oracle=(
    f"with src as ({_KNOWN_IDS_SRC}), vals as (select id as v from src union all select subscription from src "
    "union all select parent_order from src union all select unnest(orders) from src), ids as (select case when "
    "trim(v) like '{%' then json_extract_string(v, '$.id') else v end as order_id from vals) "
    "select distinct order_id from ids where order_id is not null and order_id <> ''"))
def q_known_ids(spark, sf):
    li = Tables(spark, sf).lineitem
    src = li.select(
        F.col("l_orderkey").cast("string").alias("id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('{"id": "s'), F.col("l_suppkey").cast("string"),
                                                        F.lit('"}'))).alias("subscription"),
        F.when(F.col("l_linenumber") == 1, F.col("l_partkey").cast("string")).alias("parent_order"),
        F.array(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")),
                F.concat(F.lit('{"id": "n'), F.col("l_linenumber").cast("string"), F.lit('"}'))).alias("orders"))
    return R.known_ids(src, ["id", "subscription", "parent_order"], array_field="orders")

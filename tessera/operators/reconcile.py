"""Daily reconciliation of provider orders against what each product granted.

Four divergence kinds, each a join query, put together with ``unionByName``:

* paid_not_released — paid order whose id is not among the product's release events and whose
  (product, email) has no active entitlement (two anti joins);
* refunded_still_active — returned order whose (product, email) is active with this very order id (inner join);
* unregistered_product — order whose product name matches no prefix (ignored for some accounts);
* released_without_payment — active entitlement whose order id the provider does not know in any account
  (test ids with prefix 'qa-' and entitlements without an order id are ignored).

No state is gathered on the driver: ids, entitlements and events stay DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import status_class_expr
from tessera.functions.scalar import event_root_id, strip_accents
from tessera.operators.joins import compiled_rules
from tessera.operators.layout import spread

# Divergence kinds, ignored test-order prefix.
PAID_NOT_RELEASED = "paid_not_released"
REFUNDED_STILL_ACTIVE = "refunded_still_active"
UNREGISTERED_PRODUCT = "unregistered_product"
RELEASED_WITHOUT_PAYMENT = "released_without_payment"
TEST_ORDER_PREFIX = "qa-"

OUT_COLS = ["kind", "account", "order_id", "product", "email"]


def prefix_lookup(df: DataFrame, name_col: str, prefixes_df: DataFrame, out: str = "target") -> DataFrame:
    """Add ``out``: target of the first prefix (lowest rank) that the accent-free lower-case name starts with;
    null when none matches.

    A small rule list (bounded read) is folded by the same Spark expression as the names and compiled into one
    ``CASE WHEN startswith(...)`` in rank order: a projection, no join and no shuffle of ``df``. A longer list is
    joined: each distinct name is taken at every length that a prefix has, and the best-ranked match wins."""
    folded = prefixes_df.select("rank", strip_accents("prefix").alias("prefix"), "target")
    rules = compiled_rules(folded.orderBy("rank", "prefix"))
    norm = F.col("_norm")
    named = df.withColumn("_norm", strip_accents(F.col(name_col)))
    if rules is None:
        cuts = named.select("_norm").where(norm.isNotNull()).distinct().select("_norm", F.explode(F.transform(
            F.sequence(F.lit(0), F.length(norm)), lambda n: F.substring(norm, F.lit(1), n))).alias("prefix"))
        best = (cuts.join(folded, on="prefix").groupBy("_norm")
                .agg(F.min_by("target", F.struct("rank", "prefix")).alias(out)))
        return named.join(best, on="_norm", how="left").select(*df.columns, out)
    expr = F.lit(None).cast("string")
    for r in reversed(rules):
        expr = F.when(F.startswith(norm, F.lit(r["prefix"])), F.lit(r["target"])).otherwise(expr)
    return named.withColumn(out, expr).drop("_norm")


def release_roots(releases: DataFrame, product: str = "product", event_id: str = "event_id") -> DataFrame:
    """(product, order id) from release event ids 'order:event'."""
    return releases.select(F.col(product).alias("product"), event_root_id(event_id).alias("order_id")).distinct()


def latest_entitlement(users_df: DataFrame, subs_df: DataFrame | None, now: str,
                       until: str = "active_until", seq: str = "seq") -> DataFrame:
    """Active entitlement per (product, lower-case email): only rows with ``until`` later than ``now`` count;
    subscriptions override users; within a source the highest ``seq`` wins. Aggregate with ``max_by``
    (combined map-side)."""
    now_c = F.lit(now).cast("timestamp_ntz")
    parts = [users_df.select("product", "email", "order_id", until, seq).withColumn("_src", F.lit(0))]
    if subs_df is not None:
        parts.append(subs_df.select("product", "email", "order_id", until, seq).withColumn("_src", F.lit(1)))
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    live = u.where(F.col(until).isNotNull() & (F.col(until).cast("timestamp_ntz") > now_c))
    picked = (live.groupBy("product", F.lower(F.coalesce(F.col("email"), F.lit(""))).alias("email"))
              .agg(F.max_by(F.struct(F.col("order_id"), F.col(until)), F.struct(F.col("_src"), F.col(seq)))
                   .alias("_r")))
    return picked.select("product", "email", F.col("_r.order_id").alias("order_id"),
                         F.col(f"_r.{until}").alias("until"))


def known_ids(orders_df: DataFrame, fields: list[str], array_field: str | None = None) -> DataFrame:
    """Distinct ids the provider knows: each listed field may hold a scalar or a JSON object with an ``id``;
    ``array_field`` holds an array of such values."""
    def idval(c):
        s = F.col(c).cast("string") if isinstance(c, str) else c
        return F.when(F.trim(s).startswith("{"), F.get_json_object(s, "$.id")).otherwise(s)
    arr = F.array(*[idval(c) for c in fields])
    if array_field:
        arr = F.concat(arr, F.transform(F.coalesce(F.col(array_field), F.array().cast("array<string>")), idval))
    src = spread(orders_df.select(*fields, *([array_field] if array_field else [])))
    ids = src.select(F.explode(F.array_compact(arr)).alias("order_id"))
    return ids.where(F.col("order_id") != "").distinct()


def _orders_with_target(orders: DataFrame, prefixes_df: DataFrame) -> DataFrame:
    """Orders that count (not subscriptions, product is an object) with status class and target product.
    Already classified input (from ``reconcile``) passes through, so the rules are compiled once."""
    if {"target", "status_class"} <= set(orders.columns):
        return orders
    o = orders.where((F.col("kind") != "subscription") & F.col("product_is_object"))
    o = o.select("account", F.col("order_id").cast("string").alias("order_id"),
                 F.lower(F.coalesce(F.col("email"), F.lit(""))).alias("email"),
                 status_class_expr(F.col("status")).alias("status_class"),
                 F.coalesce(F.col("product_name"), F.lit("")).alias("product_name"))
    return prefix_lookup(o, "product_name", prefixes_df)


def unregistered_product(orders: DataFrame, prefixes_df: DataFrame, ignored_accounts=("two",)) -> DataFrame:
    o = _orders_with_target(orders, prefixes_df)
    return (o.where(F.col("target").isNull() & ~F.col("account").isin(list(ignored_accounts)))
            .select(F.lit(UNREGISTERED_PRODUCT).alias("kind"), "account", "order_id",
                    F.col("product_name").alias("product"), "email"))


def _order_flags(orders: DataFrame, prefixes_df: DataFrame, base_products: DataFrame,
                 releases: DataFrame | None = None, active: DataFrame | None = None) -> DataFrame:
    """Each classified order once, with flags: ``registered`` (its target is among ``base_products``), ``released`` (its
    id is among the target's release events) and ``held`` (order ids of the active entitlements of target and email).

    Only products that a rule can yield matter, so the base list has at most as many rows as there are rule targets:
    with a compiled rule list that is a proven bound, and the list is broadcast however large its input is."""
    o = _orders_with_target(orders, prefixes_df)
    rules = compiled_rules(prefixes_df.select("target").distinct())
    base = base_products.select(F.col("product").alias("target"))
    if rules is not None:
        base = F.broadcast(base.where(F.col("target").isin([r["target"] for r in rules])).distinct())
    else:
        base = base.distinct()
    o = o.join(base.withColumn("registered", F.lit(True)), on="target", how="left")
    if releases is not None:
        roots = release_roots(releases).withColumnRenamed("product", "target").withColumn("released", F.lit(True))
        o = o.join(roots, on=["target", "order_id"], how="left")
    if active is not None:
        held = active.groupBy(F.col("product").alias("target"), "email").agg(
            F.collect_set(F.coalesce("order_id", F.lit(""))).alias("held"))
        o = o.join(held, on=["target", "email"], how="left")
    return o


def _is(name: str, status: str):
    return F.coalesce(F.col(name), F.lit(False)) & (F.col("status_class") == status)


def _paid_not_released():
    return _is("registered", "paid") & F.col("released").isNull() & F.col("held").isNull()


def _refunded_still_active():
    return _is("registered", "returned") & F.coalesce(F.array_contains("held", F.col("order_id")), F.lit(False))


def _rows(o: DataFrame, kind: str, product) -> DataFrame:
    return o.select(F.lit(kind).alias("kind"), "account", "order_id", product.alias("product"), "email")


def paid_not_released(orders: DataFrame, releases: DataFrame, active: DataFrame, prefixes_df: DataFrame,
                      base_products: DataFrame) -> DataFrame:
    o = _order_flags(orders, prefixes_df, base_products, releases, active).where(_paid_not_released())
    return _rows(o, PAID_NOT_RELEASED, F.col("target"))


def refunded_still_active(orders: DataFrame, active: DataFrame, prefixes_df: DataFrame,
                          base_products: DataFrame) -> DataFrame:
    o = _order_flags(orders, prefixes_df, base_products, active=active).where(_refunded_still_active())
    return _rows(o, REFUNDED_STILL_ACTIVE, F.col("target"))


def released_without_payment(active: DataFrame, ids: DataFrame, ignore_prefix: str = TEST_ORDER_PREFIX) -> DataFrame:
    a = active.where(F.col("order_id").isNotNull() & (F.col("order_id") != "")
                     & ~F.col("order_id").startswith(ignore_prefix))
    return (a.join(ids.select("order_id"), on="order_id", how="left_anti")
            .select(F.lit(RELEASED_WITHOUT_PAYMENT).alias("kind"), F.lit(None).cast("string").alias("account"),
                    "order_id", "product", "email"))


def reconcile(orders: DataFrame, releases: DataFrame, active: DataFrame, prefixes_df: DataFrame,
              ids: DataFrame, base_products: DataFrame | None = None, ignored_accounts=("two",)) -> DataFrame:
    """All four divergence kinds in one result (kind, account, order_id, product, email). Products without an
    entitlement base (not in ``base_products``; default: products with releases or entitlements) are skipped."""
    if base_products is None:
        base_products = releases.select("product").unionByName(active.select("product")).distinct()
    # every order is classified and joined once; the kinds follow from its flags
    o = _order_flags(orders, prefixes_df, base_products, releases, active)
    unregistered = F.col("target").isNull() & ~F.col("account").isin(list(ignored_accounts))

    def kind(when, name, product):
        return F.when(when, F.struct(F.lit(name).alias("kind"), F.col(product).alias("product")))
    kinds = F.array_compact(F.array(kind(_paid_not_released(), PAID_NOT_RELEASED, "target"),
                                    kind(_refunded_still_active(), REFUNDED_STILL_ACTIVE, "target"),
                                    kind(unregistered, UNREGISTERED_PRODUCT, "product_name")))
    found = o.select("account", "order_id", "email", F.inline(kinds))
    return found.select(*OUT_COLS).unionByName(released_without_payment(active, ids).select(*OUT_COLS))


def union_accounts(frames: dict[str, DataFrame], kind: str | None = None) -> DataFrame:
    """Orders of all accounts in one frame, tagged with the account (and a kind, e.g. 'subscription');
    columns missing in some account are filled with nulls."""
    out = None
    for account, df in frames.items():
        t = df.withColumn("account", F.lit(account))
        if kind is not None and "kind" not in df.columns:
            t = t.withColumn("kind", F.lit(kind))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out

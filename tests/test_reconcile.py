"""Golden reconciliation case: two accounts, three products with an entitlement base, every divergence kind once;
a correct order, the second account's unknown product and a courtesy entitlement give nothing."""

from pyspark.sql import functions as F

from tessera.operators import reconcile as R

NOW = "2030-01-01 00:00:00"
PREFIXES = [(1, "garden pro", "garden"), (2, "garden", "garden"), (3, "bakery", "bakery"), (4, "studio", "studio")]


def _prefixes(spark):
    return spark.createDataFrame(PREFIXES, "rank int, prefix string, target string")


def test_prefix_lookup_first_match_wins(spark):
    names = spark.createDataFrame([("Gárden Pró - Monthly",), ("GARDEN lite",), ("Bakéry Start",), ("Unknown",),
                                   ("studio",)], "name string")
    got = {r["name"]: r["target"] for r in R.prefix_lookup(names, "name", _prefixes(spark)).collect()}
    assert got == {"Gárden Pró - Monthly": "garden", "GARDEN lite": "garden", "Bakéry Start": "bakery",
                   "Unknown": None, "studio": "studio"}


def _case(spark):
    orders = spark.createDataFrame([
        ("north", "o1", "paid", "Garden Pro - Monthly", "ok@x.com"),        # correct
        ("north", "o2", "paid", "Bakery Start", "missing@x.com"),           # paid, not released
        ("north", "o3", "refunded", "Garden Start", "back@x.com"),          # refunded, still active
        ("north", "o4", "paid", "Strange Product", "z@x.com"),              # no registered product
        ("south", "o5", "paid", "Studio Cut - Monthly", "s@x.com"),         # correct
        ("south", "o6", "paid", "CLOSED VIP GROUP", "a@x.com"),             # other account's product: ignored
    ], "account string, order_id string, status string, product_name string, email string") \
        .withColumn("kind", F.lit("order")).withColumn("product_is_object", F.lit(True))
    releases = spark.createDataFrame([("garden", "o1:paid"), ("garden", "o3:paid"), ("garden", "o9:paid"),
                                      ("studio", "o5:paid")], "product string, event_id string")
    ent = spark.createDataFrame([
        ("garden", "ok@x.com", "o1", "2031-01-01 00:00:00", 1),
        ("garden", "back@x.com", "o3", "2031-01-01 00:00:00", 2),
        ("garden", "free@x.com", "o9", "2031-01-01 00:00:00", 3),          # released without payment
        ("studio", "s@x.com", "o5", "2031-01-01 00:00:00", 4),
        ("garden", "old@x.com", "o7", "2020-01-01 00:00:00", 5),           # expired: not active
    ], "product string, email string, order_id string, active_until string, seq int") \
        .withColumn("active_until", F.col("active_until").cast("timestamp_ntz"))
    base = spark.createDataFrame([("garden",), ("bakery",), ("studio",)], "product string")
    return orders, releases, ent, base


def test_golden_divergences(spark):
    orders, releases, ent, base = _case(spark)
    active = R.latest_entitlement(ent, None, NOW)
    ids = R.known_ids(orders, ["order_id"])
    out = R.reconcile(orders, releases, active, _prefixes(spark), ids, base_products=base,
                      ignored_accounts=("south",))
    got = sorted((r["kind"], r["order_id"]) for r in out.collect())
    assert got == [("paid_not_released", "o2"), ("refunded_still_active", "o3"),
                   ("released_without_payment", "o9"), ("unregistered_product", "o4")]


def test_courtesy_entitlement_is_not_a_divergence(spark):
    orders, releases, _, base = _case(spark)
    ent = spark.createDataFrame([("garden", "gift@x.com", None, "2031-01-01 00:00:00", 1)],
                                "product string, email string, order_id string, active_until string, seq int") \
        .withColumn("active_until", F.col("active_until").cast("timestamp_ntz"))
    active = R.latest_entitlement(ent, None, NOW)
    empty = orders.limit(0)
    out = R.reconcile(empty, releases.limit(0), active, _prefixes(spark), R.known_ids(empty, ["order_id"]),
                      base_products=base)
    assert out.count() == 0


def test_subscriptions_override_users(spark):
    users = spark.createDataFrame([("garden", "A@x.com", "u1", "2031-01-01 00:00:00", 9)],
                                  "product string, email string, order_id string, active_until string, seq int")
    subs = spark.createDataFrame([("garden", "a@x.com", "s1", "2031-01-01 00:00:00", 1)],
                                 "product string, email string, order_id string, active_until string, seq int")
    a = R.latest_entitlement(users, subs, NOW).collect()
    assert [(r["email"], r["order_id"]) for r in a] == [("a@x.com", "s1")]


def test_known_ids_scalar_object_and_array(spark):
    df = spark.createDataFrame([("1", '{"id": "s2"}', None, ["o3", '{"id": "o4"}'])],
                               "id string, subscription string, parent_order string, orders array<string>")
    got = sorted(r["order_id"] for r in R.known_ids(df, ["id", "subscription", "parent_order"], "orders").collect())
    assert got == ["1", "o3", "o4", "s2"]

"""Stand-in inputs built from the driver's tables: the shapes the platform's own data has (notices, indicators,
payments, entitlements, releases, samples, ledger, votes, offers, snapshots), derived by Spark from the test
tables so the work grows with them.

``STANDIN_SQL`` holds the same derivations as SQL text for the DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Lazy parquet readers for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"


def _geo(t: Tables) -> DataFrame:
    """customer ⨝ nation ⨝ region; nation and region are fixed-size dimensions (25 and 5 rows), broadcast."""
    from tessera.operators.joins import broadcast_checked
    return (t.customer.join(broadcast_checked(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(broadcast_checked(t.region), F.col("n_regionkey") == F.col("r_regionkey")))


def notices(t: Tables) -> DataFrame:
    o = t.orders
    return (o.join(_geo(t), o.o_custkey == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("notice_id"), F.col("o_orderdate").alias("published_at"),
                    F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("modality"),
                    F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
                    F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("category"),
                    F.col("c_name").alias("organization"), F.col("n_name").alias("uf"),
                    F.col("r_name").alias("region"), F.year("o_orderdate").alias("purchase_year"),
                    F.col("o_totalprice").cast("decimal(18,2)").alias("estimated_value")))


def indicators(t: Tables) -> DataFrame:
    o = t.orders
    return (o.join(_geo(t), o.o_custkey == F.col("c_custkey"))
            .select(F.col("o_custkey").alias("municipality"), F.year("o_orderdate").alias("yr"),
                    F.nullif(F.month("o_orderdate"), F.lit(1)).alias("period"),
                    F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("amount"),
                    F.when(F.col("o_orderstatus") == "P", "State").otherwise("Municipal").alias("sphere"),
                    F.col("n_name").alias("uf"), F.col("r_name").alias("region")))


def _product_of_key(k):
    return F.when(k % 5 == 0, "coffee").when(k % 5 == 1, "action").otherwise("remote")


def payments(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        F.concat(F.lit("p"), k.cast("string")).alias("order_id"),
        F.when(k % 2 == 0, "one").otherwise("two").alias("account"),
        F.when(F.col("o_orderstatus") == "F", "Paid").when(F.col("o_orderstatus") == "P", "refunded")
        .otherwise("waiting").alias("status"),
        F.when(k % 5 == 0, "Café Pro - Monthly").when(k % 5 == 1, "AÇÃO Start").when(k % 5 == 2, "cafe remote")
        .when(k % 5 == 3, "Unlisted").alias("product_name"),
        F.concat(F.lit("U"), F.col("o_custkey").cast("string"), F.lit("@x.com")).alias("email"))


def entitlements(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.where(k % 3 != 0).select(
        _product_of_key(k).alias("product"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@X.com")).alias("email"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
        .when(k % 13 == 0, F.concat(F.lit("qa-"), k.cast("string")))
        .when(k % 7 == 0, F.concat(F.lit("z"), k.cast("string")))
        .otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("order_id"),
        F.col("o_orderdate").alias("active_until"), k.alias("seq"))


def releases(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.where(k % 4 != 0).select(
        _product_of_key(k).alias("product"),
        F.concat(F.lit("p"), k.cast("string"), F.lit(":paid")).alias("event_id"))


def samples(t: Tables) -> DataFrame:
    """Running counter per series (a few series, so each is a hot key): a skew-safe prefix sum, not a window
    per series."""
    from tessera.operators.ranking import running_sum
    ev = t.events.select(F.col("event_type").alias("series"), "ts", "event_id",
                         F.floor("value").cast("bigint").alias("_inc"))
    return running_sum(ev, ["series"], ["ts", "event_id"], "_inc", "counter").drop("_inc")


def ledger(t: Tables) -> DataFrame:
    return t.events.select(
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", "published").when(F.col("event_type") == "error", "failed")
        .otherwise("running").alias("status"))


def vote_events(t: Tables) -> DataFrame:
    return t.events.select(
        F.concat(F.lit("a"), (F.col("event_id") % 7).cast("string")).alias("slug"), F.col("user_id").alias("voter"),
        F.when(F.col("event_type").isin("click", "view"), 1).when(F.col("event_type") == "error", -1)
        .otherwise(0).alias("vote"), "ts", F.col("event_id").alias("seq"))


def offers(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("offer_id"), (F.col("p_partkey") % 397).alias("machine_id"),
        F.col("p_brand").alias("model"), F.col("p_size").alias("disk"),
        (F.col("p_retailprice") / 1000).alias("base_cost"),
        (F.nullif(F.col("p_size"), F.lit(7)) / F.lit(100.0)).alias("storage_cost"))


def snapshots(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("taken_at"))


# Prefix list of the reconciliation test shape (rank, prefix, target).
PREFIXES = [(1, "cafe remote", "remote"), (2, "cafe", "coffee"), (3, "acao", "action")]
# The "now" used for entitlements in the test shape.
ENTITLEMENT_NOW = "2001-01-01 00:00:00"


def prefixes(spark: SparkSession) -> DataFrame:
    from tessera.sources.tables import literal_frame
    return literal_frame(spark, PREFIXES, "rank int, prefix string, target string")


STANDIN_SQL = {
    "notices": "select o_orderkey notice_id, o_orderdate published_at, nullif(o_orderpriority,'4-NOT SPECIFIED') "
               "modality, nullif(o_orderstatus,'P') status, nullif(c_mktsegment,'MACHINERY') category, c_name "
               "organization, n_name uf, r_name region, year(o_orderdate) purchase_year, cast(o_totalprice as "
               "decimal(18,2)) estimated_value from orders join customer on o_custkey=c_custkey join nation on "
               "c_nationkey=n_nationkey join region on n_regionkey=r_regionkey",
    "indicators": "select o_custkey municipality, year(o_orderdate) as yr, nullif(month(o_orderdate),1) period, "
                  "o_orderkey row_id, o_totalprice amount, case when o_orderstatus='P' then 'State' else "
                  "'Municipal' end sphere, n_name uf, r_name region from orders join customer on o_custkey=c_custkey "
                  "join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey",
    "payments": "select concat('p',cast(o_orderkey as string)) order_id, case when o_orderkey%2=0 then 'one' else "
                "'two' end account, case o_orderstatus when 'F' then 'Paid' when 'P' then 'refunded' else 'waiting' "
                "end status, case o_orderkey%5 when 0 then 'Café Pro - Monthly' when 1 then 'AÇÃO Start' when 2 then "
                "'cafe remote' when 3 then 'Unlisted' else null end product_name, concat('U',cast(o_custkey as "
                "string),'@x.com') email from orders",
    "entitlements": "select case o_orderkey%5 when 0 then 'coffee' when 1 then 'action' else 'remote' end product, "
                    "concat('u',cast(o_custkey as string),'@X.com') email, case when o_orderkey%11=0 then null when "
                    "o_orderkey%13=0 then concat('qa-',cast(o_orderkey as string)) when o_orderkey%7=0 then "
                    "concat('z',cast(o_orderkey as string)) else concat('p',cast(o_orderkey as string)) end "
                    "order_id, o_orderdate active_until, o_orderkey seq from orders where o_orderkey%3<>0",
    "releases": "select case o_orderkey%5 when 0 then 'coffee' when 1 then 'action' else 'remote' end product, "
                "concat('p',cast(o_orderkey as string),':paid') event_id from orders where o_orderkey%4<>0",
    "samples": "select event_type series, ts, event_id, sum(cast(floor(value) as bigint)) over (partition by "
               "event_type order by ts,event_id) counter from events",
    "ledger": "select concat('k',cast(user_id as string)) key, event_id as seq, case event_type when 'purchase' "
              "then 'published' when 'error' then 'failed' else 'running' end as status from events",
    "vote_events": "select concat('a',cast(event_id%7 as string)) slug, user_id voter, case event_type when "
                   "'click' then 1 when 'view' then 1 when 'error' then -1 else 0 end vote, ts, event_id seq from "
                   "events",
    "offers": "select p_partkey offer_id, p_partkey%397 machine_id, p_brand model, p_size disk, p_retailprice/1000 "
              "base_cost, nullif(p_size,7)/cast(100 as double) storage_cost from part",
    "snapshots": "select o_orderkey snapshot_id, o_orderdate taken_at from orders",
    "prefixes": "select * from (values (1, 'cafe remote', 'remote'), (2, 'cafe', 'coffee'), (3, 'acao', 'action'))"
                " p(rank, prefix, target)",
}


def with_standins(sql: str, *names: str) -> str:
    """Prefix an oracle query with the stand-in views it reads, as CTEs."""
    if not names:
        return sql
    ctes = ", ".join(f"{n} as ({STANDIN_SQL[n]})" for n in names)
    if sql.lstrip().lower().startswith("with "):
        return f"with {ctes}, {sql.lstrip()[5:]}"
    return f"with {ctes} {sql}"

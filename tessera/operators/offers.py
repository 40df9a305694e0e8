"""Cheapest eligible offer: filters given as data, two exclusion anti joins, derived price, then one top-1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.predicates import price_expr, spec_condition
from tessera.operators.joins import anti_excluded

# The price must beat the current ceiling by this much; live candidates at most; candidates in test at
# most while an emergency lifts the ceiling.
PRICE_MARGIN = 0.01
MAX_CANDIDATES = 2
EMERGENCY_TESTS = 2


def cheapest_offer(offers: DataFrame, blacklist: DataFrame, owned: DataFrame, spec: dict, current: float,
                   candidates: DataFrame | None = None, margin: float = PRICE_MARGIN,
                   machine: str = "machine_id", base: str = "base_cost", storage: str = "storage_cost",
                   offer_id: str = "offer_id", live: DataFrame | None = None, in_test: DataFrame | None = None,
                   emergency: bool = False) -> DataFrame:
    """The cheapest eligible offer (price, then id) with the ceiling min(current, candidate prices) − margin and
    whether it is accepted. Eligible: matches the spec, machine not blacklisted, not ours. Accepted: the price is
    within the ceiling and fewer than ``MAX_CANDIDATES`` rows are in ``live``; in an emergency the cheapest is accepted
    whatever its price while fewer than ``EMERGENCY_TESTS`` rows are ``in_test``.
    The top-1 is TakeOrderedAndProject (each partition keeps its best row); ceiling and counts are scalar subqueries."""
    o = anti_excluded(offers.where(spec_condition(spec)), blacklist, owned, machine, machine)
    best = o.select(F.col(offer_id).alias("offer_id"), price_expr(base, storage).alias("price")) \
        .orderBy("price", "offer_id").limit(1)
    cap = F.lit(float(current))
    if candidates is not None:
        cap = F.least(cap, F.coalesce(candidates.agg(F.min("price")).scalar(), cap))

    def fewer(df: DataFrame | None, most: int):
        return F.lit(True) if df is None else df.agg(F.count(F.lit(1)) < most).scalar()
    within = (F.col("price") <= F.col("ceiling")) & fewer(live, MAX_CANDIDATES)
    urgent = fewer(in_test, EMERGENCY_TESTS) if emergency else F.lit(False)
    return (best.select("offer_id", "price", (cap - F.lit(margin)).alias("ceiling"))
            .withColumn("accept", within | urgent))

"""Results that must not depend on the order of rows or on how a database rounds."""

import math

from pyspark.sql import functions as F

from motorlens.operators import dealers, money
from motorlens.plans import registry
from motorlens.plans.dialect import SPARK
from motorlens.plans.domain import view


def test_percent_is_exact_at_halves(spark):
    # Two means of 94.975 and 94.985 %: added up as doubles they come out a little more or less, by the order of the rows.
    shares = [(1, 0.95)] * 585 + [(1, 0.94)] * 15 + [(2, 0.95)] * 197 + [(2, 0.94)] * 3 + [(3, None)]
    for rows in (shares, shares[::-1], sorted(shares, key=lambda r: (r[0], -(r[1] or 0)))):
        spark.createDataFrame(rows, "k int, x double").createOrReplaceTempView("shares_of_test")
        got = spark.sql(f"SELECT k, {SPARK.percent('x')} AS p FROM shares_of_test GROUP BY k").collect()
        assert {r["k"]: r["p"] for r in got} == {1: 94.98, 2: 94.99, 3: None}


def test_health_rounds_as_its_sql_does(spark):
    listings = spark.createDataFrame([(x,) for x in (3205.945, 1.005, -2.675, 0.125, -0.125)], "x double")
    # 3205.945 is stored a little below, but 100 times it is 320594.49999999994; 1.005 * 100 is 100.49999999999999; 2.675 * 100 is 267.5.
    assert [r[0] for r in listings.select(dealers.rounded(F.col("x"))).collect()] == [round_as_c(x) for x in (3205.945, 1.005, -2.675, 0.125, -0.125)]


def round_as_c(x: float) -> float:
    y = abs(x) * 100.0
    whole = math.floor(y) + (1 if y - math.floor(y) >= 0.5 else 0)
    return math.copysign(whole / 100.0, x)


def test_alerts_look_at_all_entries(spark, data):
    """A vehicle whose entries all lie before the last year is looked at like any other."""
    ledger, fx = view(spark, data, "ledger"), view(spark, data, "fx")
    old = ledger.groupBy("tenant_vehicle").agg(F.max("day").alias("last")).where("last < DATE'2000-01-01'").select("tenant_vehicle")
    want = money.alerts(money.vehicle_pnl(money.in_euro(ledger.join(old, "tenant_vehicle"), fx))).count()
    got = registry.QUERIES["sco10_alerts"](spark, data).join(old, "tenant_vehicle").count()
    assert got == want > 0


def test_days_on_the_market_are_rounded_once(spark):
    """The mean of 257 ages is 2795.48499988 % above that of four: not half a hundredth, as it is when cut to six digits first."""
    ages = [42, 42, 42, 43] + [1242] * 252 + [1246]
    listings = spark.createDataFrame([(a,) for a in ages], "age int").selectExpr(
        "1L AS dealer_id", "'DE' AS country_code", "'BMW' AS make", "'ACTIVE' AS status", "100.0D AS price_gross_eur", "0.9D AS confidence_score", f"{SPARK.now} - make_dt_interval(age) AS indexed_at", f"{SPARK.now} AS ttl_expires_at"
    )
    got = dealers.health(listings).first()
    assert sum(ages) == 314399 and len(ages) == got["active_count"] == 257
    assert got["tom_delta"] == round_as_c(100 * (314399 / 257 - 42.25) / 42.25) == 2795.48


def test_health_does_not_depend_on_the_order_of_rows(spark):
    """Confidences of few listings, whose sums as doubles differ by their order; one is not a number, another too large for a decimal."""
    shares = {1: (0.91, 0.97, 0.93, 0.99, 0.92, 0.95, 0.9), 2: (0.9, float("nan"), 0.95), 3: (0.9, 1e300, 0.95)}
    assert sum(shares[1]) != sum(shares[1][::-1])
    rows = [(d, x, 1 + 2 * i % 14) for d, own in shares.items() for i, x in enumerate(own)] + [(d, 0.5, 20) for d in shares]
    got = []
    for own in (rows, rows[::-1], rows[3:] + rows[:3]):
        listings = spark.createDataFrame(own, "dealer_id long, confidence_score double, age int").coalesce(1).selectExpr(
            "dealer_id", "'DE' AS country_code", "'BMW' AS make", "'ACTIVE' AS status", "100.0D AS price_gross_eur", "confidence_score", f"{SPARK.now} - make_dt_interval(age) AS indexed_at", f"{SPARK.now} AS ttl_expires_at"
        )
        got.append({r["dealer_id"]: r["composite_delta"] for r in dealers.health_signals(listings).collect()})
    assert {g[1] for g in got} == {(math.fsum(shares[1]) / 7 - 0.5) * 100}
    assert all(math.isnan(g[2]) and g[3] > 1e300 for g in got)

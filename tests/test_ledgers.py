"""Months of ledgers, the year that alerts look at, the end of trust profiles: by plain loops and hand-made rows."""

import datetime
import random

from motorlens.operators import dealers, money

LEDGER = "tenant_vehicle long, type string, amount_cents long, currency string, day date, eur_cents long"


def test_months_equal_a_loop(spark):
    random.seed(5)
    rows = [(1, random.choice(["purchase", "transport", "sale"]), 0, "EUR", datetime.date(random.choice([1999, 2000]), random.choice([1, 2, 3, 7, 12]), 3), random.randint(-50, 500)) for _ in range(60)]
    got = [r.asDict() for r in money.monthly_pnl(spark.createDataFrame(rows + [(1, "sale", 0, "EUR", None, 9)], LEDGER)).orderBy("mth").collect()]
    at = [r[4].year * 12 + r[4].month - 1 for r in rows]
    assert [g["mth"] for g in got] == list(range(min(at), max(at) + 1))
    sums = {m: [sum(r[5] for r, x in zip(rows, at) if x == m and (r[1] == "sale") == sale) for sale in (False, True)] for m in range(min(at) - 1, max(at) + 1)}
    for g in got:
        (cost, rev), (pc, pr) = sums[g["mth"]], sums[g["mth"] - 1]
        assert (g["cost_cents"], g["revenue_cents"], g["prev_cost_cents"], g["prev_revenue_cents"], g["prev_margin_cents"]) == (cost, rev, pc, pr, pr - pc)
        assert abs(g["margin_pct"] - (100 * (rev - cost) / rev if rev > 0 else 0)) < 1e-3
        assert abs(g["rev_growth_pct"] - (100 * (rev - pr) / pr if pr > 0 else 0)) < 1e-3
        assert abs(g["margin_growth_pct"] - (100 * (rev - cost - pr + pc) / abs(pr - pc) if pr != pc else 0)) < 1e-3
    assert money.monthly_pnl(spark.createDataFrame([], LEDGER)).count() == 0


def test_return_and_look_back(spark):
    day = datetime.date
    rows = [(1, "purchase", 800, "EUR", day(2001, 1, 1)), (1, "sale", 1000, "EUR", day(2001, 2, 1)), (2, "sale", 70, "EUR", day(2001, 2, 1)), (3, "purchase", 10, "EUR", day(2000, 9, 29)), (4, "purchase", 10, "EUR", day(2000, 9, 30)), (5, "purchase", 10, "EUR", day(2001, 10, 1))]
    ledger = spark.createDataFrame(rows, "tenant_vehicle long, type string, amount_cents long, currency string, day date")
    fx = spark.createDataFrame([], "from_currency string, valid_from date, rate double")
    got = {r["tenant_vehicle"]: (r["margin_pct"], r["roi_pct"]) for r in money.vehicle_pnl(money.in_euro(ledger, fx)).collect()}
    assert got[1] == (20.0, 25.0) and got[2] == (100.0, 0.0) and got[3] == (0.0, -100.0)
    assert {r["tenant_vehicle"] for r in money.trailing_year(ledger).collect()} == {1, 2, 4}
    assert [tuple(r) for r in money.alerts(money.vehicle_pnl(money.in_euro(money.trailing_year(ledger), fx))).collect()] == [(4, "stock_too_long")]


def test_profiles_end_after_ninety_days(spark):
    base = "dealer_id long, vies_status string, registry string, registry_age int, v15 double, avg_score double, volume long, anomalies long, tenure_days int, issued_at date"
    rows = [(i, "valid", "registered", 9, 100.0, 100.0, 80, 0, 400, d) for i, d in enumerate([datetime.date(2001, 7, 1), datetime.date(2001, 7, 2), datetime.date(2001, 7, 3), None])]
    got = {r["dealer_id"]: (r["expires_at"], r["expired"]) for r in dealers.profiles(spark.createDataFrame(rows, base)).collect()}
    assert got == {0: ("2001-09-29", True), 1: ("2001-09-30", False), 2: ("2001-10-01", False), 3: (None, True)}

"""Market analytics: spreads, price series, indices, candles, depth, days on market, arbitrage (AGG, WIN)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.domain import VIEWS
from ..plans.registry import both, frame

_BAND = "CASE WHEN mileage_km < 30000 THEN '0-30k' WHEN mileage_km < 80000 THEN '30-80k' ELSE '80k+' END"


def mileage_band(km="mileage_km") -> F.Column:
    """Half-open bands 0-30, 30-80 and from 80 thousand km."""
    return F.when(F.col(km) < 30000, "0-30k").when(F.col(km) < 80000, "30-80k").otherwise("80k+")


def market_spread(listings: DataFrame, how: str = "avg") -> DataFrame:
    """Price of each cohort (make, model, year, band, fuel) by country in whole cents, its best and worst country and how
    far they are apart. ``how``: avg or median. Both levels aggregate partially before their shuffle."""
    live = listings.where("price_gross_eur > 0 and dealer_status = 'ACTIVE' and country_code is not null").withColumn("band", mileage_band())
    cohort = ["make", "model", "year", "band", "fuel_type"]
    middle = F.avg("price_gross_eur") if how == "avg" else F.percentile("price_gross_eur", F.lit(0.5))
    cents = F.round(middle * 100, 3).cast("long")
    by_country = live.groupBy(*cohort, "country_code").agg(F.count("*").alias("n"), cents.alias("cents"))
    # Ties go to the country that comes first.
    best = F.min_by("country_code", F.struct(-F.col("cents"), F.col("country_code")))
    worst = F.min_by("country_code", F.struct(F.col("cents"), F.col("country_code")))
    spread = F.when((F.count("*") > 0) & (F.max("cents") > 0), F.max("cents") - F.min("cents")).otherwise(0)
    return by_country.groupBy(*cohort).agg(F.sum("n").alias("samples"), best.alias("best_country"), worst.alias("worst_country"), spread.alias("spread_cents"), F.round(1 - F.exp(-F.sum("n") / 20.0), 6).alias("confidence"))


frame("agg05_market_spread", ["listing"], lambda d: f"""WITH c AS (SELECT make, model, year, {_BAND} AS band, fuel_type, country_code, count(*) AS n, CAST(trunc(round(avg(price_gross_eur) * 100, 3)) AS BIGINT) AS cents
  FROM listing WHERE price_gross_eur > 0 AND dealer_status = 'ACTIVE' GROUP BY ALL)
SELECT make, model, year, band, fuel_type, CAST(sum(n) AS BIGINT) AS samples, arg_min(country_code, (-cents, country_code)) AS best_country, arg_min(country_code, (cents, country_code)) AS worst_country, max(cents) - min(cents) AS spread_cents, round(1 - exp(-sum(n) / 20.0), 6) AS confidence FROM c GROUP BY ALL""")(market_spread)


def trimmed_means(listings: DataFrame, ranges: int = 4096) -> DataFrame:
    """Mean of the middle half of prices in each country (of rows in order of price, those after the first quarter and up to
    the third). Equal prices are one row with a count; these are put in order by ranges of price, so that no task sorts a
    country: counts of ranges are summed up first, then prices within their range."""
    counts = listings.where("price_gross_eur is not null").groupBy("country_code", F.col("price_gross_eur").alias("price")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("price").alias("low"), F.max("price").alias("high"))
    counts = counts.crossJoin(F.broadcast(ends)).withColumn("range", F.when(F.col("high") > F.col("low"), F.floor((F.col("price") - F.col("low")) / (F.col("high") - F.col("low")) * (ranges - 1))).otherwise(0))
    upto = Window.partitionBy("country_code").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("country_code", "range").agg(F.sum("n").alias("m"))
    sums = sums.select("country_code", "range", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("country_code")).alias("all"))
    within = Window.partitionBy("country_code", "range").orderBy("price").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.join(sums, ["country_code", "range"]).withColumn("last", F.col("before") + F.sum("n").over(within))
    # Rows (first, last] of a price that lie in the middle half.
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("last"), F.floor(F.col("all") * 0.75)) - F.greatest(F.col("last") - F.col("n"), F.floor(F.col("all") * 0.25)))
    cents = F.round(F.col("price") * 100).cast("decimal(38,0)")
    return placed.withColumn("taken", taken).where("taken > 0").groupBy("country_code").agg(F.round((F.sum(cents * F.col("taken")) / F.sum("taken")).cast("double") / 100, 4).alias("trimmed_mean"))


frame("win01_trimmed_mean", ["listing"], lambda d: """SELECT country_code, round(CAST(sum(CAST(round(price_gross_eur * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100, 4) AS trimmed_mean FROM (SELECT country_code, price_gross_eur, row_number() OVER (PARTITION BY country_code ORDER BY price_gross_eur) AS rn, count(*) OVER (PARTITION BY country_code) AS n FROM listing) x
WHERE rn > n * 0.25 AND rn <= n * 0.75 GROUP BY country_code""")(trimmed_means)


def ev_scores(listings: DataFrame, least: int = 20) -> DataFrame:
    """Electric listings against their cohort: residual of log-free OLS of price on mileage, as a z score (population
    deviation). Cohorts below ``least`` rows are left out. Two passes of one shuffle: sums, then their join back."""
    ev = listings.where("fuel_type in ('electric', 'hybrid_plugin', 'plug_in_hybrid') and price_gross_eur > 0 and mileage_km > 0")
    key = ["make", "model", "year", "country_code"]
    part = Window.partitionBy(*key)
    x, y = F.col("mileage_km").cast("double"), F.col("price_gross_eur")
    n, mx, my = F.count("*").over(part), F.avg(x).over(part), F.avg(y).over(part)
    sized = ev.select("vehicle_id", *key, x.alias("x"), y.alias("y"), n.alias("n"), mx.alias("mx"), my.alias("my")).where(F.col("n") >= least)
    dx = F.col("x") - F.col("mx")
    sxx, sxy = F.sum(dx * dx).over(part), F.sum(dx * (F.col("y") - F.col("my"))).over(part)
    fitted = sized.withColumn("slope", F.when(sxx > 0, sxy / sxx).otherwise(0.0))
    fitted = fitted.withColumn("residual", F.col("y") - F.col("my") - F.col("slope") * dx)
    sd = F.sqrt(F.avg(F.col("residual") * F.col("residual")).over(part))
    z = F.when(sd > 0, F.col("residual") / sd).otherwise(0.0)
    scored = fitted.withColumn("z", F.round(z, 4))
    flag = F.when(F.col("z") <= -2.0, "severe").when(F.col("z") <= -1.5, "anomaly").otherwise("normal")
    return scored.select("vehicle_id", *key, "n", "z", flag.alias("flag"), F.round(F.least(F.lit(1.0), F.col("n") / 100), 4).alias("confidence"))


_EV = """WITH e AS (SELECT vehicle_id, make, model, year, country_code, CAST(mileage_km AS DOUBLE) AS x, price_gross_eur AS y, count(*) OVER p AS n, avg(CAST(mileage_km AS DOUBLE)) OVER p AS mx, avg(price_gross_eur) OVER p AS my
  FROM listing WHERE fuel_type = 'electric' AND price_gross_eur > 0 AND mileage_km > 0 WINDOW p AS (PARTITION BY make, model, year, country_code)),
s AS (SELECT *, sum((x - mx) * (y - my)) OVER p / nullif(sum((x - mx) * (x - mx)) OVER p, 0) AS slope FROM e WHERE n >= 20 WINDOW p AS (PARTITION BY make, model, year, country_code)),
r AS (SELECT *, y - my - coalesce(slope, 0) * (x - mx) AS residual FROM s),
z AS (SELECT *, round(coalesce(residual / nullif(sqrt(avg(residual * residual) OVER (PARTITION BY make, model, year, country_code)), 0), 0), 4) AS z FROM r)"""
frame("agg13_ev_anomalies", ["listing"], lambda d: _EV + " SELECT vehicle_id, make, model, year, country_code, n, z, CASE WHEN z <= -2 THEN 'severe' WHEN z <= -1.5 THEN 'anomaly' ELSE 'normal' END AS flag, round(least(1.0, n / 100.0), 4) AS confidence FROM z")(ev_scores)
frame("flt14_ev_watch_list", ["listing"], lambda d: _EV + " SELECT vehicle_id, z, country_code FROM z WHERE z <= -1.5 AND n >= 30 ORDER BY z, vehicle_id LIMIT 50")(
    lambda v: ev_scores(v).where("z <= -1.5 and n >= 30").orderBy("z", "vehicle_id").limit(50).select("vehicle_id", "z", "country_code")
)
frame("srt03_lowest_z", ["listing"], lambda d: _EV + " SELECT vehicle_id, z FROM z ORDER BY z, vehicle_id LIMIT 30")(lambda v: ev_scores(v).orderBy("z", "vehicle_id").limit(30).select("vehicle_id", "z"))
frame("agg14_cohort_summary", ["listing"], lambda d: _EV + " SELECT make, country_code, count(*) AS n, min(z) AS min_z, max(z) AS max_z, count(*) FILTER (WHERE z <= -1.5) AS anomalies FROM z GROUP BY make, country_code")(
    lambda v: ev_scores(v).groupBy("make", "country_code").agg(F.count("*").alias("n"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.count_if(F.col("z") <= -1.5).alias("anomalies"))
)

both("agg01_country_stats", lambda d: "SELECT country_code, count(*) AS n, round(avg(coalesce(mileage_km, 0)), 4) AS avg_km, round(avg(coalesce(price_gross_eur, 0)), 4) AS avg_price FROM listing GROUP BY country_code ORDER BY n DESC, country_code")
both("agg02_global", lambda d: "SELECT (SELECT count(*) FROM dealer WHERE status = 'ACTIVE') AS active_dealers, round(avg(confidence_score), 6) AS avg_score FROM vehicle WHERE confidence_score > 0")
both("agg03_daily_series", lambda d: f"""SELECT country_code, make, model, year_from, day, price_mean, round({d.item('q', 0)}, 4) AS price_p25, round({d.item('q', 1)}, 4) AS price_p75, volume, km_mean FROM (SELECT country_code, make, model, year {d.div} 3 * 3 AS year_from, CAST(CAST(indexed_at AS DATE) AS STRING) AS day, round(avg(price_gross_eur) + 0.0000001, 4) AS price_mean, {d.pcts("price_gross_eur", (0.25, 0.75))} AS q, count(*) AS volume, round(avg(mileage_km), 4) AS km_mean
FROM listing WHERE price_gross_eur > 500 AND price_gross_eur < 500000 AND year >= 1990 GROUP BY 1, 2, 3, 4, 5) x""")
both("agg04_long_series", lambda d: "SELECT country_code, make, n_days FROM (SELECT country_code, make, count(DISTINCT CAST(indexed_at AS DATE)) AS n_days FROM listing GROUP BY country_code, make) x WHERE n_days >= 30")
both("agg06_active_dealers", lambda d: "SELECT country_code, count(*) AS n FROM dealer WHERE status = 'ACTIVE' GROUP BY country_code")
#: Fields whose presence is counted, those that must all be there first; an empty text or a zero is none.
_FIELDS = ("make", "model", "price_eur", "year", "mileage_km", "fuel_type", "transmission")
_NONE = {"price_eur": "0", "year": "0", "mileage_km": "0"}


def field_coverage(listings: DataFrame) -> DataFrame:
    """Listings with each field, and with all five critical ones, by country and for all ('all'); one aggregation."""
    there = {f: F.coalesce(F.col(f) != (0 if f in _NONE else ""), F.lit(False)) for f in _FIELDS}
    critical = reduce(lambda a, b: a & b, [there[f] for f in _FIELDS[:5]])
    out = listings.rollup("source_country").agg(F.grouping("source_country").alias("g"), F.count("*").alias("n"), *(F.count_if(x).alias(f) for f, x in there.items()), F.count_if(critical).alias("all_5_critical"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("source_country")).alias("country"), "n", *_FIELDS, "all_5_critical")


def _coverage_sql(d) -> str:
    counts = ", ".join(f"count(nullif({f}, {_NONE.get(f, repr(''))})) AS {f}" for f in _FIELDS)
    whole = f"SELECT %s AS country, count(*) AS n, {counts}, count(*) FILTER (WHERE nullif(make, '') IS NOT NULL AND nullif(model, '') IS NOT NULL AND nullif(price_eur, 0) IS NOT NULL AND nullif(year, 0) IS NOT NULL AND nullif(mileage_km, 0) IS NOT NULL) AS all_5_critical FROM quality_listing"
    return f"{whole % 'source_country'} GROUP BY source_country UNION ALL {whole % repr('all')}"


frame("agg26_field_coverage", ["quality_listing"], _coverage_sql)(field_coverage)
both("agg27_success_class", lambda d: "SELECT dealer_id, CASE WHEN r >= 0.8 THEN 'full' WHEN r > 0 THEN 'partial' ELSE 'failed' END AS class FROM (SELECT dealer_id, avg(CASE WHEN photo_count >= 2 AND price_gross_eur > 1000 THEN 1.0 ELSE 0.0 END) AS r FROM vehicle GROUP BY dealer_id) x")
both("agg28_modal_value", lambda d: "SELECT dealer_id, mileage_km FROM (SELECT dealer_id, mileage_km, row_number() OVER (PARTITION BY dealer_id ORDER BY n DESC, mileage_km) AS r FROM (SELECT dealer_id, mileage_km, count(*) AS n FROM vehicle GROUP BY dealer_id, mileage_km) x) y WHERE r = 1")
both("agg30_daily_volume", lambda d: "SELECT country_code, CAST(CAST(indexed_at AS DATE) AS STRING) AS day, count(*) AS n, round(sum(price_gross_eur), 2) AS price_sum, round(avg(price_gross_eur) + 0.0000001, 4) AS price_avg FROM listing GROUP BY 1, 2")
both("agg32_platform_coverage", lambda d: "SELECT source_platform, country_code, count(*) AS n, count(CASE WHEN sold_at IS NOT NULL THEN 1 END) AS sold FROM listing GROUP BY 1, 2")
both("agg33_volatility", lambda d: "SELECT make, model, year(w) * 10000 + month(w) * 100 + day(w) AS week, n, round(CASE WHEN m > 0 THEN s / m ELSE 0 END, 6) AS volatility FROM (SELECT make, model, date_trunc('week', indexed_at + INTERVAL 1 DAY) - INTERVAL 1 DAY AS w, count(*) AS n, avg(price_gross_eur) AS m, stddev_pop(price_gross_eur) AS s FROM vehicle GROUP BY 1, 2, 3) x WHERE n > 1")
_SHARES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
both("agg34_price_index", lambda d: "SELECT make, model, year, band, country_code, volume, " + ", ".join(f"round({d.item('q', i)}, 4) AS p{int(100 * p)}" for i, p in enumerate(_SHARES)) + f", price_avg, round({d.item('m', 0)}, 4) AS dom_median, dom_avg FROM (SELECT make, model, year, CASE WHEN mileage_km < 50000 THEN '0-50' WHEN mileage_km < 100000 THEN '50-100' WHEN mileage_km < 150000 THEN '100-150' ELSE '150+' END AS band, country_code, count(*) AS volume, {d.pcts('price_gross_eur', _SHARES)} AS q, {d.pcts('dom', (0.5,))} AS m, round(avg(dom), 4) AS dom_avg, round(avg(price_gross_eur) + 0.0000001, 4) AS price_avg FROM (SELECT *, {d.between_days('indexed_at', 'coalesce(sold_at, indexed_at + INTERVAL 60 DAY)')} AS dom FROM listing) l GROUP BY 1, 2, 3, 4, 5) x")
both("agg35_market_depth", lambda d: "SELECT make, country_code, CAST(floor(price_gross_eur / 1000) * 1000 AS BIGINT) AS tier, count(*) AS n FROM listing WHERE status = 'ACTIVE' GROUP BY 1, 2, 3")
both("agg36_days_on_market", lambda d: f"SELECT make, country_code, count(*) AS n, round({d.pct}(dom, 0.5), 4) AS dom_p50, round({d.pct}(dom, 0.9), 4) AS dom_p90 FROM (SELECT make, country_code, {d.between_days('indexed_at', 'coalesce(sold_at, indexed_at + INTERVAL 60 DAY)')} AS dom FROM listing) x GROUP BY 1, 2")


def candles(listings: DataFrame) -> DataFrame:
    """Prices of each make and model by month and week: open, high, low and close as percentiles 10, 90, 5 and 50. One scan, each
    row in both periods, one buffer a group."""
    at, week = F.col("indexed_at"), F.date_trunc("week", "indexed_at")
    day = lambda x: F.year(x) * 10000 + F.month(x) * 100 + F.day(x)
    both_ = F.inline(F.array(F.struct(F.lit("M").alias("period"), (F.year(at) * 100 + F.month(at)).alias("start")), F.struct(F.lit("W").alias("period"), day(week).alias("start"))))
    grouped = listings.select("make", "model", "price_gross_eur", both_).groupBy("make", "model", "period", "start").agg(F.percentile("price_gross_eur", F.array(*map(F.lit, (0.1, 0.9, 0.05, 0.5)))).alias("q"), F.count("*").alias("volume"))
    return grouped.select("make", "model", "period", "start", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("open", "high", "low", "close"))), "volume")


frame("agg37_candles", ["vehicle"], lambda d: """WITH p AS (SELECT make, model, 'M' AS period, year(indexed_at) * 100 + month(indexed_at) AS start, price_gross_eur AS p FROM vehicle UNION ALL SELECT make, model, 'W', CAST(strftime(date_trunc('week', indexed_at), '%Y%m%d') AS INT), price_gross_eur FROM vehicle)
SELECT make, model, period, start, round(quantile_cont(p, 0.1), 4) AS open, round(quantile_cont(p, 0.9), 4) AS high, round(quantile_cont(p, 0.05), 4) AS low, round(median(p), 4) AS close, count(*) AS volume FROM p GROUP BY ALL""")(candles)
both("agg39_arbitrage", lambda d: f"""WITH m AS (SELECT make, model, year, country_code, {d.pct}(price_gross_eur, 0.5) AS med, count(*) AS n FROM listing GROUP BY 1, 2, 3, 4)
SELECT a.make, a.model, a.year, a.country_code AS origin, b.country_code AS dest, round(b.med - a.med - t.cost / 100.0, 4) AS gross_margin, round(100 * (b.med - a.med - t.cost / 100.0) / a.med, 4) AS margin_pct
FROM m a JOIN m b ON a.make = b.make AND a.model = b.model AND a.year = b.year AND a.country_code <> b.country_code JOIN transport t ON t.origin = a.country_code AND t.dest = b.country_code WHERE b.med - a.med - t.cost / 100.0 > 0""")
both("agg40_route_stats", lambda d: f"""WITH m AS (SELECT make, model, country_code, {d.pct}(price_gross_eur, 0.5) AS med FROM listing GROUP BY 1, 2, 3)
SELECT a.country_code AS origin, b.country_code AS dest, count(*) AS n, round(avg(b.med - a.med - t.cost / 100.0), 4) AS avg_margin FROM m a JOIN m b ON a.make = b.make AND a.model = b.model AND a.country_code <> b.country_code JOIN transport t ON t.origin = a.country_code AND t.dest = b.country_code GROUP BY 1, 2""")
both("agg41_demand", lambda d: "SELECT listing_id % 50 AS cohort, event_type, count(*) AS n FROM event GROUP BY 1, 2")
both("agg45_facts", lambda d: "SELECT e.event_type, e.listing_id % 25 AS dealer_id, year(e.ts) * 10000 + month(e.ts) * 100 + day(e.ts) AS day, count(*) AS n, round(sum(e.value), 4) AS value FROM event e GROUP BY 1, 2, 3")
both("win02_latest", lambda d: "SELECT dealer_id, vehicle_id FROM (SELECT dealer_id, vehicle_id, row_number() OVER (PARTITION BY dealer_id ORDER BY indexed_at DESC, vehicle_id) AS r FROM vehicle) x WHERE r = 1")
both("win03_mileage_gaps", lambda d: f"""SELECT event_id, CASE WHEN mileage < p THEN 'rollback' ELSE 'high_gap' END AS issue FROM (SELECT *, lag(mileage) OVER w AS p, lag(ts) OVER w AS t FROM mileage WINDOW w AS (PARTITION BY vin ORDER BY ts, event_id)) x
WHERE (mileage > 0 AND p > 0 AND mileage < p) OR (p > 0 AND {d.between_days('t', 'ts')} > 0 AND (mileage - p) * 365.0 / {d.between_days('t', 'ts')} > 50000)""")
def trends(history: DataFrame, key: str = "dealer_id", at: str = "mth", score: str = "score", band: float = 5.0) -> DataFrame:
    """Each point against the mean of up to three points before it: improving or deteriorating by more than ``band``, stable
    otherwise and with fewer than two points before. Differences are rounded, so that sums in another order don't move a point
    over the threshold."""
    before = Window.partitionBy(key).orderBy(at).rowsBetween(-3, -1)
    far = F.round(F.col(score) - F.avg(score).over(before), 6)
    moved = history.select(key, at, F.when(F.count(score).over(before) >= 2, far).alias("far"))
    return moved.select(key, at, F.when(F.col("far") > band, "improving").when(F.col("far") < -band, "deteriorating").otherwise("stable").alias("trend"))


VIEWS["dealer_month"] = lambda d: "SELECT dealer_id, mth, 100 * s / n AS score FROM (SELECT dealer_id, year(indexed_at) * 12 + month(indexed_at) AS mth, CAST(sum(CAST(round(confidence_score * 100) AS BIGINT)) AS DOUBLE) / 100 AS s, count(*) AS n FROM vehicle GROUP BY 1, 2) x"
frame("win05_trend", ["dealer_month"], lambda d: """SELECT m.dealer_id, m.mth, CASE WHEN count(h.score) < 2 THEN 'stable' WHEN round(m.score - avg(h.score), 6) > 5 THEN 'improving' WHEN round(m.score - avg(h.score), 6) < -5 THEN 'deteriorating' ELSE 'stable' END AS trend
FROM dealer_month m LEFT JOIN (SELECT a.dealer_id, a.mth AS at, b.score, row_number() OVER (PARTITION BY a.dealer_id, a.mth ORDER BY b.mth DESC) AS r FROM dealer_month a JOIN dealer_month b ON a.dealer_id = b.dealer_id AND b.mth < a.mth) h ON h.dealer_id = m.dealer_id AND h.at = m.mth AND h.r <= 3 GROUP BY m.dealer_id, m.mth, m.score""")(trends)
both("win07_temporal_split", lambda d: f"SELECT event_id, CASE WHEN r > n - greatest(1, n {d.div} 10) THEN 'test' WHEN r > n - 2 * greatest(1, n {d.div} 10) THEN 'validation' ELSE 'train' END AS part FROM (SELECT event_id, row_number() OVER (PARTITION BY listing_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY listing_id) AS n FROM event) x")
both("win09_naive_error", lambda d: "SELECT listing_id, round(avg(abs(value - p)), 6) AS naive_mae FROM (SELECT listing_id, value, lag(value) OVER (PARTITION BY listing_id ORDER BY ts, event_id) AS p FROM event WHERE event_type = 'purchase') x WHERE p IS NOT NULL GROUP BY listing_id")
both("win12_price_drop", lambda d: "SELECT event_id, round(value - p, 6) AS delta, round(100 * (value - p) / p, 4) AS delta_pct, CAST(sum(CASE WHEN value < p THEN 1 ELSE 0 END) OVER (PARTITION BY listing_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS drops FROM (SELECT *, lag(value) OVER (PARTITION BY listing_id ORDER BY ts, event_id) AS p FROM event WHERE event_type = 'purchase') x WHERE p > 0")
both("win14_margin_rank", lambda d: "SELECT vehicle_id, round(percent_rank() OVER (PARTITION BY make, model, year ORDER BY price_gross_eur), 6) AS margin_score FROM vehicle")
both("win08_tail_split", lambda d: "SELECT event_id, r > n - greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS held_out FROM (SELECT event_id, row_number() OVER (PARTITION BY listing_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY listing_id) AS n FROM event) x")
both("metrics_mase_smape", lambda d: """WITH s AS (SELECT listing_id, value AS y, lag(value) OVER (PARTITION BY listing_id ORDER BY ts, event_id) AS f FROM event WHERE event_type = 'view')
SELECT listing_id, round(avg(abs(y - f)), 6) AS mae, round(200 * avg(CASE WHEN abs(y) + abs(f) > 0 THEN abs(y - f) / (abs(y) + abs(f)) END), 4) AS smape FROM s WHERE f IS NOT NULL GROUP BY listing_id""")

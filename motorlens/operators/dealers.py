"""Dealers: health signals and score, trust, confidence, clusters and graph features (AGG07-21, SCO01-04)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import SPARK
from ..plans.registry import both, frame
from ..plans.shared import stored

# Weights of the stress signals.
WEIGHTS = {"liquidation": 0.20, "price": 0.15, "volume": 0.15, "tom": 0.15, "composite": 0.10, "hhi": 0.10, "market": 0.15}


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rounded(x: Column, digits: int = 2) -> Column:
    """``x`` times the power of ten, as a double, to the nearest whole number, halves away from zero: as SQL engines round doubles. Spark's own ``round``
    goes by the decimal digits that a double prints as, which differ at halves."""
    return F.round(x * float(10**digits), 0) / float(10**digits)


def health_signals(listings: DataFrame, week_order: str = "chronological") -> DataFrame:
    """All signals of all dealers from one scan: sums and counts by dealer, make and week are written once, and dealers, their
    makes and weeks, and countries are rolled up from these few rows. ``listings`` are those up to now; ``week_order='lexical'``
    orders weeks by their text key."""
    now = F.expr(SPARK.now)

    def since(days: int) -> Column:
        return F.col("indexed_at") >= F.expr(f"{SPARK.now} - INTERVAL {days} DAY")

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.when(b > 0, 100 * (a - b) / b), F.lit(0.0))

    active, price = F.col("status") == "ACTIVE", F.col("price_gross_eur")
    counted = ~F.col("status").isin("REJECTED", "DUPLICATE")
    # Days as a double: a decimal would be cut to six digits at each division, and then rounded once more.
    age = F.expr(f"(unix_micros(CAST({SPARK.now} AS TIMESTAMP)) - unix_micros(CAST(indexed_at AS TIMESTAMP))) / 86400000000.0D")
    # Name -> (rows, value): their mean is wanted.
    means = {
        "p1": (active & (price > 0) & since(7), price), "p0": (active & (price > 0) & since(14) & ~since(7), price), "tom": (active, age), "tom0": (active & since(60) & ~since(30), age),
        "c1": (active & since(14), F.col("confidence_score")), "c0": (active & since(28) & ~since(14), F.col("confidence_score")), "own": (active & (price > 0), price),
    }
    counts = {
        "active_count": active, "removed": counted & (F.col("ttl_expires_at") >= F.expr(f"{SPARK.now} - INTERVAL 14 DAY")) & (F.col("ttl_expires_at") <= now), "new": counted & since(14), "lately": counted & since(90),
    }
    week = F.date_trunc("week", "indexed_at")
    key = F.date_format(week, "yyyy-MM-dd") if week_order == "chronological" else F.date_format(week, "MMdd-yyyy")
    # Means of few values lie at halves of a hundredth often: their sums are exact, whatever the order of the rows. What no decimal holds is added as it is.
    exact = {n: v.try_cast("decimal(38,18)") for n, (_, v) in means.items() if n in ("p1", "p0", "c1", "c0")}
    base = listings.groupBy("dealer_id", "country_code", "make", F.when(since(90), key).alias("wk")).agg(
        *(F.count_if(x).alias(n) for n, x in counts.items()), *(F.sum(F.when(x & exact[n].isNull() if n in exact else x, v)).alias(n + "_sum") for n, (x, v) in means.items()), *(F.count(F.when(x, v)).alias(n + "_n") for n, (x, v) in means.items()),
        *(F.sum(F.when(means[n][0], v)).alias(n + "_exact") for n, v in exact.items()),
    )
    base = stored(base, "signals")
    whole = lambda n: F.coalesce(F.sum(n + "_exact").cast("double") + F.coalesce(F.sum(n + "_sum"), F.lit(0.0)), F.sum(n + "_sum")) if n in exact else F.sum(n + "_sum")
    mean = lambda n: F.try_divide(whole(n), F.sum(n + "_n")).alias(n)
    main = base.groupBy("dealer_id", "country_code").agg(*(F.sum(n).alias(n) for n in ("active_count", "removed", "new")), *map(mean, means))
    makes = base.where("make is not null").groupBy("dealer_id", "make").agg(F.sum("active_count").alias("count")).where("count > 0")
    hhi = makes.groupBy("dealer_id").agg((F.sum(F.col("count") * F.col("count")) / F.pow(F.sum("count"), F.lit(2))).alias("brand_hhi"))
    market = base.groupBy("country_code").agg(mean("own").alias("market"))
    # Weeks from Monday; a week's count only where there is one, the last of them against the others.
    weeks = base.where("wk is not null").groupBy("dealer_id", "wk").agg(F.sum("lately").alias("n")).where("n > 0")
    runs = weeks.groupBy("dealer_id").agg(F.max_by("n", "wk").alias("last"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count("*").alias("w"))
    rest = F.col("w") - 1
    usual = F.try_divide(F.col("s") - F.col("last"), rest)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("last") * F.col("last"), rest) - usual * usual))
    volume = runs.select("dealer_id", F.when((F.col("w") >= 2) & (sd > 1e-9), (F.col("last") - usual) / sd).otherwise(0.0).alias("volume_z"))
    joined = main.join(hhi, "dealer_id", "left").join(volume, "dealer_id", "left").join(market, "country_code", "left")
    return joined.select(
        "dealer_id", "country_code", "active_count",
        F.coalesce(F.try_divide(F.col("removed"), F.col("new")), F.lit(0.0)).alias("liquidation"),
        ratio(F.col("p1"), F.col("p0")).alias("price_trend"), F.coalesce("volume_z", F.lit(0.0)).alias("volume_z"),
        F.coalesce("tom", F.lit(0.0)).alias("avg_tom"), ratio(F.col("tom"), F.col("tom0")).alias("tom_delta"),
        F.coalesce((F.col("c1") - F.col("c0")) * 100, F.lit(0.0)).alias("composite_delta"), F.coalesce("brand_hhi", F.lit(0.0)).alias("brand_hhi"),
        F.coalesce(F.try_divide(F.col("own"), F.col("market")), F.lit(1.0)).alias("price_vs_market"),
    )


def health_score(signals: DataFrame) -> DataFrame:
    """Score 0-100, tier and risk labels of dealers with signals."""
    c = F.col
    stress = {
        "liquidation": clamp01((c("liquidation") - 1.0) / 0.5), "price": clamp01(-c("price_trend") / 10.0), "volume": clamp01(F.abs("volume_z") / 2.0),
        "tom": clamp01(c("tom_delta") / 40.0), "composite": clamp01(-c("composite_delta") / 20.0), "hhi": clamp01((c("brand_hhi") - 0.25) / 0.75), "market": clamp01((0.85 - c("price_vs_market")) / 0.20),
    }
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - reduce(lambda a, b: a + b, [WEIGHTS[k] * s for k, s in stress.items()]))))
    risks = F.array_compact(F.array(
        F.when(c("liquidation") > 1.5, "liquidation_pressure"), F.when(c("price_trend") < -5, "price_erosion"), F.when(F.abs("volume_z") > 1.5, "volume_anomaly"), F.when(c("tom_delta") > 20, "inventory_stagnation"),
        F.when(c("composite_delta") < -10, "quality_deterioration"), F.when(c("brand_hhi") > 0.5, "brand_concentration"), F.when((c("price_vs_market") > 0) & (c("price_vs_market") < 0.85), "deep_discount"),
    ))
    scored = signals.withColumn("health_score", score)
    tier = F.when(c("health_score") >= 70, "healthy").when(c("health_score") >= 50, "watch").when(c("health_score") >= 30, "stress").otherwise("critical")
    return scored.withColumn("tier", tier).withColumn("risks", risks)


def health(listings: DataFrame) -> DataFrame:
    out = health_score(health_signals(listings))
    return out.select("dealer_id", "active_count", *(rounded(F.col(x)).alias(x) for x in ("liquidation", "price_trend", "volume_z", "tom_delta", "brand_hhi", "price_vs_market", "health_score")), "tier", F.array_join("risks", ",").alias("risks"))


_LIVE = "live AS (SELECT v.*, d.country_code FROM recent v JOIN dealer d ON v.dealer_id = d.dealer_id)"


def _health_sql(d) -> str:
    now = d.now

    def since(n: int) -> str:
        return f"indexed_at >= {now} - INTERVAL {n} DAY"

    age = f"(epoch_us({now}) - epoch_us(indexed_at)) / 86400000000.0"
    return f"""WITH {_LIVE},
m AS (SELECT dealer_id, country_code, count(*) FILTER (WHERE status = 'ACTIVE') AS active_count, count(*) FILTER (WHERE status <> 'REJECTED' AND ttl_expires_at >= {now} - INTERVAL 14 DAY AND ttl_expires_at <= {now}) AS removed,
 count(*) FILTER (WHERE status <> 'REJECTED' AND {since(14)}) AS new, avg(price_gross_eur) FILTER (WHERE status = 'ACTIVE' AND {since(7)}) AS p1, avg(price_gross_eur) FILTER (WHERE status = 'ACTIVE' AND {since(14)} AND NOT {since(7)}) AS p0,
 avg({age}) FILTER (WHERE status = 'ACTIVE') AS tom, avg({age}) FILTER (WHERE status = 'ACTIVE' AND {since(60)} AND NOT {since(30)}) AS tom0, avg(confidence_score) FILTER (WHERE status = 'ACTIVE' AND {since(14)}) AS c1,
 avg(confidence_score) FILTER (WHERE status = 'ACTIVE' AND {since(28)} AND NOT {since(14)}) AS c0, avg(price_gross_eur) FILTER (WHERE status = 'ACTIVE') AS own FROM live GROUP BY ALL),
h AS (SELECT dealer_id, sum(n * n) / (sum(n) * sum(n)) AS hhi FROM (SELECT dealer_id, make, CAST(count(*) AS DOUBLE) AS n FROM live WHERE status = 'ACTIVE' GROUP BY ALL) GROUP BY 1),
k AS (SELECT country_code, avg(price_gross_eur) AS market FROM live WHERE status = 'ACTIVE' GROUP BY 1),
w AS (SELECT dealer_id, n, row_number() OVER (PARTITION BY dealer_id ORDER BY wk DESC) AS r FROM (SELECT dealer_id, date_trunc('week', indexed_at) AS wk, count(*) AS n FROM live WHERE status <> 'REJECTED' AND {since(90)} GROUP BY ALL)),
z AS (SELECT dealer_id, CASE WHEN count(*) >= 2 AND stddev_pop(n) FILTER (WHERE r > 1) > 1e-9 THEN (max(n) FILTER (WHERE r = 1) - avg(n) FILTER (WHERE r > 1)) / stddev_pop(n) FILTER (WHERE r > 1) ELSE 0 END AS vz FROM w GROUP BY 1),
s AS (SELECT m.dealer_id, active_count, coalesce(removed / nullif(new, 0), 0) AS liquidation, coalesce(100 * (p1 - p0) / p0, 0) AS price_trend, coalesce(vz, 0) AS volume_z, coalesce(100 * (tom - tom0) / tom0, 0) AS tom_delta,
 coalesce((c1 - c0) * 100, 0) AS cd, coalesce(hhi, 0) AS brand_hhi, coalesce(own / market, 1) AS price_vs_market FROM m LEFT JOIN h USING (dealer_id) LEFT JOIN z USING (dealer_id) LEFT JOIN k USING (country_code)),
t AS (SELECT *, 100 * (1 - (0.2 * greatest(0, least(1, (liquidation - 1) / 0.5)) + 0.15 * greatest(0, least(1, -price_trend / 10)) + 0.15 * least(1, abs(volume_z) / 2) + 0.15 * greatest(0, least(1, tom_delta / 40)) + 0.1 * greatest(0, least(1, -cd / 20))
 + 0.1 * greatest(0, least(1, (brand_hhi - 0.25) / 0.75)) + 0.15 * greatest(0, least(1, (0.85 - price_vs_market) / 0.2)))) AS score FROM s)
SELECT dealer_id, active_count, round(liquidation, 2) AS liquidation, round(price_trend, 2) AS price_trend, round(volume_z, 2) AS volume_z, round(tom_delta, 2) AS tom_delta, round(brand_hhi, 2) AS brand_hhi, round(price_vs_market, 2) AS price_vs_market, round(score, 2) AS health_score,
 CASE WHEN score >= 70 THEN 'healthy' WHEN score >= 50 THEN 'watch' WHEN score >= 30 THEN 'stress' ELSE 'critical' END AS tier,
 concat_ws(',', CASE WHEN liquidation > 1.5 THEN 'liquidation_pressure' END, CASE WHEN price_trend < -5 THEN 'price_erosion' END, CASE WHEN abs(volume_z) > 1.5 THEN 'volume_anomaly' END, CASE WHEN tom_delta > 20 THEN 'inventory_stagnation' END,
 CASE WHEN cd < -10 THEN 'quality_deterioration' END, CASE WHEN brand_hhi > 0.5 THEN 'brand_concentration' END, CASE WHEN price_vs_market > 0 AND price_vs_market < 0.85 THEN 'deep_discount' END) AS risks FROM t"""


frame("sco01_dealer_health", ["live_listing"], _health_sql)(health)


def trust(signals: DataFrame, *keep: str) -> DataFrame:
    """Trust points 20+15+20+25+20 and tier from dealer signals."""
    c = F.col
    vies = F.when(c("vies_status") == "valid", 20.0).when(c("vies_status") == "unchecked", 10.0).otherwise(0.0)
    registry = F.when(c("registry") == "registered", 12 + F.least(F.lit(3.0), c("registry_age") / 5.0 * 3)).when(c("registry") == "unchecked", 7.0).otherwise(0.0)
    v15 = c("v15") / 100.0 * 20.0
    v15 = F.when(c("tenure_days") < 30, F.least(v15, F.lit(10.0))).otherwise(v15)
    behaviour = F.least(F.lit(8.0), c("volume") / 50.0 * 8) + c("avg_score") / 100.0 * 10 + F.least(F.lit(7.0), c("tenure_days") / 365.0 * 7)
    total = F.greatest(F.lit(0.0), F.least(F.lit(100.0), vies + registry + v15 + behaviour + F.greatest(F.lit(0.0), 20.0 - c("anomalies") * 4)))
    out = signals.withColumn("trust_score", F.round(total + 1e-7, 4))
    tier = F.when(c("trust_score") >= 85, "platinum").when(c("trust_score") >= 70, "gold").when(c("trust_score") >= 50, "silver").otherwise("unverified")
    return out.select("dealer_id", "trust_score", tier.alias("tier"), *keep)


#: Days for which a profile holds.
VALID_DAYS = 90


def profiles(signals: DataFrame, now: str = "2001-09-30") -> DataFrame:
    """Trust of each dealer with the day its profile, issued on ``issued_at``, ends and whether that is past at ``now``: at the very end it still
    holds. A profile without a day has no end and doesn't hold."""
    ends = F.date_add("issued_at", VALID_DAYS)
    over = F.coalesce(F.lit(now).cast("timestamp_ntz") > ends.cast("timestamp_ntz"), F.lit(True))
    return trust(signals, "issued_at").select("dealer_id", "trust_score", "tier", ends.cast("string").alias("expires_at"), over.alias("expired"))


frame("sco03_trust", ["trust_signal"], lambda d: """WITH t AS (SELECT dealer_id, round(greatest(0, least(100, CASE vies_status WHEN 'valid' THEN 20 WHEN 'unchecked' THEN 10 ELSE 0 END + CASE registry WHEN 'registered' THEN 12 + least(3, registry_age / 5.0 * 3) WHEN 'unchecked' THEN 7 ELSE 0 END
 + CASE WHEN tenure_days < 30 THEN least(10, v15 / 5.0) ELSE v15 / 5.0 END + least(8, volume / 50.0 * 8) + avg_score / 10.0 + least(7, tenure_days / 365.0 * 7) + greatest(0, 20 - anomalies * 4))) + 1e-7, 4) AS trust_score, CAST(issued_at + INTERVAL 90 DAY AS DATE) AS ends FROM trust_signal)
SELECT dealer_id, CAST(trust_score AS DOUBLE) AS trust_score, CASE WHEN trust_score >= 85 THEN 'platinum' WHEN trust_score >= 70 THEN 'gold' WHEN trust_score >= 50 THEN 'silver' ELSE 'unverified' END AS tier, CAST(ends AS VARCHAR) AS expires_at, ends < DATE '2001-09-30' AS expired FROM t""")(profiles)

both("agg07_liquidation", lambda d: f"SELECT dealer_id, count(CASE WHEN ttl_expires_at >= {d.now} - INTERVAL 14 DAY AND ttl_expires_at <= {d.now} THEN 1 END) AS removed, count(CASE WHEN indexed_at >= {d.now} - INTERVAL 14 DAY THEN 1 END) AS added FROM recent WHERE status NOT IN ('REJECTED', 'DUPLICATE') GROUP BY dealer_id")
both("agg11_brand_hhi", lambda d: "SELECT dealer_id, round(sum(n * n) / (sum(n) * sum(n)), 6) AS hhi FROM (SELECT dealer_id, make, CAST(count(*) AS DOUBLE) AS n FROM vehicle WHERE status = 'ACTIVE' GROUP BY dealer_id, make) x GROUP BY dealer_id")
both("agg17_trust_signals", lambda d: "SELECT d.dealer_id, count(v.vehicle_id) AS volume, round(100 * avg(v.confidence_score) + 0.0000001, 4) AS avg_score, count(CASE WHEN v.status = 'REJECTED' THEN 1 END) AS rejected FROM dealer d LEFT JOIN vehicle v ON v.dealer_id = d.dealer_id GROUP BY d.dealer_id")
both("agg18_confidence", lambda d: "SELECT f.dealer_id, round(CAST(least(sum(w.weight), 1.0) AS DOUBLE), 4) AS confidence, count(*) AS families FROM (SELECT DISTINCT dealer_id, family FROM finding) f JOIN family_weight w ON f.family = w.family GROUP BY f.dealer_id")
both("agg21_graph_features", lambda d: """WITH f AS (SELECT d.dealer_id, d.country_code, d.confidence_score AS trust, ln(1 + count(v.vehicle_id)) AS volume, avg(v.price_gross_eur) AS price, avg(v.mileage_km) AS km FROM dealer d LEFT JOIN vehicle v ON v.dealer_id = d.dealer_id GROUP BY 1, 2, 3),
e AS (SELECT """ + ", ".join(f"min({c}) AS {c}_low, max({c}) AS {c}_high" for c in ("trust", "volume", "price", "km")) + """ FROM f), c AS (SELECT country_code, row_number() OVER (ORDER BY country_code) - 1 AS country_index FROM (SELECT DISTINCT country_code FROM f) x)
SELECT f.dealer_id, c.country_index, """ + ", ".join(f"round(CASE WHEN {c}_high > {c}_low THEN (f.{c} - {c}_low) / ({c}_high - {c}_low) ELSE 0 END, 6) AS {c}" for c in ("trust", "volume", "price", "km")) + " FROM f CROSS JOIN e JOIN c ON c.country_code = f.country_code")
both("agg21_brand_entropy", lambda d: "SELECT dealer_id, round(-sum(n / t * ln(n / t)), 6) AS entropy FROM (SELECT dealer_id, n, sum(n) OVER (PARTITION BY dealer_id) AS t FROM (SELECT dealer_id, make, CAST(count(*) AS DOUBLE) AS n FROM vehicle GROUP BY dealer_id, make) x) y GROUP BY dealer_id")
both("agg43_source_overlap", lambda d: "SELECT count(CASE WHEN a AND b THEN 1 END) AS overlap, count(CASE WHEN a AND NOT b THEN 1 END) AS only_a, count(CASE WHEN b AND NOT a THEN 1 END) AS only_b FROM (SELECT vin, max(CASE WHEN source_platform = 'src0' THEN 1 ELSE 0 END) = 1 AS a, max(CASE WHEN source_platform = 'src1' THEN 1 ELSE 0 END) = 1 AS b FROM vehicle GROUP BY vin) x")
both("srt08_watchlist", lambda d: "SELECT dealer_id, score FROM (SELECT dealer_id, round(100 * avg(confidence_score) + 0.0000001, 4) AS score FROM vehicle GROUP BY dealer_id) x WHERE score < 95 ORDER BY score, dealer_id LIMIT 20")
both("qry05_presences", lambda d: "SELECT country_code, vies_status, count(*) AS n FROM dealer GROUP BY country_code, vies_status")
both("qry24_backfill_country", lambda d: "SELECT v.vehicle_id, coalesce(CASE WHEN d.status = 'ACTIVE' THEN d.country_code END, CASE WHEN v.source_url LIKE '%.example/%' THEN 'EU' END) AS country FROM vehicle v LEFT JOIN dealer d ON v.dealer_id = d.dealer_id")

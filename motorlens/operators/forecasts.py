"""Forecasts of daily series with a backtest: of five methods each series takes the one that did best at earlier origins.

Everything is sums by series, origin and phase of the season, so series of any length and number are aggregated where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import frame

#: Steps ahead, length of a season, earlier origins that are tested (each one horizon before the last), and how fast smoothing forgets.
HORIZON, SEASON, ORIGINS, ALPHA = 7, 7, 3, 0.3
METHODS = ("naive", "drift", "smoothed", "seasonal", "seasonal smoothed")
#: Points that a series must have.
LEAST = HORIZON * ORIGINS + 2 * SEASON


def _smoothed(y, place, count) -> F.Column:
    """Sum of what each value counts in an exponentially smoothed level: ``place`` from 1 to ``count``, the first counts for all before it."""
    weight = F.pow(F.lit(1 - ALPHA), count - place) * F.when(place == 1, 1.0).otherwise(ALPHA)
    return F.sum(weight * y)


def predictions(series: DataFrame) -> DataFrame:
    """(k, origin, n, step, method, forecast, y, scale) for series (k, at, y): forecasts of each method from the last ``ORIGINS`` + 1 origins
    (0: the end, where ``y`` is null); ``scale``: the mean step of the series up to the origin."""
    own = series.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("at")))
    size = own.groupBy("k").agg(F.max("i").alias("n")).where(F.col("n") >= LEAST)
    own = own.withColumn("move", F.abs(F.col("y") - F.lag("y").over(Window.partitionBy("k").orderBy("at")))).join(size, "k")
    seen = own.withColumn("origin", F.explode(F.array(*map(F.lit, range(ORIGINS + 1))))).withColumn("m", F.col("n") - HORIZON * F.col("origin")).where("i <= m")
    i, m, y = F.col("i"), F.col("m"), F.col("y")
    ends = seen.groupBy("k", "origin", "n", "m").agg(F.avg("move").alias("scale"), F.max_by("y", "i").alias("last"), F.min_by("y", "i").alias("first"), _smoothed(y, i, m).alias("level"))
    phase = ((i - 1) % SEASON).alias("phase")
    count, place = F.floor((m - 1 - (i - 1) % SEASON) / SEASON) + 1, F.floor((i - 1) / SEASON) + 1
    phases = seen.groupBy("k", "origin", phase).agg(F.max_by("y", "i").alias("season"), _smoothed(y, place, count).alias("season_level"))
    steps = ends.withColumn("step", F.explode(F.array(*map(F.lit, range(1, HORIZON + 1))))).withColumn("phase", (F.col("m") + F.col("step") - 1) % SEASON).join(phases, ["k", "origin", "phase"])
    c = F.col
    values = {"naive": c("last"), "drift": c("last") + c("step") * (c("last") - c("first")) / (c("m") - 1), "smoothed": c("level"), "seasonal": c("season"), "seasonal smoothed": c("season_level")}
    out = steps.select("k", "origin", "n", "step", "scale", (c("m") + c("step")).alias("i"), F.inline(F.array(*(F.struct(F.lit(j).alias("nth"), F.lit(name).alias("method"), values[name].alias("forecast")) for j, name in enumerate(METHODS)))))
    return out.join(own.select("k", "i", "y"), ["k", "i"], "left")


def backtest(found: DataFrame) -> DataFrame:
    """(k, nth, method, mase, smape) over the earlier origins of ``predictions``: mean absolute error by the series' mean step at the
    origin, and the symmetric error in per cent."""
    y, f = F.col("y"), F.col("forecast")
    half = (F.abs(y) + F.abs(f)) / 2
    by = found.where("origin > 0").groupBy("k", "nth", "method", "origin").agg((F.avg(F.abs(y - f)) / F.first("scale")).alias("mase"), (100 * F.avg(F.when(half > 0, F.abs(y - f) / half))).alias("smape"))
    return by.groupBy("k", "nth", "method").agg(F.avg("mase").alias("mase"), F.avg("smape").alias("smape"))


def forecasts(series: DataFrame) -> DataFrame:
    """(k, method, step, p10, p50, p90): of each series the method with the least mean scaled error (the first of those alike); the interval is that of
    its errors at earlier origins."""
    found = predictions(series)
    chosen = backtest(found).groupBy("k").agg(F.min_by("nth", F.struct(F.round("mase", 9), "nth")).alias("nth"))
    best = found.join(chosen, ["k", "nth"])
    errors = best.where("origin > 0").groupBy("k").agg(F.percentile(F.col("y") - F.col("forecast"), F.array(F.lit(0.1), F.lit(0.9))).alias("e"))
    out = best.where("origin = 0").join(errors, "k")
    return out.select("k", "method", "step", (F.col("forecast") + F.col("e")[0]).alias("p10"), F.col("forecast").alias("p50"), (F.col("forecast") + F.col("e")[1]).alias("p90"))


def prices(recent: DataFrame) -> DataFrame:
    """Mean price of each make and day."""
    return recent.groupBy(F.col("make").alias("k"), F.to_date("indexed_at").alias("at")).agg(F.avg("price_gross_eur").alias("y"))


_VALUES = {"naive": "last", "drift": "last + step * (last - first) / (m - 1)", "smoothed": "level", "seasonal": "season", "seasonal smoothed": "season_level"}
_SQL = f"""WITH s AS (SELECT make AS k, CAST(indexed_at AS DATE) AS day, avg(price_gross_eur) AS y FROM recent GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER w AS i, abs(y - lag(y) OVER w) AS move, count(*) OVER (PARTITION BY k) AS n FROM s WINDOW w AS (PARTITION BY k ORDER BY day)),
e AS (SELECT o.*, g AS origin, n - {HORIZON} * g AS m FROM o, range({ORIGINS + 1}) r(g) WHERE n >= {LEAST} AND i <= n - {HORIZON} * g),
d AS (SELECT k, origin, n, m, avg(move) AS scale, max(CASE WHEN i = m THEN y END) AS last, max(CASE WHEN i = 1 THEN y END) AS first, sum(power({1 - ALPHA}::DOUBLE, m - i) * CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE {ALPHA}::DOUBLE END * y) AS level FROM e GROUP BY 1, 2, 3, 4),
q AS (SELECT *, (i - 1) % {SEASON} AS phase, (i - 1) // {SEASON} + 1 AS place, (m - 1 - (i - 1) % {SEASON}) // {SEASON} + 1 AS total FROM e),
p AS (SELECT k, origin, phase, max(CASE WHEN place = total THEN y END) AS season, sum(power({1 - ALPHA}::DOUBLE, total - place) * CASE WHEN place = 1 THEN 1.0::DOUBLE ELSE {ALPHA}::DOUBLE END * y) AS season_level FROM q GROUP BY 1, 2, 3),
a AS (SELECT d.*, step, season, season_level FROM d, range(1, {HORIZON + 1}) h(step) JOIN p ON p.k = d.k AND p.origin = d.origin AND p.phase = (d.m + step - 1) % {SEASON}),
f AS ({" UNION ALL ".join(f"SELECT k, origin, n, m, step, scale, {j} AS nth, '{name}' AS method, {_VALUES[name]} AS forecast FROM a" for j, name in enumerate(METHODS))}),
t AS (SELECT f.*, o.y FROM f LEFT JOIN o ON o.k = f.k AND o.i = f.m + f.step),
b AS (SELECT k, nth, method, avg(mase) AS mase, avg(smape) AS smape FROM (SELECT k, nth, method, origin, avg(abs(y - forecast)) / min(scale) AS mase, 100 * avg(abs(y - forecast) / nullif((abs(y) + abs(forecast)) / 2, 0)) AS smape FROM t WHERE origin > 0 GROUP BY 1, 2, 3, 4) x GROUP BY 1, 2, 3),
c AS (SELECT k, nth FROM (SELECT k, nth, row_number() OVER (PARTITION BY k ORDER BY round(mase, 9), nth) AS r FROM b) x WHERE r = 1),
z AS (SELECT t.* FROM t JOIN c ON c.k = t.k AND c.nth = t.nth), w AS (SELECT k, quantile_cont(y - forecast, 0.1) AS lo, quantile_cont(y - forecast, 0.9) AS hi FROM z WHERE origin > 0 GROUP BY k)"""
_FORECAST = _SQL + " SELECT z.k AS make, method, CAST(step AS INT) AS step, round(forecast + lo, 3) AS p10, round(forecast, 3) AS p50, round(forecast + hi, 3) AS p90 FROM z JOIN w ON w.k = z.k WHERE origin = 0"


def _rounded(found: DataFrame) -> DataFrame:
    return found.select(F.col("k").alias("make"), "method", "step", *(F.round(c, 3).alias(c) for c in ("p10", "p50", "p90")))


frame("sco20_forecast", ["recent"], lambda d: _FORECAST)(lambda v: _rounded(forecasts(prices(v))))
frame("sco20_backtest", ["recent"], lambda d: _SQL + " SELECT k AS make, method, round(mase, 5) AS mase, round(smape, 4) AS smape FROM b")(
    lambda v: backtest(predictions(prices(v))).select(F.col("k").alias("make"), "method", F.round("mase", 5).alias("mase"), F.round("smape", 4).alias("smape"))
)
frame("qry26_forecast_summary", ["recent"], lambda d: f"SELECT count(*) AS series, round(max(p50), 2) AS highest, round(min(p50), 2) AS lowest FROM ({_FORECAST}) f WHERE step = 7")(
    lambda v: _rounded(forecasts(prices(v))).where("step = 7").agg(F.count("*").alias("series"), F.round(F.max("p50"), 2).alias("highest"), F.round(F.min("p50"), 2).alias("lowest"))
)

"""Filters, pages and point look-ups over listings (FLT, SRT, QRY)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import both, frame

STOP_WORDS = ("the", "and", "with", "for", "under", "near", "from", "car", "cars")


def search(listings: DataFrame, *, country=None, make=None, model=None, year=None, price=None, km=None, score=None) -> DataFrame:
    """Conjunction of the predicates that are given. ``year``, ``price``, ``km``: (least, most), either may be None."""
    tests: list[Column] = []
    if country:
        tests.append(F.upper("country_code") == country.upper())
    if make:
        tests.append(F.upper("make") == make.upper())
    if model:
        tests.append(F.upper("model").contains(model.upper()))
    for column, bounds in (("year", year), ("price_gross_eur", price), ("mileage_km", km)):
        low, high = bounds or (None, None)
        if low is not None:
            tests.append(F.col(column) >= low)
        if high is not None:
            tests.append(F.col(column) <= high)
    if score is not None:
        tests.append(F.col("confidence_score") >= score / 100)
    return reduce(DataFrame.filter, tests, listings)


def page(df: DataFrame, number: int, size: int = 25, *order: Column) -> DataFrame:
    """Page ``number`` (from 1) in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def word_search(listings: DataFrame, phrase: str) -> DataFrame:
    """Any word of at least three letters, but stop words, occurs in make or model; no such word: nothing is filtered."""
    words = [w for w in phrase.lower().split() if len(w) >= 3 and w not in STOP_WORDS]
    if not words:
        return listings
    hits = [F.lower(c).contains(w) for w in words for c in ("make", "model")]
    return listings.where(reduce(lambda a, b: a | b, hits))


_COLS = ["vehicle_id", "make", "model", "year", "price_gross_eur", "country_code"]
_SEL = ", ".join(_COLS)

frame("flt01_search", ["listing"], lambda d: f"SELECT {_SEL} FROM listing WHERE country_code = 'DE' AND make = 'BMW' AND model LIKE '%M1%' AND year BETWEEN 2018 AND 2019 AND price_gross_eur <= 60000 AND mileage_km >= 20000 AND confidence_score >= 0.92")(
    lambda v: search(v, country="de", make="bmw", model="m1", year=(2018, 2019), price=(None, 60000), km=(20000, None), score=92).select(_COLS)
)
frame("flt02_word_search", ["listing"], lambda d: f"SELECT {_SEL} FROM listing WHERE (lower(make) LIKE '%audi%' OR lower(model) LIKE '%audi%')")(
    lambda v: word_search(v, "the Audi for me").select(_COLS)
)
frame("srt01_page", ["listing"], lambda d: f"SELECT {_SEL} FROM listing WHERE make = 'Audi' ORDER BY indexed_at DESC, vehicle_id LIMIT 25 OFFSET 25")(
    lambda v: page(search(v, make="Audi"), 2, 25, F.desc("indexed_at"), F.asc("vehicle_id")).select(_COLS)
)
both("flt04_viable", lambda d: f"SELECT vehicle_id FROM vehicle WHERE make <> '' AND model <> '' AND year BETWEEN 1920 AND 2027 AND {d.rx('source_url', '^https?://[^/]+/+[^/]')}")
both("flt05_price_band", lambda d: "SELECT fuel_type, count(*) AS n FROM vehicle WHERE price_gross_eur BETWEEN 500 AND 2000000 GROUP BY fuel_type")
both("flt06_series_rows", lambda d: "SELECT country_code, count(*) AS n FROM listing WHERE price_gross_eur > 500 AND price_gross_eur < 500000 AND year >= 1990 AND country_code IN ('DE','FR','ES','NL','BE','CH','IT','AT') GROUP BY country_code")
both("flt07_not_excluded", lambda d: "SELECT dealer_id, count(*) AS n FROM vehicle WHERE status NOT IN ('REJECTED', 'DUPLICATE') GROUP BY dealer_id")
both("flt12_pending_dealers", lambda d: f"""SELECT d.dealer_id, x.last FROM dealer d LEFT JOIN (SELECT dealer_id, max(indexed_at) AS last FROM recent GROUP BY dealer_id) x ON d.dealer_id = x.dealer_id
WHERE x.last IS NULL OR x.last < {d.now} - INTERVAL 2 DAY ORDER BY x.last, d.dealer_id LIMIT 50""")
both("flt13_stale_vat", lambda d: f"SELECT dealer_id FROM dealer WHERE vies_status = 'none' OR last_confirmed_at < CAST({d.now} - INTERVAL 90 DAY AS DATE)")
both("srt10_first_success", lambda d: """SELECT vin, source_platform, priority FROM (SELECT vin, source_platform, CASE source_platform WHEN 'src0' THEN 1500 WHEN 'src1' THEN 1000 WHEN 'src2' THEN 500 ELSE 0 END AS priority,
  row_number() OVER (PARTITION BY vin ORDER BY CASE source_platform WHEN 'src0' THEN 1500 WHEN 'src1' THEN 1000 WHEN 'src2' THEN 500 ELSE 0 END DESC, vehicle_id) AS n FROM vehicle WHERE status = 'ACTIVE') x WHERE n = 1""")
both("srt09_retry_queue", lambda d: f"SELECT event_id, k, ts + INTERVAL 1 HOUR * CAST(power(2, CAST(k AS INT) % 5) AS INT) AS due FROM event WHERE event_type = 'purchase' AND CAST(k AS INT) % 5 < 4 ORDER BY due, event_id LIMIT 50")
both("srt12_vin_prefix", lambda d: "SELECT vin, vehicle_id FROM vehicle WHERE vin LIKE 'W0L00000X%' ORDER BY indexed_at DESC, vehicle_id LIMIT 20")
both("qry09_vehicle_page", lambda d: "SELECT vehicle_id, total FROM (SELECT vehicle_id, lot, count(*) OVER () AS total FROM vehicle WHERE dealer_id = 3) x ORDER BY lot, vehicle_id LIMIT 10")
both("qry12_kpi", lambda d: "SELECT count(CASE WHEN status = 'ACTIVE' THEN 1 END) AS active, count(DISTINCT CASE WHEN sold_at IS NULL THEN dealer_id END) AS open_dealers FROM vehicle")
both("qry13_messages", lambda d: f"SELECT conv_id, turn, role FROM {d.base('conversations')} WHERE conv_id = 2 ORDER BY turn")
both("qry16_calendar", lambda d: f"SELECT event_id, ts FROM event WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' AND event_type <> 'error'" if d.name == "duckdb" else "SELECT event_id, ts FROM event WHERE ts >= TIMESTAMP_NTZ'2024-01-10 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-12 00:00:00' AND event_type <> 'error'")

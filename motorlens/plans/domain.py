"""Domain tables (dealers, vehicles, events, ledgers) derived from the driver's star schema, as SQL for both dialects.

The mapping is synthetic: it exercises the operators, it doesn't imitate a market. "Now" is pinned by the dialect, so
nothing depends on the clock.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .dialect import DUCK, SPARK, Spark

COUNTRIES = ("DE", "FR", "ES", "NL", "BE", "CH")
# VAT rates.
VAT = {"DE": 0.19, "FR": 0.20, "ES": 0.21, "NL": 0.21, "BE": 0.21, "CH": 0.081}
# Transport costs in cents between countries (both ways).
TRANSPORT = {
    "DE-FR": 75000, "DE-ES": 150000, "DE-NL": 45000, "DE-BE": 50000, "DE-CH": 60000, "FR-ES": 90000, "FR-NL": 80000, "FR-BE": 35000,
    "FR-CH": 60000, "ES-NL": 180000, "ES-BE": 160000, "ES-CH": 170000, "NL-BE": 30000, "NL-CH": 85000, "BE-CH": 75000,
}
# Days to sell by country.
SELL_DAYS = {"DE": 28, "FR": 35, "NL": 21, "BE": 30, "ES": 42, "CH": 25}
# Weight of each source family in a dealer's confidence.
FAMILIES = {"A": 0.35, "B": 0.15, "C": 0.10, "D": 0.0, "E": 0.05, "F": 0.20, "G": 0.20, "H": 0.25, "I": 0.05, "J": 0.05, "K": 0.05, "L": 0.10, "M": 0.0, "N": 0.05, "O": 0.05}

_COUNTRY = "CASE {} % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(COUNTRIES)) + " END"
_MAKE = "CASE CAST(length(p_type) + p_size AS INT) % 6 WHEN 0 THEN 'BMW' WHEN 1 THEN 'Volkswagen' WHEN 2 THEN 'Renault' WHEN 3 THEN 'Peugeot' WHEN 4 THEN 'Audi' ELSE 'Toyota' END"


def _cents(x: str) -> str:
    return f"CAST(CAST(round({x} * 100) AS BIGINT) AS STRING)"


def _pairs(d: Spark, pairs, names: str) -> str:
    return d.values(", ".join(pairs), names)


_DIGITS = " + ".join(f"(CAST(floor(n / {10 ** (7 - i)}.0) AS BIGINT) % 10) * {9 - i}" for i in range(8))

_MODELS = {"BMW": ("3 Series", "320d", "X5"), "Audi": ("A3", "A4", "Q5"), "Volkswagen": ("Golf", "Passat", "Polo"), "Renault": ("Clio", "Megane", "Kadjar"), "Peugeot": ("208", "308", "3008"), "Toyota": ("Yaris", "Corolla", "Prius")}
_CODES = {"BMW": "BMW3", "Audi": "AUA4", "Volkswagen": "vwgo", "Renault": "RECL", "Peugeot": "PE20", "Toyota": "TYYA"}


def _first_words(d: Spark, n: int) -> str:
    """The first words of a document, by single blanks."""
    return f"array_join(slice(split(text, ' '), 1, {n}), ' ')" if d.name == "spark" else f"array_to_string(string_split(text, ' ')[1:{n}], ' ')"


def _letters(d: Spark, x: str) -> str:
    """Lower-case ASCII letters only."""
    return f"regexp_replace(lower({x}), '[^a-z]', ''{'' if d.name == 'spark' else ", 'g'"})"


#: For Spark: as many rows for a listing as its dealer has (one without a dealer), with nothing of the dealer. Only repeated dealers are joined.
_DEALER_ROWS = "(SELECT /*+ BROADCAST(d) */ v.* FROM vehicle v LEFT JOIN (SELECT dealer_id, explode(sequence(1L, k)) AS copy FROM (SELECT dealer_id, count(*) AS k FROM dealer GROUP BY dealer_id HAVING count(*) > 1) w) d ON v.dealer_id = d.dealer_id) v"


def _quality_listing(d: Spark, dealers: bool = True) -> str:
    """Listings with all that the validators look at; odd values are spread over them by lot number. ``dealers``: with the columns of their dealers."""
    model = "CASE v.make " + " ".join(f"WHEN '{m}' THEN CASE lot % 3 WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' ELSE '{c}' END" for m, (a, b, c) in _MODELS.items()) + " END"
    code = "CASE make " + " ".join(f"WHEN '{m}' THEN '{c}'" for m, c in _CODES.items()) + " END"
    photo = {
        "status": "CASE (lot + i) % 41 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END", "type": "CASE (lot * 3 + i) % 53 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/avif' ELSE 'Image/JPEG; q=1' END",
        "bytes": "CASE (lot + 2 * i) % 31 WHEN 0 THEN 20000 WHEN 1 THEN 2000000 ELSE 300000 END", "width": "CASE (lot + 5 * i) % 29 WHEN 0 THEN 640 WHEN 1 THEN 0 ELSE 1200 END", "height": "900", "magic": "CASE (lot + 7 * i) % 59 WHEN 0 THEN '00000000' ELSE 'ffd8ffe0' END",
    }
    return f"""SELECT q.*, {d.listed("photo_count", photo)} AS photos,
  CASE lot % 6 WHEN 0 THEN concat(make, ' ', model, ' ', CAST(year AS STRING)) WHEN 1 THEN concat(substr(make, 1, CAST(length(make) AS INT) - 1), 'x ', model, ' sport') WHEN 2 THEN concat('Voiture occasion ', model, ' diesel') WHEN 3 THEN ' ' WHEN 4 THEN concat(make, ' premium automatique') ELSE concat(upper(make), ' ', model, ' ', CAST(year + 1 AS STRING)) END AS title,
  CASE lot % 8 WHEN 0 THEN ' ' WHEN 1 THEN concat('Lorem ipsum dolor sit amet for this ', make) WHEN 2 THEN concat('A short text, ', make) WHEN 3 THEN concat('This ', make, ' ', model, ' is for sale with the full service history from our own fleet.') WHEN 4 THEN concat('Der ', make, ' ', model, ' ist ein gepflegtes Fahrzeug und die Ausstattung ist komplett mit Klima.')
   WHEN 5 THEN concat('Great car for the city! ', make, ' ', model, '. Great car, for the city. Great car for the CITY.') WHEN 6 THEN 'La voiture est avec les options pour la route dans le sud et un grand coffre.' ELSE concat('El ', make, ' ', model, ' con extras para la familia, por este precio, una ganga del mes.') END AS description,
  CASE lot % 5 WHEN 0 THEN '' ELSE concat(coalesce({code}, 'XX'), CAST(lot AS STRING)) END AS dat_code, {d.xor(d.hash60("CAST(n // 10 AS STRING)" if d.name == "duckdb" else "CAST(n div 10 AS STRING)"), "CASE WHEN (n // 10) % 2 = 0 THEN 21 * (n % 10) * 1024 ELSE n % 10 END".replace("//", d.div))} AS phash
FROM (SELECT v.vehicle_id, v.vin, v.lot, CAST(substr(v.vin, 10, 8) AS BIGINT) AS n, CASE WHEN lot % 101 = 0 THEN '' ELSE v.make END AS make, CASE WHEN lot % 101 = 0 THEN '' ELSE {model} END AS model, CAST(CASE WHEN lot % 101 = 0 THEN 0 WHEN lot % 83 = 0 THEN 0 WHEN lot % 83 = 1 THEN 1890 WHEN lot % 83 = 2 THEN 2022 WHEN lot % 83 = 3 THEN 2030 WHEN lot % 83 = 4 THEN 2010 ELSE year END AS INT) AS year,
  CAST(CASE lot % 89 WHEN 0 THEN 0 WHEN 1 THEN 600000 WHEN 2 THEN 50 ELSE mileage_km END AS INT) AS mileage_km, CASE WHEN lot % 101 = 0 OR lot % 97 = 0 THEN 0 WHEN lot % 97 = 1 THEN -5 WHEN lot % 97 = 2 THEN 2000000 ELSE CAST(floor(price_gross_eur) AS BIGINT) END AS price_eur, fuel_type,
  CASE lot % 3 WHEN 0 THEN '' ELSE 'manual' END AS transmission, CAST(CASE WHEN lot % 13 = 0 OR lot % 101 = 0 THEN 0 ELSE photo_count END AS INT) AS photo_count, CASE lot % 71 WHEN 0 THEN '' ELSE source_url END AS source_url, v.dealer_id, {"d.country_code AS source_country, " if dealers else ""}v.indexed_at AS extracted_at, lot % 19 = 0 AS is_archive,
  CASE lot % 9 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 301 WHEN 3 THEN 503 WHEN 4 THEN -1 WHEN 5 THEN 403 ELSE 200 END AS http_status, CASE lot % 11 WHEN 0 THEN '<b>Vehicle SOLD</b>' WHEN 1 THEN '{{"availability": "https://schema.org/SoldOut"}}' WHEN 2 THEN 'Nicht mehr verfügbar' ELSE 'Available now' END AS body,
  CASE lot % 17 WHEN 0 THEN true WHEN 1 THEN false END AS ai_disclosed{", CASE WHEN d.status = 'ACTIVE' THEN d.confidence_score END AS dealer_confidence, CASE WHEN d.dealer_id % 11 = 0 THEN DATE'2001-09-20' ELSE d.first_discovered_at END AS dealer_since" if dealers else ""}
FROM {"vehicle v LEFT JOIN dealer d ON v.dealer_id = d.dealer_id" if dealers else _DEALER_ROWS}) q"""


#: name -> SQL text for a dialect. Texts name other views and, by ``d.base``, the driver's tables.
VIEWS = {
    "dealer": lambda d: f"""SELECT s_suppkey AS dealer_id, s_name AS canonical_name, {_COUNTRY.format("s_nationkey")} AS country_code,
  round((s_acctbal + 1000) / 11000, 4) AS confidence_score, CASE WHEN s_suppkey % 5 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
  {d.days("DATE'1996-01-01'", "s_suppkey % 2000")} AS first_discovered_at, {d.days("DATE'2001-01-01'", "s_suppkey % 365")} AS last_confirmed_at,
  CASE s_suppkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'unchecked' WHEN 2 THEN 'invalid' ELSE 'none' END AS vies_status
FROM {d.base("supplier")}""",
    "vehicle": lambda d: f"""SELECT md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING),
    {_cents("l_quantity")}, {_cents("l_extendedprice")}, {_cents("l_discount")}, {_cents("l_tax")}, l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS STRING))) AS vehicle_id,
  concat('W0L00000', CASE WHEN n % 2 = 1 THEN '0' WHEN chk = 10 THEN 'X' ELSE CAST(chk AS STRING) END, lpad(CAST(n AS STRING), 8, '0')) AS vin,
  l_suppkey AS dealer_id, {_MAKE} AS make, concat('M', CAST(CAST(length(p_brand) + p_size AS INT) % 5 AS STRING)) AS model, 2018 + CAST(p_size AS INT) % 3 AS year,
  CAST(l_quantity * 4000 AS INT) AS mileage_km, l_extendedprice AS price_gross_eur, CASE l_returnflag WHEN 'A' THEN 'electric' WHEN 'N' THEN 'diesel' ELSE 'gasoline' END AS fuel_type,
  l_shipdate AS indexed_at, l_shipdate + INTERVAL 3 DAY AS ttl_expires_at, CASE WHEN l_linestatus = 'F' THEN 'ACTIVE' ELSE 'REJECTED' END AS status, round(1 - l_discount, 2) AS confidence_score,
  CASE WHEN l_tax >= 0.04 THEN l_shipdate + INTERVAL 40 DAY END AS sold_at, l_linenumber AS photo_count, concat('src', CAST(l_orderkey % 4 AS STRING)) AS source_platform,
  concat('https://cars.example/', CAST(l_suppkey AS STRING), '/', CAST(n AS STRING)) AS source_url, l_orderkey AS lot
FROM (SELECT *, (66 + {_DIGITS}) % 11 AS chk FROM (SELECT *, l_partkey * 10 + l_linenumber AS n FROM {d.base("lineitem")} JOIN {d.base("part")} ON l_partkey = p_partkey) w) x""",
    "recent": lambda d: f"SELECT * FROM vehicle WHERE indexed_at <= {d.now}",
    "listing": lambda d: "SELECT v.*, d.country_code, d.canonical_name, d.status AS dealer_status FROM vehicle v JOIN dealer d ON v.dealer_id = d.dealer_id",
    "live_listing": lambda d: "SELECT v.*, d.country_code FROM recent v JOIN dealer d ON v.dealer_id = d.dealer_id",
    "trust_signal": lambda d: f"""SELECT d.dealer_id, d.vies_status, CASE d.dealer_id % 3 WHEN 0 THEN 'registered' WHEN 1 THEN 'unchecked' ELSE 'not_found' END AS registry, d.dealer_id % 9 AS registry_age,
  coalesce({d.percent('v.confidence_score')}, 0) AS v15, coalesce({d.percent('v.confidence_score')}, 0) AS avg_score, count(CASE WHEN v.status = 'ACTIVE' THEN 1 END) AS volume, count(CASE WHEN v.price_gross_eur < 1000 THEN 1 END) AS anomalies,
  {d.between_days("d.first_discovered_at", d.now)} AS tenure_days, CAST(d.last_confirmed_at AS DATE) AS issued_at FROM dealer d LEFT JOIN vehicle v ON v.dealer_id = d.dealer_id GROUP BY d.dealer_id, d.vies_status, d.first_discovered_at, d.last_confirmed_at""",
    "quality_listing": _quality_listing,
    "own_listing": lambda d: _quality_listing(d, False),
    "vin_decode": lambda d: """SELECT vin, min(upper(make)) AS nhtsa_make, min(upper(model)) AS nhtsa_model, max(year) AS nhtsa_year, CASE WHEN min(n) % 5 = 0 THEN '1 - check digit' ELSE '' END AS nhtsa_error
FROM quality_listing WHERE n % 3 <> 0 GROUP BY vin""",
    "document": lambda d: f"SELECT doc_id, text, lang, source FROM {d.base('documents')}",
    "stock": lambda d: "SELECT vehicle_id, make, model, country_code AS origin FROM listing WHERE status = 'ACTIVE'",
    "price": lambda d: f"SELECT make, model, country_code AS country, {d.trunc('round(avg(price_gross_eur) * 100, 3)')} AS cents, count(*) AS n FROM listing WHERE dealer_status = 'ACTIVE' GROUP BY make, model, country_code",
    "tax_request": lambda d: f"""SELECT o_orderkey AS id, a.country AS origin, b.country AS dest, CAST(round(o_totalprice * 10) AS BIGINT) AS price_cents, CAST(o_custkey % 3 * 100000 AS BIGINT) AS margin_cents, o_orderkey % 2 = 0 AS ids_valid,
  CAST(o_orderkey % 11 AS INT) AS age_months, CAST(o_custkey % 40 * 1000 AS INT) AS km FROM {d.base("orders")} JOIN {d.values(", ".join(f"({i}, '{c}')" for i, c in enumerate(COUNTRIES)), "i, country")} a ON a.i = o_orderkey % 6 JOIN {d.values(", ".join(f"({i}, '{c}')" for i, c in enumerate(COUNTRIES)), "i, country")} b ON b.i = o_custkey % 6""",
    "embedding": lambda d: f"SELECT vec_id, embedding, label FROM {d.base('embeddings')}",
    "finding": lambda d: f"""SELECT s_suppkey AS dealer_id, substr('ABCDEFGHIJKLMNO', 1 + CAST((s_suppkey * 7 + k * k) % 15 AS INT), 1) AS family
FROM {d.base("supplier")} CROSS JOIN {d.values("(0), (1), (2), (3), (4)", "k")}""",
    "trade_name": lambda d: f"""SELECT doc_id AS id, concat({_first_words(d, 3)}, CASE doc_id % 4 WHEN 0 THEN ' GmbH' WHEN 1 THEN ' S.A.' WHEN 2 THEN ' Garage' ELSE '' END) AS name,
  CASE lang WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' WHEN 'es' THEN 'ES' ELSE CASE doc_id % 3 WHEN 0 THEN 'BE' WHEN 1 THEN 'CH' ELSE 'NL' END END AS country FROM {d.base("documents")}""",
    "certificate_name": lambda d: f"""SELECT concat(CASE id % 3 WHEN 0 THEN '*.' WHEN 1 THEN 'www.' ELSE '' END, {_letters(d, _first_words(d, 2))}, CASE id % 5 WHEN 0 THEN '-cars' ELSE '' END, '.', lower(country)) AS name_value
FROM (SELECT n.id, x.text, n.country FROM trade_name n JOIN {d.base("documents")} x ON x.doc_id = n.id) y UNION ALL SELECT regexp_extract(url, '^https?://([^/:]+)', 1) FROM {d.base("pages")}""",
    "event": lambda d: f"SELECT event_id, ts, user_id AS listing_id, event_type, value, {d.json('props', 'k')} AS k FROM {d.base('events')}",
    "ledger": lambda d: f"""SELECT l_orderkey AS tenant_vehicle, CASE WHEN l_linenumber = 1 THEN 'purchase' WHEN l_linenumber = 2 THEN 'reconditioning' WHEN l_linenumber = 3 THEN 'transport' ELSE 'sale' END AS type,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents, CASE l_linenumber % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'CHF' ELSE 'GBP' END AS currency, CAST(l_shipdate AS DATE) AS day
FROM {d.base("lineitem")}""",
    "fx": lambda d: f"""SELECT c AS from_currency, {d.days("DATE'1992-01-01'", "i * 91")} AS valid_from, round(r + i * 0.001, 4) AS rate
FROM {d.values("('CHF', 0.9), ('GBP', 1.1)", "c, r")} CROSS JOIN {d.values(", ".join(f"({i})" for i in range(40)), "i")}""",
    "vat": lambda d: _pairs(d, [f"('{c}', {r})" for c, r in VAT.items()], "country, rate"),
    "transport": lambda d: _pairs(d, [f"('{a}', '{b}', {c})" for k, c in TRANSPORT.items() for a, b in (k.split("-"), k.split("-")[::-1])], "origin, dest, cost"),
    "sell_days": lambda d: _pairs(d, [f"('{c}', {n})" for c, n in SELL_DAYS.items()], "country, days"),
    "family_weight": lambda d: _pairs(d, [f"('{c}', {w})" for c, w in FAMILIES.items()], "family, weight"),
    "country": lambda d: _pairs(d, [f"('{c}')" for c in COUNTRIES], "country"),
    "mileage": lambda d: f"SELECT user_id AS vin, ts, CAST(round(value * 1000) AS BIGINT) AS mileage, event_id FROM {d.base('events')}",
}


def _needed(text: str, d: Spark) -> list[str]:
    """Views that ``text`` names, those they name first."""
    out: list[str] = []

    def visit(body: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b(FROM|JOIN) {name}\b", body, re.IGNORECASE) and name not in out:
                visit(VIEWS[name](d))
                out.append(name)

    visit(text)
    return out


def with_views(text: str, d: Spark) -> str:
    views = [f"{name} AS ({VIEWS[name](d)})" for name in _needed(text, d)]
    if not views:
        return text
    body = text.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {', '.join(views)}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(views)}, {body[5:]}"
    return f"WITH {', '.join(views)} {body}"


#: The JVM never compiles methods of more bytecode than this; below it Spark splits long projections into methods that it does.
METHOD_BYTES = "8000"


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over domain views and, as motorlens_<table>, the driver's tables."""
    whole = with_views(text, SPARK)
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":  # Spark's default
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_BYTES)
    for table in sorted(set(re.findall(r"\bmotorlens_(\w+)\b", whole))):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"motorlens_{table}")
    return spark.sql(whole)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")


def duck_sql(text: str) -> str:
    return with_views(text, DUCK)

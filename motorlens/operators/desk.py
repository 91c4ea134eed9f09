"""The dealer's desk: clean-up, filters, look-ups, tax status, inquiries, queues, histories and forecasts over several rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..plans.domain import VIEWS, duck_sql, view
from ..plans.registry import ORACLES, QUERIES, both, frame
from ..plans.shared import new_path
from . import dealers, feeds, money, quality, storage

# ---------------------------------------------------------------- filters


def post_filters(rows: DataFrame, *, country=None, price_max=None, price_min=None, km_max=None, year_min=None, year_max=None, fuel_type=None) -> DataFrame:
    """Filters after a search; one that is empty or 0 isn't set."""
    tests = [
        (country, lambda v: F.upper("country_code") == v.upper()), (price_max, lambda v: F.col("price_gross_eur") <= v), (price_min, lambda v: F.col("price_gross_eur") >= v), (km_max, lambda v: F.col("mileage_km") <= v),
        (year_min, lambda v: F.col("year") >= v), (year_max, lambda v: F.col("year") <= v), (fuel_type, lambda v: F.lower("fuel_type") == v.lower()),
    ]
    return reduce(lambda df, t: df.where(t[1](t[0])) if t[0] else df, tests, rows)


frame("flt03_optional_filters", ["listing"], lambda d: "SELECT vehicle_id, make, year, price_gross_eur FROM listing WHERE lower(fuel_type) = 'electric' AND price_gross_eur <= 30000 AND year >= 2019")(
    lambda v: post_filters(v, fuel_type="Electric", price_max=30000, price_min=0, km_max=0, year_min=2019).select("vehicle_id", "make", "year", "price_gross_eur")
)

REQUIRED = ("make", "model", "price_eur", "thumbnail_url", "description", "year", "mileage_km")


def completeness(rows: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Each row with ``action``: keep, or delete where a required field is null, empty or 0."""
    there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "0.0")
    return rows.withColumn("action", F.when(reduce(lambda a, b: a | b, map(there, required)), "delete").otherwise("keep"))


frame("flt08_completeness_gate", ["quality_listing"], lambda d: "SELECT vehicle_id, CASE WHEN make = '' OR model = '' OR price_eur = 0 OR photo_count = 0 OR description = '' OR year = 0 OR mileage_km = 0 THEN 'delete' ELSE 'keep' END AS action FROM quality_listing")(
    lambda v: completeness(v.withColumn("thumbnail_url", F.when(F.col("photo_count") > 0, "t").otherwise(""))).select("vehicle_id", "action")
)

IMAGE = r"(?i)\.(?:jpg|jpeg|png|webp|gif|bmp|svg|pdf)(?:\?|$)"


def junk_links(pages: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose link is an image or matches one of its own host's patterns (host, pattern: a few hundred rows)."""
    host = F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)
    own = patterns.groupBy("host").agg(F.collect_list("pattern").alias("__patterns")).withColumnRenamed("host", "__host")
    met = pages.join(F.broadcast(own), host == F.col("__host"), "left")
    hit = F.exists(F.coalesce("__patterns", F.array().cast("array<string>")), lambda p: F.rlike(url, p))
    return met.where(F.rlike(url, F.lit(IMAGE)) | hit).drop("__host", "__patterns")


VIEWS["link"] = lambda d: f"SELECT page_id, CASE WHEN page_id % 7 = 0 THEN concat('https://img.example.org/p/', CAST(page_id AS STRING), '.JPG?w=1') WHEN page_id % 5 = 0 THEN 'https://cars.example.net/stock/audi/' WHEN page_id % 3 = 0 THEN concat('https://cars.example.net/stock/audi/a4-', CAST(page_id AS STRING)) ELSE url END AS url FROM {d.base('pages')}"
VIEWS["link_pattern"] = lambda d: d.values("('cars.example.net', '/stock/[^/]+/?$'), ('cars.example.net', '/about'), ('other.example', '/stock/')", "host, pattern")
frame("flt09_junk_urls", ["link", "link_pattern"], lambda d: r"SELECT page_id FROM link WHERE regexp_matches(url, '\.(jpg|jpeg|png|webp|gif|bmp|svg|pdf)(\?|$)', 'i') OR (url LIKE 'https://cars.example.net/%' AND (regexp_matches(url, '/stock/[^/]+/?$') OR url LIKE '%/about%')) OR (url LIKE 'https://other.example/%' AND url LIKE '%/stock/%')")(
    lambda pages, patterns: junk_links(pages, patterns).select("page_id")
)
both("flt10_scam_price", lambda d: "SELECT vehicle_id, price_eur FROM quality_listing WHERE price_eur < 500 OR price_eur > 2000000")
VIEWS["gallery"] = lambda d: f"SELECT vehicle_id, {'array' if d.name == 'spark' else 'list_value'}(concat(source_url, '/1.jpg'), concat(' ', source_url, '/2.jpg#top'), concat(source_url, '/2.jpg'), 'data:image/png;x', concat('https://t.example/1x1/', CAST(lot AS STRING)), concat(source_url, '/logo.svg'), CASE WHEN lot % 2 = 0 THEN concat(source_url, '/1.jpg') ELSE concat(source_url, '/Pixel.gif') END, '') AS urls FROM vehicle"
frame("flt11_photo_cleanup", ["gallery"], lambda d: "SELECT vehicle_id, urls[1] || '|' || urls[3] AS photos FROM gallery")(lambda g: g.select("vehicle_id", F.array_join(text.clean_photos("urls"), "|").alias("photos")))
VIEWS["conversation"] = lambda d: f"SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn, CASE conv_id % 5 WHEN 0 THEN 'spam' WHEN 1 THEN 'closed' ELSE 'open' END AS status FROM {d.base('conversations')} GROUP BY conv_id"


def inbox(conversations: DataFrame, status: str | None = None, page: int = 0, size: int = 20) -> DataFrame:
    """A page (from 0) of conversations, latest first; without a status all but spam."""
    own = conversations.where(F.col("status") == status) if status else conversations.where("status <> 'spam'")
    return own.orderBy(F.desc("last_turn"), "conv_id").offset(page * size).limit(size)


frame("flt15_inbox", ["conversation"], lambda d: "SELECT conv_id, n_turns, last_turn, status FROM conversation WHERE status <> 'spam' ORDER BY last_turn DESC, conv_id LIMIT 20 OFFSET 20")(lambda c: inbox(c, page=1))


def scoped(rows: DataFrame, tenant, column: str = "dealer_id") -> DataFrame:
    """Rows of one tenant; there is no way to ask for all."""
    if tenant is None:
        raise ValueError("a tenant is required")
    return rows.where(F.col(column) == F.lit(tenant))


frame("flt16_tenant", ["vehicle"], lambda d: "SELECT vehicle_id, price_gross_eur FROM vehicle WHERE dealer_id = 7 AND status = 'ACTIVE'")(lambda v: scoped(v, 7).where("status = 'ACTIVE'").select("vehicle_id", "price_gross_eur"))

# ---------------------------------------------------------------- joins and aggregates

both("jon07_anti", lambda d: "SELECT v.vehicle_id FROM vehicle v WHERE NOT EXISTS (SELECT 1 FROM event e WHERE e.event_id = v.lot AND e.event_type <> 'error')")
frame("jon14_prefix_baseline", ["quality_listing"], lambda d: f"SELECT make, model, year, p25, p75 FROM (SELECT *, (SELECT min_by(p25, i) {{0}}) AS p25, (SELECT min_by(p75, i) {{0}}) AS p75 FROM (SELECT DISTINCT upper(make) AS make, upper(model) AS model, year FROM quality_listing) q) x WHERE p25 IS NOT NULL".replace("{0}", "FROM (VALUES " + ", ".join(f"({i}, '{r[0]}', '{r[1]}', {r[2]}, {r[3]}, {r[4]}, {r[6]})" for i, r in enumerate(quality.PRICES)) + ") t(i, mk, mo, lo, hi, p25, p75) WHERE t.mk = q.make AND (starts_with(q.model, t.mo) OR starts_with(t.mo, q.model)) AND (q.year = 0 OR q.year BETWEEN t.lo AND t.hi)"))(
    lambda v: quality._cohort_rules(v, list(quality.PRICES), ["p25", "p50", "p75"]).select(F.col("__make").alias("make"), F.col("__model").alias("model"), F.col("__year").alias("year"), "p25", "p75")
)


def providers(tables: dict[str, DataFrame]) -> DataFrame:
    """Reports of several registries on a VIN, side by side: the names of those that know it, in order, and their rows."""
    rows = reduce(DataFrame.unionByName, [t.select("vin", F.lit(n).alias("provider")) for n, t in tables.items()]).groupBy("vin", "provider").agg(F.count("*").alias("n"))
    return rows.groupBy("vin").agg(F.array_join(F.array_sort(F.collect_list("provider")), ",").alias("providers"), F.sum("n").alias("n"))


frame("jon21_providers_merged", ["vehicle", "vin_decode"], lambda d: "WITH u AS (SELECT vin, 'sighting' AS p FROM vehicle UNION ALL SELECT vin, 'decode' FROM vin_decode UNION ALL SELECT vin, 'sale' FROM vehicle WHERE sold_at IS NOT NULL) SELECT vin, string_agg(DISTINCT p, ',' ORDER BY p) AS providers, count(*) AS n FROM u GROUP BY vin")(
    lambda v, decoded: providers({"sighting": v, "decode": decoded, "sale": v.where("sold_at is not null")})
)
both("agg16_vin_dealers", lambda d: f"SELECT vin, n, dealers, urls, CASE WHEN dealers > 5 THEN 'CRITICAL' WHEN dealers >= 2 THEN 'WARNING' ELSE 'INFO' END AS severity FROM (SELECT vin, CAST(sum(k) AS BIGINT) AS n, count(DISTINCT dealer_id) AS dealers, {d.joined('source_url', 'source_url')} AS urls FROM (SELECT vin, dealer_id, source_url, count(*) AS k FROM vehicle GROUP BY vin, dealer_id, source_url) y GROUP BY vin) x")
both("agg25_wip", lambda d: f"SELECT l.type, coalesce(n, 0) AS cards, l.most, coalesce(n, 0) > l.most AS over_limit FROM {d.values('(' + repr('purchase') + ', 1500), (' + repr('reconditioning') + ', 900), (' + repr('transport') + ', 100000), (' + repr('handover') + ', 5)', 'type, most')} l LEFT JOIN (SELECT type, count(*) AS n FROM ledger GROUP BY type) x ON x.type = l.type")
both("agg38_ticker", lambda d: f"""WITH c AS (SELECT make, model, {d.between_days("DATE'1990-01-01'", "date_trunc('week', indexed_at)")} AS w, {d.pct}(price_gross_eur, 0.5) AS close FROM recent GROUP BY 1, 2, 3),
v AS (SELECT make, model, count(*) AS volume_30d, round(avg({d.between_days('indexed_at', 'coalesce(sold_at, indexed_at + INTERVAL 60 DAY)')}), 4) AS dom_30d FROM recent WHERE indexed_at >= {d.now} - INTERVAL 30 DAY GROUP BY 1, 2), l AS (SELECT make, model, max(w) AS w FROM c GROUP BY 1, 2),
q AS (SELECT l.make, l.model, a.close AS last_price, max(CASE WHEN b.w = l.w - 7 THEN b.close END) AS c1w, max(CASE WHEN b.w = l.w - 28 THEN b.close END) AS c1m, max(CASE WHEN b.w = l.w - 91 THEN b.close END) AS c3m FROM l JOIN c a ON a.make = l.make AND a.model = l.model AND a.w = l.w JOIN c b ON b.make = l.make AND b.model = l.model AND b.w IN (l.w, l.w - 7, l.w - 28, l.w - 91) GROUP BY l.make, l.model, a.close)
SELECT q.make, q.model, round(last_price, 4) AS last_price, round(100 * (last_price - c1w) / c1w, 4) AS change_1w, round(100 * (last_price - c1m) / c1m, 4) AS change_1m, round(100 * (last_price - c3m) / c3m, 4) AS change_3m, coalesce(volume_30d, 0) AS volume_30d, coalesce(dom_30d, 0) AS dom_30d FROM q LEFT JOIN v ON v.make = q.make AND v.model = q.model""")
both("agg42_coverage", lambda d: f"""WITH o AS (SELECT country_code, count(*) AS observed, avg({d.between_days('indexed_at', 'coalesce(sold_at, indexed_at + INTERVAL 60 DAY)')}) AS dom FROM listing GROUP BY 1)
SELECT o.country_code, observed, round(fleet * turnover * dom / 365, 4) AS expected_for_sale, round(observed / (fleet * turnover * dom / 365), 6) AS coverage FROM o JOIN {d.values("('DE', 480000.0, 0.15), ('FR', 390000.0, 0.14), ('ES', 250000.0, 0.12), ('NL', 89000.0, 0.21), ('BE', 59000.0, 0.16), ('CH', 47000.0, 0.18)", "country, fleet, turnover")} f ON f.country = o.country_code""".replace("fleet * turnover", "CAST(fleet AS DOUBLE) * CAST(turnover AS DOUBLE)"))
both("agg43_capture_recapture", lambda d: """WITH s AS (SELECT DISTINCT vin, source_platform AS src FROM vehicle), n AS (SELECT src, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY src),
m AS (SELECT a.src AS a, b.src AS b, CAST(count(*) AS DOUBLE) AS m FROM s a JOIN s b ON a.vin = b.vin AND a.src < b.src GROUP BY 1, 2),
e AS (SELECT m.a, m.b, x.n AS n1, y.n AS n2, m, (x.n + 1) * (y.n + 1) / (m + 1) - 1 AS chapman, (x.n + 1) * (y.n + 1) * (x.n - m) * (y.n - m) / ((m + 1) * (m + 1) * (m + 2)) AS variance FROM m JOIN n x ON x.src = m.a JOIN n y ON y.src = m.b)
SELECT a AS source_a, b AS source_b, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, CAST(m AS BIGINT) AS m, round(n1 * n2 / m, 4) AS lincoln_petersen, round(chapman, 4) AS chapman, round(variance, 3) AS variance, round(chapman - 1.96 * sqrt(variance), 3) AS low, round(chapman + 1.96 * sqrt(variance), 3) AS high FROM e""")
both("agg44_pricing_cube", lambda d: "SELECT coalesce(make, 'all') AS make, coalesce(country_code, 'all') AS country, count(*) AS n, round(sum(price_gross_eur), 2) AS price_sum, min(price_gross_eur) AS price_min, max(price_gross_eur) AS price_max, count(sold_at) AS sold, round(CAST(count(sold_at) AS DOUBLE) / count(*), 6) AS sell_through, count(CASE WHEN status = 'REJECTED' THEN 1 END) AS rejected, round(sum(confidence_score), 2) AS confidence_sum FROM listing GROUP BY CUBE (make, country_code)")
both("win06_cohort_residual", lambda d: """SELECT vehicle_id, round(y - my - coalesce(sxy / nullif(sxx, 0), 0) * (x - mx), 2) AS residual FROM (SELECT *, sum((x - mx) * (y - my)) OVER p AS sxy, sum((x - mx) * (x - mx)) OVER p AS sxx FROM (SELECT vehicle_id, make, model, year, CAST(mileage_km AS DOUBLE) AS x, price_gross_eur AS y, avg(CAST(mileage_km AS DOUBLE)) OVER w AS mx, avg(price_gross_eur) OVER w AS my
 FROM vehicle WHERE fuel_type = 'electric' WINDOW w AS (PARTITION BY make, model, year)) a WINDOW p AS (PARTITION BY make, model, year)) b""")
both("win10_prior_month", lambda d: f"WITH m AS (SELECT year(day) * 12 + month(day) AS m, count(*) AS n FROM ledger WHERE type = 'sale' GROUP BY 1), b AS (SELECT min(m) AS a, max(m) AS z FROM m), s AS (SELECT {'explode(sequence(a, z))' if d.name == 'spark' else 'unnest(range(a, z + 1))'} AS m FROM b) SELECT s.m, coalesce(x.n, 0) AS n, coalesce(x.n, 0) - coalesce(p.n, 0) AS change FROM s LEFT JOIN m x ON x.m = s.m LEFT JOIN m p ON p.m = s.m - 1")
both("win13_rolling_month", lambda d: "SELECT make, day, n, CAST(sum(n) OVER w AS BIGINT) AS volume_30d, round(CAST(sum(dom) OVER w AS DOUBLE) / sum(n) OVER w, 4) AS dom_30d FROM (SELECT make, CAST(CAST(indexed_at AS DATE) AS STRING) AS day, {0} AS k, count(*) AS n, sum({1}) AS dom FROM recent GROUP BY 1, 2, 3) x WINDOW w AS (PARTITION BY make ORDER BY k RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)".format(d.between_days("DATE'1990-01-01'", "indexed_at"), d.between_days("indexed_at", "coalesce(sold_at, indexed_at + INTERVAL 60 DAY)")))

# ---------------------------------------------------------------- sorts and searches

frame("srt05_two_keys", ["tax_request"], lambda d: f"SELECT id, regime, vat_cents, total_cents, place FROM ({ORACLES['sco09_vat_regimes']}) r WHERE place = 1")(lambda r: money.vat_regimes(r).where("place = 1").select("id", "regime", "vat_cents", "total_cents", "place"))


def lexical_score(query: str, document: Column) -> Column:
    """Share of the query's words that a document holds."""
    words = sorted(set(query.lower().split()))
    have = F.array_distinct(text.tokens(document))
    return sum((F.array_contains(have, w).cast("int") for w in words), F.lit(0)) / len(words) if words else F.lit(0.0)


def reranked(hits: DataFrame, score: Column | None, order: str = "rank") -> DataFrame:
    """Hits by a second score, those of equal score as they were; without a score as they were. Adds ``place``."""
    by = [F.desc("__score"), F.asc(order)] if score is not None else [F.asc(order)]
    # A page of hits: one window over a few rows.
    return hits.withColumn("__score", score if score is not None else F.lit(0.0)).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by))).drop("__score")


VIEWS["hit"] = lambda d: "SELECT vehicle_id, rank, concat_ws(' ', make, model, fuel_type, country_code) AS doc FROM (SELECT vehicle_id, make, model, fuel_type, country_code, row_number() OVER (ORDER BY price_gross_eur DESC, vehicle_id) AS rank FROM listing) x WHERE rank <= 50"
frame("srt07_rerank", ["hit"], lambda d: "SELECT vehicle_id, rank, row_number() OVER (ORDER BY CASE WHEN doc LIKE '%BMW%' THEN 1 ELSE 0 END + CASE WHEN doc LIKE '%diesel%' THEN 1 ELSE 0 END DESC, rank) AS place FROM hit")(lambda h: reranked(h, lexical_score("bmw diesel suv", F.col("doc"))).select("vehicle_id", "rank", "place"))


def by_similarity(vectors: DataFrame, query_id: int, least: float = 0.0) -> DataFrame:
    """All other vectors by falling cosine to one of them, ties by id."""
    x = F.col("embedding").cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    one = vectors.where(F.col("vec_id") == query_id).select(x.alias("q")).limit(1)
    met = vectors.where(F.col("vec_id") != query_id).select("vec_id", x.alias("v")).crossJoin(F.broadcast(one))
    scored = met.select("vec_id", F.round(dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q")), 5).alias("cosine")).where(F.col("cosine") >= least)
    return scored.orderBy(F.desc("cosine"), "vec_id")


frame("srt13_by_similarity", ["embedding"], lambda d: "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embedding) SELECT a.vec_id, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 5) AS cosine FROM v a, v b WHERE b.vec_id = 3 AND a.vec_id <> 3 AND round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 5) >= 0.2")(lambda e: by_similarity(e, 3, 0.2))
frame("srt02_dealers_by_confidence", ["trust_signal"], lambda d: f"SELECT dealer_id, trust_score, tier FROM ({ORACLES['sco03_trust']}) t ORDER BY trust_score DESC, dealer_id LIMIT 50")(lambda s: dealers.trust(s).orderBy(F.desc("trust_score"), "dealer_id").limit(50))

# ---------------------------------------------------------------- tax status, inquiries, frontier

# Words that say the margin scheme holds.
MARGIN_WORDS = ("§25a", "ustg", "margeregeling", "mwst nicht ausweisbar", "rebu", "margen")


def tax_status(rows: DataFrame, cache: DataFrame, *keep: str) -> DataFrame:
    """Status of (id, text, seller, vies): private sellers and margin words give REBU; else what the cache (id, status, confidence)
    is sure of, or an audit where it isn't; else what the VAT register says of a business; else pending."""
    low = F.lower(F.coalesce("text", F.lit("")))
    said = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in MARGIN_WORDS])
    met = rows.join(cache.select(F.col("id").alias("__id"), F.col("status").alias("__status"), "confidence"), F.col("id") == F.col("__id"), "left")
    business = F.when(F.col("vies") == "valid", "DEDUCTIBLE").when(F.col("vies") == "invalid", "REBU").when(F.col("vies") == "timeout", "PENDING_VIES_OPTIMISTIC")
    out = F.when((F.col("seller") == "PRIVATE") | said, "REBU").when(F.col("__id").isNotNull(), F.when(F.col("confidence") >= 0.95, F.col("__status")).otherwise("REQUIRES_HUMAN_AUDIT")).otherwise(F.coalesce(business, F.lit("PENDING")))
    return met.select("id", out.alias("tax_status"), *keep)


VIEWS["sale_text"] = lambda d: f"SELECT doc_id AS id, CASE doc_id % 9 WHEN 0 THEN concat(text, ' Differenzbesteuert nach §25a UStG') WHEN 1 THEN concat(text, ' MARGEREGELING') ELSE text END AS text, CASE doc_id % 6 WHEN 0 THEN 'PRIVATE' ELSE 'B2B' END AS seller, CASE doc_id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' WHEN 2 THEN 'timeout' END AS vies FROM {d.base('documents')}"
VIEWS["tax_cache"] = lambda d: f"SELECT doc_id AS id, CASE doc_id % 2 WHEN 0 THEN 'DEDUCTIBLE' ELSE 'REBU' END AS status, CAST(90 + doc_id % 10 AS DOUBLE) / 100 AS confidence FROM {d.base('documents')} WHERE doc_id % 5 < 2"
frame("sco17_tax_cascade", ["sale_text", "tax_cache"], lambda d: r"SELECT s.id, CASE WHEN seller = 'PRIVATE' OR regexp_matches(lower(text), '§25a|ustg|margeregeling|mwst nicht ausweisbar|rebu|margen') THEN 'REBU' WHEN c.confidence >= 0.95 THEN c.status WHEN c.id IS NOT NULL THEN 'REQUIRES_HUMAN_AUDIT' WHEN vies = 'valid' THEN 'DEDUCTIBLE' WHEN vies = 'invalid' THEN 'REBU' WHEN vies = 'timeout' THEN 'PENDING_VIES_OPTIMISTIC' ELSE 'PENDING' END AS tax_status FROM sale_text s LEFT JOIN tax_cache c ON c.id = s.id")(tax_status)
VIEWS["sale_listing"] = lambda d: "SELECT vehicle_id AS id, CAST(indexed_at AS DATE) AS day, country_code AS country, CASE lot % 9 WHEN 0 THEN 'Differenzbesteuert nach §25a UStG' WHEN 1 THEN 'MARGEREGELING' ELSE model END AS text, CASE lot % 6 WHEN 0 THEN 'PRIVATE' ELSE 'B2B' END AS seller, CASE v.vies_status WHEN 'unchecked' THEN 'timeout' WHEN 'none' THEN NULL ELSE v.vies_status END AS vies FROM listing l JOIN (SELECT dealer_id, vies_status FROM dealer) v ON v.dealer_id = l.dealer_id"
VIEWS["sale_cache"] = lambda d: "SELECT vehicle_id AS id, CASE lot % 2 WHEN 0 THEN 'DEDUCTIBLE' ELSE 'REBU' END AS status, confidence_score AS confidence FROM vehicle WHERE photo_count = 2"


def tax_distribution(sales: DataFrame, cache: DataFrame) -> DataFrame:
    """Listings by day, tax status (of the cascade) and country."""
    return tax_status(sales, cache, "day", "country").groupBy("day", "tax_status", "country").agg(F.count("*").alias("n")).withColumn("day", F.col("day").cast("string"))


frame("agg31_tax_distribution", ["sale_listing", "sale_cache"], lambda d: r"SELECT CAST(day AS VARCHAR) AS day, CASE WHEN seller = 'PRIVATE' OR regexp_matches(lower(text), '§25a|ustg|margeregeling|mwst nicht ausweisbar|rebu|margen') THEN 'REBU' WHEN c.confidence >= 0.95 THEN c.status WHEN c.id IS NOT NULL THEN 'REQUIRES_HUMAN_AUDIT' WHEN vies = 'valid' THEN 'DEDUCTIBLE' WHEN vies = 'invalid' THEN 'REBU' WHEN vies = 'timeout' THEN 'PENDING_VIES_OPTIMISTIC' ELSE 'PENDING' END AS tax_status, country, count(*) AS n FROM sale_listing s LEFT JOIN sale_cache c ON c.id = s.id GROUP BY 1, 2, 3")(tax_distribution)
both("sco14_nlc_taxes", lambda d: "SELECT vehicle_id, CASE WHEN rebu THEN 0 ELSE round(CASE WHEN co2 > 117 THEN least(power(co2 - 117, 2) * 10, 60000) * (1 - 0.10 * age) ELSE 0 END, 2) END AS fr_malus, CASE WHEN rebu THEN 0 ELSE cents * CASE WHEN co2 >= 200 THEN 1475 WHEN co2 >= 160 THEN 975 WHEN co2 >= 120 THEN 475 ELSE 0 END DIVIDE 10000 END AS es_cents, CASE WHEN rebu THEN 0 ELSE round(co2 * 130 * (1 - least(age * 12 * 0.01, 0.90)), 2) END AS nl_bpm FROM (SELECT vehicle_id, CAST(round(price_gross_eur * 100) AS BIGINT) AS cents, CAST(90 + CAST(mileage_km / 1000 AS INT) % 150 AS DOUBLE) AS co2, CAST(2021 - year AS DOUBLE) AS age, lot % 10 = 0 AS rebu FROM vehicle) x".replace("DIVIDE", d.div))


@F.pandas_udf(T.DoubleType())
def _beta(shard: pd.Series, alpha: pd.Series, beta: pd.Series, seed: pd.Series) -> pd.Series:
    import zlib

    return pd.Series([np.random.default_rng([int(s), zlib.crc32(str(k).encode())]).beta(a, b) for k, a, b, s in zip(shard, alpha, beta, seed)])


def sampled_frontier(shards: DataFrame, seed: int = 1) -> DataFrame:
    """(shard, alpha, beta) with a draw from each one's beta distribution; a seed gives the same draws again."""
    return shards.withColumn("draw", _beta(F.col("shard").cast("string"), F.col("alpha").cast("double"), F.col("beta").cast("double"), F.lit(seed)))


# ---------------------------------------------------------------- look-ups, states and events

both("qry01_detail", lambda d: f"""SELECT v.vehicle_id, v.make, v.vin, d.canonical_name, d.country_code, {'get_json_object(badge, ' + repr('$.level') + ')' if d.name == 'spark' else 'json_extract_string(badge, ' + repr('$.level') + ')'} AS badge FROM (SELECT *, concat('{{"level": "', CASE WHEN confidence_score >= 0.95 THEN 'A' ELSE 'B' END, '"}}') AS badge FROM vehicle) v LEFT JOIN dealer d ON v.dealer_id = d.dealer_id WHERE v.lot = 1""")
frame("qry01_breakdown", ["quality_listing", "vin_decode"], lambda d: f"WITH {quality._oracle_source(d)} SELECT vehicle_id, validator, outcome FROM (" + " UNION ALL ".join(f"SELECT vehicle_id, '{k}' AS validator, {v} AS outcome FROM qb WHERE lot = 1" for k, v in quality._cases().items()) + ") x")(
    lambda v, decoded: quality.findings(v, decoded, rows=v.where("lot = 1")).select("vehicle_id", "validator", quality._outcome().alias("outcome"))
)
VIEWS["review"] = lambda d: "SELECT vehicle_id, CASE lot % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'APPROVED' ELSE 'REJECTED' END AS status, min(indexed_at) AS asked_at FROM vehicle WHERE confidence_score < 0.95 GROUP BY vehicle_id, lot % 3"
VIEWS["verdict"] = lambda d: "SELECT vehicle_id, CASE WHEN photo_count > 3 THEN 'APPROVED' ELSE 'REJECTED' END AS status FROM vehicle WHERE confidence_score < 0.93"
frame("qry02_review_queue", ["review", "verdict"], lambda d: "SELECT r.vehicle_id, CASE WHEN r.status = 'PENDING' AND v.status IS NOT NULL THEN v.status ELSE r.status END AS status, r.status = 'PENDING' AND v.status IS NOT NULL AS changed FROM review r LEFT JOIN verdict v ON v.vehicle_id = r.vehicle_id")(
    lambda r, v: storage.merge(r, v.dropDuplicates(["vehicle_id"]).join(r.select("vehicle_id"), "vehicle_id", "left_semi"), ["vehicle_id"], {"status": F.col("new.status")}, when=F.col("old.status") == "PENDING").select("vehicle_id", "status", (F.col("__state") == "updated").alias("changed"))
)
both("qry04_dealer_lookup", lambda d: "SELECT 'name' AS way, dealer_id FROM (SELECT dealer_id FROM dealer WHERE upper(canonical_name) LIKE upper('supplier%7') AND country_code = 'FR' ORDER BY dealer_id LIMIT 5) a UNION ALL SELECT 'identifier' AS way, dealer_id FROM dealer WHERE dealer_id % 97 = 5 UNION ALL SELECT 'domain' AS way, dealer_id FROM vehicle WHERE source_url LIKE 'https://cars.example/3/%' GROUP BY dealer_id")
VIEWS["position"] = lambda d: "SELECT listing_id AS k, max(event_id) AS position FROM event WHERE event_id % 2 = 0 GROUP BY listing_id"
VIEWS["position_new"] = lambda d: "SELECT listing_id AS k, max(event_id) AS position FROM event WHERE event_id % 3 = 0 GROUP BY listing_id"
frame("qry06_checkpoint", ["position", "position_new"], lambda d: "SELECT k, max(position) AS position FROM (SELECT * FROM position UNION ALL SELECT * FROM position_new) x GROUP BY k")(
    lambda a, b: storage.merge(a, b, ["k"], {"position": F.greatest("new.position", "old.position")}).select("k", "position")
)
both("qry08_profile", lambda d: f"SELECT dealer_id, {'sha2' if d.name == 'spark' else 'sha256'}({'format_string' if d.name == 'spark' else 'printf'}({repr('%d:%.6f:%d')}, dealer_id, {'CAST(v15 AS DOUBLE)'}, CAST(1001808000 AS BIGINT)){', 256' if d.name == 'spark' else ''}) AS hash FROM trust_signal")
RULES = (("purchase", "inspection", 3), ("purchase", "registration", 7), ("reconditioning", "photo_session", 1), ("sale", "handover", 2))


def state_events(changes: DataFrame, rules=RULES) -> DataFrame:
    """Calendar entries that a change of state makes: (state, entry, days after) rules."""
    table = F.create_map(*(x for s in dict.fromkeys(r[0] for r in rules) for x in (F.lit(s), F.array(*(F.struct(F.lit(e).alias("entry"), F.lit(n).alias("days")) for t, e, n in rules if t == s)))))
    return changes.select("*", F.inline(table[F.col("type")])).withColumn("due", F.date_add("day", F.col("days"))).drop("days")


frame("qry17_auto_events", ["ledger"], lambda d: f"SELECT tenant_vehicle, type, entry, CAST(day + CAST(days AS INT) AS STRING) AS due FROM ledger JOIN (VALUES {', '.join(map(str, RULES))}) r(t, entry, days) ON t = type".replace("day + CAST(days AS INT)", "CAST(day + CAST(days AS INT) AS DATE)"))(
    lambda ledger: state_events(ledger).select("tenant_vehicle", "type", "entry", F.col("due").cast("string").alias("due"))
)
VIEWS["report_cache"] = lambda d: "SELECT vin, max(ttl_expires_at) AS expires_at FROM vehicle GROUP BY vin"
both("qry20_cache", lambda d: f"SELECT vin, CASE WHEN expires_at > {d.now} THEN 'served' ELSE 'purged' END AS fate FROM report_cache")
both("qry21_ledger_month", lambda d: "SELECT 'month' AS list, tenant_vehicle, type, amount_cents FROM ledger WHERE day >= DATE'1997-03-01' AND day < DATE'1997-04-01' UNION ALL SELECT 'range' AS list, tenant_vehicle, type, amount_cents FROM ledger WHERE day BETWEEN DATE'1998-01-05' AND DATE'1998-01-07' UNION ALL SELECT 'vehicle' AS list, tenant_vehicle, type, amount_cents FROM ledger WHERE tenant_vehicle = 7")
VIEWS["listing_link"] = lambda d: "SELECT vehicle_id, CASE lot % 4 WHEN 0 THEN concat('https://www.mobile.example/', lower(make), '/', lower(model), '/', CAST(year AS STRING), '-', CAST(mileage_km AS STRING), 'km/', CAST(lot AS STRING)) WHEN 1 THEN concat('https://scout.example/angebote/', lower(make), '-', lower(model), '-', CAST(lot AS STRING), '?year=', CAST(year AS STRING)) WHEN 2 THEN concat('https://cars.example/', lower(make), '_', CAST(year AS STRING), '/x') ELSE 'https://cars.example/contact' END AS url FROM vehicle"


def url_fields(links: DataFrame, url: str = "url") -> DataFrame:
    """make, model, year and mileage from listing links: by the host's own form, else a known make and a year anywhere in the path."""
    makes = "audi|bmw|peugeot|renault|toyota|volkswagen"
    host, path = F.regexp_extract(url, r"^https?://(?:www\.)?([^/:?#]+)", 1), F.lower(F.regexp_extract(url, r"^https?://[^/]+(/[^?#]*)", 1))
    take = lambda p, i=1: F.nullif(F.regexp_extract(path, p, i), F.lit(""))
    first, second = r"^/([^/]+)/([^/]+)/(\d{4})-(\d+)km/", r"^/angebote/([a-z]+)-([a-z0-9]+)-\d+"
    year_of = F.nullif(F.regexp_extract(url, r"[?&]year=(\d{4})", 1), F.lit(""))
    generic = take(rf"(?:^|[/_-])({makes})(?:[/_-]|$)")
    is_, sc = host == "mobile.example", host == "scout.example"
    return links.select("*", F.when(is_, take(first)).when(sc, take(second)).otherwise(generic).alias("make"), F.when(is_, take(first, 2)).when(sc, take(second, 2)).alias("model"), F.when(is_, take(first, 3)).when(sc, year_of).otherwise(take(r"(?:^|[/_-])((?:19|20)\d{2})(?:[/_-]|$)")).cast("int").alias("year"), F.when(is_, take(first, 4)).cast("int").alias("mileage_km"))


frame("qry23_url_fields", ["listing_link"], lambda d: "SELECT l.vehicle_id, CASE WHEN v.lot % 4 < 3 THEN lower(v.make) ELSE '' END AS make, CASE WHEN v.lot % 4 < 2 THEN lower(v.model) ELSE '' END AS model, CASE WHEN v.lot % 4 < 3 THEN v.year ELSE 0 END AS year, CASE WHEN v.lot % 4 = 0 THEN v.mileage_km ELSE -1 END AS mileage_km FROM listing_link l JOIN vehicle v ON v.vehicle_id = l.vehicle_id")(
    lambda v: url_fields(v).na.fill({"make": "", "model": "", "year": 0, "mileage_km": -1}).select("vehicle_id", "make", "model", "year", "mileage_km")
)

# ---------------------------------------------------------------- sources and streams


def aliased_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as CSV under foreign headings and read by their aliases."""
    from ..sources import files

    path = new_path(spark, "aliased")
    cars = view(spark, sf_dir, "vehicle").select(F.col("make").alias("Marke"), F.col("model").alias("Modèle"), F.col("year").alias("Baujahr"), F.col("mileage_km").alias("KM"), F.col("price_gross_eur").alias("Preis"), F.col("fuel_type").alias("Carburant"), F.col("source_url").alias("Link"))
    cars.withColumnRenamed("Modèle", "Modell").write.option("header", True).csv(path)
    return files.aliased(spark.read.option("header", True).csv(path)).groupBy("make", "model", "year", "fuel_type").agg(F.count("*").alias("n"), F.sum("mileage_km").alias("km"), F.max("price_eur").alias("price"), F.min("url").alias("url"))


QUERIES["src13_alias_csv"] = aliased_csv
ORACLES["src13_alias_csv"] = duck_sql("SELECT make, model, year, fuel_type, count(*) AS n, CAST(sum(mileage_km) AS BIGINT) AS km, max(price_gross_eur) AS price, min(source_url) AS url FROM vehicle GROUP BY ALL")
VIEWS["snapshot_old"] = lambda d: f"SELECT CAST(page_id AS BIGINT) AS k, md5(url) AS content FROM {d.base('pages')} WHERE page_id % 4 <> 0"
VIEWS["snapshot_new"] = lambda d: f"SELECT CAST(page_id AS BIGINT) AS k, CASE WHEN page_id % 5 = 0 THEN md5(html) ELSE md5(url) END AS content FROM {d.base('pages')} WHERE page_id % 4 <> 1"


def snapshot_events(old: DataFrame, new: DataFrame, key: str = "k", content: str = "content") -> DataFrame:
    """SEEN, GONE and ENRICHED between two snapshots; what stayed the same is no event. One full outer join."""
    a, b = old.select(F.col(key).alias("__a"), F.col(content).alias("__x")), new.select(F.col(key).alias("__b"), F.col(content).alias("__y"))
    state = F.when(F.col("__a").isNull(), "SEEN").when(F.col("__b").isNull(), "GONE").when(~F.col("__x").eqNullSafe(F.col("__y")), "ENRICHED")
    return a.join(b, F.col("__a") == F.col("__b"), "full").select(F.coalesce("__a", "__b").alias(key), state.alias("event")).where("event is not null")


frame("st07_snapshot_delta", ["snapshot_old", "snapshot_new"], lambda d: "SELECT k, 'SEEN' AS event FROM snapshot_new WHERE k NOT IN (SELECT k FROM snapshot_old) UNION ALL SELECT k, 'GONE' FROM snapshot_old WHERE k NOT IN (SELECT k FROM snapshot_new) UNION ALL SELECT o.k, 'ENRICHED' FROM snapshot_old o JOIN snapshot_new n ON n.k = o.k WHERE n.content <> o.content")(snapshot_events)


def incremental_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums kept up to date by a stream: each micro-batch adds its own sums to the table of those before."""
    folder = new_path(spark, "view")
    spark.createDataFrame([], "day int, event_type string, n long, cents decimal(38,0)").write.parquet(f"{folder}/-1")
    last = {}

    def add(batch: DataFrame, number: int) -> None:
        own = batch.groupBy((F.year("ts") * 10000 + F.month("ts") * 100 + F.day("ts")).alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10000).cast("decimal(38,0)")).cast("decimal(38,0)").alias("cents"))
        before = batch.sparkSession.read.parquet(f"{folder}/{number - 1}")
        storage.compacted(before.unionByName(own), ["day", "event_type"], ["n", "cents"]).withColumn("cents", F.col("cents").cast("decimal(38,0)")).write.mode("overwrite").parquet(f"{folder}/{number}")
        last["n"] = number

    feeds.opened(spark, sf_dir, "events").writeStream.foreachBatch(add).option("checkpointLocation", folder + "/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/{last['n']}").select("day", "event_type", "n", (F.col("cents").cast("double") / 10000).alias("total"))


QUERIES["st10_incremental_view"] = incremental_view
ORACLES["st10_incremental_view"] = "SELECT CAST(strftime(ts, '%Y%m%d') AS INT) AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS total FROM events GROUP BY 1, 2"

# ---------------------------------------------------------------- photos


def perceptual_hash(gray: np.ndarray) -> int:
    """64-bit hash of a picture of 32 x 32 grey values: signs against their median of the 8 x 8 lowest places of the cosine transform."""
    k, n = np.arange(32)[:, None], np.arange(32)[None, :]
    cosine = np.cos(np.pi * (2 * n + 1) * k / 64)
    low = (cosine @ gray.astype(np.float64) @ cosine.T)[:8, :8].ravel()
    return int.from_bytes(np.packbits(low > np.median(low)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def photo_hash(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """``perceptual_hash`` of grey pictures of any size (a byte a pixel, row after row), shrunk to 32 x 32 by means of areas."""

    def one(raw, w, h) -> int:
        picture = np.frombuffer(raw, np.uint8).reshape(h, w).astype(np.float64)
        sums = np.zeros((h + 1, w + 1))
        sums[1:, 1:] = picture.cumsum(0).cumsum(1)
        y, x = (np.linspace(0, side, 33).round().astype(int) for side in (h, w))
        y0, y1, x0, x1 = (np.minimum(y[:-1], h - 1), np.maximum(y[1:], np.minimum(y[:-1], h - 1) + 1), np.minimum(x[:-1], w - 1), np.maximum(x[1:], np.minimum(x[:-1], w - 1) + 1))
        area = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
        value = perceptual_hash(area / np.outer(y1 - y0, x1 - x0))
        return value - (1 << 64) if value >= 1 << 63 else value

    return pd.Series([None if p is None else one(p, int(w), int(h)) for p, w, h in zip(pixels, width, height)])

"""The remaining statements of the inventory: windows, lists, states and look-ups that are plain SQL in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import both, frame

both("jon04_left_primary", lambda d: "SELECT d.dealer_id, f.family FROM dealer d LEFT JOIN (SELECT dealer_id, min(family) AS family FROM finding GROUP BY dealer_id) f ON f.dealer_id = d.dealer_id AND f.family = 'A'")
both("jon15_vehicle_country_channel", lambda d: f"SELECT s.vehicle_id, c.country, h.channel FROM stock s CROSS JOIN country c CROSS JOIN {d.values(chr(44).join(repr(x).join('()') for x in ('dealer_direct', 'auction', 'export')), 'channel')} h WHERE NOT (s.origin = c.country AND h.channel = 'export')")
both("agg08_price_trend", lambda d: f"SELECT dealer_id, round(100 * (p1 - p0) / p0, 3) AS trend FROM (SELECT dealer_id, avg(CASE WHEN indexed_at >= {d.now} - INTERVAL 90 DAY THEN price_gross_eur END) AS p1, avg(CASE WHEN indexed_at >= {d.now} - INTERVAL 180 DAY AND indexed_at < {d.now} - INTERVAL 90 DAY THEN price_gross_eur END) AS p0 FROM recent WHERE price_gross_eur > 0 GROUP BY dealer_id) x WHERE p0 > 0")
both("agg09_week_z", lambda d: f"""WITH w AS (SELECT dealer_id, date_trunc('week', indexed_at) AS wk, CAST(count(*) AS DOUBLE) AS n FROM recent WHERE indexed_at >= {d.now} - INTERVAL 365 DAY GROUP BY 1, 2),
z AS (SELECT *, avg(n) OVER p AS m, stddev_pop(n) OVER p AS s, row_number() OVER (PARTITION BY dealer_id ORDER BY wk DESC) AS r FROM w WINDOW p AS (PARTITION BY dealer_id ORDER BY wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT dealer_id, round(CASE WHEN s > 0.000001 THEN (n - m) / s ELSE 0 END, 4) AS z FROM z WHERE r = 1""")
both("agg10_dom_delta", lambda d: f"SELECT dealer_id, round(avg(a), 4) AS tom, round(avg(CASE WHEN a BETWEEN 30 AND 60 THEN a END), 4) AS tom_cohort FROM (SELECT dealer_id, {d.between_days('indexed_at', d.now)} AS a FROM recent WHERE status = 'ACTIVE') x GROUP BY dealer_id")
both("agg12_price_vs_market", lambda d: "SELECT a.dealer_id, round(coalesce(a.m / nullif(b.m, 0), 1.0), 6) AS ratio FROM (SELECT dealer_id, country_code, avg(price_gross_eur) AS m FROM listing GROUP BY 1, 2) a JOIN (SELECT country_code, avg(price_gross_eur) AS m FROM listing GROUP BY 1) b ON a.country_code = b.country_code")
both("agg20_edge_threshold", lambda d: "SELECT a.dealer_id AS src, b.dealer_id AS dst, count(*) AS n FROM (SELECT DISTINCT vin, dealer_id FROM vehicle) a JOIN (SELECT DISTINCT vin, dealer_id FROM vehicle) b ON a.vin = b.vin AND a.dealer_id < b.dealer_id GROUP BY 1, 2 HAVING count(*) >= 5")
both("win04_trailing_z", lambda d: "SELECT event_id, round(CASE WHEN s > 0.000001 THEN (value - m) / s ELSE 0 END, 4) AS z FROM (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM event WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY listing_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x WHERE n >= 3")
both("srt11_mileage_order", lambda d: "SELECT vin, event_id, row_number() OVER (PARTITION BY vin ORDER BY ts, event_id) AS nth FROM mileage")
both("sco02_risk_labels", lambda d: "SELECT dealer_id, concat_ws(',', CASE WHEN hhi > 0.25 THEN 'brand_concentration' END, CASE WHEN low > 0.05 THEN 'deep_discount' END) AS risks FROM (SELECT dealer_id, max(share) AS hhi, max(low) AS low FROM (SELECT dealer_id, make, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY dealer_id) AS share, avg(CASE WHEN price_gross_eur < 5000 THEN 1.0 ELSE 0.0 END) AS low FROM vehicle GROUP BY dealer_id, make) x GROUP BY dealer_id) y")
both("sco04_trust_inputs", lambda d: "SELECT dealer_id, CASE WHEN vies_status = 'valid' AND status = 'ACTIVE' THEN 'valid' WHEN vies_status = 'none' THEN 'none' ELSE 'unchecked' END AS vies, CASE WHEN first_discovered_at IS NOT NULL THEN 'registered' ELSE 'unchecked' END AS registry FROM dealer")
both("qry03_pending", lambda d: "SELECT count(*) AS pending FROM vehicle WHERE status = 'REJECTED' AND confidence_score >= 0.95")
both("qry07_key_updates", lambda d: "SELECT d.dealer_id, coalesce(u.score, d.confidence_score) AS confidence FROM dealer d LEFT JOIN (SELECT dealer_id, round(max(confidence_score), 2) AS score FROM vehicle WHERE status = 'ACTIVE' GROUP BY dealer_id) u ON u.dealer_id = d.dealer_id")
both("qry10_contact_deals", lambda d: f"SELECT c_custkey, coalesce(n, 0) AS deals FROM {d.base('customer')} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {d.base('orders')} GROUP BY o_custkey) x ON o_custkey = c_custkey ORDER BY c_custkey LIMIT 50")
both("qry11_deals", lambda d: f"SELECT o_orderkey, c_name, coalesce(l_partkey, -1) AS l_partkey FROM {d.base('orders')} LEFT JOIN {d.base('customer')} ON c_custkey = o_custkey LEFT JOIN {d.base('lineitem')} ON l_orderkey = o_orderkey AND l_linenumber = 1")
both("qry14_templates", lambda d: f"SELECT n_name, CASE WHEN n_regionkey = 0 THEN 'system' ELSE 'tenant' END AS owner FROM {d.base('nation')} WHERE n_regionkey IN (0, 2) ORDER BY CASE WHEN n_regionkey = 0 THEN 0 ELSE 1 END, n_name")
both("qry15_overdue", lambda d: f"SELECT count(*) AS overdue FROM (SELECT conv_id, max(turn) AS t FROM {d.base('conversations')} GROUP BY conv_id) x JOIN {d.base('conversations')} c ON c.conv_id = x.conv_id AND c.turn = x.t WHERE c.role = 'user'")
both("qry18_published", lambda d: "SELECT source_platform, count(*) AS n FROM vehicle WHERE status = 'ACTIVE' AND sold_at IS NULL GROUP BY source_platform")
both("qry19_exact_vin", lambda d: "SELECT vehicle_id, dealer_id FROM vehicle WHERE vin = (SELECT min(vin) FROM vehicle)")
both("qry22_enriched", lambda d: "SELECT source_url, max(price_gross_eur) AS price, 'ENRICHED' AS event FROM vehicle GROUP BY source_url")
both("qry25_name_tokens", lambda d: "SELECT d.dealer_id, c.listing_id FROM dealer d JOIN (SELECT DISTINCT listing_id FROM event) c ON CAST(substr(d.canonical_name, 10, 9) AS BIGINT) = c.listing_id")
both("qry28_created_at", lambda d: "SELECT vehicle_id, CAST(CAST(coalesce(sold_at, indexed_at) AS DATE) AS STRING) AS created FROM vehicle")
both("src20_distinct_left_joins", lambda d: f"SELECT DISTINCT s_suppkey, n_name, r_name FROM {d.base('supplier')} LEFT JOIN {d.base('nation')} ON s_nationkey = n_nationkey LEFT JOIN {d.base('region')} ON n_regionkey = r_regionkey")


def top_then_filter(vectors: DataFrame, k: int = 50, keep: int = 20) -> DataFrame:
    """The k nearest by inner product to the first vector, filtered afterwards, then the first ``keep``: the order of these
    steps is the semantics, so fewer than ``keep`` may be left."""
    first = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    score = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    near = vectors.where("vec_id <> 0").crossJoin(F.broadcast(first)).withColumn("score", F.round(score, 5)).orderBy(F.desc("score"), "vec_id").limit(k)
    return near.where("label < 5").orderBy(F.desc("score"), "vec_id").limit(keep).select("vec_id", "score")


frame("srt06_filter_after_topk", ["embedding"], lambda d: "SELECT vec_id, score FROM (SELECT vec_id, label, round(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embedding WHERE vec_id = 0)), 5) AS score FROM embedding WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 50) x WHERE label < 5 ORDER BY score DESC, vec_id LIMIT 20")(top_then_filter)


def net_savings(requests: DataFrame, vat: DataFrame) -> DataFrame:
    """VAT of each request (id, origin, price_cents) in all other countries, what it saves against the dearest one, and its place by rate. Rows of one id count
    together: an id's requests are gathered first, and countries come in only then, so a task sorts requests and not their product with countries."""
    rates = vat.agg(F.sort_array(F.collect_list(F.struct(F.col("rate").cast("double").alias("rate"), "country"))).alias("rates"))  # a handful
    own = requests.groupBy("id").agg(F.collect_list(F.struct("origin", "price_cents")).alias("own")).crossJoin(F.broadcast(rates))
    taxed = lambda r: F.transform(F.filter("rates", lambda v: v["country"] != r["origin"]), lambda v: F.struct(v["rate"].alias("rate"), v["country"].alias("dest"), (r["price_cents"] * v["rate"]).cast("long").alias("vat_cents")))
    all_ = own.select("id", F.sort_array(F.flatten(F.transform("own", taxed))).alias("all")).withColumn("most", F.array_max(F.transform("all", lambda x: x["vat_cents"])))
    return all_.select("id", "most", F.posexplode("all").alias("at", "x")).select("id", "x.dest", "x.vat_cents", (F.col("most") - F.col("x.vat_cents")).alias("saving"), (F.col("at") + 1).alias("place"))


frame("win11_net_saving", ["tax_request", "vat"], lambda d: f"SELECT r.id, b.country AS dest, {d.trunc('r.price_cents * CAST(b.rate AS DOUBLE)')} AS vat_cents, max({d.trunc('r.price_cents * CAST(b.rate AS DOUBLE)')}) OVER (PARTITION BY r.id) - {d.trunc('r.price_cents * CAST(b.rate AS DOUBLE)')} AS saving, row_number() OVER (PARTITION BY r.id ORDER BY b.rate, b.country) AS place FROM tax_request r JOIN vat b ON b.country <> r.origin")(net_savings)

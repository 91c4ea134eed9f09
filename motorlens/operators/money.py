"""Ledgers, tax and disposition: profit and loss, alerts, VAT regimes, routes, capacity (AGG22-29, SCO05-18)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import explain
from ..plans.domain import TRANSPORT, VAT
from ..plans.registry import both, frame
from .joins import interval_asof
from .storage import stored


def in_euro(ledger: DataFrame, fx: DataFrame) -> DataFrame:
    """Amounts in euro cents at the latest rate on or before the day, 1.0 without one."""
    rated = interval_asof(ledger, fx, ("currency", "from_currency"), "day", "valid_from", "rate", 1.0)
    return rated.withColumn("eur_cents", F.round(F.col("amount_cents") * F.col("rate") + 1e-6).cast("long"))


def vehicle_pnl(euro: DataFrame) -> DataFrame:
    """Costs (any type but sale), revenue, margin, return on costs, days in stock of each vehicle; one aggregation."""
    sale, buy = F.col("type") == "sale", F.col("type") == "purchase"
    sums = euro.groupBy("tenant_vehicle").agg(
        F.sum(F.when(~sale, F.col("eur_cents")).otherwise(0)).alias("cost_cents"), F.sum(F.when(sale, F.col("eur_cents")).otherwise(0)).alias("revenue_cents"),
        F.min(F.when(buy, F.col("day"))).alias("bought"), F.max(F.when(sale, F.col("day"))).alias("sold"),
        F.sum(F.when(buy, F.col("amount_cents")).otherwise(0)).alias("buy_cents"), F.sum(F.when(F.col("type") == "reconditioning", F.col("amount_cents")).otherwise(0)).alias("recon_cents"),
    )
    margin = F.col("revenue_cents") - F.col("cost_cents")
    days = F.when(F.col("bought").isNotNull(), F.greatest(F.lit(0), F.datediff(F.coalesce("sold", F.lit(TODAY).cast("date")), "bought"))).otherwise(0)
    out = sums.withColumn("margin_cents", margin).withColumn("days", days)
    for name, base in (("margin_pct", "revenue_cents"), ("roi_pct", "cost_cents")):
        out = out.withColumn(name, F.when(F.col(base) > 0, F.round(F.col("margin_cents") * 100.0 / F.col(base), 4)).otherwise(0.0))
    return out.withColumn("cost_per_day", F.when(F.col("days") > 0, F.expr("cost_cents div days")).otherwise(0))


#: The day that stands for today.
TODAY = "2001-09-30"


def trailing_year(ledger: DataFrame, today: str = TODAY) -> DataFrame:
    """Entries of the year up to ``today``, both days included."""
    day = F.lit(today).cast("date")
    return ledger.where(F.col("day").between(F.add_months(day, -12), day))


def alerts(pnl: DataFrame) -> DataFrame:
    """Sold at a loss; 60 days in stock unsold; reconditioning over 15 % of the purchase."""
    c = F.col
    kinds = F.array_compact(F.array(
        F.when((c("revenue_cents") > 0) & (c("margin_cents") < 0), "negative_margin"), F.when((c("revenue_cents") == 0) & (c("days") >= 60), "stock_too_long"), F.when((c("buy_cents") > 0) & (c("recon_cents") * 100.0 / c("buy_cents") > 15), "reconditioning_high"),
    ))
    return pnl.select("tenant_vehicle", F.explode(kinds).alias("alert"))


_EUR = "e AS (SELECT l.*, CAST(round(amount_cents * coalesce((SELECT f.rate FROM fx f WHERE f.from_currency = l.currency AND f.valid_from <= l.day ORDER BY f.valid_from DESC LIMIT 1), 1.0)::DOUBLE + 1e-6) AS BIGINT) AS eur_cents FROM ledger l)"
_PNL = _EUR + """, s AS (SELECT tenant_vehicle, CAST(sum(CASE WHEN type <> 'sale' THEN eur_cents ELSE 0 END) AS BIGINT) AS cost_cents, CAST(sum(CASE WHEN type = 'sale' THEN eur_cents ELSE 0 END) AS BIGINT) AS revenue_cents, min(CASE WHEN type = 'purchase' THEN day END) AS bought, max(CASE WHEN type = 'sale' THEN day END) AS sold,
 CAST(sum(CASE WHEN type = 'purchase' THEN amount_cents ELSE 0 END) AS BIGINT) AS buy_cents, CAST(sum(CASE WHEN type = 'reconditioning' THEN amount_cents ELSE 0 END) AS BIGINT) AS recon_cents FROM e GROUP BY 1),
p AS (SELECT *, revenue_cents - cost_cents AS margin_cents, CASE WHEN bought IS NULL THEN 0 ELSE greatest(0, date_diff('day', bought, coalesce(sold, DATE '2001-09-30'))) END AS days FROM s),
q AS (SELECT *, coalesce(round(margin_cents * 100.0::DOUBLE / nullif(greatest(revenue_cents, 0), 0), 4), 0) AS margin_pct, coalesce(round(margin_cents * 100.0::DOUBLE / nullif(greatest(cost_cents, 0), 0), 4), 0) AS roi_pct, CASE WHEN days > 0 THEN CAST(trunc(cost_cents / days) AS BIGINT) ELSE 0 END AS cost_per_day FROM p)"""
_OUT = ["tenant_vehicle", "cost_cents", "revenue_cents", "margin_cents", "margin_pct", "roi_pct", "days", "cost_per_day"]
frame("agg22_vehicle_pnl", ["ledger", "fx"], lambda d: f"WITH {_PNL} SELECT {', '.join(_OUT)} FROM q")(lambda ledger, fx: vehicle_pnl(in_euro(ledger, fx)).select(_OUT))
frame("sco10_alerts", ["ledger", "fx"], lambda d: f"WITH {_PNL} SELECT tenant_vehicle, 'negative_margin' AS alert FROM q WHERE revenue_cents > 0 AND margin_cents < 0 UNION ALL SELECT tenant_vehicle, 'stock_too_long' FROM q WHERE revenue_cents = 0 AND days >= 60 UNION ALL SELECT tenant_vehicle, 'reconditioning_high' FROM q WHERE buy_cents > 0 AND recon_cents * 100.0 / buy_cents > 15")(
    lambda ledger, fx: alerts(vehicle_pnl(in_euro(ledger, fx)))
)


def fleet_pnl(pnl: DataFrame) -> DataFrame:
    """One row: totals, mean margin of vehicles with revenue, best and worst vehicle (ties: smallest id)."""
    m, v = F.col("margin_cents"), F.col("tenant_vehicle")
    return pnl.agg(
        F.count("*").alias("vehicles"), F.sum("cost_cents").alias("cost_cents"), F.sum("revenue_cents").alias("revenue_cents"), F.round(F.avg(F.when(F.col("revenue_cents") > 0, F.col("margin_pct"))), 2).alias("avg_margin_pct"),
        F.min_by(v, F.struct(-m, v)).alias("best"), F.min_by(v, F.struct(m, v)).alias("worst"),
    )


frame("agg23_fleet_pnl", ["ledger", "fx"], lambda d: f"WITH {_PNL} SELECT count(*) AS vehicles, CAST(sum(cost_cents) AS BIGINT) AS cost_cents, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents, round(avg(margin_pct) FILTER (WHERE revenue_cents > 0), 2) AS avg_margin_pct, arg_min(tenant_vehicle, (-margin_cents, tenant_vehicle)) AS best, arg_min(tenant_vehicle, (margin_cents, tenant_vehicle)) AS worst FROM q")(
    lambda ledger, fx: fleet_pnl(vehicle_pnl(in_euro(ledger, fx)))
)
both("agg23_cost_by_type", lambda d: "SELECT type, CAST(sum(amount_cents) AS BIGINT) AS cents, count(*) AS n FROM ledger WHERE type <> 'sale' GROUP BY type")

def monthly_pnl(euro: DataFrame) -> DataFrame:
    """Sums of each month in euro cents from the first to the last month with entries, months without any as zeros, with the month before. Growth is a share of the
    month before: of its revenue, where that is positive, and of the absolute value of its margin, where there is one; else 0. Entries without a
    day count nowhere. Entries are summed by month first; what follows has a row a month."""
    c, month = F.col, F.year("day") * 12 + F.month("day") - 1
    sums = euro.where("day is not null").groupBy(month.alias("mth")).agg(F.sum(F.when(c("type") == "sale", 0).otherwise(c("eur_cents"))).alias("cost"), F.sum(F.when(c("type") == "sale", c("eur_cents")).otherwise(0)).alias("rev"))
    # A month's row gives the sums to its own month and, as those before, to the next one; the months between come from the next month that is there.
    following = F.lead("mth").over(Window.orderBy("mth"))
    spine = sums.withColumn("next", following).select(F.explode(F.sequence("mth", F.coalesce(c("next") - 1, c("mth")))).alias("at"), "mth", "cost", "rev")
    zero = {k: F.when(c("at") == c("mth"), c(k)).otherwise(0) for k in ("cost", "rev")}
    full = spine.select(c("at").alias("mth"), zero["cost"].alias("cost_cents"), zero["rev"].alias("revenue_cents")).withColumn("margin_cents", c("revenue_cents") - c("cost_cents"))
    before = Window.orderBy("mth")
    for k in ("cost", "revenue", "margin"):
        full = full.withColumn(f"prev_{k}_cents", F.coalesce(F.lag(f"{k}_cents").over(before), F.lit(0)))
    share = {"margin_pct": ("margin_cents", c("revenue_cents")), "rev_growth_pct": (c("revenue_cents") - c("prev_revenue_cents"), c("prev_revenue_cents")), "margin_growth_pct": (c("margin_cents") - c("prev_margin_cents"), F.abs("prev_margin_cents"))}
    for k, (part, whole) in share.items():
        full = full.withColumn(k, F.when(whole > 0, F.round((part if not isinstance(part, str) else c(part)).cast("double") / whole * 100, 4)).otherwise(0.0))
    return full


frame("agg24_monthly_pnl", ["ledger", "fx"], lambda d: f"""WITH {_EUR}, m AS (SELECT date_trunc('month', day) AS mo, sum(CASE WHEN type <> 'sale' THEN eur_cents ELSE 0 END) AS cost, sum(CASE WHEN type = 'sale' THEN eur_cents ELSE 0 END) AS rev FROM e GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(mo) FROM m)::TIMESTAMP, (SELECT max(mo) FROM m)::TIMESTAMP, INTERVAL 1 MONTH)) AS mo),
f AS (SELECT s.mo, CAST(coalesce(cost, 0) AS BIGINT) AS cost, CAST(coalesce(rev, 0) AS BIGINT) AS rev FROM s LEFT JOIN m ON m.mo = s.mo),
g AS (SELECT a.mo, a.cost, a.rev, coalesce(b.cost, 0) AS pc, coalesce(b.rev, 0) AS pr FROM f a LEFT JOIN f b ON b.mo = a.mo - INTERVAL 1 MONTH)
SELECT year(mo) * 12 + month(mo) - 1 AS mth, cost AS cost_cents, rev AS revenue_cents, rev - cost AS margin_cents, pc AS prev_cost_cents, pr AS prev_revenue_cents, pr - pc AS prev_margin_cents,
 CASE WHEN rev > 0 THEN round((rev - cost)::DOUBLE / rev * 100, 4) ELSE 0 END AS margin_pct, CASE WHEN pr > 0 THEN round((rev - pr)::DOUBLE / pr * 100, 4) ELSE 0 END AS rev_growth_pct, CASE WHEN pr <> pc THEN round((rev - cost - (pr - pc))::DOUBLE / abs(pr - pc) * 100, 4) ELSE 0 END AS margin_growth_pct FROM g""")(
    lambda ledger, fx: monthly_pnl(in_euro(ledger, fx))
)


def vat_regimes(requests: DataFrame, *keep: str) -> DataFrame:
    """VAT routes of each request (origin, dest, price_cents, margin_cents, ids_valid, age_months, km), ranked by total cost; ``keep``: columns of
    the request to return as well."""
    c = F.col
    rate = {x: F.coalesce(*(F.when(c(x) == k, F.lit(v)) for k, v in VAT.items())) for x in ("origin", "dest")}
    new = ((c("age_months") > 0) & (c("age_months") <= 6)) | ((c("km") > 0) & (c("km") <= 6000))
    eu = (c("origin") != "CH") & (c("dest") != "CH")
    price, margin = c("price_cents"), F.when(c("margin_cents") > 0, c("margin_cents")).otherwise((c("price_cents") * 0.15).cast("long"))

    def route(name: str, vat: Column, total: Column) -> Column:
        return F.struct(F.lit(name).alias("regime"), vat.cast("long").alias("vat_cents"), total.cast("long").alias("total_cents"))

    full = (price * rate["dest"]).cast("long")
    routes = F.array_compact(F.array(
        F.when(eu & new, route("INTRA_COMMUNITY", full, price + full)), F.when(eu & ~new & c("ids_valid"), route("INTRA_COMMUNITY", F.lit(0), price)),
        F.when(eu & ~new, route("MARGIN_SCHEME", (margin * rate["origin"] / (1 + rate["origin"])).cast("long"), price)), F.when(~eu & (c("origin") != c("dest")), route("EXPORT_IMPORT", full, price + full)),
    ))
    opened = requests.select("id", "origin", "dest", *keep, F.posexplode(routes).alias("ord", "r")).select("id", "origin", "dest", *keep, "ord", "r.*")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("total_cents", "vat_cents", "ord"))
    worst = F.max("vat_cents").over(Window.partitionBy("id"))
    return opened.select("id", "origin", "dest", "regime", "vat_cents", "total_cents", rank.alias("place"), (worst - F.col("vat_cents")).alias("saving_cents"), *keep)


_REGIMES = """WITH q AS (SELECT r.*, a.rate AS ra, b.rate AS rb, (age_months BETWEEN 1 AND 6 OR km BETWEEN 1 AND 6000) AS new, origin <> 'CH' AND dest <> 'CH' AS eu, CASE WHEN margin_cents > 0 THEN margin_cents ELSE CAST(trunc(price_cents * 0.15::DOUBLE) AS BIGINT) END AS m FROM tax_request r JOIN vat a ON a.country = origin JOIN vat b ON b.country = dest),
o AS (SELECT id, origin, dest, 0 AS ord, 'INTRA_COMMUNITY' AS regime, CAST(trunc(price_cents * rb::DOUBLE) AS BIGINT) AS vat_cents, price_cents + CAST(trunc(price_cents * rb::DOUBLE) AS BIGINT) AS total_cents FROM q WHERE eu AND new UNION ALL SELECT id, origin, dest, 0, 'INTRA_COMMUNITY', 0, price_cents FROM q WHERE eu AND NOT new AND ids_valid
 UNION ALL SELECT id, origin, dest, 1, 'MARGIN_SCHEME', CAST(trunc(m * ra::DOUBLE / (1 + ra::DOUBLE)) AS BIGINT), price_cents FROM q WHERE eu AND NOT new UNION ALL SELECT id, origin, dest, 0, 'EXPORT_IMPORT', CAST(trunc(price_cents * rb::DOUBLE) AS BIGINT), price_cents + CAST(trunc(price_cents * rb::DOUBLE) AS BIGINT) FROM q WHERE NOT eu AND origin <> dest)
SELECT id, origin, dest, regime, vat_cents, total_cents, row_number() OVER (PARTITION BY id ORDER BY total_cents, vat_cents, ord) AS place, max(vat_cents) OVER (PARTITION BY id) - vat_cents AS saving_cents FROM o"""
frame("sco09_vat_regimes", ["tax_request"], lambda d: _REGIMES)(vat_regimes)


def disposition(vehicles: DataFrame, prices: DataFrame, dealers: DataFrame) -> DataFrame:
    """Routes of each vehicle over countries and channels with VAT, transport, net profit, days to sell and confidence;
    ``place`` 1 is the best. ``prices``: make, model, country, cents, n (a small cohort table). Vehicles (one row each) of one make, model and origin have
    the same routes, so routes are made and ranked once for each of these and joined to the vehicles by them; no route is shuffled by vehicle."""
    c = F.col
    routes = vehicles.select("make", "model", "origin").distinct().join(prices, ["make", "model"]).where("cents > 0")
    channel = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("name")) for i, x in enumerate(("dealer_direct", "auction", "export")))))
    routes = routes.withColumn("ch", channel).where(~((c("country") == c("origin")) & (c("ch.name") == "export")))
    rate = F.coalesce(*(F.when(c("country") == k, F.lit(v)) for k, v in VAT.items()))
    vat = F.when(c("origin") == c("country"), 0).when((c("origin") != "CH") & (c("country") != "CH"), 0).when(c("country") == "CH", (c("cents") * rate).cast("long") + 50000).otherwise((c("cents") * rate).cast("long") + 40000)
    pairs = [(k, v) for a, v in TRANSPORT.items() for k in (a, "-".join(a.split("-")[::-1]))]
    cost = F.coalesce(F.create_map(*(F.lit(x) for p in pairs for x in p))[F.concat_ws("-", "origin", "country")], F.lit(300000))
    cost = F.when(c("origin") == c("country"), 0).otherwise(cost) + F.when(c("ch.name") == "auction", F.expr("cents * 3 div 100")).otherwise(0)
    base = F.coalesce(*(F.when(c("country") == k, F.lit(v)) for k, v in (("DE", 28), ("FR", 35), ("NL", 21), ("BE", 30), ("ES", 42), ("CH", 25))), F.lit(35))
    days = F.when(c("ch.name") == "auction", F.floor(base / 2)).when(c("ch.name") == "export", base + 21).otherwise(base)
    confidence = F.when(c("n") >= 50, 1.0).otherwise(1 - 1 / (c("n") + 1.0))
    full = routes.withColumn("vat_cents", vat.cast("long")).withColumn("transport_cents", cost.cast("long")).withColumn("net_cents", c("cents") - c("vat_cents") - c("transport_cents"))
    own = Window.partitionBy("make", "model", "origin")
    place = F.row_number().over(own.orderBy(F.desc("net_cents"), "country", "ch.i"))
    # What the best route brings over the price where the vehicle is; nothing without a price there.
    uplift = F.coalesce(F.max("net_cents").over(own) - F.max(F.when(c("country") == c("origin"), c("cents"))).over(own), F.lit(0))
    active = dealers.where("status = 'ACTIVE'").groupBy(c("country_code").alias("country")).agg(F.count("*").alias("dealers"))
    ranked = full.join(active, "country", "left").select("make", "model", "origin", "country", c("ch.name").alias("channel"), "net_cents", "vat_cents", "transport_cents", days.cast("long").alias("days"), F.round(confidence, 6).alias("confidence"), F.coalesce("dealers", F.lit(0)).alias("dealers"), place.alias("place"), uplift.alias("uplift_cents"))
    told = ("origin", "country", "channel", "net_cents", "vat_cents", "transport_cents", "days", "confidence", "dealers", "place", "uplift_cents")
    # Written, so that its size is known when the join is planned.
    return vehicles.select("vehicle_id", "make", "model", "origin").join(stored(ranked, "routes"), ["make", "model", "origin"]).select("vehicle_id", *told)


_ROUTES = """WITH r AS (SELECT vehicle_id, k.origin AS origin, p.country, n, cents, ch.i, ch.name AS channel, CASE WHEN k.origin = p.country OR (k.origin <> 'CH' AND p.country <> 'CH') THEN 0 ELSE CAST(trunc(cents * v.rate::DOUBLE) AS BIGINT) + CASE WHEN p.country = 'CH' THEN 50000 ELSE 40000 END END AS vat_cents,
 CASE WHEN k.origin = p.country THEN 0 ELSE coalesce(t.cost, 300000) END + CASE WHEN ch.name = 'auction' THEN cents * 3 // 100 ELSE 0 END AS transport_cents, CASE ch.name WHEN 'auction' THEN s.days // 2 WHEN 'export' THEN s.days + 21 ELSE s.days END AS days
 FROM stock k JOIN price p USING (make, model) JOIN vat v ON v.country = p.country JOIN sell_days s ON s.country = p.country LEFT JOIN transport t ON t.origin = k.origin AND t.dest = p.country CROSS JOIN (VALUES (0, 'dealer_direct'), (1, 'auction'), (2, 'export')) ch(i, name) WHERE cents > 0 AND NOT (k.origin = p.country AND ch.name = 'export')),
f AS (SELECT *, cents - vat_cents - transport_cents AS net_cents FROM r)
SELECT vehicle_id, origin, f.country, channel, net_cents, vat_cents, transport_cents, days, round(CASE WHEN n >= 50 THEN 1.0::DOUBLE ELSE 1 - 1 / (n + 1.0::DOUBLE) END, 6) AS confidence, coalesce(a.dealers, 0) AS dealers, row_number() OVER (PARTITION BY vehicle_id ORDER BY net_cents DESC, f.country, i) AS place, coalesce(max(net_cents) OVER (PARTITION BY vehicle_id) - max(CASE WHEN f.country = origin THEN cents END) OVER (PARTITION BY vehicle_id), 0) AS uplift_cents
FROM f LEFT JOIN (SELECT country_code AS country, count(*) AS dealers FROM dealer WHERE status = 'ACTIVE' GROUP BY 1) a ON a.country = f.country"""
frame("sco07_disposition", ["stock", "price", "dealer"], lambda d: _ROUTES)(disposition)
frame("srt04_best_routes", ["stock", "price", "dealer"], lambda d: f"SELECT vehicle_id, country, channel, net_cents, uplift_cents FROM ({_ROUTES}) WHERE place = 1")(
    lambda s, p, d: disposition(s, p, d).where("place = 1").select("vehicle_id", "country", "channel", "net_cents", "uplift_cents")
)


def explained_routes(routes: DataFrame) -> DataFrame:
    c = F.col
    price = c("net_cents") + c("vat_cents") + c("transport_cents")
    return routes.select("vehicle_id", "country", "channel", explain.route(c("country"), c("channel"), price, c("vat_cents"), c("transport_cents"), c("net_cents")).alias("explanation"))


_EURO0 = "printf('%.0f', {} / 100.0::DOUBLE)".format
frame("str_route_explanations", ["stock", "price", "dealer"], lambda d: f"""SELECT vehicle_id, country, channel, 'Market price in ' || country || ': €' || {_EURO0("(net_cents + vat_cents + transport_cents)")} || ' | ' || CASE WHEN vat_cents > 0 THEN 'VAT/customs cost: −€' || {_EURO0("vat_cents")} ELSE 'Intra-EU reverse charge: €0 VAT' END
 || CASE WHEN transport_cents > 0 THEN ' | Transport cost: −€' || {_EURO0("transport_cents")} ELSE '' END || ' | Net profit: €' || {_EURO0("net_cents")} || ' via ' || channel AS explanation FROM ({_ROUTES})""")(lambda s, p, d: explained_routes(disposition(s, p, d)))


def explained_regimes(requests: DataFrame) -> DataFrame:
    """Each regime open to a request with its sentence."""
    c = F.col
    margin = F.when(c("margin_cents") > 0, c("margin_cents")).otherwise((c("price_cents") * 0.15).cast("long"))
    new = ((c("age_months") > 0) & (c("age_months") <= 6)) | ((c("km") > 0) & (c("km") <= 6000))
    told = vat_regimes(requests.withColumn("taxed_margin", margin).withColumn("is_new", F.coalesce(new, F.lit(False))), "price_cents", "taxed_margin", "is_new")
    return told.select("id", "regime", "place", explain.tax(c("regime"), c("origin"), c("dest"), c("is_new"), c("price_cents"), c("taxed_margin"), c("vat_cents"), c("total_cents")).alias("explanation"))


def _tax_sql(d) -> str:
    e = "printf('%.2f', {} / 100.0::DOUBLE)".format
    return f"""SELECT t.id, regime, place, CASE WHEN regime = 'MARGIN_SCHEME' THEN format('Régimen de margen (Art. 313 Dir. IVA): IVA {{}}% sobre margen €{{}}. IVA incorporado €{{}} no deducible por el comprador. Precio total facturado: €{{}}', printf('%.0f', a.rate * 100.0::DOUBLE), {e("CASE WHEN r.margin_cents > 0 THEN r.margin_cents ELSE CAST(trunc(r.price_cents * 0.15::DOUBLE) AS BIGINT) END")}, {e("vat_cents")}, {e("r.price_cents")})
 WHEN regime = 'INTRA_COMMUNITY' AND total_cents = r.price_cents THEN format('Adquisición intracomunitaria 0% (Art. 20 Dir. IVA): factura sin IVA. Comprador aplica reverse-charge {{}}% en {{}} y deduce íntegramente. Coste IVA neto: €0,00. Precio neto: €{{}}', printf('%.0f', b.rate * 100.0::DOUBLE), t.dest, {e("r.price_cents")})
 WHEN regime = 'INTRA_COMMUNITY' THEN format('Vehículo nuevo Art. 2(2)(b): IVA {{}}% OBLIGATORIO en destino {{}}. IVA sobre precio íntegro €{{}} = €{{}}. Total bruto: €{{}}. Sujeto pasivo en {{}}: IVA recuperable como input tax.', printf('%.0f', b.rate * 100.0::DOUBLE), t.dest, {e("r.price_cents")}, {e("vat_cents")}, {e("total_cents")}, t.dest)
 WHEN t.dest = 'CH' THEN format('Exportación UE→CH (Art. 146 Dir. IVA): 0% IVA en origen {{}}. Importación suiza MWST {{}}% sobre valor CIF €{{}} = €{{}}. Total bruto: €{{}}. Comprador CH inscrito MWST: IVA importación recuperable.', t.origin, printf('%.1f', b.rate * 100.0::DOUBLE), {e("r.price_cents")}, {e("vat_cents")}, {e("total_cents")})
 ELSE format('Exportación CH→UE (Art. 23 MWSTG): 0% MWST en origen. IVA importación {{}} {{}}% sobre valor declarado €{{}} = €{{}}. Total bruto: €{{}}. Comprador EU-VAT inscrito en {{}}: IVA importación recuperable como input tax.', t.dest, printf('%.0f', b.rate * 100.0::DOUBLE), {e("r.price_cents")}, {e("vat_cents")}, {e("total_cents")}, t.dest) END AS explanation
FROM ({_REGIMES}) t JOIN tax_request r ON r.id = t.id AND r.origin = t.origin AND r.dest = t.dest JOIN vat a ON a.country = t.origin JOIN vat b ON b.country = t.dest"""


frame("str_tax_explanations", ["tax_request"], _tax_sql)(explained_regimes)
frame("agg29_fleet_summary", ["stock", "price", "dealer"], lambda d: f"SELECT country, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct FROM ({_ROUTES}) WHERE place = 1 GROUP BY country")(
    lambda s, p, d: disposition(s, p, d).where("place = 1").groupBy("country").agg(F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))
)
both("sco05_vat_cost", lambda d: f"SELECT r.id, r.origin, r.dest, CASE WHEN r.origin = r.dest OR (r.origin <> 'CH' AND r.dest <> 'CH') THEN 0 ELSE {d.trunc('r.price_cents * CAST(b.rate AS DOUBLE)')} + CASE WHEN r.dest = 'CH' THEN 50000 ELSE 40000 END END AS vat_cents FROM tax_request r JOIN vat b ON b.country = r.dest")
both("sco06_transport", lambda d: f"SELECT s.vehicle_id, s.origin, b.country AS dest, CASE WHEN s.origin = b.country THEN 0 ELSE coalesce(o.cost, t.cost, 300000) END AS cost FROM stock s CROSS JOIN country b LEFT JOIN transport t ON t.origin = s.origin AND t.dest = b.country LEFT JOIN {d.values('(' + repr('DE') + ', ' + repr('FR') + ', 70000)', 'origin, dest, cost')} o ON o.origin = s.origin AND o.dest = b.country")


def gain_share(plans: DataFrame, share: float = 0.1) -> DataFrame:
    """Fee of each plan: a share of its uplift in whole cents, nothing where there is none."""
    gain = F.greatest(F.lit(0).cast("long"), F.col("uplift_cents"))
    return plans.select("vehicle_id", gain.alias("uplift_cents"), (gain * share).cast("long").alias("fee_cents"))


frame("sco08_gain_share", ["stock", "price", "dealer"], lambda d: f"SELECT vehicle_id, greatest(0, uplift_cents) AS uplift_cents, CAST(trunc(greatest(0, uplift_cents) * 0.1::DOUBLE) AS BIGINT) AS fee_cents FROM ({_ROUTES}) WHERE place = 1")(lambda s, p, d: gain_share(disposition(s, p, d).where("place = 1")))
both("sco12_dossier", lambda d: "SELECT vin, CASE WHEN n >= 4 THEN 'full' WHEN n >= 2 THEN 'partial' ELSE 'unavailable' END AS section FROM (SELECT vin, count(DISTINCT source_platform) AS n FROM vehicle GROUP BY vin) x")
both("sco15_sdi", lambda d: f"SELECT vehicle_id, dom FROM (SELECT vehicle_id, {d.between_days('indexed_at', d.now)} AS dom FROM recent) x WHERE dom BETWEEN 58 AND 65 OR dom BETWEEN 88 AND 95")
#: Width of the ranges of prices that are ranked side by side.
PRICES = 500.0


def composite(vehicles: DataFrame) -> DataFrame:
    """A score of the price's percent rank among vehicles of its make and year, confidence, photos and sale. Ranks are taken within ranges of prices and raised by
    how many vehicles lie in lower ones, so that no task sorts a whole make and year."""
    span = F.floor(F.col("price_gross_eur") / PRICES).alias("span")
    counts = vehicles.groupBy("make", "year", span).agg(F.count("*").alias("n"))
    group = Window.partitionBy("make", "year")
    lower = F.coalesce(F.sum("n").over(group.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = counts.select(F.col("make").alias("_make"), F.col("year").alias("_year"), F.col("span").alias("_span"), lower.alias("lower"), F.sum("n").over(group).alias("all"))
    own = vehicles.select("vehicle_id", "make", "year", "price_gross_eur", "confidence_score", "photo_count", F.col("sold_at").isNull().alias("unsold"), span)
    ranked = own.withColumn("r", F.rank().over(Window.partitionBy("make", "year", "span").orderBy("price_gross_eur")))
    ranked = ranked.join(below, F.col("make").eqNullSafe(F.col("_make")) & F.col("year").eqNullSafe(F.col("_year")) & F.col("span").eqNullSafe(F.col("_span")))
    m = F.when(F.col("all") > 1, (F.col("r") - 1 + F.col("lower")).cast("double") / (F.col("all") - 1).cast("double")).otherwise(0.0)
    return ranked.withColumn("m", m).selectExpr("vehicle_id", "round(0.35 * m + 0.25 * confidence_score + 0.25 * (CAST(photo_count AS DOUBLE) / 7) + 0.15 * CASE WHEN unsold THEN 1 ELSE 0 END + 0.0000001, 4) AS score")


frame("sco16_composite", ["vehicle"], lambda d: "SELECT vehicle_id, round(0.35 * m + 0.25 * confidence_score + 0.25 * (CAST(photo_count AS DOUBLE) / 7) + 0.15 * CASE WHEN sold_at IS NULL THEN 1 ELSE 0 END + 0.0000001, 4) AS score FROM (SELECT *, percent_rank() OVER (PARTITION BY make, year ORDER BY price_gross_eur) AS m FROM vehicle) x")(composite)
both("sco18_rollback", lambda d: f"""SELECT event_id FROM (SELECT event_id, mileage, max(mileage) OVER (PARTITION BY vin ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND {'INTERVAL 1 MICROSECOND' if d.name == 'duckdb' else "INTERVAL '0.000001' SECOND"} PRECEDING) AS high FROM mileage) x WHERE high > mileage + 500""")
both("sco19_frontier", lambda d: "SELECT k AS shard, round(CAST(1 + sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS DOUBLE) / (2 + count(*)), 6) AS posterior_mean FROM event GROUP BY k")


def capped(routes: DataFrame, share: float = 0.20) -> DataFrame:
    """Assignment of vehicles to destinations, at most ``share`` of them (rounded up) to each. In order of their best
    unconstrained profit (ties: vehicle_id) vehicles take their best route to a destination with room; when all of a vehicle's
    destinations are full it keeps its best route. ``routes``: vehicle_id, country, net_cents and others.

    One vehicle after another would be a loop; instead, the vehicle that fills the next destination is looked up, which closes
    it for all after that vehicle. There are as many such steps as destinations, each a few counts over the vehicles in order,
    and none moves a row: where each vehicle goes follows from its number and the steps before it."""
    best = routes.groupBy("vehicle_id", "country").agg(F.max("net_cents").alias("net_cents"))
    wishes = best.groupBy("vehicle_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("net_cents")).alias("loss"), "country"))).alias("wishes"))
    # Numbers in order: of a range partition of the sorted rows, then within it.
    ordered = stored(wishes.orderBy(F.col("wishes")[0]["loss"], "vehicle_id").withColumn("at", F.monotonically_increasing_id()), "ordered")
    cap = max(1, int(ordered.count() * share + 0.999))
    steps: list[tuple[int, tuple[str, ...]]] = []  # (last number, destinations closed for the vehicles up to it)
    full: list[str] = []
    left: dict[str, int] = {}
    done = -1
    while True:
        waiting = ordered.where(F.col("at") > done).withColumn("to", _open(full)).where("to is not null").withColumn("part", F.shiftright("at", 33))
        counts = waiting.groupBy("to", "part").count().collect()  # a row for each destination and range partition
        ends = {}
        for to in {r["to"] for r in counts}:
            room = left.setdefault(to, cap)
            for r in sorted((r for r in counts if r["to"] == to), key=lambda r: r["part"]):
                if room <= r["count"]:
                    ends[to] = (r["part"], room)
                    break
                room -= r["count"]
        if not ends:
            break
        # The vehicle that takes the last place of each destination; the first of these ends the step.
        in_part = Window.partitionBy("to", "part").orderBy("at")
        hit = reduce(lambda x, y: x | y, [(F.col("to") == to) & (F.col("part") == part) & (F.col("nth") == nth) for to, (part, nth) in ends.items()])
        near = waiting.where(reduce(lambda x, y: x | y, [(F.col("to") == to) & (F.col("part") == part) for to, (part, _) in ends.items()]))
        at, closed = min((r["at"], r["to"]) for r in near.withColumn("nth", F.row_number().over(in_part)).where(hit).collect())
        steps.append((at, tuple(full)))
        for r in waiting.where(F.col("at") <= at).groupBy("to").count().collect():
            left[r["to"]] -= r["count"]
        full.append(closed)
        done = at
    to = F.coalesce(_open(full), F.col("wishes")[0]["country"])
    for at, closed in reversed(steps):
        to = F.when(F.col("at") <= at, F.coalesce(_open(list(closed)), F.col("wishes")[0]["country"])).otherwise(to)
    gone = ordered.withColumn("country", to).withColumn("hit", F.filter("wishes", lambda w: w["country"] == F.col("country"))[0])
    return gone.select("vehicle_id", "country", (-F.col("hit.loss")).alias("net_cents"), (F.col("country") != F.col("wishes")[0]["country"]).alias("rerouted"))


def _open(full: list[str]) -> Column:
    """The best destination of a vehicle's wishes that isn't among ``full``."""
    return F.get(F.filter("wishes", lambda w: ~w["country"].isin(full)) if full else F.col("wishes"), F.lit(0))["country"]


frame("srt14_capped_assignment", ["stock", "price", "dealer"])(lambda s, p, d: capped(disposition(s, p, d)))




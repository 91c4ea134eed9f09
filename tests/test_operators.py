"""Operators of the market engine on small hand-made tables."""

import datetime
import json
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorlens.functions import text, vin
from motorlens.operators import dealers, desk, feeds, joins, market, money, quality, search, storage
from motorlens.sources import dumps, files
from motorlens.streaming import ingest


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("number, ok", [("1M8GDM9AXKP042788", True), ("1M8GDM9A1KP042788", False), ("11111111111111111", True), ("1M8GDM9AXKP04278", False), ("IM8GDM9AXKP042788", False), ("", False), (None, False)])
def test_check_digit(spark, number, ok):
    assert one(spark, vin.check_ok, number) is ok


def test_vin_forms(spark):
    assert one(spark, vin.normal, " 1m8gdm9axkp 042788") == "1M8GDM9AXKP042788"
    assert one(spark, vin.normal, "short") is None
    assert one(spark, vin.masked, "1M8GDM9AXKP042788") == "***2788"


def test_text_functions(spark):
    assert one(spark, text.language, "der Wagen ist mit der Garantie") == "de"
    assert one(spark, text.language, "xyz") is None
    assert one(spark, text.redacted, "mail a.b@c.de or +49 30 1234567") == "mail [email] or [phone]"
    assert [one(spark, text.number, x) for x in ("1.234,5", "1,234.5 EUR", "12.000", "7")] == [1234.5, 1234.5, 12000.0, 7.0]
    assert [one(spark, text.fuel, x) for x in ("Diesel", "Benzin E10", "plug-in hybrid", "steam", None)] == ["diesel", "gasoline", "hybrid", "steam", None]
    assert one(spark, text.clean_photos, ["a.jpg", "data:x", "a.jpg#1", "p/pixel.gif", "b.svg", "b.jpg"], "array<string>") == ["a.jpg", "b.jpg"]


def test_asof_joins_agree(spark):
    left = spark.createDataFrame([(1, "A", 5), (2, "A", 10), (3, "A", 1), (4, "B", 9)], "id int, k string, t int").withColumn("t", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(t)"))
    right = spark.createDataFrame([("A", 2, 1.0), ("A", 5, 2.0), ("A", 11, 3.0)], "k string, t int, rate double").withColumn("t", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(t)"))
    want = {1: 2.0, 2: 2.0, 3: 1.5, 4: 1.5}
    assert {r["id"]: r["rate"] for r in joins.asof(left, right, "k", "t", "t", "rate", 1.5).collect()} == want
    assert {r["id"]: r["rate"] for r in joins.interval_asof(left, right, ("k", "k"), "t", "t", "rate", 1.5).collect()} == want


def test_first_match_and_hamming(spark):
    rules = spark.createDataFrame([(0, "AB"), (1, "A")], "ord int, prefix string")
    rows = spark.createDataFrame([("ABC",), ("AX",), ("Z",)], "code string")
    got = {r["code"]: r["rule"] and r["rule"]["ord"] for r in joins.first_match(rows, rules, F.col("code").startswith(F.col("prefix")), "ord", "code").collect()}
    assert got == {"ABC": 0, "AX": 1, "Z": None}
    values = [0, 0b1111, 0b11111, 1 << 63, (1 << 63) | 7, -1]
    hashes = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)], "id long, h long")
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and ((a ^ b) % 2**64).bit_count() <= 4}
    for plan in (None, (5, 0), (4, 1), (3, 1), (2, 2)):
        assert {(r["a"], r["b"]) for r in joins.hamming_pairs(hashes, plan=plan).collect()} == want
    # Pairs compared on even hashes: about as many for each of a billion hashes as for each of a thousand.
    assert [joins.hamming_plan(n, 4)[0] for n in (10, 1_000_000, 10**9)] == [5, 3, 2]


def test_upsert_and_delta(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "k int, v string, first string")
    new = spark.createDataFrame([(2, "B", "new"), (3, "c", "q"), (None, "m", "z")], "k int, v string, first string")
    got = sorted(map(tuple, storage.upsert(old, new, ["k"], F.col("v"), ("first",)).collect()), key=str)
    assert got == sorted([(1, "a", "x"), (2, "B", "y"), (3, "c", "q"), (None, "n", "z"), (None, "m", "z")], key=str)
    assert {r["k"]: r["state"] for r in storage.delta(old.dropna(), new.dropna(), "k").collect()} == {1: "GONE", 2: "KEPT", 3: "SEEN"}
    assert storage.insert_ignore(old, new.dropna(), ["k"]).count() == 4


def cohort(spark, n, slope=-0.1, odd=0.0):
    rows = [(f"v{i}", "BMW", "M1", 2020, "DE", 1000 + 100 * i, 30000 + slope * (1000 + 100 * i) + (odd if i == 0 else 0), "electric", "ACTIVE") for i in range(n)]
    return spark.createDataFrame(rows, "vehicle_id string, make string, model string, year int, country_code string, mileage_km int, price_gross_eur double, fuel_type string, dealer_status string")


def test_ev_cohorts(spark):
    assert market.ev_scores(cohort(spark, 19)).count() == 0
    flat = market.ev_scores(cohort(spark, 20)).collect()
    assert len(flat) == 20 and all(abs(r["z"]) < 2 for r in flat)
    worst = market.ev_scores(cohort(spark, 30, odd=-9000.0)).orderBy("z").first()
    assert worst["vehicle_id"] == "v0" and worst["flag"] == "severe" and worst["confidence"] == 0.3


def test_spread(spark):
    rows = [("v1", "BMW", "M1", 2020, "DE", 10, 100.0), ("v2", "BMW", "M1", 2020, "FR", 10, 150.5), ("v3", "BMW", "M1", 2020, "ES", 10, 100.0)]
    v = spark.createDataFrame(rows, "vehicle_id string, make string, model string, year int, country_code string, mileage_km int, price_gross_eur double").withColumns({"fuel_type": F.lit("diesel"), "dealer_status": F.lit("ACTIVE")})
    r = market.market_spread(v).first()
    assert (r["best_country"], r["worst_country"], r["spread_cents"], r["samples"]) == ("FR", "DE", 5050, 3)


def test_vat_regimes(spark):
    rows = [(1, "DE", "FR", 1_000_000, 0, True, 24, 50000), (2, "DE", "FR", 1_000_000, 0, False, 24, 50000), (3, "DE", "FR", 1_000_000, 0, True, 3, 50000), (4, "DE", "CH", 1_000_000, 0, True, 24, 50000), (5, "CH", "ES", 1_000_000, 0, True, 24, 50000)]
    req = spark.createDataFrame(rows, "id long, origin string, dest string, price_cents long, margin_cents long, ids_valid boolean, age_months int, km int")
    got = {(r["id"], r["place"]): (r["regime"], r["vat_cents"], r["total_cents"]) for r in money.vat_regimes(req).collect()}
    assert got[1, 1] == ("INTRA_COMMUNITY", 0, 1_000_000) and got[1, 2] == ("MARGIN_SCHEME", 23949, 1_000_000)
    assert [k for k in got if k[0] == 2] == [(2, 1)] and got[3, 1] == ("INTRA_COMMUNITY", 200_000, 1_200_000)
    assert got[4, 1] == ("EXPORT_IMPORT", 81_000, 1_081_000) and got[5, 1] == ("EXPORT_IMPORT", 210_000, 1_210_000)


def test_pnl(spark):
    day = datetime.date
    ledger = spark.createDataFrame([(1, "purchase", 1000, "EUR", day(2001, 1, 1)), (1, "reconditioning", 200, "CHF", day(2001, 1, 5)), (1, "sale", 1100, "EUR", day(2001, 1, 11)), (2, "purchase", 500, "EUR", day(2001, 1, 1))], "tenant_vehicle long, type string, amount_cents long, currency string, day date")
    fx = spark.createDataFrame([("CHF", day(2000, 1, 1), 0.5)], "from_currency string, valid_from date, rate double")
    pnl = money.vehicle_pnl(money.in_euro(ledger, fx))
    a, b = pnl.orderBy("tenant_vehicle").collect()
    assert (a["cost_cents"], a["margin_cents"], a["days"], a["cost_per_day"]) == (1100, 0, 10, 110)
    assert b["days"] == 272 and {tuple(r) for r in money.alerts(pnl).collect()} == {(1, "reconditioning_high"), (2, "stock_too_long")}
def test_trust_ramp(spark):
    base = "dealer_id long, vies_status string, registry string, registry_age int, v15 double, avg_score double, volume long, anomalies long, tenure_days int"
    rows = [(1, "valid", "registered", 9, 100.0, 100.0, 80, 0, 400), (2, "valid", "registered", 9, 100.0, 100.0, 80, 0, 10), (3, "none", "none", 0, 0.0, 0.0, 0, 9, 0)]
    got = {r["dealer_id"]: (r["trust_score"], r["tier"]) for r in dealers.trust(spark.createDataFrame(rows, base)).collect()}
    assert got[1] == (100.0, "platinum") and got[2][0] < 90.5 - 6 and got[3] == (0.0, "unverified")


def test_search_and_pages(spark):
    rows = spark.createDataFrame([(i, "Audi" if i % 2 else "BMW", "M1") for i in range(60)], "id int, make string, model string")
    assert [r["id"] for r in search.page(rows, 2, 25, F.asc("id")).collect()] == list(range(25, 50))
    assert search.word_search(rows, "the and").count() == 60 and search.word_search(rows, "an audi").count() == 30


PAGE = """<html><script type="application/ld+json">{"@graph": [{"@type": "Car", "brand": {"name": "BMW"}, "model": "X1", "vehicleModelDate": "2019-01",
 "mileageFromOdometer": {"value": "45,000"}, "fuelType": "Diesel", "offers": {"price": "21900"}, "url": "https://a/b"}]}</script><script type="application/ld+json">broken</script></html>"""


def test_sources(spark, tmp_path):
    row = files.html_vehicles(spark.createDataFrame([(PAGE,), (None,), ("<p>",)], "html string")).collect()
    assert [tuple(r) for r in row] == [("BMW", "X1", 2019, 45000, 21900.0, "Diesel", "https://a/b")]
    feed = "<rss><item><title><![CDATA[One]]></title><link>https://a/1</link></item></rss><feed><entry><title>Two</title><link href=\"https://a/2\"/></entry></feed>"
    assert {tuple(r) for r in files.feed_items(spark.createDataFrame([(feed,)], "xml string")).collect()} == {("One", "https://a/1"), ("Two", "https://a/2")}
    assert files.sitemap_urls(spark.createDataFrame([("<urlset><url><loc>https://a/cars/1</loc></url><url><loc>https://a/about</loc></url></urlset>",)], "xml string")).count() == 1
    csv = files.aliased(spark.createDataFrame([("VW", "Golf", "2018", "x")], "Marke string, Modell string, Baujahr string, Preis string")).first()
    assert (csv["make"], csv["year"], csv["price_eur"], csv["url"]) == ("VW", 2018, None, None)
    mapped = spark.createDataFrame([({"Marque": "Renault", "prix": "9000"},)], "m map<string,string>").select(files.aliased_map(F.col("m")).alias("v")).first()["v"]
    assert (mapped["make"], mapped["price_eur"]) == ("Renault", 9000.0)
    path = tmp_path / "fixed.txt"
    path.write_bytes("ï»¿AB  12\nÉX\n".encode("latin-1"))
    got = files.read_fixed_width(spark, f"file://{path}", [("a", 1, 4), ("b", 5, 2)], 6).collect()
    assert [tuple(r) for r in got] == [(False, "AB", "12"), (True, "ÉX", "")]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("data.txt", "l1\nl2")
        z.writestr("README.txt", "no")
    assert files.zip_lines(spark.createDataFrame([(bytearray(buffer.getvalue()),)], "content binary")).count() == 2
    assert one(spark, lambda c: files.fenced_json(c, "a int")["a"], "```json\n{\"a\": 3}\n```") == 3


def test_stream_steps(spark):
    raw = spark.createDataFrame([('{"vin": "V", "url": "https://a/b", "make": "A", "model": "B", "year": 2000, "mileage_km": 5, "price_raw": 1000, "currency": "EUR"}',)] * 2 + [("junk",), ('{"url": "https://a/", "make": "A", "model": "B", "year": 2000}',)], "value string")
    kept = ingest.viable(ingest.decoded(raw))
    assert kept.count() == 2 and ingest.deduplicated(kept, None).count() == 1
    assert ingest.converted(kept, spark.createDataFrame([("EUR", 1.0)], "currency string, rate double")).count() == 2
    assert ingest.decoded(raw, broken=True).count() == 1
    assert ingest.converted(kept, spark.createDataFrame([("CHF", 1.0)], "currency string, rate double")).count() == 0


LISTING = "vehicle_id string, vin string, make string, model string, year int, mileage_km int, price_eur long, fuel_type string, transmission string, photo_count int, source_url string, dealer_id long, source_country string, title string, description string, dat_code string, extracted_at timestamp_ntz, is_archive boolean, http_status int, body string, ai_disclosed boolean, dealer_confidence double, dealer_since date, phash long, photos array<struct<status:int,type:string,bytes:long,width:int,height:int,magic:string>>"
DECODED = "vin string, nhtsa_make string, nhtsa_model string, nhtsa_year int, nhtsa_error string"
GOOD = {
    "vehicle_id": "g", "vin": "1M8GDM9AXKP042788", "make": "BMW", "model": "320d", "year": 2019, "mileage_km": 40000, "price_eur": 30000, "fuel_type": "diesel", "transmission": "manual", "photo_count": 8, "source_url": "https://a.example/1", "dealer_id": 1, "source_country": "DE",
    "title": "BMW 320d Sport 2019", "description": "Der BMW 320d ist ein gepflegtes Fahrzeug und die Ausstattung ist komplett mit Klima.", "dat_code": "BMW3001", "extracted_at": datetime.datetime(2001, 9, 29, 12), "is_archive": False, "http_status": 200, "body": "on offer", "ai_disclosed": None,
    "dealer_confidence": 0.9, "dealer_since": datetime.date(2000, 1, 1), "phash": 0, "photos": [(200, "image/jpeg", 200000, 1200, 900, "ffd8ffe0")],
}


def judged(spark, *changes, decoded=(), only=None):
    names = [f.split(" ")[0] for f in LISTING.split(", ")]
    rows = [tuple({**GOOD, "vehicle_id": f"v{i}", "phash": 2**40 * (i + 1) * 341, "vin": GOOD["vin"] if i == 0 else f"{GOOD['vin'][:13]}{i:04d}", **c}[n] for n in names) for i, c in enumerate(changes)]
    frame, known = spark.createDataFrame(rows, LISTING), spark.createDataFrame(list(decoded), DECODED)
    return {(r["vehicle_id"], r["validator"]): r for r in quality.findings(frame, known, only or tuple(quality.WEIGHT)).collect()}, frame, known


def test_weights_add_up():
    assert sum(quality.WEIGHT.values()) == 176 and len(quality.WEIGHT) == 19 and len(quality.PRICES) == 47


def test_a_good_listing_passes_everything(spark):
    got, frame, known = judged(spark, {})
    assert all(r["pass"] for r in got.values()), {k: r["issue"] for k, r in got.items() if not r["pass"]}
    assert [tuple(r) for r in quality.composite(frame, known).collect()] == [("v0", 100.0, 0, "PUBLISH")]


@pytest.mark.parametrize("changes, passes, least, most", [
    ({"make": "BMW", "model": "320i", "title": "BMW 320i Sport Line 2020 48000km"}, True, 0.9, 1.0), ({"make": "BMW", "model": "320", "title": "BMV 320 sport 2020"}, True, 0.1, 0.99), ({"make": "BMW", "model": "320i", "title": "Voiture occasion 320i diesel 2020"}, False, 0.6, 0.6),
    ({"make": "BMW", "model": "M5", "title": "Voiture de sport premium automatique"}, False, 0.0, 0.2), ({"title": ""}, True, 1.0, 1.0), ({"model": "3 Series", "title": "bmw-series: the 3"}, True, 1.0, 1.0), ({"make": "", "model": ""}, True, 1.0, 1.0),
])
def test_make_and_model_in_title(spark, changes, passes, least, most):
    r = judged(spark, changes, only=["V04"])[0]["v0", "V04"]
    assert r["pass"] == passes and least <= r["confidence"] <= most and (r["pass"] or r["severity"] == "WARNING")


@pytest.mark.parametrize("changes, rule, outcome, confidence", [
    ({"price_eur": 10999}, "V07", "CRITICAL", 0.95), ({"price_eur": 11000}, "V07", "pass", 0.9), ({"price_eur": 80001}, "V07", "WARNING", 0.8), ({"price_eur": 0}, "V07", "CRITICAL", 1.0), ({"model": "X9"}, "V07", "pass", 0.5), ({"make": "bmw ", "model": "320D xDrive", "year": 0, "price_eur": 10999}, "V07", "CRITICAL", 0.95),
    ({"year": 2016, "price_eur": 6499}, "V07", "CRITICAL", 0.95), ({"dat_code": "bmw3xx"}, "V03", "pass", 0.9), ({"dat_code": "VWGO"}, "V03", "WARNING", 0.85), ({"make": "MERCEDES-BENZ", "model": "A-CLASS", "dat_code": "MBA1"}, "V03", "WARNING", 0.85), ({"model": "Isetta"}, "V03", "pass", 0.5),
    ({"photos": [(404, "image/jpeg", 1, 0, 0, "")]}, "V05", "CRITICAL", 0.9), ({"photos": [(500, "image/jpeg", 1, 0, 0, "")]}, "V05", "WARNING", 0.9), ({"photos": [(200, "text/html", 99999, 0, 0, "")]}, "V05", "CRITICAL", 0.9), ({"photos": [(200, "image/jpeg", 20000, 0, 0, "00")]}, "V05", "WARNING", 0.9),
    ({"photos": [(200, "image/jpeg", 99999, 640, 900, "00")]}, "V05", "WARNING", 0.9), ({"photos": [(200, "image/png; x", 99999, 0, 0, "ffd8")]}, "V05", "CRITICAL", 0.9), ({"photos": [(200, "image/avif", 99999, 0, 0, "00")]}, "V05", "pass", 0.9), ({"photos": []}, "V05", "pass", 1.0),
    ({"year": 2022}, "V09", "WARNING", 0.8), ({"year": 2023}, "V09", "CRITICAL", 1.0), ({"year": 1899}, "V09", "CRITICAL", 1.0), ({"title": "BMW 320d 2018"}, "V09", "WARNING", 0.8), ({"title": "BMW 1979 320d"}, "V09", "pass", 1.0), ({"year": 0}, "V09", "pass", 1.0),
    ({"http_status": 404}, "V10", "CRITICAL", 0.95), ({"http_status": 307}, "V10", "pass", 0.9), ({"http_status": 502}, "V10", "WARNING", 0.6), ({"http_status": -1}, "V10", "WARNING", 0.5), ({"http_status": 403}, "V10", "pass", 0.7),
    ({"description": "TODO"}, "V11", "CRITICAL", 1.0), ({"ai_disclosed": False}, "V11", "CRITICAL", 1.0), ({"description": "Kurz, BMW 320d."}, "V11", "WARNING", 0.85), ({"description": "BMW 320d. " + "Sehr guter Wagen! sehr guter  wagen. SEHR GUTER WAGEN? und der die"}, "V11", "WARNING", 0.85), ({"description": "The BMW 320d has been serviced and comes with the papers for this car."}, "V11", "WARNING", 0.85),
    ({"extracted_at": datetime.datetime(2001, 9, 29)}, "V14", "pass", 1.0), ({"extracted_at": datetime.datetime(2001, 9, 27)}, "V14", "pass", 0.95), ({"extracted_at": datetime.datetime(2001, 9, 26, 23)}, "V14", "WARNING", 0.85), ({"extracted_at": datetime.datetime(2001, 9, 22)}, "V14", "CRITICAL", 0.9), ({"is_archive": True, "extracted_at": None}, "V14", "pass", 1.0),
    ({"dealer_confidence": 0.7, "dealer_since": datetime.date(2001, 9, 20)}, "V15", "pass", 0.5), ({"dealer_confidence": 0.3}, "V15", "WARNING", 0.3), ({"dealer_confidence": 0.29}, "V15", "CRITICAL", 0.29), ({"dealer_confidence": None}, "V15", "CRITICAL", 0.95),
    ({"body": "an UNSOLD car"}, "V17", "CRITICAL", 0.88), ({"body": '{"availability":"http://schema.org/OutOfStock"}'}, "V17", "CRITICAL", 0.98), ({"body": "Annonce expirée"}, "V17", "CRITICAL", 0.88), ({"http_status": 404, "body": "sold"}, "V17", "pass", 0.7), ({"http_status": 410}, "V17", "CRITICAL", 1.0),
    ({"source_country": "FR"}, "V18", "WARNING", 0.85), ({"source_country": "CH"}, "V18", "pass", 0.9), ({"source_country": "JP"}, "V18", "pass", 1.0), ({"description": "xyz"}, "V18", "pass", 0.5), ({"source_country": "CH"}, "V19", "pass", 0.8), ({"price_eur": 1000001}, "V19", "WARNING", 0.85), ({"price_eur": -1}, "V19", "CRITICAL", 1.0),
    ({"make": "", "model": "", "price_eur": 0, "year": 0, "photo_count": 0}, "V13", "WARNING", 0.45),
])
def test_rules(spark, changes, rule, outcome, confidence):
    r = judged(spark, changes, only=[rule])[0]["v0", rule]
    assert ("pass" if r["pass"] else r["severity"], r["confidence"]) == (outcome, pytest.approx(confidence))


def test_rules_across_listings(spark):
    same = GOOD["vin"]
    got, _, _ = judged(spark, {}, {"vin": same, "dealer_id": 2, "phash": 2**40 * 341 ^ 0b1111}, {"phash": 2**40 * 341 ^ 0b11111}, decoded=[(same, "BMW", "320D", 2020, "")], only=["V02", "V09", "V12", "V16"])
    assert not got["v0", "V02"]["pass"] and got["v2", "V02"]["confidence"] == 0.0 and not got["v0", "V09"]["pass"]
    assert got["v0", "V12"]["severity"] == "WARNING" and got["v2", "V12"]["pass"]
    assert [got[f"v{i}", "V16"]["pass"] for i in range(3)] == [False, False, False]
    assert judged(spark, {}, {"phash": 2**40 * 341 ^ 0b11111}, only=["V16"])[0]["v0", "V16"]["pass"]


def test_decisions_from_stored_results(spark):
    full = [(k, True, "INFO") for k in quality.WEIGHT]

    def decided(*changes, keep=tuple(quality.WEIGHT)):
        rows = [("v", k, ok, sev, 1) for k, ok, sev in full if k in keep] + [("v", k, ok, sev, 2) for k, ok, sev in changes]
        r = quality.composite_of_results(spark.createDataFrame(rows, "vehicle_id string, validator string, pass boolean, severity string, validated_at int")).first()
        return r["score"], r["decision"]

    assert decided() == (100.0, "PUBLISH")
    assert decided(("V01", False, "CRITICAL"), ("V02", False, "CRITICAL"))[1] == "REJECT"
    assert decided(("V01", False, "CRITICAL")) == (pytest.approx(100 * 161 / 176, abs=1e-4), "MANUAL_REVIEW")
    assert decided(("V16", False, "WARNING"), ("V18", False, "INFO")) == (pytest.approx(100 * 171 / 176, abs=1e-4), "PUBLISH")  # 5 gives 2, 4 gives 2
    assert decided(*((k, False, "WARNING") for k in quality.WEIGHT))[1] == "REJECT"
    assert decided(keep=("V01", "V02")) == (100.0, "PUBLISH")


@pytest.mark.parametrize("scores, last", [([50, 55, 58, 70], "improving"), ([80, 75, 72, 60], "deteriorating"), ([65, 66, 67], "stable"), ([80], "stable"), ([70, 80], "stable"), ([0, 60, 60, 60, 64], "stable"), ([60, 60, 60, 65], "stable")])
def test_trends(spark, scores, last):
    rows = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)], "dealer_id int, mth int, score double")
    got = {r["mth"]: r["trend"] for r in market.trends(rows).collect()}
    assert len(got) == len(scores) and got[len(scores) - 1] == last


def greedy(routes, share=0.2):
    """One vehicle after another."""
    best = {}
    for v, c, net in routes:
        best.setdefault(v, {})
        best[v][c] = max(net, best[v].get(c, net))
    wishes = {v: sorted(((-n, c) for c, n in own.items())) for v, own in best.items()}
    cap, used, out = max(1, int(len(wishes) * share + 0.999)), {}, {}
    for v in sorted(wishes, key=lambda v: (wishes[v][0][0], v)):
        to = next((c for _, c in wishes[v] if used.get(c, 0) < cap), wishes[v][0][1])
        used[to] = used.get(to, 0) + 1
        out[v] = to
    return out, cap, used


def test_capped_assignment(spark):
    rng = np.random.default_rng(2)
    cases = [[(f"v{i}", c, 100 - j) for i in range(10) for j, c in enumerate(("DE", "FR", "ES", "NL", "BE", "CH"))], [("a", "DE", 5)], [(f"v{i}", "DE", i) for i in range(7)]]
    cases += [[(f"v{i}", c, int(rng.integers(0, 20))) for i in range(60) for c in rng.permutation(["DE", "FR", "ES", "NL", "BE", "CH"])[: rng.integers(1, 7)]] for _ in range(3)]
    for routes in cases:
        got = {r["vehicle_id"]: r["country"] for r in money.capped(spark.createDataFrame(routes, "vehicle_id string, country string, net_cents int")).collect()}
        want, cap, used = greedy(routes)
        assert got == want
    got = money.capped(spark.createDataFrame(cases[0], "vehicle_id string, country string, net_cents int")).groupBy("country").count().collect()
    assert sum(r["count"] for r in got) == 10 and max(r["count"] for r in got) == 2


def test_hamming_links(spark):
    values = [5, 5, 5 ^ 0b1111, 5 ^ 0b11111, 0xFFFF << 40, None]
    got = {r["id"]: (r["class_id"], r["links"]) for r in joins.hamming_links(spark.createDataFrame(list(enumerate(values)), "id long, h long")).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 2), 3: (3, 1), 4: (4, 0), 5: (None, 0)}


def trigrams(name):
    def fnv(raw):
        h = 2166136261
        for b in raw:
            h = ((h ^ b) * 16777619) % 2**32
        return h

    clean = "".join(c for c in name.lower() if c.isalpha() or c.isdecimal() or c.isspace()).strip()
    out = np.zeros(256)
    for i in range(len(clean) - 2):
        out[fnv(clean[i : i + 3].encode()) % 256] += 1
    return out / max(1e-12, np.sqrt((out**2).sum()))


def test_similar_names_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = ["Autohaus", "Garage", "Müller", "Meyer", "Dupont", "Nord", "Süd", "GmbH", "Automobiles", "Motors"]
    names = [(i, "DE" if i % 3 else "FR", " ".join(rng.choice(words, rng.integers(1, 5))) + ("!" if i % 4 == 0 else "")) for i in range(90)] + [(90, "DE", ""), (91, "DE", None)]
    table = spark.createDataFrame(names, "dealer_id long, country_code string, canonical_name string")
    vectors = {r["dealer_id"]: r["v"] for r in table.select("dealer_id", text.trigram_vector("canonical_name").alias("v")).collect()}
    assert all(np.allclose(vectors[i], trigrams(n or ""), atol=1e-6) for i, _, n in names)
    want = {}
    for i, b, n in names:
        best = sorted((-round(float(np.dot(trigrams(n or ""), trigrams(m or ""))), 5), j) for j, c, m in names if j != i and c == b)
        if n and best[0][0] <= -0.85:
            want[i] = best[0]
    got = {r["dealer_id"]: (r["cosine"], r["match"]) for r in feeds.similar(table).collect() if r["dealer_id"] < 90}
    assert set(got) == set(want)
    for i, (cosine, match) in got.items():
        assert abs(cosine + want[i][0]) < 2e-5 and (match == want[i][1] or abs(np.dot(vectors[i], vectors[match]) + want[i][0]) < 2e-5)


def test_similar_names_meet_in_parts_of_bounded_size(spark):
    table = spark.createDataFrame([(i, "DE" if i % 4 else None, f"Supplier#{i * 37 % 1000:09d}") for i in range(300)], "dealer_id long, country_code string, canonical_name string")
    whole = sorted(map(tuple, feeds.similar(table).collect()))
    assert whole == sorted(map(tuple, feeds.similar(table, side=40).collect()))
    vectors = {r["dealer_id"]: np.array(r["v"], np.float64) for r in table.where("country_code is not null").select("dealer_id", text.trigram_vector("canonical_name").alias("v")).collect()}
    for i, match, cosine in whole:
        best = min((-round(sum((vectors[i] * v).tolist()), 6), j) for j, v in vectors.items() if j != i)
        assert (-cosine, match) == best if cosine < 1 else best[0] > -1.000001


def test_rate_limits(spark):
    def allowed(batches, limit=1000, seconds=60):
        start, used, out = None, 0, []
        for at, n in batches:
            if start is None or at > start + seconds:
                start, used = at, n
                out.append(n <= limit)
            elif used + n > limit:
                out.append(False)
            else:
                used += n
                out.append(True)
        return out

    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    rng = np.random.default_rng(7)
    for _ in range(30):
        batches = sorted((int(a), int(n)) for a, n in zip(rng.integers(0, 400, 60), rng.integers(0, 700, 60)))
        state, got = State(), []
        for at in range(0, 60, 13):  # over several micro-batches
            part = pd.DataFrame(batches[at : at + 13], columns=["at", "size"])
            got += next(ingest._limited(1000, 60)((1,), iter([part[:5], part[5:]]), state))["accepted"].tolist()
        assert got == allowed(batches)
    state = State()
    first = pd.DataFrame([(0, 1500), (1, 10), (60, 10), (61, 10)], columns=["at", "size"])
    assert next(ingest._limited(1000, 60)((1,), iter([first]), state))["accepted"].tolist() == [False, False, False, True]


def test_merges(spark):
    old = spark.createDataFrame([(1, 100.0, 0, "a"), (2, 50.0, 3, "b"), (None, 7.0, 0, "n")], "k int, price double, drops int, note string")
    new = spark.createDataFrame([(1, 90.0, None), (2, 60.0, "B"), (3, 10.0, "c"), (None, 8.0, "m")], "k int, price double, note string")
    changes = {"price": F.col("new.price"), "note": F.coalesce("new.note", "old.note"), "drops": F.col("old.drops") + (F.col("new.price") < F.col("old.price")).cast("int")}
    got = sorted(map(tuple, storage.merge(old, new, ["k"], changes, inserted={"drops": F.lit(0)}).collect()), key=str)
    assert got == sorted([(1, 90.0, 1, "a", "updated"), (2, 60.0, 3, "B", "updated"), (3, 10.0, 0, "c", "inserted"), (None, 7.0, 0, "n", "kept"), (None, 8.0, 0, "m", "inserted")], key=str)
    guarded = storage.merge(old, new, ["k"], changes, when=F.col("old.price") > 60, inserted={"drops": F.lit(0)}).where("k = 2").first()
    assert (guarded["price"], guarded["__state"]) == (50.0, "kept")


def test_feed_files(spark, tmp_path):
    row = spark.createDataFrame([("v1", "BMW", 'the "M"; x', 100, ["a", "b"], ["p1", "p2", "p3", "p4"]), ("v2", "BMW", "", 100, [], []), ("v3", "BMW", "x", 0, [], [])], "vehicle_id string, make string, model string, price_cents long, features array<string>, photo_urls array<string>")
    storage.write_feed(row, f"file://{tmp_path}/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/csv")
    assert tuple(back.columns) == storage.FEED and len(storage.FEED) == 24 and back.count() == 1
    r = back.first()
    assert (r["model"], r["features"], r["photo_url_3"], r["vin"]) == ('the "M"; x', "a|b", "p3", None)
    storage.write_feed(row, f"file://{tmp_path}/xml", "xml")
    x = spark.read.format("xml").option("rowTag", "listing").load(f"file://{tmp_path}/xml").first()
    assert (x["vehicleId"], x["priceCents"], list(x["photos"]["photo"]), list(x["features"]["feature"])) == ("v1", 100, ["p1", "p2", "p3"], ["a", "b"])


def test_claims_are_apart(spark):
    queue = spark.range(300).selectExpr("id", "300 - id AS created_at", "CASE WHEN id % 5 = 0 THEN 'x' END AS claimed_by")
    got = storage.claimed(queue, 4, 20).collect()
    assert len(got) == 80 and len({r["id"] for r in got}) == 80 and all(r["id"] % 5 for r in got)


def test_trimmed_mean(spark):
    rng = np.random.default_rng(1)
    prices = {c: np.round(rng.exponential(20000, n), 2).tolist() + [5.0] * t for c, n, t in (("DE", 101, 40), ("FR", 3, 0), ("ES", 50, 500), ("NL", 1, 0))}
    rows = spark.createDataFrame([(c, p) for c, own in prices.items() for p in own], "country_code string, price_gross_eur double")
    for ranges in (4096, 3, 1):
        got = {r["country_code"]: r["trimmed_mean"] for r in market.trimmed_means(rows, ranges).collect()}
        for c, own in prices.items():
            own = sorted(own)
            mid = [p for i, p in enumerate(own, 1) if len(own) * 0.25 < i <= len(own) * 0.75]
            assert (got.get(c) is None) == (not mid) and (not mid or abs(got[c] - np.mean(mid)) < 1e-3)


def test_normalisers(spark):
    cases = [
        (text.fuel, {"Diesel": "diesel", " Électrique ": "electric", "Plug-in Hybrid": "hybrid", "GNV / essence": "gasoline", "steam": "steam"}), (text.transmission, {"Semi-Automatic": "semi-automatic", "7-Gang DSG": "automatic", "Schaltgetriebe": "manual", "x": "x"}),
        (text.body, {"Kombi": "estate", "Coupé 2T": "coupe", "Pick-Up": "pickup", "SUV": "suv"}), (text.fuel_code, {"Blue HDi 130": "DIESEL", "chevy": "ELECTRIC", "something rather long indeed": "SOMETHING RATHER LON"}), (text.transmission_code, {"BVA6": "AUTOMATIC", "manuelle": "MANUAL", "retreat": "AUTOMATIC", "x": "X"}),
        (text.title_case, {"mercedes-benz": "Mercedes-Benz", " ALFA romeo ": "Alfa Romeo", "": ""}), (text.dealer_name, {"Autohaus Müller & Söhne GmbH & Co. KG": "müller  söhne", "Garage du Lac SARL": "du lac", "X1 Motors": "x motors"}),
    ]
    for function, examples in cases:
        for raw, want in examples.items():
            assert one(spark, function, raw) == want, (function.__name__, raw)


def test_dealer_names_in_text(spark):
    article = "Das Autohaus Muster GmbH, sowie Müller Auto AG und Garage Dupont SARL. Auch Mueller Motors und Mueller Motors sind da."
    got = [r["normal"] for r in one(spark, text.dealer_names, article)]
    assert got == ["muster", "müller auto", "dupont", "auch mueller motors", "mueller motors"]
    read = lambda text_: [r["normal"] for r in one(spark, text.dealer_names, text_)]
    assert "muster" in read("Der Automobilhändler Autohaus Muster GmbH hat heute eine neue Filiale in Berlin eröffnet.")
    assert read("Le Garage Dupont SARL a été racheté par Garage Martin SAS, dit-on.") == ["dupont", "martin"]
    assert read("The weather in Berlin was sunny yesterday. No dealers mentioned here.") == []
    assert read("Autohaus Muster GmbH hat eröffnet. Das AUTOHAUS Muster GmbH dankt; Talleres García SL y el Garage de la Gare") == ["muster", "garcía", "de la gare"]
    assert read("") == [] and read("Garage") == []


def test_listing_document(spark):
    row = spark.createDataFrame([("BMW", None, "", 5)], "a string, b string, c string, d int")
    doc = row.select(text.listing_document({"": F.col("a"), "model": F.col("b"), "fuel": F.col("c"), "km": F.col("d")}).alias("x")).first()["x"]
    assert doc == "BMW km 5"


def test_stream_windows_drop_late_rows(spark, tmp_path):
    """Rows later than the watermark allows change no window that is closed."""
    folder, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    at = lambda minutes: (datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)).isoformat(sep=" ")
    batches = [[(0, 1.0), (70, 1.0)], [(400, 1.0)], [(10, 5.0), (405, 1.0)], [(1000, 1.0)], [(1001, 1.0)]]
    import os

    os.mkdir(folder)

    def run():
        stream = spark.readStream.schema("ts timestamp, event_type string, value double").json(f"file://{folder}")
        query = ingest.windowed(stream, "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    for i, rows in enumerate(batches):
        with open(f"{folder}/{i}.json", "w") as f:
            f.write("\n".join(json.dumps({"ts": at(m), "event_type": "view", "value": v}) for m, v in rows))
        run()
    got = {r["start"] % 86400 // 3600: (r["n"], r["value"]) for r in spark.read.parquet(out).collect()}
    assert got == {0: (1, 1.0), 1: (1, 1.0), 6: (2, 2.0)}


def test_stream_ingest_over_several_batches(spark, tmp_path):
    """A price that falls from one micro-batch to the next is one event and one drop; a batch that is run again counts once."""
    listing = lambda vin, price, km=5: {"vin": vin, "url": f"https://a/{vin}", "make": "A", "model": "B", "year": 2000, "mileage_km": km, "color": "Red", "price_raw": price, "currency": "EUR", "lat": 48.2, "lng": 2.3, "photo": "p"}
    sink = ingest.Ingest(spark, f"file://{tmp_path}/ingest")
    rates = spark.createDataFrame([("EUR", 1.0)], "currency string, rate double")
    for number, rows in enumerate(([listing("V1", 1000), listing("V2", 2000)], [listing("V1", 900), listing("V3", 100)], [listing("V1", 950)])):
        batch = ingest.ingest_steps(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"), rates)
        sink(batch, number)
        sink(batch, number)
    state = {r["vin"]: (r["price_eur"], r["drops"], r["cell"]) for r in sink.state(2).collect()}
    assert state == {"V1": (950.0, 1, "g0.5:96:4"), "V2": (2000.0, 0, "g0.5:96:4")}
    events = sorted((r["vin"], r["kind"], r["value"]) for r in spark.read.parquet(f"file://{tmp_path}/ingest/history").collect())
    assert events == sorted([("V1", "LISTING", 1000.0), ("V2", "LISTING", 2000.0), ("V1", "PRICE_CHANGE", 100.0)] + [("V1", "MILEAGE", 5.0)] * 3 + [("V2", "MILEAGE", 5.0)])
    assert spark.read.parquet(f"file://{tmp_path}/ingest/thumbs").count() == 4


ANSWERS = {
    "sirene": ({"etablissements": [{"siret": "1", "uniteLegale": {"denominationUniteLegale": "GARAGE UN", "etatAdministratifUniteLegale": "A"}, "adresseEtablissement": {"numeroVoieEtablissement": "12", "typeVoieEtablissement": "RUE", "libelleVoieEtablissement": "X", "codePostalEtablissement": "75001", "libelleCommuneEtablissement": "PARIS"}}, {"siret": "2", "uniteLegale": {"denominationUniteLegale": "ZU", "etatAdministratifUniteLegale": "C"}}]}, [("A", "GARAGE UN", "1", "12 RUE X", "FR")]),
    "kvk": ({"resultaten": [{"kvkNummer": "9", "naam": "Auto BV", "adres": {"binnenlandsAdres": {"straatnaam": "Weg", "huisnummer": 4}}}]}, [("A", "Auto BV", "9", "Weg 4", "NL")]),
    "overpass": ({"elements": [{"type": "node", "id": 5, "lat": 50.1, "lon": 8.5, "tags": {"name": "Auto M", "addr:street": "S", "addr:country": "DE"}}, {"type": "way", "id": 6}]}, [("B", "Auto M", "node 5", "S", "DE"), ("B", None, "way 6", None, None)]),
    "wikidata": ({"results": {"bindings": [{"dealer": {"value": "Q1"}, "dealerLabel": {"value": "Auto W"}, "coords": {"value": "Point(8.5 50.25)"}}]}}, [("B", "Auto W", "Q1", None, None)]),
    "archive": ({"archived_snapshots": {"closest": {"timestamp": "2023"}, "url": "u"}}, [("C", None, None, None, None)]),
    "mobilians": ({"hits": [{"id": "M1", "title": "Garage D", "street": "1 R"}]}, [("G", "Garage D", "M1", "1 R", "FR")]),
    "makers": ({"result": {"dealers": [{"dealerId": "T2", "name": "Toyota U", "address": {"street": "V", "zipCode": "1", "country": "NL"}}]}}, [("H", "Toyota U", "T2", "V", "NL")]),
    "rdw": ([{"volgnummer": 7, "handelsnaam": "APK", "straat": "L", "huisnummer": 2}], [("I", "APK", "7", "L 2", "NL")]),
    "utac": ({"results": [{"no_agrement": "S1", "nom_centre": "CT", "adresse": "A"}]}, [("I", "CT", "S1", "A", "FR")]),
    "pappers": ({"resultats": [{"siren": "3", "nom_entreprise": "P", "siege": {"adresse_ligne_1": "Q"}}]}, [("J", "P", "3", "Q", "FR")]),
    "searxng": ({"results": [{"title": "T", "url": "https://t"}]}, [("K", "T", None, None, None)]),
    "youtube": ({"items": [{"id": {"channelId": "c"}, "snippet": {"title": "Y", "country": "DE"}}]}, [("L", "Y", "c", None, "DE")]),
    "vies": ({"isValid": True, "vatNumber": "V", "name": "N", "address": "A", "countryCode": "BE"}, [("M", "N", "V", "A", "BE")]),
    "censys": ({"result": {"hits": [{"ip": "1.2.3.4"}]}}, [("N", None, "1.2.3.4", None, None)]),
    "shodan": ({"matches": [{"ip_str": "1.2.3.5", "hostnames": ["h.example"]}]}, [("N", None, "1.2.3.5", None, None)]),
    "gdelt": ({"articles": [{"title": "Autohaus Meyer GmbH, neu", "url": "https://n", "sourcecountry": "Germany"}]}, [("O", "Autohaus Meyer GmbH, neu", None, None, "Germany")]),
}


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_answers_of_dealer_sources(spark, name):
    answer, want = ANSWERS[name]
    rows = spark.createDataFrame([(json.dumps(answer),), ("no json",), ("{}",), (None,)], "body string")
    got = dumps.dealers(rows, name)
    assert tuple(got.columns) == dumps.SCHEMA
    assert sorted((tuple(r[c] for c in ("family", "name", "identifier", "street", "country")) for r in got.collect()), key=str) == sorted(want, key=str)
    if name == "wikidata":
        assert (got.first()["lat"], got.first()["lng"]) == (50.25, 8.5)
    if name == "gdelt":
        assert [r["normal"] for r in dumps.article_dealers(got).collect()] == ["meyer"]


def test_pages_of_dealer_sources(spark):
    page = '<script id="__NEXT_DATA__" type="application/json"> {"props": {"pageProps": {"page": {"name": "A", "kvkNumber": "1", "address": {"street": "T", "housenumber": 42}}}}} </script>'
    r = dumps.dealers(spark.createDataFrame([(page,), ("<p>",)], "body string"), "bovag").collect()
    assert [(x["name"], x["identifier"], x["street"], x["country"]) for x in r] == [("A", "1", "T 42", "NL")]
    hosts = [{"id": 1, "common_name": "a.de", "name_value": "a.de\nwww.a.de\n*.a.de"}, {"id": 2, "common_name": "a.de", "name_value": "a.de"}]
    assert {x["website"] for x in dumps.dealers(spark.createDataFrame([(json.dumps(hosts),)], "body string"), "certificates").collect()} == {"a.de", "www.a.de"}
    xml = '<sumario><empresa id="B-1"><nombre_empresa> AUTO SL </nombre_empresa><acto>Alta</acto><provincia>Madrid</provincia></empresa><empresa id="B-2"><nombre_empresa>Z</nombre_empresa></empresa></sumario>'
    assert [tuple(x) for x in dumps.registry_xml(spark.createDataFrame([(xml,)], "xml string")).collect()] == [("B-1", "AUTO SL", "Alta", "Madrid"), ("B-2", "Z", None, None)]
    cards = '<div class="dealerItem"><h3><a href="/h/1">Auto M</a></h3> Weg 1, 12345 B <a href="https://m.de" class="dealerWebsite">x</a></div>'
    assert [tuple(x) for x in dumps.directory_cards(spark.createDataFrame([(cards,)], "html string"), *dumps.CARDS["mobile"]).collect()] == [("Auto M", "Weg 1, 12345 B", "https://m.de")]
    assert one(spark, dumps.content_system, '<meta name="generator" content="WordPress 6.1">') == ("wordpress", "6.1") and one(spark, dumps.content_system, "<p>") is None
    shared = spark.createDataFrame([("h", 1, None), ("h", 2, "p"), ("i", 3, "q")], "host string, dealer_id int, provider string")
    assert [tuple(r) for r in dumps.shared_hosts(shared).collect()] == [("h", [1, 2], "p")]


def test_confidence_by_families(spark):
    table = lambda family, names: spark.createDataFrame([(family, n) for n in names], "family string, name string")
    got = {r["normal"]: (r["confidence"], r["families"]) for r in dumps.confirmed([table("A", ["Auto X GmbH", "AUTO X"]), table("H", ["auto x", "Y AG"])], {"A": 0.35, "H": 0.25}).collect()}
    assert got == {"auto x": (0.6, 2), "y": (0.25, 1)}


def test_json_bodies_and_posts(spark):
    bodies = ['[{"Marke": "VW", "modell": "Golf", "KM": "5"}]', '{"total": 1, "vehicles": [], "items": [{"brand": "BMW", "price": 7}]}', '{"x": 1}', "junk", None]
    got = files.json_vehicles(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert sorted((r["make"], r["model"], r["mileage_km"], r["price_eur"]) for r in got) == [("BMW", None, None, 7.0), ("VW", "Golf", 5, None)]
    posts = '[{"id": 3, "title": {"rendered": "A <b>Golf</b>"}, "link": "https://a/3", "meta": {"_make": "VW", "_year": "2019"}}]'
    r = files.posts(spark.createDataFrame([(posts,), (None,)], "body string")).collect()
    assert [(x["post_id"], x["title"], x["make"], x["year"], x["url"]) for x in r] == [(3, "A Golf", "VW", 2019, "https://a/3")]
    push = spark.createDataFrame([("1M8GDM9AXKP042788", "A", "B", 2020), ("x", "A", "B", 2020), ("", "A", "B", 2020), ("1M8GDM9AXKP042788", "A", "B", 2030)], "vin string, make string, model string, year int")
    assert [r["error"] for r in files.pushed(push, 2021).collect()] == [None, "vin must be 17 characters", "vin required", "year out of range"]
    assert files.pending(spark.range(5), spark.range(2)).count() == 3


def workbook(rows):
    buffer = io.BytesIO()
    cell = lambda i, j, v: f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if not v.isdigit() else f'<c r="{chr(65 + j)}{i + 1}"><v>{v}</v></c>'
    sheet = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(r) if v) + "</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
    return bytearray(buffer.getvalue())


def test_tables_in_documents(spark):
    rows = [["Fahrzeug-Marke", "Modell", "Baujahr", "", "Preis (EUR)"], ["VW", "Golf", "2018", "", "12.500,00"], ["", "", "", "", ""], ["BMW", "X1", "18", "", "x"]]
    want = [("VW", "Golf", 2018, 12500.0), ("BMW", "X1", None, None)]
    got = files.workbook_vehicles(spark.createDataFrame([(workbook(rows),)], "content binary")).collect()
    assert [(r["make"], r["model"], r["year"], r["price_eur"]) for r in got] == want
    page = "Our stock\n\nMake   Model   Year | Price\nVW\tGolf\t2018\t12500\nBMW   X1   18   x\n"
    got = files.document_vehicles(spark.createDataFrame([(page,), (None,), ("nothing here",)], "text string")).collect()
    assert [(r["make"], r["model"], r["year"], r["price_eur"]) for r in got] == want


def test_marked_up_pages(spark):
    page = """<div itemscope itemtype="https://schema.org/Car"><span itemprop="brand">BMW</span><b itemprop="model">X <i>1</i></b><meta itemprop="vehicleModelDate" content="2019"><span itemprop="mileageFromOdometer">45,000 km</span>
 <div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><span itemprop="price">21,900</span></div><a itemprop="url" href="/c/1">x</a></div><div itemscope itemtype="https://schema.org/Car"><span itemprop="model">no make</span></div>
 <div typeof="schema:Vehicle"><span property="schema:brand">VW</span><span property="schema:fuelType" content="diesel"></span></div><p itemprop="brand">outside</p>"""
    got = files.marked_pages(spark.createDataFrame([(page,), (None,)], "html string")).collect()
    assert [tuple(r) for r in got] == [("BMW", "X 1", 2019, 45000, 21900.0, None, "/c/1"), ("VW", None, None, None, None, "diesel", None)]
    two = '<script type="application/ld+json">[{"@type": "Car", "model": "X1"}, {"@type": "Car", "model": "X2", "brand": "BMW"}]</script>'
    r = files.first_json_ld_pages(spark.createDataFrame([(two,), ("<p>",)], "html string")).collect()
    assert len(r) == 1 and r[0]["make"] == "BMW" and r[0]["model"] in ("X1", "X2")


def test_links(spark):
    xml = [("<sitemapindex><sitemap><loc>https://a/s.xml</loc></sitemap></sitemapindex>",), ("<urlset><url><loc> https://a/c/1 </loc></url></urlset>",)]
    assert {tuple(r) for r in files.sitemaps(spark.createDataFrame(xml, "xml string")).collect()} == {("sitemap", "https://a/s.xml"), ("page", "https://a/c/1")}
    for link, want in {"b.html": "https://h.de/x/b.html", "/b": "https://h.de/b", "//c.fr/d": "https://c.fr/d", "http://e": "http://e"}.items():
        assert one(spark, lambda c: files.resolved(F.lit("https://h.de/x/a.html?q=1"), c), link) == want
    assert [one(spark, files.country_of, u) for u in ("https://www.a.de/x", "http://a.fr:80", "https://a.com", None)] == ["DE", "FR", None, None]


def test_filters_that_are_not_set(spark):
    rows = spark.createDataFrame([("DE", 100.0, 5, 2020, "Diesel"), ("FR", 900.0, 50, 2010, "electric")], "country_code string, price_gross_eur double, mileage_km int, year int, fuel_type string")
    assert desk.post_filters(rows, price_max=0, km_max=0, country="").count() == 2
    assert desk.post_filters(rows, price_max=500, fuel_type="diesel", country="de").count() == 1
    with pytest.raises(ValueError):
        desk.scoped(rows, None)


def test_rerank_falls_back_to_the_first_order(spark):
    hits = spark.createDataFrame([(1, "audi petrol"), (2, "bmw diesel"), (3, "BMW petrol"), (4, "bmw petrol")], "rank int, doc string")
    order = lambda df: [r["rank"] for r in df.orderBy("place").collect()]
    assert order(desk.reranked(hits, desk.lexical_score("bmw diesel", F.col("doc")))) == [2, 3, 4, 1]
    assert order(desk.reranked(hits, None)) == [1, 2, 3, 4] and order(desk.reranked(hits, desk.lexical_score("", F.col("doc")))) == [1, 2, 3, 4]


def test_frontier_draws_repeat(spark):
    shards = spark.createDataFrame([("a", 1, 1), ("b", 500, 1), ("c", 1, 500)], "shard string, alpha int, beta int")
    first, again, other = ({r["shard"]: r["draw"] for r in desk.sampled_frontier(shards, s).collect()} for s in (1, 1, 2))
    assert first == again != other and first["b"] > 0.9 > 0.1 > first["c"]


def test_perceptual_hash(spark):
    rng = np.random.default_rng(3)
    base = np.kron(rng.integers(0, 200, (8, 8)), np.ones((16, 16))).astype(np.uint8)
    dark, noisy, other = (base * 0.8).astype(np.uint8), np.clip(base + rng.normal(0, 3, base.shape), 0, 255).astype(np.uint8), np.kron(rng.integers(0, 200, (8, 8)), np.ones((16, 16))).astype(np.uint8)
    rows = spark.createDataFrame([(i, bytearray(x.tobytes()), x.shape[1], x.shape[0]) for i, x in enumerate((base, dark, noisy, other, base[:20, :20]))] + [(9, None, 1, 1)], "id int, pixels binary, w int, h int")
    got = {r["id"]: r["h"] for r in rows.select("id", desk.photo_hash("pixels", "w", "h").alias("h")).collect()}
    apart = lambda a, b: ((got[a] ^ got[b]) % 2**64).bit_count()
    assert apart(0, 1) <= 4 and apart(0, 2) <= 8 and apart(0, 3) > 12 and got[9] is None and got[4] is not None


def test_week_order_of_health(spark):
    rows = [("v", 1, "DE", "BMW", "ACTIVE", 10000.0, 0.9, datetime.datetime(2001, 9, 30) - datetime.timedelta(days=7 * (i // 2) + 1), datetime.datetime(2001, 9, 30)) for i in range(12)]
    table = spark.createDataFrame(rows, "vehicle_id string, dealer_id long, country_code string, make string, status string, price_gross_eur double, confidence_score double, indexed_at timestamp_ntz, ttl_expires_at timestamp_ntz")
    r = dealers.health(table).first()
    assert (r["active_count"], r["brand_hhi"], r["price_vs_market"], r["volume_z"]) == (12, 1.0, 1.0, 0.0)

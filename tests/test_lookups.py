"""What travels and what is looked up, in hash pairs and validators."""

import itertools
import math
import random
import re

import pytest

from motorlens.operators import graph, inbox
from motorlens.plans import shared
from motorlens.operators import desk, joins, money, more, quality  # noqa: F401  (desk registers its queries)
from motorlens.plans import registry
from motorlens.plans.domain import view
from motorlens.streaming import ingest


@pytest.mark.parametrize("n", [10, 8_400_000, 10**9])
def test_blocks_lose_no_pair_and_give_each_once(spark, monkeypatch, n):
    blocks = joins.hamming_blocks(n, 4)
    assert math.comb(*blocks) <= 35
    monkeypatch.setattr(joins, "hamming_blocks", lambda *_: blocks)
    draw = random.Random(7)
    values = [draw.getrandbits(60) for _ in range(20)]
    values += [v ^ sum(1 << b for b in draw.sample(range(64), k)) for v in values for k in (1, 3, 4, 5)] + [0, 15, 31, 1 << 63]
    values = sorted({v - 2**64 if v >= 2**63 else v for v in values})
    want = sorted((a, b, ((a ^ b) % 2**64).bit_count()) for a, b in itertools.combinations(values, 2) if ((a ^ b) % 2**64).bit_count() <= 4)
    got = joins.hamming_pairs(spark.createDataFrame([(v,) for v in values], "h long"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 60


def joined_columns(plan):
    out = set()
    kids = [plan.children().apply(i) for i in range(plan.children().size())]
    if plan.nodeName() == "Join":
        out |= {k.output().apply(i).name() for k in kids for i in range(k.output().size())}
    return out.union(*map(joined_columns, kids))


def test_texts_and_photos_stay_out_of_the_validators_joins(spark, data):
    listings = view(spark, data, "quality_listing")
    names = listings.columns
    stored = spark.createDataFrame(listings.limit(5).collect(), listings.schema)
    decoded = spark.createDataFrame([], "vin string, nhtsa_make string, nhtsa_model string, nhtsa_year int, nhtsa_error string")
    seen = joined_columns(quality.composite(stored, decoded)._jdf.queryExecution().optimizedPlan())
    assert "vin" in seen and not {"photos", "title", "description", "body"} & seen and "photos" in names


def test_breakdown_judges_only_its_own_listings_among_all(spark, data):
    rows = registry.QUERIES["qry01_breakdown"](spark, data)
    asked = {r["vehicle_id"] for r in view(spark, data, "vehicle").where("lot = 1").collect()}
    assert {r["vehicle_id"] for r in rows.collect()} == asked
    listings, decoded = view(spark, data, "quality_listing"), view(spark, data, "vin_decode")
    all_ = {tuple(r) for r in quality.findings(listings, decoded, ["V12", "V16"]).collect() if r["vehicle_id"] in asked}
    assert {tuple(r) for r in quality.findings(listings, decoded, ["V12", "V16"], rows=listings.where("lot = 1")).collect()} == all_


def test_routes_are_ranked_once_for_vehicles_alike(spark):
    vehicles = spark.createDataFrame([(f"v{i}", "BMW", "M1", o) for i, o in enumerate(["DE", "DE", "FR", "CH"])], "vehicle_id string, make string, model string, origin string")
    prices = spark.createDataFrame([("BMW", "M1", "DE", 2_000_000, 60), ("BMW", "M1", "FR", 2_100_000, 3), ("BMW", "M1", "NL", 0, 3)], "make string, model string, country string, cents long, n long")
    dealers = spark.createDataFrame([("DE", "ACTIVE")], "country_code string, status string")
    routes = money.disposition(vehicles, prices, dealers)
    assert "Window" not in routes._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in routes.collect():
        got.setdefault(r["vehicle_id"], []).append((r["place"], r["country"], r["channel"], r["net_cents"]))
    assert sorted(got["v0"]) == sorted(got["v1"]) and [p for p, *_ in sorted(got["v0"])] == [1, 2, 3, 4, 5] and len(got["v3"]) == 6
    assert min(got["v2"])[1:] == ("FR", "dealer_direct", 2_100_000)


def test_savings_gather_requests_before_countries(spark):
    """Requests of one id count together, and what is shuffled is requests, not their product with countries."""
    rates = [("DE", 0.19), ("FR", 0.20), ("ES", 0.21), ("NL", 0.21)]
    requests = [(1, "DE", 10_001), (2, "ES", 777), (2, "FR", 999), (3, "CH", -5), (None, "NL", 100)]
    got = sorted(map(tuple, more.net_savings(spark.createDataFrame(requests, "id long, origin string, price_cents long"), spark.createDataFrame(rates, "country string, rate double")).collect()), key=str)
    want = []
    for i in {r[0] for r in requests}:
        own = sorted((rate, c, int(p * rate)) for k, o, p in requests if k == i for c, rate in rates if c != o)
        want += [(i, c, cents, max(x[2] for x in own) - cents, n + 1) for n, (_, c, cents) in enumerate(own)]
    assert got == sorted(want, key=str)


def test_percent_ranks_within_ranges_of_prices(spark):
    rows = [(f"v{i}", "BMW" if i % 5 else None, 2018 + i % 2, float((i * 733) % 4000) if i % 7 else 1500.0, 0.5, i % 8, None) for i in range(200)] + [("alone", "Audi", 2018, 9.0, 0.5, 1, None), ("below", "BMW", 2018, -20.0, 0.5, 1, None)]
    cars = spark.createDataFrame(rows, "vehicle_id string, make string, year int, price_gross_eur double, confidence_score double, photo_count int, sold_at timestamp")
    for r in money.composite(cars).collect():
        _, make, year, price, *_ = own = next(x for x in rows if x[0] == r["vehicle_id"])
        group = [x[3] for x in rows if x[1:3] == (make, year)]
        m = sum(p < price for p in group) / (len(group) - 1) if len(group) > 1 else 0.0
        assert abs(r["score"] - (0.35 * m + 0.125 + 0.25 * own[5] / 7 + 0.15)) < 6e-5
    assert money.composite(cars).count() == len(rows)


def test_vehicles_are_read_once_for_references(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(inbox, "stored", lambda df, label: seen.append(label) or shared.stored(df, label))
    cars = [("a", "1", "W1", "BMW", "M1", None), ("b", "2", "W2", "BMW", "m1 sport", 2019), ("c", "3", "W3", "bmw", "M1", 2019), ("d", "4", "W4", "Audi", "M1", None), ("e", "5", "W5", "BMW", "M1", 2018)]
    cars = spark.createDataFrame(cars, "vehicle_id string, external_id string, vin string, make string, model string, year int")
    refs = spark.createDataFrame([(1, "2"), (2, "W5"), (3, "bmw  M1 x"), (4, "Audi M1"), (5, "BMW sport")], "ref_id long, ref string")
    assert {r["ref_id"]: (r["tier"], r["vehicle_id"]) for r in inbox.found_vehicles(refs, cars).collect()} == {1: (1, "b"), 2: (2, "e"), 3: (3, "b"), 5: (3, "b")}
    assert seen == ["vehicles", "references"]


def test_a_graph_of_dealers_reads_its_listings_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "stored", lambda df, label: seen.append(label) or shared.stored(df, label))
    rows = [(d, f"V{v}", "BMW", 100.0 * d, 10 * v, 0.5, f"2001-01-{d:02d}", d) for d, vins in ((1, (1, 2, 3)), (2, (1, 2)), (3, (3,))) for v in vins]
    listings = spark.createDataFrame(rows, "dealer_id long, vin string, make string, price_gross_eur double, mileage_km int, confidence_score double, at string, other long").selectExpr("*", "to_timestamp(at) AS indexed_at")
    nodes, edges = graph.dealer_graph(listings)
    assert seen[:3] == ["listings", "dealers", "shared"]
    got = {r["id"]: r["x"] for r in nodes.collect()}
    assert set(got) == {1, 2, 3} and all(len(x) == graph.FEATURES for x in got.values())
    assert abs(sum(x[1] for x in got.values())) < 1e-9 and got[1][1] < got[2][1] < got[3][1]
    assert [(r["a"], r["b"]) for r in edges.collect()] == [(1, 2)]


def test_a_payload_is_parsed_once(spark):
    raw = spark.createDataFrame([('{"vin": "V", "make": "BMW", "model": "X", "year": 2000, "url": "https://x.example/1"}',), ("{broken",), ("",), (None,), ("[1]",)], "value string")
    kept = ingest.viable(ingest.decoded(raw))
    assert [(r["vin"], r["year"], r["ts"]) for r in kept.collect()] == [("V", 2000, None)]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert ingest.decoded(raw, broken=True).count() + ingest.decoded(raw).count() == 5


def test_single_validators_make_listings_once(spark, data, tmp_path):
    """Also with dealers and lines that are repeated or missing: as the SQL text says, from one reading of the lines."""
    import duckdb

    con = duckdb.connect()
    for t, more in (("part", "SELECT * FROM t"), ("supplier", "SELECT * FROM t WHERE s_suppkey % 4 > 0 UNION ALL SELECT * FROM t WHERE s_suppkey % 3 = 0 UNION ALL SELECT * FROM t WHERE s_suppkey % 3 = 0"), ("lineitem", "SELECT * FROM t UNION ALL SELECT * FROM t WHERE l_orderkey % 7 = 0")):
        con.execute(f"COPY (WITH t AS (SELECT * FROM '{data}/{t}.parquet') {more}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("v09_year", "v02_decode_table", "v12_cross_source", "v19_currency"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(registry.ORACLES[name]).fetchall()
        assert sorted(map(tuple, got.select("vehicle_id", "outcome").collect())) == sorted(want), name
        if name in ("v09_year", "v02_decode_table"):
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert sum("Relation" in line and "l_orderkey" in line for line in plan.split("\n")) == 1, name


def test_keys_of_hashes_are_never_broadcast(spark):
    """Each hash has many keys; small files of hashes would let the planner send all of them through the driver."""
    hashes = shared.stored(spark.createDataFrame([(v, v ^ 3) for v in range(50)], "id long, h long"), "hashes")
    for pairs in (joins.hamming_pairs(hashes), joins.hamming_pairs(hashes.select("h")), joins.hamming_pairs(hashes, plan=(3, 1))):
        plan = pairs._jdf.queryExecution().sparkPlan().toString()
        assert re.findall(r"(\w+) \[i#\d+L?, s#", plan) == ["SortMergeJoin"], plan

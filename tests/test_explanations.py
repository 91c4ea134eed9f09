"""Sentences, VIN parts and presence counts on hand-made rows."""

from pyspark.sql import functions as F

from motorlens.functions import explain, vin
from motorlens.operators import market, money


def test_whole_euros_go_to_the_even_one(spark):
    cents = [50, 150, 250, 251, -50, -150, -30, 0, 123456789]
    got = [r["e"] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cents)], "i int, c long").orderBy("i").select(explain.whole_euros(F.col("c")).alias("e")).collect()]
    assert got == [f"{c / 100:.0f}" for c in cents]


def test_routes(spark):
    rows = spark.createDataFrame([(1, "FR", "auction", 900_000, 0, 75_000), (2, "CH", "export", -1_000, 81_000, 0)], "vehicle_id int, country string, channel string, net_cents long, vat_cents long, transport_cents long")
    got = {r["vehicle_id"]: r["explanation"] for r in money.explained_routes(rows).collect()}
    assert got[1] == "Market price in FR: €9750 | Intra-EU reverse charge: €0 VAT | Transport cost: −€750 | Net profit: €9000 via auction"
    assert got[2] == "Market price in CH: €800 | VAT/customs cost: −€810 | Net profit: €-10 via export"


def test_regimes(spark):
    rows = [(1, "DE", "FR", 1_000_000, 100_000, True, 20, 90_000), (2, "DE", "FR", 1_000_000, 0, True, 3, 90_000), (3, "DE", "CH", 1_000_000, 0, True, 20, 90_000), (4, "CH", "ES", 1_000_050, 0, True, 20, 90_000)]
    req = spark.createDataFrame(rows, "id long, origin string, dest string, price_cents long, margin_cents long, ids_valid boolean, age_months int, km int")
    got = {(r["id"], r["regime"]): r["explanation"] for r in money.explained_regimes(req).collect()}
    assert got[1, "INTRA_COMMUNITY"].startswith("Adquisición intracomunitaria 0% ") and got[1, "INTRA_COMMUNITY"].endswith("reverse-charge 20% en FR y deduce íntegramente. Coste IVA neto: €0,00. Precio neto: €10000.00")
    assert "IVA 19% sobre margen €1000.00. IVA incorporado €159.66 no" in got[1, "MARGIN_SCHEME"]
    assert "IVA 20% OBLIGATORIO en destino FR. IVA sobre precio íntegro €10000.00 = €2000.00. Total bruto: €12000.00." in got[2, "INTRA_COMMUNITY"]
    assert "origen DE. Importación suiza MWST 8.1% sobre valor CIF €10000.00 = €810.00. Total bruto: €10810.00." in got[3, "EXPORT_IMPORT"]
    assert "IVA importación ES 21% sobre valor declarado €10000.50 = €2100.10." in got[4, "EXPORT_IMPORT"]


def test_vin_parts(spark):
    rows = spark.createDataFrame([("wvwzzz1jz3w000001",), ("WVWZZZ1JZAW000001",), ("AB",), ("",), (None,)], "v string")
    got = [tuple(r) for r in rows.select(vin.model_year(F.col("v")), vin.parts(F.col("v"))["wmi"], vin.parts(F.col("v"))["plant"], vin.parts(F.col("v"))["serial"], vin.masked_end(F.col("v"))).collect()]
    assert got[0] == (2003, "WVW", "W", "000001", "wvwzzz1jz3w00****") and got[1][0] == 2010
    assert got[2:] == [(None, None, None, None, "**"), (None, None, None, None, ""), (None, None, None, None, None)]


def test_coverage_counts(spark):
    cols = "source_country string, make string, model string, price_eur long, year int, mileage_km int, fuel_type string, transmission string"
    rows = spark.createDataFrame([("DE", "A", "B", 1, 2, 3, "", None), ("DE", "", "B", 0, 2, None, "x", "y"), (None, "A", "B", 1, 2, 3, "x", "y")], cols)
    got = {r["country"]: tuple(r)[1:] for r in market.field_coverage(rows).collect()}
    assert got == {"DE": (2, 1, 2, 1, 2, 1, 1, 1, 1), None: (1, 1, 1, 1, 1, 1, 1, 1, 1), "all": (3, 2, 3, 2, 3, 2, 2, 2, 2)}

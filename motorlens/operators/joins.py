"""Join shapes (JON): relational ones, and as-of, first-match, blocked-similarity and Hamming joins."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.domain import VIEWS
from ..plans.registry import both, frame


def asof(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, default=None) -> DataFrame:
    """Adds the latest ``value`` of ``right`` at or before ``left_time``. One sorted pass over the union of both sides, so
    that neither an inequality join nor a broadcast is needed; a key's rows are dealt by the key."""
    both_sides = left.withColumn("__t", F.col(left_time).cast("timestamp_ntz")).withColumn("__v", F.lit(None).cast("double")).withColumn("__side", F.lit(1))
    quotes = right.select(F.col(by), F.col(right_time).cast("timestamp_ntz").alias("__t"), F.col(value).cast("double").alias("__v"), F.lit(0).alias("__side"))
    order = Window.partitionBy(by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both_sides.unionByName(quotes, allowMissingColumns=True).withColumn("__v", F.last("__v", ignorenulls=True).over(order))
    found = F.coalesce(F.col("__v"), F.lit(default)) if default is not None else F.col("__v")
    return merged.where("__side = 1").select(*left.columns, found.alias(value))


def interval_asof(left: DataFrame, right: DataFrame, by: tuple[str, str], left_time: str, right_time: str, value: str, default: float) -> DataFrame:
    """As-of against a small dimension: validity intervals by ``lead``, then an equi join with a range condition."""
    until = F.lead(right_time).over(Window.partitionBy(by[1]).orderBy(right_time))
    spans = right.select(F.col(by[1]).alias("__k"), F.col(right_time).alias("__from"), until.alias("__until"), F.col(value).alias("__v"))
    hit = (left[by[0]] == F.col("__k")) & (left[left_time] >= F.col("__from")) & (F.col("__until").isNull() | (left[left_time] < F.col("__until")))
    return left.join(spans, hit, "left").select(*left.columns, F.coalesce("__v", F.lit(default)).alias(value))


def first_match(left: DataFrame, rules: DataFrame, condition, ordinal: str, id_column: str) -> DataFrame:
    """The rule of lowest ``ordinal`` that matches each row (rules are a static list: a few dozen rows)."""
    joined = left.join(F.broadcast(rules), condition, "left")
    return joined.groupBy(*left.columns).agg(F.min_by(F.struct(*rules.columns), ordinal).alias("rule"))


def hamming_plan(n: int, distance: int, bits: int = 64) -> tuple[int, int]:
    """(slices, flips) for n hashes: of any pair one of the slices differs in no more than ``flips`` bits, so a hash is looked up under each of its
    slices with so many bits turned. The plan with the fewest look-ups and, on even hashes, pairs compared: more hashes mean fewer and
    wider slices, so that pairs grow about as hashes do."""

    def cost(slices: int) -> float:
        width, flips = bits // slices, distance // slices
        return slices * sum(math.comb(width, k) for k in range(flips + 1)) * (10 + n / 2**width)  # a look-up costs about ten comparisons

    best = min(range(1, distance + 2), key=lambda s: cost(s) if sum(math.comb(bits // s, k) for k in range(distance // s + 1)) <= 4096 else math.inf)
    return best, distance // best


def hamming_blocks(n: int, distance: int, bits: int = 64) -> tuple[int, int]:
    """(blocks, kept) for n hashes: their bits are dealt over so many blocks, and of any pair some ``kept`` = blocks - distance blocks are equal. A hash is
    looked up once for each choice of ``kept`` blocks, whatever the others hold. The plan with the fewest look-ups and, on even hashes, pairs compared."""

    def cost(blocks: int) -> float:
        kept = blocks - distance
        return math.comb(blocks, kept) * (50 + n / 2 ** (bits * kept / blocks))  # a look-up is shuffled and sorted, which costs about fifty comparisons

    best = min(range(distance + 1, distance + 5), key=cost)
    return best, best - distance


def hamming_pairs(hashes: DataFrame, distance: int = 4, plan: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, distance) of all pairs with at most ``distance`` differing bits; none is lost. ``hashes``: id, h; without an id, a hash is its own. By
    ``hamming_blocks``, or by turned bits under a ``plan`` of ``hamming_plan``. Keys are many times the hashes, which a planner that goes by the size of
    the hashes' files doesn't see: they are merged, never broadcast."""
    if plan:
        return _turned_pairs(hashes, distance, plan)
    blocks, kept = hamming_blocks(hashes.count(), distance)
    signed = lambda m: m if m < 2**63 else m - 2**64
    # Bits are dealt in turn, so that bits that are the same in all hashes weigh on all blocks alike.
    block = [sum(1 << k for k in range(i, 64, blocks)) for i in range(blocks)]
    chosen = list(itertools.combinations(range(blocks), kept))
    masks = F.array(*(F.lit(signed(sum(block[i] for i in c))).cast("long") for c in chosen))
    # A pair may agree in more blocks than are kept: it counts where these are the first of them, so every earlier block that isn't kept must differ.
    before = F.array(*(F.array(*(F.lit(signed(block[i])).cast("long") for i in range(c[-1]) if i not in c)).cast("array<long>") for c in chosen))
    keyed = hashes.select(*hashes.columns, F.posexplode(masks).alias("i", "m")).select(*hashes.columns, "i", F.col("h").bitwiseAND(F.col("m")).alias("s"))
    own = "id" if "id" in hashes.columns else "h"
    left, right = keyed.alias("l"), keyed.hint("merge").alias("r")
    x = F.col("l.h").bitwiseXOR(F.col("r.h"))
    first = F.forall(F.get(before, F.col("l.i")), lambda m: x.bitwiseAND(m) != 0)
    met = left.join(right, (F.col("l.i") == F.col("r.i")) & (F.col("l.s") == F.col("r.s")) & (F.col(f"l.{own}") < F.col(f"r.{own}")) & (F.bit_count(x) <= distance))
    return met.where(first).select(F.col(f"l.{own}").alias("a"), F.col(f"r.{own}").alias("b"), F.bit_count(x).alias("distance"))


def _turned_pairs(hashes: DataFrame, distance: int, plan: tuple[int, int]) -> DataFrame:
    n, flips = plan
    width = -(-64 // n)
    sizes = [min(width, 64 - i * width) for i in range(n)]
    slices = F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("h", i * width).bitwiseAND(F.lit((1 << sizes[i]) - 1 if sizes[i] < 64 else -1)).alias("s")) for i in range(n)))
    cut = hashes.select("id", "h", F.inline(slices))
    turned = [[0] + [sum(1 << k for k in at) for f in range(1, flips + 1) for at in itertools.combinations(range(size), f)] for size in sizes]
    masks = hashes.sparkSession.createDataFrame([(i, m if m < 2**63 else m - 2**64) for i, own in enumerate(turned) for m in own], "i int, mask long")  # at most some thousand rows
    asked = cut.join(F.broadcast(masks), "i").select(F.col("id").alias("b"), F.col("h").alias("g"), "i", F.col("s").bitwiseXOR(F.col("mask")).alias("s"))
    far = F.bit_count(F.col("h").bitwiseXOR(F.col("g")))
    near = cut.withColumnRenamed("id", "a").join(asked.hint("merge"), ["i", "s"]).where((F.col("a") < F.col("b")) & (far <= distance))
    return near.select("a", "b", far.alias("distance")).distinct()


both("jon01_inner", lambda d: "SELECT v.vehicle_id, d.country_code FROM vehicle v JOIN dealer d ON v.dealer_id = d.dealer_id")
both("jon02_left", lambda d: "SELECT v.vehicle_id, d.canonical_name FROM vehicle v LEFT JOIN dealer d ON v.dealer_id = d.dealer_id AND d.status = 'ACTIVE'")
both("jon03_left_keep_empty", lambda d: "SELECT d.dealer_id, count(v.vehicle_id) AS n FROM dealer d LEFT JOIN vehicle v ON v.dealer_id = d.dealer_id AND v.make = 'BMW' AND v.price_gross_eur > 90000 GROUP BY d.dealer_id")
both("jon05_chained", lambda d: f"SELECT o_orderkey, c_name, n_name FROM {d.base('orders')} LEFT JOIN {d.base('customer')} ON o_custkey = c_custkey LEFT JOIN {d.base('nation')} ON c_nationkey = n_nationkey")
both("jon06_shared_vin_edges", lambda d: """WITH seen AS (SELECT vin, dealer_id, min(indexed_at) AS first_at FROM vehicle WHERE status = 'ACTIVE' GROUP BY vin, dealer_id)
SELECT a.dealer_id AS src, b.dealer_id AS dst, count(*) AS shared, min(b.first_at) AS first_time FROM seen a JOIN seen b ON a.vin = b.vin AND a.dealer_id <> b.dealer_id AND a.first_at < b.first_at GROUP BY a.dealer_id, b.dealer_id HAVING count(*) >= 2""")
both("jon08_anti_extra", lambda d: f"SELECT c.conv_id, c.turn FROM {d.base('conversations')} c WHERE c.role = 'user' AND NOT EXISTS (SELECT 1 FROM {d.base('conversations')} r WHERE r.conv_id = c.conv_id AND r.role = 'assistant' AND r.turn > c.turn)")
both("jon09_semi", lambda d: "SELECT round(avg(price_gross_eur), 4) AS avg_price, count(*) AS n FROM vehicle WHERE dealer_id IN (SELECT dealer_id FROM dealer WHERE country_code = 'ES')")
both("jon10_correlated_count", lambda d: "SELECT d.dealer_id, d.country_code FROM dealer d WHERE (SELECT count(*) FROM vehicle v WHERE v.dealer_id = d.dealer_id AND v.status = 'ACTIVE') >= 300")
both("jon11_dealer_vs_country", lambda d: """SELECT a.dealer_id, round(a.m, 4) AS dealer_avg, round(b.m, 4) AS country_avg FROM (SELECT dealer_id, country_code, avg(price_gross_eur) AS m FROM listing WHERE status = 'ACTIVE' GROUP BY dealer_id, country_code) a
JOIN (SELECT country_code, avg(price_gross_eur) AS m FROM listing WHERE status = 'ACTIVE' GROUP BY country_code) b ON a.country_code = b.country_code""")
frame("jon12_asof_fx", ["ledger", "fx"], lambda d: "SELECT tenant_vehicle, type, amount_cents, CAST(day AS STRING) AS day, coalesce((SELECT f.rate FROM fx f WHERE f.from_currency = l.currency AND f.valid_from <= l.day ORDER BY f.valid_from DESC LIMIT 1), 1.0) AS rate FROM ledger l")(
    lambda ledger, fx: interval_asof(ledger, fx, ("currency", "from_currency"), "day", "valid_from", "rate", 1.0).select("tenant_vehicle", "type", "amount_cents", F.col("day").cast("string").alias("day"), "rate")
)
frame("jon12_asof_events", ["event"], lambda d: """SELECT e.event_id, (SELECT p.value FROM event p WHERE p.event_type = 'purchase' AND p.listing_id = e.listing_id AND p.ts <= e.ts ORDER BY p.ts DESC LIMIT 1) AS price FROM event e WHERE e.event_type = 'view'""")(
    lambda e: asof(e.where("event_type = 'view'").select("event_id", "listing_id", "ts"), e.where("event_type = 'purchase'").select("listing_id", "ts", F.col("value").alias("price")), "listing_id", "ts", "ts", "price").select("event_id", "price")
)
both("jon13_latest_keep_ties", lambda d: "SELECT dealer_id, vehicle_id FROM (SELECT dealer_id, vehicle_id, rank() OVER (PARTITION BY dealer_id ORDER BY indexed_at DESC) AS r FROM vehicle) x WHERE r = 1")


def hamming_links(rows: DataFrame, distance: int = 4) -> DataFrame:
    """(id, h, class_id, links): each row of (id, h) with the smallest id of its hash and how many other hashes lie within the
    distance. Hashes are compared once each, whatever the number of rows that share them."""
    classes = rows.where("h is not null").groupBy("h").agg(F.min("id").alias("class_id"))
    pairs = hamming_pairs(classes.select("h"), distance)
    links = pairs.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("links"))
    return rows.join(classes.join(links, "h", "left"), "h", "left").select("id", "h", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def _photo_hashes(d) -> str:
    return f"SELECT p_partkey AS id, {d.xor(d.hash60('CAST(p_partkey % 500 AS STRING)'), 'CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 127 END')} AS h FROM {d.base('part')}"


VIEWS["photo_hash"] = _photo_hashes
frame("jon17_hamming", ["photo_hash"], lambda d: """WITH c AS (SELECT h, min(id) AS class_id FROM photo_hash GROUP BY h), l AS (SELECT a.h, count(*) AS links FROM c a JOIN c b ON a.h <> b.h AND bit_count(xor(a.h, b.h)) <= 4 GROUP BY a.h)
SELECT p.id, p.h, c.class_id, coalesce(l.links, 0) AS links FROM photo_hash p JOIN c ON c.h = p.h LEFT JOIN l ON l.h = p.h""")(hamming_links)
both("jon18_merged_aggregates", lambda d: "SELECT country_code, round(avg(price_gross_eur), 4) AS price_mean, count(*) AS volume, round(avg(mileage_km), 4) AS km_mean FROM listing GROUP BY country_code")
both("jon20_mandates", lambda d: f"""SELECT m.id AS mandate, count(*) AS matches, min(v.vehicle_id) AS first_match FROM (SELECT id, most, km, fuel, {'explode(makes)' if d.name == 'spark' else 'unnest(makes)'} AS make FROM (SELECT id, {'from_json(criteria, ' + chr(39) + 'makes array<string>, most double, km int, fuel string' + chr(39) + ')' if d.name == 'spark' else 'from_json(criteria, ' + chr(39) + '{"makes": ["VARCHAR"], "most": "DOUBLE", "km": "INT", "fuel": "VARCHAR"}' + chr(39) + ')'} AS c FROM
 {d.values("(1, '{\"makes\": [\"BMW\", \"Audi\"], \"most\": 20000, \"km\": 120000}'), (2, '{\"makes\": [\"Audi\"], \"most\": 30000, \"km\": 80000, \"fuel\": \"diesel\"}'), (3, '{\"makes\": [\"Toyota\", \"Renault\", \"Peugeot\"], \"most\": 15000, \"km\": 200000}')", "id, criteria")} j) k
 {'LATERAL VIEW inline(array(c)) x AS makes, most, km, fuel' if d.name == 'spark' else ', LATERAL (SELECT c.makes AS makes, c.most AS most, c.km AS km, c.fuel AS fuel) x'}) m
JOIN vehicle v ON v.make = m.make AND (m.fuel IS NULL OR v.fuel_type = m.fuel) AND v.price_gross_eur <= m.most AND v.mileage_km <= m.km WHERE v.status = 'ACTIVE' GROUP BY m.id""")

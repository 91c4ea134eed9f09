"""Upserts, set deltas, compaction, retention (SNK, SET, STG) as joins and windows over plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.domain import VIEWS, duck_sql, view
from ..plans.registry import ORACLES, QUERIES, both, frame
from ..plans.shared import new_path, stored  # noqa: F401


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: Column, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Latest row of each key; ``keep_old`` columns stay as they were first. Rows with a null key are always appended (each has a number of its
    own beside the keys). One aggregation by the keys: rows of a task are merged before they are shuffled, and both inputs are read once."""
    both_ = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1))).withColumn("__order", order)
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    both_ = both_.withColumn("__alone", F.when(null, F.monotonically_increasing_id()))
    rest = [c for c in existing.columns if c not in keys]
    latest = F.min_by(F.struct(*rest), F.struct((-F.col("__new")).alias("a"), F.col("__order").alias("b"))).alias("__r")
    first = [F.min_by(F.struct(c), F.when(F.col(c).isNotNull(), F.struct("__new", "__order")))[c].alias("__first_" + c) for c in keep_old]
    merged = both_.groupBy(*keys, "__alone").agg(latest, *first)
    return merged.select(*keys, *((F.col("__first_" + c) if c in keep_old else F.col("__r")[c]).alias(c) for c in rest)).select(existing.columns)


def merge(existing: DataFrame, incoming: DataFrame, keys: list[str], changes: dict[str, Column], when: Column | None = None, inserted: dict[str, Column] | None = None) -> DataFrame:
    """Two states in, one out. ``incoming`` has one row for a key. A key of both has ``changes`` (expressions over ``old.x`` and
    ``new.x``) where ``when`` holds, its other columns stay; a key of one side stays, new ones with ``inserted`` (expressions over
    ``new.x``) in place of their own columns. ``__state`` says what became of a row: inserted, updated or kept."""
    cols = [c for c in existing.columns if c not in keys]
    old = existing.select(*(F.col(k).alias("__o_" + k) for k in keys), F.struct(*cols).alias("old"))
    fresh = incoming.select(*(F.col(k).alias("__n_" + k) for k in keys), F.struct(*[c for c in incoming.columns if c not in keys]).alias("new"))
    joined = old.join(fresh, [F.col("__o_" + k) == F.col("__n_" + k) for k in keys], "full")
    hit = F.coalesce(when, F.lit(False)) if when is not None else F.lit(True)
    state = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull() | ~hit, "kept").otherwise("updated")
    inserted = inserted or {}
    own = lambda c: inserted[c] if c in inserted else F.col("new")[c] if c in incoming.columns else F.lit(None)
    out = joined.withColumn("__state", state)
    values = [F.when(F.col("__state") == "inserted", own(c)).when(F.col("__state") == "updated", changes[c] if c in changes else F.col("old")[c]).otherwise(F.col("old")[c]).cast(existing.schema[c].dataType).alias(c) for c in cols]
    return out.select(*(F.coalesce("__o_" + k, "__n_" + k).alias(k) for k in keys), *values, "__state")


def gone(stored_keys: DataFrame, cycle: DataFrame, key: str) -> DataFrame:
    """Keys of ``stored_keys`` that the cycle no longer has, as events."""
    return stored_keys.select(key).distinct().join(cycle.select(key), key, "left_anti").select(key, F.lit("GONE").alias("event"))


#: Columns of the universal feed, in order.
FEED = (
    "vehicle_id", "vin", "make", "model", "variant", "year", "mileage_km", "fuel_type", "transmission", "power_kw", "color", "body_type", "price_cents", "currency",
    "description", "features", "photo_url_1", "photo_url_2", "photo_url_3", "dealer_name", "dealer_country", "dealer_vat_id", "contact_email", "contact_phone",
)


def feed(listings: DataFrame) -> DataFrame:
    """Listings in the columns of the feed, as text; ``photo_urls`` gives the first three photos, ``features`` are joined by |.
    Listings without make, model or a positive price are left out."""
    have = set(listings.columns)
    photo = {f"photo_url_{i + 1}": F.get("photo_urls", F.lit(i)) for i in range(3)} if "photo_urls" in have else {}
    col = lambda n: photo.get(n, F.array_join("features", "|") if n == "features" and n in have else F.col(n) if n in have else F.lit(None))
    fine = listings.where((F.coalesce("make", F.lit("")) != "") & (F.coalesce("model", F.lit("")) != "") & (F.col("price_cents") > 0))
    return fine.select(*(F.coalesce(col(n).cast("string"), F.lit("")).alias(n) for n in FEED))


def write_feed(listings: DataFrame, path: str, form: str = "csv") -> None:
    """The feed as compressed CSV with a header, or as XML with ``listing`` elements that leave empty fields out."""
    rows = feed(listings)
    if form == "csv":
        rows.write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
        return
    camel = lambda n: "".join(p if i == 0 else p.capitalize() for i, p in enumerate(n.split("_")))
    given = lambda n: F.when(F.col(n) != "", F.col(n))
    plain = FEED[:15]
    parts = F.filter(F.array(*(given(f"photo_url_{i}") for i in (1, 2, 3))), lambda x: x.isNotNull())
    nested = rows.select(*(given(n).alias(camel(n)) for n in plain), F.struct(F.filter(F.split("features", "[|]"), lambda x: x != "").alias("feature")).alias("features"), F.struct(parts.alias("photo")).alias("photos"), F.struct(given("dealer_name").alias("name"), given("dealer_country").alias("country"), given("dealer_vat_id").alias("vatId"), given("contact_email").alias("email"), given("contact_phone").alias("phone")).alias("dealer"))
    nested.write.format("xml").option("rootTag", "listings").option("rowTag", "listing").save(path)


def write_series(series: DataFrame, path: str, keys: list[str]) -> None:
    """A folder of CSV files for each series; characters that a file name can't have become ``_``."""
    clean = {k: F.regexp_replace(F.col(k).cast("string"), r"[^A-Za-z0-9_-]+", "_") for k in keys}
    series.withColumns(clean).repartition(*keys).sortWithinPartitions(*keys).write.partitionBy(*keys).option("header", True).csv(path)


def write_monthly(rows: DataFrame, path: str, at: str, bloom: str | None = None) -> None:
    """Parquet by month of ``at``; with a Bloom filter on the column ``bloom``, so that look-ups skip row groups."""
    out = rows.withColumn("month", F.year(at) * 100 + F.month(at)).repartition("month").write.partitionBy("month")
    if bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{bloom}", "true").option(f"parquet.bloom.filter.expected.ndv#{bloom}", "1000000")
    out.parquet(path)


def claimed(queue: DataFrame, workers: int, n: int, key: str = "id") -> DataFrame:
    """(worker, key): up to ``n`` open entries for each worker, the oldest first and none for two of them, as row locks that skip
    locked rows would give. Entries belong to workers by hash, so that workers never wait for each other."""
    open_ = queue.where("claimed_by is null").withColumn("worker", F.pmod(F.xxhash64(key), F.lit(workers)).cast("int"))
    nth = F.row_number().over(Window.partitionBy("worker").orderBy("created_at", key))
    return open_.withColumn("nth", nth).where(F.col("nth") <= n).select("worker", key)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those incoming ones whose key is new."""
    return existing.unionByName(incoming.dropDuplicates(keys).join(existing.select(keys), keys, "left_anti"))


def delta(stored: DataFrame, cycle: DataFrame, key: str) -> DataFrame:
    """State of each key between two snapshots: new, stale or kept; one full outer join."""
    a = stored.select(F.col(key).alias("__a")).distinct()
    b = cycle.select(F.col(key).alias("__b")).distinct()
    joined = a.join(b, F.col("__a") == F.col("__b"), "full")
    return joined.select(F.coalesce("__a", "__b").alias(key), F.when(F.col("__a").isNull(), "SEEN").when(F.col("__b").isNull(), "GONE").otherwise("KEPT").alias("state"))


def compacted(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Rows of one key summed up."""
    return rows.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums))


_OLD, _NEW = "mileage_km < 120000", "mileage_km >= 80000"
_COLS = ["vin", "dealer_id", "vehicle_id", "price_gross_eur"]
frame("snk01_upsert", ["vehicle"], lambda d: f"""SELECT vin, dealer_id, vehicle_id, price_gross_eur FROM (SELECT vin, dealer_id, vehicle_id, price_gross_eur, row_number() OVER (PARTITION BY vin, dealer_id ORDER BY n DESC, vehicle_id) AS r
 FROM (SELECT *, 0 AS n FROM vehicle WHERE {_OLD} UNION ALL SELECT *, 1 AS n FROM vehicle WHERE {_NEW}) x) y WHERE r = 1""")(lambda v: upsert(v.where(_OLD).select(_COLS), v.where(_NEW).select(_COLS), ["vin", "dealer_id"], F.col("vehicle_id")))
frame("snk03_insert_ignore", ["vehicle"], lambda d: f"SELECT vin FROM (SELECT DISTINCT vin FROM vehicle WHERE {_OLD} UNION SELECT DISTINCT vin FROM vehicle WHERE {_NEW}) x")(
    lambda v: insert_ignore(v.where(_OLD).select("vin").distinct(), v.where(_NEW).select("vin"), ["vin"])
)
frame("set01_delta", ["vehicle"], lambda d: f"SELECT coalesce(a.vin, b.vin) AS vin, CASE WHEN a.vin IS NULL THEN 'SEEN' WHEN b.vin IS NULL THEN 'GONE' ELSE 'KEPT' END AS state FROM (SELECT DISTINCT vin FROM vehicle WHERE {_OLD}) a FULL JOIN (SELECT DISTINCT vin FROM vehicle WHERE {_NEW}) b ON a.vin = b.vin")(
    lambda v: delta(v.where(_OLD), v.where(_NEW), "vin")
)
frame("stg02_summing", ["event"], lambda d: "SELECT k, event_type, CAST(sum(1) AS BIGINT) AS n FROM event GROUP BY k, event_type")(lambda e: compacted(e.withColumn("n", F.lit(1)), ["k", "event_type"], ["n"]))
both("snk08_retention", lambda d: f"SELECT dealer_id, count(*) AS kept FROM recent WHERE indexed_at >= {d.now} - INTERVAL 365 DAY GROUP BY dealer_id")
both("snk14_no_personal_data", lambda d: "SELECT vehicle_id, make, model, year, fuel_type, source_platform FROM vehicle WHERE status = 'ACTIVE'")
both("set02_incremental", lambda d: f"SELECT v.vehicle_id FROM vehicle v LEFT JOIN (SELECT DISTINCT vin FROM vehicle WHERE {_OLD}) k ON v.vin = k.vin WHERE k.vin IS NULL")
both("set04_distinct", lambda d: "SELECT DISTINCT make, model, fuel_type FROM vehicle")
both("set05_overlap", lambda d: f"SELECT count(CASE WHEN a.vin IS NOT NULL AND b.vin IS NOT NULL THEN 1 END) AS both_n, count(CASE WHEN b.vin IS NULL THEN 1 END) AS only_a, count(CASE WHEN a.vin IS NULL THEN 1 END) AS only_b FROM (SELECT DISTINCT vin FROM vehicle WHERE {_OLD}) a FULL JOIN (SELECT DISTINCT vin FROM vehicle WHERE {_NEW}) b ON a.vin = b.vin")
both("set06_batch_dedup", lambda d: "SELECT vin, dealer_id, mileage_km, min(vehicle_id) AS vehicle_id FROM vehicle GROUP BY vin, dealer_id, mileage_km")
both("stg01_replacing", lambda d: "SELECT vin, vehicle_id, price_gross_eur FROM (SELECT vin, vehicle_id, price_gross_eur, row_number() OVER (PARTITION BY vin ORDER BY indexed_at DESC, vehicle_id) AS r FROM vehicle) x WHERE r = 1")
both("stg03_ttl", lambda d: f"SELECT country_code, count(*) AS live FROM live_listing WHERE indexed_at > {d.now} - INTERVAL 730 DAY GROUP BY country_code")
both("stg08_ttl_cache", lambda d: f"SELECT v.vin, count(*) AS hits FROM recent v WHERE v.ttl_expires_at > {d.now} GROUP BY v.vin")
both("hash_url_ids", lambda d: ("SELECT vehicle_id, substring(sha2(source_url, 256), 1, 32) AS url_id, substring(sha2(concat(vin, '|', fuel_type, '|', CAST(mileage_km AS STRING)), 256), 1, 16) AS fingerprint FROM vehicle" if d.name == "spark" else "SELECT vehicle_id, substr(sha256(source_url), 1, 32) AS url_id, substr(sha256(concat(vin, '|', fuel_type, '|', CAST(mileage_km AS STRING))), 1, 16) AS fingerprint FROM vehicle"))

_PRINT = "concat('vin:', vin, ':', fuel_type, ':', CAST(mileage_km AS STRING))"
VIEWS["print_state"] = lambda d: f"SELECT {_PRINT} AS fingerprint, min(price_gross_eur) AS last_price, min(lot) % 3 AS drops, min(photo_count) AS photos, min(indexed_at) AS updated_at FROM vehicle WHERE lot % 3 <> 0 GROUP BY 1"
VIEWS["print_cycle"] = lambda d: f"SELECT {_PRINT} AS fingerprint, max(price_gross_eur) - 10000 AS last_price, CASE WHEN min(photo_count) > 2 THEN min(photo_count) END AS photos, max(indexed_at) AS updated_at FROM vehicle WHERE lot % 3 <> 1 GROUP BY 1"


def price_counter(state: DataFrame, cycle: DataFrame) -> DataFrame:
    """Upsert by fingerprint: the price and its time are the new ones, a lower price counts as a drop, photos stay if none come."""
    changes = {
        "last_price": F.col("new.last_price"), "updated_at": F.col("new.updated_at"), "photos": F.coalesce("new.photos", "old.photos"),
        "drops": F.when(F.col("new.last_price") < F.col("old.last_price"), F.col("old.drops") + 1).otherwise(F.col("old.drops")),
    }
    return merge(state, cycle, ["fingerprint"], changes, inserted={"drops": F.lit(0), "photos": F.coalesce("new.photos", F.lit(0))})


frame("snk02_fingerprint_counts", ["print_state", "print_cycle"], lambda d: """SELECT coalesce(s.fingerprint, c.fingerprint) AS fingerprint, coalesce(c.last_price, s.last_price) AS last_price, CASE WHEN s.fingerprint IS NULL THEN 0 WHEN c.last_price < s.last_price THEN s.drops + 1 ELSE s.drops END AS drops,
 coalesce(c.photos, s.photos, 0) AS photos, coalesce(c.updated_at, s.updated_at) AS updated_at, CASE WHEN s.fingerprint IS NULL THEN 'inserted' WHEN c.fingerprint IS NULL THEN 'kept' ELSE 'updated' END AS state FROM print_state s FULL JOIN print_cycle c ON s.fingerprint = c.fingerprint""")(
    lambda s, c: price_counter(s, c).withColumnRenamed("__state", "state")
)
VIEWS["candidate_state"] = lambda d: "SELECT dealer_id, country_code, last_confirmed_at AS last_seen FROM dealer WHERE dealer_id % 4 <> 0"
VIEWS["candidate_cycle"] = lambda d: "SELECT dealer_id, country_code, DATE'2001-09-30' AS last_seen FROM dealer WHERE dealer_id % 4 <> 1"
frame("snk04_stale_guard", ["candidate_state", "candidate_cycle"], lambda d: """SELECT coalesce(s.dealer_id, c.dealer_id) AS dealer_id, CASE WHEN s.dealer_id IS NULL OR (c.dealer_id IS NOT NULL AND s.last_seen < DATE '2001-03-31') THEN '2001-09-30' ELSE CAST(s.last_seen AS STRING) END AS last_seen,
 CASE WHEN s.dealer_id IS NULL THEN 'inserted' WHEN c.dealer_id IS NOT NULL AND s.last_seen < DATE '2001-03-31' THEN 'updated' ELSE 'kept' END AS state FROM candidate_state s FULL JOIN candidate_cycle c ON s.dealer_id = c.dealer_id""")(
    lambda s, c: merge(s, c, ["dealer_id"], {"last_seen": F.col("new.last_seen")}, when=F.col("old.last_seen") < F.lit("2001-03-31").cast("date")).select("dealer_id", F.col("last_seen").cast("string").alias("last_seen"), F.col("__state").alias("state"))
)
VIEWS["syndicated"] = lambda d: "SELECT vin, source_platform AS platform, CASE WHEN min(lot) % 4 = 0 THEN 'withdrawn' ELSE 'published' END AS status, min(lot) AS external_id, min(indexed_at) AS published_at, CASE WHEN min(lot) % 4 = 0 THEN max(indexed_at) END AS withdrawn_at FROM vehicle WHERE lot % 3 <> 0 GROUP BY 1, 2"
VIEWS["syndication"] = lambda d: "SELECT vin, source_platform AS platform, CASE WHEN max(lot) % 2 = 0 THEN 'error' ELSE 'published' END AS status, max(lot) AS external_id, CASE WHEN max(lot) % 2 = 1 THEN max(indexed_at) END AS published_at, CASE WHEN max(lot) % 5 = 0 THEN max(sold_at) END AS withdrawn_at FROM vehicle WHERE lot % 3 <> 1 GROUP BY 1, 2"
def syndicate(state: DataFrame, cycle: DataFrame) -> DataFrame:
    """Upsert by vehicle and platform that keeps earlier times where none come."""
    changes = {c: F.col(f"new.{c}") for c in ("status", "external_id")} | {c: F.coalesce(f"new.{c}", f"old.{c}") for c in ("published_at", "withdrawn_at")}
    return merge(state, cycle, ["vin", "platform"], changes).drop("__state")


frame("snk05_coalesce_upsert", ["syndicated", "syndication"], lambda d: """SELECT vin, platform, coalesce(c.status, s.status) AS status, coalesce(c.external_id, s.external_id) AS external_id, coalesce(c.published_at, s.published_at) AS published_at, coalesce(c.withdrawn_at, s.withdrawn_at) AS withdrawn_at
FROM syndicated s FULL JOIN syndication c USING (vin, platform)""")(syndicate)
VIEWS["score_state"] = lambda d: "SELECT dealer_id, round(100 * avg(confidence_score), 2) AS score, min(lot) AS first_lot, count(*) AS n FROM vehicle WHERE lot % 3 <> 0 AND dealer_id % 7 <> 1 GROUP BY dealer_id"
VIEWS["score_cycle"] = lambda d: "SELECT dealer_id, round(100 * avg(confidence_score), 2) AS score, max(lot) AS first_lot, count(*) AS n FROM vehicle WHERE lot % 3 <> 1 AND dealer_id % 7 <> 2 GROUP BY dealer_id"
frame("snk06_last_writer", ["score_state", "score_cycle"], lambda d: "SELECT dealer_id, coalesce(c.score, s.score) AS score, coalesce(s.first_lot, c.first_lot) AS first_lot, coalesce(c.n, s.n) AS n FROM score_state s FULL JOIN score_cycle c USING (dealer_id)")(
    lambda s, c: merge(s, c, ["dealer_id"], {"score": F.col("new.score"), "n": F.col("new.n")}).drop("__state")
)
frame("snk07_gone", ["vehicle"], lambda d: f"SELECT vin, 'GONE' AS event FROM (SELECT DISTINCT vin FROM vehicle WHERE {_OLD}) x WHERE vin NOT IN (SELECT vin FROM vehicle WHERE {_NEW})")(lambda v: gone(v.where(_OLD), v.where(_NEW), "vin"))
VIEWS["feed_listing"] = lambda d: f"""SELECT v.vehicle_id, v.vin, v.make, v.model, v.year, v.mileage_km, v.fuel_type, 'manual' AS transmission, CAST(round(v.price_gross_eur * 100) AS BIGINT) AS price_cents, 'EUR' AS currency, concat('A ', v.make, ', "as new"') AS description, {"array" if d.name == "spark" else "list_value"}('abs', v.source_platform) AS features,
 {"transform(sequence(1, photo_count), i -> concat(source_url, '/', CAST(i AS STRING), '.jpg'))" if d.name == "spark" else "list_transform(range(1, photo_count + 1), lambda i: concat(source_url, '/', CAST(i AS STRING), '.jpg'))"} AS photo_urls, v.canonical_name AS dealer_name, v.country_code AS dealer_country FROM listing v"""


def feed_and_back(spark, sf_dir: str) -> DataFrame:
    """The whole feed written as CSV and read again."""
    path = new_path(spark, "feed")
    write_feed(view(spark, sf_dir, "feed_listing"), path)
    return spark.read.option("header", True).option("escape", '"').schema(", ".join(f"{c} string" for c in FEED)).csv(path).na.fill("")


QUERIES["snk10_feed_columns"] = feed_and_back
ORACLES["snk10_feed_columns"] = duck_sql("SELECT vehicle_id, vin, make, model, '' AS variant, CAST(year AS STRING) AS year, CAST(mileage_km AS STRING) AS mileage_km, fuel_type, transmission, '' AS power_kw, '' AS color, '' AS body_type, CAST(price_cents AS STRING) AS price_cents, currency, description, array_to_string(features, '|') AS features, coalesce(photo_urls[1], '') AS photo_url_1, coalesce(photo_urls[2], '') AS photo_url_2, coalesce(photo_urls[3], '') AS photo_url_3, dealer_name, dealer_country, '' AS dealer_vat_id, '' AS contact_email, '' AS contact_phone FROM feed_listing WHERE price_cents > 0")


def series_files(spark, sf_dir: str) -> DataFrame:
    """Daily means of each country and make, a folder of CSV each, and what is read back."""
    path = new_path(spark, "series")
    daily = view(spark, sf_dir, "listing").groupBy("country_code", "make", F.to_date("indexed_at").cast("string").alias("day")).agg(F.count("*").alias("volume"), F.round(F.min("price_gross_eur"), 2).alias("low"))
    write_series(daily, path, ["country_code", "make"])
    return spark.read.option("header", True).schema("day string, volume long, low double, country_code string, make string").csv(path)


QUERIES["snk09_series_files"] = series_files
ORACLES["snk09_series_files"] = duck_sql("SELECT country_code, make, CAST(CAST(indexed_at AS DATE) AS STRING) AS day, count(*) AS volume, round(min(price_gross_eur), 2) AS low FROM listing GROUP BY ALL")


def monthly_files(spark, sf_dir: str) -> DataFrame:
    """Listings written by month with a Bloom filter on the VIN; of the last 200 days only those folders are read."""
    path = new_path(spark, "monthly")
    write_monthly(view(spark, sf_dir, "vehicle").select("vin", "vehicle_id", "indexed_at"), path, "indexed_at", bloom="vin")
    return spark.read.parquet(path).where("month >= 200103").groupBy(F.col("month").alias("part")).agg(F.count("*").alias("n"), F.min("vin").alias("first_vin"))


QUERIES["stg04_monthly_partitions"] = monthly_files
ORACLES["stg04_monthly_partitions"] = duck_sql("SELECT year(indexed_at) * 100 + month(indexed_at) AS part, count(*) AS n, min(vin) AS first_vin FROM vehicle WHERE year(indexed_at) * 100 + month(indexed_at) >= 200103 GROUP BY 1")
VIEWS["work_queue"] = lambda d: "SELECT event_id AS id, ts AS created_at, CASE WHEN event_type = 'error' THEN 'w0' END AS claimed_by FROM event"
frame("stg07_claim_queue", ["work_queue"])(lambda q: claimed(q, 8, 50))

"""Queries over sources and streams (SRC, ST)."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..plans.domain import VIEWS, duck_sql, view
from ..plans.registry import ORACLES, QUERIES, frame
from ..plans.shared import new_path, stored
from ..sources import files
from ..streaming import ingest


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = duck_sql(oracle)
        return f

    return put


@query("src17_fixed_width", "SELECT o_orderkey % 7 = 0 AS short, CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE replace(o_orderpriority, ' ', '_') END AS priority FROM orders")
def fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    whole = F.concat(F.rpad(F.col("o_orderkey").cast("string"), 12, " "), F.rpad("o_orderstatus", 4, " "), F.rpad(F.replace("o_orderpriority", F.lit(" "), F.lit("_")), 16, " "))
    # Every seventh line breaks off within its key's field.
    lines = orders.select(F.when(F.col("o_orderkey") % 7 == 0, F.substring(whole, 1, 11)).otherwise(whole).alias("value"))
    return files.fixed_width(lines, [("key", 1, 12), ("status", 13, 4), ("priority", 17, 16)], 32)


@query("src04_page_fields", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<a\\s')) AS n_links FROM pages")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.page_fields(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "title", "n_links")


@query("src03_event_payloads", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


def streamed(spark: SparkSession, sf_dir: str, table: str, job) -> DataFrame:
    """A job over a table read as a stream of files until all is read, as a table of its results."""
    where = new_path(spark, "stream")
    out = job(opened(spark, sf_dir, table))
    kind = out.schema
    out.writeStream.format("parquet").option("path", where + "/out").option("checkpointLocation", where + "/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kind).parquet(where + "/out")


def opened(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{table}.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # A stream reads folders; a table in one file is picked out of its folder by name.
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


@query("st02_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, "events", lambda e: e.dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"))


@query("st04_stream_static", "SELECT event_id, round(value * rate, 4) AS euro FROM events JOIN (VALUES ('purchase', 0.9), ('view', 1.1)) r(event_type, rate) USING (event_type)")
def stream_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame([("purchase", 0.9), ("view", 1.1)], "event_type string, rate double")
    return streamed(spark, sf_dir, "events", lambda e: e.join(F.broadcast(rates), "event_type").select("event_id", F.round(F.col("value") * F.col("rate"), 4).alias("euro")))


@query("st11_tumbling", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("st11_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS BIGINT) AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, no""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("st08_rate_limit")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, "events", lambda e: ingest.rate_limited(e.select((F.col("user_id") % 20).alias("dealer_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 7 * 200).alias("size"))))


_MAKES = "CASE CAST(l_partkey AS BIGINT) % 6 WHEN 0 THEN 'BMW' WHEN 1 THEN 'Audi' WHEN 2 THEN 'Renault' WHEN 3 THEN 'Peugeot' WHEN 4 THEN 'Toyota' ELSE 'Volkswagen' END"
#: Fields of a payload, all of them made from part and line, so that listings of one fingerprint are alike.
_FIELDS = {
    "vin": "CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE concat('V', CAST(l_partkey AS STRING), '-', CAST(l_linenumber AS STRING)) END",
    "url": "concat('https://cars.example/', CASE WHEN l_partkey % 50 = 0 THEN '' ELSE concat(CAST(l_partkey AS STRING), '/', CAST(l_linenumber AS STRING)) END)",
    "make": f"CASE WHEN l_partkey % 40 = 1 THEN '' ELSE {_MAKES} END", "model": "concat('M', CAST(l_linenumber AS STRING))", "year": "CAST(1900 + l_partkey % 150 AS INT)", "mileage_km": "CAST(l_partkey % 200 * 1000 AS INT)", "color": "CASE WHEN l_linenumber % 2 = 0 THEN 'Red' ELSE 'BLUE' END",
    "price_raw": "CAST(400 + l_partkey * 37 % 60000 AS DOUBLE)", "currency": "CASE l_partkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'CHF' WHEN 2 THEN 'GBP' ELSE 'XXX' END", "lat": "CAST(CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 40 + l_partkey % 10 END AS DOUBLE)", "lng": "CAST(CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 2 + l_linenumber END AS DOUBLE)",
    "photo": "CASE WHEN l_linenumber > 3 THEN concat('https://img.example/', CAST(l_partkey AS STRING)) END",
}
RATES = (("EUR", 1.0), ("CHF", 0.95), ("GBP", 1.15))


def _known(d) -> str:
    """Vehicles that are known before the stream starts: a third of the parts, ten per cent dearer or cheaper than the stream has them."""
    return f"SELECT l_partkey, l_linenumber, concat('V', CAST(l_partkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS vin, CASE WHEN l_linenumber % 2 = 0 THEN 'red' ELSE 'blue' END AS color, CAST(l_partkey % 200 * 1000 AS INT) AS mileage_km, 50000.0 AS price FROM (SELECT DISTINCT l_partkey, l_linenumber FROM {d.base('lineitem')} WHERE l_partkey % 3 = 0 AND l_linenumber % 5 <> 0) x"


VIEWS["known_vehicle"] = _known


def ingested(spark: SparkSession, sf_dir: str) -> tuple[ingest.Ingest, str]:
    """Runs the listing stream end to end: decode, filter, de-duplicate, convert, merge, fan out."""
    folder = new_path(spark, "ingest")
    known = view(spark, sf_dir, "known_vehicle").select(F.sha2(F.concat(F.lit("vin:"), "vin", F.lit(":"), "color", F.lit(":"), F.col("mileage_km").cast("string")), 256).alias("fingerprint"), "vin", *(F.lit("").alias(c) for c in ("url", "make", "model")), F.lit(0).alias("year"), "mileage_km", *(F.col("price").cast("double").alias(c) for c in ("price_eur", "last_price_eur")), F.lit(0).alias("drops"), F.lit("ACTIVE").alias("status"), F.lit("").alias("cell"))
    sink = ingest.Ingest(spark, folder, known)
    lines = opened(spark, sf_dir, "lineitem")
    texts = lines.select(F.when(F.col("l_orderkey") % 97 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(*(F.expr(x).alias(n) for n, x in _FIELDS.items()), F.lit("TEST").alias("source")))).alias("value"))
    rates = spark.createDataFrame(list(RATES), "currency string, rate double")
    kept = ingest.ingest_steps(texts, F.broadcast(rates))
    kept.writeStream.foreachBatch(sink).option("checkpointLocation", folder + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sink, folder


_TAKEN = "k AS (SELECT DISTINCT l_partkey, l_linenumber, " + ", ".join(f"{x} AS {n}" for n, x in _FIELDS.items()) + """ FROM lineitem WHERE l_orderkey % 97 <> 0),
t AS (SELECT *, round(price_raw * CASE currency WHEN 'EUR' THEN 1.0 WHEN 'CHF' THEN 0.95 WHEN 'GBP' THEN 1.15 END::DOUBLE, 2) AS price_eur FROM k WHERE make <> '' AND year BETWEEN 1920 AND 2027 AND l_partkey % 50 <> 0 AND currency <> 'XXX'),
b AS (SELECT t.*, n.price AS before FROM t LEFT JOIN known_vehicle n ON n.l_partkey = t.l_partkey AND n.l_linenumber = t.l_linenumber WHERE price_eur BETWEEN 500 AND 2000000)"""


@query("st01_ingest", f"""WITH {_TAKEN} SELECT CASE WHEN vin <> '' THEN sha256(concat('vin:', vin, ':', lower(color), ':', CAST(mileage_km AS STRING))) ELSE sha256(concat('url:', url)) END AS fingerprint, price_eur, CASE WHEN before > price_eur THEN 1 ELSE 0 END AS drops,
 CASE WHEN before IS NOT NULL THEN '' WHEN lat <> 0 THEN concat('g0.5:', CAST(CAST(floor(lat / 0.5) AS INT) AS STRING), ':', CAST(CAST(floor(lng / 0.5) AS INT) AS STRING)) ELSE 'none' END AS cell FROM b
 UNION ALL SELECT sha256(concat('vin:', n.vin, ':', n.color, ':', CAST(n.mileage_km AS STRING))), n.price, 0, '' FROM known_vehicle n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_partkey = n.l_partkey AND b.l_linenumber = n.l_linenumber)""")
def ingest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink, _ = ingested(spark, sf_dir)
    return sink.state(sink.last).select("fingerprint", "price_eur", "drops", F.coalesce("cell", F.lit("none")).alias("cell"))


@query("st05_derived_events", f"""WITH {_TAKEN} SELECT vin, 'LISTING' AS kind, 0.95::DOUBLE AS confidence, price_eur AS value FROM b WHERE vin <> '' AND before IS NULL UNION ALL SELECT vin, 'PRICE_CHANGE', 1.0, round(before - price_eur, 2) FROM b WHERE vin <> '' AND before > price_eur UNION ALL SELECT vin, 'MILEAGE', 0.8, mileage_km FROM b WHERE vin <> '' AND mileage_km > 0""")
def derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, folder = ingested(spark, sf_dir)
    return spark.read.schema("fingerprint string, vin string, kind string, confidence double, value double").parquet(folder + "/history").select("vin", "kind", "confidence", F.round("value", 2).alias("value"))


@query("snk11_fan_out", f"WITH {_TAKEN} SELECT 'db_write' AS sink, count(*) AS n FROM b UNION ALL SELECT 'search_sync', count(*) FROM b UNION ALL SELECT 'price_events', count(*) FROM b UNION ALL SELECT 'thumbs', count(*) FROM b WHERE photo IS NOT NULL")
def fan_out_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, folder = ingested(spark, sf_dir)
    parts = [spark.read.schema("fingerprint string").parquet(f"{folder}/{name}").select(F.lit(name).alias("sink")) for name in ingest.Ingest.SINKS[:4]]
    return reduce(DataFrame.unionByName, parts).groupBy("sink").agg(F.count("*").alias("n"))


@query("src03_malformed", "SELECT count(*) AS broken FROM lineitem WHERE l_orderkey % 97 = 0")
def malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.when(F.col("l_orderkey") % 97 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("l_partkey").cast("string").alias("vin")))).alias("value"))
    return ingest.decoded(texts, broken=True).agg(F.count("*").alias("broken"))


@query("udf01_name_vectors")
def name_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "dealer").select("dealer_id", text.trigram_vector("canonical_name").alias("vector"))


#: Vectors of one side of a comparison, about: what a task holds, twice. Products in single precision are this near to the exact ones, at least.
SIDE, NEAR = 4096, 4e-5


def _packed(batches):
    """Vectors (``v``) as their components that aren't 0: places, then values."""
    for batch in batches:
        own = [np.asarray(v, np.float32) for v in batch.column("v").to_pylist()]
        at = [np.flatnonzero(v) for v in own]
        packed = [i.astype(np.uint8).tobytes() + v[i].tobytes() for i, v in zip(at, own)]
        yield pa.RecordBatch.from_arrays([batch.column("b"), batch.column("first"), pa.array(packed, pa.binary())], names=["b", "first", "packed"])


def _unpacked(packed: list[bytes]) -> np.ndarray:
    out = np.zeros((len(packed), 256), np.float32)
    for row, p in zip(out, packed):
        n = len(p) // 5
        row[np.frombuffer(p, np.uint8, n)] = np.frombuffer(p[n:], np.float32)
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals, halves up, as Spark rounds."""
    scaled = x * 1e6
    out = np.rint(scaled) / 1e6
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _best(x: np.ndarray, x_key: np.ndarray, y: np.ndarray, y_key: np.ndarray, least: float) -> pa.Table:
    """(x, y, cosine): for each row of ``x`` the best other row of ``y``, ``least`` or more. Products in single precision leave out what can't be the best;
    the others are summed exactly, component by component."""
    held = []
    for at in range(0, len(x), 1024):
        about = x[at : at + 1024] @ y.T
        about[x_key[at : at + 1024, None] == y_key[None, :]] = -1
        i, j = np.nonzero(about >= np.maximum(about.max(1, initial=-1), least)[:, None] - NEAR)
        for to in range(0, len(i), 8192):
            p, q = i[to : to + 8192] + at, j[to : to + 8192]
            products = x[p].astype(np.float64) * y[q].astype(np.float64)
            cosine = np.zeros(len(p))
            for column in np.flatnonzero(products.any(0)):
                cosine += products[:, column]
            cosine = rounded(cosine)
            keep = np.flatnonzero((cosine >= least) & (x_key[p] != y_key[q]))
            keep = keep[np.lexsort((y_key[q[keep]], -cosine[keep], p[keep]))]
            keep = keep[np.flatnonzero(np.diff(p[keep], prepend=-1))]
            held.append(pa.table({"x": x_key[p[keep]], "y": y_key[q[keep]], "cosine": cosine[keep]}))
    return pa.concat_tables(held) if held else pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})


def similar(names: DataFrame, least: float = 0.85, key: str = "dealer_id", block: str = "country_code", name: str = "canonical_name", side: int = SIDE) -> DataFrame:
    """(key, match, cosine): the most similar other row of the block by the cosine of name vectors, ``least`` or more; ties to the
    smaller key.

    Equal vectors are one class. A block's classes are dealt to parts of about ``side``; each two parts meet in one task as two matrices, which gives
    the best match of each row there. All pairs are compared, and scores are exact; a task holds two parts, however large the block."""
    rows = stored(names.select(F.col(key).alias("k"), F.col(block).alias("b"), text.trigram_vector(name).alias("v")), "names")
    classes = rows.groupBy("b", "v").agg(F.min("k").alias("first"))
    second = rows.join(classes.select("b", "v", "first"), ["b", "v"]).where("k <> first").groupBy("b", "v").agg(F.min("k").alias("second"))
    classes = stored(classes.join(second, ["b", "v"], "left").select("b", "v", "first", "second"), "classes")
    sizes = classes.where("b is not null").groupBy("b").agg(F.ceil(F.count("*") / side).alias("parts"))
    kinds = f"b {classes.schema['b'].dataType.simpleString()}, first long, packed binary"
    own = classes.select("b", F.col("first").cast("long").alias("first"), "v").mapInArrow(_packed, kinds).join(sizes, "b").withColumn("part", F.pmod(F.xxhash64("first"), "parts"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = own.select("b", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "first", "packed")

    def compare(group: pa.Table) -> pa.Table:
        vectors, keys, part = _unpacked(group.column("packed").to_pylist()), group.column("first").to_numpy(), group.column("part").to_numpy()
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        a, b = part == lo, part == hi
        found = _best(vectors[a], keys[a], vectors[b], keys[b], least)
        return found if lo == hi else pa.concat_tables([found, _best(vectors[b], keys[b], vectors[a], keys[a], least)])

    near = dealt.groupBy("b", "lo", "hi").applyInArrow(compare, "x long, y long, cosine double")
    best = near.groupBy("x").agg(F.min_by("y", F.struct(-F.col("cosine"), "y")).alias("match"), F.max("cosine").alias("cosine"))
    own = rows.join(classes, ["b", "v"]).join(best.withColumnRenamed("x", "first"), "first", "left")
    twin = F.when(F.col("k") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    found = own.select("k", F.when(F.col("second").isNotNull(), twin).otherwise(F.col("match")).alias("match"), F.when(F.col("second").isNotNull(), 1.0).otherwise(F.col("cosine")).alias("cosine"))
    return found.where("match is not null").withColumnRenamed("k", key)


frame("jon16_similar_dealers", ["dealer"])(similar)



"""Streams with state, timers, changing rates and states that merge (ST, AGG44), over the events of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import new_path
from ..streaming.lifecycle import lifecycle, with_provider
from ..streaming.state import BucketedState
from .feeds import query

DAY_MS = 86_400_000


def in_files(rows: DataFrame, by: str, n: int, folder: str) -> DataFrame:
    """``rows`` as a stream of ``n`` files in order of ``by``, a file a micro-batch: each written after the one before, since a stream
    takes files by age."""
    low, high = rows.agg(F.min(F.unix_micros(F.col(by).cast("timestamp"))), F.max(F.unix_micros(F.col(by).cast("timestamp")))).first()
    place = F.floor((F.unix_micros(F.col(by).cast("timestamp")) - F.lit(low)) * n / F.lit(high - low + 1)) if low is not None else F.lit(0)
    for i in range(n):
        rows.where(place == i).repartition(1).write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


AWAY = 3 * DAY_MS


@query("st07_lifecycle", f"""WITH s AS (SELECT concat(CAST(user_id AS VARCHAR), '/', event_type) AS k, epoch_us(ts) // 1000 AS ms, CAST(floor(value) AS BIGINT) % 3 AS content, event_id FROM events),
l AS (SELECT *, lag(ms) OVER w AS before, lag(content) OVER w AS old, lead(ms) OVER w AS next FROM s WINDOW w AS (PARTITION BY k ORDER BY ms, event_id)),
e AS (SELECT k, CASE WHEN before IS NULL OR ms - before >= {AWAY} THEN 'SEEN' WHEN content <> old THEN 'ENRICHED' END AS event, ms FROM l
 UNION ALL SELECT k, 'GONE', before + {AWAY} FROM l WHERE ms - before >= {AWAY} UNION ALL SELECT k, 'GONE', ms + {AWAY} FROM l WHERE next IS NULL AND ms + {AWAY} <= (SELECT max(ms) FROM s))
SELECT k, event, ms FROM e WHERE event IS NOT NULL""")
def listing_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of listings over five micro-batches, through state and timers."""
    folder = new_path(spark, "lifecycle")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sights = events.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("k"), "ts", F.col("event_id").alias("nth"), (F.floor("value") % 3).cast("string").alias("content"))
    with with_provider(spark):
        found = lifecycle(in_files(sights, "ts", 5, folder + "/in"), AWAY)
        found.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("k string, event string, at timestamp").parquet(folder + "/out").select("k", "event", F.unix_millis("at").alias("ms"))


@query("st06_bucketed_state", "SELECT user_id AS k, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY user_id")
def bucketed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each user, kept in buckets by a stream of four micro-batches."""
    folder = new_path(spark, "totals")
    schema = "k long, n long, cents long, at string, latest string"
    state = BucketedState(spark, folder + "/state", schema, "k", 32)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("k"), "ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), "event_id")
    last = {}

    def add(batch: DataFrame, number: int) -> None:
        path = f"{folder}/own/{number}"
        stamp = F.concat(F.lpad(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), 20, "0"), F.lit("/"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
        batch.groupBy("k").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.max(stamp).alias("at"), F.max_by("event_type", stamp).alias("latest")).write.mode("overwrite").parquet(path)
        own = batch.sparkSession.read.parquet(path)
        old = state.read(state.before(number), state.touched(own))
        both = old.unionByName(own).groupBy("k").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max("at").alias("newest"), F.max_by("latest", "at").alias("latest"))
        state.write(number, both.withColumnRenamed("newest", "at"))
        last["n"] = number

    in_files(events, "ts", 4, folder + "/in").writeStream.foreachBatch(add).option("checkpointLocation", folder + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state.read(last["n"]).select("k", "n", "cents", "latest")


# ---------------------------------------------------------------- rates that change


class Versions:
    """A small table that changes while a stream runs: ``folder/<version>``, whole versions only. A batch takes the newest one there is when it first
    runs and notes it, so that it takes the same one when it is run again."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def put(self, version: int, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{version}")

    def newest(self) -> int:
        fs = self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath().getName() for f in fs.listStatus(self._path(""))]
        return max(int(n) for n in found if n.isdigit() and fs.exists(self._path(f"{n}/_SUCCESS")))

    def taken_by(self, number: int) -> DataFrame:
        """The version that batch ``number`` works with."""
        fs, notes = self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration()), self._path("batches")
        names = [f.getPath().getName().split("-") for f in fs.listStatus(notes)] if fs.exists(notes) else []
        noted = [int(version) for batch, version in names if batch == str(number)]
        version = min(noted) if noted else self.newest()
        if not noted:
            fs.mkdirs(self._path(f"batches/{number}-{version}"))
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{version}")


_RATES = "(VALUES ('purchase', 0.9), ('view', 1.1), ('click', 1.0)) r(event_type, rate)"


@query("st04_changing_rates", f"""WITH s AS (SELECT *, epoch_us(ts) AS us FROM events), b AS (SELECT min(us) AS low, max(us) AS high FROM s), n AS (SELECT s.*, CAST((us - low) * 4 // (high - low + 1) AS INT) AS batch FROM s, b)
SELECT event_id, batch, round(value * (rate::DOUBLE + 0.5 * batch), 4) AS euro FROM n JOIN {_RATES} USING (event_type)""")
def changing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in euro by the rates that hold when a micro-batch runs; they change after each of four. A kind without a rate drops out."""
    folder, schema = new_path(spark, "rates"), "event_type string, rate double"
    rates = Versions(spark, folder + "/rates", schema)
    table = lambda n: spark.createDataFrame([("purchase", 0.9 + 0.5 * n), ("view", 1.1 + 0.5 * n), ("click", 1.0 + 0.5 * n)], schema)
    rates.put(0, table(0))

    def convert(batch: DataFrame, number: int) -> None:
        out = batch.join(F.broadcast(rates.taken_by(number)), "event_type")  # a row for each kind
        out.select("event_id", F.lit(number).alias("batch"), F.round(F.col("value") * F.col("rate"), 4).alias("euro")).write.mode("overwrite").parquet(f"{folder}/out/part={number}")
        rates.put(number + 1, table(number + 1))

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    in_files(events, "ts", 4, folder + "/in").writeStream.foreachBatch(convert).option("checkpointLocation", folder + "/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, batch int, euro double").parquet(*[f"{folder}/out/part={i}" for i in range(4)])


# ---------------------------------------------------------------- states by day

#: Binary logarithm of registers of a distinct sketch, and size of a quantile sketch: errors of about 1.6 % of the number and 0.7 % of ranks.
LG, K = 12, 400


def day_states(events: DataFrame) -> DataFrame:
    """(day, event_type, n, cents, users, prices): counts, sums and two sketches of (ts, event_type, user_id, value), which merge to any period."""
    cents = F.round(F.col("value") * 100).cast("long")
    day = (F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")).alias("day")
    return events.groupBy(day, "event_type").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"), F.hll_sketch_agg("event_id", LG).alias("users"), F.kll_sketch_agg_bigint(cents, K).alias("prices"))


def add_days(states: DataFrame, folder: str) -> None:
    """Writes the days of ``states``; those that are there already are replaced, no other day is touched."""
    states.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def over(states: DataFrame, *keys: str) -> DataFrame:
    """States merged over ``keys``: counts and sums exactly, distinct numbers and quantiles within the sketches' errors."""
    merged = states.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_bigint("prices").alias("prices"))
    quantile = lambda q: F.kll_sketch_get_quantile_bigint("prices", F.lit(q))
    return merged.select(*keys, "n", "cents", F.hll_sketch_estimate("users").alias("distinct"), quantile(0.25).alias("p25"), quantile(0.5).alias("p50"), quantile(0.75).alias("p75"))


@query("agg44_day_states", "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, true AS distinct_fits, true AS quartiles_fit FROM events GROUP BY event_type")
def merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of each day, stored; the last day comes later and again; then the month of each kind, and whether its estimates lie within the
    stated errors (three times the distinct sketch's, twice the quantile sketch's) of the exact numbers."""
    folder = new_path(spark, "days")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "user_id", "value")
    last = events.agg(F.to_date(F.max("ts")).alias("d")).first()["d"]
    add_days(day_states(events.where(F.to_date("ts") < F.lit(last))), folder)
    for part in (events.where(F.to_date("ts") == F.lit(last)).limit(1), events.where(F.to_date("ts") == F.lit(last))):
        add_days(day_states(part), folder)
    month = over(spark.read.parquet(folder), "event_type")
    cents = F.round(F.col("value") * 100).cast("long")
    exact = events.groupBy("event_type").agg(F.count_distinct("event_id").alias("_d"))
    near = events.join(month.select("event_type", "p25", "p50", "p75"), "event_type").groupBy("event_type").agg(*(F.avg((cents <= F.col(p)).cast("double")).alias("_" + p) for p in ("p25", "p50", "p75")))
    fits = lambda p, q: F.abs(F.col("_" + p) - q) < 0.014 + 1 / F.col("n")
    out = month.join(exact, "event_type").join(near, "event_type")
    return out.select("event_type", "n", "cents", (F.abs(F.col("distinct") - F.col("_d")) <= 1 + 3 * 1.04 / 2 ** (LG / 2) * F.col("_d")).alias("distinct_fits"), (fits("p25", 0.25) & fits("p50", 0.5) & fits("p75", 0.75)).alias("quartiles_fit"))

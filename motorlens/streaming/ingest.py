"""Listing stream: decode, filter, de-duplicate, convert, fan out; windows with watermarks; rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.storage import merge
from .state import BucketedState

PAYLOAD = "vin string, url string, make string, model string, year int, mileage_km int, color string, price_raw double, currency string, lat double, lng double, photo string, source string, status string, ts timestamp_ntz"
_BROKEN = "_broken"


def decoded(raw: DataFrame, broken: bool = False) -> DataFrame:
    """Payloads of a ``value`` column; what isn't JSON of this shape is dropped, or is all that is given (``broken``)."""
    # Exploded, so that no condition on a field moves below and parses the text once more for itself.
    read = raw.select("value", F.explode(F.array(F.from_json("value", f"{PAYLOAD}, {_BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}))).alias("p"))
    bad = F.col("p").isNull() | F.col(f"p.{_BROKEN}").isNotNull()
    return read.where(bad).select("value") if broken else read.where(~bad).select("p.*").drop(_BROKEN)


def viable(payloads: DataFrame) -> DataFrame:
    """Make and model, a plausible year, and a link with a path."""
    path = F.rtrim(F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/"))
    return payloads.where((F.coalesce(F.length("make"), F.lit(0)) > 0) & (F.coalesce(F.length("model"), F.lit(0)) > 0) & F.col("year").between(1920, 2027) & (path != ""))


def fingerprint() -> F.Column:
    """SHA-256 of VIN, colour and mileage, or of the link where there is no VIN."""
    with_vin = F.concat(F.lit("vin:"), "vin", F.lit(":"), F.lower(F.coalesce("color", F.lit(""))), F.lit(":"), F.coalesce("mileage_km", F.lit(0)).cast("string"))
    return F.sha2(F.when(F.coalesce(F.length("vin"), F.lit(0)) > 0, with_vin).otherwise(F.concat(F.lit("url:"), "url")), 256)


def grid_key(lat, lng, degrees: float) -> F.Column:
    """Key of the square of so many degrees that a place lies in: a stand-in for hexagon cells; null at (0, 0)."""
    cell = lambda x: F.floor(F.col(x) / degrees).cast("string")
    return F.when((F.coalesce(lat, F.lit(0.0)) != 0) | (F.coalesce(lng, F.lit(0.0)) != 0), F.concat_ws(":", F.lit(f"g{degrees:g}"), cell(lat), cell(lng)))


def deduplicated(payloads: DataFrame, delay: str | None = "7 days") -> DataFrame:
    """First payload of each fingerprint: with a delay the state is bounded by the watermark, without it is kept for ever."""
    keyed = payloads.withColumn("fingerprint", fingerprint())
    if delay is None or not keyed.isStreaming:
        return keyed.dropDuplicates(["fingerprint"])
    stamped = keyed.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def converted(payloads: DataFrame, rates: DataFrame) -> DataFrame:
    """Euro prices in a plausible band; a currency without a rate drops the row. ``rates``: currency, rate (a static side)."""
    return payloads.join(rates, "currency").withColumn("price_eur", F.round(F.col("price_raw") * F.col("rate"), 2)).where(F.col("price_eur").between(500, 2_000_000))


STATE = "fingerprint string, vin string, url string, make string, model string, year int, mileage_km int, price_eur double, last_price_eur double, drops int, status string, cell string"


def history_events(merged: DataFrame) -> DataFrame:
    """Events of vehicles with a VIN: LISTING for new ones, PRICE_CHANGE for lower prices, MILEAGE where it is known."""
    c = F.col
    one = lambda kind, sure, value: F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"), value.cast("double").alias("value"))
    kinds = F.array_compact(F.array(
        F.when(c("__state") == "inserted", one("LISTING", 0.95, c("price_eur"))),
        F.when((c("__state") == "updated") & (c("price_eur") < c("__before")), one("PRICE_CHANGE", 1.0, c("__before") - c("price_eur"))),
        F.when(c("mileage_km") > 0, one("MILEAGE", 0.80, c("mileage_km"))),
    ))
    return merged.where("coalesce(vin, '') <> ''").select("fingerprint", "vin", F.inline(kinds))


class Ingest:
    """Sink of the listing stream for ``foreachBatch``: merges a micro-batch into the state table and fans it out.

    ``folder`` gets ``state`` (see ``BucketedState``: only buckets that a batch touches are read, merged and rewritten) and, for each sink,
    ``<sink>/batch=<number>``. A batch that is run again after a failure overwrites what it wrote, so each batch counts once."""

    SINKS = ("db_write", "search_sync", "price_events", "thumbs", "history")

    def __init__(self, spark, folder: str, state: DataFrame | None = None, buckets: int = 64):
        self.spark, self.folder = spark, folder
        self.store = BucketedState(spark, folder + "/state", STATE, "fingerprint", buckets)
        self.last = -1
        if state is not None:
            self.store.write(-1, state)

    def state(self, version: int) -> DataFrame:
        return self.store.read(version)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{self.folder}/fresh/batch={number}"
        fresh = batch.select("fingerprint", "vin", "url", "make", "model", "year", "mileage_km", "price_eur", F.coalesce("status", F.lit("ACTIVE")).alias("status"), grid_key("lat", "lng", 0.5).alias("cell"), "photo", "source", "ts")
        fresh.write.mode("overwrite").parquet(path)
        fresh = spark.read.schema(fresh.schema).parquet(path)
        touched_buckets = self.store.touched(fresh)
        old = self.store.read(self.store.before(number), touched_buckets)
        # Written once, read by all sinks; a persisted copy would be lost with its executors.
        path = f"{self.folder}/merged/batch={number}"
        prior = old.withColumn("__before", F.col("last_price_eur"))
        merged = merge(prior.withColumn("photo", F.lit(None).cast("string")).withColumn("ts", F.lit(None).cast("timestamp_ntz")), fresh.withColumn("last_price_eur", F.col("price_eur")).withColumn("__before", F.lit(None).cast("double")), ["fingerprint"], {
            "price_eur": F.col("new.price_eur"), "last_price_eur": F.col("new.price_eur"), "mileage_km": F.col("new.mileage_km"), "status": F.col("new.status"), "photo": F.col("new.photo"), "ts": F.col("new.ts"),
            "drops": F.when(F.col("new.price_eur") < F.col("old.last_price_eur"), F.col("old.drops") + 1).otherwise(F.col("old.drops")),
        }, inserted={"drops": F.lit(0)})
        merged.write.mode("overwrite").parquet(path)
        merged = spark.read.schema(merged.schema).parquet(path)
        names = [f.split(" ")[0] for f in STATE.split(", ")]
        self.store.write(number, merged.select(*names), touched_buckets)
        touched = merged.where("__state <> 'kept'")
        outs = {
            "db_write": touched.select("fingerprint"), "search_sync": touched.select("fingerprint", F.to_json(F.struct("make", "model", "year", "mileage_km", "price_eur", "status", "cell")).alias("payload")),
            "price_events": touched.select("fingerprint", "url", "price_eur", "make", "model", "year"), "thumbs": touched.where("photo is not null").select("fingerprint", F.col("photo").alias("image_url")), "history": history_events(touched),
        }
        for name in self.SINKS:
            outs[name].write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")
        self.last = number


def ingest_steps(raw: DataFrame, rates: DataFrame, delay: str | None = None) -> DataFrame:
    """From payload texts to de-duplicated listings in euro."""
    return converted(deduplicated(viable(decoded(raw)), delay), rates)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows of event time."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("ts", delay) if stamped.isStreaming else stamped
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stamped.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Sessions of each user."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("ts", delay) if stamped.isStreaming else stamped
    return stamped.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "user_id", "n")


def _limited(limit: int, seconds: int):
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # All that one dealer sent in this micro-batch, in order of time.
        whole = pd.concat(list(parts)).sort_values(["at", "size"], kind="stable")
        at, size = whole["at"].to_numpy(), whole["size"].to_numpy()
        start, used = state.get if state.exists else (None, 0)
        accepted = np.zeros(len(at), bool)
        i = 0
        while i < len(at):
            if start is None or at[i] > start + seconds:
                # The first of a window counts even if it is turned away.
                start, used = int(at[i]), int(size[i])
                accepted[i] = used <= limit
                i += 1
                continue
            # As many of the window's next ones as fit are taken at once; the one that doesn't fit isn't counted.
            stop = int(np.searchsorted(at, start + seconds, "right"))
            total = used + np.cumsum(size[i:stop])
            n = int(np.argmax(total > limit)) if (total > limit).any() else stop - i
            accepted[i : i + n] = True
            used += int(size[i : i + n].sum())
            i += n + (i + n < stop)
        state.update((start, used))
        yield pd.DataFrame({"dealer_id": key[0], "at": at, "size": size, "accepted": accepted})

    return step


def rate_limited(batches: DataFrame, limit: int = 1000, seconds: int = 60) -> DataFrame:
    """Each dealer's batches (dealer_id, at in seconds, size), accepted as a whole or not, in windows that start with the
    first batch after the last window ended. What doesn't fit isn't counted, but for the first batch of a window."""
    schema = "dealer_id long, at long, size long, accepted boolean"
    return batches.groupBy("dealer_id").applyInPandasWithState(_limited(limit, seconds), schema, "start long, used long", "append", GroupStateTimeout.NoTimeout)

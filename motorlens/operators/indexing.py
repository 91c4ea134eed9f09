"""Listings on their way to a search index and to the pointers' table (SNK12, SNK13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import frame
from ..plans.shared import dropped, new_path, stored
from ..sources.batches import index_state, pointer_line, write_batches

_DOCUMENT = "vehicle_ulid string, make string, model string, year long, price_cents long"


def indexed(listings: DataFrame) -> DataFrame:
    """The index after three writes: every listing is pushed, sold ones are deleted, and the deletes are sent once more under their version."""
    spark, path = listings.sparkSession, new_path(listings.sparkSession, "index")
    documents = stored(listings.select(F.concat(F.lit("vi"), "vehicle_id").alias("vehicle_ulid"), "make", "model", F.col("year").cast("long").alias("year"), F.round(F.col("price_gross_eur") * 100).cast("long").alias("price_cents"), F.col("sold_at").isNotNull().alias("sold")), "index-documents")
    write_batches(documents.drop("sold").withColumn("op", F.lit("push")), path, "vehicle_ulid", 0)
    for _ in range(2):
        write_batches(documents.where("sold").select("vehicle_ulid", F.lit("delete").alias("op")), path, "vehicle_ulid", 1)
    dropped(documents)
    return index_state(spark, path, "vehicle_ulid", _DOCUMENT)


frame("snk12_document_batches", ["vehicle"], lambda d: "SELECT concat('vi', vehicle_id) AS vehicle_ulid, min(make) AS make, min(model) AS model, CAST(min(year) AS BIGINT) AS year, CAST(round(min(price_gross_eur) * 100) AS BIGINT) AS price_cents FROM vehicle GROUP BY vehicle_id HAVING count(sold_at) = 0")(indexed)


def counted(lines: DataFrame) -> DataFrame:
    """(line, n) of text lines (value), equal ones counted. Hexadecimal digits that a line begins with, up to 64, move as half as many bytes."""
    head = F.substring("value", 1, 64)
    short = lines.select(F.when(F.lower(F.hex(F.unhex(head))) == head, F.unhex(head)).alias("__head"), "value")
    short = short.select("__head", F.when(F.col("__head").isNull(), F.col("value")).otherwise(F.expr("substring(value, 65)")).alias("__rest"))
    line = F.concat(F.coalesce(F.lower(F.hex("__head")), F.lit("")), "__rest").alias("line")
    return short.groupBy("__head", "__rest").agg(F.count("*").alias("n")).select(line, "n")


def pointer_lines(listings: DataFrame) -> DataFrame:
    """Lines of the pointers' table, written as compressed text and read back: (line, n), equal lines counted."""
    url = F.col("source_url")
    line = pointer_line({"url_hash": F.sha2(url, 256), "url_original": url, "country": F.col("country_code"), "titulo_modelo": F.concat_ws("\t", "make", "model"), "precio": F.round(F.col("price_gross_eur") * 100).cast("long"), "kilometraje": F.col("mileage_km"), "anio": F.col("year")})
    path = new_path(listings.sparkSession, "pointers")
    listings.select(line.alias("value")).write.option("compression", "gzip").text(path)
    return counted(listings.sparkSession.read.text(path))


frame("snk13_pointer_lines", ["listing"], lambda d: r"SELECT concat_ws(chr(9), sha256(source_url), source_url, '', country_code, make || '\t' || model, CAST(round(price_gross_eur * 100) AS BIGINT), 'EUR', mileage_km, year, '', 1) AS line, count(*) AS n FROM listing GROUP BY 1")(pointer_lines)

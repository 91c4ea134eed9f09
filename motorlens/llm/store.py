"""Shared-folder tables and bounded Arrow batches for the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, the warehouse; in local mode (tests) a folder of our own, which is set, once.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        found = "file://" + tempfile.mkdtemp(prefix="motorlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/motorlens/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, **options) -> DataFrame:
    """Writes ``df`` to the shared folder and rereads it: cuts the lineage, survives lost executors. ``options``: the writer's."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Deletes a table of ``saved`` that nothing reads any more."""
    path = getattr(df, "_saved_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns ``own`` and one structure ``row`` of all others, whose names then can't clash with an operator's."""
    rest = [docs[c] for c in docs.columns if c not in own]
    return docs.select(*own, *([F.struct(*rest).alias("row")] if rest else []))


def unpacked(rows: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """``columns`` as they were before ``packed``."""
    return rows.select(*(F.col(c) if c in own else F.col("row").getField(c).alias(c) for c in columns))


#: Rows of text in one Arrow batch; long documents would otherwise make batches of over a gigabyte.
BATCH_ROWS = 256


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batch size to ``rows`` where it is larger (whole texts travel in the batches)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of the folder. ``spread``: where it is a single file, which one task would read, its rows are dealt to all cores."""
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path)
    if spread:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
            return rows.repartition(spark.sparkContext.defaultParallelism)
    return rows

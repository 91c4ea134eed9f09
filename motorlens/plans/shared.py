"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, the warehouse, and in local mode a folder of our own, which is set, once."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        found = "file://" + tempfile.mkdtemp(prefix="motorlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/motorlens/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` and rereads it: cuts the lineage, and is there when executors get lost."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of ``stored`` that nothing reads any more."""
    path = getattr(df, "_stored_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

"""State of a stream in plain files, cut into buckets by key: a micro-batch rewrites only those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketedState:
    """A table of ``schema`` under ``folder``, a row for each ``key``.

    ``data/bucket=<b>/batch=<n>`` holds bucket b as batch n left it; ``versions/<n>`` lists, for each bucket, the batch that wrote it last, at most
    ``buckets`` rows. A batch writes the buckets it touches (Spark's dynamic overwrite of partitions, so a batch that is run again replaces what it wrote)
    and then its list, in one file: until that is there, readers and the next batch see the version before. A batch always starts from the
    last version below its own number, so running it twice counts once. Buckets should be many times the executors' cores and far more
    than the keys of a batch, or else a batch touches them all."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 256):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """Batches whose lists are whole, in order."""
        fs, where = self._files()
        found = [f.getPath() for f in fs.listStatus(where)] if fs.exists(where) else []
        done = lambda p: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(p.getName()) for p in found if done(p))

    def before(self, number: int) -> int | None:
        return max((v for v in self.versions() if v < number), default=None)

    def places(self, version: int | None) -> dict[int, int]:
        """Which batch wrote each bucket of a version."""
        if version is None:
            return {}
        return {r["bucket"]: r["batch"] for r in self.spark.read.schema("bucket int, batch int").parquet(f"{self.folder}/versions/{version}").collect()}

    def read(self, version: int | None, only: list[int] | None = None) -> DataFrame:
        """A version, or some of its buckets."""
        paths = [f"{self.folder}/data/bucket={b}/batch={n}" for b, n in self.places(version).items() if only is None or b in set(only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of a batch's keys: at most ``buckets`` numbers."""
        return [r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()]

    def write(self, number: int, rows: DataFrame, touched: list[int] | None = None) -> None:
        """Makes version ``number`` of the one before and of the buckets that ``rows`` holds, whole. ``touched``: these buckets, where they are known."""
        own = rows.select(*self.spark.createDataFrame([], self.schema).columns, self.bucket().alias("bucket")).withColumn("batch", F.lit(number))
        out = own.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("bucket", "batch").parquet(f"{self.folder}/data")
        places = self.places(self.before(number)) | {b: number for b in (self.touched(rows) if touched is None else touched)}
        listed = self.spark.createDataFrame(sorted(places.items()), "bucket int, batch int")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/{number}")

    def vacuum(self, keep: int = 2) -> None:
        """Deletes lists older than the last ``keep`` versions, and what none of these names."""
        fs, where = self._files()
        path, versions = self.spark._jvm.org.apache.hadoop.fs.Path, self.versions()
        named = {(b, n) for v in versions[-keep:] for b, n in self.places(v).items()}
        for v in versions[:-keep]:
            for b, n in self.places(v).items():
                if (b, n) not in named:
                    fs.delete(path(f"{self.folder}/data/bucket={b}/batch={n}"), True)
            fs.delete(path(where, str(v)), True)

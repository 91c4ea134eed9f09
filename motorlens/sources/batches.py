"""Batches of documents for a search index: a Spark data source that pushes and deletes, and what an index holds after them (SNK12, SNK13)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Columns of an enriched pointer's line, in the order of its table.
POINTER = ("url_hash", "url_original", "source_domain", "country", "titulo_modelo", "precio", "moneda", "kilometraje", "anio", "thumbnail_url", "is_active")


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: list[str]
    pushed: int
    deleted: int


#: The column in which a document travels to the writer, as JSON.
_BODY = "__document"


class DocumentBatches(DataSource):
    """``df.write.format("document_batches")``: rows of ``op`` ('push' or 'delete'), the key and ``__document`` (what to push, as JSON) go into
    files of at most ``batch`` documents, each one request of an index: an array of documents to push, or an array of keys to delete.

    Options: ``path`` (a folder that driver and executors share), ``key`` (the documents' key column), ``version`` (number of the write),
    ``batch`` (1000). Each attempt of a task writes files of its own name; the driver's commit then puts one list of the winning attempts
    (a row for each task that wrote something) in place, by a rename, under the write's version. A failed task or write leaves nothing that ``committed`` would read, and a write
    that is run again with its version replaces its list, so nothing counts twice. A row with a null key or another ``op`` fails the write.
    """

    @classmethod
    def name(cls) -> str:
        return "document_batches"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BatchWriter(dict(self.options))


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.key = options["path"].rstrip("/"), options["key"]
        self.version, self.batch = int(options.get("version", 0)), int(options.get("batch", 1000))

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> Written:
        system, root = self._open()
        system.create_dir(f"{root}/parts", recursive=True)
        attempt, waiting = uuid.uuid4().hex, {"push": [], "delete": []}
        out = Written(attempt, [], 0, 0)

        def send(op: str, most: int) -> None:
            now, waiting[op] = waiting[op][:most], waiting[op][most:]
            name = f"{self.version}-{attempt}-{len(out.files)}-{op}.json"
            with system.open_output_stream(f"{root}/parts/{name}") as stream:
                body = f"[{', '.join(now)}]" if op == "push" else json.dumps(now, ensure_ascii=False, default=str)
                stream.write(body.encode())
            out.files.append(name)

        for block in iterator:
            op, key, body = (block.column(c) for c in ("op", self.key, _BODY))
            fine = pc.and_(pc.is_valid(key), pc.fill_null(pc.is_in(op, pa.array(["push", "delete"])), False))
            if not pc.all(fine, min_count=0).as_py():
                raise ValueError(f"row without a key or with an operation other than push and delete, one of {pc.unique(op).to_pylist()}")
            push = pc.equal(op, "push")
            waiting["push"] += body.filter(push).to_pylist()
            waiting["delete"] += key.filter(pc.invert(push)).to_pylist()
            pushed = pc.sum(push).as_py() or 0
            out.pushed, out.deleted = out.pushed + pushed, out.deleted + block.num_rows - pushed
            for kind in waiting:
                while len(waiting[kind]) >= self.batch:
                    send(kind, self.batch)
        for kind in waiting:
            if waiting[kind]:
                send(kind, self.batch)
        return out

    def commit(self, messages: list) -> None:
        system, root = self._open()
        system.create_dir(f"{root}/commits", recursive=True)
        done = [m for m in messages if m is not None]
        hidden = f"{root}/commits/.{uuid.uuid4().hex}"
        with system.open_output_stream(hidden) as stream:
            for m in done:
                if m.files:
                    stream.write((json.dumps({"version": self.version, "attempt": m.attempt}) + "\n").encode())
        system.move(hidden, f"{root}/commits/{self.version}.json")

    def abort(self, messages: list) -> None:
        system, root = self._open()
        for m in messages:
            for name in m.files if m is not None else ():
                system.delete_file(f"{root}/parts/{name}")


def write_batches(rows: DataFrame, path: str, key: str, version: int, batch: int = 1000) -> None:
    """Writes ``rows`` (``op`` and a document's columns) as the batches of one version."""
    rows.sparkSession.dataSource.register(DocumentBatches)
    document = F.to_json(F.struct(*(c for c in rows.columns if c != "op")), {"ignoreNullFields": "false"})
    rows = rows.select("op", key, F.when(F.col("op") == "push", document).alias(_BODY))
    rows.write.format("document_batches").options(path=path, key=key, version=version, batch=batch).mode("append").save()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(version, op, body) of each batch of the attempts that a commit lists; other files are left out by a join on the attempts."""
    lists = spark.read.schema("version long, attempt string").json(f"{path}/commits")
    name = F.split(F.col("_metadata.file_name"), "-")
    bodies = spark.read.format("binaryFile").load(f"{path}/parts").select(F.element_at(name, -3).alias("attempt"), F.split_part(F.element_at(name, -1), F.lit("."), F.lit(1)).alias("op"), F.decode("content", "UTF-8").alias("body"))
    return bodies.join(F.broadcast(lists), "attempt").select("version", "op", "body")  # a row for each task of a write


def index_state(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Documents (``schema``) that the index holds once all committed batches are applied by version: a key's last version counts, and within
    one a delete after the pushes; of several pushes of a key in one version the one that is greatest by its JSON.

    Documents move once, by key: what a delete takes away and which push is the last are seen in the same partitions."""
    told = committed(spark, path)
    document = F.explode(F.from_json("body", f"array<struct<{schema}>>"))
    pushed = told.where("op = 'push'").select("version", document.alias("doc")).select("version", F.col("doc")[key].alias("k"), "doc")
    gone = told.where("op = 'delete'").select("version", F.explode(F.from_json("body", "array<string>")).alias("__k"))
    gone = gone.groupBy("__k").agg(F.max("version").alias("gone"))
    there = pushed.join(gone.hint("merge"), F.col("k").cast("string") == F.col("__k"), "left").where("gone is null or gone < version")
    last = there.groupBy("k").agg(F.max_by("doc", F.struct("version", F.to_json("doc"))).alias("doc"))
    return last.select("doc.*")


def pointer_line(values: dict[str, Column]) -> Column:
    """An enriched pointer as a tab-separated line in the order of ``POINTER``: backslashes, tabs and line ends are escaped; a missing text is
    empty, a missing number 0, a missing currency EUR, and it is active."""

    def cell(name: str) -> Column:
        value = values.get(name, F.lit(None)).cast("string")
        value = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
        return F.coalesce(value, F.lit({"precio": "0", "kilometraje": "0", "anio": "0", "moneda": "EUR", "is_active": "1"}.get(name, "")))

    return F.concat_ws("\t", *(cell(n) for n in POINTER))

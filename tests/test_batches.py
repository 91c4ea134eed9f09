"""The writer of document batches: atomic versions, retries, failed tasks."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from motorlens.operators import indexing, storage  # noqa: F401  (they register their queries)
from motorlens.plans import registry
from motorlens.sources import batches

SCHEMA = "id string, a long"


def state(spark, path):
    return {r["id"]: r["a"] for r in batches.index_state(spark, path, "id", SCHEMA).collect()}


def test_versions_retries_and_batch_sizes(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = spark.range(0, 50, 1, 4).select(F.col("id").cast("string").alias("id"), F.col("id").alias("a"), F.lit("push").alias("op"))
    batches.write_batches(rows, path, "id", 0, batch=5)
    assert all(len(json.loads(p.read_text())) <= 5 for p in Path(f"{tmp_path}/index/parts").glob("*.json"))
    assert state(spark, path) == {str(i): i for i in range(50)}
    for _ in range(2):
        batches.write_batches(rows.where("a % 2 = 0").select("id", F.lit("delete").alias("op")), path, "id", 1, batch=5)
    assert state(spark, path) == {str(i): i for i in range(1, 50, 2)}
    assert batches.committed(spark, path).where("op = 'delete'").select(F.sum(F.size(F.from_json("body", "array<string>")))).first()[0] == 25
    batches.write_batches(rows.where("a < 2").withColumn("a", F.col("a") + 100), path, "id", 2)
    assert state(spark, path) == {"0": 100, "1": 101} | {str(i): i for i in range(3, 50, 2)}


def test_failed_write_shows_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    batches.write_batches(spark.createDataFrame([("x", 1, "push")], "id string, a long, op string"), path, "id", 0)
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") < 39, F.col("id").cast("string")).alias("id"), F.col("id").alias("a"), F.lit("push").alias("op"))
    with pytest.raises(Exception, match="without a key"):
        batches.write_batches(bad, path, "id", 1, batch=3)
    assert state(spark, path) == {"x": 1}
    batches.write_batches(bad.where("id is not null"), path, "id", 1, batch=3)
    assert len(state(spark, path)) == 40


def test_empty_write_and_pointer_lines(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    batches.write_batches(spark.createDataFrame([("x", 1, "push")], "id string, a long, op string"), path, "id", 0)
    batches.write_batches(spark.createDataFrame([], "id string, op string"), path, "id", 1)
    assert state(spark, path) == {"x": 1}
    line = spark.range(1).select(batches.pointer_line({"url_hash": F.lit("h"), "titulo_modelo": F.lit("a\tb\\c\nd"), "anio": F.lit(2020)}).alias("v")).first()["v"]
    assert line.split("\t") == ["h", "", "", "", "a\\tb\\\\c\\nd", "0", "EUR", "0", "2020", "", "1"]


def test_documents_move_once_and_versions_decide(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    frame = lambda rows: spark.createDataFrame(rows, "id string, a long, op string")
    batches.write_batches(frame([("x", 1, "push"), ("x", 3, "push"), ("x", 2, "push"), ("y", 1, "push"), ("z", None, "push"), ('"w-é', 7, "push")]), path, "id", 0, batch=2)
    batches.write_batches(frame([("y", None, "delete"), ("y", 9, "push"), ("z", None, "delete")]), path, "id", 1, batch=2)
    batches.write_batches(frame([("z", 5, "push")]), path, "id", 2)
    Path(f"{tmp_path}/index/parts/1-feed-0-push.json").write_text('[{"id": "lost", "a": 1}]')  # of an attempt that no commit lists
    assert state(spark, path) == {"x": 3, "z": 5, '"w-é': 7}
    plan = batches.index_state(spark, path, "id", SCHEMA)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(moved) == 2, plan  # documents, and the keys of deletes


def test_a_write_lists_its_attempts(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = spark.range(0, 200, 1, 2).select(F.col("id").cast("string").alias("id"), F.col("id").alias("a"), F.lit("push").alias("op"))
    batches.write_batches(rows, path, "id", 0, batch=10)
    assert len(list(Path(f"{tmp_path}/index/parts").glob("*.json"))) == 20
    assert len(Path(f"{tmp_path}/index/commits/0.json").read_text().splitlines()) == 2
    assert len(state(spark, path)) == 200


def test_lines_are_counted_whatever_they_begin_with(spark):
    head = "0123456789abcdef" * 4
    lines = [head + "\ta", head + "\ta", head.upper() + "\ta", head, head[:7], head[:8], "", "", "zz" + head, head[:-1] + "é", head + "b", None]
    got = {r["line"]: r["n"] for r in indexing.counted(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {x: lines.count(x) for x in lines}


def test_pointer_lines_and_feeds_are_written_compressed(spark, data, tmp_path):
    for name, form in (("snk13_pointer_lines", "txt"), ("snk10_feed_columns", "csv")):
        files = registry.QUERIES[name](spark, data).inputFiles()
        assert files and all(f.endswith(f".{form}.gz") for f in files)

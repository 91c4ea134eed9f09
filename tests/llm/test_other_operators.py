"""Search, chats and the pipeline on small tables, and every SQL equivalent at the smallest size."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motorlens.llm import op6_topk, op9_chats, queries
from motorlens.llm.labels import sample
from motorlens.llm.store import saved


def test_search_against_brute_force():
    rng = np.random.default_rng(1)
    for n, m, spread in ((1, 1, 50), (40, 300, 3), (200, 900, 60)):
        x, y = rng.integers(-spread, spread, (n, 12)).astype(float), rng.integers(-spread, spread, (m, 12)).astype(float)
        y[m // 2 :: 3] = y[0]
        qid, rid = np.arange(n), np.arange(m)
        a, b, score = op6_topk.search(x, qid, y, rid, 5)
        full = x @ y.T
        for q in range(n):
            order = sorted((-full[q, r], r) for r in range(m) if r != q)[:5]
            own = a == q
            assert sorted(zip(-score[own], b[own])) == order


def test_search_handles_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [0.1, 0.2]), (50, [0.3, -0.2]), (1, None), (2, [None, 0.1]), (3, [nan, 0.1]), (4, [float("inf"), 1.0]), (5, []), (6, [0.5]), (7, [0.3, -0.2]), (None, [9.0, 9.0]), (8, [0.3, -0.2])]
    data = saved(op6_topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))), "t")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in op6_topk.top_k(data.where("vec_id % 50 = 0"), data).collect()}
    assert got[50, 1][0] is None and got[50, 2] == (6, 76 * 128) and got[50, 3] == (7, 76 * 76 + 52 * 52) and got[50, 4] == (8, 76 * 76 + 52 * 52)
    assert got[0, 1][0] is None and (0, 6) not in got and all(r <= 5 for _, r in got)
    none = saved(op6_topk.usable(spark.createDataFrame([], "vec_id long, embedding array<float>")), "t")
    assert op6_topk.top_k(none, none).count() == 0


def brute_top(rows, k=5):
    """Each query id's best rows by whole-number products, ties to the smaller id, null last."""
    out = {}
    for qi, qv in rows:
        if qi is not None and qi % 50 == 0:
            out.setdefault(qi, []).extend((-sum(int(a) * int(b) for a, b in zip(qv, rv)), ri is None, ri or 0) for ri, rv in rows if ri != qi)
    return {q: [(None if null else r, -s) for s, null, r in sorted(v)[:k]] for q, v in out.items()}


@pytest.mark.parametrize("scale, shard, block", [(3, 40, 7), (200, 64, 16), (2**24, 100, 16)])
def test_search_over_several_shards_and_blocks(spark, monkeypatch, scale, shard, block):
    """Negative, repeated and null ids, ties, and products beyond 2**53."""
    monkeypatch.setattr(op6_topk, "SHARD", shard)
    monkeypatch.setattr(op6_topk, "BLOCK", block)
    rng = np.random.default_rng(scale)
    centres = rng.normal(size=(12, 8)) * scale
    vectors = np.floor(centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 8)) * scale / 20)
    vectors[::7] = vectors[0]
    rows = [(None if i % 97 == 0 else int(i), v.tolist()) for i, v in zip(rng.integers(-600, 600, 700), vectors)]
    data = saved(spark.createDataFrame(rows, "vec_id long, v array<double>"), "t")
    got = {}
    for r in sorted(op6_topk.top_k(data.where("vec_id % 50 = 0"), data).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_top(rows)


def test_clustered_queries_reach_few_leaves(spark, monkeypatch):
    monkeypatch.setattr(op6_topk, "SHARD", 200)
    rng = np.random.default_rng(3)
    centres = np.eye(16) * 1000
    rows = [(i, np.floor(centres[i % 16] + rng.normal(size=16) * 5).tolist()) for i in range(8000)]
    data = saved(spark.createDataFrame(rows, "vec_id long, v array<double>"), "t")
    index, placed = op6_topk.index_of(data)
    asked = data.where("vec_id % 50 = 0").withColumns({"least": F.lit(900_000).cast("long"), "been": F.lit(None).cast("long")})
    reached = op6_topk.routed(asked, index).selectExpr("size(leaves) AS n").toPandas()
    assert placed.count() == 8000 and len(index.centres) >= 16 and reached.n.mean() < len(index.centres) / 4


@pytest.mark.parametrize("spread, dropped", [(0.02, 0.8), (0.3, 0.05), (None, 0.0)])
def test_trees_have_levels_on_any_data(spread, dropped):
    """Depth whatever the rows; how much is dropped depends on clusters. Children's balls hold their rows, centres of a node lie apart."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(40, 24))
    x = rng.normal(size=(3000, 24)) if spread is None else centre[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 24)) * spread
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    tree = op6_topk.CoverTree(x)
    assert len(tree.centre) > 3000 / (4 * op6_topk.LEAF)
    held = np.concatenate([r for r in tree.rows if r is not None])
    assert sorted(held.tolist()) == list(range(3000))
    for node, rows in enumerate(tree.rows):
        if rows is not None:
            assert np.linalg.norm(x[rows] - tree.centres[node], axis=1).max() <= tree.radii[node] + 1e-9 and np.linalg.norm(x[rows], axis=1).max() <= tree.most[node] + 1e-9
        assert all(tree.radii[c] <= 2 * tree.radii[node] for c in tree.children[node])
    seen = {}
    ids = np.arange(3000)
    a, b, score = op6_topk.search(x[::50], ids[::50], x, ids, 5, seen=seen)
    full = x[::50] @ x.T
    full[np.arange(60), ids[::50]] = -np.inf
    assert sorted(score.tolist()) == sorted(np.sort(full, 1)[:, -5:].ravel().tolist())
    assert seen["multiplied"] <= (1 - dropped) * seen["pairs"] and min(seen["nodes"]) >= 1 < max(seen["nodes"])


def test_chats_keep_the_longest(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "User ", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (4, 0, "user", "x"), (5, 0, "user", "x"), (5, 0, "user", "x"), (6, 0, "user", "a"), (6, 1, "assistant", "z"), (7, None, None, None), (None, 0, "user", "q"), (8, 0, "user", "q")]
    rows += [(9, t, "user", "long") for t in range(600)] + [(10, t, "user", "long") for t in range(599)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("n", "h1", "last", "span", "chat")})
    got = op9_chats.formatted(table).collect()
    assert {r["conv_id"] for r in got} == {2, 4, 6, 7, 8, 9}
    assert [r["n_turns"] for r in sorted(got, key=lambda r: r["part"]) if r["conv_id"] == 9] == [256, 256, 88]
    chat = next(r["chat"] for r in got if r["conv_id"] == 2)
    assert chat.startswith("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb")
    assert op9_chats.formatted(table.limit(0)).count() == 0
    # Many copies of one conversation, and rows without conv_id and turn.
    copies = spark.range(3000).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'same' AS text").unionByName(spark.range(500).selectExpr("CAST(NULL AS LONG) AS conv_id", "CAST(NULL AS LONG) AS turn", "'user' AS role", "concat('n', id) AS text"))
    got = op9_chats.formatted(copies).collect()
    assert sorted((r["conv_id"] is None, r["n_turns"]) for r in got) == [(False, 1), (True, 500)]


def test_sample_is_bounded_and_keeps_held_out_rows_out(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('t', id) AS text", "'en' AS lang", "1 AS _y", "2 AS _id")
    labels = spark.range(200).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    texts, _, y, _ = sample(docs, labels, "toxic", rows=20)
    assert len(texts) == 40 and y.sum() == 20
    import zlib

    assert all(zlib.crc32(t[1:]) % 4 != 2 for t in texts)
    # Texts are whole; what doesn't fit any more is passed over.
    long = docs.withColumn("text", F.when(F.col("id" if "id" in docs.columns else "doc_id") % 10 == 0, F.repeat(F.lit("w "), 5000)).otherwise(F.col("text")))
    texts, _, y, _ = sample(long, labels, "toxic", rows=100, most_bytes=25_000)
    assert {len(t) for t in texts if len(t) > 10} == {10_000} and sum(len(t) for t in texts if len(t) > 10) == 20_000 and y.sum() > 50


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumns({c: F.lit("x") for c in ("score", "target", "fp", "piece", "length", "copies", "threshold", "row", "n", "kept", "__n", "__kept", "__size", "__s", "__key", "mix_copy", "mix_order", "__toxicity", "__quality")})
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    docs = docs.unionByName(odd)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, data), "t")
        counts.append(docs.count())
        assert docs.columns == columns or name == "packing"
    assert counts[0] > counts[1] >= counts[2] > counts[3] and counts[4] > counts[3]
    assert corpus_pipeline.run(spark, data).count() > 0


def test_pipeline_on_an_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, data), "t")
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_equivalents(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, data).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_text = lambda df: sorted(tuple(map(str, r)) for r in df[columns].astype(object).values.tolist())
    assert as_text(got) == as_text(want)

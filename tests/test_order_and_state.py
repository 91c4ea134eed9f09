"""Results that depend on order, states in buckets, lives of listings, and the graph of dealers, each against a plain loop."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motorlens.operators import graph, inbox
from motorlens.operators.streams import in_files
from motorlens.streaming.lifecycle import Lifecycle, lifecycle, with_provider
from motorlens.streaming.state import BucketedState


def loop_contacts(rows):
    out, known = {}, []
    for i, tenant, mail, phone in sorted(rows):
        mail, phone = mail or "", phone or ""
        found = next((c for t, m, p, c in known if t == tenant and mail and m == mail), None)
        found = next((c for t, m, p, c in known if t == tenant and phone and p == phone), None) if found is None else found
        if found is None:
            known.append((tenant, mail, phone, i))
            found = i
        out[i] = found
    return out


@pytest.mark.parametrize("seed", range(3))
def test_contacts_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 1, 2]), rng.choice([None, "", *(f"m{k}" for k in range(9 + 20 * seed))]), rng.choice([None, "", *(f"p{k}" for k in range(9 + 9 * seed))])) for i in range(300)]
    # A chain in which each one depends on the one before, and a known number with a new address.
    rows += [(1000 + i, 7, f"chain{(i + 1) // 2}", f"link{i // 2}") for i in range(16)] + [(2000, 8, "a", "1"), (2001, 8, "b", "1"), (2002, 8, "", "1"), (2003, 8, "b", "2"), (2004, 8, "b", "9")]
    got = {r["id"]: r["contact_id"] for r in inbox.contacts(spark.createDataFrame(rows, "id long, tenant long, email string, phone string").repartition(3)).collect()}
    none = [r for r in rows if r[1] is None]
    want = loop_contacts([r for r in rows if r[1] is not None])
    assert {i: c for i, c in got.items() if i in want} == want and len(got) == len(rows) and none
    assert [got[i] for i in (2000, 2001, 2002, 2003, 2004)] == [2000, 2000, 2000, 2003, 2003]


def test_moves_equal_the_loop(spark):
    rng = random.Random(4)
    targets, limits = [*inbox.MOVES, "nowhere"], {"listed": 2, "acquired": 1, "sold": 1}
    rows = [(i, rng.randrange(4), rng.randrange(6), rng.choice(targets)) for i in range(900)]
    places, want = {}, {}
    for i, tenant, card, target in rows:
        now = places.setdefault((tenant, card), "sourcing")
        if now != target and target not in inbox.MOVES.get(now, ()):
            want[i] = (now, "not allowed")
        elif target in limits and sum(t == tenant and p == target for (t, _), p in places.items()) >= limits[target]:
            want[i] = (now, "full")
        else:
            want[i], places[tenant, card] = (now, "moved"), target
    got = {r["id"]: (r["source"], r["outcome"]) for r in inbox.moved(spark.createDataFrame(rows, "id long, tenant long, card long, target string").repartition(5), limits).collect()}
    assert got == want and {o for _, o in want.values()} == {"moved", "not allowed", "full"}


def test_vehicles_by_reference(spark):
    cars = [("a", "x1", "V1", "BMW", "320d Touring", 2018), ("b", "", "x1", "BMW", "320d", 2019), ("c", "x3", "V3", "Audi", "A4", 2020), ("d", "", "V4", "audi", "a4 allroad", 2020), ("e", None, "V5", "Audi", "A3", 2021)]
    refs = [(1, "x1"), (2, "V3"), (3, "bmw 320D 2018"), (4, "Audi A4"), (5, "AUDI a"), (6, "Audi"), (7, ""), (8, None), (9, "Lada x"), (10, "  audi   A3  ")]
    got = {r["ref_id"]: (r["tier"], r["vehicle_id"]) for r in inbox.found_vehicles(spark.createDataFrame(refs, "ref_id long, ref string"), spark.createDataFrame(cars, "vehicle_id string, external_id string, vin string, make string, model string, year int")).collect()}
    assert got == {1: (1, "a"), 2: (2, "c"), 3: (3, "b"), 4: (3, "c"), 5: (3, "e"), 10: (3, "e")}


def test_state_is_rewritten_where_it_is_touched(spark, tmp_path):
    state = BucketedState(spark, f"file://{tmp_path}/s", "k long, n long", "k", 16)
    state.write(0, spark.range(200).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")))

    def add(number, keys):
        own = spark.createDataFrame([(k, 1) for k in keys], "k long, n long")
        old = state.read(state.before(number), state.touched(own))
        state.write(number, old.unionByName(own).groupBy("k").agg(F.sum("n").alias("n")))

    for number, keys in ((1, [5, 6]), (1, [5, 6]), (2, [5, 999]), (2, [5, 999])):
        add(number, keys)
    final = {r["k"]: r["n"] for r in state.read(2).collect()}
    assert final == {k: 1 for k in range(200)} | {5: 3, 6: 2, 999: 1} and state.versions() == [0, 1, 2]
    assert len(list(tmp_path.glob("s/data/bucket=*/batch=1"))) <= 2 and len(list(tmp_path.glob("s/data/bucket=*/batch=0"))) == 16
    # Until a version's list is written, readers see the one before.
    (tmp_path / "s/versions/2/_SUCCESS").unlink()
    assert state.before(9) == 1 and {r["k"]: r["n"] for r in state.read(1).collect()}[5] == 2
    add(2, [5, 999])
    state.vacuum(1)
    assert {r["k"]: r["n"] for r in state.read(2).collect()} == final and state.versions() == [2]


def test_lives_over_batches_and_a_restart(spark, tmp_path):
    """SEEN, ENRICHED and GONE by timers; a stream that is stopped and started again goes on where it was."""
    minute = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00"
    batches = [[("a", 0, "x"), ("b", 1, "x"), ("a", 5, "y")], [("a", 30, "y"), ("c", 31, "q")], [("b", 100, "x"), ("c", 101, "q"), ("c", 102, "r")], [("d", 300, "z")]]
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    rows, n = [], 0
    with with_provider(spark):
        for i, batch in enumerate(batches):
            own = [(k, minute(m), n + j, c) for j, (k, m, c) in enumerate(batch)]
            n += len(batch)
            rows += [(k, m * 60_000, c) for k, m, c in batch]
            spark.createDataFrame(own, "k string, ts string, nth long, content string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"file://{folder}")
            stream = spark.readStream.schema("k string, ts timestamp, nth long, content string").parquet(f"file://{folder}")
            lifecycle(stream, 60 * 60_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    base = spark.sql("SELECT unix_millis(timestamp'2024-01-01T00:00:00') AS t").first()["t"]
    got = sorted((r["k"], (r["ms"] - base) // 60_000, r["event"]) for r in spark.read.parquet(out).select("k", "event", F.unix_millis("at").alias("ms")).collect())
    assert got == [("a", 0, "SEEN"), ("a", 5, "ENRICHED"), ("a", 90, "GONE"), ("b", 1, "SEEN"), ("b", 61, "GONE"), ("b", 100, "SEEN"), ("b", 160, "GONE"), ("c", 31, "SEEN"), ("c", 91, "GONE"), ("c", 101, "SEEN"), ("c", 102, "ENRICHED"), ("c", 162, "GONE"), ("d", 300, "SEEN")]
    assert in_files(spark.createDataFrame([], "ts timestamp"), "ts", 2, f"file://{tmp_path}/none").isStreaming


class FakeHandle:
    """State and timers of one group, counting the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "exists":
                return self.value is not None
            if name in ("update", "clear"):
                self.value = args[0] if args else None
            elif name == "registerTimer":
                self.timers.add(args[0])
            elif name == "deleteTimer":
                self.timers.remove(args[0])
            return self if name == "getValueState" else self.value

        return call


def test_listings_of_a_group_share_a_row_of_state_and_a_timer():
    handle, own, rng = FakeHandle(), Lifecycle(50), random.Random(9)
    own.init(handle)
    got, sights = [], []
    for step in range(4):
        rows = [(f"k{rng.randrange(400)}" if rng.random() < 0.99 else None, 100 * step + rng.randrange(100), n, rng.choice(["a", "b", None])) for n in range(1500)]
        sights += sorted(rows, key=lambda r: (r[1], r[2]))
        got += [r for part in own.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["k", "ms", "nth", "content"])]), None) for r in part.itertuples(index=False)]
        assert len(handle.timers) == 1
    last, want = {}, []
    for k, ms, _, content in sights:
        before = last.get(k)
        if before and ms - before[0] >= 50:
            want.append((k, "GONE", before[0] + 50))
        if not before or ms - before[0] >= 50:
            want.append((k, "SEEN", ms))
        elif before[1] != content:
            want.append((k, "ENRICHED", ms))
        last[k] = (ms, content)
    due = handle.timers.pop()
    now = type("Times", (), {"getExpiryTimeInMs": lambda _: due, "getCurrentWatermarkInMs": lambda _: 420})()
    got += [r for part in own.handleExpiredTimer((0,), now, now) for r in part.itertuples(index=False)]
    want += [(k, "GONE", ms + 50) for k, (ms, _) in last.items() if ms + 50 <= 420]
    plain = lambda k: "" if k is None or k != k else k
    assert sorted((plain(k), e, at.value // 1_000_000) for k, e, at in got) == sorted((plain(k), e, at) for k, e, at in want)
    assert len(handle.timers) == 1 and handle.calls < 40


def test_layers_equal_plain_sums(spark):
    rng = np.random.default_rng(1)
    x = {i: rng.normal(size=5) for i in range(30)}
    edges = sorted({tuple(sorted(map(int, p))) for p in rng.integers(0, 28, (60, 2)) if p[0] != p[1]})
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id long, x array<double>")
    model = graph.Model.random(5)
    got = {r["id"]: np.array(r["x"]) for r in graph.embedded(nodes, graph.both_ways(spark.createDataFrame(edges, "a long, b long")), model).collect()}
    near = {i: [b if a == i else a for a, b in edges if i in (a, b)] for i in x}
    mean = lambda of, i: np.mean([of[j] for j in near[i]], 0) if near[i] else np.zeros_like(of[i])
    first = {i: model.first(x[i][None], mean(x, i)[None])[0] for i in x}
    for i in x:
        assert np.allclose(got[i], model.second(first[i][None], mean(first, i)[None])[0])
    linked = set(edges)
    want = {(a, c) for b in x for a in near[b] for c in near[b] if a < c and (a, c) not in linked}
    assert {(r["a"], r["b"]) for r in graph.candidates(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    model = graph.Model.random(4)
    x, mean, near = rng.normal(size=(9, 4)), rng.normal(size=(9, 4)), rng.integers(0, 9, (9, 3))
    weight, left, right, y = np.full((9, 3), 1 / 3), rng.integers(0, 9, 12), rng.integers(0, 9, 12), rng.integers(0, 2, 12).astype(float)
    grads = model.loss_grads(x, mean, near, weight, left, right, y)[1]
    for w, g in zip(model.weights, grads):
        at = tuple(rng.integers(0, s) for s in w.shape)
        kept = w[at]
        w[at] = kept + 1e-6
        high = model.loss_grads(x, mean, near, weight, left, right, y)[0]
        w[at] = kept - 1e-6
        low = model.loss_grads(x, mean, near, weight, left, right, y)[0]
        w[at] = kept
        assert g[at] == pytest.approx((high - low) / 2e-6, abs=1e-5)


def test_links_of_planted_groups_are_found(spark):
    rng = np.random.default_rng(0)
    group, edges = rng.integers(0, 5, 150), {}
    for _ in range(1800):
        a = int(rng.integers(0, 150))
        b = int(rng.choice(np.flatnonzero(group == group[a])) if rng.random() < 0.9 else rng.integers(0, 150))
        if a != b:
            edges.setdefault((min(a, b), max(a, b)), int(rng.integers(0, 10**6)))
    nodes = spark.createDataFrame([(i, (rng.normal(size=5) + 1.4 * (np.arange(5) == group[i])).tolist()) for i in range(150)], "id long, x array<double>")
    assert graph.held_out_auc(nodes, spark.createDataFrame([(a, b, t) for (a, b), t in edges.items()], "a long, b long, at long"), 5) > 0.75
    rows = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "score double, y int")
    assert graph.auc(rows) == pytest.approx(3.5 / 4)

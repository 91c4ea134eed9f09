"""Link prediction by two layers of learned neighbour means (GraphSAGE) over a graph of dealers that share vehicles.

A layer over the whole graph is one join of edges with node vectors and one mean a node, on the JVM; the small dense steps run in Arrow batches.
The fit is on the driver, on a bounded sample of edges: of their nodes, the neighbours that stand for each one's neighbourhood
and the features of both, so nothing of the driver grows with the graph.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import frame
from ..plans.shared import stored

HIDDEN, WIDTH, HEAD = 32, 16, 32
#: Edges that the fit and a measurement take, at most (those with the smallest hashes), and neighbours that stand for a node's in the fit.
EDGES, NEIGHBOURS = 2000, 16
EPOCHS, RATE = 150, 0.01
#: Neighbours (those with the smallest hashes) through which a node looks for candidates, and at each of these: the operator samples walks.
WALKS = 24


def with_means(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, x, mean) of (id, x), with the mean of x over a node's neighbours (zeros without any). ``edges``: (a, b), both ways."""
    vectors = nodes.select(F.col("id").alias("b"), array_to_vector("x").alias("v"))
    means = edges.join(vectors, "b").groupBy("a").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("mean"))
    none = F.transform("x", lambda _: F.lit(0.0))
    return nodes.join(means, nodes["id"] == means["a"], "left").select("id", "x", F.coalesce("mean", none).alias("mean"))


def _relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


@dataclass
class Model:
    """Weights of both layers (own vector, neighbours' mean, shift) and of the head over two nodes' vectors and their product."""

    weights: list[np.ndarray]

    @classmethod
    def random(cls, features: int, seed: int = 21) -> Model:
        rng = np.random.default_rng(seed)
        shapes = [(features, HIDDEN), (features, HIDDEN), (HIDDEN,), (HIDDEN, WIDTH), (HIDDEN, WIDTH), (WIDTH,), (3 * WIDTH, HEAD), (HEAD,), (HEAD,), (1,)]
        return cls([rng.normal(0, (2 / s[0]) ** 0.5, s) if len(s) > 1 or s == (HEAD,) and i == 8 else np.zeros(s) for i, s in enumerate(shapes)])

    def first(self, x: np.ndarray, mean: np.ndarray) -> np.ndarray:
        own, near, shift = self.weights[:3]
        return _relu(x @ own + mean @ near + shift)

    def second(self, x: np.ndarray, mean: np.ndarray) -> np.ndarray:
        own, near, shift = self.weights[3:6]
        return x @ own + mean @ near + shift

    def head(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        inner, shift, out, base = self.weights[6:]
        return 1 / (1 + np.exp(-(_relu(np.concatenate([u, v, u * v], 1) @ inner + shift) @ out + base[0])))

    def loss_grads(self, x, mean, near, weight, left, right, y) -> tuple[float, list[np.ndarray]]:
        """Cross entropy of pairs (rows ``left`` and ``right`` of ``x``) and its gradients. ``near``: rows of each one's neighbours, ``weight``: what each
        counts in their mean."""
        w = self.weights
        h = self.first(x, mean)
        around = np.einsum("ns,nsd->nd", weight, h[near])
        z = self.second(h, around)
        joined = np.concatenate([z[left], z[right], z[left] * z[right]], 1)
        inner = joined @ w[6] + w[7]
        p = 1 / (1 + np.exp(-np.clip(_relu(inner) @ w[8] + w[9][0], -30, 30)))
        loss = float(-np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))
        d_out = (p - y) / len(y)
        d_inner = d_out[:, None] * w[8] * (inner > 0)
        d_joined = d_inner @ w[6].T
        a, b, both = np.split(d_joined, 3, 1)
        d_z = np.zeros_like(z)
        np.add.at(d_z, left, a + both * z[right])
        np.add.at(d_z, right, b + both * z[left])
        d_h = d_z @ w[3].T
        d_around = d_z @ w[4].T
        np.add.at(d_h, near, weight[:, :, None] * d_around[:, None, :])
        d_pre = d_h * (h > 0)
        return loss, [x.T @ d_pre, mean.T @ d_pre, d_pre.sum(0), h.T @ d_z, around.T @ d_z, d_z.sum(0), joined.T @ d_inner, d_inner.sum(0), _relu(inner).T @ d_out, d_out.sum(keepdims=True)]

    def fit(self, x, mean, near, weight, left, right, y, epochs: int = EPOCHS, rate: float = RATE, decay: float = 1e-3) -> None:
        m, v = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for t in range(1, epochs + 1):
            for w, g, a, b in zip(self.weights, self.loss_grads(x, mean, near, weight, left, right, y)[1], m, v):
                g = g + decay * w
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)


def _dense(rows: DataFrame, step) -> DataFrame:
    """(id, x) with ``step`` applied to the vectors and means of (id, x, mean)."""

    def run(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "x": list(step(np.stack(batch["x"]), np.stack(batch["mean"])))})

    return rows.select("id", "x", "mean").mapInPandas(run, "id long, x array<double>")


def embedded(nodes: DataFrame, edges: DataFrame, model: Model) -> DataFrame:
    """(id, x): the second layer's vectors of all nodes, over whole neighbourhoods."""
    first = stored(_dense(with_means(nodes, edges), model.first), "layer")
    return _dense(with_means(first, edges), model.second)


def scored(pairs: DataFrame, vectors: DataFrame, model: Model) -> DataFrame:
    """All columns of ``pairs`` (a, b) and the probability of a link."""
    met = pairs.join(vectors.select(F.col("id").alias("a"), F.col("x").alias("_u")), "a").join(vectors.select(F.col("id").alias("b"), F.col("x").alias("_v")), "b")

    @F.pandas_udf("double")
    def probability(u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(model.head(np.stack(u), np.stack(v)) if len(u) else [], dtype="float64")

    return met.withColumn("score", probability("_u", "_v")).drop("_u", "_v")


def sampled(edges: DataFrame, known: DataFrame, most: int = EDGES) -> list[tuple[int, int, int]]:
    """(a, b, 1) of at most ``most`` edges and (a, b, 0) of as many pairs of their ends, dealt anew, that aren't in ``known``."""
    spark = edges.sparkSession
    found = [(r["a"], r["b"]) for r in edges.orderBy(F.xxhash64("a", "b"), "a", "b").limit(most).collect()]
    other = np.random.default_rng(5).permutation(len(found))
    dealt = sorted({(min(a, found[j][1]), max(a, found[j][1])) for (a, _), j in zip(found, other) if a != found[j][1]})
    if not dealt:
        return [(a, b, 1) for a, b in found]
    apart = spark.createDataFrame(dealt, "a long, b long").join(known.select("a", "b"), ["a", "b"], "left_anti").collect()
    return [(a, b, 1) for a, b in found] + sorted((r["a"], r["b"], 0) for r in apart)


def trained(nodes: DataFrame, edges: DataFrame, known: DataFrame, features: int) -> Model:
    """A model fitted on a sample of ``edges`` (a < b), which are also what it may see; ``known``: all edges, for what is none."""
    spark, model = nodes.sparkSession, Model.random(features)
    pairs = sampled(edges, known)
    if len({y for _, _, y in pairs}) < 2:
        return model
    both = stored(both_ways(edges), "both-ways")
    wanted = spark.createDataFrame(sorted({(i,) for a, b, _ in pairs for i in (a, b)}), "a long")
    nth = Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b")
    close = both.join(F.broadcast(wanted), "a", "left_semi").withColumn("n", F.row_number().over(nth)).where(F.col("n") <= NEIGHBOURS).select("a", "b").collect()
    ids = sorted({i for a, b, _ in pairs for i in (a, b)} | {r["b"] for r in close})
    there = spark.createDataFrame([(i,) for i in ids], "id long")
    held = {r["id"]: (r["x"], r["mean"]) for r in with_means(nodes, both).join(F.broadcast(there), "id", "left_semi").collect()}
    row = {i: n for n, i in enumerate(ids)}
    near, weight = np.zeros((len(ids), NEIGHBOURS), np.int64), np.zeros((len(ids), NEIGHBOURS))
    count = np.zeros(len(ids), np.int64)
    # An edge that is asked for isn't shown to the layer that answers: its end is left out of the neighbourhood.
    asked = {(a, b) for a, b, y in pairs if y} | {(b, a) for a, b, y in pairs if y}
    for r in close:
        if (r["a"], r["b"]) not in asked:
            i = row[r["a"]]
            near[i, count[i]] = row[r["b"]]
            count[i] += 1
    for i in range(len(ids)):
        weight[i, : count[i]] = 1 / max(1, count[i])
    x, mean = (np.array([held[i][k] for i in ids]) for k in (0, 1))
    left, right = (np.array([row[p[k]] for p in pairs]) for k in (0, 1))
    model.fit(x, mean, near, weight, left, right, np.array([p[2] for p in pairs], np.float64))
    return model


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def split_by_time(edges: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The earlier edges (a, b, at), about ``share`` of all, and the later ones."""
    cut = edges.agg(F.approx_percentile("at", share, 10_000)).first()[0]
    return edges.where(F.col("at") <= F.lit(cut)), edges.where(F.col("at") > F.lit(cut))


def auc(rows: DataFrame, score: str = "score", label: str = "y") -> float:
    """How often a link scores above what is none; ties count half. From counts by score, so rows are never ranked one by one."""
    by = rows.groupBy(score).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg")).orderBy(score).toPandas()
    pos, neg = by["pos"].to_numpy(float), by["neg"].to_numpy(float)
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / max(1.0, pos.sum() * neg.sum()))


def candidates(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs two steps apart that aren't linked, by walks over at most ``WALKS`` neighbours of each node."""
    both = both_ways(edges)
    some = both.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b"))).where(F.col("n") <= WALKS).select("a", "b")
    two = some.join(some.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").where("a <> c").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
    return two.join(edges.select("a", "b"), ["a", "b"], "left_anti")


def standardised(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(id, x): the columns less their means, by their deviations."""
    stats = nodes.agg(*(F.avg(c).alias("m_" + c) for c in columns), *(F.stddev_pop(c).alias("s_" + c) for c in columns)).first()
    x = [((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(stats["m_" + c] or 0.0)) / F.lit(stats["s_" + c] or 1.0)) for c in columns]
    return nodes.select(F.col("id").cast("long").alias("id"), F.array(*x).alias("x"))


def dealer_graph(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x) of dealers and edges (a, b, at) of those that list a VIN alike, with the time when they first did.

    A vehicle's dealers are linked along the order in which they first listed it, each with the next: as many edges as listings, whatever a VIN's number of dealers. Edges of more vehicles than the
    average edge are kept."""
    listings = stored(listings.select("dealer_id", "vin", "make", "price_gross_eur", "mileage_km", "confidence_score", "indexed_at"), "listings")  # read for nodes and edges
    makes = [F.avg((F.col("make") == m).cast("double")).alias(f"make_{i}") for i, m in enumerate(("BMW", "Audi", "Volkswagen", "Renault", "Peugeot", "Toyota"))]
    node = listings.groupBy(F.col("dealer_id").alias("id")).agg(F.log1p(F.count("*")).alias("volume"), F.avg("price_gross_eur").alias("price"), F.avg("mileage_km").alias("km"), F.avg("confidence_score").alias("trust"), *makes)
    columns = ["volume", "price", "km", "trust", *(f"make_{i}" for i in range(6))]
    nodes = standardised(stored(node, "dealers"), columns)
    # A place in a ring as two features of the dealer, so that nodes alike in all else can be told apart.
    turn = [F.sin(F.col("id") * 2.0 * np.pi / k) for k in (16, 64)] + [F.cos(F.col("id") * 2.0 * np.pi / k) for k in (16, 64)]
    nodes = nodes.select("id", F.concat("x", F.array(*turn)).alias("x"))
    first = listings.groupBy("vin", "dealer_id").agg(F.min("indexed_at").alias("at"))
    before = F.lag("dealer_id").over(Window.partitionBy("vin").orderBy("at", "dealer_id"))
    steps = first.withColumn("before", before).where("before is not null")
    edges = steps.groupBy(F.least("before", "dealer_id").cast("long").alias("a"), F.greatest("before", "dealer_id").cast("long").alias("b")).agg(F.min(F.unix_micros(F.col("at").cast("timestamp"))).alias("at"), F.count("*").alias("n"))
    edges = stored(edges, "shared")
    return nodes, edges.where(F.col("n") > F.lit(edges.agg(F.avg("n")).first()[0] or 0.0)).select("a", "b", "at")


FEATURES = 14


def link_scores(listings: DataFrame, best: int = 3) -> DataFrame:
    """(dealer_id, other, score): of each dealer its ``best`` likeliest new links among those two steps away; the model learns from the earlier edges."""
    nodes, edges = (stored(t, n) for t, n in zip(dealer_graph(listings), ("nodes", "edges")))
    early, _ = split_by_time(edges)
    model = trained(nodes, early, edges, FEATURES)
    vectors = stored(embedded(nodes, both_ways(edges), model), "vectors")
    found = scored(candidates(edges), vectors, model)
    found = found.select(F.col("a").alias("dealer_id"), F.col("b").alias("other"), "score").union(found.select("b", "a", "score"))
    order = Window.partitionBy("dealer_id").orderBy(F.desc("score"), "other")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= best).select("dealer_id", "other", "score")


def held_out_auc(nodes: DataFrame, edges: DataFrame, features: int) -> float:
    """AUC on the later edges of a model that saw the earlier ones."""
    early, late = split_by_time(edges)
    model = trained(nodes, early, edges, features)
    vectors = stored(embedded(nodes, both_ways(early), model), "vectors")
    pairs = nodes.sparkSession.createDataFrame(sampled(late, edges), "a long, b long, y int")
    return auc(scored(pairs, vectors, model))


frame("sco21_link_prediction", ["listing"])(link_scores)

"""Exact top-k search by inner product with two cover trees.

1. A cover tree over a bounded sample of the data (``SAMPLE`` rows) gives centres. Every vector is indexed: it
   goes down the tree to the nearest centre, and each centre keeps the number of its vectors, its covering
   radius and the largest norm. A centre with more than ``SHARD`` vectors is dealt over several shards.
2. A query first goes to the centre with the highest bound. For a vector x near centre c, <q,x> is at most <q,c> + |q| * radius, and
   at most half of |q|**2 + |x|**2 less the square of the least distance that |q - c| and the radius leave.
3. With the k-th score found there it goes to all other centres whose bound reaches it.
4. A task holds one shard and a block of at most about ``BLOCK`` queries that reach it. It builds a cover
   tree over each and walks pairs of nodes from the roots, nearest bound first. For a query node with
   centre q and covering radius s and a data node with centre r and covering radius t no product can exceed
   <q,r> + t|q| + s|r| + st, nor half of both largest squared norms less the squared gap of the balls; the pair is dropped if that is
   below the worst k-th score of the node's queries so far. In a leaf of queries each has bounds of its own. A task sends k candidates for each query; the
   best of these are the result.

Vectors are scaled and floored first, so that products are whole numbers: exact in doubles where
|q| * |x| stays below 2**53, in extended doubles (below 2**63) beyond.

Defined results: vectors that are null or hold a null or non-finite component take no part; vectors of
unlike length count as filled up with zeros; a null vec_id is no query but can be found; ties go to the smaller
vec_id (negative ones included, null last); repeated rows are found each, and queries that share an id are answered together; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import saved, small_batches, table

SCALE = 256
K = 5
#: Data vectors of one shard and queries of one block, about.
SHARD = 16384
BLOCK = 8192
#: Rows (those with the smallest hashes) that the centres of the index are taken from: a bound on the driver's share.
SAMPLE = 16384
LEAF = 48
#: Children of a node, at most.
CHILDREN = 16
#: Data rows multiplied with a query leaf at a time.
COLUMNS = 2048
#: Factor between the radii of a node's and its children's cover.
BASE = 1.4


class CoverTree:
    """Nodes of a cover tree over the rows of ``x``: centre (a row), covering radius, children or rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        if len(x):
            self._node(np.arange(len(x)), 0)
        self.norms = np.sqrt((x[self.centre] ** 2).sum(1)) if len(x) else np.zeros(0)
        own = np.sqrt((x * x).sum(1))
        #: The largest norm below each node; children come after their parents.
        self.most = np.array([0.0 if rows is None else own[rows].max() for rows in self.rows])
        for node in range(len(self.rows) - 1, -1, -1):
            if self.children[node]:
                self.most[node] = self.most[self.children[node]].max()
        self.centres = x[self.centre] if len(x) else x
        self.radii = np.array(self.radius)

    def _add(self, centre: int, radius: float, rows: np.ndarray | None) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append([])
        self.rows.append(rows)
        return len(self.centre) - 1

    def _far(self, own: np.ndarray, centre: int) -> np.ndarray:
        d = self.x[own] - self.x[centre]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _node(self, own: np.ndarray, centre: int) -> None:
        """The tree of rows ``own``, node by node (no recursion, so that depth is no limit).

        A node's centres are chosen farthest first until they cover its rows within ``radius / BASE``, ``CHILDREN`` at most: whenever that
        stops, all rows lie within the last distance of a centre and all centres lie farther apart than it, so every
        node has children, whatever the rows' dimension, and each row goes to the nearest one."""
        todo = [(own, centre, -1)]
        while todo:
            own, centre, parent = todo.pop()
            far = self._far(own, centre)
            radius = float(far.max())
            children: list[tuple[np.ndarray, int]] = []
            if len(own) > self.leaf and radius > 0:
                points, near, reach = [centre], np.zeros(len(own), np.int64), far.copy()
                while len(points) < CHILDREN and reach.max() > radius / BASE:
                    points.append(int(own[np.argmax(reach)]))
                    other = self._far(own, points[-1])
                    near[other < reach] = len(points) - 1
                    reach = np.minimum(reach, other)
                # Groups of few rows are joined, or else a leaf would be a row or two; their radii are measured anew.
                held: list[np.ndarray] = []
                for i, point in enumerate(points):
                    rows = own[near == i]
                    if len(rows) >= self.leaf:
                        children.append((rows, point))
                        continue
                    held.append(rows)
                    if sum(map(len, held)) >= 2 * self.leaf:
                        children.append((np.concatenate(held), int(np.concatenate(held)[0])))
                        held = []
                if sum(map(len, held)):
                    children.append((np.concatenate(held), int(np.concatenate(held)[0])))
            split = len(children) > 1
            node = self._add(centre, radius, None if split else own)
            if parent >= 0:
                self.children[parent].append(node)
            if split:
                todo += [(rows, point, node) for rows, point in children]


def _largest(x: np.ndarray) -> float:
    return float(np.sqrt((x * x).sum(1).max(initial=0)))


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int = K, null: np.ndarray | None = None, least: np.ndarray | None = None, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of queries, row of data, score) of each query's k best rows with another id; ``null`` marks rows without an id, ``least``
    is a score that a query's rows must reach; ``seen`` gets the numbers of nodes, of row pairs and of those that were multiplied."""
    n = len(queries)
    null = np.zeros(len(data), bool) if null is None else null
    # Products of whole numbers are exact while they stay below what the mantissa holds.
    kind = np.float64 if _largest(queries) * _largest(data) < 2.0**52 else np.longdouble
    queries, data = queries.astype(kind), data.astype(kind)
    best = np.full((n, k), -np.inf, kind)
    floor = np.full(n, -np.inf, kind) if least is None else least.astype(kind)
    who = np.full((n, k), -1, np.int64)
    seen = {} if seen is None else seen
    seen["pairs"], seen["multiplied"] = n * len(data), 0
    if not n or not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b = CoverTree(queries), CoverTree(data)
    # Rounding of distances must not drop a pair that ties.
    slack = 1e-9 * (1 + a.norms.max(initial=0) * b.norms.max(initial=0)) + 1e-6
    under = {}
    seen["nodes"] = len(a.centre), len(b.centre)
    worst = lambda own: np.maximum(best[own, -1], floor[own]).min()

    def rows_under(node: int) -> np.ndarray:
        if node not in under:
            out, todo = [], [node]
            while todo:
                i = todo.pop()
                if a.rows[i] is not None:
                    out.append(a.rows[i])
                todo += a.children[i]
            under[node] = np.concatenate(out)
        return under[node]

    square = (b.centres**2).sum(1)

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        product = b.centres[nodes] @ a.centres[q]
        linear = product + b.radii[nodes] * a.norms[q] + a.radii[q] * b.norms[nodes] + a.radii[q] * b.radii[nodes]
        # Twice a product is both squares less the squared distance, which is no less than the balls' gap.
        gap = np.sqrt(np.maximum(0, square[nodes] + a.norms[q] ** 2 - 2 * product)) - a.radii[q] - b.radii[nodes]
        apart = (a.most[q] ** 2 + b.most[nodes] ** 2 - np.maximum(0, gap) ** 2) / 2
        return np.minimum(linear, apart) + slack

    def alone(own: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """For each query by itself and data node what ``bounds`` says of a group."""
        norms = np.sqrt((queries[own] ** 2).sum(1))[:, None]
        product = queries[own] @ b.centres[nodes].T
        gap = np.sqrt(np.maximum(0, square[nodes] + norms**2 - 2 * product)) - b.radii[nodes]
        return np.minimum(product + b.radii[nodes] * norms, (norms**2 + b.most[nodes] ** 2 - np.maximum(0, gap) ** 2) / 2) + slack

    def leaf(q: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(rows), COLUMNS):
            r = rows[at : at + COLUMNS]
            score = queries[q] @ data[r].T
            seen["multiplied"] += score.size
            score[(query_ids[q][:, None] == data_ids[r][None, :]) & ~null[r]] = -np.inf
            # What reaches a query's k-th score so far, old and new, in order of score and id.
            least = np.maximum(np.maximum(best[q, -1], floor[q]), -np.partition(-score, k - 1, 1)[:, k - 1] if len(r) >= k else -np.inf)
            i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            kept = who[q] >= 0
            old_i, old_j = np.nonzero(kept)
            line = np.concatenate([old_i, i])
            value = np.concatenate([best[q][kept], score[i, j]])
            row = np.concatenate([who[q][kept], r[j]])
            order = np.lexsort((data_ids[row], null[row], -value, line))
            line, value, row = line[order], value[order], row[order]
            place = np.arange(len(line)) - np.searchsorted(line, line)
            top = place < k
            best[q[line[top]], place[top]] = value[top]
            who[q[line[top]], place[top]] = row[top]

    todo = [(0, np.array([0]))]
    while todo:
        q, nodes = todo.pop()
        own = rows_under(q)
        high = bounds(q, nodes)
        order = np.argsort(-high)
        nodes, high = nodes[order], high[order]
        nodes = nodes[high >= worst(own)]
        if a.children[q]:
            # Open the widest data nodes with the query node, then give what is left to its children.
            wide = [i for i in nodes if b.children[i] and b.radii[i] > a.radii[q]]
            rest = [i for i in nodes if not (b.children[i] and b.radii[i] > a.radii[q])]
            opened = np.array(rest + [c for i in wide for c in b.children[i]], np.int64)
            todo += [(c, opened) for c in a.children[q]]
            continue
        # A leaf of queries. Data nodes are opened down to leaves that the group can reach; then each query has its own bounds: first all
        # go to their best leaf, then leaf by leaf those whose worst k-th score doesn't lie above their bound.
        reached, waiting = [], nodes.tolist()
        while waiting:
            flat = [i for i in waiting if b.rows[i] is not None]
            below = np.array([c for i in waiting for c in b.children[i]], np.int64)
            reached += flat
            waiting = below[bounds(q, below) >= worst(own)].tolist() if len(below) else []
        if not reached:
            continue
        high = alone(own, np.array(reached))
        first = high.argmax(1)
        for i in np.unique(first):
            leaf(own[first == i], b.rows[reached[i]])
        for i in np.argsort(-high.max(0)):
            going = (high[:, i] >= np.maximum(best[own, -1], floor[own])) & (first != i)
            if going.any():
                leaf(own[going], b.rows[reached[i]])
    q, j = np.nonzero(who >= 0)
    return q, who[q, j], best[q, j]


def usable(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that take part, scaled and floored."""
    x = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)), F.lit(False))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * float(scale)).cast("double")).alias("v")).where(fine)


def _matrix(column, width: int = 0) -> np.ndarray:
    """Vectors as rows, filled up with zeros to ``width`` or the longest one."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _pair(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(left.shape[1], right.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (left, right))


class Index:
    """Centres of the shards: a cover tree over a sample, whose leaves' centres attract the vectors."""

    def __init__(self, sample: pa.Table, n: int):
        self.x = _matrix(sample.column("v"))
        # A leaf of the sample stands for about half a shard of the data, or for a few rows of the sample at least.
        tree = CoverTree(self.x, max(8, SHARD // 2 * len(self.x) // max(1, n)))
        self.children = tree.children
        self.nodes = tree.centres
        leaves = [i for i, rows in enumerate(tree.rows) if rows is not None]
        self.leaf_of = {node: i for i, node in enumerate(leaves)}
        self.centres = self.nodes[leaves]
        self.x = np.zeros((0, self.x.shape[1]))
        self.radius = self.norm = self.shards = np.zeros(0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distance to its centre) of each row, down the tree by the nearest child."""
        x, nodes = _pair(x, self.nodes)
        leaf, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node in self.leaf_of:
                leaf[own] = self.leaf_of[node]
                d = x[own] - nodes[node]
                far[own] = np.sqrt(np.einsum("ij,ij->i", d, d))
                continue
            below = np.array(self.children[node])
            near = np.argmin((nodes[below] ** 2).sum(1) - 2 * (x[own] @ nodes[below].T), 1)
            todo += [(int(c), own[near == i]) for i, c in enumerate(below) if (near == i).any()]
        return leaf, far

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and leaf: no row of the leaf scores higher; minus infinity where it has none."""
        q, c = _pair(q, self.centres)
        norms, square = np.sqrt((q * q).sum(1))[:, None], (c * c).sum(1)
        product = q @ c.T
        gap = np.sqrt(np.maximum(0, norms**2 + square - 2 * product)) - self.radius
        high = np.minimum(product + norms * self.radius, (norms**2 + self.norm**2 - np.maximum(0, gap) ** 2) / 2)
        slack = 1e-9 * (1 + norms * (self.norm + self.radius) + norms**2 + self.norm**2) + 1e-6
        return np.where(self.shards > 0, high + slack, -np.inf)


#: Rows multiplied with the centres at a time.
_STEP = 1024


def index_of(data: DataFrame) -> tuple[Index, DataFrame]:
    """The index of (vec_id, v) rows, stored, and the rows with ``leaf`` and a running number ``nth``, stored."""
    n = data.count()
    index = Index(data.orderBy(F.xxhash64("vec_id", "v"), "vec_id").select("v").limit(SAMPLE).toArrow(), n)

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            if not len(x):
                continue
            leaf, far = index.nearest(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf), pa.array(far), pa.array(np.sqrt((x * x).sum(1)))], names=["vec_id", "v", "leaf", "far", "norm"])

    small_batches(data.sparkSession, 4096)
    placed = saved(data.mapInArrow(assign, "vec_id long, v array<double>, leaf long, far double, norm double").withColumn("nth", F.monotonically_increasing_id()), "index")
    # A row for each centre, of which there are fewer than rows in the sample.
    found = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()
    size = len(index.centres)
    index.radius, index.norm, index.shards = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
    for r in found:
        index.radius[r["leaf"]], index.norm[r["leaf"]], index.shards[r["leaf"]] = r["far"], r["norm"], -(-r["n"] // SHARD)
    return index, placed


def routed(queries: DataFrame, index: Index) -> DataFrame:
    """(vec_id, v, least, leaves): all queries (vec_id, v, least, been) with the leaves that could hold a row of a score of ``least`` or more,
    without the leaf ``been``; where ``least`` is null, with the one leaf of the highest bound."""

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                high = index.bounds(_matrix(part.column("v")))
                first = np.asarray(part.column("least").is_null())
                least = part.column("least").fill_null(0).to_numpy().astype(np.float64)
                been = part.column("been").fill_null(-1).to_numpy()
                hit = (high > -np.inf) & ((high >= least[:, None]) | first[:, None]) & (been[:, None] != np.arange(high.shape[1]))
                hit[first] &= (np.arange(high.shape[1]) == high.argmax(1)[:, None])[first]
                offsets = np.concatenate([[0], np.cumsum(hit.sum(1))])
                leaves = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.nonzero(hit)[1], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), part.column("least"), leaves], names=["vec_id", "v", "least", "leaves"])

    return queries.select("vec_id", "v", "least", "been").mapInArrow(route, "vec_id long, v array<double>, least long, leaves array<long>")


def _met(asked: DataFrame, placed: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each shard that a query is routed to, its k best rows there."""
    wanted = asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()  # at most a row for each centre
    plan = asked.sparkSession.createDataFrame([(int(r["leaf"]), int(index.shards[r["leaf"]]), int(-(-r["count"] // BLOCK))) for r in wanted], "leaf long, shards long, blocks long")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # A vector goes to each block of the queries that reach its leaf, a query to each shard of the leaves it reaches.
    d = placed.join(F.broadcast(plan), "leaf").select("vec_id", "v", "leaf", F.expr("pmod(nth, shards)").alias("shard"), upto("blocks").alias("block"))
    q = asked.select("vec_id", "v", "least", F.explode("leaves").alias("leaf")).join(F.broadcast(plan), "leaf")
    q = q.select("vec_id", "v", "least", "leaf", F.expr("pmod(xxhash64(vec_id), blocks)").alias("block"), upto("shards").alias("shard"))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = _pair(_matrix(left.column("v")), _matrix(right.column("v")))
        qid = left.column("vec_id").to_numpy()
        null = np.asarray(right.column("vec_id").is_null())
        rid = right.column("vec_id").fill_null(0).to_numpy()
        least = np.where(np.asarray(left.column("least").is_null()), -np.inf, left.column("least").fill_null(0).to_numpy().astype(np.longdouble))
        a, b, score = search(x, qid, y, rid, k, null, least)
        ids = right.column("vec_id").combine_chunks().take(pa.array(b))
        return pa.table({"query_id": pa.array(qid[a], pa.int64()), "vec_id": ids, "score": pa.array(score.astype(np.int64), pa.int64())})

    return q.groupBy("leaf", "shard", "block").cogroup(d.groupBy("leaf", "shard", "block")).applyInArrow(pair, "query_id long, vec_id long, score long")


def top_k(queries: DataFrame, data: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (vec_id, v) against all of data (vec_id, v), both stored."""
    index, placed = index_of(data)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    none = F.lit(None).cast("long")
    asked = queries.where("vec_id is not null")
    home = saved(routed(asked.withColumns({"least": none, "been": none}), index), "home")
    first = saved(ranked(_met(home, placed, index, k)).drop("rank"), "first")
    # The k-th score found so far; what stays below it can't be among the k best.
    least = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(-(2**62)).alias("least"))
    left = home.select("vec_id", "v", F.element_at("leaves", 1).alias("been")).join(least, F.col("vec_id") == F.col("query_id"), "left")
    # A query without any row so far still goes everywhere.
    left = left.select("vec_id", "v", F.coalesce("least", F.lit(-(2**62))).alias("least"), "been")
    rest = saved(routed(left, index), "routes")
    return ranked(first.unionByName(_met(rest, placed, index, k))).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = saved(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(data.where("vec_id % 50 = 0"), data)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score FROM v q, v d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""

"""SimHash near-duplicates: fingerprints linked through vantage-point trees, components by star contraction.

``fingerprints``: 64-bit SimHash of the word shingles of each whole text.
``linked``: different fingerprints are dealt to shards by a vantage-point tree. A node puts the
fingerprints within its radius of the vantage point inside and the others outside; those outside by
no more than the link distance also go inside (triangle bound), so that every link lies in at least
one shard. Inside a shard the tree goes on down to small leaves, which grow components by exact distances. A
shard gives at most one row for each fingerprint that has a link, never all pairs. Small tables of such rows are then contracted across shards.

Defined results: a null, empty or blank text has fingerprint zero and is linked as any other; repeated
rows and equal texts share a fingerprint; an empty table gives no rows; extra columns are ignored. A very
long text is held as bytes, its words span by span.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op8_toxicity import _bytes
from .store import dropped, saved, small_batches, table
from .tokens import chunks

SHINGLE = 3
DISTANCE = 2
#: Different fingerprints sampled (those with the smallest hashes) to place vantage points: a bound on the driver's share.
SAMPLE = 8192
#: Fingerprints that a shard should hold. Deeper levels than the sample can place use vantage points made from the path.
SHARD = 100_000
#: Fingerprints of a leaf of the tree inside a shard.
LEAF = 512

#: Bytes of text whose words are held at a time.
SPAN = 1_000_000
#: Shingles of a text hashed at a time.
PART = 16_384
#: A-Z to lower case, ASCII white space to blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def shingle_hashes(raw: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles of one text (UTF-8), repeats included; of the whole sequence, where there are fewer words.
    Words are cut out span by span."""
    raw = raw.translate(_FOLD)
    words, at, some, hash_ = [], 0, False, xxhash.xxh64_intdigest
    while at < len(raw):
        cut = raw.find(b" ", at + SPAN)
        cut = len(raw) if cut < 0 else cut
        # The last words of a span begin the shingles of the next one.
        kept = words[max(0, len(words) - shingle + 1) :]
        words = raw[at:cut].split()
        if kept:
            words = kept + words
        at = cut
        if len(words) < shingle:
            continue
        some = True
        line = memoryview(b" ".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        ends = ends[shingle - 1 :].tolist()
        for i in range(0, len(ends), PART):
            yield np.fromiter([hash_(line[a:b], 42) for a, b in zip(starts[i : i + PART], ends[i : i + PART])], np.uint64)
    if words and not some:
        yield np.array([hash_(b" ".join(words), 42)], np.uint64)


def text_fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text."""
    return sim_hash(shingle_hashes(raw, shingle))


def sim_hash(parts: Iterable[np.ndarray]) -> int:
    """SimHash of shingles' hashes: a bit is 1 if set in over half of them; zero of none."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        n += len(hashes)
        # Most significant byte first, so that bit 63 comes first.
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bit pattern as a signed long."""
    small_batches(docs.sparkSession)

    def hashed(batches):
        for batch in chunks(batches):
            data, bounds = _bytes(batch.column("text"))
            prints = [text_fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, "doc_id long, fp long")


# ---------------------------------------------------------------- vantage-point tree


def _mixed(x: int) -> int:
    """A 64-bit mix of a path number (a vantage point where there is no sample)."""
    return xxhash.xxh64_intdigest(x.to_bytes(16, "little"), 7)


def _median(distances: np.ndarray, distance: int) -> int:
    """Radius for which the larger of inside (with its margin) and outside is smallest."""
    upto = np.cumsum(np.bincount(distances, minlength=65 + distance))
    radius = np.arange(64)
    return int(np.argmin(np.maximum(upto[radius + distance], upto[-1] - upto[radius])))


def build_tree(sample: np.ndarray, levels: int, distance: int = DISTANCE) -> dict[int, tuple[int, int]]:
    """(vantage point, radius) of the nodes that the sample can place; node k has children 2k (inside) and 2k+1."""
    tree: dict[int, tuple[int, int]] = {}
    todo = [(1, sample.astype(np.uint64))]
    while todo:
        node, own = todo.pop()
        if len(own) < 32 or node.bit_length() > levels:
            continue
        best = None
        for i in range(4):  # of a few vantage points, the one with the most even halves
            point = int(own[_mixed(node * 4 + i) % len(own)])
            far = np.bitwise_count(own ^ np.uint64(point)).astype(np.int64)
            radius = _median(far, distance)
            uneven = max(int((far <= radius + distance).sum()), int((far > radius).sum()))
            if best is None or uneven < best[0]:
                best = (uneven, point, radius, far)
        _, point, radius, far = best
        tree[node] = (point, radius)
        todo += [(2 * node, own[far <= radius]), (2 * node + 1, own[far > radius])]
    return tree


def shards_of(prints: np.ndarray, tree: dict[int, tuple[int, int]], levels: int, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``prints`` and the shard (leaf) of each of their places."""
    places, leaves = [], []
    todo = [(1, np.arange(len(prints)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node.bit_length() > levels:
            places.append(own)
            leaves.append(np.full(len(own), node, np.int64))
            continue
        point, radius = tree.get(node) or (_mixed(node), 31)
        far = np.bitwise_count(prints[own] ^ np.uint64(point))
        todo += [(2 * node, own[far <= radius + distance]), (2 * node + 1, own[far > radius])]
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(leaves)


def _join(parent: np.ndarray, a: int, b: int) -> bool:
    """Unites the components of two; whether they were different ones."""
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    while parent[b] != b:
        parent[b] = parent[parent[b]]
        b = parent[b]
    if a != b:
        parent[max(a, b)] = min(a, b)
    return a != b


def _grow(own: np.ndarray, prints: np.ndarray, parent: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Components among prints[own] by comparing each one once with those not reached yet; the links that united them."""
    links = []
    left = own
    while len(left):
        front, left = deque([left[0]]), left[1:]
        while front and len(left):
            i = front.popleft()  # the nearest first: chains of links stay short
            near = np.bitwise_count(prints[left] ^ prints[i]) <= distance
            if near.any():
                found = left[near]
                links += [(int(i), k) for k in found.tolist() if _join(parent, int(i), k)]
                front.extend(found.tolist())
                left = left[~near]
    return links


def _searched(prints: np.ndarray, distance: int, leaf: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Parents in the components of the sorted ``prints``, and the links that united them. A vantage-point tree as that which deals
    to shards goes on down to leaves; branches farther from each other than the link distance never meet. What no radius divides (a
    dense ball, where links are many and groups grow fast) is a leaf as well."""
    parent, links = np.arange(len(prints)), []
    todo = [np.arange(len(prints))]
    while todo:
        own = todo.pop()
        if len(own) > leaf:
            far = np.bitwise_count(prints[own] ^ prints[own[len(own) // 2]]).astype(np.int64)
            radius = _median(far, distance)
            inside, outside = own[far <= radius + distance], own[far > radius]
            if max(len(inside), len(outside)) <= 0.8 * len(own):
                todo += [inside, outside]
                continue
        links += _grow(own, prints, parent, distance)
    return parent, links


def shard_links(prints: np.ndarray, distance: int = DISTANCE, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for each of the different ``prints`` that is linked to another one here, but the roots."""
    prints = np.sort(prints.astype(np.uint64))
    root, _ = _searched(prints, distance, leaf)
    while (root != (up := root[root])).any():
        root = up
    member = np.flatnonzero(root != np.arange(len(root)))
    return prints[member], prints[root[member]]


def shard_pairs(prints: np.ndarray, distance: int = DISTANCE, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the different ``prints`` that lie within the distance of each other and chain all that are linked here: at most one
    for each of them."""
    prints = np.sort(prints.astype(np.uint64))
    _, links = _searched(prints, distance, leaf)
    ends = np.array(links, np.int64).reshape(-1, 2)
    return prints[ends[:, 0]], prints[ends[:, 1]]


# ---------------------------------------------------------------- components


def components(edges: DataFrame, done_rows: int = 0) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b): the smallest node that each reaches, by alternating large and
    small stars. Each round writes the edges to the shared folder."""
    now = saved(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: what is larger than a node is tied to the least of its neighbours and itself.
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = saved(large, "edges")
        # Small star: a node and its smaller neighbours are tied to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        small = saved(small.where("a <> b").distinct(), "edges")
        state = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        dropped(large)
        dropped(now)
        now = small
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state


def _in_shards(prints: DataFrame, distance: int, links: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b): what ``links`` finds in each shard of the fingerprints (column ``fp``, all different, stored)."""
    n = prints.count()
    levels = max(0, int(np.ceil(np.log2(max(1, n / SHARD)))))
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect() if levels else []
    tree = build_tree(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), levels, distance)

    def deal(batches):
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            places, leaves = shards_of(own, tree, levels, distance)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(leaves, pa.int64()), "fp": pa.array(own[places].view(np.int64), pa.int64())})

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        a, b = links(shard["fp"].to_numpy(np.int64).view(np.uint64), distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return prints.mapInArrow(deal, "shard long, fp long").groupBy("shard").applyInPandas(search, "a long, b long")


def linked(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) of all fingerprints (column ``fp``, all different, stored) that have a link within ``distance``."""
    edges = _in_shards(prints, distance, shard_links)
    # Roots are the smallest fingerprints of their shard as unsigned numbers; contraction needs any one order.
    return components(edges).select(F.col("node").alias("fp"), F.col("root"))


def linked_pairs(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): different pairs of fingerprints (column ``fp``, all different, stored) within ``distance`` of each other, which chain all
    that ``linked`` links; for who checks each of them afterwards."""
    found = _in_shards(prints, distance, shard_pairs)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``: the smallest doc_id reachable through links."""
    own = saved(fingerprints(docs, shingle), "prints")
    classes = saved(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = saved(linked(classes.select("fp"), distance), "roots")
    firsts = roots.join(classes, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = classes.join(roots.join(firsts, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return own.join(saved(of_class, "components"), "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", spread=True))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

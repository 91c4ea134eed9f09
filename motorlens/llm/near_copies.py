"""Near copies: SimHash links that hold by exact Jaccard similarity of five-word shingle sets, and every other pair that reaches it.

Texts of equal sets form one class. First, operator 5: SimHashes of the classes' shingles are linked through vantage-point trees,
each link is checked against the whole sets (a similarity of 4/5 or more), and star contraction joins classes by those that hold. A
SimHash tells close copies only, so an exact filter compares what these links left apart. Two sets of similarity 4/5 or more share
one of their first ``n - ceil(4n/5) + 1`` shingles in any one order of all shingles (prefix filter), so classes meet at shared prefix
shingles; sizes, places in the prefix and counts by ranges of hashes rule out more pairs (none that are near), and the rest is
compared whole. The order puts shingles of common hash buckets last, which only saves work. Two rounds keep large groups from pairing
all with all. First, each shingle's classes are compared with one of them, its centre: that which holds the fewest rarer shingles, in
a group of near copies the least changed one, so nearly all of a group are joined through few. Then only classes that no chain of
links joins yet are compared; a common shingle's classes are split over cells.

Defined results: words are told apart and lowered as by op5_simhash; a text of at most five words is one shingle; null, empty
and blank texts are equal; sets are told apart by 64-bit hashes. Ties for a centre go to the smaller hash and change no result; repeated rows
are one class; an empty table gives no rows; extra columns are ignored; a very long text's words are cut out span by span, and its
different shingles are held whole (8 bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op5_simhash import PART, components, linked_pairs, shingle_hashes, sim_hash
from .op8_toxicity import _bytes
from .store import dropped, saved, small_batches
from .tokens import chunks

WORDS = 5
#: Hash buckets whose shingles are counted for the order, and the parts in which the counts travel.
BUCKETS, PARTS = 1 << 22, 64
#: Ranges of shingles that are counted for each set: what two sets can have in common at most, range by range.
RANGES_BITS = 8
#: Rows that are searched for pairs at once (the rows of a cell stay together), and rows of a shingle from which it is split over cells.
BLOCK, CELL = 1 << 17, 4096
#: Binary logarithm of the shingles of a bucket beyond which the rows of its shingles are split over tasks.
SPLIT = 20


def shingle_set(raw: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted different hashes of the shingles of one text (UTF-8)."""
    parts = list(shingle_hashes(raw, size))
    if len(parts) > 1:
        parts = [np.concatenate([np.unique(p) for p in parts])]
    return np.unique(parts[0]) if parts else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    data, bounds = _bytes(texts)
    return (shingle_set(data[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:]))


def set_id(own: np.ndarray) -> int:
    """The hash of a whole set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42) if len(own) else 0).astype(np.int64))


def class_print(own: np.ndarray) -> int:
    """SimHash of the different shingles of a text, part by part."""
    return sim_hash(own[i : i + PART] for i in range(0, len(own), PART))


def prefix(own: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first shingles in order (rarer buckets first): a set of similarity 4/5 has one of them among its own first ones."""
    ordered = own[np.lexsort((own, levels[own % np.uint64(len(levels))]))]
    return ordered[: len(own) - -(-4 * len(own) // 5) + 1] if len(own) else ordered


def range_counts(own: np.ndarray) -> bytes:
    """How many shingles lie in each range of hashes: a byte each, or four where one holds over 255."""
    counts = np.bincount((own >> np.uint64(64 - RANGES_BITS)).astype(np.int64), minlength=1 << RANGES_BITS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.int32).tobytes()


def ranges_of(packed: list[bytes]) -> np.ndarray:
    """Rows of counts by range."""
    if all(len(p) == 1 << RANGES_BITS for p in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    return np.stack([np.frombuffer(p, np.uint8 if len(p) == 1 << RANGES_BITS else np.int32).astype(np.int32) for p in packed])


def bucket_levels(docs: DataFrame) -> np.ndarray:
    """For each hash bucket the binary logarithm of the number of its shingles in all texts."""

    def counted(batches):
        total = np.zeros(BUCKETS, np.int32)
        for batch in chunks(batches):
            for own in shingle_sets(batch.column("text")):
                np.add.at(total, (own % np.uint64(BUCKETS)).astype(np.int64), 1)
        total = np.minimum(total, 255).astype(np.uint8)  # of one task; the order needs no exact counts
        if total.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "counts": pa.array([p.tobytes() for p in np.split(total, PARTS)], pa.binary())})

    def summed(batches):
        # One block of counts for each part that this task is dealt, however many tasks have counted.
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, block in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(block, np.uint8).astype(np.int32)
        if total:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "counts": pa.array([t.tobytes() for t in total.values()], pa.binary())})

    parts = docs.select("text").mapInArrow(counted, "part int, counts binary").repartition(PARTS, "part").mapInArrow(summed, "part int, counts binary")
    total = np.zeros(BUCKETS, np.int32)
    for r in parts.collect():
        np.split(total, PARTS)[r["part"]][:] = np.frombuffer(r["counts"], np.int32)
    return np.ceil(np.log2(total + np.float32(1))).astype(np.uint8)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by cell, regrouped so that a cell's rows stay together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        cell = whole.column("cell").to_numpy()
        cut = int(np.searchsorted(cell, cell[-1]))
        if cut:
            yield whole.slice(0, cut).to_pandas()
        held, size = whole.slice(cut).to_batches(), 0 if cut else -whole.num_rows  # a longer run is looked at again when it has doubled
    if held:
        yield pa.Table.from_batches(held).to_pandas()


def _possible(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes, first meeting at these places, can still reach 4/5: 4/9 of both sizes in common."""
    rest = 1 + np.minimum(n[i] - at[i] - 1, n[j] - at[j] - 1)
    return (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (9 * rest >= 4 * (n[i] + n[j]))


def _may_meet(n, at, n_other, at_other) -> F.Column:
    """``_possible`` as an expression."""
    rest = F.least(n - at, n_other - at_other)
    return (5 * F.least(n, n_other) >= 4 * F.greatest(n, n_other)) & (9 * rest >= 4 * (n + n_other))


def block_pairs(block: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of pairs of classes that share a token and lie in different components (``comp``) and, in a cell of two ``side``s, on both. Rows
    are sorted by cell and n."""
    cell, side, whole = block["cell"].to_numpy(), block["side"].to_numpy(), block["whole"].to_numpy()
    n, at, comp = block["n"].to_numpy(np.int64), block["at"].to_numpy(np.int64), block["comp"].to_numpy()
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    length = np.diff(np.concatenate([start, [len(cell)]]))
    last = np.repeat(start + length, length)
    i = np.flatnonzero(np.repeat(length > 1, length))
    lag = 1
    while len(i):
        i = i[i + lag < last[i]]
        i = i[5 * n[i] >= 4 * n[i + lag]]  # later ones of the cell are no smaller
        j = i + lag
        keep = (comp[i] != comp[j]) & (whole[i] | (side[i] != side[j])) & _possible(n, at, i, j)
        if keep.any():
            yield i[keep], j[keep]
        lag += 1


def least_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of rows (counts by range): whether they can have 4/9 of both sizes in common."""
    return 9 * np.minimum(x, y).sum(1, dtype=np.int64) >= 4 * (x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64))


def starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, part, at and set_id, each with the first row of its token and part, its ``centre``; without those that are alone."""
    names = ("token", "part", "at", "set_id", "n")
    waiting, centre = None, None  # a row that began a run and may be alone; the first row of the run that the batch before ended in
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in names]
        if waiting is not None:
            rows = [np.concatenate([w, r]) for w, r in zip(waiting, rows)]
            waiting = None
        if not len(rows[0]):
            continue
        token, part = rows[:2]
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])])
        start = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        first = [r[start] for r in rows]
        if centre is not None and (centre[0], centre[1]) == (token[0], part[0]):
            for f, c in zip(first, centre):
                f[start == 0] = c
            fresh[0] = False
        centre = [f[-1] for f in first]
        alone = fresh & np.concatenate([fresh[1:], [False]]) & (part < 0)  # a part of a split token is kept as a whole
        if fresh[-1] and part[-1] < 0:
            waiting, alone[-1], centre = [r[-1:] for r in rows], True, None
        kept = [r[~alone] for r in (rows[0], rows[2], rows[3], rows[4], first[2], first[3], first[4])]
        yield pa.RecordBatch.from_arrays([pa.array(k) for k in kept], names=["token", "at", "set_id", "n", "c_at", "c_set", "c_n"])


def alike(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of classes that chain all whose SimHashes are equal or linked by operator 5."""
    firsts = saved(classes.groupBy("fp").agg(F.min("set_id").alias("first_set")), "prints")
    same = classes.select("fp", "set_id").join(firsts, "fp").where("set_id <> first_set").select(F.col("first_set").alias("a"), F.col("set_id").alias("b"))
    end = lambda side: firsts.select(F.col("fp").alias(side), F.col("first_set").alias(f"{side}_set"))
    other = linked_pairs(firsts.select("fp")).join(end("a"), "a").join(end("b"), "b")
    return same.union(other.select(F.least("a_set", "b_set").alias("a"), F.greatest("a_set", "b_set").alias("b")))


def still_apart(pairs: DataFrame, of_class: DataFrame) -> DataFrame:
    """The pairs whose classes lie in different components (``of_class``: set_id, __root of those that have links)."""
    root = lambda side: of_class.select(F.col("set_id").alias(side), F.col("__root").alias(f"__{side}"))
    both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return both.where(F.coalesce("__a", "a") != F.coalesce("__b", "b")).select("a", "b")


def stars(shared: DataFrame) -> DataFrame:
    """(a, b), a < b: each token's classes with its centre, where they may be near."""
    own = shared.where((F.col("set_id") != F.col("c_set")) & _may_meet(F.col("n"), F.col("at"), F.col("c_n"), F.col("c_at")))
    return own.select(F.least("set_id", "c_set").alias("a"), F.greatest("set_id", "c_set").alias("b")).distinct()


def between(apart: DataFrame) -> DataFrame:
    """(a, b), a < b: different pairs of classes of different components that share a token and may be near.
    A token's rows are dealt to cells of at most about twice ``CELL`` rows: each two of its parts meet in one."""

    def search(batches):
        for block in _blocks(batches, BLOCK):
            own, held, size = block["set_id"].to_numpy(), [], 0
            for i, j in block_pairs(block):
                a, b = own[i], own[j]
                held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
                size += len(a)
                if size > BLOCK:
                    held = [np.unique(np.concatenate(held), axis=0)]
                    size = len(held[0])
                    if size > BLOCK // 2:
                        yield _rows(held[0])
                        held, size = [], 0
            if size:
                yield _rows(np.unique(np.concatenate(held), axis=0))

    many = apart.groupBy("token").agg(F.count("*").alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", F.ceil(F.col("k") / CELL).alias("parts"))
    rows = apart.join(many, "token").withColumn("side", F.expr("pmod(xxhash64(set_id), parts)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    rows = rows.withColumn("cell", F.xxhash64("token", F.least("side", "other"), F.greatest("side", "other"))).withColumn("whole", F.col("parts") == 1)
    # Of a cell of one part with itself all pairs count.
    rows = rows.withColumn("whole", F.col("whole") | (F.col("side") == F.col("other")))
    dealt = rows.select("cell", "side", "whole", "set_id", "n", "at", "comp").repartition("cell").sortWithinPartitions("cell", "n", "set_id")
    return dealt.mapInArrow(search, "a long, b long").distinct()


def _rows(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(np.ascontiguousarray(pairs[:, 0])), "b": pa.array(np.ascontiguousarray(pairs[:, 1]))})


def within_counts(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose ranges can have 4/9 of both sizes in common; no pair of similarity 4/5 is lost."""

    def bounded(batches):
        for batch in batches:
            x, y = (ranges_of(batch.column(c).to_pylist()) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array(least_common(x, y), pa.bool_()))

    both = pairs.join(classes.select(F.col("set_id").alias("a"), F.col("ranges").alias("x")), "a").join(classes.select(F.col("set_id").alias("b"), F.col("ranges").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(bounded, "a long, b long")


def near(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose whole sets have a similarity of 4/5 or more, stored."""

    def sets(batches):
        for batch in chunks(batches):
            own = list(shingle_sets(batch.column("text")))
            yield pa.RecordBatch.from_pydict({"set_id": pa.array([set_id(s) for s in own], pa.int64()), "own": pa.array([s.tobytes() for s in own], pa.binary())})

    def compared(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(5 * common >= 4 * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    needed = saved(classes.join(ends, "set_id", "left_semi").select("set_id", "first_id"), "needed")
    firsts = needed.select(F.col("first_id").alias("__id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), "text").join(firsts, F.col("__doc").eqNullSafe(F.col("__id")), "left_semi").select("text")
    whole = texts.mapInArrow(sets, "set_id long, own binary").join(needed.select("set_id"), "set_id", "left_semi")
    whole = saved(whole.groupBy("set_id").agg(F.first("own").alias("own")), "sets")
    both = pairs.join(whole.select(F.col("set_id").alias("a"), F.col("own").alias("x")), "a").join(whole.select(F.col("set_id").alias("b"), F.col("own").alias("y")), "b")
    found = saved(both.select("a", "b", "x", "y").mapInArrow(compared, "a long, b long"), "links")
    dropped(needed)
    dropped(whole)
    return found


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(set_id, first_id, group) for each class of texts with equal sets: its smallest doc_id (null if none has one), and the
    group of classes that links join, directly or by a chain."""
    small_batches(docs.sparkSession)
    levels = bucket_levels(docs)

    def described(batches):
        for batch in chunks(batches):
            own = list(shingle_sets(batch.column("text")))
            columns = {"set_id": pa.array([set_id(s) for s in own], pa.int64()), "n": pa.array([len(s) for s in own], pa.int32()), "prefix": pa.array([prefix(s, levels).tobytes() for s in own], pa.binary()), "ranges": pa.array([range_counts(s) for s in own], pa.binary()), "fp": pa.array(np.array([class_print(s) for s in own], np.uint64).view(np.int64), pa.int64())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **columns})

    def posted(batches):
        for batch in batches:
            own = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
            times = np.array([len(p) for p in own], np.int64)
            if times.sum():
                at = np.concatenate([np.arange(t, dtype=np.int32) for t in times])
                token = np.concatenate(own)
                columns = {c: np.repeat(batch.column(c).to_numpy(), times) for c in ("set_id", "n")}
                # A token of a bucket with over 2**SPLIT shingles is dealt to parts of about so many rows.
                bits = np.maximum(levels[token.view(np.uint64) % np.uint64(BUCKETS)].astype(np.int64) - SPLIT, 0)
                part = np.where(bits > 0, columns["set_id"] & ((1 << bits) - 1), -1)
                yield pa.RecordBatch.from_pydict({"token": pa.array(token), "part": pa.array(part), "at": pa.array(at), **{c: pa.array(v) for c, v in columns.items()}})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(described, "doc_id long, set_id long, n int, prefix binary, ranges binary, fp long")
    classes = saved(rows.groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("ranges").alias("ranges"), F.first("fp").alias("fp")), "classes")
    close = saved(within_counts(alike(classes), classes), "close")
    chained = saved(components(near(close, classes, docs)), "chained")
    postings = classes.select("set_id", "n", "prefix").mapInArrow(posted, "token long, part long, at int, set_id long, n int")
    # The centre of a token: the class with the fewest rarer shingles, which in a group of near copies is the least changed one.
    dealt = postings.repartition("token", "part").sortWithinPartitions("token", "part", "at", "set_id")
    shared = saved(dealt.mapInArrow(starred, "token long, at int, set_id long, n int, c_at int, c_set long, c_n int"), "shared")
    of_class = lambda found: found.select(F.col("node").alias("set_id"), F.col("root").alias("__root"))
    tried = saved(within_counts(still_apart(stars(shared), of_class(chained)).join(close, ["a", "b"], "left_anti"), classes), "tried")
    # Components so far go on as stars, which contract in few rounds.
    star = lambda found: found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    joined = saved(components(star(chained).union(near(tried, classes, docs))), "joined")
    apart = shared.select("token", "at", "set_id", "n").join(of_class(joined), "set_id", "left").withColumn("comp", F.coalesce("__root", "set_id"))
    apart = apart.select("token", "at", "set_id", "n", "comp")
    more = saved(within_counts(between(apart).join(close.union(tried), ["a", "b"], "left_anti"), classes), "more")
    whole = saved(components(star(joined).union(near(more, classes, docs))), "joined")
    for used in (shared, close, tried, more, chained, joined):
        dropped(used)
    return classes.select("set_id", "first_id").join(of_class(whole), "set_id", "left").select("set_id", "first_id", F.coalesce("__root", "set_id").alias("group"))

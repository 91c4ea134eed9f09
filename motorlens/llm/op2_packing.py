"""Best-fit packing by exact-complement hashing.

The plan depends on the histogram of piece lengths alone, which has at most ``capacity`` entries, so
it is made on the driver whatever the number of documents. The sums of one, two and three lengths are
indexed once; each step looks a gap up and takes the combination found as often as its scarcest length
allows. What has no exact complement is packed by best fit. Pieces then find their sequence from their
rank among the pieces of their length.

Defined results: a null or empty text is one piece that holds the end id; repeated rows are packed
each; an empty table gives no rows; extra columns are ignored. A very long text is encoded at once, in
memory in proportion to it, and cut into pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import saved, small_batches, table
from .tokens import chunks, encoder, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0


class Sums:
    """Index of the sums of one, two and three of the lengths that occur, hashed by the sum, under counts of what is left.

    Counts only fall while a plan is made, so a combination that can't be had now is never had again: each sum keeps the
    place in its list up to which combinations are used up, and all lists together are gone through once."""

    def __init__(self, free: list[int]):
        self.free = free
        most = len(free) - 1
        have = np.array(free) > 0
        #: For each sum the larger length of its pairs, the largest first.
        self.pairs: dict[int, list[int]] = {}
        for total in range(2, most + 1):
            a = np.arange(total - 1, (total - 1) // 2, -1)
            if len(a := a[have[a] & have[total - a]]):
                self.pairs[total] = a.tolist()
        paired = np.zeros(most + 1, bool)
        paired[list(self.pairs)] = True
        #: For each sum the lengths that a pair's sum completes to it, the largest first.
        self.triples: dict[int, list[int]] = {}
        for total in range(3, most + 1):
            a = np.arange(total - 2, 0, -1)
            if len(a := a[have[a] & paired[total - a]]):
                self.triples[total] = a.tolist()
        self.at_pair, self.at_triple = dict.fromkeys(self.pairs, 0), dict.fromkeys(self.triples, 0)

    def _there(self, a: int, b: int, c: int = 0) -> bool:
        """Whether pieces of these lengths (0: none) are left, as many of each as needed."""
        free = self.free
        return free[a] > (a == b) + (a == c) and free[b] > (a == b) + (b == c) and (not c or free[c] > (a == c) + (b == c))

    def pair(self, total: int, other: int = 0) -> tuple[int, int] | None:
        """The first pair with this sum that is left, beside ``other`` (a length, 0: none)."""
        found = self.pairs.get(total, ())
        at = self.at_pair.get(total, 0)
        while at < len(found) and not self._there(found[at], total - found[at]):
            at += 1
        self.at_pair[total] = at
        while at < len(found):
            if self._there(found[at], total - found[at], other):
                return found[at], total - found[at]
            at += 1
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that are left and fill ``gap`` exactly: the fewest, then the largest."""
        if self.free[gap] > 0:
            return (gap,)
        if two := self.pair(gap):
            return two
        found = self.triples.get(gap)
        if not found:
            return None
        for at in range(self.at_triple[gap], len(found)):
            a = found[at]
            if self.free[a] > 0 and (two := self.pair(gap - a, a)):
                self.at_triple[gap] = at
                return (a, *two)
        self.at_triple[gap] = len(found)
        return None


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) of the sequences that hold ``counts`` pieces of each length."""
    free = [0] * (capacity + 1)
    for length, n in counts.items():
        free[length] = n
    sums = Sums(free)
    made: list[tuple[int, list[int]]] = []
    left: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        gap = capacity - length
        while free[length] > 0:
            if not gap:
                made.append((int(free[length]), [length]))
                free[length] = 0
                break
            free[length] -= 1
            found = sums.complement(gap)
            free[length] += 1
            if not found:
                left.append((length, int(free[length])))
                free[length] = 0
                break
            need = Counter((length, *found))
            times = min(int(free[x]) // k for x, k in need.items())
            for x, k in need.items():
                free[x] -= k * times
            made.append((times, [length, *found]))
    # Best fit of what has no complement: open sequences by the room they have.
    room: dict[int, list[tuple[int, list[int]]]] = {}
    open_ = np.zeros(capacity + 1, bool)

    def put(times: int, lengths: list[int], space: int) -> None:
        if space:
            room.setdefault(space, []).append((times, lengths))
            open_[space] = True
        else:
            made.append((times, lengths))

    for length, n in left:
        while n:
            fits = np.flatnonzero(open_[length:])
            if len(fits):
                space = length + int(fits[0])
                times, lengths = room[space].pop()
                taken = min(n, times)
                if taken < times:
                    room[space].append((times - taken, lengths))
                open_[space] = bool(room[space])
                put(taken, [*lengths, length], space - length)
                n -= taken
            else:
                each = capacity // length
                if full := n // each:
                    put(full, [length] * each, capacity - each * length)
                if rest := n % each:
                    put(1, [length] * rest, capacity - rest * length)
                n = 0
    for groups in room.values():
        made += groups
    return made


def _places(plan: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per length and step of the plan: length, first rank, rank after the last, pieces in each sequence, first
    sequence, offset."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for times, lengths in plan:
        offset = 0
        for length, k in Counter(lengths).items():
            rows.append((length, used[length], used[length] + times * k, k, sequence, offset))
            used[length] += times * k
            offset += k * length
        sequence += times
    return rows


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pieces of the documents: doc_id, piece, start, length, ids_crc32 and, if asked, ids (little-endian)."""
    small_batches(docs.sparkSession)
    file = tokenizer_path(tokenizer)

    def cut(batches):
        take = encoder(file, True)
        for batch in chunks(batches):
            flat, bounds = take.encode(batch.column("text"))
            n = len(bounds) - 1
            raw = memoryview(np.insert(flat, bounds[1:], end_id).astype("<u4").tobytes())
            ends = bounds[1:] + np.arange(1, n + 1)
            sizes = np.diff(bounds) + 1
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(n), pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = sizes - (pieces - 1) * capacity
            start = np.where(number > 0, head[doc] + (number - 1) * capacity, 0)
            length = np.where(number > 0, capacity, head[doc])
            at = (ends - sizes)[doc] + start
            cuts = [raw[4 * a : 4 * b] for a, b in zip(at, at + length)]
            out = {"doc_id": batch.column("doc_id").take(pa.array(doc)), "piece": pa.array(number, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64())}
            if keep_ids:
                out["ids"] = pa.array([bytes(c) for c in cuts], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32 and others), which must be
    stored: they are read more than once."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = {int(r["length"]): int(r["count"]) for r in counted}
    places = _places(plan_sequences(counts, capacity))
    # Lengths that many pieces share are dealt to many groups, each ranked on its own; by a stored row number, where there is
    # one, so that rows that are alike in everything are dealt as well.
    groups = int(min(4096, max(64, sum(counts.values()) // 500_000)))
    alike = ["_row"] if "_row" in pieces.columns else ["doc_id", "piece", "ids_crc32"]
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(*alike), F.lit(groups)).cast("int"))
    sizes = dealt.groupBy("length", "_group").count()
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "start", "ids_crc32", *(["_row"] if "_row" in pieces.columns else []))
    ranked = dealt.withColumn("_own", F.row_number().over(own)).join(sizes, ["length", "_group"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    schema = "length long, _from long, _to long, _each long, _first long, _offset long"
    # A few rows for each step of the plan, whose number is bounded by the capacity and not by the documents.
    steps = F.broadcast(spark.createDataFrame(places, schema).withColumnRenamed("length", "_length"))
    hit = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    j = F.col("_rank") - F.col("_from")
    return ranked.join(steps, hit).select(*pieces.columns, F.expr("_first + (_rank - _from) div _each").alias("sequence_id"), (F.col("_offset") + (j % F.col("_each")) * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence (little-endian), from packed pieces that kept their ids: at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of all ``docs`` with their place."""
    pieces = token_pieces(docs, keep_ids=False).withColumn("_row", F.monotonically_increasing_id())
    return pack(saved(pieces, "pieces")).drop("_row")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents", spread=True))

"""Language identification by prediction by partial matching: the language whose frozen statistics code a text in the fewest bits.

``train``: of each language at most ``SAMPLE_ROWS`` labelled documents, whole, are counted on executors: how often each byte follows
each of the contexts of 0 to ``ORDER`` bytes before it. The most frequent contexts of all languages together form one context
tree (a node's parent is its context without the oldest byte); each language has its own counts at the nodes. From these, once, the
code length of each byte at each node and in each language is made: a byte that the context has seen n times of N, with d different ones,
has probability n/(N + d); any other is coded by an escape of probability d/(N + d) and the next shorter context, where
what longer ones have seen is left out; below the root all bytes that are left are alike. A context that a
language doesn't have costs nothing.

``Model.bits``: a byte's node is the deepest one that the bytes before it reach (shorter contexts at a text's start). The
lengths are whole numbers (units of 2**-16 bit), so sums don't depend on batches or order.

Defined results: ``und`` and score 0 for texts that are null, empty or without a letter, and for all, where nothing can be learned;
of languages that code a text alike the first name wins; equal texts get equal values; repeated rows are answered each; an empty table gives
no rows; null doc_ids are answered but never learned from, nor are null languages; extra columns are ignored. A very long
text is coded whole, in steps; it is held as two bytes a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .labels import held_out
from .op8_toxicity import _bytes
from .store import small_batches, table
from .tokens import chunks

#: Bytes of the longest contexts.
ORDER = 4
#: Contexts of the tree, and bytes of its table of code lengths, at most (fewer contexts where there are many languages).
NODES, TABLE_BYTES = 8192, 64_000_000
#: Documents of each language that are learned from, at most (those with the smallest hashes).
SAMPLE_ROWS = 400
#: Rows up to which the chosen documents' ids are broadcast.
BROADCAST_ROWS = 200_000
UNIT = 1 << 16
#: The symbol before a text's first byte, which no context holds.
START = 256
WIDTH = 257
UNKNOWN = "und"
#: Bytes of text coded or counted at a time.
STEP = 1 << 17


def padded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with ``ORDER`` starts before each, and where each text (with its starts) begins and ends."""
    at = bounds + ORDER * np.arange(len(bounds))
    out = np.full(int(at[-1]), START, np.int16)
    sizes = np.diff(bounds)
    out[np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(bounds)), sizes)] = data
    return out, at


class Model:
    """``languages`` in order; ``child[node, byte]``: the context one byte longer (0: none); ``length[node * WIDTH + byte]``: a code length for
    each language. Node 1 is the root."""

    def __init__(self, languages: list[str], contexts: list[tuple[int, int]], counts: list[tuple[int, int, int, int, int]]):
        """``contexts``: (order, bytes, latest lowest), parents first; ``counts``: (order, bytes, language, byte, times)."""
        self.languages = languages
        size = max(1, len(contexts)) + 1
        self.child = np.zeros((size + 1, WIDTH), np.int32)
        node_of, parent, depth = {}, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for node, (order, context) in enumerate(contexts, 1):
            node_of[order, context] = node
            if order:
                parent[node] = node_of[order - 1, context & ((1 << 8 * (order - 1)) - 1)]
                depth[node] = order
                self.child[parent[node], context >> 8 * (order - 1)] = node
        seen = np.zeros((len(languages), size, 256), np.int32)
        for order, context, language, byte, times in counts:
            seen[language, node_of[order, context], byte] = times
        self.length = np.zeros((size, WIDTH, max(1, len(languages))), np.int32)
        for language in range(len(languages)):
            for order in range(ORDER + 1):
                nodes = np.flatnonzero(depth == order)
                for part in np.split(nodes[nodes > 0], range(1024, len(nodes), 1024)):
                    self.length[part, :256, language] = self._lengths(seen[language], parent, part, order)
        self.length = self.length.reshape(-1, max(1, len(languages)))

    @staticmethod
    def _lengths(seen: np.ndarray, parent: np.ndarray, nodes: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of all bytes at ``nodes`` of one order."""
        bits, escaped = np.zeros((len(nodes), 256)), np.zeros((len(nodes), 1))
        left = np.ones((len(nodes), 256), bool)
        for _ in range(order + 1):
            own = np.where(left, seen[nodes], 0)
            there = own > 0
            total, kinds = own.sum(1, keepdims=True), there.sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                bits = np.where(there, escaped + np.log2((total + kinds) / own), bits)
                escaped = escaped + np.where(total > 0, np.log2((total + kinds) / kinds), 0)
            left &= ~there
            nodes = parent[nodes]
        return np.rint(np.where(left, escaped + np.log2(np.maximum(1, left.sum(1, keepdims=True))), bits) * UNIT).astype(np.int32)

    def bits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code length of each text in each language, in units."""
        symbols, at = padded(data, bounds)
        out = np.zeros((len(bounds) - 1, self.length.shape[1]), np.int64)
        for lo in range(0, len(symbols), STEP):
            hi = min(lo + STEP, len(symbols))
            node, state = np.ones(hi - lo, np.int32), np.ones(hi - lo, np.int32)
            before = np.concatenate([np.full(max(0, ORDER - lo), START, np.int16), symbols[max(0, lo - ORDER) : hi]])
            for k in range(1, ORDER + 1):
                node = self.child[node, before[ORDER - k : ORDER - k + hi - lo]]
                state = np.where(node > 0, node, state)
            length = self.length[state * WIDTH + symbols[lo:hi]]
            first, last = int(np.searchsorted(at, lo, "right")) - 1, int(np.searchsorted(at, hi, "left"))
            out[first:last] += np.add.reduceat(length, np.maximum(at[first:last] - lo, 0), axis=0, dtype=np.int64)
        return out

    def predicted(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language with the shortest code, and its probability if all are alike before the text is seen."""
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best][:, None]
        return best, 1 / np.exp2(np.maximum(-1000.0, (least - bits) / UNIT)).sum(1)


def counted(docs: DataFrame) -> DataFrame:
    """(place, context order, context, byte, times): how often a byte follows a context in the texts of a language (``place``)."""

    def count(batches):
        for batch in chunks(batches):
            data, bounds = _bytes(batch.column("text"))
            symbols, at = padded(data, bounds)
            place = np.repeat(batch.column("place").to_numpy().astype(np.int64), np.diff(at))
            for lo in range(0, len(symbols), STEP):
                hi = min(lo + STEP, len(symbols))
                before = np.concatenate([np.full(max(0, ORDER - lo), START, np.int16), symbols[max(0, lo - ORDER) : hi]]).astype(np.int64)
                fine = before[ORDER:] != START
                key = place[lo:hi] << 48 | before[ORDER:]
                for k in range(ORDER + 1):
                    if k:
                        byte = before[ORDER - k : ORDER - k + hi - lo]
                        fine &= byte != START
                        key = key + (byte << 8 * k)
                    found, times = np.unique(key[fine], return_counts=True)
                    context = found >> 8 & (1 << 40) - 1
                    yield pa.RecordBatch.from_pydict({"place": pa.array(found >> 48), "length": pa.array(np.full(len(found), k, np.int32)), "context": pa.array(context), "byte": pa.array((found & 255).astype(np.int32)), "times": pa.array(times.astype(np.int64))})

    rows = docs.select("place", "text").mapInArrow(count, "place long, length int, context long, byte int, times long")
    return rows.groupBy("place", "length", "context", "byte").agg(F.sum("times").alias("times"))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, nodes: int = NODES) -> Model:
    """Learns from at most ``rows`` documents of each language, never from held-out ones."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # In two steps, so that one task gets at most so many rows of each of 64 parts of the input.
    chosen = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("_h"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("_part"))
    for keys in (["lang", "_part"], ["lang"]):
        chosen = chosen.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id"))).where(F.col("_n") <= rows)
    languages = sorted(r["lang"] for r in chosen.where("_n = 1").select("lang").collect())
    if not languages:
        return Model([], [], [])
    places = spark.createDataFrame(list(enumerate(languages)), "place long, lang string")
    chosen = chosen.select("lang", "doc_id")
    chosen = F.broadcast(chosen) if len(languages) * rows <= BROADCAST_ROWS else chosen
    # Rows that share a doc_id and language are all learned from.
    learned = known.select("doc_id", "lang", "text").join(chosen, ["lang", "doc_id"], "left_semi").join(F.broadcast(places), "lang")
    found = counted(learned).persist()
    most = max(1, min(nodes, TABLE_BYTES // (4 * WIDTH * len(languages))))
    # The most frequent ones; a context is never more frequent than its parent, which comes first where they are alike.
    kept = found.groupBy("length", "context").agg(F.sum("times").alias("_times")).orderBy(F.desc("_times"), "length", "context").limit(most)
    contexts = [(r["length"], r["context"]) for r in kept.collect()]
    kept = spark.createDataFrame(contexts or [(0, 0)], "length int, context long")
    counts = found.join(F.broadcast(kept), ["length", "context"]).select("length", "context", "place", "byte", "times").toArrow()
    found.unpersist()
    return Model(languages, sorted(contexts), list(zip(*(c.to_pylist() for c in counts.columns))))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, bits): ``bits``, the shortest code's length."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in chunks(batches):
            bits = model.bits(*_bytes(batch.column("text")))
            best, score = model.predicted(bits)
            some = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            name = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(name, pa.string()), "score": pa.array(np.where(some, score, 0.0)), "bits": pa.array(bits[np.arange(len(bits)), best] / UNIT)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", letters).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits double")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    return identified(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

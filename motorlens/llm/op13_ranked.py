"""Ranked lexical search with block-max pruning.

1. ``vocabulary``: the different terms of all queries. ``forward_index``: of each document its length in terms and how often it has each
   of the vocabulary's; ``statistics``: the number of documents, of terms, and of documents that hold each term.
2. ``blocks``: documents sorted by doc_id, ``BLOCK`` at a time, are a block: their lists as flat arrays, and of each term the largest
   impact (what one document has of it, whatever the term's weight) in the block.
3. ``top_documents``: a query's bound in a block is the sum of weight times largest impact. Of each query the ``SEEDS`` blocks with the
   highest bounds are scored first, across all tasks; the k-th score there is the query's threshold. Then each task goes over its blocks, some
   hundred at a time: sorted by the query's bound they are scored from their lists until the bound falls below the
   threshold, which grows as scores are found. A task sends k rows of each query at most; the best of these are the result.

All is in whole numbers (bounds in doubles, where they and all scores stay below 2**53; beyond, in Python's whole numbers). Queries
are answered ``QUERIES`` at a time, so a large query set means more passes and no larger task.

Defined results: a null, empty or wordless text has no term and is in no result; equal scores come by ascending doc_id, null last; rows that share a
doc_id are ranked each; queries that share an item_id are one query with the terms of all; a query without a term, or none that a document has,
gives no row; an empty table gives no rows; extra columns are ignored. A very long text's terms are cut out span by span.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .op8_toxicity import _bytes
from .store import dropped, saved, small_batches, table
from .tokens import chunks

K = 10
#: Parameters of the score, fixed values: share of a document's length in its norm in hundredths, scale of weights and of impacts.
LENGTH, WEIGHT, IMPACT = 90, 1000, 1_000_000_000
#: Documents of a block, blocks that a task sorts at a time, blocks of each query that are scored first.
BLOCK, GROUP, SEEDS = 64, 256, 8
#: Queries answered in one pass: a bound on the vocabulary that travels.
QUERIES = 4096
#: Bytes of text whose terms are cut out at a time.
SPAN = 1_000_000
#: A-Z to lower case; of the other ASCII bytes all but digits and letters to blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(raw: bytes) -> Counter:
    """How often a text (UTF-8) has each term."""
    raw, found, at = raw.translate(_FOLD), Counter(), 0
    while at < len(raw):
        cut = raw.find(b" ", at + SPAN)
        cut = len(raw) if cut < 0 else cut
        found.update(raw[at:cut].split())
        at = cut
    return found


def vocabulary(items: DataFrame) -> tuple[list, list[np.ndarray], list[bytes]]:
    """Ids of the queries, places in the vocabulary of the terms of each, and the vocabulary. ``items``: (item_id, text), at most ``QUERIES`` ids."""
    own: dict = {}
    for r in items.collect():
        own.setdefault(r["item_id"], set()).update(terms((r["text"] or "").encode()))
    words = sorted(set().union(*own.values())) if own else []
    place = {w: i for i, w in enumerate(words)}
    return list(own), [np.array(sorted(place[w] for w in t), np.int64) for t in own.values()], words


def forward_index(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(doc_id, n, term, tf) of each document with a term: its length, and how often it has the vocabulary's terms (flat int32)."""
    small_batches(docs.sparkSession)
    place = {w: i for i, w in enumerate(words)}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches):
        for batch in chunks(batches):
            data, bounds = _bytes(batch.column("text"))
            keep, sizes, term, tf = [], [], [], []
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                found = terms(data[a:b].tobytes())
                if found:
                    own = sorted((place[w], found[w]) for w in found.keys() & place.keys())
                    keep.append(i)
                    sizes.append(found.total())
                    term.append(np.array([x for x, _ in own], np.int32).tobytes())
                    tf.append(np.array([x for _, x in own], np.int32).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(keep, pa.int64())), "n": pa.array(sizes, pa.int64()), "term": pa.array(term, pa.binary()), "tf": pa.array(tf, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, n long, term binary, tf binary")


def statistics(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all, and the number of documents of each of the ``size`` terms of the vocabulary."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("term")), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(held), "df": pa.array(total[held])})

    both = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    found = index.select("term").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return both["n"], both["l"], df


def _flat(column: pa.Array, kind=np.int32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.floor(WEIGHT * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, all_terms: int) -> np.ndarray:
    """What a document of ``n`` terms has of a term that it holds ``tf`` times, before the term's weight."""
    norm = 100 - LENGTH + LENGTH * n * docs // max(1, all_terms)
    return IMPACT * tf // (1000 * tf + 8 * norm)


def blocks(index: DataFrame, docs: int, all_terms: int) -> DataFrame:
    """Rows of ``index`` by ranges of doc_id, ``BLOCK`` documents a row: their ids, the start of each one's list, terms and impacts; and for
    each term of the block the largest impact."""
    kind = index.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _regrouped(batches, BLOCK * 16):
            out = {c: [] for c in ("ids", "starts", "term", "impact", "top_term", "top_impact")}
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                term, tf = _flat(own.column("term")), _flat(own.column("tf")).astype(np.int64)
                sizes = np.array([len(t) // 4 for t in own.column("term").to_pylist()], np.int64)
                impact = impacts(tf, np.repeat(own.column("n").to_numpy(), sizes), docs, all_terms)
                order = np.argsort(term, kind="stable")
                first = np.flatnonzero(np.diff(term[order], prepend=-1))
                out["ids"].append(own.column("doc_id").to_pylist())
                out["starts"].append(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32).tobytes())
                out["term"].append(term.tobytes())
                out["impact"].append(impact.tobytes())
                out["top_term"].append(term[order][first].tobytes())
                out["top_impact"].append((np.maximum.reduceat(impact[order], first) if len(first) else impact).tobytes())
            ids = pa.array(out.pop("ids"), pa.list_(batch.schema.field("doc_id").type))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.binary()) for c in out.values())], names=["ids", *out])

    dealt = index.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    made = dealt.mapInArrow(pack, f"ids array<{kind}>, starts binary, term binary, impact binary, top_term binary, top_impact binary")
    return made.withColumn("block", F.monotonically_increasing_id())


def _regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of just that many rows, but the last."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - size)
            batch = batch.slice(part.num_rows)
            held.append(part)
            size += part.num_rows
            if size == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Query:
    """Terms and weights of the queries of a pass, and a matrix of them for bounds."""

    def __init__(self, own: list[np.ndarray], weight: np.ndarray, size: int):
        self.own, self.weight, self.size = own, weight, size
        # Sums of whole numbers are exact in doubles below 2**53.
        most = max((int(weight[t].sum()) for t in own), default=0) * (IMPACT // 1000)
        self.kind = np.float64 if most < 2**53 else object
        self.lengths = np.array([len(t) for t in own], np.int64)
        self.flat = np.concatenate(own) if own else np.zeros(0, np.int64)
        self.flat_weight = weight[self.flat].astype(self.kind)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]

    def bounds(self, top_term: list[bytes], top_impact: list[bytes]) -> np.ndarray:
        """For each block and query: no document of the block scores higher."""
        out = np.zeros((len(top_term), len(self.own)), self.kind)
        some = np.flatnonzero(self.lengths)
        row = np.zeros(self.size, np.int64)
        for i, (term, impact) in enumerate(zip(top_term, top_impact)):
            term = np.frombuffer(term, np.int32)
            row[term] = np.frombuffer(impact, np.int64)
            out[i, some] = np.add.reduceat(row[self.flat] * self.flat_weight, self.starts[some])
            row[term] = 0
        return out

    def scores(self, starts: bytes, term: bytes, impact: bytes, asked: np.ndarray) -> np.ndarray:
        """For each document of a block and each query of ``asked``: its score."""
        starts = np.frombuffer(starts, np.int32)
        matrix = np.zeros((len(starts) - 1, self.size), np.float64 if self.kind is np.float64 else np.int64)
        matrix[np.repeat(np.arange(len(starts) - 1), np.diff(starts)), np.frombuffer(term, np.int32)] = np.frombuffer(impact, np.int64)
        return np.stack([matrix[:, t] @ self.weight[t].astype(self.kind) for t in (self.own[q] for q in asked)], 1)


def _best(score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores above 0, equal ones by id, null last."""
    return np.lexsort((ids, null, -score))[:k]


def _searched(query: Query, k: int, threshold: np.ndarray, report: bool = False):
    """A function for mapInArrow over blocks: each query's k best documents among those of its task, sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = threshold.copy()
        best: list[list[tuple]] = [[] for _ in query.own]  # (minus score, id is null, id), sorted
        pairs = scored = 0
        for batch in _regrouped(batches, GROUP):
            columns = {c: batch.column(c).to_pylist() for c in ("ids", "starts", "term", "impact", "top_term", "top_impact")}
            high = query.bounds(columns["top_term"], columns["top_impact"])
            pairs += high.size
            order = np.argsort(-high, axis=0, kind="stable")
            # Rank by rank: of each query its next best block, until that one's bound falls below the threshold.
            for place in order:
                going = np.flatnonzero((high[place, np.arange(len(place))] >= floor) & (high[place, np.arange(len(place))] > 0))
                if not len(going):
                    break
                for at in np.unique(place[going]).tolist():
                    asked = going[place[going] == at]
                    score = query.scores(columns["starts"][at], columns["term"][at], columns["impact"][at], asked)
                    ids = columns["ids"][at]
                    scored += len(asked)
                    for j, q in enumerate(asked.tolist()):
                        rows = np.flatnonzero((score[:, j] >= floor[q]) & (score[:, j] > 0))
                        if len(rows):
                            new = [(-int(score[i, j]), ids[i] is None, ids[i] or 0) for i in rows.tolist()]
                            best[q] = sorted(best[q] + new)[:k]
                            if len(best[q]) == k:
                                floor[q] = max(floor[q], -best[q][-1][0])
        if report:
            yield pa.RecordBatch.from_pydict({"pairs": pa.array([pairs]), "scored": pa.array([scored])})
            return
        out = [(q, None if null else i, -s) for q, own in enumerate(best) for s, null, i in own]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return run


def _seeds(made: DataFrame, query: Query, seeds: int) -> DataFrame:
    """(block): those among the ``seeds`` highest bounds of any query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high = query.bounds(batch.column("top_term").to_pylist(), batch.column("top_impact").to_pylist())
            block = batch.column("block").to_numpy()
            rows = np.argsort(-high, axis=0, kind="stable")[:seeds]
            q = np.broadcast_to(np.arange(high.shape[1]), rows.shape).ravel()
            rows = rows.ravel()
            yield pa.RecordBatch.from_pydict({"query": pa.array(q.astype(np.int32)), "block": pa.array(block[rows]), "bound": pa.array(high[rows, q].astype(np.float64))})

    first = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    found = made.select("block", "top_term", "top_impact").mapInArrow(run, "query int, block long, bound double")
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= seeds).select("block").distinct()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, k: int = K, seeds: int = SEEDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring of all (doc_id, text) for each of at most ``QUERIES`` different item_ids."""
    spark = docs.sparkSession
    ids, own, words = vocabulary(items)
    index = saved(forward_index(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words), "forward")
    n, all_terms, df = statistics(index, len(words))
    made = saved(blocks(index, n, all_terms), "blocks")
    dropped(index)
    query = Query(own, weights(n, df), len(words))
    schema, none = "query int, doc_id long, score long", np.zeros(len(own))
    chosen = saved(_seeds(made, query, seeds), "seeds")
    first = made.join(chosen, "block", "left_semi").mapInArrow(_searched(query, k, none), schema)
    floor = none.astype(query.kind)
    for r in _ranked(first, k).where(F.col("rank") == k).select("query", "score").collect():  # a row for each query at most
        floor[r["query"]] = r["score"]
    best = _ranked(made.mapInArrow(_searched(query, k, floor), schema), k)
    names = spark.createDataFrame([(q, i) for q, i in enumerate(ids)], f"query int, item_id {items.schema['item_id'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, queries: int = QUERIES) -> DataFrame:
    """``top_documents`` for any number of queries, in passes."""
    spark = docs.sparkSession
    items = items.select("item_id", "text").where("text is not null")
    passes = -(-items.select("item_id").distinct().count() // queries)
    if passes <= 1:
        return top_documents(docs, items, k)
    # Each pass takes the ids of a range of their order, so none has more than ``queries``.
    nth = Window.orderBy("item_id")
    place = saved(items.select("item_id").distinct().withColumn("part", F.floor((F.row_number().over(nth) - 1) / queries)), "queries")
    out = None
    for i in range(passes):
        chosen = items.join(place.where(F.col("part") == i).select(F.col("item_id").alias("_id")), F.col("item_id").eqNullSafe(F.col("_id")), "left_semi")
        found = saved(top_documents(docs, chosen, k), "ranked")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"))


_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_RUN}') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::HUGEINT AS n, sum(len(t))::HUGEINT AS l FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_RUN}')) AS term FROM benchmark),
f AS (SELECT r, any_value(doc_id) AS doc_id, any_value(len(t)) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM s) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f GROUP BY term),
x AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * f.n * s.n) // s.l))))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY item_id, r),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {K}
"""

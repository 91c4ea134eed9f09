"""Toxicity: a convolutional text classifier on hashed word embeddings, trained and run in numpy.

A word (lower-cased run of letters, digits and other non-ASCII characters) has the sum of four hashed
vectors: of the whole word and of its first 4, 6 and 8 bytes. Filters of several widths slide over the
words of the whole text; each filter's largest answer goes into one logistic unit. Scores see the text
only. Thresholds are then set for each language on training rows that were kept out of the fit. All labelled rows are learned from:
tasks fit on shards of them, and the weights are averaged.

Defined results: a null or empty text is one blank word; equal texts get equal scores, bit for bit, whatever
batch they stand in; without labels of both classes every score is 0; an empty table gives no rows; extra columns stay. A very
long text is scored in spans of ``BYTES`` bytes cut between words, the last words of one going before the next.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import Adam, held_out, sigmoid
from .store import dropped, new_path, saved, small_batches, table
from .tokens import chunks

SLOTS = 1 << 17
WIDTH = 8
FILTERS = {1: 8, 2: 8, 3: 8}
PREFIXES = (4, 6, 8)
EPOCHS = 6
THRESHOLD = 0.3
#: Thresholds that are tried, those nearest to THRESHOLD first.
GRID = np.arange(0.1, 0.71, 0.05)
GRID = GRID[np.argsort(np.abs(GRID - THRESHOLD), kind="stable")]
#: Text bytes scored at a time (or one longer text).
BYTES = 1_000_000
_GAP = max(FILTERS) - 1

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IN_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def word_slots(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots (words, 4) of the words of all texts, and the number of words of each; ``bounds``: where texts start in
    ``data`` (bytes), and its end."""
    low = _FOLD[data]
    # Capital letters of the Latin-1 supplement, in UTF-8.
    after = np.zeros(len(low), bool)
    after[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low = np.where(after, low + 0x20, low).astype(np.uint8)
    inside = _IN_WORD[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(low)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = bounds[1:] - 1
    tails = tails[tails >= 0]
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(start, bounds))
    padded = np.concatenate([low, np.zeros(16, np.uint8)])
    size = end - start
    head, tail = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    back = np.maximum(start, end - 8)
    for j in range(8):
        shift = np.uint64(8 * j)
        head |= np.where(j < size, padded[start + j], 0).astype(np.uint64) << shift
        tail |= np.where(back + j < end, padded[back + j], 0).astype(np.uint64) << shift
    shift = np.uint64(64 - int(SLOTS).bit_length() + 1)
    out = np.empty((len(start), 1 + len(PREFIXES)), np.int64)
    out[:, 0] = ((head * _ODD[0] ^ (tail + size.astype(np.uint64)) * _ODD[1]) * _ODD[2]) >> shift
    for i, k in enumerate(PREFIXES):
        part = head & np.uint64((1 << 8 * k) - 1)
        out[:, 1 + i] = ((part ^ (part >> np.uint64(29))) * _ODD[2 + i] * _ODD[0]) >> shift
    return out, counts


#: Words whose products are held at a time.
_ROWS = 1 << 14


def _fixed_product(x: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """``x @ wide`` with its sums taken in one order for every row, so that a row's result doesn't depend on the others."""
    out = np.empty((len(x), wide.shape[1]), np.float32)
    for at in range(0, len(x), _ROWS):
        part, z = x[at : at + _ROWS], out[at : at + _ROWS]
        np.multiply(part[:, :1], wide[0], out=z)
        for d in range(1, len(wide)):
            z += part[:, d : d + 1] * wide[d]
    return out


def _word_end(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where no word goes on (bytes above 0x7F and capital letters are of a word)."""
    while at < len(data):
        inside = np.append(_IN_WORD[_FOLD[data[at : at + 4096]]], False)
        stop = int(np.argmin(inside))
        if at + stop < len(data) and stop == 4096:
            at += 4096
            continue
        return at + stop
    return len(data)


class Model:
    """Weights of the classifier; ``table`` has one vector for each slot."""

    def __init__(self, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (SLOTS, WIDTH)).astype(np.float32)
        self.filters = [rng.normal(0, 0.5 / k**0.5, (k, WIDTH, n)).astype(np.float32) for k, n in FILTERS.items()]
        self.bias = np.zeros(sum(FILTERS.values()), np.float32)
        self.out = rng.normal(0.5, 0.1, sum(FILTERS.values())).astype(np.float32)
        self.base = np.full(1, -2, np.float32)
        self.thresholds: dict[str, float] = {}
        self.fitted = False

    def small(self) -> list[np.ndarray]:
        """All weights but the table."""
        return [*self.filters, self.bias, self.out, self.base]

    def copy(self) -> Model:
        return copy.deepcopy(self)

    def laid_out(self, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word vectors with blank rows between texts, the row where each text starts, and rows that may begin a window."""
        most = np.maximum(counts, 1)
        starts = np.cumsum(most + _GAP) - most - _GAP
        rows = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(slots))
        x = np.zeros((int((most + _GAP).sum()), WIDTH), np.float32)
        x[rows] = self.table[slots[:, 0]] + self.table[slots[:, 1]] + self.table[slots[:, 2]] + self.table[slots[:, 3]]
        return x, starts, most

    def answers(self, x: np.ndarray, product=None) -> np.ndarray:
        """Every filter at every row (the last ``_GAP`` rows see fewer words)."""
        wide = np.concatenate([w[j] for w in self.filters for j in range(len(w))], 1)
        z = (product or _fixed_product)(x, wide)
        y = np.zeros((len(x), len(self.bias)), np.float32)
        at = to = 0
        for w in self.filters:
            n = w.shape[2]
            for j in range(len(w)):
                y[: len(x) - j, to : to + n] += z[j:, at : at + n]
                at += n
            to += n
        return y

    def best(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each filter's largest answer in each text."""
        out = np.empty((len(bounds) - 1, len(self.bias)), np.float32)
        text = 0
        while text < len(out):
            upto = max(text + 1, int(np.searchsorted(bounds, bounds[text] + BYTES, "right")) - 1)
            part = data[bounds[text] : bounds[upto]]
            if len(part) > BYTES:
                out[text] = self._best_of_long(part)
            else:
                slots, counts = word_slots(part, bounds[text : upto + 1] - bounds[text])
                x, starts, most = self.laid_out(slots, counts)
                pairs = np.stack([starts, starts + most], 1).ravel()
                out[text:upto] = np.maximum.reduceat(self.answers(x), pairs, axis=0)[::2]
            text = upto
        return out

    def _best_of_long(self, data: np.ndarray) -> np.ndarray:
        best = np.full(len(self.bias), -np.inf, np.float32)
        carried, at = np.zeros((0, 1 + len(PREFIXES)), np.int64), 0
        while at < len(data):
            cut = _word_end(data, at + BYTES)
            slots = np.concatenate([carried, word_slots(data[at:cut], np.array([0, cut - at]))[0]])
            # Windows that reach into the next span are answered there.
            windows = len(slots) - (0 if cut == len(data) else _GAP)
            at = cut
            if windows > 0 or cut == len(data):
                x = self.laid_out(slots, np.array([len(slots)]))[0]
                best = np.maximum(best, self.answers(x)[: max(1, windows)].max(0))
            carried = slots[-_GAP:]
        return best

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(bounds) - 1)
        best = self.best(data, bounds)
        hidden = np.maximum(best + self.bias, 0).astype(np.float64)
        return sigmoid((hidden * self.out.astype(np.float64)).sum(1) + float(self.base[0]))

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, seed: int = 8, decay: float = 1e-4) -> None:
        self.fitted = True
        rng = np.random.default_rng(seed)
        small = Adam([*self.filters, self.bias, self.out, self.base], 0.01)
        square = np.full(SLOTS, 1e-3, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                raw = b"".join(texts[i] for i in own)
                slots, counts = word_slots(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])]))
                # A tenth of the words is left out, so that no text is known by a single rare word.
                keep = rng.random(len(slots)) > 0.1
                doc = np.repeat(np.arange(len(own)), counts)[keep]
                slots, counts = slots[keep], np.bincount(doc, minlength=len(own))
                x, starts, most = self.laid_out(slots, counts)
                ys = self.answers(x, np.matmul)
                place = np.array([s + ys[s : s + m].argmax(0) for s, m in zip(starts, most)])
                pre = np.take_along_axis(ys, place, 0) + self.bias
                hidden = np.maximum(pre, 0)
                error = (sigmoid(hidden @ self.out + self.base[0]) - y[own]).astype(np.float32) / len(own)
                inner = error[:, None] * self.out * (pre > 0)
                row_of = np.full(len(x), -1)
                rows = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(slots))
                row_of[rows] = np.arange(len(slots))
                back = np.zeros_like(x)
                grads, to = [], 0
                for w in self.filters:
                    k, _, n = w.shape
                    g = np.zeros_like(w)
                    for j in range(k):
                        p = place[:, to : to + n] + j
                        d = inner[:, to : to + n]
                        g[j] = np.einsum("dnw,dn->wn", x[p], d)
                        np.add.at(back, p.ravel(), (d[:, :, None] * w[j].T[None]).reshape(-1, WIDTH))
                    grads.append(g + decay * w)
                    to += n
                small.step([*grads, inner.sum(0), hidden.T @ error + decay * self.out, error.sum(keepdims=True)])
                used = np.flatnonzero((back != 0).any(1) & (row_of >= 0))
                if len(used):
                    hit, where = np.unique(slots[row_of[used]], return_inverse=True)
                    step = np.zeros((len(hit), WIDTH), np.float32)
                    np.add.at(step, where.reshape(len(used), -1), back[used][:, None, :])
                    step += decay * self.table[hit]
                    square[hit] += (step * step).mean(1)
                    self.table[hit] -= 0.05 * step / np.sqrt(square[hit])[:, None]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array without copying, and where each text starts."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


#: Labelled rows and bytes of their texts that a task fits on, about. Where there are more, tasks fit side by side, and their weights are averaged after
#: each of ``ROUNDS`` rounds, in which each row is seen once.
SHARD_ROWS, SHARD_BYTES, ROUNDS = 10_000, 32_000_000, 2
_UNIT = float(1 << 32)


#: Labelled documents up to which texts without a label are left out by a broadcast of the others' ids, before texts are dealt.
FEW = 100_000


def marked(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(id, y) of documents with a text and a label that may be learned from. A doc_id with several labels has the largest."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y")).where("y in (0, 1)")
    there = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), F.octet_length("text").cast("long").alias("size")).groupBy("id").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return known.join(there, "id")


def _place(shards: int) -> F.Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")


def labelled(docs: DataFrame, known: DataFrame, shards: int, few: bool) -> DataFrame:
    """(shard, id, text, lang, y) of the texts whose id is in ``known``, a shard's rows together. Texts travel once: they and the labels are dealt by shard
    and sorted by id, and a label goes before the texts that it marks."""
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("id"), "text", "lang")
    if few:
        texts = texts.join(F.broadcast(known.select("id")), "id", "left_semi")
    marks = known.select("id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), "y")
    both = marks.unionByName(texts.withColumn("y", F.lit(None).cast("int"))).select(_place(shards), "id", "text", "lang", "y")

    def merge(batches):
        at, mark = None, None
        for batch in batches:
            ids, y = batch.column("id").to_numpy(), batch.column("y").fill_null(-1).to_numpy()
            heads = y >= 0
            place = np.maximum.accumulate(np.where(heads, np.arange(len(ids)), -1))
            own = np.where(place >= 0, ids[place], at if at is not None else ids - 1)
            found = np.where(place >= 0, y[place], mark if mark is not None else -1)
            keep = ~heads & (own == ids)
            if heads.any():
                at, mark = ids[place[-1]], y[place[-1]]
            out = batch.set_column(4, "y", pa.array(found.astype(np.int32)))
            yield out.filter(pa.array(keep))

    # Nulls come first, so labels do.
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "id", F.col("y").isNull())
    return dealt.mapInArrow(merge, "shard int, id long, text string, lang string, y int")


def _whole_shards(batches):
    """(shard, texts, labels) of rows that come shard by shard."""
    shard, rows = None, []

    def sorted_rows():
        rows.sort()
        return shard, [t for t, _ in rows], np.array([y for _, y in rows], np.float64)

    for batch in batches:
        for own, text, y in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            if own != shard:
                if rows:
                    yield sorted_rows()
                shard, rows = own, []
            rows.append((text.encode("utf-8"), y))
    if rows:
        yield sorted_rows()


def _rows_of(model: Model, before: Model) -> tuple[np.ndarray, np.ndarray]:
    """Weights as rows of ``WIDTH`` whole units: those slots that differ from ``before``, and below 0 all other weights."""
    slots = np.flatnonzero((model.table != before.table).any(1))
    small = np.concatenate([w.ravel() for w in model.small()])
    small = np.pad(small, (0, -len(small) % WIDTH)).reshape(-1, WIDTH)
    return np.concatenate([slots, -1 - np.arange(len(small))]), np.rint(np.concatenate([model.table[slots], small]).astype(np.float64) * _UNIT).astype(np.int64)


def fitted(rows: DataFrame, model: Model, shards: int, epochs: int, number: int) -> Model:
    """The model after one round: each shard's rows (shard, text, y) fit a copy, and each weight becomes its mean over the copies that changed it. Sums are of
    whole units, so their order doesn't matter."""
    small_batches(rows.sparkSession)
    names = [f"d{i}" for i in range(WIDTH)]

    def run(batches):
        for shard, texts, y in _whole_shards(batches):
            own = model.copy()
            own.fit(texts, y, epochs, seed=8 + number * shards + shard)
            slots, values = _rows_of(own, model)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), *(pa.array(np.ascontiguousarray(v)) for v in values.T)], names=["slot", *names])

    changed = rows.select("shard", "text", "y").mapInArrow(run, ", ".join(["slot long", *(f"{d} long" for d in names)]))
    means = changed.groupBy("slot").agg(*((F.sum(d) / F.count("*")).alias(d) for d in names)).orderBy("slot").toArrow()  # at most a row for each slot
    slots, values = means.column("slot").to_numpy(), np.stack([means.column(d).to_numpy() for d in names], 1) / _UNIT
    out = model.copy()
    out.fitted = True
    out.table[slots[slots >= 0]] = values[slots >= 0]
    at, flat = 0, values[slots < 0][::-1].ravel()
    for w in out.small():
        w[...] = flat[at : at + w.size].reshape(w.shape)
        at += w.size
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fits on all labelled rows but a fifth, which sets the thresholds; on all, where the others lack a class."""
    model, spark = Model(), docs.sparkSession
    small_batches(spark)
    check = F.pmod(F.xxhash64("id", F.lit(label)), F.lit(5)) == 0
    known = saved(marked(docs, labels, label), "marked")
    counts = known.groupBy(check.alias("check"), "y").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()
    if len({r["y"] for r in counts}) < 2:
        return model
    every = len({r["y"] for r in counts if not r["check"]}) < 2
    n, size = (sum(r[c] for r in counts if every or not r["check"]) for c in ("n", "size"))
    shards = max(-(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    # A file for each shard, in one row group, which a reader never divides; check rows are in files of their own.
    path = new_path(spark, "labelled")
    placed = labelled(docs, known.select("id", "y"), shards, n <= FEW).withColumn("check", check)
    placed.drop("id").write.partitionBy("check", "shard").option("compression", "zstd").option("parquet.block.size", str(1 << 30)).parquet(path)
    stored = spark.read.schema("text string, lang string, y int, check boolean, shard int").parquet(path)
    own = stored if every else stored.where("not check")
    for number in range(ROUNDS if shards > 1 else 1):
        model = fitted(own, model, shards, 1 if shards > 1 else EPOCHS, number)
    # Counts of what each threshold of the grid finds, by language.
    hits = [F.sum((F.col("score") >= float(t)).cast("long")).alias(f"t{i}") for i, t in enumerate(GRID)]
    found = scored(stored.where("check and lang is not null").select("text", "lang", "y"), model).groupBy("lang", "y").agg(F.count("*").alias("n"), *hits)
    found = {(r["lang"], r["y"]): r for r in found.where("n >= 10").collect()}
    for lang in sorted({k for k, _ in found}):
        if (lang, 0) in found and (lang, 1) in found:
            good, bad = found[lang, 1], found[lang, 0]
            balance = [good[f"t{i}"] / good["n"] + (bad["n"] - bad[f"t{i}"]) / bad["n"] for i in range(len(GRID))]
            model.thresholds[lang] = float(round(GRID[int(np.argmax(balance))], 2))
    dropped(known)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return model


def calibrated(scores: np.ndarray, y: np.ndarray, langs: list, least: int = 10) -> dict[str, float]:
    """For each language with ``least`` rows of both classes the threshold nearest to THRESHOLD among those with most right."""
    grid, out = GRID, {}
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= least:
            balance = [((scores[own] >= t) & (y[own] == 1)).sum() / (y[own] == 1).sum() + ((scores[own] < t) & (y[own] == 0)).sum() / (y[own] == 0).sum() for t in grid]
            out[lang] = float(round(grid[int(np.argmax(balance))], 2))
    return out


def scored(docs: DataFrame, model, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each whole text."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches):
        for batch in chunks(batches, limit=BYTES):
            got = model.scores(*_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def language_threshold(model: Model) -> F.Column:
    """The threshold of a row's language."""
    value = F.lit(THRESHOLD)
    for lang, own in model.thresholds.items():
        value = F.when(F.col("lang") == lang, F.lit(own)).otherwise(value)
    return value


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text", "lang")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model).withColumn("threshold", language_threshold(model))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))

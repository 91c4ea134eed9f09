"""Labelled rows for the classifiers: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a classifier is fitted on, at most (those with the smallest hashes).
SAMPLE_ROWS = 1500
#: Bytes of their texts, of each class, at most: whole texts, in order of the hash, each that still fits. It bounds what the driver holds.
SAMPLE_BYTES = 6_000_000


def held_out(doc_id="doc_id") -> F.Column:
    """Rows that are never learned from: crc32 of doc_id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitting(rows: list, most: int) -> list:
    """Of rows with ``size``, in their order, each that fits into what is left of ``most`` bytes."""
    out = []
    for r in rows:
        if r["size"] <= most:
            most -= r["size"]
            out.append(r)
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list, np.ndarray, float]:
    """Whole texts (UTF-8), languages and labels of at most ``rows`` rows and ``most_bytes`` bytes of each class, and by how much the log-odds of
    label 1 among all labelled rows exceed those in the sample. A doc_id with several labels has the largest."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    # Of the labelled documents that are there, those with the smallest hashes.
    there = known.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi")
    chosen = [there.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    ids = [tuple(r) for part in chosen for r in part.collect()]
    if not ids:
        return [], [], np.zeros(0), 0.0
    wanted = docs.sparkSession.createDataFrame(ids, "_id long, _y int")
    found = docs.select(F.col("doc_id").alias("_doc"), "text", "lang").join(F.broadcast(wanted), F.col("_doc") == F.col("_id")).where("text is not null")
    found = found.select("text", "lang", "_y", "_id", F.xxhash64("_id").alias("_h"), F.xxhash64("text").alias("_t"), F.octet_length("text").alias("size"))
    sizes = [found.where(F.col("_y") == y).select("_y", "_id", "_h", "_t", "size").orderBy("_h", "_id", "_t").limit(rows).collect() for y in (0, 1)]
    kept = [(r["_id"], r["_t"]) for part in sizes for r in fitting(part, most_bytes)]
    if not kept:
        return [], [], np.zeros(0), 0.0
    kept = docs.sparkSession.createDataFrame(sorted(set(kept)), "_id long, _t long")
    got = found.join(F.broadcast(kept), ["_id", "_t"], "left_semi").groupBy("_y", "_h", "_id", "_t", "lang").agg(F.first("text").alias("text")).collect()
    got.sort(key=lambda r: (r["_h"], r["_id"], r["_t"], r["lang"] or ""))
    y = np.array([r["_y"] for r in got], np.float64)
    all_ = {r["_y"]: r["count"] for r in known.groupBy("_y").count().where("_y in (0, 1)").collect()}
    odds = [all_.get(1, 0) / max(1, all_.get(0, 0)), (y == 1).sum() / max(1, (y == 0).sum())]
    shift = float(np.log(odds[0] / odds[1])) if min(odds) > 0 else 0.0
    return [r["text"].encode("utf-8") for r in got], [r["lang"] for r in got], y, shift


class Adam:
    """Adam steps on a list of arrays, in place."""

    def __init__(self, weights: list[np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = [np.zeros_like(w) for w in weights]
        self.v = [np.zeros_like(w) for w in weights]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for w, g, m, v in zip(self.weights, grads, self.m, self.v):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w -= (rate * m / (np.sqrt(v) + 1e-8)).astype(w.dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

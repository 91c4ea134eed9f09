"""Quality: a byte-level convolutional network, trained and run in numpy.

Each filter has one weight for each byte value at each of its ``SPAN`` places, so that its answer at a
byte is a sum of table entries. A text is cut into chunks of ``CHUNK`` bytes; the windows that begin in a
chunk reach into the next one, so chunks overlap and cover the whole text. The largest answer in each
chunk is pooled over the text by largest and by mean, and a hidden layer turns both into one
probability.

Defined results: a null or empty text is one chunk of zero bytes; repeated rows get equal scores;
texts that score alike are ranked nowhere; without labels of both classes every score is 0; an empty table gives no rows; extra columns stay.
A very long text is scored whole, chunk by chunk, and held in memory a few times over.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import Adam, held_out, sample, sigmoid
from .op8_toxicity import scored
from .store import table

SPAN = 6
FILTERS = 16
CHUNK = 256
HIDDEN = 8
EPOCHS = 8
THRESHOLD = 0.7
#: Bytes whose answers are held at a time.
BLOCK = 1 << 16


class Model:
    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.taps = rng.normal(0, 0.4, (SPAN, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.hidden = rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(np.float32)
        self.shift = np.zeros(HIDDEN, np.float32)
        self.out = rng.normal(0, 0.3, HIDDEN).astype(np.float32)
        self.base = np.full(1, 1.5, np.float32)
        self.fitted = False

    def chunked(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts padded with zeros to whole chunks (with room for the last window), and the chunks of each."""
        sizes = np.diff(bounds)
        chunks = -(-(sizes + SPAN - 1) // CHUNK)
        ends = np.cumsum(chunks) * CHUNK
        buffer = np.zeros(int(ends[-1]) + CHUNK if len(ends) else CHUNK, np.uint8)
        shift = np.repeat(ends - chunks * CHUNK - bounds[:-1], sizes)
        buffer[np.arange(len(data)) + shift] = data
        # Each chunk with the first bytes of the text's next one, zeros after its last: no window sees another text.
        rows = buffer[: int(chunks.sum()) * CHUNK].reshape(-1, CHUNK)
        after = np.zeros((len(rows), SPAN - 1), np.uint8)
        after[:-1] = rows[1:, : SPAN - 1]
        after[np.cumsum(chunks) - 1] = 0
        return np.concatenate([rows, after], 1), chunks

    def pooled(self, buffer: np.ndarray, n: int) -> np.ndarray:
        """Largest answer of each filter in each of ``n`` chunks."""
        out = np.empty((n, FILTERS), np.float32)
        step = BLOCK // CHUNK
        for at in range(0, n, step):
            m = min(step, n - at)
            part = buffer[at : at + m]
            y = self.taps[0].take(part[:, :CHUNK], 0)
            for j in range(1, SPAN):
                y += self.taps[j].take(part[:, j : j + CHUNK], 0)
            out[at : at + m] = y.max(1)
        return out

    def head(self, best: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = np.concatenate([best, mean], 1)
        inner = (joined[:, :, None] * self.hidden).sum(1) + self.shift
        return joined, inner, (np.maximum(inner, 0) * self.out).sum(1) + self.base[0]

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(bounds) - 1)
        buffer, chunks = self.chunked(data, bounds)
        seen = np.maximum(self.pooled(buffer, int(chunks.sum())) + self.bias, 0)
        first = np.cumsum(chunks) - chunks
        best = np.maximum.reduceat(seen, first, axis=0)
        # In whole 2**-16ths, so that a text's mean doesn't depend on what else is in the batch.
        mean = np.add.reduceat(np.rint(seen.astype(np.float64) * 65536), first, axis=0) / 65536 / chunks[:, None]
        return sigmoid(self.head(best.astype(np.float64), mean)[2])

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 32, seed: int = 4, decay: float = 1e-4) -> None:
        self.fitted = True
        rng = np.random.default_rng(seed)
        adam = Adam([self.taps, self.bias, self.hidden, self.shift, self.out, self.base], 0.01)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                raw = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
                buffer, chunks = self.chunked(raw, np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])]))
                n = int(chunks.sum())
                place, pre = np.empty((n, FILTERS), np.int64), np.empty((n, FILTERS), np.float32)
                for lo in range(0, n, BLOCK // CHUNK):
                    part = buffer[lo : min(n, lo + BLOCK // CHUNK)]
                    answers = self.taps[0].take(part[:, :CHUNK], 0)
                    for j in range(1, SPAN):
                        answers += self.taps[j].take(part[:, j : j + CHUNK], 0)
                    place[lo : lo + len(part)] = answers.argmax(1)
                    pre[lo : lo + len(part)] = answers.max(1)
                pre += self.bias
                seen = np.maximum(pre, 0)
                first = np.cumsum(chunks) - chunks
                doc = np.repeat(np.arange(len(own)), chunks)
                best = np.maximum.reduceat(seen, first, axis=0)
                mean = np.add.reduceat(seen, first, axis=0) / chunks[:, None]
                joined, inner, z = self.head(best, mean.astype(np.float32))
                error = ((sigmoid(z) - y[own]) * weight[own] / len(own)).astype(np.float32)
                d_inner = error[:, None] * self.out * (inner > 0)
                d_joined = d_inner @ self.hidden.T
                top = seen == best[doc]
                share = np.add.reduceat(top.astype(np.float32), first, axis=0)
                d_seen = top * (d_joined[:, :FILTERS] / share)[doc] + (d_joined[:, FILTERS:] / chunks[:, None])[doc]
                d_seen = (d_seen * (pre > 0)).astype(np.float32)
                line = np.arange(n)[:, None]
                flat = np.arange(FILTERS)
                taps = np.stack([np.bincount((buffer[line, place + j].astype(np.int64) * FILTERS + flat).ravel(), d_seen.ravel(), 256 * FILTERS).reshape(256, FILTERS) for j in range(SPAN)])
                adam.step([taps + decay * self.taps, d_seen.sum(0), joined.T @ d_inner + decay * self.hidden, d_inner.sum(0), np.maximum(inner, 0).T @ error, error.sum(keepdims=True)])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fits on a bounded sample of labelled rows."""
    texts, _, y, shift = sample(docs, labels, label)
    model = Model()
    if len(set(y.tolist())) == 2:
        model.fit(texts, y)
        # The fit weighs both classes equally; scores are for classes as frequent as among all labelled rows.
        model.base += np.float32(shift + np.log(y.mean() / (1 - y.mean())))
    return model


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

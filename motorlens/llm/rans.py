"""Static range asymmetric numeral system for runs of token ids, vectorised over blocks and lanes.

A segment holds one frequency table that all its blocks share. Each block is coded on its own by
``LANES`` interleaved 64-bit states that emit 32-bit words into one stream. The segment's head lists
for each block where its words start (the checkpoint), how many ids it has and their CRC-32, so that
blocks can be decoded in any order or in parallel.

Layout (little-endian): 8 bytes magic; n ids, blocks, steps, lanes, table bits, symbols, words as
uint64; symbols and frequencies as uint32; word starts as uint64, counts and checksums as uint32; final
states as uint64; words as uint32.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"MLRANS01"
LANES = 64
STEPS = 512
_LOW = np.uint64(1 << 31)
_U32 = np.uint64(32)


def _table(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that sum to 2**bits, none zero, near the counts."""
    total = 1 << bits
    exact = counts.astype(np.float64) * (total / counts.sum())
    freq = np.maximum(1, np.floor(exact)).astype(np.int64)
    lack = total - int(freq.sum())
    if lack > 0:
        order = np.argsort(-(exact - freq), kind="stable")
        freq[np.resize(order, lack) if lack <= len(order) else order] += 1
        freq[int(np.argmax(counts))] += total - int(freq.sum())
    while lack < 0:
        order = np.argsort(-freq, kind="stable")
        order = order[freq[order] > 1][:-lack]
        freq[order] -= 1
        lack += len(order)
    return freq


def encode(ids: np.ndarray, lanes: int = LANES, steps: int = STEPS) -> bytes:
    """A segment of ``ids`` (uint32, any number of them)."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    if not n:
        return MAGIC + np.zeros(7, "<u8").tobytes()
    steps = min(steps, -(-n // lanes))
    size = lanes * steps
    blocks = -(-n // size)
    symbols, coded, counts = np.unique(ids, return_inverse=True, return_counts=True)
    bits = min(24, max(12, int(len(symbols) - 1).bit_length() + 3))
    freq = _table(counts, bits).astype(np.uint64)
    first = np.cumsum(freq) - freq
    filler = int(np.argmax(counts))
    padded = np.full(blocks * size, filler, np.int64)
    padded[:n] = coded
    padded = padded.reshape(blocks, steps, lanes)
    x = np.full((blocks, lanes), _LOW, np.uint64)
    words = np.empty((blocks, steps, lanes), np.uint32)
    sent = np.empty((blocks, steps, lanes), bool)
    room, k = np.uint64(63 - bits), np.uint64(bits)
    for t in range(steps - 1, -1, -1):
        s = padded[:, t]
        f = freq[s]
        big = x >= (f << room)
        words[:, t] = x.astype(np.uint32)
        sent[:, t] = big
        x = np.where(big, x >> _U32, x)
        q = x // f
        x = (q << k) + (x - q * f) + first[s]
    stream = words[sent]
    per = sent.reshape(blocks, -1).sum(1)
    sizes = np.minimum(size, n - size * np.arange(blocks))
    sums = np.array([zlib.crc32(ids[b * size : b * size + m].astype("<u4").tobytes()) for b, m in enumerate(sizes)])
    head = np.array([n, blocks, steps, lanes, bits, len(symbols), len(stream)], "<u8")
    parts = (head, symbols.astype("<u4"), freq.astype("<u4"), (np.cumsum(per) - per).astype("<u8"), sizes.astype("<u4"), sums.astype("<u4"), x.astype("<u8"), stream.astype("<u4"))
    return MAGIC + b"".join(p.tobytes() for p in parts)


class Segment:
    """Reads a segment: ``blocks`` of it, or all."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a segment of this format")
        self.n, self.blocks, self.steps, self.lanes, self.bits, m, w = map(int, np.frombuffer(data, "<u8", 7, 8))
        at = 64

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.symbols, self.freq = take("<u4", m), take("<u4", m).astype(np.uint64)
        self.starts, self.sizes, self.sums = take("<u8", self.blocks), take("<u4", self.blocks), take("<u4", self.blocks)
        self.states = take("<u8", self.blocks * self.lanes).reshape(self.blocks, -1) if self.blocks else None
        self.words = take("<u4", w)

    def decode(self, blocks: np.ndarray | None = None) -> np.ndarray:
        """Ids of the given blocks (all by default), each checked against its checksum."""
        which = np.arange(self.blocks) if blocks is None else np.asarray(blocks)
        if not len(which):
            return np.zeros(0, np.uint32)
        first = np.cumsum(self.freq) - self.freq
        of_slot = np.repeat(np.arange(len(self.freq)), self.freq.astype(np.int64))
        x = self.states[which].astype(np.uint64)
        at = self.starts[which].astype(np.int64)[:, None]
        words = np.append(self.words, np.uint32(0)).astype(np.uint64)
        k, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        out = np.empty((len(which), self.steps, self.lanes), np.int64)
        for t in range(self.steps):
            slot = x & mask
            s = of_slot[slot.astype(np.int64)]
            out[:, t] = s
            x = self.freq[s] * (x >> k) + slot - first[s]
            low = x < _LOW
            seen = np.cumsum(low, 1)
            x = np.where(low, (x << _U32) | words[np.minimum(at + np.maximum(seen - 1, 0), len(words) - 1)], x)
            at = at + seen[:, -1:]
        ids = self.symbols[out.reshape(len(which), -1)]
        sizes = self.sizes[which]
        for row, m, want in zip(ids, sizes, self.sums[which]):
            if zlib.crc32(row[:m].astype("<u4").tobytes()) != want:
                raise ValueError("a block's checksum differs")
        if (sizes == ids.shape[1]).all():
            return ids.reshape(-1)
        return np.concatenate([row[:m] for row, m in zip(ids, sizes)])

"""Media columns: payloads stored as progressive JPEG, read back, and turned into full-resolution RGB tensors.

A payload's 64-byte blocks are the coefficient blocks of the image (the format's unit), so that the
lossy steps of a photograph's way into JPEG don't touch them: reading the scans back gives every byte.
``media_streams`` makes the streams, ``saved`` or a table of one's own keeps them, ``media_features`` reads them back, and
``write_tensors`` writes the images as tensors of whole numbers.

Defined results: a null or empty text is one block of zero bytes; equal texts give equal streams and
values; repeated rows are stored each; an empty table gives no rows; extra columns are ignored. A text of more than ``PART``
bytes is a sequence of images, of which a task holds one at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg
from .op8_toxicity import _bytes
from .store import saved, small_batches, table
from .tokens import chunks

#: Text bytes stored and read at a time, and bytes of one image at most (whole blocks).
BYTES = 1_500_000
PART = 64 * 20_000
_TO_COEFFICIENT = np.array([b - 126 if b >= 128 else -b - 2 for b in range(256)], np.int16)


def store(data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Streams that hold the texts' bytes, each padded with zeros to whole blocks."""
    sizes = np.diff(bounds)
    blocks = np.maximum(1, -(-sizes // 64))
    shape = np.array([jpeg.layout(int(n)) for n in blocks])
    grid = jpeg.Grid(shape[:, 0], shape[:, 1])
    payload = np.zeros((grid.total, 64), np.uint8)
    payload.reshape(-1)[jpeg._ranges(64 * grid.first, sizes)] = data
    coefficients = np.zeros((grid.total, 64), np.int16)
    used = jpeg._ranges(grid.first, blocks)
    coefficients[used] = _TO_COEFFICIENT[payload[used]]
    return jpeg.write(coefficients, grid, [struct.pack(">QQ", n, b) for n, b in zip(sizes.tolist(), blocks.tolist())])


def load(streams: list[bytes]) -> tuple[list[tuple[int, bytes]], np.ndarray, jpeg.Grid]:
    """(unpadded size, payload) of each stream, then coefficients and grid for its pixels."""
    coefficients, grid, notes = jpeg.read(streams)
    raw = np.where(coefficients > 0, coefficients + 126, -coefficients - 2).astype(np.uint8)
    out = []
    for note, first in zip(notes, grid.first.tolist()):
        size, blocks = struct.unpack(">QQ", note)
        out.append((size, raw[first : first + blocks].tobytes()))
    return out, coefficients, grid


def feature_sums(images: list[np.ndarray]) -> np.ndarray:
    """For each tensor (height, width, 3): sums of the channels, of brightness and its square, and a histogram of brightness in 8 bins."""
    flat = np.concatenate([x.reshape(-1, 3) for x in images])
    size = np.array([x.shape[0] * x.shape[1] for x in images])
    first = np.cumsum(size) - size
    sums = np.add.reduceat(flat, first, axis=0, dtype=np.int64)
    light = flat.astype(np.uint16) @ np.array([77, 150, 29], np.uint16) >> 8
    bins = np.bincount((light >> 5) + np.repeat(8 * np.arange(len(images)), size), minlength=8 * len(images)).reshape(-1, 8)
    total = np.add.reduceat(light, first, dtype=np.int64)
    square = np.add.reduceat(light.astype(np.uint32) ** 2, first, dtype=np.int64)
    return np.concatenate([sums, total[:, None], square[:, None], bins], 1)


def feature_string(shapes: list[tuple[int, int]], sums: np.ndarray) -> str:
    """Sizes of a text's images, mean of each channel, spread of brightness and its histogram in thousandths, over all of them."""
    n = sum(w * h for w, h in shapes)
    r, g, b, s, q, *bins = sums.tolist()
    spread = (q * n - s * s) * 100 // (n * n)
    return "+".join(f"{w}x{h}" for w, h in shapes) + ";rgb=" + ",".join(f"{c * 100 // n}" for c in (r, g, b)) + f";var={spread};hist=" + ",".join(f"{1000 * x // n}" for x in bins)


def _groups(sizes: np.ndarray, limit: int):
    """Runs (from, to) of items of ``limit`` in all, or of one larger item."""
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield at, to
        at = to


def media_streams(docs: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, n_bytes, media): the streams of each text's images, in order."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in chunks(batches, limit=BYTES):
            data, bounds = _bytes(batch.column("text"))
            sizes = np.diff(bounds)
            parts = np.maximum(1, -(-sizes // part))
            ends = np.cumsum(parts)
            # Where each image's bytes begin and end.
            start = np.repeat(bounds[:-1], parts) + (np.arange(ends[-1]) - np.repeat(ends - parts, parts)) * part
            cuts = np.append(start, bounds[-1])
            streams: list[bytes] = []
            for at, to in _groups(np.diff(cuts), BYTES):
                streams += store(data[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(streams, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), lists], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media array<binary>")


def _regrouped(batches):
    """Batches of stored streams, joined to about ``BYTES`` of them each: many images are decoded side by side."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("media").flatten())).as_py() or 0
        if size >= BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _read_back(media):
    """For each group of images of a column of streams: (rows, streams, payloads, tensors)."""
    lists = media.combine_chunks() if isinstance(media, pa.ChunkedArray) else media
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    streams = lists.flatten()
    for at, to in _groups(np.array([len(x.as_buffer()) for x in streams], np.int64), BYTES):
        own = [x.as_py() for x in streams.slice(at, to - at)]
        found, coefficients, grid = load(own)
        yield rows[at:to].tolist(), own, found, jpeg.tensors(jpeg.mcu_pixels(coefficients, grid), grid)


def media_features(media: DataFrame) -> DataFrame:
    """Digests of what is read back from (doc_id, n_bytes, media): the payload, its last 64 bytes, the streams, and the feature of
    the images' tensors at full resolution, those that ``tensors`` gives."""
    small_batches(media.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in _regrouped(batches):
            n = batch.num_rows
            payload, stream = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            size, stored, n_bytes, tail, shapes, sums = [0] * n, [0] * n, [0] * n, [b""] * n, [[] for _ in range(n)], np.zeros((n, 13), np.int64)
            for rows, own, found, images in _read_back(batch.column("media")):
                for i, s, (k, p), image, x in zip(rows, own, found, images, feature_sums(images)):
                    payload[i].update(p)
                    stream[i].update(s)
                    size[i], stored[i], n_bytes[i], tail[i] = size[i] + len(p), stored[i] + len(s), n_bytes[i] + k, p[-64:]
                    shapes[i].append((image.shape[1], image.shape[0]))
                    sums[i] += x
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "payload_bytes": pa.array(size, pa.int64()), "payload_sha256": pa.array([x.hexdigest() for x in payload], pa.string()), "tail_crc32": pa.array(list(map(zlib.crc32, tail)), pa.int64()),
                "media_bytes": pa.array(stored, pa.int64()), "media_sha256": pa.array([x.hexdigest() for x in stream], pa.string()), "feature": pa.array([feature_string(a, b) for a, b in zip(shapes, sums)], pa.string()),
            })

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


class _Numbers:
    """Counts the images of each row, from 0."""

    def __init__(self):
        self.next: dict[int, int] = {}

    def __call__(self, row: int) -> int:
        n = self.next.get(row, 0)
        self.next[row] = n + 1
        return n


def payloads(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, part, payload) read back from the streams."""
    small_batches(media.sparkSession)

    def run(batches):
        for batch in _regrouped(batches):
            number = _Numbers()
            for rows, _, found, _ in _read_back(batch.column("media")):
                part = list(map(number, rows))
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(take), "n_bytes": batch.column("n_bytes").take(take), "part": pa.array(part, pa.int32()), "payload": pa.array([p for _, p in found], pa.binary())})

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, part int, payload binary")


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, part, height, width, rgb): each image as a tensor of height x width x 3 bytes at full resolution."""
    small_batches(media.sparkSession)

    def run(batches):
        for batch in _regrouped(batches):
            number = _Numbers()
            for rows, _, _, images in _read_back(batch.column("media")):
                part = list(map(number, rows))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "part": pa.array(part, pa.int32()), "height": pa.array([x.shape[0] for x in images], pa.int32()), "width": pa.array([x.shape[1] for x in images], pa.int32()), "rgb": pa.array([x.tobytes() for x in images], pa.binary())})

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, part int, height int, width int, rgb binary")


def write_tensors(media: DataFrame, path: str) -> None:
    """The tensors of all images as Parquet: about 2.3 bytes a byte of text."""
    tensors(media).write.option("compression", "zstd").parquet(path)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = saved(media_streams(table(spark, sf_dir, "documents", spread=True)), "media", compression="zstd")
    return media_features(stored)

"""Token-ID files: whole texts to ids, coded as static rANS segments in ascending doc_id order, and back.

``write_token_files`` writes a folder of Parquet files whose rows are segments (``part``, ``seq`` order
them; ``payload`` is the binary segment of ``rans`` behind a table of its documents).
``read_token_files`` decodes them again.

Defined results: a null or empty text has no ids but the end id; equal doc_ids are ordered by a hash of
their ids; a null doc_id comes first; an empty table makes a folder without segments; extra columns
are ignored. A very long text is encoded at once; its segment holds it whole.

Texts are encoded where they are read. Only their ids, two bytes each where the vocabulary allows it, are sorted.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .store import dropped, new_path, saved, small_batches, table
from .tokens import chunks, encoder, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Ids of one segment, at least (it is closed after the text that passes this).
SEGMENT_IDS = 2_000_000
_SEGMENT = "part int, seq int, n_docs long, n_tokens long, before long, payload binary"


def pack_segment(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment with the table of its documents: count, null marks, doc_ids, sizes, then the rANS bytes."""
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return np.array([len(doc_ids)], "<u8").tobytes() + null.tobytes() + keys.tobytes() + np.asarray(sizes, "<u8").tobytes() + rans.encode(ids)


def unpack_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    null = np.frombuffer(data, np.uint8, n, 8)
    keys = np.frombuffer(data, "<i8", n, 8 + n)
    sizes = np.frombuffer(data, "<u8", n, 8 + 9 * n).astype(np.int64)
    ids = rans.Segment(data[8 + 17 * n :]).decode()
    return [None if z else int(k) for z, k in zip(null, keys)], sizes, ids


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes ``docs`` (doc_id, text) and writes segments to ``path``, in ascending doc_id order over (part, seq)."""
    small_batches(docs.sparkSession)
    file = tokenizer_path(tokenizer)

    def encode(batches):
        take = encoder(file, False)
        kind = "<u2" if max(take.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in chunks(batches):
            flat, bounds = take.encode(batch.column("text"))
            full = np.insert(flat, bounds[1:], end_id).astype(kind)
            ends = (bounds + np.arange(len(bounds))) * full.itemsize
            # Offsets of a binary array are 32-bit; a chunk holds few megabytes or one text.
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(full.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), raw.cast(pa.binary()), pa.array(np.full(len(raw), full.itemsize, np.int8))], names=["doc_id", "ids", "bytes"])

    def segments(batches):
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        keys, sizes, ids, held = [], [], [], 0

        def row():
            flat = np.concatenate(ids)
            payload = pack_segment(keys, np.concatenate(sizes), flat)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(keys)], pa.int64()), "n_tokens": pa.array([len(flat)], pa.int64()), "before": pa.array([before], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for key, raw, width in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("bytes").to_pylist()):
                one = np.frombuffer(raw.as_buffer(), f"<u{width}").astype(np.uint32)
                keys.append(key)
                sizes.append([len(one)])
                ids.append(one)
                held += len(one)
                if held >= segment_ids:
                    yield row()
                    keys, sizes, ids, held, seq, before = [], [], [], 0, seq + 1, before + held
        if keys:
            yield row()

    tie = F.xxhash64("ids")
    # Written once: the range partitioning reads its input twice, and encoding is what costs.
    encoded = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids binary, bytes byte"), "encoded", compression="zstd")
    ordered = encoded.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    ordered.mapInArrow(segments, _SEGMENT).write.parquet(path)
    dropped(encoded)


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids
    (little-endian unsigned 32-bit). Segments are decoded where they are read; only their sizes are summed up."""
    files = spark.read.schema(_SEGMENT).parquet(path)
    # One row for each task that wrote segments; a segment knows what comes before it in its task.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def decode(batches):
        for batch in batches:
            for base, payload in zip(batch.column("base").to_pylist(), batch.column("payload")):
                keys, sizes, ids = unpack_segment(payload.as_py())
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                cuts = [raw[4 * a : 4 * b] for a, b in zip(ends - sizes, ends)]
                out = {"doc_id": pa.array(keys, pa.int64()), "start": pa.array(base + ends - sizes, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64())}
                if keep_ids:
                    out["ids"] = pa.array([bytes(c) for c in cuts], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    # A segment's payload is some megabytes, so few of them make a batch.
    small_batches(spark, 16)
    return files.join(F.broadcast(starts), "part").select((F.col("base") + F.col("before")).alias("base"), "payload").mapInArrow(decode, schema)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents", spread=True), path)
    return read_token_files(spark, path, keep_ids=False)

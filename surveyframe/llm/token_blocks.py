"""Token ids in patched frame-of-reference blocks.

The format is a folder of Parquet files written by Spark, so a lost task leaves
nothing behind and every store that Spark writes will do.  One row is a segment
of a shard; shards follow each other in ascending document order.  A segment's
``payload`` is, in little-endian order:

* ``PFR1``, number of ids (u4), ids per block (u4), number of blocks (u4)
* the index: the byte offset of each block after the index, and the end (u4 each)
* the blocks: least id (u4), width in bits (u1), unused (u1), number of outliers
  (u2); the ids less the least one, ``width`` low bits each, least bit first; the
  outliers' places (u2 each) and what they hold above the low bits (u4 each)

The width holds a share ``percentile`` of the block's ids; the rest are outliers.
The other columns place documents: which document each run of ids belongs to,
its length, and how many ids of the document came before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import words as W
from .ship import ship
from .tokenizing import encoder

BLOCK = 256
SEGMENT = 1 << 16
PERCENTILE = 0.9
# Texts that are encoded at a time: each distinct token among them is looked up once.
ENCODED_BYTES = 4 << 20
MAGIC = b"PFR1"

SEGMENTS = ("shard int, segment bigint, start bigint, n_ids bigint, payload binary,"
            " doc_no array<bigint>, doc_id array<bigint>, length array<bigint>,"
            " before array<bigint>")


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bits of each value, least bit first, row by row as bytes."""
    rows, n = values.shape
    groups = -(-n // 8)  # eight values take ``width`` whole bytes
    padded = np.zeros((rows, 8 * groups), np.uint64 if width > 25 else np.uint32)
    padded[:, :n] = values & np.uint32((1 << width) - 1)
    columns = np.ascontiguousarray(padded.reshape(-1, 8).T)
    out = np.zeros((width, rows * groups), np.uint8)
    for j in range(8):
        at, shift = divmod(j * width, 8)
        moved = columns[j] << columns.dtype.type(shift)
        for k in range(-(-(width + shift) // 8) if width else 0):
            out[at + k] |= (moved >> columns.dtype.type(8 * k)).astype(np.uint8)
    return out.T.reshape(rows, groups * width)[:, :(n * width + 7) // 8]


def _unpack_bits(packed: np.ndarray, n: int, width: int) -> np.ndarray:
    """``n`` values a row from the bytes of :func:`_pack_bits`."""
    rows, groups = len(packed), -(-n // 8)
    padded = np.zeros((rows, groups * width), np.uint8)
    padded[:, :packed.shape[1]] = packed
    kind = np.uint64 if width > 25 else np.uint32
    columns = np.ascontiguousarray(padded.reshape(rows * groups, width).T).astype(kind)
    out = np.zeros((8, rows * groups), np.uint32)
    for j in range(8):
        at, shift = divmod(j * width, 8)
        held = np.zeros(rows * groups, kind)
        for k in range(-(-(width + shift) // 8) if width else 0):
            held |= columns[at + k] << kind(8 * k)
        out[j] = (held >> kind(shift)) & kind((1 << width) - 1)
    return out.T.reshape(rows, 8 * groups)[:, :n]


def pack(ids: np.ndarray, percentile: float = PERCENTILE, block: int = BLOCK) -> bytes:
    """One segment's payload."""
    n = len(ids)
    count = -(-n // block)
    table = np.empty(count * block, np.uint32)
    table[:n] = ids
    if n:
        table[n:] = ids[-1]
    table = table.reshape(count, block)
    least = table.min(axis=1, initial=np.uint32(2**32 - 1))
    table = table - least[:, None]
    place = min(block - 1, int(np.ceil(percentile * block)) - 1)
    chosen = np.partition(table, place, axis=1)[:, place] if count else np.zeros(0, np.uint32)
    widths = np.frexp(chosen.astype(np.float64))[1].astype(np.int64)
    blocks: list[bytes] = [b""] * count
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        part = table[rows]
        packed = _pack_bits(part, width)
        high = (part.astype(np.uint64) >> np.uint64(width)).astype(np.uint32)
        for row, i in enumerate(rows.tolist()):
            outliers = np.flatnonzero(high[row])
            blocks[i] = b"".join((
                struct.pack("<IBBH", int(least[i]), width, 0, len(outliers)),
                packed[row].tobytes(), outliers.astype("<u2").tobytes(),
                high[row, outliers].astype("<u4").tobytes()))
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u4")
    return b"".join((MAGIC, struct.pack("<III", n, block, count), starts.tobytes(), *blocks))


def _header(payload: bytes) -> tuple[int, int, np.ndarray, int]:
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of packed token ids")
    n, block, count = struct.unpack_from("<III", payload, 4)
    starts = np.frombuffer(payload, "<u4", count + 1, 16).astype(np.int64)
    return n, block, starts, 16 + 4 * (count + 1)


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from place ``first`` up to ``last``; only their blocks are read."""
    n, block, starts, body = _header(payload)
    last = n if last is None else min(last, n)
    if last <= first:
        return np.zeros(0, np.uint32)
    low = first // block
    picked = np.arange(low, -(-last // block))
    at = body + starts[picked]
    data = np.frombuffer(payload, np.uint8)
    heads = data[at[:, None] + np.arange(8)].copy().view("<u4")
    widths = heads[:, 1] & 0xFF
    outliers = heads[:, 1] >> 16
    out = np.empty((len(picked), block), np.uint32)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        size = (block * width + 7) // 8
        packed = data[(at[rows] + 8)[:, None] + np.arange(size)]
        out[rows] = _unpack_bits(packed, block, width)
    for row in np.flatnonzero(outliers).tolist():
        width, count = int(widths[row]), int(outliers[row])
        place = int(at[row]) + 8 + (block * width + 7) // 8
        where = np.frombuffer(payload, "<u2", count, place)
        high = np.frombuffer(payload, "<u4", count, place + 2 * count)
        out[row, where] |= (high.astype(np.uint64) << np.uint64(width)).astype(np.uint32)
    out += heads[:, 0][:, None]
    return out.ravel()[first - low * block:last - low * block]


def _encode(path: str, end_id: int | None, percentile: float, segment_ids: int):
    """Task function: one shard's documents, in order, to its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(path).encode_all
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        shard, limit = TaskContext.get().partitionId(), 4 * segment_ids
        buffer = bytearray()
        runs: list[list] = []  # [document in the shard, doc_id, bytes, bytes before]
        segment = doc_no = 0

        def row(size: int) -> pa.RecordBatch:
            nonlocal segment, buffer
            ids = np.frombuffer(bytes(buffer[:size]), "<u4")
            del buffer[:size]
            columns = [[shard], [segment], [segment * segment_ids], [len(ids)],
                       [pack(ids, percentile)], [[r[0] for r in runs]], [[r[1] for r in runs]],
                       [[r[2] // 4 for r in runs]], [[r[3] // 4 for r in runs]]]
            segment += 1
            runs.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, ARROW)], NAMES)

        for batch in W.pieces(batches, "text", ENCODED_BYTES):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for doc_id, parts in zip(batch.column("doc_id").to_pylist(), encode_all(texts)):
                before = 0
                for part in chain(parts, (end,)):
                    while part:
                        taken = part[:limit - len(buffer)]
                        part = part[len(taken):]
                        buffer += taken
                        if runs and runs[-1][0] == doc_no:
                            runs[-1][2] += len(taken)
                        else:
                            runs.append([doc_no, doc_id, len(taken), before])
                        before += len(taken)
                        if len(buffer) == limit:
                            yield row(limit)
                if not before:  # no end id and no text: an empty run keeps the document
                    runs.append([doc_no, doc_id, 0, 0])
                doc_no += 1
        if runs:
            yield row(len(buffer))

    return run


NAMES = [part.split()[0] for part in SEGMENTS.split(", ")]
ARROW = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 4]


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = 2,
    percentile: float = PERCENTILE, segment_ids: int = SEGMENT,
) -> None:
    """Write the ids of ``docs`` (doc_id, text) to the folder ``path`` in ascending doc_id order.

    ``tokenizer`` names a vocabulary file that every executor has; ``end_id``
    follows each document.  A missing text is an empty one.  Rows without doc_id
    come first; rows that share one follow each other, each a document of its own.
    """
    ship(docs.sparkSession)
    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
               .repartitionByRange("doc_id", F.xxhash64("text"))
               .sortWithinPartitions("doc_id", F.xxhash64("text"), "text"))
    ordered.mapInArrow(_encode(tokenizer, end_id, percentile, segment_ids), SEGMENTS).write.option(
        "compression", "none").parquet(path)


def _decode(full: bool):
    """Task function: segments to the runs of their documents, with their ids or their crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, start, payload, numbers, names, lengths, before = (
                    batch.column(c)[row] for c in (
                        "shard", "start", "payload", "doc_no", "doc_id", "length", "before"))
                ids = unpack(payload.as_buffer().to_pybytes())
                sizes = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(sizes)
                data = [ids[e - n:e] for n, e in zip(sizes.tolist(), ends.tolist())]
                value = pa.array(data, pa.list_(pa.int64())) if full else pa.array(
                    [zlib.crc32(d.astype("<u4").tobytes()) for d in data], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard.as_py()] * len(data), pa.int32()), numbers.values,
                    names.values, before.values, pa.array(sizes),
                    pa.array(start.as_py() + ends - sizes), value,
                ], ["shard", "doc_no", "doc_id", "before", "length", "place",
                    "ids" if full else "crc"])

    return run


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The ids of ``path`` as runs (shard, doc_no, doc_id, before, length, place, ids); the runs of
    a document, in the order of ``before``, are its ids."""
    ship(spark)
    columns = "shard int, doc_no bigint, doc_id bigint, before bigint, length bigint, place bigint"
    return spark.read.parquet(path).mapInArrow(_decode(True), f"{columns}, ids array<bigint>")


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the crc32 of each document from those of its runs, which needs their lengths
    but not their ids."""
    for batch in batches:
        totals = []
        for parts in batch.column("parts").to_pylist():
            total = 0
            for part in sorted(parts, key=lambda p: p["before"]):
                if total:
                    zeros = bytes(4 * part["length"])
                    total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros)
                total ^= part["crc"]
            totals.append(total)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("shard", "doc_id", "place", "n_tokens")),
             pa.array(totals, pa.int64())], ["shard", "doc_id", "place", "n_tokens", "crc"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files of ``path``.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is taken
    over its ids as little-endian unsigned 32-bit integers.
    """
    ship(spark)
    segments = spark.read.parquet(path)
    # One row per shard: as many as the files were written by tasks.
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select(
        "shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("shard_start"))
    columns = "shard int, doc_no bigint, doc_id bigint, before bigint, length bigint, place bigint"
    runs = segments.mapInArrow(_decode(False), f"{columns}, crc bigint")
    parts = F.collect_list(F.struct("before", "length", "crc"))
    documents = runs.groupBy("shard", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("place").alias("place"),
        F.sum("length").alias("n_tokens"), parts.alias("parts"))
    joined = documents.mapInArrow(
        _join_runs, "shard int, doc_id bigint, place bigint, n_tokens bigint, crc bigint")
    return joined.join(shards, "shard").select(
        "doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens",
        F.col("crc").alias("ids_crc32"))

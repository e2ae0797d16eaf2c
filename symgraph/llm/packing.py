"""Operator 3: packing along a space-filling curve.

A document's hashed byte 4-gram vector is projected to DIMS random directions and placed on a Hilbert curve. Rows are
range-partitioned and sorted by curve key, and each partition cuts its token stream into full sequences, so neighbours on
the curve share sequences. Only the tail of a partition is shorter; it is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm import tokens
from symgraph.llm.common import slices

DIMS, BITS, BUCKET_BITS = 4, 12, 10
BUCKETS = 1 << BUCKET_BITS
SEQUENCE = 2048
#: Bytes of text for each range partition, and partitions at most: the driver samples some twenty keys for each.
PARTITION_BYTES, MOST_PARTITIONS = 64 << 20, 100_000


@lru_cache(maxsize=1)
def directions() -> np.ndarray:
    """BUCKETS x DIMS signs: the projection of the hashed vector, from a fixed seed."""
    return np.random.default_rng(17).choice(np.array([-1.0, 1.0]), size=(BUCKETS, DIMS))


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index (int64) of points, one row each of unsigned coordinates below 2**bits; the transform from axes to the transposed index is Skilling's (2004)."""
    x = axes.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> level) & 1)
    return key


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Each text's place on the curve (null: as empty). Texts of fewer than four bytes have the middle of all axes."""
    column = texts.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    mean = np.zeros((len(sizes), DIMS))
    signs = directions()
    for i in np.flatnonzero(sizes >= 4):
        own = data[at[i] : at[i] + sizes[i]]
        gram = np.ndarray((len(own) - 3,), "<u4", own, 0, (1,)) * np.uint32(2654435761) >> np.uint32(32 - BUCKET_BITS)
        mean[i] = np.bincount(gram.view(np.int32), minlength=BUCKETS) @ signs / len(gram)
    axes = ((np.tanh(mean * 6) + 1) * ((1 << BITS) - 1) / 2).astype(np.int64)
    return hilbert(axes)


def curve_key(text: Column) -> Column:
    @F.arrow_udf("long")
    def key(x: pa.Array) -> pa.Array:
        return pa.array(curve_keys(x))

    return key(text)


PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def tail_lengths(n: int, size: int) -> list[int]:
    """How the last n < size tokens of a partition are cut: at powers of two, largest first."""
    return [1 << b for b in range(size.bit_length(), -1, -1) if n >> b & 1]


class _Packer:
    """Cuts a stream of documents into sequences; holds at most one unfinished sequence."""

    def __init__(self, size: int, base: int, with_ids: bool):
        self.size, self.sequence, self.with_ids, self.open = size, base, with_ids, []

    def _row(self, doc_id, start, ids, total, offset) -> tuple:
        raw = ids.astype("<u4").tobytes()
        return (doc_id, start, len(ids), zlib.crc32(raw), total, self.sequence, offset, raw if self.with_ids else None)

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        used = sum(len(x[2]) for x in self.open)
        start = 0
        while start < len(ids):
            piece = ids[start : start + self.size - used]
            self.open.append((doc_id, start, piece, len(ids)))
            start, used = start + len(piece), used + len(piece)
            if used == self.size:
                yield from self.close([self.size])
                used = 0

    def close(self, lengths: list[int] | None = None) -> Iterator[tuple]:
        """Emit what is open, as sequences of these lengths (default: powers of two)."""
        waiting, self.open = self.open, []
        lengths = tail_lengths(sum(len(x[2]) for x in waiting), self.size) if lengths is None else lengths
        room = lengths.pop(0) if lengths else 0
        offset = 0
        for doc_id, start, ids, total in waiting:
            while len(ids):
                part = ids[: room - offset]
                yield self._row(doc_id, start, part, total, offset)
                start, ids, offset = start + len(part), ids[len(part) :], offset + len(part)
                if offset == room:
                    self.sequence, offset, room = self.sequence + 1, 0, lengths.pop(0) if lengths else 0


def pack(docs: DataFrame, tokenizer_path: str | None = None, sequence_tokens: int = SEQUENCE, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian uint32; null without with_ids).

    Null texts are empty: they are one piece with just end_id. Null ids stay null. Repeated rows are packed each. Of an
    empty table nothing is returned. Ties on the curve are ordered by document, so that copies spread over partitions.
    Other columns, whatever their names, are ignored. sequence_id is unique, not gapless, over partitions.
    """
    path = tokenizer_path or tokens.default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTITIONS, -(-size // PARTITION_BYTES))
    rows = rows.withColumn("key", curve_key(F.col("text"))).withColumn("tie", F.xxhash64("doc_id"))
    rows = rows.repartitionByRange(max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "key", "tie").sortWithinPartitions("key", "tie", "doc_id", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = _Packer(sequence_tokens, TaskContext.get().partitionId() << 32, with_ids), []
        for batch in slices(batches, "text", 16_000_000):
            ids, offsets = tokens.encode_with_end(batch.column(1), path, end_id)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                out += packer.add(doc_id, ids[offsets[i] : offsets[i + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECE)], schema=PIECE) if out else pa.RecordBatch.from_pylist([], PIECE)
            out = []
        if out := list(packer.close()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECE)], schema=PIECE)

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids binary"
    return rows.mapInArrow(run, kinds)

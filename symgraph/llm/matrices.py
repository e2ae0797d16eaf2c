"""Operator 8: token-id output. Best-fit-decreasing packing with a segment tree over free room.

No shuffle: each partition packs buffers of bounded size. A document longer than a row is first split, losslessly, into
full rows and a rest. Each packed row carries its ids, the cumulative segment lengths and the position resets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm import tokens
from symgraph.llm.common import slices

ROW_TOKENS = 2048
#: Tokens held before a buffer is packed: bounds a task's memory.
BUFFER_TOKENS = 4_000_000


class RoomTree:
    """Segment tree over free room 0..size: how many open bins have it. fit(n): the smallest room of at least n."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = np.zeros(2 * self.width, np.int64)

    def add(self, room: int, n: int = 1) -> None:
        i = room + self.width
        while i:
            self.count[i] += n
            i >>= 1

    def fit(self, need: int) -> int:
        """Smallest room >= need that an open bin has; -1 if there is none."""
        i = need + self.width
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:  # the right sibling holds larger rooms
                i += 1
                while i < self.width:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indexes into lengths (each 1..size): longest first, into the fullest bin that it fits; ties by index."""
    tree, open_at, bins = RoomTree(size), [[] for _ in range(size + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.fit(lengths[i])
        if room < 0:
            bins.append([])
            at, room = len(bins) - 1, size
        else:
            at = open_at[room].pop()
            tree.add(room, -1)
        bins[at].append(i)
        if rest := room - lengths[i]:
            open_at[rest].append(at)
            tree.add(rest)
    return bins


MATRIX = pa.schema(
    [("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())]
)
KINDS = "sequence_id long, n_tokens long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


def token_matrices(docs: DataFrame, tokenizer_path: str | None = None, row_tokens: int = ROW_TOKENS, end_id: int = 1, pad_id: int = 0, buffer_tokens: int = BUFFER_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed row: sequence_id, n_tokens (before padding), doc_ids and starts of its segments, cu_seqlens (from 0 to n_tokens),
    input_ids and position_ids (little-endian uint32, row_tokens each, padded with pad_id and 0; positions restart at each segment).

    Null texts are empty: end_id alone. Null ids stay null. Repeated rows are written each. An empty table gives no rows.
    Other columns, whatever their names, are ignored. sequence_id is unique, not gapless, over partitions.
    """
    path = tokenizer_path or tokens.default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def emit(pieces: list[tuple], first: int) -> pa.RecordBatch:
        out = []
        for k, members in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], row_tokens)):
            own = [pieces[i] for i in members]
            cuts = np.concatenate([[0], np.cumsum([len(p[2]) for p in own])]).astype(np.int32)
            ids, positions = np.full(row_tokens, pad_id, "<u4"), np.zeros(row_tokens, "<u4")
            ids[: cuts[-1]] = np.concatenate([p[2] for p in own])
            positions[: cuts[-1]] = np.arange(cuts[-1]) - np.repeat(cuts[:-1], np.diff(cuts))
            out.append((first + k, int(cuts[-1]), [p[0] for p in own], [p[1] for p in own], cuts.tolist(), ids.tobytes(), positions.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), MATRIX)], schema=MATRIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id, held, pieces = TaskContext.get().partitionId() << 32, 0, []
        for batch in slices(batches, "text", 16_000_000):
            ids, offsets = tokens.encode_with_end(batch.column(1), path, end_id)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                own = ids[offsets[i] : offsets[i + 1]]
                pieces += ((doc_id, at, own[at : at + row_tokens]) for at in range(0, len(own), row_tokens))
                held += len(own)
            if held >= buffer_tokens:
                yield (done := emit(pieces, next_id))
                next_id, held, pieces = next_id + done.num_rows, 0, []
        if pieces:
            yield emit(pieces, next_id)

    return rows.mapInArrow(run, KINDS)


def matrix_digests(matrices: DataFrame) -> DataFrame:
    """The rows of token_matrices with ids and positions as CRC-32 (of the written little-endian bytes)."""
    return matrices.select("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))

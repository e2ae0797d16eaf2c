"""Rank and labels over a graph packed into arrays: nodes are numbers, and neighbours lie in blocks of nodes, shuffled once.

A round reads the blocks and the state of all nodes (4 or 8 bytes a node, sent to each worker) and gives back each block's
part of the next state, so no round shuffles arcs. What the driver holds is the ids and one state, at most NODES of them;
larger graphs take the joins of `iterative`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.tables import materialize

#: Nodes of which ids and state may lie in memory at once: 8 bytes each.
NODES = 40_000_000
#: Entries (arcs, from either end) of a block, about; arcs that a task numbers at a time.
ENTRIES, CHUNK = 1 << 21, 1 << 21


@dataclass(frozen=True)
class Packed:
    """ids, sorted; blocks (block, out_at, out, in_at, into): of the nodes whose number leaves `block` when divided by n_blocks, where the neighbours of each begin, and their numbers."""

    ids: np.ndarray
    shared_ids: Broadcast
    blocks: DataFrame
    n_blocks: int


def pack(arcs: DataFrame, written: bool = False) -> Packed | None:
    """The graph of arcs (src, dst), repeated ones included, which are written first unless they are a table; None if it has no nodes or over NODES of them."""
    arcs = arcs.where("src is not null and dst is not null").select(F.col("src").cast("long"), F.col("dst").cast("long"))
    arcs = arcs if written else materialize(arcs, "arcs")
    nodes = materialize(arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    if not 0 < nodes.count() <= NODES:
        return None
    ids = np.sort(nodes.toArrow().column("node").to_numpy())
    shared = arcs.sparkSession.sparkContext.broadcast(ids)
    n = max(1, -(-2 * arcs.count() // ENTRIES))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= CHUNK:
                yield _dealt(shared.value, held, n)
                held, size = [], 0
        if size:
            yield _dealt(shared.value, held, n)

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        q = key[0].as_py()
        out = {"block": [q]}
        for outgoing, at, to in ((True, "out_at", "out"), (False, "in_at", "into")):
            own, other = (np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x, o in zip(rows.column(c), rows.column("outgoing")) if o.as_py() == outgoing] or [np.empty(0, np.int32)]) for c in ("own", "other"))
            counts = np.bincount(own // n, minlength=len(range(q, len(shared.value), n)))
            out[at] = [np.concatenate([[0], np.cumsum(counts)]).astype(np.int64).tobytes()]
            out[to] = [other[np.argsort(own, kind="stable")].tobytes()]
        return pa.table(out, schema=pa.schema([("block", pa.int32()), *[(c, pa.binary()) for c in ("out_at", "out", "in_at", "into")]]))

    dealt = arcs.mapInArrow(number, "block int, outgoing boolean, own binary, other binary").repartition(n, "block")
    blocks = dealt.groupBy("block").applyInArrow(block, "block int, out_at binary, out binary, in_at binary, into binary")
    return Packed(ids, shared, materialize(blocks, "blocks"), n)


def _dealt(ids: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.RecordBatch:
    """Arcs by number, dealt to the blocks of both of their ends."""
    src, dst = (np.searchsorted(ids, np.concatenate([h[i] for h in held])).astype(np.int32) for i in (0, 1))
    rows: dict[str, list] = {"block": [], "outgoing": [], "own": [], "other": []}
    for outgoing, own, other in ((True, src, dst), (False, dst, src)):
        order = np.argsort(own % n, kind="stable")
        own, other = own[order], other[order]
        ends = np.searchsorted(own % n, np.arange(n + 1))
        for q in np.flatnonzero(np.diff(ends)):
            a, b = ends[q], ends[q + 1]
            rows["block"].append(int(q)), rows["outgoing"].append(outgoing), rows["own"].append(own[a:b].tobytes()), rows["other"].append(other[a:b].tobytes())
    return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("block", pa.int32()), ("outgoing", pa.bool_()), ("own", pa.binary()), ("other", pa.binary())]))


def _array(scalar: pa.BinaryScalar, kind) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), kind)


def _round(graph: Packed, columns: list[str], state: np.ndarray, step) -> np.ndarray:
    """The next state: step(state, arrays of a block) gives that of the block's nodes."""
    spark = graph.blocks.sparkSession
    shared, kind = spark.sparkContext.broadcast(state), state.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                arrays = [_array(batch.column(c)[i], np.int64 if c.endswith("_at") else np.int32) for c in columns]
                new = step(shared.value, *arrays).astype(kind)
                yield pa.RecordBatch.from_pydict({"block": [batch.column("block")[i].as_py()], "new": [new.tobytes()]}, schema=pa.schema([("block", pa.int32()), ("new", pa.binary())]))

    new = np.empty_like(state)
    for row in graph.blocks.select("block", *columns).mapInArrow(run, "block int, new binary").collect():
        new[row.block :: graph.n_blocks] = np.frombuffer(row.new, kind)
    shared.destroy()
    return new


def _rows(graph: Packed, state: np.ndarray, value: str, named: bool) -> DataFrame:
    """(node, value) of all nodes; named: the state is numbers of nodes."""
    shared, ids, n = graph.blocks.sparkSession.sparkContext.broadcast(state), graph.shared_ids, graph.n_blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q in batch.column("block").to_pylist():
                own = shared.value[q::n]
                yield pa.RecordBatch.from_pydict({"node": ids.value[q::n], value: ids.value[own] if named else own})

    out = materialize(graph.blocks.select("block").mapInArrow(run, f"node long, {value} {'long' if named else 'double'}"), value)
    shared.destroy()
    return out


def _brought(state: np.ndarray, at: np.ndarray, into: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), weights=state[into], minlength=len(at) - 1)


def pagerank(graph: Packed, rounds: int, damping: float) -> DataFrame:
    """As iterative.pagerank."""
    n = _round(graph, ["out_at"], np.zeros(len(graph.ids)), lambda _, at: np.diff(at))
    rank = np.ones(len(graph.ids))
    for _ in range(rounds):
        rank = 1 - damping + damping * _round(graph, ["in_at", "into"], np.divide(rank, n, out=np.zeros_like(rank), where=n > 0), _brought)
    return _rows(graph, rank, "rank", False)


def _elected(label: np.ndarray, out_at: np.ndarray, out: np.ndarray, in_at: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Of each node's neighbours the most frequent label, ties the least; every node has neighbours."""
    nodes = np.arange(len(out_at) - 1, dtype=np.int64)
    votes = np.concatenate([np.repeat(nodes << 32, np.diff(out_at)) | label[out], np.repeat(nodes << 32, np.diff(in_at)) | label[into]])
    votes.sort()
    first = np.flatnonzero(np.concatenate([[True], votes[1:] != votes[:-1]]))
    n, what = np.diff(np.append(first, len(votes))), votes[first]
    begin = np.searchsorted(what >> 32, nodes)
    most = np.repeat(np.maximum.reduceat(n, begin), np.diff(np.append(begin, len(n))))
    best = np.flatnonzero(n == most)
    return what[best[np.searchsorted(what[best] >> 32, nodes)]] & 0xFFFFFFFF


def label_propagation(graph: Packed, rounds: int) -> DataFrame:
    """As iterative.label_propagation."""
    label = np.arange(len(graph.ids), dtype=np.int32)
    for _ in range(rounds):
        label = _round(graph, ["out_at", "out", "in_at", "into"], label, _elected)
    return _rows(graph, label, "label", True)

"""Operator 10: SimHash near-duplicates with a Gray-order hierarchical index.

Every document gets a 64-bit fingerprint. Distinct fingerprints meet in buckets that share one of four 16-bit blocks
(three differing bits leave at least one block whole, so no link is lost). Inside a task the fingerprints of each bucket
are sorted by Gray rank and built into a tree whose upper nodes hold the bits that all fingerprints below share. Pairs
of nodes are walked from the roots: a pair whose shared bits already differ in more places than allowed is pruned whole,
a pair that can't differ in more is linked whole, and a pair that is linked already is not opened. Tasks emit a spanning
forest, and the components of the forests are found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import LOWER_TABLE, byte_texts, materialize, slices, text_hashes

BLOCKS = 4
FANOUT = 8
#: Fingerprints of a bucket above which it is dealt over several tasks, each with two parts of it.
BUCKET_LIMIT = 1_000_000
#: Node pairs opened at once.
PAIRS = 400_000
#: Columns of text_hashes.
HASHES = ("_h1", "_h2")

_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, width: int = 3) -> list[int]:
    """XXH64 (seed 42) of each run of `width` words, repeats included; of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER_TABLE).split()
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), 42)] if words else []
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes[:-1])])
    first = starts[: len(words) - width + 1]
    last = (starts + sizes - 1)[width - 1 :]
    return list(map(xxh64_intdigest, map(joined.__getitem__, map(slice, first.tolist(), last.tolist())), repeat(42)))


def fingerprints(texts: Iterator[bytes], width: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is 1 if it is set in over half the hashes. Bits are counted in byte lanes, up to 255 hashes a lane."""
    hashes, chunk_starts, chunk_doc, counts = [], [], [], []
    for doc, text in enumerate(texts):
        own = shingle_hashes(text, width)
        chunk_starts += range(len(hashes), len(hashes) + len(own), 255)
        chunk_doc += [doc] * -(-len(own) // 255)
        counts.append(len(own))
        hashes += own
    n = np.array(counts, np.int64)
    ones = np.zeros((len(counts), 64), np.int64)
    if hashes:
        lanes = _SPREAD[np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)]
        partial = np.add.reduceat(lanes, np.array(chunk_starts), axis=0).view(np.uint8).reshape(-1, 64)
        first = np.flatnonzero(np.diff(np.array(chunk_doc), prepend=-1))
        ones[n > 0] = np.add.reduceat(partial.astype(np.int64), first, axis=0)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of x in the sequence of 64-bit Gray codes."""
    r = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(shift)
    return r


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a[i] and b[i]; parent[x] is the root of x before and after."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)
    return parent


def link_forest(keys: np.ndarray, fps: np.ndarray, most: int = 3, fanout: int = FANOUT) -> np.ndarray:
    """For rows in order of bucket key: the index of each row's representative among the rows of its bucket that links of at most `most` differing bits reach.

    `keys` numbers the buckets. Within each, rows are put in Gray order and indexed; see the module's docstring.
    """
    order = np.lexsort((gray_rank(fps), keys))
    keys, fp = keys[order], fps[order]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [(np.full(len(fp), full), fp, np.arange(len(fp)), np.arange(len(fp)) + 1, keys)]  # mask of shared bits, their pattern, rows from, to, bucket
    while True:
        mask, pattern, lo, hi, key = levels[-1]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        if len(new) == len(key):
            break
        place = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
        starts = np.flatnonzero(place % fanout == 0)
        some, every = np.bitwise_or.reduceat(pattern, starts), np.bitwise_and.reduceat(pattern, starts)
        shared = np.bitwise_and.reduceat(mask, starts) & ~(some ^ every)
        levels.append((shared, every & shared, lo[starts], hi[np.append(starts[1:], len(key)) - 1], key[starts]))
    children = []  # of each node of levels[1:]: first child and number
    for (_, _, lo, _, _), (_, _, up, _, _) in zip(levels, levels[1:]):
        first = np.searchsorted(lo, up)
        children.append((first, np.diff(np.append(first, len(lo)))))
    parent = np.arange(len(fp))
    top = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS:
            stack += [(level, a[PAIRS:], b[PAIRS:]), (level, a[:PAIRS], b[:PAIRS])]
            continue
        mask, pattern, lo, hi, _ = levels[level]
        same = a == b
        both = mask[a] & mask[b]
        apart = np.bitwise_count((pattern[a] ^ pattern[b]) & both)
        keep = apart <= most
        a, b, both, apart, same = a[keep], b[keep], both[keep], apart[keep], same[keep]
        whole = apart + np.bitwise_count(~both) <= most
        if whole.any():
            x, y = a[whole], b[whole]
            for node in (x, y):  # every two rows below may differ only in bits that are not shared
                n = hi[node] - lo[node]
                rows = np.repeat(lo[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                parent = _union(parent, rows, np.repeat(lo[x], n))
        if level == 0:
            continue
        a, b, same = a[~whole], b[~whole], same[~whole]
        changes = np.flatnonzero(np.diff(parent)) + 1  # rows whose root is not that of the row before
        one = np.searchsorted(changes, hi[a] - 1, side="right") == np.searchsorted(changes, lo[a], side="right")
        two = np.searchsorted(changes, hi[b] - 1, side="right") == np.searchsorted(changes, lo[b], side="right")
        todo = ~(one & two & (parent[lo[a]] == parent[lo[b]]))
        a, b, same = a[todo], b[todo], same[todo]
        first, number = children[level - 1]
        n = number[a] * number[b]
        pair = np.repeat(np.arange(len(a)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ca, cb = first[a][pair] + k // number[b][pair], first[b][pair] + k % number[b][pair]
        once = ~same[pair] | (ca <= cb)
        ca, cb = ca[once], cb[once]
        stack.append((level - 1, ca, cb))
    out = np.empty(len(fp), np.int64)
    out[order] = order[parent]
    return out


def _forest_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, part, fp) sorted by (k, part) in; edges (fp, other fp) of each bucket's spanning forest out. Buckets are gathered until there are some rows, so a task holds one large bucket at most."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        root = link_forest(np.cumsum(np.diff(k, prepend=k[:1]) != 0), fp.view(np.uint64))
        apart = fp[root] != fp
        return pa.RecordBatch.from_arrays([pa.array(fp[apart]), pa.array(fp[root[apart]])], schema=schema)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        k, fp = (batch.column(i).to_numpy() for i in (0, 1))
        held.append((k, fp))
        if sum(len(x) for x, _ in held) < 100_000:
            continue
        k, fp = (np.concatenate(x) for x in zip(*held))
        cut = np.searchsorted(k, k[-1]) if k[0] != k[-1] else 0
        if cut:
            yield links(k[:cut], fp[:cut])
        held = [(k[cut:], fp[cut:])]
    if held:
        k, fp = (np.concatenate(x) for x in zip(*held))
        yield links(k, fp)


def near_links(distinct: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (u, v) between fingerprints (column fp, distinct) that join exactly those that links of three or fewer differing bits join."""
    block = F.explode(F.array(*[F.struct(F.lit(i).alias("b"), F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF).alias("x")) for i in range(BLOCKS)]))
    rows = distinct.select("fp", block.alias("k")).select("fp", (F.col("k.b") * 65536 + F.col("k.x")).cast("long").alias("k"))
    sizes = rows.groupBy("k").count().where(F.col("count") > 1)
    parts = sizes.select("k", F.ceil(F.col("count") / bucket_limit).cast("int").alias("parts"))  # at most BLOCKS * 65536 rows
    rows = rows.join(F.broadcast(parts), "k")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # a large bucket's parts meet pairwise: every pair of its rows is in at least one task
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.select("k", "fp", "parts", own.alias("own"), F.explode(others).alias("other"))
    pair = F.least("own", "other").cast("long") * F.col("parts") + F.greatest("own", "other")
    dealt = dealt.select((F.col("k") * 4_000_000_000 + F.when(F.col("parts") > 1, pair).otherwise(F.lit(0))).alias("k"), "fp")
    return dealt.repartition("k").sortWithinPartitions("k").mapInArrow(_forest_edges, "u long, v long").where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every end of an edge (u, v): the smallest value that edges reach, by alternating large-star and small-star contraction."""
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("fp"), F.col("v").alias("root"))).distinct()
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # larger neighbours to the least
        large = materialize(large.where("u <> v"), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.*").where("u <> v").distinct(), "edges")


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_hashes: bool = False) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long. Null and blank texts have zero. with_hashes adds those of text_hashes."""
    own = dict(zip(HASHES, text_hashes(F.col(text_col)))) if with_hashes else {}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[h.alias(n) for n, h in own.items()])
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), *[(n, pa.int64()) for n in own]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(byte_texts(batch.column(1))).view(np.int64)), *batch.columns[2:]], schema=schema)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in schema.names))


def component_roots(prints: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(fp, root, least) of each distinct fingerprint of (doc_id, fp): its component's smallest fingerprint, and its own smallest doc_id."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(near_links(distinct.select("fp"), bucket_limit))
    return distinct.join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach, itself included).

    Null and blank texts have fingerprint zero and are linked like any other. Rows with equal ids or a null id keep a row
    each; a null id is nobody's component_id unless the whole component has none. An empty table gives no rows. Other
    columns, whatever their names, are ignored.
    """
    prints = materialize(fingerprint_rows(docs, id_col, text_col), "prints")
    classes = component_roots(prints, bucket_limit)
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = classes.join(least, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, a null id last.

    An id that is null or stands for several texts doesn't name a row, so rows are told by id and text. Of rows alike in
    both, one stays.
    """
    prints = materialize(fingerprint_rows(docs, id_col, text_col, with_hashes=True), "prints")
    roots = component_roots(prints).select("fp", "root")
    alike = prints.groupBy("doc_id", *HASHES, "fp").agg(F.count("*").alias("_n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *HASHES, "_n")
    first = alike.groupBy("fp").agg(F.min(order).alias("first")).join(roots, "fp").groupBy("root").agg(F.min("first").alias("first"))  # a row of each fingerprint is joined
    kept = first.select(F.col("first.doc_id").alias("_id"), *[F.col(f"first.{n}").alias(n) for n in HASHES], F.col("first._n").alias("_n"))
    own = [h.alias(n) for n, h in zip(HASHES, text_hashes(F.col(text_col)))]
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), *own).alias("rows")
    same = F.col("rows._id").eqNullSafe(F.col("kept._id"))
    for n in HASHES:
        same &= F.col(f"rows.{n}") == F.col(f"kept.{n}")
    rows = rows.join(kept.alias("kept"), same).select("_row", "rows._id", *[f"rows.{n}" for n in HASHES], "_n")
    single = rows.where("_n = 1").select("_row.*")
    again = rows.where("_n > 1")  # only rows that repeat are put side by side
    one = again.groupBy("_id", *HASHES).agg(F.min_by("_row", F.xxhash64(F.col("_row").cast("string"))).alias("_row"))
    return single.unionByName(one.select("_row.*"))

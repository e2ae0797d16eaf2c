"""Traversals that return paths and classes of nodes: exploration, shortest paths, strongly connected components, subsystems.

Frontiers, parents and states are tables in the shared folder; the driver only learns whether a round found anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.tables import materialize, spread
from symgraph.operators.iterative import levels, union

# Fixed values ---------------------------------------------------------------------------------------------------------
HOPS = {"strict": 0, "expanded": 3, "full": 8}
COHESION_SHARE, COHESION_EDGES, FILE_CAP = 0.3, 3, 150


def explore(edges: DataFrame, start: DataFrame, depth: int, direction: str = "out", max_nodes: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, level), edges (src, dst, kind)) within depth 0 to 5: the max_nodes nearest nodes (1 to 200, ties the
    lowest id) and at most three times as many edges among them. Self-loops and edges without a source are passed over."""
    depth, max_nodes = min(max(depth, 0), 5), min(max(max_nodes, 1), 200)
    arcs = edges.where("source_symbol_id is not null and source_symbol_id <> target_symbol_id").select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"), "kind")
    arcs = spread(arcs, "src", "dst").distinct()
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    walked = {"out": arcs.select("src", "dst"), "in": back, "both": arcs.select("src", "dst").union(back)}[direction]
    nodes = materialize(levels(walked, start, depth).orderBy("level", "node").limit(max_nodes), "explored")
    near = F.broadcast(nodes.select("node"))  # max_nodes rows
    inside = arcs.join(near, arcs.src == near.node, "left_semi").join(near, arcs.dst == near.node, "left_semi")
    return nodes, inside.orderBy("src", "dst", "kind").limit(3 * max_nodes)


def subtree(edges: DataFrame, root: DataFrame, depth: int, max_nodes: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, level), edges (src, dst, kind)) around a root, whatever the edges' direction: the max_nodes nearest
    nodes (1 to 500, ties the lowest id) and all edges among them, self-loops too."""
    max_nodes = min(max(max_nodes, 1), 500)
    arcs = edges.where("source_symbol_id is not null").select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"), "kind")
    arcs = materialize(spread(arcs, "src", "dst").distinct(), "arcs")
    both = arcs.select("src", "dst").union(arcs.select("dst", "src"))
    nodes = materialize(levels(both, root, depth).orderBy("level", "node").limit(max_nodes), "subtree")
    near = F.broadcast(nodes.select("node"))  # max_nodes rows
    return nodes, arcs.join(near, arcs.src == near.node, "left_semi").join(near, arcs.dst == near.node, "left_semi")


def isolation(edges: DataFrame, root: int) -> DataFrame:
    """One row: why a root has nothing around it (no edges, only self-loops, only edges that files start), or connected."""
    own = edges.where((F.col("source_symbol_id") == root) | (F.col("target_symbol_id") == root))
    loops, starts = F.col("source_symbol_id") == F.col("target_symbol_id"), F.col("source_symbol_id").isNull()
    counts = own.agg(F.count("*").alias("edges"), F.count_if(F.coalesce(loops, F.lit(False))).alias("loops"), F.count_if(starts).alias("from_files"))
    n = F.col("edges")
    return counts.withColumn("reason", F.when(n == 0, "no edges").when(n == F.col("loops"), "only self-loops").when(n == F.col("loops") + F.col("from_files"), "only edges that files start").otherwise("connected"))


def shortest_path(arcs: DataFrame, source: int, target: int, spark=None, most: int | None = None) -> DataFrame:
    """(step, node) of a shortest directed path, of those the one of the lowest parents; (0, source) if both are one; no rows if there is none (of `most` steps, where given).

    Each level is a table (node, parent); the path is read back by one join of the target with the levels before it.
    """
    spark = spark or arcs.sparkSession
    arcs = materialize(arcs.where("src is not null").select("src", "dst").distinct(), "arcs")
    tables = [materialize(spark.createDataFrame([(source, None)], "node long, parent long"), "level")]
    while source != target:
        if most is not None and len(tables) > most:
            return spark.createDataFrame([], "step long, node long")
        found = tables[-1].select(F.col("node").alias("src")).join(arcs, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        found = materialize(found.join(union(tables).select("node"), "node", "left_anti"), "level")
        if found.isEmpty():
            return spark.createDataFrame([], "step long, node long")
        tables.append(found)
        if not found.where(F.col("node") == target).isEmpty():
            break
    last = len(tables) - 1
    rows = tables[last].where(F.col("node") == target).select(F.col("node").alias(f"n{last}"), "parent")
    for at in range(last - 1, -1, -1):
        level = tables[at].select(F.col("node").alias(f"n{at}"), F.col("parent").alias("next"))
        rows = rows.join(level, rows["parent"] == level[f"n{at}"]).drop("parent").withColumnRenamed("next", "parent")
    steps = F.array(*[F.struct(F.lit(at).cast("long").alias("step"), F.col(f"n{at}").alias("node")) for at in range(last + 1)])
    return rows.select(F.explode(steps).alias("s")).select("s.step", "s.node")


def dependency_graph(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Arcs (src, dst) among symbols and files (negative ids): each symbol depends on its file, an edge without a source
    comes from its file. Self-loops, edges to unknown symbols and a file's edges to its own symbols are left out."""
    home = symbols.join(files.select("file_id"), "file_id").select("symbol_id", "file_id")
    rows = edges.join(files.select(F.col("file_id").alias("source_file_id")), "source_file_id").join(home, F.col("target_symbol_id") == F.col("symbol_id"))
    source = F.coalesce("source_symbol_id", -F.col("source_file_id"))
    own = F.col("source_symbol_id").isNull() & (F.col("source_file_id") == F.col("file_id"))
    kept = rows.where(~own).select(source.alias("src"), F.col("target_symbol_id").alias("dst")).where("src <> dst")
    return home.select(F.col("symbol_id").alias("src"), (-F.col("file_id")).alias("dst")).unionByName(kept).distinct()


def _trimmed(arcs: DataFrame) -> DataFrame:
    """arcs without the nodes that nothing enters or nothing leaves, over and over: those are on no cycle."""
    n = arcs.count()
    while n:
        heads, tails = arcs.select(F.col("dst").alias("src")).distinct(), arcs.select(F.col("src").alias("dst")).distinct()
        arcs = materialize(arcs.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"), "trimmed")
        left = arcs.count()
        if left == n:
            break
        n = left
    return arcs


def _spread(arcs: DataFrame, state: DataFrame) -> DataFrame:
    """state (node, color): each node takes the least color that arcs bring it, until nothing changes."""
    while True:
        into = arcs.join(state, arcs.src == state.node).groupBy("dst").agg(F.min("color").alias("c"))
        new = materialize(state.join(into, state.node == into.dst, "left").select("node", F.least("color", F.coalesce("c", "color")).alias("color"), (F.col("c") < F.col("color")).alias("moved")), "colors")
        state = new.select("node", "color")
        if new.where("moved").isEmpty():
            return state


def strong_components(arcs: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles; component is the least node of each strongly connected component.

    By colours: the least node that reaches a node is its colour; within a colour, what reaches the node of that name
    back is its component. Components are taken out, arcs between them and what is left are dropped, and so on.
    """
    arcs = _trimmed(materialize(arcs.where("src <> dst").select("src", "dst").distinct(), "arcs"))
    out = None
    while not arcs.isEmpty():
        nodes = arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        color = _spread(arcs, materialize(nodes.withColumn("color", F.col("node")), "colors"))
        a, b = color.select(F.col("node").alias("src"), F.col("color").alias("c1")), color.select(F.col("node").alias("dst"), F.col("color").alias("c2"))
        inside = materialize(arcs.join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst"), "inside")
        roots = color.where("node = color").select("node")
        reached = levels_all(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)
        found = materialize(color.join(reached, "node", "left_semi").select("node", F.col("color").alias("component")), "strong")
        out = found if out is None else materialize(out.unionByName(found), "strong")
        gone = found.select("node")
        arcs = inside.join(gone, inside.src == gone.node, "left_anti").join(gone, inside.dst == gone.node, "left_anti")
        arcs = _trimmed(materialize(arcs, "arcs"))
    if out is None:
        return arcs.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    sizes = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return out.join(sizes, "component", "left_semi").select("node", "component")


def levels_all(arcs: DataFrame, start: DataFrame) -> DataFrame:
    """(node) of all that arcs reach from start, itself included."""
    tables = [materialize(start.select("node").distinct(), "reached")]
    while True:
        found = tables[-1].select(F.col("node").alias("src")).join(arcs, "src").select(F.col("dst").alias("node")).distinct()
        found = materialize(found.join(union(tables), "node", "left_anti"), "reached")
        if found.isEmpty():
            return union(tables)
        tables.append(found)


def cyclic_groups(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size, files, cross_file): groups of symbols and files that depend on each other in a circle."""
    parts = strong_components(dependency_graph(files, symbols, edges))
    home = symbols.select(F.col("symbol_id").alias("node"), "file_id").unionByName(files.select((-F.col("file_id")).alias("node"), "file_id"))
    rows = parts.join(home, "node").groupBy("component").agg(F.count("*").alias("size"), F.countDistinct("file_id").alias("files"))
    return rows.withColumn("cross_file", F.col("files") > 1)


def discover_subsystem(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, scope: str = "expanded", file_cap: int = FILE_CAP) -> DataFrame:
    """(symbol_id, file_id, hop) of the seeds (symbol_id) and of what clings to them.

    Each hop a neighbour of the last hop's symbols joins if COHESION_SHARE of its edges, or COHESION_EDGES of them, lead to
    members, unless its kind is local. Above file_cap files the lowest file ids stay.
    """
    from symgraph.functions.vocabulary import LOCAL_KINDS

    both = edges.where("source_symbol_id is not null").select(F.col("source_symbol_id").alias("a"), F.col("target_symbol_id").alias("b"))
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    degree = edges.select(F.explode(F.array("source_symbol_id", "target_symbol_id")).alias("a")).where("a is not null").groupBy("a").agg(F.count("*").alias("total"))
    degree = materialize(degree, "degree")
    eligible = symbols.where(~F.lower("kind").isin(LOCAL_KINDS)).select(F.col("symbol_id").alias("a"))
    home = symbols.select("symbol_id", "file_id")
    members = materialize(home.join(seeds.select("symbol_id").distinct(), "symbol_id", "left_semi").withColumn("hop", F.lit(0)), "members")
    frontier = members.select(F.col("symbol_id").alias("b"))
    for hop in range(1, HOPS[scope] + 1):
        if members.select("file_id").distinct().count() >= file_cap:
            break
        inside = members.select(F.col("symbol_id").alias("b"))
        near = both.join(frontier, "b", "left_semi").select("a").distinct().join(inside.withColumnRenamed("b", "a"), "a", "left_anti").join(eligible, "a", "left_semi")
        bonds = both.join(near, "a", "left_semi").join(inside, "b", "left_semi").groupBy("a").agg(F.count("*").alias("bonds"))
        strong = bonds.join(degree, "a").where((F.col("bonds") >= COHESION_EDGES) | (F.col("bonds") >= COHESION_SHARE * F.greatest("total", F.lit(1))))
        found = materialize(home.join(strong.select(F.col("a").alias("symbol_id")), "symbol_id", "left_semi").withColumn("hop", F.lit(hop)), "found")
        if found.isEmpty():
            break
        members = materialize(members.unionByName(found), "members")
        frontier = found.select(F.col("symbol_id").alias("b"))
    kept = members.select("file_id").distinct().orderBy("file_id").limit(file_cap)
    return members.join(F.broadcast(kept), "file_id", "left_semi").select("symbol_id", "file_id", "hop")

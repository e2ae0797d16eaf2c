"""Iterative graph operators: levels, distances, rank, labels, components. Frontiers and states are tables, never collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.tables import materialize, spread
from symgraph.operators import packed


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def levels(arcs: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, level) of nodes that arcs (src, dst) reach within depth, start (node) being level 0. Each level is written once, as a table of its own."""
    arcs = materialize(arcs.where("src is not null").select("src", "dst"), "arcs")  # repeated arcs do no harm
    tables = [materialize(start.select("node").distinct().withColumn("level", F.lit(0)), "level")]
    for level in range(1, depth + 1):
        found = tables[-1].select(F.col("node").alias("src")).join(arcs, "src").select(F.col("dst").alias("node")).distinct()
        found = materialize(found.join(union(tables).select("node"), "node", "left_anti").withColumn("level", F.lit(level)), "level")
        if found.isEmpty():
            break
        tables.append(found)
    return union(tables).select("node", F.col("level").cast("long").alias("level"))


def pagerank(arcs: DataFrame, rounds: int = 10, damping: float = 0.85, graph: packed.Packed | None = None) -> DataFrame:
    """Un-normalised rank from 1.0: 0.15 + 0.85 x what comes in; parallel arcs count, what dangles and arcs without a source are dropped. graph: arcs, where they are packed already."""
    graph = graph or packed.pack(arcs)
    return packed.pagerank(graph, rounds, damping) if graph else joined_pagerank(arcs, rounds, damping)


def joined_pagerank(arcs: DataFrame, rounds: int = 10, damping: float = 0.85, every: int = 5) -> DataFrame:
    """pagerank by joins, for graphs of any size."""
    arcs = materialize(arcs.where("src is not null").groupBy("src", "dst").agg(F.count("*").alias("m")), "arcs")
    out = arcs.groupBy("src").agg(F.sum("m").alias("n"))
    weights = materialize(arcs.join(out, "src").select("src", "dst", (F.col("m") / F.col("n")).alias("w")), "weights")
    nodes = materialize(arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    rank = nodes.withColumn("rank", F.lit(1.0))
    for i in range(1, rounds + 1):
        into = rank.join(weights, rank.node == weights.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("s"))
        rank = nodes.join(into, nodes.node == into.dst, "left").select("node", (1 - damping + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if i % every == 0:
            rank = materialize(rank, "rank")
    return rank


def label_propagation(arcs: DataFrame, rounds: int = 5, graph: packed.Packed | None = None) -> DataFrame:
    """Synchronous rounds: each node takes its neighbours' most frequent label, ties the smallest. graph: arcs, where they are packed already."""
    graph = graph or packed.pack(arcs)
    return packed.label_propagation(graph, rounds) if graph else joined_labels(arcs, rounds)


def joined_labels(arcs: DataFrame, rounds: int = 5) -> DataFrame:
    """label_propagation by joins, for graphs of any size."""
    arcs = arcs.where("src is not null")
    both = materialize(arcs.select("src", "dst").union(arcs.select("dst", "src")).groupBy("src", "dst").agg(F.count("*").alias("m")), "both")
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, both.dst == labels.node).groupBy("src", "label").agg(F.sum("m").alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("b"))
        labels = materialize(best.select(F.col("src").alias("node"), (-F.col("b.m")).alias("label")), "labels")
    return labels


def connected(arcs: DataFrame) -> DataFrame:
    """(node, component): the smallest node that arcs reach, whatever their direction; labels jump along themselves each round."""
    both = materialize(arcs.select("src", "dst").union(arcs.select("dst", "src")).distinct(), "both")
    state = materialize(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")), "state")
    while True:
        near = both.join(state, both.dst == state.node).groupBy("src").agg(F.min("component").alias("m"))
        stepped = state.join(near, state.node == near.src, "left").select("node", F.least("component", F.coalesce("m", "component")).alias("c"))
        up = state.select(F.col("node").alias("c"), F.col("component").alias("over"))
        new = materialize(stepped.join(up, "c", "left").select("node", F.least("c", F.coalesce("over", "c")).alias("component")), "state")
        same = new.join(state.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        state = new
        if same:
            return state


def two_cycles(arcs: DataFrame) -> DataFrame:
    """Pairs a < b with arcs both ways."""
    ordered = arcs.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    return spread(ordered, "a", "b").groupBy("a", "b").agg(F.count_if("up").alias("x"), F.count_if(~F.col("up")).alias("y")).where("x > 0 and y > 0").select("a", "b")

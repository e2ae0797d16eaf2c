"""What a review found: steps that grew faster than their input, and results that differ from SQL."""

import random
import time

import duckdb
from pyspark.sql import functions as F

from symgraph.functions import tables
from symgraph.operators import context, flow, iterative, knowledge, packed, paths
from symgraph.plans import catalogue, structure  # noqa: F401  structure adds its queries to the catalogue


SF = "/root/testdata/sf0.001"


def within(seconds, df):
    began = time.monotonic()
    rows = df.collect()
    assert time.monotonic() - began < seconds
    return rows


def test_parents_of_equal_spans(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2), a := rng.choice([0, 10, 5000]), a + rng.choice([0, 5, 9000])) for i in range(60)]
    want = {}
    for s, f, a, b in rows:
        around = [(y - x, p) for p, g, x, y in rows if g == f and x <= a and y >= b and p != s]
        if around:
            want[s] = min(around)[1]
    got = flow.parents(spark.createDataFrame(rows, "symbol_id long, file_id long, start_byte long, end_byte long"))
    assert {r.symbol_id: r.parent_id for r in got.collect()} == want
    # as pairs of symbols these would be 10^10 rows
    many = spark.range(100_000).select(F.col("id").alias("symbol_id"), F.lit(1).cast("long").alias("file_id"), F.lit(1).cast("long").alias("start_byte"), F.lit(9).cast("long").alias("end_byte"))
    found = within(60, flow.parents(many).groupBy("parent_id").count().orderBy("parent_id"))
    assert [tuple(r) for r in found] == [(0, 99_999), (1, 1)]


def test_models_of_a_file_with_many_bases(spark):
    ids = spark.range(20_000).select(F.col("id").alias("symbol_id"), F.lit(1).cast("long").alias("file_id"), F.format_string("b%05d", "id").alias("name"))
    edges = ids.select(F.col("file_id").alias("source_file_id"), F.col("symbol_id").alias("target_symbol_id"), F.lit("inherits").alias("kind"))
    named = spark.createDataFrame([(100_000, 2, "Model"), (100_001, 2, "B")], "symbol_id long, file_id long, name string")
    edges = edges.unionByName(edges.limit(0).union(spark.createDataFrame([(2, 3, "inherits"), (2, 5, "inherits")], "source_file_id long, target_symbol_id long, kind string")))
    wanted = ids.where("symbol_id < 5000").withColumn("signature", F.lit("(x: Model)"))
    # every symbol with every base of its file would be 10^8 rows
    found = within(60, context.model_expansion(wanted, ids.unionByName(named), edges).groupBy("place", "name").count().orderBy("place"))
    assert [tuple(r) for r in found] == [(i, n, 5000) for i, n in enumerate(["Model", "b00003", "b00005", "b00000", "b00001", "b00002", "b00004", "b00006"])]


def test_siblings_are_joined_by_distinct_names(spark):
    symbols = spark.range(40_000).select(F.col("id").alias("symbol_id"), F.lit(1).cast("long").alias("file_id"), F.concat(F.lit("n"), F.col("id") % 3).alias("name"))
    symbols = symbols.unionByName(spark.createDataFrame([(50_000, 1, "N0PROPS")], symbols.schema))
    edges = spark.createDataFrame([], "source_file_id long, source_symbol_id long, target_symbol_id long, kind string, confidence double")
    # symbols of a file met pairwise: 1.6 * 10^9 rows
    found = within(60, context.symbol_context(symbols.where("symbol_id < 40000"), symbols, edges).groupBy("section").count().orderBy("section"))
    assert [tuple(r) for r in found] == [("prop_interfaces", 13_334), ("siblings", 120_000)]


def test_two_steps_without_a_path(spark, tmp_path):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert paths.shortest_path(arcs, 1, 4).count() == 4 and paths.shortest_path(arcs, 1, 4, most=3).count() == 4
    assert paths.shortest_path(arcs, 1, 4, most=2).count() == 0
    for name in ("nation", "region", "supplier", "customer", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        (rows.where("l_partkey <> 1") if name == "lineitem" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("nation", "region", "supplier", "customer", "part", "orders", "lineitem", "events"):
        folder = SF if name == "events" else tmp_path
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet{'' if name == 'events' else '/*.parquet'}')")
    want = con.sql(catalogue.ORACLE_SQL["shortest_path"]).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["shortest_path"](spark, str(tmp_path)).collect())) == sorted(want) == [(0, 20000001), (1, None), (2, 30000001)]


def test_tokens_of_nothing_in_scope(spark):
    files = spark.createDataFrame([("a/x", 8), ("b/y", 5)], "path string, size long")
    tokens = lambda scope, most: knowledge.scope_tokens(files, scope, most).first().tokens
    assert tokens("b/", 1) is None and tokens("b/", 2) == 1 and tokens(None, 2) == 3


def test_packed_graph_as_joined(spark, monkeypatch):
    rng = random.Random(11)
    arcs = [(rng.randrange(40) * 10**9, rng.randrange(25) * 10**9 + rng.randrange(2)) for _ in range(150)] + [(7, 7), (None, 3), (5, 6), (5, 6)]
    frame = spark.createDataFrame(arcs, "src long, dst long")
    monkeypatch.setattr(packed, "ENTRIES", 20)
    graph = packed.pack(frame)
    assert graph.n_blocks > 10 and len(graph.ids) == len({n for a in arcs if a[0] is not None for n in a})
    ranks = lambda df: {r.node: round(r["rank"], 9) for r in df.collect()}
    assert ranks(iterative.pagerank(frame, graph=graph)) == ranks(iterative.joined_pagerank(frame))
    labels = lambda df: {r.node: r.label for r in df.collect()}
    assert labels(iterative.label_propagation(frame)) == labels(iterative.joined_labels(frame))
    monkeypatch.setattr(packed, "NODES", 10)
    assert packed.pack(frame) is None and packed.pack(frame.limit(0)) is None
    assert ranks(iterative.pagerank(frame)) == ranks(iterative.joined_pagerank(frame)) and iterative.label_propagation(frame.limit(0)).count() == 0


def test_partitions_follow_the_files_read(spark, tmp_path, monkeypatch):
    spark.range(20_000).selectExpr("id % 500 as a", "id as b").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert tables.spread(table, "a").rdd.getNumPartitions() == 1
    monkeypatch.setattr(tables, "SPREAD_BYTES", 4_000)
    few, many = tables.spread(table, "a").rdd.getNumPartitions(), tables.spread(table.union(table), "a").rdd.getNumPartitions()
    assert few > 5 and many in (2 * few - 1, 2 * few)
    assert tables.spread(table, "a").groupBy("a").count().where("count = 40").count() == 500
    assert tables.spread(spark.createDataFrame([(1,)], "a long").unionByName(table.select("a")), "a").count() == 20_001
    edges = catalogue.adapter.edges(spark, SF)
    assert edges.rdd.getNumPartitions() > 50  # the folder has 0.1 MB of line items

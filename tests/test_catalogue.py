"""Registered queries against DuckDB, and small hand-built graphs."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from symgraph.functions import scalars
from symgraph.operators import iterative, relational
from symgraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(row):
    return tuple(None if x is None else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in row)


@pytest.mark.parametrize("name", ["hotspots_symbols", "graph_metrics", "enclosing_symbol", "edge_builder_dedup", "tool_stats", "hourly_usage", "search_demoted", "rrf_fusion", "bfs_levels", "pagerank", "file_components", "duplicate_text_groups"])
def test_against_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(plain, got.select(*columns).collect()), key=repr) == sorted(map(plain, want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()), key=repr)


def graph(spark, files, symbols, edges):
    return (
        spark.createDataFrame(files, "file_id long, path string"),
        spark.createDataFrame([(*s, "function", 1, 9) for s in symbols], "symbol_id long, file_id long, name string, kind string, start_line long, end_line long"),
        spark.createDataFrame([(*e, "calls", "static", 1.0) for e in edges], "source_file_id long, source_symbol_id long, target_symbol_id long, kind string, edge_type string, confidence double"),
    )


def test_small_graphs(spark):
    files, symbols, edges = graph(spark, [(1, "./a/x.ts"), (2, "./b/y.py")], [(1, 1, "a"), (2, 2, "b"), (3, 1, "c")], [(1, 1, 2), (1, None, 2)])
    assert [r.symbol_id for r in relational.orphan_symbols(symbols, edges).collect()] == [3]
    assert [r.file_id for r in relational.isolated_files(files, symbols, edges).collect()] == [2]
    hot = {r.name: (r.incoming, r.outgoing, r.score) for r in relational.hotspots_symbols(files, symbols, edges).collect()}
    assert hot == {"b": (2, 0, 6), "a": (0, 1, 1)}
    counts = relational.validation_counts(symbols, edges.union(edges)).first()
    assert counts.duplicates == 2 and counts.dangling == 0 and not counts.is_valid
    empty = relational.graph_metrics(files.limit(0), symbols.limit(0), edges.limit(0), spark.createDataFrame([], "file_id long, kind string")).first()
    assert (empty.connectivity, empty.density, empty.resolution_rate) == (1.0, 0.0, 1.0)


def test_iterative(spark):
    rng = random.Random(3)
    arcs = {(rng.randrange(30), rng.randrange(30)) for _ in range(35)} | {(0, 1)}
    frame = spark.createDataFrame(sorted(arcs), "src long, dst long")
    level, frontier = {0: 0}, [0]
    while frontier:
        frontier = sorted({d for s, d in arcs if s in frontier} - level.keys())
        level |= {n: level[max(level, key=level.get)] + 1 for n in frontier}
    out = iterative.levels(frame, spark.createDataFrame([(0,)], "node long"), 50)
    assert {r.node: r.level for r in out.collect()} == level
    group = {n: n for a in arcs for n in a}
    for _ in group:
        for a, b in arcs:
            group[a] = group[b] = min(group[a], group[b])
    assert {r.node: r.component for r in iterative.connected(frame).collect()} == group
    both = {(min(a, b), max(a, b)) for a, b in arcs if a != b and (b, a) in arcs}
    assert {tuple(r) for r in iterative.two_cycles(frame).collect()} == both


def test_scalars(spark):
    assert scalars.query_tokens("The Auth, user-API auth") == ["api", "auth"]
    row = spark.range(1).select(
        scalars.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("c"),
        scalars.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"),
        scalars.token_estimate(F.lit("one two three")).alias("t"),
        scalars.whole_word(F.lit("x.Get(y)"), "get").alias("w"),
        scalars.whole_word(F.lit("getter"), "get").alias("n"),
        scalars.cost_cents(F.lit(1_000_000), F.lit("GPT-x")).alias("m"),
        scalars.call_literals(F.lit("fetch( '/api/run') put(\"x\")")).alias("l"),
    ).first()
    assert math.isclose(row.c, 0.5**0.5) and row.z == 0 and row.t == 4 and row.w and not row.n and row.m == 250 and row.l == ["/api/run"]

"""Classifiers, resolution, repository files, paths and diagnostics: against DuckDB, brute force and small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from symgraph.operators import classify, diagnostics, linking, manifest, paths, resolve
from symgraph.plans import catalogue, structure  # noqa: F401
from symgraph.sources import python_frontend, repository
from symgraph.streaming import reindex
from tests.test_catalogue import SF, duck, plain  # noqa: F401

NEW = "feature_flags entrypoint_categories directory_layers entrypoint_classes resolve_names resolve_paths name_like file_changes index_freshness line_slices file_cascade explore_nodes method_origins contract_violations unbacked_references duplicate_definitions excess_edges manifest_largest language_share architecture_health import_map embedding_work type_words".split()


@pytest.mark.parametrize("name", NEW)
def test_against_duckdb(spark, duck, name):  # noqa: F811
    import duckdb

    got, want = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(plain, got.select(*columns).collect()), key=repr)
    assert rows == sorted(map(plain, want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()), key=repr)


def test_entrypoints(spark):
    cases = [
        ("f", "function", "a.py", ['@app.get("/x")'], "Route"), ("f", "function", "a.py", ["@router.POST('/x')"], "Route"), ("f", "method", "a.py", ["@bp.route('/')"], "Route"),
        ("f", "function", "a.py", ["@app.websocket('/ws')"], "Route"), ("f", "function", "a.py", ["@get"], "Route"), ("f", "function", "a.py", ["@staticmethod"], None),
        ("f", "function", "a.py", ["@pytest.fixture"], None), ("C", "class", "a.py", ["@app.get('/')"], None), ("Home", "function", "x/app/page.tsx", [], "Page"),
        ("helper", "function", "app/page.tsx", [], None), ("Root", "function", "app\\layout.tsx", [], "Page"), ("GET", "function", "app/api/route.ts", [], "Route"),
        ("Me", "function", "web/pages/api/me.tsx", [], "Route"), ("App", "function", "pages/_app.tsx", [], None), ("x", "page", "x.py", [], "Page"), ("x", "endpoint", "x.py", None, "Route"),
        ("main", "function", "run.py", None, "Cli"), ("C", "class", "p/__main__.py", None, "Cli"), ("main", "function", "run.rs", None, None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, name string, kind string, path string, attributes array<string>, want string")
    got = rows.withColumn("got", classify.entrypoint_class(F.col("name"), F.col("kind"), F.col("path"), F.col("attributes"))).orderBy("i").collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]


def test_imports(spark):
    cases = [
        ("std::fs", "fs", "rs", "StandardLibrary"), ("crate::a", "a", "rs", "RepositorySymbol"), ("serde", "x", "rs", "ExternalDependency"), ("node:fs", "x", "ts", "Builtin"),
        ("fs/promises", "x", "js", "Builtin"), ("react", "x", "tsx", "ExternalDependency"), ("@/lib/a", "x", "ts", "RepositorySymbol"), ("./a", "x", "js", "RepositorySymbol"),
        ("os.path", "join", "py", "StandardLibrary"), (".a", "b", "py", "RepositorySymbol"), ("numpy", "x", "py", "ExternalDependency"), ("mine.a", "x", "py", "RepositorySymbol"),
        (None, "json", "py", "StandardLibrary"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, source string, name string, lang string, want string")
    got = rows.withColumn("got", classify.import_state(F.col("source"), F.col("name"), F.col("lang"), ["mine"])).orderBy("i").collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]


def test_name_hints(spark):
    files = spark.createDataFrame([(1, "./a/client.ts"), (2, "./a/server.ts")], "file_id long, path string")
    symbols = spark.createDataFrame([(1, 1, "create", 1, 5), (2, 2, "create", 1, 5), (3, 2, "Only", 7, 9), (4, 2, "Only", 7, 9)], "symbol_id long, file_id long, name string, start_line long, end_line long")
    q = spark.createDataFrame([("create",), ("only",), ("none",), (None,)], "query string")
    got = lambda hint: {r["query"]: (r["outcome"], r["n"], r["symbol_id"]) for r in resolve.resolve_names(q, symbols, files, hint).collect()}
    assert got(None) == {"create": ("Ambiguous", 2, 1), "only": ("Symbol", 1, 3), "none": ("NotFound", 0, None), None: ("NotFound", 0, None)}
    assert got("server.ts")["create"] == ("Symbol", 1, 2) and got("other.ts")["create"] == ("Ambiguous", 2, 1)
    assert resolve.closest_definition(symbols.withColumn("name", F.lit("n")), "n", 6).first().symbol_id == 1


def strong(arcs):
    """Brute force: groups of nodes that reach each other."""
    nodes = sorted({n for a in arcs for n in a})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in arcs:
            reach[a] |= reach[b]
    groups = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    sizes = list(groups.values())
    return {n: g for n, g in groups.items() if sizes.count(g) > 1}


@pytest.mark.parametrize("seed,n,m", [(1, 12, 18), (2, 25, 32), (3, 8, 0)])
def test_strong_components(spark, seed, n, m):
    rng = random.Random(seed)
    arcs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    got = paths.strong_components(spark.createDataFrame(sorted(arcs), "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == strong(arcs)


def index(spark, files, symbols, edges):
    return (
        spark.createDataFrame(files, "file_id long, path string"),
        spark.createDataFrame([(*s, "function", 1, 9) for s in symbols], "symbol_id long, file_id long, name string, kind string, start_line long, end_line long"),
        spark.createDataFrame([(*e, "calls", "static", 1.0) for e in edges], "source_file_id long, source_symbol_id long, target_symbol_id long, kind string, edge_type string, confidence double"),
    )


@pytest.mark.parametrize("files,symbols,edges,want", [
    ([(1, "a")], [(1, 1, "a"), (2, 1, "b")], [(1, 1, 2), (1, 2, 1)], [(1, 2, False)]),
    ([(1, "a")], [(1, 1, "T")], [(1, 1, 1)], []),
    ([(1, "a")], [(1, 1, "a"), (2, 1, "b")], [(1, 1, 2)], []),
    ([(1, "a"), (2, "b")], [(1, 1, "a"), (2, 2, "b")], [(1, 1, 2), (2, 2, 1)], [(1, 2, True)]),
    ([(1, "a")], [(1, 1, "a"), (2, 1, "b")], [(1, None, 1), (1, None, 2)], []),
])
def test_cyclic_groups(spark, files, symbols, edges, want):
    assert [(r.component, r.size, r.cross_file) for r in paths.cyclic_groups(*index(spark, files, symbols, edges)).collect()] == want


def test_paths_and_subsystems(spark):
    files, symbols, edges = index(spark, [(i, f"f{i}") for i in range(1, 6)], [(i, i, f"n{i}") for i in range(1, 6)], [(i, i, i + 1) for i in range(1, 5)])
    arcs = edges.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"))
    walk = lambda a, b: [r.node for r in paths.shortest_path(arcs, a, b).orderBy("step").collect()]
    assert walk(1, 4) == [1, 2, 3, 4] and walk(4, 1) == [] and walk(2, 2) == [2]
    seeds = symbols.where("symbol_id = 1")
    for scope, n in {"strict": 1, "expanded": 4, "full": 5}.items():
        assert paths.discover_subsystem(symbols, edges, seeds, scope).select("file_id").distinct().count() == n
    assert paths.discover_subsystem(symbols, edges, seeds, "full", 2).count() == 2
    nodes, inside = paths.explore(edges, spark.createDataFrame([(3,)], "node long"), 1, "both")
    assert {(r.node, r.level) for r in nodes.collect()} == {(3, 0), (2, 1), (4, 1)} and inside.count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, text in {"src/a.py": "x = 1\n", "node_modules/b.js": "y", "src/c.bin": "z", "Dockerfile": "FROM x", "package.json": '{"dependencies": {"a": "1"}, "scripts": {"t": "run"}}'}.items():
        (tmp_path / name).write_text(text)
    found = repository.walk(spark, str(tmp_path))
    assert sorted(r.path for r in found.select("path").collect()) == ["Dockerfile", "package.json", "src/a.py"]
    assert {tuple(r) for r in repository.manifest_symbols(found).select("name", "kind").collect()} == {("a", "dependency"), ("t", "script")}
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], "path string, content_hash string")
    assert {r.path: r.state for r in repository.changes(old, new).collect()} == {"a": "Unchanged", "b": "Changed", "c": "Changed", "d": "Removed", "e": "Added"}
    assert tuple(repository.stale_counts(old, new).first()) == (2, 4)
    text = spark.createDataFrame([("a", "1\r\n2\n3\n"), ("b", "1")], "path string, content string")
    assert [tuple(r) for r in repository.line_range(text, 2, 9).collect()] == [("a", "2\n3")]
    with pytest.raises(ValueError):
        repository.line_range(text, 3, 2)
    spots = spark.createDataFrame([(1, 1, 0, 2), (2, 1, 1, 3), (3, 1, 0, 99)], "symbol_id long, file_id long, start_byte long, end_byte long")
    assert {r.symbol_id: r.source for r in repository.byte_slices(spots, spark.createDataFrame([(1, "éab")], "file_id long, content string")).where("symbol_id <> 2").collect()} == {1: "é", 3: None}
    rows = repository.upsert(spark.createDataFrame([(1, None, "a"), (2, 1, "b")], "k long, j long, v string"), spark.createDataFrame([(1, None, "z"), (3, 1, "c")], "k long, j long, v string"), ["k", "j"])
    assert {tuple(r) for r in rows.collect()} == {(1, None, "z"), (2, 1, "b"), (3, 1, "c")}


def test_python_frontend(spark):
    source = '''
import os
from a.b import C as D, E
from x import *

@app.get("/x")
def arrange(shelf: Shelf, n: int = 1) -> Outcome[int]:
    c = Client()
    c.send(1)
    print(c.state)

class K(Base, m.Other):
    limit = 3
    def go(self):
        self.f = Engine()
        self.f.run()
        global total
'''
    files = spark.createDataFrame([("a.py", source), ("b.py", "def ("), ("c.py", None), ("d.js", "x")], "path string, content string")
    symbols, references = python_frontend.parsed_tables(files)
    got = {(r.name, r.kind) for r in symbols.where("path = 'a.py'").collect()}
    assert got == {("arrange", "function"), ("c", "variable"), ("K", "class"), ("limit", "variable"), ("go", "method")}
    assert symbols.where("name = 'arrange'").first().attributes == ["@app.get('/x')"]
    assert {r.path for r in python_frontend.parse(files).collect()} == {"a.py", "b.py", "c.py"}
    refs = {(r.name, r.kind, r.source) for r in references.collect()}
    assert {("os", "imports", None), ("E", "imports", "a.b"), ("Client", "instantiates", "c"), ("send", "method_call", "c"), ("Engine", "instantiates", "f"), ("run", "method_call", "self.f"), ("Base", "inherits", None), ("Other", "inherits", None), ("Shelf", "type_ref", None), ("Outcome", "type_ref", None), ("total", "global_ref", None), ("state", "MEMBER_ACCESS", None)} <= refs
    assert not {n for n, *_ in refs} & {"print", "int", "*"}


def test_diagnostics_gate(spark):
    files, symbols, edges = index(spark, [(1, "x/a.py"), (2, "y/b.py")], [(1, 1, "a"), (2, 2, "b")], [(1, 1, 2)])

    def statuses(evidence):
        rel = spark.createDataFrame([(1, 1, "b", 3, "calls", "RepositorySymbol", evidence)], "rel_id long, file_id long, name string, line_number long, kind string, state string, evidence string")
        bindings = spark.createDataFrame([(1, "variable", "v", "T")], "file_id long, kind string, name string, type_name string")
        tables = diagnostics.Tables(files, symbols, edges, rel, bindings, symbols.select("symbol_id"), spark.createDataFrame([(1, "0.9")], "id long, version string"))
        rows = diagnostics.run(spark, tables).select("place", "stage", "status").distinct().orderBy("place").collect()
        assert [r.stage for r in rows] == [stage for stage, *_ in diagnostics.CHECKS]
        return [r.status for r in rows]

    sound = statuses("LexicalScopeMatch")
    assert sound[0] == "Warning" and "Fail" not in sound and "Skipped" not in sound
    assert statuses(None)[7:] == ["Fail"] + ["Skipped"] * 6


def test_links(spark):
    sources = spark.createDataFrame([(1, "fetch('/api/run/[id]'); fetch(\"/api/other\")"), (2, "fetch('/x')"), (3, None)], "symbol_id long, source string")
    routes = spark.createDataFrame([(9, "web/app/api/run/route.ts"), (8, "web/app/API/run/route.ts"), (7, "web/api/none.ts")], "symbol_id long, path string")
    assert [tuple(r) for r in linking.connectors(sources, routes).collect()] == [(1, "/api/run/[id]", 8)]
    contents = spark.createDataFrame([(1, "post('/api/login') get('/api/login')"), (2, "fetch(`/users/all`)"), (3, "")], "file_id long, content string")
    ends = spark.createDataFrame([(1, "login", None), (2, "all", []), (3, "list_users", ["@app.get('/users/all')"])], "symbol_id long, name string, attributes array<string>")
    assert {tuple(r)[:2] for r in linking.interactions(contents, ends).collect()} == {(1, 1), (2, 3)}
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts, parts = [word(rng.randrange(12)) for _ in range(40)], [word(rng.randrange(6)) for _ in range(30)]
    got = linking.substring_pairs(spark.createDataFrame(list(enumerate(texts)), "h int, text string"), spark.createDataFrame(list(enumerate(parts)), "n int, part string"))
    assert sorted((r.h, r.n) for r in got.collect()) == sorted((h, n) for h, t in enumerate(texts) for n, p in enumerate(parts) if p and p in t)


def test_manifest(spark):
    rel = lambda *sources: spark.createDataFrame([("imports", s) for s in sources], "kind string, source string")
    files = spark.createDataFrame([("web/app/page.tsx",), ("a.py",)], "path string")
    kinds = lambda r, f: {x.framework: x.confidence for x in manifest.frameworks(r, f).collect()}
    assert kinds(rel("react"), files) == {"Next.js": "Medium", "React": "High"} and kinds(rel("react", "express", None), files.limit(0)) == {"Express": "High"} and kinds(rel("next/link", "react"), files.limit(0)) == {"Next.js": "High"}
    paths_ = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3, "path string")
    assert tuple(manifest.dominant_file(paths_).first()) == ("a", 5, 62.5) and manifest.dominant_file(paths_.where("path = 'b'")).isEmpty()
    degrees = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "symbol_id long, fan_in long, fan_out long")
    assert manifest.health(degrees, 50).first().score == 40 and manifest.health(degrees.limit(0), 0).first().score == 100


def test_follow_stream(spark, tmp_path):
    at, table = str(tmp_path / "in"), tmp_path / "table"
    schema = "path string, version long, content string"
    seen = {}
    for rows in ([("a", 1, "x"), ("b", 1, "y")] + [(f"p{i}", 1, "q") for i in range(20)], [("a", 2, "z"), ("a", 1, "old")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(at)
        reindex.follow(spark.readStream.schema(schema).parquet(at), str(table), str(tmp_path / "checkpoint"), 8).awaitTermination()
        before, seen = seen, {p: p.stat().st_mtime_ns for p in table.glob("_bucket=*/*.parquet")}
    assert {tuple(r) for r in reindex.read_followed(spark, str(table)).where("content <> 'q'").collect()} == {("a", 2, "z"), ("b", 1, "y")}
    assert reindex.read_followed(spark, str(table)).count() == 22
    changed = {p.parent.name for p in seen if before.get(p) != seen[p]}
    assert len(changed) == 1 and len({p.parent.name for p in seen}) > 3  # the bucket of one path


def test_labels_and_communities(spark):
    from collections import Counter

    from symgraph.operators import iterative

    rng = random.Random(8)
    arcs = [(rng.randrange(12), rng.randrange(12)) for _ in range(20)]
    near = [(a, b) for a, b in arcs] + [(b, a) for a, b in arcs]
    label = {a: a for a, _ in near}
    for _ in range(5):
        votes = {n: Counter(label[b] for a, b in near if a == n) for n in label}
        label = {n: min(c, key=lambda x: (-c[x], x)) for n, c in votes.items()}
    assert {r.node: r.label for r in iterative.label_propagation(spark.createDataFrame(arcs, "src long, dst long")).collect()} == label
    files, symbols, edges = index(spark, [(1, "./src/auth/a.ts"), (2, "./src/lib/b.ts"), (3, "./pay/c.ts")], [(1, 1, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d")], [(1, 1, 4), (1, 2, 3), (3, 4, 4)])
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "node long, label long")
    got = {tuple(r) for r in manifest.communities(groups, symbols, files, edges).collect()}
    assert got == {(1, "auth", 3, 1, 0), (4, "pay", 1, 0, 1)}

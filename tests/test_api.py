"""An index of a small folder, built from sources, and every tool over it."""

import pytest

from symgraph import api
from symgraph.operators import render

SOURCES = {
    "store/db.py": '''"""Database."""
class Store:
    def load(self, key):
        return key

    def save(self, key, value):
        return self.load(key)


def connect(url) -> Store:
    return Store()
''',
    "store/cache.py": '''from store.db import Store


def warm(x: Store):
    s = Store()
    s.load(1)
    return helper(x)


def helper(value):
    return warm(value)
''',
    "web/routes.py": '''from store.cache import warm

@app.get("/api/items")
def list_items():
    return warm(1)
''',
    "web/view.ts": '''import { Panel } from "./panel";
export class View extends Panel {
  panel: Panel;
  show() { this.paint(); fetch("/api/items"); }
  paint() { return new Panel(); }
}
''',
    "web/panel.ts": "export class Panel {\n  draw() { return 1; }\n}\n",
    "node_modules/x.py": "def hidden(): pass\n",
    "package.json": '{"dependencies": {"left": "1"}, "scripts": {"run": "x"}}',
}


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    for path, text in SOURCES.items():
        (root / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (root / "src" / path).write_text(text)
    return api.set_workspace(spark, str(root / "index"), str(root / "src")), root / "src"


def names(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_tables(workspace):
    w, _ = workspace
    symbols = w.table("symbols").join(w.table("files"), "file_id")
    assert {("Store", "class"), ("load", "method"), ("warm", "function"), ("View", "type"), ("left", "dependency"), ("run", "script")} <= names(symbols, "name", "kind")
    assert not symbols.where("name = 'hidden'").count()
    own = {r.symbol_id: r.name for r in symbols.collect()}
    edges = {(own.get(r.source_symbol_id), own[r.target_symbol_id], r.kind) for r in w.table("edges").collect()}
    assert {("warm", "helper", "calls"), ("helper", "warm", "calls"), ("list_items", "warm", "calls"), ("warm", "load", "method_call"), ("show", "paint", "method_call"), ("View", "Panel", "extends"), (None, "list_items", "interaction")} <= edges
    assert w.table("features").count() == symbols.count() and w.table("concepts").where("concept = 'database'").count() > 0
    assert not w.table("features").where("is_entrypoint").join(symbols, "symbol_id").where("name <> 'list_items'").count()


def test_tools(workspace):
    w, _ = workspace
    assert w.repository_stats().first().files == 6 and w.repository_stats("store/").first().files == 2
    best = w.search_codebase("warm").first()
    assert best.name == "warm" and best.label == "High (Exact Match)"
    assert ("db.py", "text") in names(w.search_codebase("def connect", "text"), "name", "kind")
    assert w.search_codebase("conn", "text", whole_word=True).count() == 0
    hot = [r.name for r in w.architectural_hotspots().collect()]
    assert {"Store", "Panel", "warm"} <= set(hot)
    assert 2 in {r.length for r in w.dependency_cycles().collect()}
    counts, examples = w.subsystem_communication("web", "store")
    assert names(counts, "direction") == {("a_to_b",)} and examples.count() > 0
    around = names(w.get_context("warm"), "section", "name")
    assert {("callers", "helper"), ("callers", "list_items"), ("callees", "helper"), ("callees", "load"), ("siblings", "helper"), ("same_file_callers", "helper")} <= around
    assert ("source",) in names(w.get_edit_context("warm"), "section")
    source = w.read_symbol_source("helper").first()
    assert source.status == "bytes" and source.source == "def helper(value):\n    return warm(value)"
    assert len(names(w.read_symbol_source("connect", True), "symbol_id")) >= 1
    assert "return key" not in w.read_file_skeleton("store/db.py").first().skeleton and "return self.load" not in w.read_file_skeleton("db.py").first().skeleton
    assert w.read_file_snippet("web/panel.ts", 2, 2).first().text == "  draw() { return 1; }"
    nodes, edges = w.explore_graph("list_items", 2)
    assert {r.level for r in nodes.collect()} == {0, 1, 2} and edges.count() >= 3
    assert w.shortest_path("list_items", "helper").count() == 3 and w.shortest_path("helper", "nothing").count() == 0
    assert w.find_duplicate_logic(500).count() == 0
    assert names(w.list_entrypoints(), "group", "name") == {("routes", "list_items")}
    assert "list_items" in render.sections_markdown("warm", w.get_context("warm").select("section", "name"), value="name")


def test_reindexing(workspace):
    w, root = workspace
    assert w.reindex_workspace() == "unchanged"
    (root / "store" / "cache.py").write_text(SOURCES["store/cache.py"] + "\n\ndef late():\n    return helper(2)\n")
    stale = w.read_symbol_source("helper").first()
    assert stale.status == "stale" and stale.source is None
    assert w.reindex_workspace() == "changed"
    assert ("callers", "late") in names(w.get_context("helper"), "section", "name") and w.read_symbol_source("helper").first().status == "bytes"

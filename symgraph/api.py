"""The tools of the engine by name, over an index of a folder: build or refresh it, then ask.

An index is a set of tables (see sources.index) that is published as a whole. Every answer is a DataFrame; render turns one
into JSON or Markdown.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.scalars import scope_path
from symgraph.functions.tables import materialize
from symgraph.operators import classify, context, features, flow, linking, paths, relational, resolve, resolver, retrieval, search, subsystem
from symgraph.sources import index, python_frontend, repository, text_frontends


def numbered(rows: DataFrame, column: str, *order: str) -> DataFrame:
    """rows with ids from 1 upward that follow an order, not without gaps; written, so that they stay."""
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(rows.withColumn(column, F.monotonically_increasing_id() + 1), column)


def build(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of an index of files (path, content, content_hash): parse, resolve, link, then features and concepts, which see all edges."""
    files = numbered(files.select("path", "content", "content_hash"), "file_id", "path")
    ids = files.select("path", "file_id")
    python = python_frontend.parsed_tables(files)
    other = text_frontends.parsed_tables(files)
    config = repository.manifest_symbols(files).select("path", "name", "kind", F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"), F.lit(0).cast("long").alias("start_byte"), F.lit(0).cast("long").alias("end_byte"))
    found = python[0].unionByName(other[0]).unionByName(config, allowMissingColumns=True).join(ids, "path")
    symbols = numbered(found.dropDuplicates(["file_id", "name", "kind", "start_byte"]), "symbol_id", "path", "start_byte", "end_byte", "name", "kind")
    relationships = numbered(python[1].unionByName(other[1]).join(ids, "path"), "rel_id", "path", "line_number", "kind", "name")
    bindings = python_frontend.parse_bindings(files).unionByName(other[2].select("path", "kind", "name", "type_name", "context"))
    bindings = numbered(bindings.join(ids, "path"), "binding_id", "path", "kind", "name", "type_name")
    symbols = symbols.drop("path")
    packages = [r.package for r in flow.local_packages(files).limit(10_000).collect()]  # names of a repository's own packages
    resolved = materialize(flow.resolve(ids, symbols, relationships.drop("path"), bindings.drop("path"), packages), "resolved")
    routes = classify.entrypoints(symbols, ids).where("class = 'Route'").select("symbol_id", "name", "attributes")
    links = linking.interactions(files.select("file_id", "content"), routes).select("source_file_id", F.lit(None).cast("long").alias("source_symbol_id"), "target_symbol_id", F.lit("interaction").alias("kind"), F.lit("static").alias("edge_type"), "confidence").distinct()
    edges = materialize(flow.edges_of(resolved).unionByName(links), "edges")
    return {
        "files": files,
        "symbols": symbols,
        "relationships": resolved,
        "bindings": bindings.drop("path"),
        "edges": edges,
        "features": features.feature_table(ids, symbols, edges),
        "concepts": search.concept_tags(symbols, ids),
    }


@dataclass
class Workspace:
    """An index below `root`, of the sources below `source`. Tables of the current version are read anew after each publish."""

    spark: SparkSession
    root: str
    source: str
    _tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = index.read(self.spark, self.root, name)
        return self._tables[name]

    def _contents(self) -> DataFrame:
        """(file_id, path, content) of the indexed files as they are now."""
        return self.table("files").select("file_id", "path").join(repository.walk(self.spark, self.source).select("path", "content"), "path")

    def _scope(self, scope: str | None) -> str | None:
        return self.spark.range(1).select(scope_path(F.lit(scope), self.source)).first()[0] if scope else None

    def reindex_workspace(self) -> str:
        """Build the index if any file has changed since the last one, and publish it. Returns changed or unchanged."""
        now = materialize(repository.walk(self.spark, self.source), "walked")
        if index.current(self.spark, self.root):
            states = repository.changes(self.table("files").select("path", "content_hash"), now.select("path", "content_hash"))
            if states.where("state <> 'Unchanged'").isEmpty():
                return "unchanged"
        index.publish(self.spark, self.root, build(now))
        self._tables.clear()
        return "changed"

    def repository_stats(self, scope: str | None = None) -> DataFrame:
        return relational.overview_totals(self.table("files"), self.table("symbols"), self.table("edges"), self._scope(scope))

    def search_codebase(self, query: str, mode: str = "symbol", scope: str | None = None, limit: int = 15, concepts: bool = True, whole_word: bool = False) -> DataFrame:
        table = self.table("symbols").join(self.table("features"), "symbol_id")
        texts = self._contents() if mode in ("text", "both") else None
        found = search.search(self.table("files"), table, query, self._scope(scope), limit, mode, texts, query if whole_word else None)
        return search.augmented(found, self.table("concepts"), self.table("symbols"), self.table("files"), query) if concepts and mode != "text" else found

    def architectural_hotspots(self, limit: int = 20, scope: str | None = None) -> DataFrame:
        return relational.hotspots_symbols(self.table("files"), self.table("symbols"), self.table("edges"), limit, self._scope(scope))

    def dependency_cycles(self, limit: int = 25, longest: int = 6) -> DataFrame:
        arcs = paths.dependency_graph(self.table("files"), self.table("symbols"), self.table("edges"))
        inside = paths.strong_components(arcs)
        a, b = inside.select(F.col("node").alias("src"), "component"), inside.select(F.col("node").alias("dst"), F.col("component").alias("other"))
        return resolver.cycles(arcs.join(a, "src").join(b, "dst").where("component = other").select("src", "dst"), longest, limit)

    def subsystem_communication(self, a: str, b: str) -> tuple[DataFrame, DataFrame]:
        return subsystem.communication(self.table("files"), self.table("symbols"), self.table("edges"), a, b)

    def resolve_name(self, name: str, file_hint: str | None = None) -> DataFrame:
        queries = self.spark.range(1).select(F.lit(name).alias("query"))
        return resolve.resolve_names(queries, self.table("symbols"), self.table("files"), file_hint)

    def _symbol(self, name: str, file_hint: str | None = None) -> int | None:
        """The one symbol of a name, or none if there is none or several."""
        found = self.resolve_name(name, file_hint).first()
        return found.symbol_id if found.outcome == "Symbol" else None

    def get_context(self, name: str, file_hint: str | None = None) -> DataFrame:
        """Of all symbols of the name, unless a hint picks one."""
        one = self._symbol(name, file_hint)
        symbols = self.table("symbols")
        wanted = symbols.where(F.col("symbol_id") == one) if one is not None else symbols.where(F.col("name") == name)
        return context.symbol_context(wanted, symbols, self.table("edges"), self.table("relationships"))

    def get_edit_context(self, name: str) -> DataFrame:
        """The context, and in section source the text of each symbol of the name."""
        symbols = self.table("symbols").where(F.col("name") == name)
        sources = retrieval.symbol_sources(symbols, self.table("files"), self._contents()).where("source is not null")
        return self.get_context(name).unionByName(sources.select("symbol_id", F.lit("source").alias("section"), F.col("source").alias("name")))

    def read_symbol_source(self, name: str, dependencies: bool = False) -> DataFrame:
        symbols = self.table("symbols")
        own = symbols.where(F.col("name") == name)
        if dependencies:
            models = context.model_expansion(own, symbols, self.table("edges"))
            own = own.unionByName(symbols.join(models.select("name").distinct(), "name", "left_semi")).distinct()
        return retrieval.symbol_sources(own, self.table("files"), self._contents())

    def read_file_skeleton(self, path: str, target: str | None = None) -> DataFrame:
        files = self._contents().where(F.col("path").endswith(path.removeprefix("./")))
        return retrieval.skeletons(files, self.table("symbols"), target)

    def read_file_snippet(self, path: str, start: int, end: int) -> DataFrame:
        return repository.line_range(self._contents().where(F.col("path").endswith(path.removeprefix("./"))), start, end)

    def explore_graph(self, name: str, depth: int = 2, direction: str = "out", max_nodes: int = 100) -> tuple[DataFrame, DataFrame]:
        start = self.table("symbols").where(F.col("name") == name).select(F.col("symbol_id").alias("node"))
        return paths.explore(self.table("edges"), start, depth, direction, max_nodes)

    def shortest_path(self, source: str, target: str) -> DataFrame:
        """(step, node); no rows if a name isn't one symbol, or there is no path."""
        a, b = self._symbol(source), self._symbol(target)
        arcs = self.table("edges").select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"))
        if a is None or b is None:
            return self.spark.createDataFrame([], "step long, node long")
        return paths.shortest_path(arcs, a, b)

    def find_duplicate_logic(self, least: int = 15) -> DataFrame:
        symbols = self.table("symbols").where("kind not in ('import', 'jsx_element') and end_byte > start_byte")
        sources = retrieval.symbol_sources(symbols, self.table("files"), self._contents()).where("source is not null")
        return retrieval.structural_duplicates(sources.select("symbol_id", "source"), least)

    def list_entrypoints(self, scope: str | None = None) -> DataFrame:
        return context.entrypoint_list(self.table("symbols"), self.table("files"), classify.entrypoints, self._scope(scope))


def set_workspace(spark: SparkSession, root: str, source: str) -> Workspace:
    """The workspace of a folder of sources, indexed below root; built if there is no index yet."""
    workspace = Workspace(spark, root, source)
    if index.current(spark, root) is None:
        workspace.reindex_workspace()
    return workspace

"""Registered queries over the driver's tables, and the DuckDB SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import vocabulary as v
from symgraph.functions.scalars import call_literals, token_estimate, whole_word
from symgraph.operators import iterative, relational, search, usage
from symgraph.sources import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
CANONICAL = f"kind IN ({_quoted(v.CANONICAL_KINDS)})"

#: The adapter as DuckDB SQL.
GRAPH_SQL = """WITH files AS (
  SELECT CAST(n_nationkey AS BIGINT) + 1 AS file_id, concat('./src/', replace(lower(r_name),' ','_'), '/', replace(lower(n_name),' ','_'), '.ts') AS path
  FROM nation JOIN region ON n_regionkey = r_regionkey),
symbols AS (
  SELECT 10000000 + s_suppkey AS symbol_id, CAST(s_nationkey AS BIGINT) + 1 AS file_id, s_name AS name, 'function' AS kind, CAST(1 AS BIGINT) AS start_line, CAST(10 AS BIGINT) AS end_line FROM supplier
  UNION ALL SELECT 20000000 + c_custkey, CAST(c_nationkey AS BIGINT) + 1, c_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'class' WHEN 'MACHINERY' THEN 'variable' ELSE 'method' END, 11, 20 FROM customer
  UNION ALL SELECT 30000000 + p_partkey, p_partkey % 25 + 1, p_name, 'constant', 21, 30 FROM part),
raw_edges AS (
  SELECT 20000000 + o_custkey AS source_symbol_id, 10000000 + l_suppkey AS target_symbol_id, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'method_call' END AS kind,
         CASE WHEN l_discount >= 0.05 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 10000000 + l_suppkey, 30000000 + l_partkey, 'type_ref', CAST(1 AS DOUBLE) FROM lineitem
  UNION ALL SELECT 30000000 + l_partkey, 10000000 + min(l_suppkey), 'inherits', CAST(1 AS DOUBLE) FROM lineitem GROUP BY l_partkey),
edges AS (
  SELECT s.file_id AS source_file_id, r.source_symbol_id, r.target_symbol_id, r.kind, 'static' AS edge_type, max(r.confidence) AS confidence
  FROM raw_edges r JOIN symbols s ON s.symbol_id = r.source_symbol_id GROUP BY ALL),
relationships AS (
  SELECT l_orderkey * 8 + l_linenumber AS rel_id, CAST(c_nationkey AS BIGINT) + 1 AS file_id, s_name AS name, CAST(l_linenumber AS BIGINT) * 4 AS line_number,
         CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'method_call' END AS kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
tool_events AS (
  SELECT event_id AS id, event_type AS tool_name, event_type <> 'error' AS success, CAST(trunc(value * 10) AS BIGINT) AS execution_time_ms, user_id AS delivered_token_count,
         greatest(CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 - user_id, 0) AS token_reduction, event_id % 3 = 0 AS cache_hit, ts AS created_at FROM events),
degrees AS (
  SELECT s.*, COALESCE(i.n, 0) AS fan_in, COALESCE(o.n, 0) AS fan_out FROM symbols s
  LEFT JOIN (SELECT target_symbol_id AS id, count(*) AS n FROM edges GROUP BY 1) i ON i.id = symbol_id LEFT JOIN (SELECT source_symbol_id AS id, count(*) AS n FROM edges GROUP BY 1) o ON o.id = symbol_id),
hot AS (
  SELECT symbol_id, name, path, incoming, outgoing, 3 * incoming + outgoing AS score, CASE WHEN incoming > 20 THEN 'critical' WHEN incoming > 10 THEN 'important' ELSE 'normal' END AS class FROM (
    SELECT s.symbol_id, s.name, f.path, COALESCE(i.n, 0) AS incoming, COALESCE(o.n, 0) AS outgoing FROM symbols s JOIN files f USING (file_id)
    LEFT JOIN (SELECT target_symbol_id AS id, count(*) AS n FROM edges WHERE [canonical] GROUP BY 1) i ON i.id = symbol_id LEFT JOIN (SELECT source_symbol_id AS id, count(*) AS n FROM edges WHERE [canonical] GROUP BY 1) o ON o.id = symbol_id)
  WHERE incoming + outgoing > 0),
spots AS (
  SELECT file_id, line_number, arg_min(symbol_id, struct_pack(a := end_line - start_line, b := symbol_id)) AS enclosing FROM (SELECT DISTINCT file_id, line_number FROM relationships) r
  JOIN (SELECT file_id, start_line, end_line, min(symbol_id) AS symbol_id FROM symbols WHERE kind NOT IN ([not_enclosing]) GROUP BY 1, 2, 3) s USING (file_id) WHERE line_number BETWEEN start_line AND end_line GROUP BY 1, 2),
states AS (
  SELECT rel_id, r.file_id, r.line_number, r.kind, COALESCE(c.n, 0) AS n, c.first, enclosing, CASE WHEN c.n > 1 THEN 'Ambiguous' WHEN c.n = 1 AND c.first = enclosing THEN 'Recursive' WHEN c.n = 1 THEN 'RepositorySymbol' WHEN r.kind IN ('method_call', 'MEMBER_ACCESS', 'annotation', 'generic_constraint') THEN 'Dynamic' ELSE 'Missing' END AS state
  FROM relationships r LEFT JOIN (SELECT name, count(*) AS n, min(symbol_id) AS first FROM symbols GROUP BY 1) c USING (name) LEFT JOIN spots USING (file_id, line_number))
""".replace("[canonical]", CANONICAL).replace("[not_enclosing]", _quoted(v.NOT_ENCLOSING_KINDS))

#: The rough graph (see the adapter) after it.
ROUGH_SQL = GRAPH_SQL + """, rfiles AS (FROM files UNION ALL SELECT 26 + r_regionkey, concat('./lib/', replace(lower(r_name), ' ', '_'), '/auth_index.py') FROM region),
rsymbols AS (SELECT *, start_line * 100 AS start_byte, end_line * 100 + 99 AS end_byte FROM (FROM symbols
  UNION ALL SELECT 40000000 + r_regionkey, 26 + r_regionkey, concat('notify_', replace(lower(r_name), ' ', '_')), 'class', 1, 99 FROM region
  UNION ALL SELECT 41000000 + n_nationkey, 26 + n_regionkey, concat('get_', replace(lower(n_name), ' ', '_')), 'method', n_nationkey * 3 + 2, n_nationkey * 3 + 3 FROM nation)),
redges AS (FROM edges UNION ALL SELECT c_nationkey + 1, 20000000 + c_custkey, 90000000 + c_custkey, 'calls', 'static', CAST(1 AS DOUBLE) FROM customer WHERE c_custkey % 50 = 0
  UNION ALL SELECT c_nationkey + 1, NULL, 10000001 + c_custkey % 7, 'interaction', 'static', CAST(1 AS DOUBLE) FROM customer WHERE c_custkey % 40 = 1
  UNION ALL SELECT c_nationkey + 1, 20000000 + c_custkey, 20000000 + c_custkey, 'calls', 'static', CAST(1 AS DOUBLE) FROM customer WHERE c_custkey % 60 = 7),
rdegrees AS (SELECT s.*, COALESCE(i.n, 0) AS fan_in, COALESCE(o.n, 0) AS fan_out, CAST(COALESCE(i.x, 0) + COALESCE(o.x, 0) AS BIGINT) AS interaction_count FROM rsymbols s
  LEFT JOIN (SELECT target_symbol_id AS id, count(*) AS n, count(*) FILTER (kind = 'interaction') AS x FROM redges GROUP BY 1) i ON i.id = symbol_id LEFT JOIN (SELECT source_symbol_id AS id, count(*) AS n, count(*) FILTER (kind = 'interaction') AS x FROM redges GROUP BY 1) o ON o.id = symbol_id)
"""


def _add(name: str, sql: str | None, graph: bool = True):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (GRAPH_SQL if graph else "") + sql
        return f

    return register


def _over_graph(name: str, sql: str | None):
    """Register a query of a Graph."""

    def register(f):
        return _add(name, sql)(lambda spark, sf_dir: f(adapter.graph(spark, sf_dir)))

    return register


def _over_rough(name: str, sql: str | None):
    """Register a query of the rough Graph."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(adapter.rough(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = ROUGH_SQL + sql
        return f

    return register


def _over_table(table: str, name: str, sql: str | None):
    """Register a query of one driver table."""

    def register(f):
        return _add(name, sql, graph=False)(lambda spark, sf_dir: f(adapter.read(spark, sf_dir, table)))

    return register


def _over_events(name: str, sql: str | None):
    def register(f):
        return _add(name, sql)(lambda spark, sf_dir: f(adapter.tool_events(spark, sf_dir)))

    return register


# relational ---------------------------------------------------------------------------------------------------------

_over_graph("overview_totals", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges")(lambda g: relational.overview_totals(g.files, g.symbols, g.edges))
_over_graph("overview_scoped", "SELECT (SELECT count(*) FROM files WHERE contains(path, 'src/asia')) AS files, (SELECT count(*) FROM symbols JOIN files USING (file_id) WHERE contains(path, 'src/asia')) AS symbols, (SELECT count(*) FROM edges JOIN files ON source_file_id = file_id WHERE contains(path, 'src/asia')) AS edges")(lambda g: relational.overview_totals(g.files, g.symbols, g.edges, "src\\asia"))
_over_graph("language_histogram", "SELECT regexp_extract(path, '\\.([^./]+)$', 1) AS extension, count(*) AS n FROM files GROUP BY 1")(lambda g: relational.language_histogram(g.files))
_over_graph("top_directories", "SELECT regexp_replace(path, '/[^/]*$', '') AS directory, count(*) AS file_count, CAST(sum(COALESCE(n, 0)) AS BIGINT) AS symbol_count FROM files LEFT JOIN (SELECT file_id, count(*) AS n FROM symbols GROUP BY 1) USING (file_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")(lambda g: relational.top_directories(g.files, g.symbols))
_over_graph("edge_kind_distribution", "SELECT kind, count(*) AS n FROM edges GROUP BY 1")(lambda g: relational.kind_distribution(g.edges))
_over_graph("symbol_kind_distribution", "SELECT kind, count(*) AS n FROM symbols GROUP BY 1")(lambda g: relational.kind_distribution(g.symbols))
_over_graph("degree", "SELECT symbol_id, fan_in, fan_out FROM degrees")(lambda g: relational.degree(g.symbols, g.edges).select("symbol_id", "fan_in", "fan_out"))
_over_graph("hotspots_symbols", "SELECT * FROM hot ORDER BY score DESC, incoming DESC, incoming + outgoing DESC, name, path, symbol_id LIMIT 20")(lambda g: relational.hotspots_symbols(g.files, g.symbols, g.edges))
_over_graph("hotspots_scoped", "SELECT * FROM hot WHERE contains(path, 'europe') ORDER BY score DESC, incoming DESC, incoming + outgoing DESC, name, path, symbol_id LIMIT 20")(lambda g: relational.hotspots_symbols(g.files, g.symbols, g.edges, scope="europe"))
_over_graph("hotspots_files", "SELECT path, count(*) AS n_symbols, CAST(sum(score) AS BIGINT) AS score, CAST(sum(incoming) AS BIGINT) AS incoming, CAST(sum(outgoing) AS BIGINT) AS outgoing FROM hot GROUP BY 1")(lambda g: relational.hotspots_files(g.files, g.symbols, g.edges))
_over_rough("orphan_symbols", "SELECT symbol_id FROM rsymbols WHERE symbol_id NOT IN (SELECT source_symbol_id FROM redges WHERE source_symbol_id IS NOT NULL UNION SELECT target_symbol_id FROM redges)")(lambda g: relational.orphan_symbols(g.symbols, g.edges))
_over_rough("dangling_edges", "SELECT source_file_id, source_symbol_id, target_symbol_id, kind, edge_type, confidence FROM redges WHERE target_symbol_id NOT IN (SELECT symbol_id FROM rsymbols)")(lambda g: relational.dangling_edges(g.symbols, g.edges))
_over_rough("isolated_files", "SELECT file_id, path FROM rfiles WHERE file_id NOT IN (SELECT source_file_id FROM redges JOIN rsymbols ON target_symbol_id = symbol_id WHERE source_file_id <> file_id)")(lambda g: relational.isolated_files(g.files, g.symbols, g.edges))
_over_graph("edge_endpoints_union", "SELECT source_symbol_id AS symbol_id FROM edges UNION SELECT target_symbol_id FROM edges")(lambda g: relational.endpoints(g.edges))
_over_rough("validation_counts", "SELECT *, dangling = 0 AND duplicates = 0 AS is_valid FROM (SELECT (SELECT count(*) FROM redges WHERE target_symbol_id NOT IN (SELECT symbol_id FROM rsymbols)) AS dangling, (SELECT count(*) FROM (SELECT 1 FROM redges GROUP BY source_file_id, source_symbol_id, target_symbol_id, kind, edge_type HAVING count(*) > 1)) AS duplicates, (SELECT count(*) FROM redges WHERE source_symbol_id = target_symbol_id) AS self_loops)")(lambda g: relational.validation_counts(g.symbols, g.edges))
_over_graph("edge_coverage", "SELECT count(*) AS symbols, (SELECT count(DISTINCT source_symbol_id) FROM edges) AS with_edges, round(100.0 * (SELECT count(DISTINCT source_symbol_id) FROM edges) / count(*), 6) AS percent FROM symbols")(lambda g: relational.edge_coverage(g.symbols, g.edges))
_over_graph("neighbors_in", "SELECT DISTINCT s.name FROM edges JOIN symbols s ON source_symbol_id = s.symbol_id WHERE target_symbol_id IN (SELECT symbol_id FROM symbols WHERE name = 'Supplier#000000003')")(lambda g: relational.neighbours(g.symbols, g.edges, "Supplier#000000003", False))
_over_graph("neighbors_out", "SELECT DISTINCT s.name FROM edges JOIN symbols s ON target_symbol_id = s.symbol_id WHERE source_symbol_id IN (SELECT symbol_id FROM symbols WHERE name = 'Supplier#000000003')")(lambda g: relational.neighbours(g.symbols, g.edges, "Supplier#000000003", True))
_over_graph("neighbors_confident", f"SELECT DISTINCT s.name FROM edges e JOIN symbols s ON source_symbol_id = s.symbol_id WHERE target_symbol_id IN (SELECT symbol_id FROM symbols WHERE name = 'Supplier#000000003') AND (e.{CANONICAL} OR (e.kind IN ('method_call', 'MEMBER_ACCESS') AND confidence >= 0.5))")(lambda g: relational.neighbours(g.symbols, relational.dependency(g.edges), "Supplier#000000003", False))
_over_graph("dependents_of", "SELECT path FROM edges JOIN files ON source_file_id = file_id WHERE target_symbol_id IN (SELECT symbol_id FROM symbols WHERE name = 'Supplier#000000003')")(lambda g: relational.dependents(g.files, g.symbols, g.edges, "Supplier#000000003"))
_over_graph("subsystem_edge_counts", f"SELECT regexp_replace(a.path, '/[^/]*$', '') AS from_dir, regexp_replace(b.path, '/[^/]*$', '') AS to_dir, count(*) AS n FROM edges e JOIN files a ON source_file_id = a.file_id JOIN symbols s ON target_symbol_id = symbol_id JOIN files b ON s.file_id = b.file_id WHERE e.{CANONICAL} GROUP BY 1, 2")(lambda g: relational.directory_edges(g.files, g.symbols, g.edges))
_over_graph("graph_snapshot_nodes", "SELECT symbol_id, name, fan_in, fan_out FROM degrees ORDER BY fan_in + fan_out DESC, symbol_id LIMIT 120")(lambda g: relational.snapshot_nodes(g.symbols, g.edges))
_over_graph("graph_snapshot_edges", ", top AS (SELECT symbol_id FROM degrees ORDER BY fan_in + fan_out DESC, symbol_id LIMIT 120) SELECT source_symbol_id, target_symbol_id, kind FROM edges WHERE source_symbol_id IN (FROM top) AND target_symbol_id IN (FROM top) ORDER BY 1, 2, 3 LIMIT 300")(lambda g: relational.snapshot_edges(g.symbols, g.edges))
_over_graph("most_depended_files", "SELECT path, count(*) AS incoming FROM edges JOIN symbols s ON target_symbol_id = symbol_id JOIN files f ON s.file_id = f.file_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda g: relational.most_depended_files(g.files, g.symbols, g.edges))


@_add("graph_metrics", "SELECT *, round((symbols - orphans) / CAST(symbols AS DOUBLE), 6) AS connectivity, round(edges / (CAST(symbols AS DOUBLE) * (symbols - 1)), 9) AS density, round((relationships - unresolved) / CAST(relationships AS DOUBLE), 6) AS resolution_rate FROM (SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM symbols WHERE symbol_id NOT IN (SELECT source_symbol_id FROM edges UNION SELECT target_symbol_id FROM edges)) AS orphans, (SELECT count(*) FROM files WHERE file_id NOT IN (SELECT source_file_id FROM edges JOIN symbols ON target_symbol_id = symbol_id WHERE source_file_id <> file_id)) AS isolated_files, (SELECT count(*) FROM relationships) AS relationships, (SELECT count(*) FROM relationships r WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_file_id = r.file_id AND e.kind = r.kind)) AS unresolved)")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = adapter.graph(spark, sf_dir)
    return relational.graph_metrics(g.files, g.symbols, g.edges, adapter.relationships(spark, sf_dir))


@_add("unresolved_relationships", "SELECT file_id, kind, rel_id FROM relationships r WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_file_id = r.file_id AND e.kind = r.kind AND e.source_file_id % 5 <> 0)")
def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth file's edges are left out."""
    return relational.unresolved_relationships(adapter.relationships(spark, sf_dir), adapter.edges(spark, sf_dir).where("source_file_id % 5 <> 0")).select("file_id", "kind", "rel_id")


@_add("enclosing_symbol", "SELECT rel_id, line_number, enclosing FROM states")
def enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.enclosing_symbols(adapter.relationships(spark, sf_dir), adapter.symbols(spark, sf_dir)).select("rel_id", "line_number", "enclosing")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = adapter.symbols(spark, sf_dir)
    return relational.name_candidates(relational.enclosing_symbols(adapter.relationships(spark, sf_dir), symbols), symbols)


@_add("name_candidates", "SELECT rel_id, n, first, state FROM states")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("rel_id", "n", "first", "state")


@_add("resolution_states", "SELECT state, kind, count(*) AS n FROM states GROUP BY 1, 2")
def resolution_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).groupBy("state", "kind").agg(F.count("*").alias("n"))


@_add("edge_builder_dedup", "SELECT DISTINCT file_id AS source_file_id, enclosing AS source_symbol_id, first AS target_symbol_id, kind FROM states WHERE state = 'RepositorySymbol' AND enclosing IS DISTINCT FROM first")
def edge_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.built_edges(adapter.relationships(spark, sf_dir), adapter.symbols(spark, sf_dir))


# usage --------------------------------------------------------------------------------------------------------------

_over_events("tool_stats", "SELECT tool_name, count(*) AS calls, CAST(sum(execution_time_ms) // count(*) AS BIGINT) AS avg_ms, CAST(sum(token_reduction) AS BIGINT) AS saved, CAST(sum(delivered_token_count) AS BIGINT) AS delivered, CAST(count(*) FILTER (NOT success) AS BIGINT) AS failures FROM tool_events GROUP BY 1")(usage.tool_stats)
_over_events("usage_totals", "SELECT count(*) AS calls, CAST(sum(token_reduction) AS BIGINT) AS saved, count(*) FILTER (NOT success) AS failures, round(avg(execution_time_ms), 4) AS avg_ms, round(100.0 * (count(*) - count(*) FILTER (NOT success)) / count(*), 4) AS success_percent, round(CAST(sum(token_reduction) AS DOUBLE) / 1000000 * 300, 4) AS cost_cents FROM tool_events")(usage.usage_totals)
_over_events("hourly_usage", ", b AS (SELECT date_trunc('hour', created_at) AS h, count(*) AS calls, CAST(sum(token_reduction) AS BIGINT) AS saved FROM tool_events GROUP BY 1 ORDER BY 1 DESC LIMIT 24) SELECT strftime(h, '%m/%d %H:00') AS label, calls, saved FROM b")(usage.hourly)
_over_events("cache_hit_rate", "SELECT round(100 * avg(CASE WHEN cache_hit THEN 1.0 ELSE 0.0 END), 6) AS percent FROM tool_events")(usage.cache_hit_rate)
_over_events("recent_errors", "SELECT id, tool_name, execution_time_ms FROM tool_events WHERE NOT success ORDER BY id DESC LIMIT 50")(usage.recent_errors)

# search, text, vectors ----------------------------------------------------------------------------------------------

QUERY = "supplier"
_RANKED = """, r AS (SELECT symbol_id, name, kind, path, fan_in, fan_out, CASE WHEN lower(name) = 'supplier' THEN 1000 WHEN starts_with(lower(name), 'supplier') THEN 500 WHEN contains(lower(name), 'supplier') THEN 250 ELSE 0 END
  + CASE WHEN lower(name) = 'supplier' THEN 100 WHEN levenshtein(lower(name), 'supplier') <= 1 THEN 50 WHEN levenshtein(lower(name), 'supplier') = 2 THEN 25 ELSE 0 END AS a, CASE WHEN contains(lower(path), 'supplier') THEN 250 ELSE 0 END AS b FROM degrees JOIN files USING (file_id)),
ranked AS (SELECT symbol_id, name, kind, path, CAST(trunc((a + b + 150) * (CASE WHEN kind IN ('function', 'method') THEN CAST(1.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) * (CASE WHEN kind = 'variable' THEN CAST(0.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)) AS BIGINT) + 2 * fan_in + fan_out AS score,
  CASE WHEN a >= 1000 THEN 'High (Exact Match)' WHEN a >= 500 THEN 'High (Prefix Match)' WHEN a >= 250 THEN 'Medium (Contains Match)' WHEN a >= 100 THEN 'Medium (Token Match)' WHEN a >= 50 THEN 'Low (Fuzzy Match)' ELSE 'Low (Weak Fuzzy)' END AS label FROM r WHERE a > 0 OR b > 0) """


def _ranked(g: adapter.Graph) -> DataFrame:
    return search.ranked_symbols(g.files, relational.degree(g.symbols, g.edges), QUERY)


_over_graph("search_symbols_ranked", _RANKED + "SELECT * FROM ranked WHERE score > 0 ORDER BY score DESC, name, path, symbol_id LIMIT 15")(lambda g: _ranked(g).drop("name_score").orderBy(F.desc("score"), "name", "path", "symbol_id").limit(15))
_over_graph("search_demoted", _RANKED + "SELECT symbol_id, name, rank, CASE WHEN rank > 1 THEN CAST(trunc(score * CAST(0.7 AS DOUBLE)) AS BIGINT) ELSE score END AS score, CASE WHEN rank > 1 THEN replace(label, 'High', 'Medium') ELSE label END AS label FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, path, symbol_id) AS rank FROM ranked WHERE score > 0)")(lambda g: search.demoted(_ranked(g)).select("symbol_id", "name", "rank", "score", "label"))
_CONCEPTS = "c AS (SELECT symbol_id, lower(name) AS n, lower(path) AS p FROM rsymbols JOIN rfiles USING (file_id)), tags AS (" + " UNION ALL ".join(f"SELECT symbol_id, '{k}' AS concept, CASE WHEN {' OR '.join(f"contains(n, '{w}')" for w in ws)} THEN 'name' ELSE 'path' END AS matched_on FROM c WHERE {' OR '.join(f"contains(n, '{w}') OR contains(p, '{w}')" for w in ws)}" for k, ws in v.CONCEPTS.items()) + ")"
_over_rough("concept_tags", f", {_CONCEPTS} FROM tags")(lambda g: search.concept_tags(g.symbols, g.files))
_over_table("documents", "text_search", "SELECT doc_id, line_number, CAST(length(line) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_number FROM documents) WHERE contains(lower(line), 'license') AND contains(lower(line), 'licensed') ORDER BY 1, 2 LIMIT 50")(lambda d: search.text_search(d, "licensed license"))
_over_table("documents", "text_search_whole_word", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^A-Za-z0-9_])version([^A-Za-z0-9_]|$)')")(lambda d: d.where(whole_word(F.col("text"), "version")).select("doc_id"))
_over_table("documents", "token_estimates", "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE round((length(text) / CAST(4 AS DOUBLE) + greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1) / CAST(0.75 AS DOUBLE)) / 2) END AS BIGINT) AS tokens FROM documents")(lambda d: d.select("doc_id", token_estimate(F.col("text")).alias("tokens")))
_over_table("documents", "duplicate_text_groups", "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY regexp_replace(trim(text), '[ \\t\\n\\r]+', ' ', 'g') HAVING count(*) > 1")(lambda d: d.groupBy(F.regexp_replace(F.trim("text"), r"[ \t\n\r]+", " ").alias("t")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "n"))
_over_table("pages", "link_literals", "SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) GROUP BY 1, 2")(lambda p: p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n")))
_CALL_TEXT = "concat('fetch( ''/api/', source, '/', doc_id % 50, ''') post(\"x\") put(`', lang, '`)')"
_over_table("documents", "call_literals", f"SELECT doc_id, lit, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_CALL_TEXT}, '(?:fetch|post|get|put|delete)\\(\\s*[\"''`]([^\"''`]+)[\"''`]', 1)) AS lit FROM documents) WHERE length(lit) >= 2 GROUP BY 1, 2")(
    lambda d: d.select("doc_id", F.explode(call_literals(F.concat(F.lit("fetch( '/api/"), "source", F.lit("/"), F.col("doc_id") % 50, F.lit("') post(\"x\") put(`"), "lang", F.lit("`)")))).alias("lit")).groupBy("doc_id", "lit").agg(F.count("*").alias("n"))
)

_COSINE = "SELECT b.vec_id, round(CASE WHEN nb * nq = 0 THEN 0 ELSE dot / (nb * nq) END, 6) AS similarity FROM (SELECT e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS dot, sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nb, sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nq FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) b ORDER BY 2 DESC, 1 LIMIT 10"


def _top10(vectors: DataFrame) -> DataFrame:
    query = vectors.where("vec_id = 0").select("embedding").first()  # one query vector
    return search.vector_top_k(vectors, list(query.embedding))


_over_table("embeddings", "vector_top_k", _COSINE)(_top10)


_NEAR = "SELECT q.vec_id AS query_id, e.vec_id, round(CASE WHEN nb * nq = 0 THEN 0 ELSE dot / (nb * nq) END, 6) AS similarity FROM (SELECT q, e, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS dot, sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nb, sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nq FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)"
_over_table("embeddings", "vector_search", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM ({_NEAR})) WHERE rank <= 10")(lambda e: search.vector_search(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")))

_SEMANTIC = """, q AS (SELECT embedding AS w, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nq FROM embeddings WHERE vec_id = 0),
near AS (SELECT name, path, start_line, symbol_id, round(CASE WHEN nb * nq = 0 THEN 0 ELSE dot / (nb * nq) END, 6) AS similarity FROM (SELECT s.*, path, nq, list_sum(list_transform(list_zip(embedding, w), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS dot, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nb
  FROM embeddings, q, symbols s, files f WHERE s.symbol_id = 10000001 + vec_id AND f.file_id = s.file_id AND label % 2 = 0 AND contains(path, 'src/')))"""


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of one model in scope by similarity to the first vector."""
    g, vectors = adapter.graph(spark, sf_dir), adapter.read(spark, sf_dir, "embeddings")
    own = search.symbol_vectors(adapter.symbol_embeddings(spark, sf_dir), g.symbols, g.files, "local", "src/")
    query = vectors.where("vec_id = 0").select("embedding").first()  # one query vector
    best = search.vector_top_k(own, list(query.embedding), 50, "symbol_id")
    return best.join(own.drop("embedding"), "symbol_id")


_add("semantic_symbols", _SEMANTIC + " SELECT symbol_id, name, path, similarity FROM near ORDER BY similarity DESC, symbol_id LIMIT 50")(lambda spark, sf_dir: _semantic(spark, sf_dir).select("symbol_id", "name", "path", "similarity"))


@_add("rrf_fusion", _RANKED.rstrip() + _SEMANTIC + """, legs AS (SELECT 0 AS leg, name, path, label, NULL AS line, row_number() OVER (ORDER BY score DESC, name, path, symbol_id) AS rank FROM (SELECT * FROM ranked WHERE score > 0 ORDER BY score DESC, name, path, symbol_id LIMIT 50)
  UNION ALL SELECT 1, name, path, 'Semantic Match', start_line, row_number() OVER (ORDER BY similarity DESC, symbol_id) FROM (SELECT * FROM near ORDER BY similarity DESC, symbol_id LIMIT 50))
SELECT name, path, CAST(round(s * 10000) AS BIGINT) AS score, label, line FROM (SELECT name, path, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 12) AS s, COALESCE(arg_min(label, leg * 1000 + rank) FILTER (starts_with(label, 'High (Exact')), arg_min(label, leg * 1000 + rank)) AS label,
  arg_min(line, leg * 1000 + rank) FILTER (line IS NOT NULL) AS line, bool_or(starts_with(label, 'High (Exact')) AS exact FROM legs GROUP BY 1, 2) ORDER BY s DESC, exact DESC, name, path LIMIT 15""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked search and a semantic one, fused."""
    words = _ranked(adapter.graph(spark, sf_dir)).orderBy(F.desc("score"), "name", "path", "symbol_id").limit(50)
    near = _semantic(spark, sf_dir).withColumn("label", F.lit("Semantic Match"))
    return search.rrf([search.ranked_leg(words, F.desc("score"), "name", "path", "symbol_id"), search.ranked_leg(near, F.desc("similarity"), "symbol_id", line=F.col("start_line"))])


# iterative ----------------------------------------------------------------------------------------------------------


def _arcs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"))


_BFS = ", b(node, level) AS (WITH RECURSIVE t(node, level) AS (SELECT CAST(20000001 AS BIGINT), 0 UNION SELECT target_symbol_id, level + 1 FROM t JOIN edges ON source_symbol_id = node WHERE level < 3) SELECT node, min(level) FROM t GROUP BY 1) "


def _start(g: adapter.Graph) -> DataFrame:
    return g.symbols.where("symbol_id = 20000001").select(F.col("symbol_id").alias("node"))


_over_graph("bfs_levels", _BFS + "SELECT node, CAST(level AS BIGINT) AS level FROM b")(lambda g: iterative.levels(_arcs(g.edges), _start(g), 3))
_over_graph("shortest_distance", _BFS + "SELECT CAST(level AS BIGINT) AS distance, count(*) AS n FROM b GROUP BY 1")(lambda g: iterative.levels(_arcs(g.edges), _start(g), 3).groupBy(F.col("level").alias("distance")).agg(F.count("*").alias("n")))
_over_graph("subtree_depths", ", both_ways AS (SELECT source_symbol_id AS a, target_symbol_id AS b FROM edges UNION SELECT target_symbol_id, source_symbol_id FROM edges), b(node, level) AS (WITH RECURSIVE t(node, level) AS (SELECT CAST(20000001 AS BIGINT), 0 UNION SELECT b, level + 1 FROM t JOIN both_ways ON a = node WHERE level < 2) SELECT node, min(level) FROM t GROUP BY 1) SELECT node, CAST(level AS BIGINT) AS level FROM b")(lambda g: iterative.levels(_arcs(g.edges).union(g.edges.select("target_symbol_id", "source_symbol_id")), _start(g), 2))
_PAGERANK = ", w AS (SELECT source_symbol_id AS src, target_symbol_id AS dst, count(*) / any_value(n) AS w FROM edges JOIN (SELECT source_symbol_id, CAST(count(*) AS DOUBLE) AS n FROM edges GROUP BY 1) USING (source_symbol_id) GROUP BY 1, 2), p0 AS (SELECT source_symbol_id AS node, CAST(1 AS DOUBLE) AS rank FROM edges UNION SELECT target_symbol_id, CAST(1 AS DOUBLE) FROM edges)" + "".join(f", p{i} AS MATERIALIZED (SELECT p0.node, 0.15 + 0.85 * COALESCE(s, 0) AS rank FROM p0 LEFT JOIN (SELECT dst, sum(rank * w) AS s FROM p{i - 1} JOIN w ON node = src GROUP BY 1) ON dst = node)" for i in range(1, 11))
_over_graph("pagerank", _PAGERANK + " SELECT node, round(rank, 5) AS rank FROM p10")(lambda g: iterative.pagerank(_arcs(g.edges)).select("node", F.round("rank", 5).alias("rank")))
_LABELS = ", both_ways AS (SELECT source_symbol_id AS src, target_symbol_id AS dst FROM edges UNION ALL SELECT target_symbol_id, source_symbol_id FROM edges), l0 AS (SELECT DISTINCT src AS node, src AS label FROM both_ways)" + "".join(f", l{i} AS MATERIALIZED (SELECT src AS node, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS r FROM both_ways JOIN l{i - 1} ON dst = node GROUP BY src, label) WHERE r = 1)" for i in range(1, 6))
_over_graph("label_propagation", _LABELS + " FROM l5")(lambda g: iterative.label_propagation(_arcs(g.edges)))
_over_graph("two_cycles", "SELECT DISTINCT least(x.source_symbol_id, x.target_symbol_id) AS a, greatest(x.source_symbol_id, x.target_symbol_id) AS b FROM edges x JOIN edges y ON x.source_symbol_id = y.target_symbol_id AND x.target_symbol_id = y.source_symbol_id WHERE x.source_symbol_id <> x.target_symbol_id")(lambda g: iterative.two_cycles(_arcs(g.edges)))


def _file_arcs(g: adapter.Graph) -> DataFrame:
    return g.edges.where("kind = 'inherits'").join(g.symbols, F.col("target_symbol_id") == F.col("symbol_id")).select(F.col("source_file_id").alias("src"), F.col("file_id").alias("dst"))


_over_graph("file_components", ", a AS (SELECT DISTINCT source_file_id AS x, file_id AS y FROM edges JOIN symbols ON target_symbol_id = symbol_id WHERE edges.kind = 'inherits'), u AS (FROM a UNION SELECT y, x FROM a), c AS (WITH RECURSIVE t(x, y) AS (SELECT x, x FROM u UNION SELECT t.x, u.y FROM t JOIN u ON t.y = u.x) SELECT x AS node, min(y) AS component FROM t GROUP BY 1) SELECT node, component FROM c")(lambda g: iterative.connected(_file_arcs(g)))

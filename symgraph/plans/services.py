"""Registered queries of features, search results, contexts, subsystems, retrieval and whole-index knowledge; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import scalars
from symgraph.functions import vocabulary as v
from symgraph.operators import classify, context, features, flow, knowledge, manifest, paths, relational, resolver, retrieval, search, subsystem
from symgraph.plans.catalogue import _CONCEPTS, _LABELS, _PAGERANK, ROUGH_SQL, _add, _arcs, _over_graph, _over_rough, _over_table, _quoted
from symgraph.sources import adapter, index

# features -------------------------------------------------------------------------------------------------------------

#: Rank and labels are those of the graph: the rough edges with a source are added to its edges.
_ROUGH_ARCS = _PAGERANK.replace("FROM edges", "FROM arcs").replace(", w AS", ", arcs AS (FROM redges WHERE source_symbol_id IS NOT NULL), w AS", 1)
_ROUGH_LABELS = _LABELS.replace("FROM edges", "FROM arcs")
_FEATURES = _ROUGH_ARCS + _ROUGH_LABELS + """, entry AS (SELECT symbol_id FROM rsymbols JOIN rfiles USING (file_id) WHERE suffix(path, '.py') AND name = 'main' AND kind = 'function'),
features AS (SELECT d.symbol_id, round(COALESCE(rank, 0), 5) AS pagerank, fan_in, fan_out, interaction_count, COALESCE(label, d.symbol_id) AS community_id, symbol_id IN (FROM entry) AS is_entrypoint, kind IN ('function', 'method') AS is_callable, kind = 'class' AS is_type,
  kind = 'variable' AS is_local, kind = 'constant' AS is_constant, NOT starts_with(name, '_') AS is_exported, NOT starts_with(name, '_') AS is_public, contains(name, 'generated') AS is_generated FROM rdegrees d LEFT JOIN p10 ON p10.node = d.symbol_id LEFT JOIN l5 ON l5.node = d.symbol_id)"""


def _features(g: adapter.Graph) -> DataFrame:
    return features.feature_table(g.files, g.symbols, g.edges).withColumn("pagerank", F.round("pagerank", 5))


_over_rough("feature_table", _FEATURES + " FROM features")(_features)
_over_rough("symbols_with_features", _FEATURES + " SELECT symbol_id, name, COALESCE(fan_in, 0) AS fan_in, COALESCE(is_callable, false) AS is_callable FROM rsymbols LEFT JOIN (FROM features WHERE fan_in > 3) f USING (symbol_id)")(lambda g: features.with_features(g.symbols, _features(g).where("fan_in > 3")).select("symbol_id", "name", "fan_in", "is_callable"))
_over_rough("feature_coverage", _FEATURES + " SELECT count(*) AS symbols, count(f.symbol_id) AS with_features, count(*) FILTER (is_entrypoint) AS entrypoints, round(100.0 * count(f.symbol_id) / count(*), 6) AS percent FROM rsymbols s LEFT JOIN (FROM features WHERE fan_out > 1) f USING (symbol_id)")(lambda g: features.coverage(g.symbols, _features(g).where("fan_out > 1")))
_over_rough("community_count", _FEATURES + " SELECT count(DISTINCT community_id) AS communities FROM features")(lambda g: features.communities_count(_features(g)))
_over_rough("manifest_by_rank", _FEATURES + """, m AS (SELECT symbol_id, unnest(['fan_in', 'fan_out', 'connections', 'pagerank']) AS metric, unnest([CAST(fan_in AS DOUBLE), fan_out, fan_in + fan_out, pagerank]) AS value FROM features)
SELECT metric, symbol_id, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, symbol_id) AS r FROM m WHERE value > 0) WHERE r = 1""")(lambda g: manifest.largest(_features(g)))
_over_rough("interaction_counts", " SELECT symbol_id, interaction_count FROM rdegrees WHERE interaction_count > 0")(lambda g: relational.degree(g.symbols, g.edges).where("interaction_count > 0").select("symbol_id", "interaction_count"))
_over_rough("incident_counts", " SELECT symbol_id, count(*) AS n FROM (SELECT source_symbol_id AS symbol_id FROM redges WHERE source_symbol_id IS NOT NULL UNION ALL SELECT target_symbol_id FROM redges WHERE source_symbol_id IS DISTINCT FROM target_symbol_id) GROUP BY 1")(lambda g: relational.incident_counts(g.edges))
_over_rough("snapshot_by_rank", _FEATURES + " SELECT symbol_id, fan_in, fan_out, pagerank FROM features ORDER BY fan_in + fan_out DESC, pagerank DESC, symbol_id LIMIT 120")(lambda g: _features(g).select("symbol_id", "fan_in", "fan_out", "pagerank").orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), F.desc("pagerank"), "symbol_id").limit(120))
_EMBEDDED = "(SELECT 10000001 + vec_id AS symbol_id, CASE WHEN label % 2 = 0 THEN 'local' ELSE 'remote' END AS model_id, embedding, sha256(CAST(label AS VARCHAR)) AS body_hash FROM embeddings)"
_add("embedded_counts", f"SELECT model_id, count(DISTINCT symbol_id) AS n FROM {_EMBEDDED} GROUP BY 1", graph=False)(lambda spark, sf_dir: features.embedded_counts(adapter.symbol_embeddings(spark, sf_dir)))
_add("embedding_candidates", f" SELECT s.symbol_id, path, kind, name, body_hash FROM symbols s JOIN files USING (file_id) LEFT JOIN (FROM {_EMBEDDED} WHERE model_id = 'local') USING (symbol_id)")(lambda spark, sf_dir: search.embedding_candidates(adapter.symbol_embeddings(spark, sf_dir), adapter.symbols(spark, sf_dir), adapter.files(spark, sf_dir), "local"))
_add("vector_reuse", f"SELECT body_hash, min(symbol_id) AS symbol_id FROM {_EMBEDDED} WHERE model_id = 'remote' GROUP BY 1", graph=False)(lambda spark, sf_dir: search.reuse_map(adapter.symbol_embeddings(spark, sf_dir), "remote"))

# search ---------------------------------------------------------------------------------------------------------------

#: A search over the rough graph with features, for a query of two words.
_SEARCH = _FEATURES + """, r AS (SELECT s.symbol_id, s.name, kind, path, fan_in, fan_out, is_entrypoint, pagerank, lower(s.name) AS n, lower(path) AS p FROM rsymbols s JOIN rfiles USING (file_id) JOIN features f ON f.symbol_id = s.symbol_id),
sc AS (SELECT *, CASE WHEN n = 'asia notify' THEN 1000 WHEN starts_with(n, 'asia notify') THEN 500 WHEN contains(n, 'asia notify') THEN 250 ELSE 0 END
  + CASE WHEN n = 'asia' THEN 100 WHEN levenshtein(n, 'asia') <= 1 THEN 50 ELSE 0 END + CASE WHEN n = 'notify' THEN 100 WHEN levenshtein(n, 'notify') <= 1 THEN 50 WHEN levenshtein(n, 'notify') = 2 THEN 25 ELSE 0 END AS a,
  CASE WHEN contains(p, 'asia notify') THEN 200 ELSE 0 END + CASE WHEN contains(p, 'asia') THEN 50 ELSE 0 END + CASE WHEN contains(p, 'notify') THEN 50 ELSE 0 END AS b FROM r),
ranked AS (SELECT symbol_id, name, kind, path, a, CAST(trunc((a + b + CASE WHEN len(list_intersect(string_split(p, '/'), ['app', 'src', 'server', 'backend', 'core', 'api'])) > 0 THEN 150 ELSE 0 END) * (CASE WHEN is_entrypoint THEN CAST(1.5 AS DOUBLE) WHEN kind IN ('function', 'method') THEN CAST(1.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
  * CASE WHEN kind = 'variable' THEN CAST(0.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END * least(CAST(1 AS DOUBLE) + CAST(0.1 AS DOUBLE) * pagerank, CAST(2.5 AS DOUBLE)))) AS BIGINT) + 2 * fan_in + fan_out AS score,
  CASE WHEN a >= 1000 THEN 'High (Exact Match)' WHEN a >= 500 THEN 'High (Prefix Match)' WHEN a >= 250 THEN 'Medium (Contains Match)' WHEN a >= 100 THEN 'Medium (Token Match)' WHEN a >= 50 THEN 'Low (Fuzzy Match)' ELSE 'Low (Weak Fuzzy)' END AS label FROM sc WHERE a > 0 OR b > 0),
rolled AS (SELECT CASE WHEN count(*) > 1 THEN regexp_extract(path, '[^/]*$', 0) ELSE min(name) END AS name, CASE WHEN count(*) > 1 THEN 'file_rollup' ELSE min(kind) END AS kind, path, max(score) AS score, CASE WHEN count(*) > 1 THEN 'Low (Weak Fuzzy)' ELSE min(label) END AS label, CASE WHEN count(*) > 1 THEN count(*) END AS members
  FROM ranked WHERE a = 0 AND score > 0 GROUP BY path),
named AS (SELECT name, kind, path, CASE WHEN rank > 1 THEN CAST(trunc(score * CAST(0.7 AS DOUBLE)) AS BIGINT) ELSE score END AS score, CASE WHEN rank > 1 THEN replace(label, 'High', 'Medium') ELSE label END AS label FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, path, symbol_id) AS rank FROM ranked WHERE a > 0 AND score > 0)),
found AS (SELECT path, lower(path) AS p, regexp_extract(lower(path), '[^/]*$', 0) AS f FROM rfiles),
filed AS (SELECT regexp_extract(path, '[^/]*$', 0) AS name, 'file' AS kind, path, base + CASE WHEN len(list_intersect(string_split(p, '/'), ['app', 'src', 'server', 'backend', 'core', 'api'])) > 0 THEN 150 ELSE 0 END AS score FROM (SELECT *, CASE WHEN f = 'asia notify' THEN 800 WHEN contains(f, 'asia notify') THEN 250 WHEN contains(p, 'asia notify') THEN 100 ELSE 0 END
  + CASE WHEN f = 'asia' THEN 100 WHEN contains(f, 'asia') THEN 50 WHEN contains(p, 'asia') THEN 25 ELSE 0 END + CASE WHEN f = 'notify' THEN 100 WHEN contains(f, 'notify') THEN 50 WHEN contains(p, 'notify') THEN 25 ELSE 0 END AS base FROM found) WHERE base > 0),
matched AS (SELECT name, kind, path, CAST(score AS BIGINT) AS score, CASE WHEN score >= 800 THEN 'High (Exact File Match)' WHEN score >= 250 THEN 'Medium (File Substring Match)' WHEN score >= 100 THEN 'Low (Token File Match)' ELSE 'Low (File Path Match)' END AS label FROM filed),
results AS (FROM (FROM named UNION ALL SELECT name, kind, path, score, label FROM rolled UNION ALL FROM matched) ORDER BY score DESC, name, path, kind LIMIT 15)"""
TWO_WORDS = "asia notify"


def _results(g: adapter.Graph, query: str = TWO_WORDS, limit: int = 15) -> DataFrame:
    return search.search(g.files, relational.degree(g.symbols, g.edges).drop("fan_in", "fan_out", "interaction_count").join(_features(g), "symbol_id"), query, limit=limit)


_over_rough("search_path_rollup", _SEARCH + " FROM rolled")(lambda g: search.path_rollup(search.ranked_symbols(g.files, g.symbols.join(_features(g), "symbol_id"), TWO_WORDS)))
_over_rough("search_files", _SEARCH + " FROM matched")(lambda g: search.file_matches(g.files, TWO_WORDS))
_over_rough("search_results", _SEARCH + " FROM results")(_results)
_over_rough("search_with_concepts", _SEARCH.replace("'asia notify'", "'notify'").replace("'asia'", "'no such token'").replace("LIMIT 15", "LIMIT 3") + f""", {_CONCEPTS}, more AS (SELECT name, kind, path, CAST(150 AS BIGINT) AS score, concat('Concept Match (', concept, ')') AS label FROM (SELECT s.name, s.kind, path, concept, s.symbol_id FROM tags JOIN rsymbols s USING (symbol_id) JOIN rfiles USING (file_id) WHERE concept = 'notifications') t
  WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.name = t.name AND r.path = t.path) ORDER BY symbol_id LIMIT 10) FROM results UNION ALL FROM more""")(lambda g: search.augmented(_results(g, "notify", 3), search.concept_tags(g.symbols, g.files), g.symbols, g.files, "notify"))
_FOUND = " SELECT symbol_id, name, path, kind, start_line, CAST(score AS BIGINT) AS score FROM (SELECT s.*, path, CASE WHEN lower(name) = 'notify_asis' THEN 1000 WHEN starts_with(lower(name), 'notify_asis') THEN 500 WHEN contains(lower(name), 'notify_asis') THEN 250 WHEN levenshtein(lower(name), 'notify_asis') <= 1 THEN 100 WHEN levenshtein(lower(name), 'notify_asis') = 2 THEN 50 ELSE 0 END AS score FROM rsymbols s JOIN rfiles USING (file_id)) WHERE score > 0 ORDER BY score DESC, name, path, symbol_id LIMIT 10"
_over_rough("find_symbols", _FOUND)(lambda g: search.find_symbols(g.symbols, g.files, "notify_asis"))
_over_rough("concept_symbols", f", {_CONCEPTS} FROM tags WHERE concept = 'auth'")(lambda g: search.symbols_of_concept(g.symbols, g.files, "auth"))
_over_table("documents", "text_previews", "SELECT doc_id, CASE WHEN octet_length(encode(trim(text))) > 160 THEN substr(trim(text), 1, 160) || '...' ELSE trim(text) END AS preview FROM documents")(lambda d: d.select("doc_id", context.text_preview(F.col("text")).alias("preview")))
_over_table("documents", "call_sites", "SELECT doc_id, regexp_matches(concat(lang, ' (', source, ' (x'), '(^|[^A-Za-z0-9_])src7[ \\t]*\\(') AS called FROM documents")(lambda d: d.select("doc_id", context.call_sites(F.concat("lang", F.lit(" ("), "source", F.lit(" (x")), "src7").alias("called")))

# contexts -------------------------------------------------------------------------------------------------------------

_OTHERS = _quoted([k for k in v.CANONICAL_KINDS if k != "calls"])
_CALLING = "(e.kind = 'calls' OR (e.kind IN ('method_call', 'MEMBER_ACCESS') AND confidence >= 0.5))"
_over_rough("symbol_context", f""", wanted AS (SELECT symbol_id, file_id, name FROM rsymbols WHERE symbol_id % 50 = 7 AND symbol_id < 30000000),
around AS (SELECT DISTINCT w.symbol_id, section, s.name FROM (SELECT target_symbol_id AS near, source_symbol_id AS far, 'callers' AS section FROM redges e WHERE {_CALLING} UNION ALL SELECT source_symbol_id, target_symbol_id, 'callees' FROM redges e WHERE {_CALLING}
  UNION ALL SELECT target_symbol_id, source_symbol_id, 'reverse_dependencies' FROM redges e WHERE e.kind IN ({_OTHERS}) UNION ALL SELECT source_symbol_id, target_symbol_id, 'forward_dependencies' FROM redges e WHERE e.kind IN ({_OTHERS})) x JOIN wanted w ON near = w.symbol_id JOIN rsymbols s ON s.symbol_id = far)
FROM around UNION SELECT a.symbol_id, 'same_file_callers', a.name FROM around a JOIN (SELECT name, arg_min(file_id, symbol_id) AS f FROM rsymbols GROUP BY 1) h USING (name) JOIN wanted w ON w.symbol_id = a.symbol_id WHERE section = 'callers' AND f = w.file_id
UNION SELECT w.symbol_id, 'siblings', s.name FROM wanted w JOIN rsymbols s USING (file_id) WHERE s.name <> w.name""")(lambda g: context.symbol_context(g.symbols.where("symbol_id % 50 = 7 and symbol_id < 30000000"), g.symbols, g.edges))
_over_rough("symbol_candidates", " SELECT symbol_id, name, kind, path, start_line FROM rsymbols JOIN rfiles USING (file_id) WHERE name = 'get_nation_3'")(lambda g: context.symbol_candidates(g.symbols, g.files, "get_nation_3"))
_over_rough("symbol_lookups", ", q AS (SELECT DISTINCT query FROM (SELECT upper(s_name) AS query FROM supplier UNION ALL SELECT p_name FROM part UNION ALL SELECT 'none')) SELECT query, folded_id, exact_id, exact_file_id FROM q LEFT JOIN (SELECT lower(name) AS k, min(symbol_id) AS folded_id FROM rsymbols GROUP BY 1) ON k = lower(query) LEFT JOIN (SELECT name, min(symbol_id) AS exact_id, arg_min(file_id, symbol_id) AS exact_file_id FROM rsymbols GROUP BY 1) ON name = query")(
    lambda g: context.lookups(g.symbols.where("kind = 'function'").select(F.upper("name").alias("query")).union(g.symbols.where("kind = 'constant'").select("name")).union(g.files.limit(1).select(F.lit("none"))), g.symbols)
)
_over_rough("context_targets", ", q AS (SELECT unnest(['get_nation_3', 'ASIA/nation_1_.ts', 'Supplier#000000003', 'nowhere']) AS query), x AS (SELECT name, min(symbol_id) AS symbol_id, arg_min(file_id, symbol_id) AS f FROM rsymbols GROUP BY 1) SELECT query, symbol_id, COALESCE(f, (SELECT min(file_id) FROM rfiles WHERE path ILIKE '%' || query || '%')) AS file_id FROM q LEFT JOIN x ON name = query")(
    lambda g: context.targets(g.files.limit(1).select(F.explode(F.array(*map(F.lit, ["get_nation_3", "ASIA/nation_1_.ts", "Supplier#000000003", "nowhere"]))).alias("query")), g.symbols, g.files)
)
_over_rough("names_in_files", " SELECT file_id, q.name, symbol_id FROM (SELECT DISTINCT file_id + 1 AS file_id, name FROM rsymbols WHERE kind = 'constant') q LEFT JOIN (SELECT file_id, name, min(symbol_id) AS symbol_id FROM rsymbols GROUP BY 1, 2) USING (file_id, name)")(lambda g: context.in_file(g.symbols.where("kind = 'constant'").select((F.col("file_id") + 1).alias("file_id"), "name"), g.symbols))
_over_rough("nodes_by_id", " SELECT symbol_id, CASE WHEN symbol_id % 4 = 0 THEN 'Entrypoint' ELSE 'Symbol' END AS node_kind, name, kind, path FROM rsymbols JOIN rfiles USING (file_id) WHERE symbol_id % 3 = 0")(lambda g: context.nodes(g.symbols.where("symbol_id % 3 = 0").select("symbol_id").union(g.symbols.limit(1).select(F.lit(-5).cast("long"))), g.symbols, g.files, g.symbols.select("symbol_id", (F.col("symbol_id") % 4 == 0).alias("is_entrypoint"))))
_over_rough("entrypoint_list", " SELECT 'cli' AS \"group\", path, name, kind FROM rsymbols JOIN rfiles USING (file_id) WHERE kind IN ('class', 'method') AND suffix(path, '.py')")(lambda g: context.entrypoint_list(g.symbols, g.files.withColumn("path", F.replace("path", F.lit("auth_index.py"), F.lit("__main__.py"))), classify.entrypoints).withColumn("path", F.replace("path", F.lit("__main__.py"), F.lit("auth_index.py"))))


def _signed(g: adapter.Graph) -> DataFrame:
    """Suppliers' symbols, with a signature that names part types of upper case, a class and themselves."""
    signature = F.concat(F.lit("(Depends x, "), F.initcap(F.lit("notify")), F.lit(": Model"), F.pmod("symbol_id", F.lit(7)), F.lit(", Model"), F.pmod("symbol_id", F.lit(7)), F.lit(") -> "), "name")
    return g.symbols.where("kind = 'function'").withColumn("signature", signature)


def _models(g: adapter.Graph) -> DataFrame:
    """Symbols Model, and for their files what inherits edges lead to."""
    extra = g.symbols.where("symbol_id >= 40000000 and kind = 'class'").limit(50).withColumns({"name": F.lit("Model"), "symbol_id": F.col("symbol_id") + 5_000_000})
    return g.symbols.unionByName(extra)


_over_rough("model_expansion", """, wanted AS (SELECT * FROM rsymbols WHERE kind = 'function'), base AS (SELECT DISTINCT source_file_id, t.name FROM redges e JOIN rsymbols t ON t.symbol_id = target_symbol_id WHERE e.kind = 'inherits'),
rows AS (SELECT symbol_id, 'Model' AS name, 0 AS a FROM wanted UNION SELECT w.symbol_id, b.name, 1 FROM wanted w JOIN base b ON b.source_file_id = w.file_id)
SELECT symbol_id, CAST(r - 1 AS INTEGER) AS place, name FROM (SELECT symbol_id, name, row_number() OVER (PARTITION BY symbol_id ORDER BY a, name) AS r FROM rows) WHERE r <= 8""")(lambda g: context.model_expansion(_signed(g), _models(g), g.edges))

# subsystems -----------------------------------------------------------------------------------------------------------

_over_table("documents", "subsystem_names", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'auth' WHEN doc_id % 4 = 1 THEN 'ui' WHEN doc_id % 4 = 2 THEN lower(source) ELSE 'database' END AS name FROM documents")(
    lambda d: d.select("doc_id", subsystem.canonical_name(F.element_at(F.array(F.lit(" Packages/Features/LOGIN/ "), F.lit("src/app/views"), F.concat(F.lit("features/"), F.upper("source")), F.lit("Postgres")), (F.col("doc_id") % 4 + 1).cast("int"))).alias("name"))
)
_over_rough("directories", " SELECT dir, CAST(sum(n) AS BIGINT) AS symbols, substr(dir, 3) AS short FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, COALESCE(n, 0) AS n FROM rfiles LEFT JOIN (SELECT file_id, count(*) AS n FROM rsymbols GROUP BY 1) USING (file_id)) GROUP BY 1")(lambda g: subsystem.directories(g.files, g.symbols))
_over_rough("directory_suggestions", " SELECT DISTINCT substr(regexp_replace(path, '/[^/]*$', ''), 3) AS short, unnest(CASE WHEN contains(path, 'rica/') THEN ['did_you_mean', 'known'] ELSE ['known'] END) AS kind FROM rfiles")(lambda g: subsystem.suggestions(subsystem.directories(g.files, g.symbols), "rica"))
_BETWEEN = """, x AS (SELECT CASE WHEN starts_with(a.path, './src/asia') THEN 'a_to_b' ELSE 'b_to_a' END AS direction, COALESCE(s.name, regexp_extract(a.path, '[^/]*$', 0)) AS from_name, a.path AS from_file, t.name AS to_name, b.path AS to_file, e.kind FROM redges e JOIN rfiles a ON a.file_id = e.source_file_id JOIN rsymbols t ON t.symbol_id = e.target_symbol_id JOIN rfiles b ON b.file_id = t.file_id LEFT JOIN rsymbols s ON s.symbol_id = e.source_symbol_id
  WHERE (starts_with(a.path, './src/asia') AND starts_with(b.path, './src/europe')) OR (starts_with(a.path, './src/europe') AND starts_with(b.path, './src/asia')))"""
_over_rough("directory_communication", _BETWEEN + " SELECT direction, count(*) AS n FROM x GROUP BY 1")(lambda g: subsystem.communication(g.files, g.symbols, g.edges, "src/asia/", "europe")[0])
_over_rough("communication_examples", _BETWEEN + " SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY from_file, from_name, to_file, to_name, kind) AS r FROM x) WHERE r <= 10")(lambda g: subsystem.communication(g.files, g.symbols, g.edges, "src\\asia", "europe")[1])
_MEMBERS = ", m AS (SELECT symbol_id, file_id FROM rsymbols WHERE symbol_id BETWEEN 10000001 AND 10000005)"
_members = lambda g: g.symbols.where("symbol_id between 10000001 and 10000005").select("symbol_id", "file_id")
_over_rough("subsystem_dependencies", _MEMBERS + " SELECT DISTINCT name FROM redges JOIN rsymbols s ON s.symbol_id = target_symbol_id WHERE source_file_id IN (SELECT file_id FROM m) AND s.symbol_id NOT IN (SELECT symbol_id FROM m)")(lambda g: subsystem.dependencies(_members(g), g.symbols, g.edges))
_over_rough("subsystem_consumers", _MEMBERS + " SELECT path FROM rfiles WHERE file_id IN (SELECT source_file_id FROM redges WHERE target_symbol_id IN (SELECT symbol_id FROM m)) AND file_id NOT IN (SELECT file_id FROM m)")(lambda g: subsystem.consumers(_members(g), g.files, g.edges))
_over_rough("subsystem_hash", _MEMBERS + " SELECT sha256(concat((SELECT string_agg('f' || file_id || '_', '' ORDER BY file_id) FROM (SELECT DISTINCT file_id FROM m)), (SELECT string_agg('s' || symbol_id || '_', '' ORDER BY symbol_id) FROM m))) AS hash")(lambda g: subsystem.membership_hash(_members(g)))
_over_rough("subsystem_report", _MEMBERS + """ SELECT 'files' AS section, path AS value FROM rfiles WHERE file_id IN (SELECT file_id FROM m) UNION SELECT 'symbols', name FROM rsymbols WHERE symbol_id IN (SELECT symbol_id FROM m)
UNION SELECT 'dependencies', name FROM redges JOIN rsymbols s ON s.symbol_id = target_symbol_id WHERE source_file_id IN (SELECT file_id FROM m) AND s.symbol_id NOT IN (SELECT symbol_id FROM m)
UNION SELECT 'consumers', path FROM rfiles WHERE file_id IN (SELECT source_file_id FROM redges WHERE target_symbol_id IN (SELECT symbol_id FROM m)) AND file_id NOT IN (SELECT file_id FROM m)
UNION SELECT 'hash', sha256(concat((SELECT string_agg('f' || file_id || '_', '' ORDER BY file_id) FROM (SELECT DISTINCT file_id FROM m)), (SELECT string_agg('s' || symbol_id || '_', '' ORDER BY symbol_id) FROM m)))
UNION SELECT 'entrypoints', name FROM rsymbols WHERE symbol_id IN (SELECT symbol_id FROM m) AND symbol_id % 2 = 0 UNION SELECT 'routes', name FROM rsymbols WHERE symbol_id IN (SELECT symbol_id FROM m) AND symbol_id % 4 = 0""")(
    lambda g: subsystem.report(_members(g), g.files, g.symbols, g.edges, g.symbols.where("symbol_id % 2 = 0").select("symbol_id", "name", F.when(F.col("symbol_id") % 4 == 0, "Route").otherwise("Page").alias("class")))
)
_over_rough("subsystem_clusters", _MEMBERS + """, a AS (SELECT DISTINCT source_file_id AS x, file_id AS y FROM redges JOIN rsymbols ON symbol_id = target_symbol_id WHERE source_file_id <> file_id AND source_file_id IN (SELECT file_id FROM m) AND file_id IN (SELECT file_id FROM m)), u AS (FROM a UNION SELECT y, x FROM a),
c AS (WITH RECURSIVE t(x, y) AS (SELECT x, x FROM u UNION SELECT t.x, u.y FROM t JOIN u ON t.y = u.x) SELECT x, min(y) AS y FROM t GROUP BY 1) SELECT x AS file_id, y AS cluster FROM c""")(lambda g: subsystem.clusters(_members(g), g.symbols, g.edges))
_over_rough("context_capsule", _MEMBERS.replace("symbol_id BETWEEN 10000001 AND 10000005", "symbol_id >= 40000000") + """ SELECT 'core_files' AS section, path AS value FROM rfiles WHERE file_id IN (SELECT file_id FROM m) UNION SELECT 'public_apis', name FROM rsymbols WHERE symbol_id >= 41000000 UNION SELECT 'entry_points', concat(name, ' in ', path) FROM rsymbols JOIN rfiles USING (file_id) WHERE symbol_id >= 41000000""")(
    lambda g: subsystem.capsule(g.symbols.where("symbol_id >= 40000000").select("symbol_id", "file_id"), g.files, g.symbols.where("symbol_id >= 41000000").join(g.files, "file_id").select("symbol_id", "name", "path"))
)

# resolution -----------------------------------------------------------------------------------------------------------


def _typed_references(spark: SparkSession, sf_dir: str) -> tuple[adapter.Graph, DataFrame, DataFrame]:
    """The rough graph; a method call for each line item on one of seven variables; types for five of them, one of an unknown type."""
    g = adapter.rough(spark, sf_dir)
    read = lambda name: adapter.read(spark, sf_dir, name)
    lower = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    items = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    references = items.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("rel_id"), (F.col("c_nationkey") + 1).cast("long").alias("file_id"), F.concat(F.lit("get_"), lower("n_name")).alias("name"), F.concat(F.lit("v"), F.col("l_linenumber")).alias("source"), (F.col("l_linenumber") * 4).cast("long").alias("line_number"), F.lit("method_call").alias("kind"))
    region = read("region").select((F.col("r_regionkey") + 1).alias("k"), F.concat(F.lit("notify_"), lower("r_name")).alias("t"))
    typed = read("nation").select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).join(region, "k")  # five types for each of 25 files
    bindings = typed.select((F.col("n_nationkey") * 10 + F.col("k")).cast("long").alias("binding_id"), (F.col("n_nationkey") + 1).cast("long").alias("file_id"), F.lit("var_type").alias("kind"), F.concat(F.lit("v"), F.col("k").cast("int")).alias("name"), F.when(F.col("k") == 5, "nothing").otherwise(F.col("t")).alias("type_name"))
    return g, references, bindings


_RESOLVED = """, ref AS (SELECT l_orderkey * 8 + l_linenumber AS rel_id, CAST(c_nationkey AS BIGINT) + 1 AS file_id, concat('get_', replace(lower(n_name), ' ', '_')) AS name, l_linenumber AS k, CAST(l_linenumber AS BIGINT) * 4 AS line_number, n_regionkey, CAST(41000000 + n_nationkey AS BIGINT) AS method FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
inner_most AS (SELECT file_id, line_number, arg_min(symbol_id, struct_pack(a := end_line - start_line, b := symbol_id)) AS enclosing FROM (SELECT DISTINCT file_id, line_number FROM ref) JOIN rsymbols USING (file_id) WHERE line_number BETWEEN start_line AND end_line AND kind NOT IN ('variable', 'constant') GROUP BY 1, 2),
resolved AS (SELECT rel_id, file_id, enclosing, CASE WHEN k > 5 OR (k < 5 AND n_regionkey = k - 1) THEN 'RepositorySymbol' ELSE 'Missing' END AS state, CASE WHEN k > 5 THEN 'LexicalScopeMatch' WHEN k < 5 AND n_regionkey = k - 1 THEN 'VariableAssignment' ELSE 'MissingImport' END AS evidence,
  CASE WHEN k > 5 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS confidence, CASE WHEN k > 5 OR (k < 5 AND n_regionkey = k - 1) THEN method END AS target FROM ref LEFT JOIN inner_most USING (file_id, line_number))"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, references, bindings = _typed_references(spark, sf_dir)
    untyped = references.withColumn("source", F.when(F.col("source").isin("v6", "v7"), F.lit(None)).otherwise(F.col("source")))
    return flow.resolve(g.files, g.symbols, untyped, bindings)


def _add_rough(name: str, sql: str | None):
    return _add(name, ROUGH_SQL + sql if sql else None, graph=False)


_add_rough("resolve_references", _RESOLVED + " SELECT rel_id, enclosing, state, evidence, confidence, target FROM resolved")(lambda spark, sf_dir: _resolved(spark, sf_dir).select("rel_id", "enclosing", "state", "evidence", "confidence", "target"))
_add_rough("resolved_edges", _RESOLVED + " SELECT file_id AS source_file_id, enclosing AS source_symbol_id, target AS target_symbol_id, 'method_call' AS kind, arg_min(confidence, rel_id) AS confidence, 'static' AS edge_type FROM resolved WHERE state = 'RepositorySymbol' GROUP BY 1, 2, 3")(lambda spark, sf_dir: flow.edges_of(_resolved(spark, sf_dir)))
_add_rough("builder_counts", _RESOLVED + """, c AS (SELECT count(*) AS input, count(*) FILTER (state = 'RepositorySymbol') AS repository, count(*) FILTER (state = 'Missing') AS missing, (SELECT count(*) FROM (SELECT DISTINCT file_id, enclosing, target FROM resolved WHERE state = 'RepositorySymbol')) AS after FROM resolved)
SELECT unnest(['input', 'repository', 'external', 'builtin', 'dynamic', 'missing', 'ambiguous', 'recursive', 'orphan', 'without_target', 'self_loops', 'edges_before', 'edges_after', 'collapsed']) AS metric, unnest([input, repository, 0, 0, 0, missing, 0, 0, 0, 0, 0, repository, after, repository - after]) AS n FROM c""")(lambda spark, sf_dir: knowledge.builder_counts(_resolved(spark, sf_dir)))
_add_rough("builder_invariants", " SELECT unnest(['states_make_input', 'edges_add_up', 'references_add_up']) AS rule, true AS holds")(lambda spark, sf_dir: knowledge.builder_invariants(knowledge.builder_counts(_resolved(spark, sf_dir))))
_over_rough("parent_symbols", " SELECT symbol_id, parent_id FROM (SELECT c.symbol_id, p.symbol_id AS parent_id, row_number() OVER (PARTITION BY c.symbol_id ORDER BY p.end_byte - p.start_byte, p.symbol_id) AS r FROM rsymbols c JOIN rsymbols p ON p.file_id = c.file_id AND p.start_byte <= c.start_byte AND p.end_byte >= c.end_byte AND p.symbol_id <> c.symbol_id WHERE c.file_id > 25) WHERE r = 1")(lambda g: flow.parents(g.symbols.where("file_id > 25")))
_over_rough("type_methods", " SELECT t.name AS type_name, m.name AS method, min(m.symbol_id) AS symbol_id FROM rsymbols m JOIN rsymbols t ON t.file_id = m.file_id AND t.kind = 'class' WHERE m.kind = 'method' AND m.file_id > 25 GROUP BY 1, 2")(lambda g: flow.type_methods(g.symbols.where("file_id > 25"), flow.parents(g.symbols.where("file_id > 25"))))
_over_rough("local_packages", " SELECT DISTINCT regexp_replace(part, '(\\.py)+$', '') AS package FROM (SELECT unnest(string_split(path, '/')) AS part FROM rfiles WHERE suffix(path, '.py')) WHERE part NOT IN ('', '.', '..')")(lambda g: flow.local_packages(g.files))
_over_rough("distinct_symbols", " SELECT file_id, kind, start_byte, count(*) AS n FROM (SELECT DISTINCT file_id, kind, start_byte, substr(name, 1, 3) FROM rsymbols) GROUP BY 1, 2, 3")(lambda g: flow.distinct_symbols(g.symbols.withColumn("name", F.substring("name", 1, 3))).groupBy("file_id", "kind", "start_byte").agg(F.count("*").alias("n")))
_add("distinct_references", " SELECT min(rel_id) AS rel_id, file_id, name, line_number, kind FROM relationships GROUP BY 2, 3, 4, 5")(lambda spark, sf_dir: flow.distinct_references(adapter.relationships(spark, sf_dir)).select("rel_id", "file_id", "name", "line_number", "kind"))
_over_rough("ancestors", """, i AS (SELECT source_symbol_id AS s, target_symbol_id AS t FROM redges WHERE kind = 'inherits' OR (kind = 'type_ref' AND source_symbol_id % 3 = 0)), b AS (WITH RECURSIVE r(node, level) AS (SELECT CAST(30000001 AS BIGINT), 0 UNION SELECT t, level + 1 FROM r JOIN i ON s = node WHERE level < 4) SELECT node, CAST(min(level) AS BIGINT) AS level FROM r GROUP BY 1) FROM b WHERE level > 0""")(
    lambda g: flow.ancestors(_arcs(g.edges.where("kind = 'inherits' or (kind = 'type_ref' and source_symbol_id % 3 = 0)")), g.symbols.where("symbol_id = 30000001").select(F.col("symbol_id").alias("node")), 4)
)
_STAGED = ", dec AS (SELECT kind AS stage, CASE WHEN state IN ('RepositorySymbol', 'Recursive') THEN 'Success' ELSE 'Failed' END AS status, CASE state WHEN 'Ambiguous' THEN 'MultipleCandidates' WHEN 'Dynamic' THEN 'DynamicPropertyAccess' ELSE 'MissingImport' END AS reason FROM states), bad AS (FROM dec WHERE status = 'Failed') "


@_add("decision_counts", _STAGED + """SELECT 'stage' AS section, stage AS key, count(*) AS n, count(*) FILTER (status = 'Failed') AS failed, NULL AS percent FROM dec GROUP BY 2 UNION ALL SELECT 'reason', reason, count(*), count(*), round(100.0 * count(*) / (SELECT count(*) FROM bad), 6) FROM bad GROUP BY 2
UNION ALL SELECT 'recoverability', CASE reason WHEN 'MultipleCandidates' THEN 'Expected' WHEN 'DynamicPropertyAccess' THEN 'Unrecoverable' ELSE 'Recoverable' END, count(*), count(*), round(100.0 * count(*) / (SELECT count(*) FROM bad), 6) FROM bad GROUP BY 2""")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = adapter.symbols(spark, sf_dir)
    rows = relational.name_candidates(relational.enclosing_symbols(adapter.relationships(spark, sf_dir), symbols), symbols)
    reason = F.when(F.col("state") == "Ambiguous", "MultipleCandidates").when(F.col("state") == "Dynamic", "DynamicPropertyAccess").otherwise("MissingImport")
    return knowledge.decision_counts(rows.select(F.col("kind").alias("stage"), F.when(F.col("state").isin("RepositorySymbol", "Recursive"), "Success").otherwise("Failed").alias("status"), reason.alias("reason")))


# knowledge ------------------------------------------------------------------------------------------------------------

_add_rough("repository_fingerprint", """ SELECT (SELECT count(*) FROM rfiles) AS total_files, (SELECT count(*) FROM rsymbols) AS total_symbols, (SELECT count(*) FROM relationships) AS total_relationships, 'Python,TypeScript' AS languages, 'Express' AS frameworks,
CASE WHEN (SELECT count(*) FROM rsymbols JOIN rfiles USING (file_id) WHERE contains(lower(name), 'route') OR contains(lower(name), 'handler')) > 0 THEN 'Full Stack' ELSE 'Library' END AS project_type, CASE WHEN (SELECT count(*) FROM rsymbols) > 5000 THEN 'High' WHEN (SELECT count(*) FROM rsymbols) > 500 THEN 'Medium' ELSE 'Low' END AS complexity""")(
    lambda spark, sf_dir: (lambda g: knowledge.fingerprint(g.files, g.symbols, adapter.relationships(spark, sf_dir).withColumn("source", F.when(F.col("kind") == "imports", "express").otherwise("react"))))(adapter.rough(spark, sf_dir))
)
_over_table("documents", "knowledge_stats", "SELECT count(*) AS files, count(*) FILTER (lang = 'en') AS summaries, CAST(sum(n_chars) FILTER (lang = 'en') AS BIGINT) AS cache_hits FROM documents")(lambda d: knowledge.knowledge_stats(d, d.where("lang = 'en'").select(F.col("n_chars").alias("hit_count"))))
_PARTS = lambda h, p: ", ".join(f"CAST(sum(CAST(concat('0x', substr({h}, {8 * i + 1}, 8)) AS BIGINT)) AS VARCHAR) AS {p}{i}" for i in range(8))
_over_rough("topology_hash", f""" SELECT sha256(concat_ws('-', (SELECT count(*) FROM rfiles), (SELECT count(*) FROM redges), symbols, s0, s1, s2, s3, s4, s5, s6, s7, d0, d1, d2, d3, d4, d5, d6, d7)) AS topology FROM (SELECT count(*) AS symbols, {_PARTS('h', 's')} FROM (SELECT sha256(concat_ws('|', path, name, kind, '')) AS h FROM rsymbols JOIN rfiles USING (file_id))),
  (SELECT {_PARTS('h', 'd')} FROM (SELECT sha256(d) AS h FROM (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS d FROM rfiles)))""")(lambda g: knowledge.topology_hash(g.files, g.symbols, g.edges))
_over_table("events", "latest_rows", "SELECT event_type, user_id % 10 AS u, max(event_id) AS event_id FROM events GROUP BY 1, 2")(lambda e: knowledge.latest(e.select("event_type", (F.col("user_id") % 10).alias("u"), "event_id"), ["event_type", "u"], "event_id"))
_over_table("events", "next_version", "SELECT max(event_id) + 1 AS version FROM events")(lambda e: knowledge.next_version(e, "event_id"))
_over_table("documents", "scope_tokens", "SELECT CAST(round(sum(n) / CAST(4 AS DOUBLE)) AS BIGINT) AS tokens FROM (SELECT concat('./docs/', source, '/', doc_id, '.txt') AS path, octet_length(encode(text)) AS n FROM documents ORDER BY 1 LIMIT 500) WHERE contains(path, '/src1/')")(lambda d: knowledge.scope_tokens(d.select(F.concat(F.lit("./docs/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("size")), "/src1/", 500))
_over_table("documents", "answer_baseline", "SELECT a.doc_id AS answer_id, CAST(round((octet_length(encode(a.text)) + CASE WHEN a.doc_id >= 1 AND b.text IS NOT NULL THEN octet_length(encode(b.text)) ELSE 0 END) / CAST(4 AS DOUBLE)) AS BIGINT) AS tokens FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id - 1")(
    lambda d: knowledge.answer_baseline(d.select(F.col("doc_id").alias("answer_id"), F.concat(F.lit('{"items": [{"file_path": "d/'), "doc_id", F.lit('"}, {"path":"d/'), F.col("doc_id") - 1, F.lit('", "name": "path"}], "path": "d/'), "doc_id", F.lit('"}')).alias("json")), d.select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.octet_length("text").cast("long").alias("size")))
)
_over_table("events", "recent_activity", "SELECT event_id AS id, event_type AS tool_name, CASE WHEN octet_length(encode(p)) > 240 THEN substr(p, 1, 240) || '...' ELSE p END AS prompt FROM (SELECT *, repeat(concat(event_type, ' ', user_id, ' '), CAST(event_id % 40 AS INTEGER)) AS p FROM events) ORDER BY event_id DESC LIMIT 50")(lambda e: knowledge.recent_activity(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("tool_name"), F.repeat(F.concat("event_type", F.lit(" "), "user_id", F.lit(" ")), (F.col("event_id") % 40).cast("int")).alias("prompt"))))
_over_table("events", "event_savings", "SELECT event_id AS id, greatest(user_id * 3 - event_id, 0) AS token_reduction FROM events")(lambda e: knowledge.tool_events(e.select(F.col("event_id").alias("id"), (F.col("user_id") * 3).alias("estimated_raw_context_tokens"), F.col("event_id").alias("delivered_token_count"))).select("id", "token_reduction"))
_over_rough("scoped_counts", " SELECT count(*) FILTER (contains(path, 'SRC/a_ia')) AS by_text, count(*) FILTER (path ILIKE '%SRC/a_ia%') AS by_pattern FROM rsymbols JOIN rfiles USING (file_id)")(lambda g: knowledge.scoped_counts(g.files, g.symbols, "SRC/a_ia"))

# retrieval ------------------------------------------------------------------------------------------------------------

#: Documents of plain ASCII as files, each with one symbol of forty bytes; those of every seventh have changed, every eleventh is gone, every thirteenth's bytes lie outside.
_ASCII = "(SELECT doc_id, text, source FROM documents WHERE regexp_full_match(text, '(?s)[\\x00-\\x7F]{60,}'))"


def _ascii(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    files = d.where(F.col("text").rlike(r"(?s)\A[\x00-\x7F]{60,}\z")).select(F.col("doc_id").alias("file_id"), F.concat(F.lit("./docs/"), "source", F.lit(".py")).alias("path"), F.col("text").alias("content"))
    outside = F.col("file_id") % 13 == 0
    symbols = files.select(F.col("file_id").alias("symbol_id"), "file_id", F.lit("function").alias("kind"), F.concat(F.lit("f"), "file_id").alias("name"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.when(outside, 10**8).otherwise(10).alias("start_byte"), F.when(outside, 10**8 + 1).otherwise(50).alias("end_byte"))
    return files, symbols


def _sources(d: DataFrame) -> DataFrame:
    files, symbols = _ascii(d)
    indexed = files.select("file_id", F.sha2(F.when(F.col("file_id") % 7 == 0, F.lit("other")).otherwise(F.col("content")), 256).alias("content_hash"))
    return retrieval.symbol_sources(symbols, indexed, files.where("file_id % 11 <> 0"))


_over_table("documents", "symbol_sources", f"SELECT doc_id AS symbol_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'stale' WHEN doc_id % 13 = 0 THEN 'lines' ELSE 'bytes' END AS status, CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN string_split(text, chr(10))[1] ELSE substr(text, 11, 40) END AS source FROM {_ASCII}")(_sources)
_over_table("documents", "symbol_cards", f"SELECT doc_id AS symbol_id, card, sha256(card) AS body_hash FROM (SELECT doc_id, concat('docs/', source, '.py', chr(10), 'function f', doc_id, chr(10), CASE WHEN doc_id % 13 = 0 THEN '' ELSE substr(text, 11, 40) END) AS card FROM {_ASCII})")(lambda d: retrieval.cards(_ascii(d)[1], _ascii(d)[0]))
_over_table("documents", "file_skeletons", f"SELECT doc_id AS file_id, concat('./docs/', source, '.py') AS path, CASE WHEN doc_id % 13 = 0 THEN text ELSE concat(substr(text, 1, 10), 'f', doc_id, ':', chr(10), '    ... ', substr(text, 51)) END AS skeleton FROM {_ASCII}")(lambda d: retrieval.skeletons(*_ascii(d)))
_over_table("documents", "structural_duplicates", f"""SELECT min(doc_id) AS first_id, count(*) AS n, any_value(len(form)) AS length FROM (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '{retrieval.TOKEN.replace("'", "''")}'), lambda t: NOT regexp_matches(t, '^(/\\*.|//|#)')),
  lambda t: CASE WHEN length(t) > 1 AND regexp_matches(t, '^["''`].') THEN '#STR' WHEN regexp_matches(t, '^[0-9]') THEN '#NUM' WHEN t IN ({_quoted(retrieval.KEYWORDS)}) THEN t WHEN regexp_matches(t, '^[\\p{{L}}_]') THEN '#ID' ELSE t END) AS form FROM documents WHERE NOT contains(lower(text), 'logger')) WHERE len(form) >= 15 GROUP BY form HAVING count(*) > 1""")(lambda d: retrieval.structural_duplicates(d.select(F.col("doc_id").alias("symbol_id"), F.col("text").alias("source"))))
_over_table("documents", "path_helpers", "SELECT doc_id, concat('a.', doc_id) AS stem, CASE WHEN doc_id % 2 = 0 THEN concat('/b/', source) ELSE concat('../', source) END AS collapsed, concat('x/', source) AS scope FROM documents")(
    lambda d: d.select("doc_id", scalars.stem(F.concat(F.lit("./q/a."), "doc_id", F.lit(".ts"))).alias("stem"), scalars.collapsed(F.concat(F.when(F.col("doc_id") % 2 == 0, "/a/../b/./c/..//").otherwise("a/../../b/.././"), "source")).alias("collapsed"), scalars.scope_path(F.concat(F.lit("/root/./x\\"), "source", F.lit("//")), "/root").alias("scope"))
)
_over_table("embeddings", "vector_codec", "SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")(lambda e: e.select("vec_id", scalars.vector_of(scalars.blob_of(F.col("embedding"))).alias("x")).select("vec_id", F.size("x").cast("long").alias("n"), F.col("x")[0].cast("double").alias("first")))
_over_graph("subtree_capped", ", both_ways AS (SELECT source_symbol_id AS a, target_symbol_id AS b FROM edges UNION SELECT target_symbol_id, source_symbol_id FROM edges), t AS (WITH RECURSIVE r(node, level) AS (SELECT CAST(20000001 AS BIGINT), 0 UNION SELECT b, level + 1 FROM r JOIN both_ways ON a = node WHERE level < 2) SELECT node, CAST(min(level) AS BIGINT) AS level FROM r GROUP BY 1) FROM t ORDER BY level, node LIMIT 100")(lambda g: paths.subtree(g.edges, g.symbols.where("symbol_id = 20000001").select(F.col("symbol_id").alias("node")), 2)[0])

# resolver, cycles, index ----------------------------------------------------------------------------------------------

_ANY_QUERIES = "q AS (SELECT name AS query FROM rsymbols WHERE symbol_id % 400 = 5 UNION SELECT path FROM rfiles UNION SELECT 'auth_index.py' UNION SELECT 'notif' UNION SELECT 'NATION_1.ts' UNION SELECT 'Packages/ASIA/' UNION SELECT 'nothing here')"


def _any_queries(g: adapter.Graph) -> DataFrame:
    fixed = ["auth_index.py", "notif", "NATION_1.ts", "Packages/ASIA/", "nothing here"]
    return g.symbols.where("symbol_id % 400 = 5").select(F.col("name").alias("query")).union(g.files.select("path")).union(g.files.limit(1).select(F.explode(F.array(*map(F.lit, fixed)))))


_over_rough("resolve_any", f""", {_ANY_QUERIES}, k AS (SELECT query, lower(query) AS low, rtrim(regexp_replace(query, '^(\\./|/)+', ''), '/') AS key FROM q), sy AS (SELECT query, count(DISTINCT (file_id, start_line, end_line)) FILTER (s.name = query) AS e, count(DISTINCT (file_id, start_line, end_line)) FILTER (lower(s.name) = low) AS f FROM k LEFT JOIN rsymbols s ON lower(s.name) = low GROUP BY 1),
pt AS (SELECT query, count(*) FILTER (p = key) AS n1, count(*) FILTER (p = key OR suffix(p, '/' || key)) AS n2, count(*) FILTER (d = key OR suffix(d, '/' || key)) AS n3 FROM k, (SELECT substr(path, 3) AS p, regexp_replace(substr(path, 3), '/[^/]*$', '') AS d FROM rfiles) GROUP BY 1),
all_ AS (SELECT query, low, COALESCE(nullif(e, 0), f) AS s, n1, n2, n3, CASE WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 ELSE n3 END AS p FROM k JOIN sy USING (query) JOIN pt USING (query)),
fx AS (SELECT *, (CASE WHEN {" OR ".join(f"contains(low, '{w}') OR contains('{w}', low)" for w in v.CONCEPTS['auth'])} THEN 1 ELSE 0 END + CASE WHEN {" OR ".join(f"contains(low, '{w}') OR contains('{w}', low)" for w in v.CONCEPTS['notifications'])} THEN 1 ELSE 0 END
  + CASE WHEN {" OR ".join(f"contains(low, '{w}') OR contains('{w}', low)" for w in v.CONCEPTS['realtime'])} THEN 1 ELSE 0 END + CASE WHEN {" OR ".join(f"contains(low, '{w}') OR contains('{w}', low)" for w in v.CONCEPTS['database'])} THEN 1 ELSE 0 END) AS f, CASE WHEN low = 'packages/asia/' THEN (SELECT count(*) FROM rfiles WHERE contains(path, '/asia/')) ELSE 0 END AS d FROM all_)
SELECT query, CASE WHEN s > 0 THEN 'symbol' WHEN p > 0 THEN 'path' WHEN f > 0 THEN 'feature' WHEN d > 0 THEN 'subsystem' END AS stage, CASE WHEN s = 1 THEN 'Symbol' WHEN s > 1 THEN 'Ambiguous' WHEN n1 = 1 OR (n1 = 0 AND n2 = 1) THEN 'File' WHEN n1 + n2 > 0 THEN 'Ambiguous' WHEN n3 > 0 THEN 'Directory' WHEN f > 0 THEN 'Feature' WHEN d > 0 THEN 'Subsystem' ELSE 'NotFound' END AS outcome,
  CAST(CASE WHEN s > 0 THEN s WHEN p > 0 THEN p WHEN f > 0 THEN f ELSE d END AS BIGINT) AS n, CAST(CASE WHEN s > 0 THEN 95 WHEN p > 0 THEN 90 WHEN f > 0 THEN 70 WHEN d > 0 THEN 65 ELSE 0 END AS BIGINT) AS score, CASE WHEN s > 0 OR p > 0 THEN 'High' WHEN f > 0 OR d > 0 THEN 'Medium' ELSE 'Low' END AS label FROM fx""")(lambda g: resolver.resolve_any(_any_queries(g), g.symbols, g.files))
_over_rough("universal_nodes", " SELECT path AS query, 'File' AS node_kind, file_id AS node_id, path AS name FROM rfiles UNION ALL SELECT name, 'Symbol', symbol_id, name FROM rsymbols WHERE symbol_id >= 40000000 UNION ALL SELECT 'nothing here', 'Unknown', NULL, NULL")(
    lambda g: resolver.universal(g.files.select(F.col("path").alias("query")).union(g.symbols.where("symbol_id >= 40000000").select("name")).union(g.files.limit(1).select(F.lit("nothing here"))), g.symbols, g.files)
)
_FILE_ARCS = ", a AS (SELECT DISTINCT source_file_id AS s, file_id AS d FROM redges e JOIN rsymbols ON symbol_id = target_symbol_id WHERE source_file_id <> file_id AND e.kind = 'inherits' AND source_symbol_id % 7 = 0)"


def _file_arcs(g: adapter.Graph) -> DataFrame:
    """Arcs between files, from one inherits edge in seven."""
    return g.edges.where("kind = 'inherits' and source_symbol_id % 7 = 0").join(g.symbols, F.col("target_symbol_id") == F.col("symbol_id")).select(F.col("source_file_id").alias("src"), F.col("file_id").alias("dst"))


_over_rough("file_cycles", _FILE_ARCS + ", c AS (SELECT 2 AS length, [x.s, x.d] AS nodes FROM a x JOIN a y ON y.s = x.d AND y.d = x.s WHERE x.s < x.d UNION ALL SELECT 3, [x.s, y.s, z.s] FROM a x JOIN a y ON y.s = x.d JOIN a z ON z.s = y.d AND z.d = x.s WHERE x.s < y.s AND x.s < z.s AND y.s <> z.s) SELECT CAST(length AS BIGINT) AS length, array_to_string(nodes, '>') AS nodes FROM c ORDER BY length, c.nodes LIMIT 500")(lambda g: resolver.cycles(_file_arcs(g), 3).select("length", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("nodes")))
_over_rough("cyclic_files", _FILE_ARCS + ", r AS (WITH RECURSIVE t(x, y) AS (SELECT s, d FROM a UNION SELECT t.x, a.d FROM t JOIN a ON t.y = a.s) FROM t) SELECT x AS node, min(y) AS component FROM r WHERE EXISTS (SELECT 1 FROM r b WHERE b.x = r.y AND b.y = r.x) GROUP BY 1")(lambda g: paths.strong_components(_file_arcs(g)))
_over_rough("logical_edges", " SELECT file_id AS source_file_id, symbol_id AS source_symbol_id, 41000000 + symbol_id % 25 AS target_symbol_id, 'interaction' AS kind, 'logical' AS edge_type, CAST(0.7 AS DOUBLE) AS confidence, '{\"literal\":\"/api/x\"}' AS metadata FROM rsymbols WHERE kind = 'function'")(lambda g: resolver.logical_edges(g.symbols.where("kind = 'function'").select("symbol_id", F.lit("/api/x").alias("literal"), (41_000_000 + F.col("symbol_id") % 25).alias("route_id")), g.symbols))
_over_rough("file_ids", " SELECT path, file_id FROM rfiles UNION ALL SELECT '/repo' || substr(path, 2), file_id FROM rfiles WHERE file_id % 2 = 0 UNION ALL SELECT 'none', NULL")(lambda g: index.file_ids(g.files.select("path").union(g.files.where("file_id % 2 = 0").select(F.concat(F.lit("/repo/x/../"), F.expr("substring(path, 3)")))).union(g.files.limit(1).select(F.lit("none"))), g.files, "/repo").withColumn("path", F.replace("path", F.lit("/x/..")  , F.lit(""))))
_over_rough("ignored_files", " SELECT path FROM rfiles WHERE NOT (contains(path, '/asia/') AND NOT suffix(path, '_1.ts')) AND NOT contains(path, 'auth_index')")(lambda g: index.kept(g.files, ["# rules", "**/asia/*", "!*_1.ts", "/lib/**/auth_*.py"]).select("path"))
_over_rough("migrated_edges", " SELECT source_file_id, source_symbol_id, target_symbol_id, kind, 'static' AS edge_type, CAST(NULL AS VARCHAR) AS metadata, CAST(1 AS DOUBLE) AS confidence FROM redges WHERE kind = 'inherits'")(lambda g: index.migrated("edges", g.edges.where("kind = 'inherits'").drop("edge_type", "confidence").withColumn("old", F.lit(1))).withColumn("metadata", F.col("metadata").cast("string")))

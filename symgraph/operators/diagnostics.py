"""Fourteen checks of an index, in order; a stage that needs one that failed is skipped, and then counts as failed.

A check returns one small row of metrics. What decides a status is computed by Spark; the driver reads single rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.tables import spread
from symgraph.operators import classify, relational

# Fixed values ---------------------------------------------------------------------------------------------------------
PIPELINE_VERSION = "1.0"
LEAST = {"edge_coverage": 95.0, "typed": 5.0, "receiver": 20.0, "features": 100.0, "traversal": 90.0}
IMPORT_EVIDENCE = ["ImportMatch", "ImportFlow"]


@dataclass(frozen=True)
class Tables:
    """files, symbols, edges, relationships (with state and evidence), bindings (file_id, kind, name, type_name), features (symbol_id), manifest (id, version)."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    relationships: DataFrame
    bindings: DataFrame
    features: DataFrame
    manifest: DataFrame


def _one(df: DataFrame, *metrics) -> dict[str, float]:
    return {k: float(x or 0) for k, x in df.agg(*metrics).first().asDict().items()}


def _n(df: DataFrame, name: str) -> dict[str, float]:
    return {name: float(df.count())}


def state_histogram(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy(F.coalesce("state", F.lit("Unknown")).alias("state")).agg(F.count("*").alias("n"))


def evidence_histogram(relationships: DataFrame) -> DataFrame:
    return relationships.where("evidence is not null").groupBy("evidence").agg(F.count("*").alias("n"))


def method_origins(relationships: DataFrame) -> DataFrame:
    """One row: how many method calls each origin explains, and the share of those explained."""
    rows = relationships.where("kind = 'method_call'")
    state, imported = F.coalesce("state", F.lit("Unknown")), F.coalesce(F.col("evidence").isin(IMPORT_EVIDENCE), F.lit(False))
    own = state == "RepositorySymbol"
    counts = {"local_variables": own & ~imported, "repository_imports": own & imported, "external_imports": state == "ExternalDependency", "builtin": state == "Builtin", "standard_library": state == "StandardLibrary"}
    out = rows.agg(F.count("*").alias("calls"), *[F.count_if(test).alias(k) for k, test in counts.items()])
    known = sum((F.col(k) for k in counts), F.lit(0))
    return out.withColumns({"unknown": F.col("calls") - known, "deterministic_percent": F.round(F.when(F.col("calls") == 0, 0.0).otherwise(F.try_divide(100.0 * known, F.col("calls"))), 6)})


def contract_violations(relationships: DataFrame) -> DataFrame:
    """One row: references whose evidence doesn't fit their state."""
    state, none = F.col("state"), F.col("evidence").isNull()
    return relationships.agg(
        F.count_if((state == "RepositorySymbol") & none).alias("repository_without_evidence"),
        F.count_if(state.isin("Missing", "Dynamic") & none).alias("missing_without_reason"),
        F.count_if((state == "Builtin") & (F.col("evidence") != "BuiltinClassification")).alias("builtin_evidence"),
        F.count_if((state == "ExternalDependency") & (F.col("evidence") != "ExternalDependency")).alias("external_evidence"),
    )


def duplicate_definitions(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("file_id", "name", "kind", "start_line").agg(F.count("*").alias("n")).where("n > 1")


def excess_edges(edges: DataFrame) -> DataFrame:
    """One row: static edges beyond the first of each key."""
    keys = ["source_file_id", "source_symbol_id", "target_symbol_id", "kind", "edge_type"]
    return spread(edges.where("edge_type = 'static'"), *keys[1:3]).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


def unbacked_references(relationships: DataFrame, edges: DataFrame) -> DataFrame:
    """References resolved to the repository of whose kind their file has no edge."""
    return relational.unresolved_relationships(relationships.where("state = 'RepositorySymbol'"), edges)


def _version(t: Tables):
    newest = t.manifest.orderBy(F.desc("id")).limit(1).first()
    return "Warning" if newest and newest["version"] != PIPELINE_VERSION else "Pass", {}


def _completeness(t: Tables):
    homeless = _n(t.symbols.join(t.files, "file_id", "left_anti"), "without_file")
    spans = [c for c in ("start_byte", "end_byte") if c in t.symbols.columns]
    unspanned = _n(t.symbols.where(" or ".join(f"{c} is null" for c in spans) if spans else "false"), "without_span")
    cover = relational.edge_coverage(t.symbols, t.edges).first()
    found = homeless | unspanned | {"edge_coverage": float(cover["percent"] or 0)}
    return "Fail" if found["without_file"] or found["without_span"] else "Pass", found


def _parser(t: Tables):
    found = _n(t.files, "files") | _n(t.symbols, "symbols") | _n(t.relationships, "relationships") | _n(duplicate_definitions(t.symbols), "duplicates") | _n(t.symbols.where("name is null or trim(name) = ''"), "unnamed")
    return "Fail" if found["unnamed"] else "Warning" if found["duplicates"] else "Pass", found


def _semantic(t: Tables):
    found = {f"bindings_{r.kind}": float(r.n) for r in relational.kind_distribution(t.bindings).collect()} | _n(t.bindings.join(t.files, "file_id", "left_anti"), "orphaned")  # a row per kind
    return "Fail" if found["orphaned"] else "Pass", found


def _flow(t: Tables):
    found = _one(t.bindings, F.count("*").alias("variables"), F.count_if(F.col("type_name").isNotNull()).alias("typed"))
    share = 100 * found["typed"] / found["variables"] if found["variables"] else 0.0
    return "Warning" if share < LEAST["typed"] else "Pass", found | {"typed_percent": share}


def _receiver(t: Tables):
    found = {k: float(x) for k, x in method_origins(t.relationships).first().asDict().items()}
    return "Warning" if found["calls"] and found["deterministic_percent"] < LEAST["receiver"] else "Pass", found


def _method(t: Tables):
    status, found = _receiver(t)
    return status, found | _n(t.relationships.where("kind = 'method_call' and state in ('Missing', 'Dynamic', 'Ambiguous')"), "unresolved")


def unresolved_samples(relationships: DataFrame, limit: int = 10) -> DataFrame:
    """(rel_id, name, state, severity) of method calls that nothing explains, the first of them: open ones are Info, others Warning."""
    rows = relationships.where("kind = 'method_call' and state in ('Missing', 'Dynamic', 'Ambiguous')").orderBy("rel_id").limit(limit)
    return rows.select("rel_id", "name", "state", F.when(F.col("state") == "Dynamic", "Info").otherwise("Warning").alias("severity"))


def _health(t: Tables):
    found = {k: float(x) for k, x in contract_violations(t.relationships).first().asDict().items()}
    return "Fail" if any(found.values()) else "Pass", found


def _quality(t: Tables):
    return "Pass", {f"state_{r.state}": float(r.n) for r in state_histogram(t.relationships).collect()} | {f"evidence_{r.evidence}": float(r.n) for r in evidence_histogram(t.relationships).collect()}  # a row per state and code


def _graph(t: Tables):
    built, stored = relational.built_edges(t.relationships.drop("state"), t.symbols), t.edges.where("edge_type = 'static'")
    found = _n(built, "rebuilt") | _n(stored, "stored") | _one(excess_edges(t.edges), F.sum("excess").alias("duplicates")) | _n(relational.dangling_edges(t.symbols, t.edges), "dangling")
    return "Fail" if found["rebuilt"] != found["stored"] or found["duplicates"] or found["dangling"] else "Pass", found


def _features(t: Tables):
    found = _n(t.symbols, "symbols") | _n(t.symbols.join(t.features, "symbol_id", "left_semi"), "with_features") | _n(classify.entrypoints(t.symbols, t.files), "entrypoints")
    share = 100 * found["with_features"] / found["symbols"] if found["symbols"] else 100.0
    return "Warning" if share < LEAST["features"] else "Pass", found | {"coverage_percent": share}


def _retrieval(t: Tables):
    found = _n(t.symbols, "symbols") | _n(t.symbols.join(relational.endpoints(t.edges), "symbol_id", "left_semi"), "reachable") | {"communities": 0.0}
    share = 100 * found["reachable"] / found["symbols"] if found["symbols"] else 0.0
    return "Warning" if share < LEAST["traversal"] else "Pass", found | {"traversal_percent": share}


def _consistency(t: Tables):
    found = _n(unbacked_references(t.relationships, t.edges), "unbacked") | _n(relational.endpoints(t.edges).join(t.features, "symbol_id", "left_anti"), "without_features")
    return "Fail" if found["unbacked"] or found["without_features"] else "Pass", found


def _developer(t: Tables):
    return "Pass", {f"layer_{r.layer}": float(r.n) for r in classify.layers(relational.directory_edges(t.files, t.symbols, t.edges)).groupBy("layer").agg(F.count("*").alias("n")).collect()}  # four rows


#: Stage, what it needs, check: in the order in which they run. The version check reports as Parser, which so appears twice.
CHECKS: list[tuple[str, list[str], Callable[[Tables], tuple[str, dict[str, float]]]]] = [
    ("Parser", [], _version),
    ("Completeness", ["SemanticIndex", "Graph"], _completeness),
    ("Parser", [], _parser),
    ("Semantic", ["Parser"], _semantic),
    ("Flow", ["Semantic"], _flow),
    ("Receiver", ["Flow"], _receiver),
    ("Method", ["Receiver"], _method),
    ("PipelineHealth", ["Receiver", "Method"], _health),
    ("ResolutionQuality", ["PipelineHealth"], _quality),
    ("Graph", ["ResolutionQuality"], _graph),
    ("FeatureExtraction", ["Graph"], _features),
    ("Retrieval", ["FeatureExtraction", "SemanticIndex", "Completeness"], _retrieval),
    ("Consistency", ["Parser", "Semantic", "Flow", "Receiver", "Method", "ResolutionQuality", "Graph"], _consistency),
    ("DeveloperIntelligence", ["Graph", "FeatureExtraction"], _developer),
]


def run(spark: SparkSession, tables: Tables) -> DataFrame:
    """(place, stage, status, metric, value) of all stages; a stage without metrics has one row of nulls."""
    failed: set[str] = set()
    rows = []
    for place, (stage, needs, check) in enumerate(CHECKS):
        if failed & set(needs):
            status, metrics = "Skipped", {}
        else:
            status, metrics = check(tables)
        if status in ("Fail", "Skipped"):
            failed.add(stage)
        rows += [(place, stage, status, k, float(x)) for k, x in sorted(metrics.items())] or [(place, stage, status, None, None)]
    return spark.createDataFrame(rows, "place int, stage string, status string, metric string, value double")

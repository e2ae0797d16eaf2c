"""What a query names, whatever it is: a symbol, a path, a concept or a directory; cycles of dependencies, listed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions import vocabulary as v
from symgraph.functions.tables import materialize
from symgraph.operators import resolve, search, subsystem
from symgraph.operators.search import resolver_label

#: Stages in order, and the score of what each finds.
STAGES = {"symbol": 95, "path": 90, "feature": 70, "subsystem": 65}


def resolve_any(queries: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row per distinct query: query, stage (the first of STAGES that finds anything, or null), outcome, n (what it found), score, label.

    Symbols by name, paths by full path, end or directory, features by a concept that the query is or is a part of, subsystems by their
    canonical name as a directory's last part.
    """
    q = materialize(queries.select("query").distinct(), "queries")
    named = resolve.resolve_names(q, symbols, files).select("query", F.struct("outcome", "n").alias("symbol"))
    placed = resolve.resolve_paths(q, files).select("query", F.struct("outcome", "n").alias("path"))
    low = F.lower("query")
    words = F.array(*[F.when(F.lit(False), "").otherwise(F.when((low == c) | reduce(lambda a, b: a | b, [low.contains(w) | (F.lit(w).contains(low) & (low != "")) for w in ws]), c)) for c, ws in v.CONCEPTS.items()])
    concepts = q.select("query", F.size(F.array_compact(words)).cast("long").alias("n")).where("n > 0").select("query", F.struct(F.lit("Feature").alias("outcome"), "n").alias("feature"))
    last = files.select(F.lower(F.element_at(F.split(F.regexp_replace("path", "/[^/]*$", ""), "/"), -1)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    systems = q.withColumn("key", subsystem.canonical_name(F.col("query"))).join(last, "key").select("query", F.struct(F.lit("Subsystem").alias("outcome"), "n").alias("subsystem"))
    rows = q.join(named, "query", "left").join(placed, "query", "left").join(concepts, "query", "left").join(systems, "query", "left")
    found = F.array_compact(F.array(*[F.when(F.col(s).isNotNull() & (F.col(f"{s}.outcome") != "NotFound"), F.struct(F.lit(s).alias("stage"), F.col(f"{s}.outcome").alias("outcome"), F.col(f"{s}.n").cast("long").alias("n"), F.lit(score).alias("score"))) for s, score in STAGES.items()]))
    first = F.when(F.size(found) > 0, F.element_at(found, 1))
    rows = rows.select("query", first.alias("r"))
    score = F.coalesce("r.score", F.lit(0))
    return rows.select("query", "r.stage", F.coalesce("r.outcome", F.lit("NotFound")).alias("outcome"), F.coalesce("r.n", F.lit(0)).cast("long").alias("n"), score.cast("long").alias("score"), resolver_label(score).alias("label"))


def universal(queries: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(query, node_kind, node_id, name): what each query names as one record; symbols and files by id, features and subsystems by name, nothing as Unknown."""
    any_ = resolve_any(queries, symbols, files)
    ids = resolve.resolve_names(queries, symbols, files).select(F.col("query").alias("q"), "symbol_id")
    paths_ = files.select(F.regexp_replace("path", r"^(\./|/)+", "").alias("key"), "file_id").groupBy("key").agg(F.min("file_id").alias("file_id"))
    rows = any_.join(ids, any_["query"] == ids["q"], "left").join(paths_, F.regexp_replace("query", r"^(\./|/)+", "") == F.col("key"), "left")
    kind = F.when((F.col("stage") == "symbol") & (F.col("outcome") == "Symbol"), "Symbol").when((F.col("stage") == "path") & (F.col("outcome") == "File"), "File").when(F.col("outcome").isin("Directory", "Feature", "Subsystem", "Ambiguous"), F.col("outcome")).otherwise("Unknown")
    node = F.when(kind == "Symbol", F.col("symbol_id")).when(kind == "File", F.col("file_id"))
    return rows.select("query", kind.alias("node_kind"), node.alias("node_id"), F.when(kind != "Unknown", F.col("query")).alias("name"))


def dispatch(files: DataFrame, features: DataFrame, query: str, mode: str, embedded: DataFrame | None = None, vector: list[float] | None = None, scope: str | None = None, limit: int = 15, texts: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Results (name, path, score, label) of a search by mode (symbol, text, both, semantic), and the mode that was used.

    semantic needs vectors (as of search.symbol_vectors) and the query's own; without them it becomes symbol. both fuses
    the lexical leg with the semantic one where there is one.
    """
    meaning = embedded is not None and vector is not None and mode in ("both", "semantic")
    used = mode if mode != "semantic" or meaning else "symbol"
    legs = []
    if used != "semantic":
        words = search.search(files, features, query, scope, limit, used if used != "both" or texts is not None else "symbol", texts)
        if not meaning:
            return words.select("name", "path", "score", "label"), used
        legs.append(search.ranked_leg(words, F.desc("score"), "name", "path", "kind"))
    near = search.vector_top_k(embedded, vector, limit, "symbol_id").join(embedded.drop("embedding"), "symbol_id").withColumn("label", F.lit("Semantic Match"))
    legs.append(search.ranked_leg(near, F.desc("similarity"), "symbol_id", line=F.col("start_line")))
    return search.rrf(legs, limit).select("name", "path", "score", "label"), used


def cycles(arcs: DataFrame, longest: int = 4, limit: int = 500) -> DataFrame:
    """(length, nodes): elementary cycles of arcs (src, dst) of up to `longest` nodes, each from its lowest node; the shortest, then the lowest, `limit` of them.

    Paths grow by one arc a round and only over nodes above their start, and only arcs between nodes that reach each other
    are given (see paths.strong_components), so nothing is found twice and nothing leads nowhere for long.
    """
    arcs = materialize(arcs.where("src <> dst").select("src", "dst").distinct(), "arcs")
    paths_ = arcs.where("src < dst").select(F.array("src", "dst").alias("nodes"), "dst")
    found = []
    for length in range(2, longest + 1):
        step = paths_.select("nodes", F.col("dst").alias("at")).join(arcs, F.col("at") == F.col("src")).select("nodes", "dst")
        step = materialize(step.where((F.col("dst") == F.col("nodes")[0]) | ((F.col("dst") > F.col("nodes")[0]) & ~F.array_contains("nodes", F.col("dst")))), "cycles")
        closed = F.col("dst") == F.col("nodes")[0]
        found.append(step.where(closed).select(F.lit(length).cast("long").alias("length"), "nodes"))
        paths_ = step.where(~closed).select(F.concat("nodes", F.array("dst")).alias("nodes"), "dst")
    return reduce(DataFrame.unionByName, found).orderBy("length", "nodes").limit(limit)


def logical_edges(connected: DataFrame, symbols: DataFrame, confidence: float = 0.7) -> DataFrame:
    """Edges of kind interaction from symbols to the routes that their requests name; connected as of linking.connectors."""
    home = symbols.select("symbol_id", F.col("file_id").alias("source_file_id"))
    rows = connected.where("symbol_id <> route_id").join(home, "symbol_id")
    return rows.select("source_file_id", F.col("symbol_id").alias("source_symbol_id"), F.col("route_id").alias("target_symbol_id"), F.lit("interaction").alias("kind"), F.lit("logical").alias("edge_type"), F.lit(confidence).alias("confidence"), F.to_json(F.struct("literal")).alias("metadata"))

"""Overview, metrics, validation, degrees, hotspots, neighbours: joins and aggregations over the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions import vocabulary as v
from symgraph.functions.scalars import extension, in_scope, parent_dir
from symgraph.functions.tables import materialize, spread


def canonical(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind").isin(v.CANONICAL_KINDS))


def dependency(edges: DataFrame) -> DataFrame:
    """Canonical edges, and receiver-resolved ones of enough confidence."""
    return edges.where(F.col("kind").isin(v.CANONICAL_KINDS) | (F.col("kind").isin(v.RECEIVER_KINDS) & (F.col("confidence") >= v.RECEIVER_CONFIDENCE)))


def overview_totals(files: DataFrame, symbols: DataFrame, edges: DataFrame, scope: str | None = None) -> DataFrame:
    """Counts of files, symbols and edges (by source file) in scope."""
    own = files.where(in_scope(F.col("path"), scope)).select("file_id")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [count(own, "files"), count(symbols.join(own, "file_id", "left_semi"), "symbols"), count(edges.join(own, edges.source_file_id == own.file_id, "left_semi"), "edges")]
    return parts[0].join(parts[1]).join(parts[2])  # three single rows


def language_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n"))


def top_directories(files: DataFrame, symbols: DataFrame, limit: int = 20) -> DataFrame:
    per_file = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    rows = files.join(per_file, "file_id", "left").groupBy(parent_dir(F.col("path")).alias("directory"))
    return rows.agg(F.count("*").alias("file_count"), F.sum(F.coalesce("n", F.lit(0))).alias("symbol_count")).orderBy(F.desc("file_count"), "directory").limit(limit)


def kind_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("kind").agg(F.count("*").alias("n"))


def degree(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """symbols with fan_in (edges without a source count), fan_out and interaction_count (both ends), over all kinds; one shuffle on the symbol."""
    kind = F.col("kind") == "interaction"
    end = lambda c, i, o: F.struct(F.col(c).alias("id"), F.lit(i).alias("i"), F.lit(o).alias("o"), kind.cast("int").alias("x"))
    ends = edges.select(F.explode(F.array(end("target_symbol_id", 1, 0), end("source_symbol_id", 0, 1))).alias("e")).select("e.*").where("id is not null")
    counts = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.sum("x").alias("interaction_count"))
    rows = symbols.join(counts, symbols.symbol_id == counts.id, "left")
    return rows.select(*[symbols[c] for c in symbols.columns], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fan_in", "fan_out", "interaction_count")])


def incident_counts(edges: DataFrame) -> DataFrame:
    """(symbol_id, n): edges that begin or end at a symbol; a self-loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array("source_symbol_id", "target_symbol_id"))).alias("symbol_id")).where("symbol_id is not null").groupBy("symbol_id").agg(F.count("*").alias("n"))


def hotspot_rows(files: DataFrame, symbols: DataFrame, edges: DataFrame, scope: str | None = None) -> DataFrame:
    """Every symbol with canonical edges: incoming, outgoing, score = 3 in + out, class by incoming."""
    rows = degree(symbols, canonical(edges)).where("fan_in + fan_out > 0").join(files.where(in_scope(F.col("path"), scope)), "file_id")
    klass = F.when(F.col("fan_in") > 20, "critical").when(F.col("fan_in") > 10, "important").otherwise("normal")
    return rows.select("symbol_id", "name", "path", F.col("fan_in").alias("incoming"), F.col("fan_out").alias("outgoing"), (3 * F.col("fan_in") + F.col("fan_out")).alias("score"), klass.alias("class"))


def hotspots_symbols(files: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 20, scope: str | None = None) -> DataFrame:
    total = F.col("incoming") + F.col("outgoing")
    return hotspot_rows(files, symbols, edges, scope).orderBy(F.desc("score"), F.desc("incoming"), F.desc(total), "name", "path", "symbol_id").limit(limit)


def hotspots_files(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """File roll-up of all symbol rows, before any limit."""
    return hotspot_rows(files, symbols, edges).groupBy("path").agg(F.count("*").alias("n_symbols"), F.sum("score").alias("score"), F.sum("incoming").alias("incoming"), F.sum("outgoing").alias("outgoing"))


def graph_metrics(files: DataFrame, symbols: DataFrame, edges: DataFrame, relationships: DataFrame) -> DataFrame:
    """Totals, orphans, isolated files, connectivity, density, import resolution; of nothing: 1.0, 0.0, 1.0."""
    edges = materialize(edges.select("source_file_id", "source_symbol_id", "target_symbol_id", "kind"), "edges")  # read four times
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(files, "files").join(one(symbols, "symbols")).join(one(edges, "edges")).join(one(orphan_symbols(symbols, edges), "orphans"))
    out = out.join(one(isolated_files(files, symbols, edges), "isolated_files")).join(one(relationships, "relationships")).join(one(unresolved_relationships(relationships, edges), "unresolved"))
    n, m, r = F.col("symbols"), F.col("edges"), F.col("relationships")
    return out.select(
        "*",
        F.round(F.when(n == 0, 1.0).otherwise(F.try_divide(n - F.col("orphans"), n)), 6).alias("connectivity"),
        F.round(F.when(n < 2, 0.0).otherwise(F.try_divide(m, n.cast("double") * (n - 1))), 9).alias("density"),
        F.round(F.when(r == 0, 1.0).otherwise(F.try_divide(r - F.col("unresolved"), r)), 6).alias("resolution_rate"),
    )


def orphan_symbols(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return symbols.join(endpoints(edges), "symbol_id", "left_anti").select("symbol_id")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_symbol_id", "target_symbol_id")).alias("symbol_id")).where("symbol_id is not null").distinct()


def dangling_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target, or given source, is no symbol."""
    ids = symbols.select("symbol_id")
    no_target = edges.join(ids, edges.target_symbol_id == ids.symbol_id, "left_anti")
    no_source = edges.where("source_symbol_id is not null").join(ids, edges.source_symbol_id == ids.symbol_id, "left_anti")
    return no_target.union(no_source).distinct()


def isolated_files(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that no edge leaves for another file."""
    home = symbols.select(F.col("symbol_id").alias("target_symbol_id"), "file_id")
    leaving = edges.join(home, "target_symbol_id").where("source_file_id <> file_id").select(F.col("source_file_id").alias("file_id")).distinct()
    return files.join(leaving, "file_id", "left_anti").select("file_id", "path")


def unresolved_relationships(relationships: DataFrame, edges: DataFrame) -> DataFrame:
    """References of a kind (none: imports) of which their file has no edge."""
    have = edges.select(F.col("source_file_id").alias("file_id"), "kind").distinct()
    return relationships.withColumn("kind", F.coalesce("kind", F.lit("imports"))).join(have, ["file_id", "kind"], "left_anti")


def validation_counts(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    keys = ["source_file_id", "source_symbol_id", "target_symbol_id", "kind", "edge_type"]
    duplicate = spread(edges, *keys[1:3]).groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("duplicates"))
    loops = edges.agg(F.count_if(F.col("source_symbol_id") == F.col("target_symbol_id")).alias("self_loops"))
    out = dangling_edges(symbols, edges).agg(F.count("*").alias("dangling")).join(duplicate).join(loops)
    return out.withColumn("is_valid", (F.col("dangling") == 0) & (F.col("duplicates") == 0))


def neighbours(symbols: DataFrame, edges: DataFrame, name: str, outgoing: bool) -> DataFrame:
    """Distinct names beside the symbols of this name."""
    near, far = ("source_symbol_id", "target_symbol_id") if outgoing else ("target_symbol_id", "source_symbol_id")
    own = symbols.where(F.col("name") == name).select(F.col("symbol_id").alias(near))
    ids = edges.join(own, near, "left_semi").select(F.col(far).alias("symbol_id")).distinct()
    return symbols.join(ids, "symbol_id", "left_semi").select("name").distinct()


def dependents(files: DataFrame, symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Paths of the files with an edge to a symbol of this name or of its class (A of A.b); one row per edge."""
    names = [name, name.rsplit(".", 1)[0]] if "." in name else [name]
    own = symbols.where(F.col("name").isin(names)).select(F.col("symbol_id").alias("target_symbol_id"))
    return edges.join(own, "target_symbol_id", "left_semi").join(files, edges.source_file_id == files.file_id).select("path")


def directory_edges(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Canonical edges between directories."""
    place = symbols.join(files, "file_id").select("symbol_id", parent_dir(F.col("path")).alias("to_dir"))
    rows = canonical(edges).join(files.select(F.col("file_id").alias("source_file_id"), parent_dir(F.col("path")).alias("from_dir")), "source_file_id")
    return rows.join(place, rows.target_symbol_id == place.symbol_id).groupBy("from_dir", "to_dir").agg(F.count("*").alias("n"))


def snapshot_nodes(symbols: DataFrame, edges: DataFrame, limit: int = 120) -> DataFrame:
    return degree(symbols, edges).orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "symbol_id").limit(limit).select("symbol_id", "name", "fan_in", "fan_out")


def snapshot_edges(symbols: DataFrame, edges: DataFrame, nodes: int = 120, limit: int = 300) -> DataFrame:
    """Edges among the largest nodes."""
    top = F.broadcast(snapshot_nodes(symbols, edges, nodes).select("symbol_id"))
    rows = edges.join(top, edges.source_symbol_id == top.symbol_id, "left_semi").join(top, edges.target_symbol_id == top.symbol_id, "left_semi")
    return rows.select("source_symbol_id", "target_symbol_id", "kind").orderBy("source_symbol_id", "target_symbol_id", "kind").limit(limit)


def most_depended_files(files: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    per_symbol = edges.groupBy("target_symbol_id").agg(F.count("*").alias("n"))
    rows = per_symbol.join(symbols.select("symbol_id", "file_id"), per_symbol.target_symbol_id == F.col("symbol_id")).join(files, "file_id")
    return rows.groupBy("path").agg(F.sum("n").alias("incoming")).orderBy(F.desc("incoming"), "path").limit(limit)


def edge_coverage(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    have = edges.agg(F.countDistinct("source_symbol_id").alias("with_edges"))
    return symbols.agg(F.count("*").alias("symbols")).join(have).withColumn("percent", F.round(100.0 * F.col("with_edges") / F.col("symbols"), 6))


#: Lines of a bucket of enclosing_symbols.
LINE_BUCKET = 64


def enclosing_symbols(relationships: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with `enclosing`: the innermost symbol of the file around the line (smallest span, then lowest id), of kinds that can hold others.

    Spans are looked up per (file, line), not per reference, and lines meet only the distinct spans of their bucket of
    lines. What they find is a table of its own: where it is small it is sent to the references, which then stay in place.
    """
    bucket = lambda c: F.floor(F.col(c) / LINE_BUCKET)
    spots = relationships.select("file_id", "line_number").where("line_number is not null").distinct().withColumn("bucket", bucket("line_number"))
    holders = symbols.where(~F.col("kind").isin(v.NOT_ENCLOSING_KINDS) & (F.col("end_line") >= F.col("start_line")))
    holders = holders.groupBy("file_id", "start_line", "end_line").agg(F.min("symbol_id").alias("symbol_id"))
    holders = holders.select("file_id", "symbol_id", "start_line", "end_line", F.explode(F.sequence(bucket("start_line"), bucket("end_line"))).alias("bucket"))
    around = spots.join(holders, ["file_id", "bucket"]).where("line_number between start_line and end_line")
    best = around.groupBy("file_id", "line_number").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "symbol_id")).alias("b"))
    best = materialize(best.select("file_id", "line_number", F.col("b.symbol_id").alias("enclosing")), "enclosing")
    return relationships.join(best, ["file_id", "line_number"], "left").select(*[relationships[c] for c in relationships.columns], "enclosing")


def name_candidates(relationships: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with n (how many symbols have the name), first (the lowest of them) and the state that follows; with a column `enclosing`, a reference to it is Recursive."""
    by_name = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("first"))
    rows = relationships.join(by_name, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = F.coalesce(F.col("first") == F.col("enclosing"), F.lit(False)) if "enclosing" in relationships.columns else F.lit(False)
    state = F.when(F.col("n") > 1, "Ambiguous").when((F.col("n") == 1) & own, "Recursive").when(F.col("n") == 1, "RepositorySymbol").when(F.col("kind").isin(v.DYNAMIC_KINDS), "Dynamic").otherwise("Missing")
    return rows.withColumn("state", state)


def built_edges(relationships: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct edges of the uniquely resolved references, without self-loops."""
    rows = name_candidates(enclosing_symbols(relationships, symbols), symbols).where("state = 'RepositorySymbol'")
    rows = rows.select(F.col("file_id").alias("source_file_id"), F.col("enclosing").alias("source_symbol_id"), F.col("first").alias("target_symbol_id"), "kind")
    return rows.where(~F.col("source_symbol_id").eqNullSafe(F.col("target_symbol_id"))).distinct()

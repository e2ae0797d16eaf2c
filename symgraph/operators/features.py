"""The feature table of symbols: rank, degrees, community and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.tables import materialize
from symgraph.operators import classify, iterative, packed, relational


def feature_table(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per symbol: symbol_id, pagerank (0 without edges that have a source), fan_in, fan_out, interaction_count,
    community_id (itself without such edges), is_entrypoint and the flags of classify.feature_flags.

    Edges are written once and read by all parts, and packed once for rank and labels. Symbols without a file have features too, as long as they are symbols.
    """
    edges = materialize(edges.select("source_symbol_id", "target_symbol_id", "kind"), "edges")
    arcs = edges.where("source_symbol_id is not null").select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"))
    graph = packed.pack(arcs, written=True)
    rank = iterative.pagerank(arcs, graph=graph).select(F.col("node").alias("symbol_id"), F.col("rank").alias("pagerank"))
    community = iterative.label_propagation(arcs, graph=graph).select(F.col("node").alias("symbol_id"), F.col("label").alias("community_id"))
    entry = classify.entrypoints(symbols, files).select("symbol_id", F.lit(True).alias("is_entrypoint"))
    rows = relational.degree(symbols.select("symbol_id"), edges).join(rank, "symbol_id", "left").join(community, "symbol_id", "left").join(entry, "symbol_id", "left").join(classify.feature_flags(symbols), "symbol_id")
    flags = [c for c in rows.columns if c.startswith("is_") and c != "is_entrypoint"]
    return rows.select("symbol_id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), "fan_in", "fan_out", "interaction_count", F.coalesce("community_id", "symbol_id").alias("community_id"), F.coalesce("is_entrypoint", F.lit(False)).alias("is_entrypoint"), *flags)


def with_features(symbols: DataFrame, features: DataFrame) -> DataFrame:
    """symbols with their features; those without have zeros and false."""
    rows = symbols.join(features, "symbol_id", "left")
    fill = {"pagerank": F.lit(0.0), "fan_in": F.lit(0), "fan_out": F.lit(0), "interaction_count": F.lit(0)}
    return rows.withColumns({c: F.coalesce(F.col(c), fill[c] if c in fill else F.lit(False)) for c in features.columns if c in fill or c.startswith("is_")})


def coverage(symbols: DataFrame, features: DataFrame) -> DataFrame:
    """One row: symbols, those with features, percent (100 without symbols), entrypoints among them."""
    have = features.select("symbol_id", F.lit(True).alias("have"), "is_entrypoint")
    rows = symbols.select("symbol_id").join(have, "symbol_id", "left").agg(F.count("*").alias("symbols"), F.count("have").alias("with_features"), F.count_if(F.coalesce("is_entrypoint", F.lit(False))).alias("entrypoints"))
    return rows.withColumn("percent", F.when(F.col("symbols") == 0, 100.0).otherwise(F.round(F.try_divide(100.0 * F.col("with_features"), F.col("symbols")), 6)))


def embedded_counts(embeddings: DataFrame) -> DataFrame:
    """(model_id, n): symbols with a vector of each model."""
    return embeddings.groupBy("model_id").agg(F.countDistinct("symbol_id").alias("n"))


def communities_count(features: DataFrame) -> DataFrame:
    return features.agg(F.countDistinct("community_id").alias("communities"))

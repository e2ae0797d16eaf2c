"""What a repository's manifest and dashboard tell: largest symbols, languages, frameworks, health, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.scalars import extension, parent_dir


def largest(degrees: DataFrame) -> DataFrame:
    """(metric, symbol_id, value) of the symbols with the highest fan_in, fan_out, both, and pagerank where it is there; ties the lowest id, none where all are 0."""
    metrics = {"fan_in": F.col("fan_in"), "fan_out": F.col("fan_out"), "connections": F.col("fan_in") + F.col("fan_out")}
    if "pagerank" in degrees.columns:
        metrics = {k: x.cast("double") for k, x in metrics.items()} | {"pagerank": F.col("pagerank")}
    rows = degrees.select("symbol_id", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), x.alias("value")) for k, x in metrics.items()])).alias("m")).select("symbol_id", "m.*").where("value > 0")
    best = rows.groupBy("metric").agg(F.max(F.struct("value", (-F.col("symbol_id")).alias("m"))).alias("b"))
    return best.select("metric", (-F.col("b.m")).alias("symbol_id"), F.col("b.value").alias("value"))


def language_share(files: DataFrame, limit: int = 8) -> DataFrame:
    """(extension, files, percent) of the most frequent extensions."""
    counts = files.groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"))
    total = counts.agg(F.sum("files").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("extension", "files", F.round(100.0 * F.col("files") / F.col("total"), 6).alias("percent")).orderBy(F.desc("files"), "extension").limit(limit)


def dominant_file(paths: DataFrame, least: int = 5, share: float = 0.4) -> DataFrame:
    """(path, n, percent) of the file with the most rows, if there are `least` of it and these are more than `share` of all."""
    counts = paths.groupBy("path").agg(F.count("*").alias("n"))
    top = counts.agg(F.max(F.struct("n", "path")).alias("b"), F.sum("n").alias("total"))
    return top.where((F.col("b.n") >= least) & (F.col("b.n") > share * F.col("total"))).select("b.path", "b.n", F.round(100.0 * F.col("b.n") / F.col("total"), 6).alias("percent"))


def health(degrees: DataFrame, cross_file_cycles: int) -> DataFrame:
    """One row: orphan share and a score of 100 less 3 for each cycle between files (40 at most) and 0.4 for each percent of orphans (30 at most)."""
    rows = degrees.agg(F.count("*").alias("symbols"), F.count_if((F.col("fan_in") == 0) & (F.col("fan_out") == 0)).alias("orphans"))
    percent = F.when(F.col("symbols") == 0, 0.0).otherwise(F.try_divide(100.0 * F.col("orphans"), F.col("symbols")))
    score = F.lit(100.0) - F.least(F.lit(3.0 * cross_file_cycles), F.lit(40.0)) - F.least(0.4 * percent, F.lit(30.0))
    return rows.select("symbols", "orphans", F.round(percent, 6).alias("orphan_percent"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("long").alias("score"))


def frameworks(relationships: DataFrame, files: DataFrame) -> DataFrame:
    """(framework, confidence, evidence). Of the words next, express and react the first that an import's source has counts; route files tell of Next.js too."""
    source = F.coalesce("source", F.lit(""))
    word = F.when(source.contains("next"), "next").when(source.contains("express"), "express").when(source.contains("react"), "react")
    found = relationships.where("kind = 'imports'").select(word.alias("word"), F.concat(F.lit("Import('"), source, F.lit("')")).alias("evidence"), F.lit(True).alias("imported")).where("word is not null")
    path = F.col("path")
    routes = files.where((path.contains("/app/") | path.contains("/pages/")) & (path.endswith("page.tsx") | path.endswith("route.ts"))).select(F.lit("next").alias("word"), F.concat(F.lit("RouteConvention('"), path, F.lit("')")).alias("evidence"), F.lit(False).alias("imported"))
    rows = found.unionByName(routes).distinct().groupBy("word").agg(F.sort_array(F.collect_list("evidence")).alias("evidence"), F.bool_or("imported").alias("imported"))
    have = rows.agg(F.collect_set(F.when(F.col("imported"), F.col("word"))).alias("have"))  # one row of three words at most
    rows = rows.join(F.broadcast(have)).where("word <> 'react' or not (array_contains(have, 'next') or array_contains(have, 'express'))")
    name = F.when(F.col("word") == "next", "Next.js").when(F.col("word") == "express", "Express").otherwise("React")
    return rows.select(name.alias("framework"), F.when(F.col("imported"), "High").otherwise("Medium").alias("confidence"), "evidence")


def communities(labels: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, name, symbols, dependencies, dependents) of each community: its most frequent directory name but src, lib and app, and how many others its edges reach and come from."""
    own = labels.select(F.col("node").alias("symbol_id"), "label")
    place = symbols.join(own, "symbol_id").join(files.select("file_id", "path"), "file_id").select("label", F.substring_index(parent_dir(F.col("path")), "/", -1).alias("directory"))
    counts = place.groupBy("label", "directory").agg(F.count("*").alias("n"))
    named = F.when(~F.col("directory").isin("src", "lib", "app", ".", ""), F.struct("n", "directory"))
    rows = counts.groupBy("label").agg(F.max(named)["directory"].alias("name"), F.sum("n").alias("symbols"))
    a, b = own.select(F.col("symbol_id").alias("source_symbol_id"), F.col("label").alias("x")), own.select(F.col("symbol_id").alias("target_symbol_id"), F.col("label").alias("y"))
    across = edges.join(a, "source_symbol_id").join(b, "target_symbol_id").where("x <> y").select("x", "y").distinct()
    ends = across.select(F.col("x").alias("label"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(across.select(F.col("y").alias("label"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("label").agg(F.sum("o").alias("dependencies"), F.sum("i").alias("dependents"))
    return rows.join(sums, "label", "left").select("label", "name", "symbols", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), F.coalesce("dependents", F.lit(0)).alias("dependents"))

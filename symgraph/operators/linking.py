"""Links between files by what their strings say: request literals, route files, interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.functions.scalars import call_literals

GRAM = 3
INTERACTION_CONFIDENCE = 0.9


def fetch_literals(text: Column) -> Column:
    """String arguments of fetch( that begin with /api/."""
    found = F.regexp_extract_all(text, F.lit(r"""(?s)fetch\(\s*(["'`])(.*?)\1"""), F.lit(2))
    return F.filter(found, lambda x: x.startswith("/api/"))


def route_fragment(literal: Column) -> Column:
    """The literal without its first slashes, up to the first parameter segment ([ or :)."""
    return F.regexp_replace(F.regexp_replace(literal, "^/+", ""), r"(?s)(^|/)[\[:].*$", "")


def substring_pairs(texts: DataFrame, parts: DataFrame, gram: int = GRAM) -> DataFrame:
    """Rows of texts (h, text) and parts (n, part) of which the text contains the part; empty and null ones pair with none.

    A part meets only texts that have one of its runs of `gram` letters, the one that fewest texts have, so that the test is
    an equality join on a rare key and no comparison of all with all. Parts shorter than that meet texts by all their letters.
    """
    runs = lambda text, k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1))), lambda i: F.substr(F.col(text), i, k))
    keyed = texts.where("text <> ''").select("h", "text", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda k: runs("text", k))))).alias("key"))
    known = parts.where("part <> ''").select("n", "part", F.explode(F.array_distinct(runs("part", F.least(F.length("part"), F.lit(gram))))).alias("key"))
    counts = keyed.join(known.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("texts"))
    rarest = known.join(counts, "key", "left").groupBy("n", "part").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "key")).alias("k")).select("n", "part", "k.key")
    return keyed.join(rarest, "key").where(F.col("text").contains(F.col("part"))).select("h", "n", "text", "part")


def interactions(contents: DataFrame, routes: DataFrame) -> DataFrame:
    """(source_file_id, target_symbol_id, literal, confidence): a request literal of a file names a route (more than three
    letters), or one of the route's decorators has the literal. contents (file_id, content); routes (symbol_id, name, attributes)."""
    literals = contents.select("file_id", F.explode(call_literals(F.col("content"))).alias("literal")).distinct()
    words = literals.select(F.col("literal").alias("h"), F.col("literal").alias("text")).distinct()
    names = routes.where(F.length("name") > 3).select(F.col("symbol_id").alias("n"), F.col("name").alias("part"))
    by_name = substring_pairs(words, names).select(F.col("text").alias("literal"), F.col("n").alias("symbol_id"))
    marks = routes.select(F.col("symbol_id").alias("h"), F.array_join("attributes", "\n").alias("text"))
    by_mark = substring_pairs(marks, words.select(F.col("h").alias("n"), F.col("text").alias("part"))).select(F.col("part").alias("literal"), F.col("h").alias("symbol_id"))
    pairs = by_name.unionByName(by_mark).distinct()
    return literals.join(pairs, "literal").select(F.col("file_id").alias("source_file_id"), F.col("symbol_id").alias("target_symbol_id"), "literal", F.lit(INTERACTION_CONFIDENCE).alias("confidence"))


def connectors(sources: DataFrame, routes: DataFrame) -> DataFrame:
    """(symbol_id, literal, route_id): the first /api/ literal of each symbol's source that a route's path has, and of its routes the lowest.
    sources (symbol_id, source); routes (symbol_id, path). Fragments are taken literally."""
    found = sources.select("symbol_id", F.posexplode(fetch_literals(F.col("source"))).alias("at", "literal")).withColumn("part", F.lower(route_fragment(F.col("literal"))))
    parts = found.select(F.col("part").alias("n"), "part").distinct()
    hits = substring_pairs(routes.select(F.col("symbol_id").alias("h"), F.lower("path").alias("text")), parts).groupBy("part").agg(F.min("h").alias("route_id"))
    first = found.join(hits, "part").groupBy("symbol_id").agg(F.min(F.struct("at", "literal", "route_id")).alias("b"))
    return first.select("symbol_id", "b.literal", "b.route_id")

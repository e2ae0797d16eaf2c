"""Name and path resolution for whole tables of queries: each stage is a join, the first stage with candidates decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.scalars import in_scope, parent_dir


def _slashed(path):
    """Slashes made equal, without leading ./ or / and without a trailing slash."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./|/)+", ""), "/+$", "")


def resolve_names(queries: DataFrame, symbols: DataFrame, files: DataFrame, file_hint: str | None = None) -> DataFrame:
    """One row per query (column `query`): stage, outcome, n candidates, the lowest symbol_id.

    Stages: exact name, then name in any case. One place in the code (same file and lines) is a Symbol, several are
    Ambiguous, none is NotFound. With a file hint only places whose path has it count; if none does, all stay and the
    outcome is Ambiguous. Repeated and null queries: one row per distinct query, null is NotFound.
    """
    places = symbols.join(files.select("file_id", "path"), "file_id")
    hint = (file_hint or "").replace("\\", "/").strip("/").removeprefix("./").lower()
    hinted = in_scope(F.lower("path"), hint)
    spot = F.struct("file_id", "start_line", "end_line")

    def counted(key):
        own = lambda e: F.when(hinted, e)
        return places.groupBy(key.alias("key")).agg(
            F.countDistinct(spot).alias("everywhere"), F.countDistinct(own(spot)).alias("hinted"), F.min(own(F.col("symbol_id"))).alias("best"), F.min("symbol_id").alias("least")
        )

    q = queries.select("query").distinct()
    exact, folded = counted(F.col("name")), counted(F.lower("name"))
    rows = q.join(exact, q["query"] == exact["key"], "left").select("query", F.struct("everywhere", "hinted", "best", "least").alias("a"))
    rows = rows.join(folded, F.lower("query") == folded["key"], "left").select("query", "a", F.struct("everywhere", "hinted", "best", "least").alias("b"))
    first = F.col("a.everywhere").isNotNull()
    hit = F.when(first, F.col("a")).otherwise(F.col("b"))
    rows = rows.select("query", F.when(first, "exact_symbol").when(F.col("b.everywhere").isNotNull(), "canonical_symbol").alias("stage"), hit.alias("h"))
    n = F.when(F.col("h.hinted") > 0, F.col("h.hinted")).otherwise(F.coalesce("h.everywhere", F.lit(0)))
    outcome = F.when(F.col("stage").isNull(), "NotFound").when(F.col("h.hinted") == 1, "Symbol").otherwise("Ambiguous")
    return rows.select("query", "stage", outcome.alias("outcome"), n.cast("long").alias("n"), F.coalesce("h.best", "h.least").alias("symbol_id"))


def resolve_paths(queries: DataFrame, files: DataFrame) -> DataFrame:
    """One row per distinct query: stage (full_path, filename, directory), outcome (File, Directory, Ambiguous, NotFound), n.

    Every file gives its path, its suffixes and the suffixes of its directory as keys, so that the suffix tests become one
    equality join instead of a comparison of all queries with all files.
    """
    norm = files.select("path", F.split(_slashed(F.col("path")), "/").alias("p"))
    tails = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    folder = F.expr("slice(p, 1, size(p) - 1)")
    full = F.struct(F.array_join("p", "/").alias("key"), F.lit(1).alias("stage"))
    keys = F.concat(
        F.array(full),
        F.transform(tails(F.col("p")), lambda k: F.struct(k.alias("key"), F.lit(2).alias("stage"))),
        F.when(F.size("p") > 1, F.transform(tails(folder), lambda k: F.struct(k.alias("key"), F.lit(3).alias("stage")))).otherwise(F.array().cast("array<struct<key:string,stage:int>>")),
    )
    known = norm.select("path", F.explode(keys).alias("k")).groupBy("k.key", "k.stage").agg(F.count("*").alias("n"))
    q = queries.select("query").distinct().withColumn("key", _slashed(F.col("query")))
    known = known.where("key <> ''")
    rows = q.join(known, "key", "left").groupBy("query").agg(F.min(F.when(F.col("stage").isNotNull(), F.struct("stage", "n"))).alias("h"))
    stage = F.element_at(F.array(F.lit("full_path"), F.lit("filename"), F.lit("directory")), F.col("h.stage"))
    outcome = F.when(F.col("h").isNull(), "NotFound").when(F.col("h.stage") == 3, "Directory").when(F.col("h.n") == 1, "File").otherwise("Ambiguous")
    return rows.select("query", F.when(F.col("h").isNotNull(), stage).alias("stage"), outcome.alias("outcome"), F.coalesce("h.n", F.lit(0)).alias("n"))


def name_like(symbols: DataFrame, text: str) -> DataFrame:
    """Symbols whose name has the text, in any case; % and _ are wildcards."""
    return symbols.where(F.col("name").ilike(f"%{text}%"))


def closest_definition(symbols: DataFrame, name: str, line: int) -> DataFrame:
    """Of the symbols of this name the one that starts last at or before the line."""
    own = symbols.where((F.col("name") == name) & (F.col("start_line") <= line))
    return own.groupBy("name").agg(F.max_by("symbol_id", F.struct("start_line", (-F.col("symbol_id")).alias("m"))).alias("symbol_id"))


def path_directories(files: DataFrame) -> DataFrame:
    """(directory, n): how many files each directory holds itself."""
    return files.groupBy(parent_dir(F.col("path")).alias("directory")).agg(F.count("*").alias("n"))


def import_map(relationships: DataFrame) -> DataFrame:
    """(file_id, name, rel_id): the last import of each name in each file."""
    return relationships.where("kind = 'imports'").groupBy("file_id", "name").agg(F.max("rel_id").alias("rel_id"))

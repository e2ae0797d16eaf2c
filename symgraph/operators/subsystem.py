"""Reports of subsystems: names, communication between directories, dependencies and consumers of a set of symbols, capsules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.functions import vocabulary as v
from symgraph.functions.scalars import parent_dir
from symgraph.functions.tables import materialize
from symgraph.operators import iterative, paths, search


def canonical_name(name: Column) -> Column:
    """Lower-cased, without the usual prefixes and trailing slashes; other names of a subsystem become its own."""
    out = F.lower(F.trim(name))
    for prefix in v.SUBSYSTEM_PREFIXES:
        out = F.regexp_replace(out, f"^({prefix})+", "")
    out = F.regexp_replace(out, "/+$", "")
    result = out
    for canonical, names in v.SUBSYSTEM_ALIASES.items():
        result = F.when(out.isin(names), canonical).otherwise(result)
    return result


def directories(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(dir, symbols, short): every directory with files, its symbols, and its path without what all directories begin with ('.' if that is all)."""
    counts = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    rows = files.join(counts, "file_id", "left").groupBy(parent_dir(F.col("path")).alias("dir")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("symbols"))
    # the common beginning is that of the least and the greatest path, segment by segment
    ends = rows.agg(F.split(F.min("dir"), "/").alias("a"), F.split(F.max("dir"), "/").alias("b"))
    same = F.aggregate(F.arrays_zip("a", "b"), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & F.coalesce(x["a"] == x["b"], F.lit(False))).alias("on"), (s["n"] + (s["on"] & F.coalesce(x["a"] == x["b"], F.lit(False))).cast("int")).alias("n")))
    depth = ends.select(same["n"].alias("depth"))
    parts = F.split("dir", "/")
    short = F.array_join(F.slice(parts, F.col("depth") + 1, F.size(parts)), "/")
    return rows.join(F.broadcast(depth)).select("dir", "symbols", F.when(short == "", ".").otherwise(short).alias("short"))


def resolve_directories(known: DataFrame, query: str) -> DataFrame:
    """Directories that the query names: by their whole short path or last segments; else those below it."""
    q = query.replace("\\", "/").rstrip("/")
    exact = (F.col("short") == q) | F.col("dir").endswith(f"/{q}")
    rows = known.where(exact | F.col("short").startswith(f"{q}/")).withColumn("exact", exact)
    best = rows.agg(F.bool_or("exact").alias("any"))
    return rows.join(F.broadcast(best)).where("exact or not any").select("dir", "short")


def suggestions(known: DataFrame, query: str) -> DataFrame:
    """(short, kind): what could be meant (did_you_mean), and all directories of three symbols or more (known)."""
    q = query.replace("\\", "/").rstrip("/")
    near = known.where(F.col("short").contains(q)).select("short", F.lit("did_you_mean").alias("kind"))
    return near.unionByName(known.where("symbols >= 3").select("short", F.lit("known").alias("kind"))).distinct()


def communication(files: DataFrame, symbols: DataFrame, edges: DataFrame, a: str, b: str, examples: int = 10) -> tuple[DataFrame, DataFrame]:
    """Edges from one directory to another and back: counts (direction, n), and examples (direction, from_name, from_file, to_name, to_file, kind) in order.

    The start of an edge without a source is its file. A directory's files are all whose path begins with it, in any case.
    """
    known = materialize(directories(files, symbols), "directories")
    sides = {s: F.broadcast(resolve_directories(known, q).select(F.lower("dir").alias("prefix")).distinct()) for s, q in (("a", a), ("b", b))}  # directories of one name
    paths_ = files.select("file_id", "path")
    of = lambda side: paths_.join(sides[side], F.lower("path").startswith(F.col("prefix")), "left_semi").select("file_id", "path")
    target = symbols.select(F.col("symbol_id").alias("target_symbol_id"), F.col("name").alias("to_name"), F.col("file_id").alias("to_id"))
    source = symbols.select(F.col("symbol_id").alias("source_symbol_id"), F.col("name").alias("source_name"))
    rows = None
    for direction, x, y in (("a_to_b", "a", "b"), ("b_to_a", "b", "a")):
        start = of(x).select(F.col("file_id").alias("source_file_id"), F.col("path").alias("from_file"))
        end = of(y).select(F.col("file_id").alias("to_id"), F.col("path").alias("to_file"))
        own = edges.join(start, "source_file_id").join(target, "target_symbol_id").join(end, "to_id").join(source, "source_symbol_id", "left")
        own = own.select(F.lit(direction).alias("direction"), F.coalesce("source_name", F.substring_index("from_file", "/", -1)).alias("from_name"), "from_file", "to_name", "to_file", "kind")
        rows = own if rows is None else rows.unionByName(own)
    rows = materialize(rows, "communication")
    counts = rows.groupBy("direction").agg(F.count("*").alias("n"))
    order = ["from_file", "from_name", "to_file", "to_name", "kind"]
    some = [rows.where(F.col("direction") == d).orderBy(*order).limit(examples) for d in ("a_to_b", "b_to_a")]
    return counts, some[0].unionByName(some[1])


def dependencies(members: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct names of symbols outside the members (symbol_id, file_id) that edges from their files lead to."""
    inside = members.select("symbol_id").distinct()
    near = edges.join(members.select(F.col("file_id").alias("source_file_id")).distinct(), "source_file_id", "left_semi").select(F.col("target_symbol_id").alias("symbol_id")).distinct()
    return symbols.join(near.join(inside, "symbol_id", "left_anti"), "symbol_id", "left_semi").select("name").distinct()


def consumers(members: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct paths of files outside the members' from which edges lead to members."""
    into = edges.join(members.select(F.col("symbol_id").alias("target_symbol_id")).distinct(), "target_symbol_id", "left_semi").select(F.col("source_file_id").alias("file_id")).distinct()
    return files.join(into.join(members.select("file_id").distinct(), "file_id", "left_anti"), "file_id", "left_semi").select("path")


def clusters(members: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, cluster): files of the members that edges between them tie together, in any direction; files alone have no row."""
    own = members.select("file_id").distinct()
    home = symbols.select(F.col("symbol_id").alias("target_symbol_id"), F.col("file_id").alias("dst"))
    arcs = edges.select(F.col("source_file_id").alias("src"), "target_symbol_id").join(home, "target_symbol_id").where("src <> dst").select("src", "dst").distinct()
    arcs = arcs.join(own.withColumnRenamed("file_id", "src"), "src", "left_semi").join(own.withColumnRenamed("file_id", "dst"), "dst", "left_semi")
    return iterative.connected(arcs).select(F.col("node").alias("file_id"), F.col("component").alias("cluster"))


def membership_hash(members: DataFrame) -> DataFrame:
    """One row: the SHA-256 of the members' files and symbols, in order. A subsystem has as many files as its cap allows, so the lists are short."""
    rows = members.agg(F.array_sort(F.collect_set("file_id")).alias("f"), F.array_sort(F.collect_set("symbol_id")).alias("s"))
    text = lambda c, mark: F.array_join(F.transform(c, lambda x: F.concat(F.lit(mark), x.cast("string"), F.lit("_"))), "")
    return rows.select(F.sha2(F.concat(text("f", "f"), text("s", "s")), 256).alias("hash"))


def report(members: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, entrypoints: DataFrame | None = None) -> DataFrame:
    """Distinct (section, value) of a set of members: files, symbols, dependencies, consumers, routes, entrypoints, hash. entrypoints: (symbol_id, name, class)."""
    members = materialize(members.select("symbol_id", "file_id").distinct(), "members")
    own = symbols.join(members.select("symbol_id"), "symbol_id", "left_semi")
    parts = {
        "files": files.join(members.select("file_id").distinct(), "file_id", "left_semi").select("path"),
        "symbols": own.select("name"),
        "dependencies": dependencies(members, symbols, edges),
        "consumers": consumers(members, files, edges),
        "hash": membership_hash(members),
    }
    if entrypoints is not None:
        inside = entrypoints.join(members.select("symbol_id"), "symbol_id", "left_semi")
        parts |= {"entrypoints": inside.select("name"), "routes": inside.where("class <> 'Page'").select("name")}
    out = None
    for section, rows in parts.items():
        rows = rows.toDF("value").select(F.lit(section).alias("section"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def find(files: DataFrame, symbols: DataFrame, edges: DataFrame, features: DataFrame, name: str, scope: str = "expanded", seeds: int = 50) -> DataFrame:
    """Members (symbol_id, file_id, hop) of the subsystem that a search for the name finds: its canonical name first, then the name as given. No rows if neither finds symbols."""
    canonical = materialize(symbols.sparkSession.createDataFrame([(name,)], "name string").select(canonical_name(F.col("name")).alias("c")), "name").first()[0]  # one row
    for query in dict.fromkeys([canonical, name]):
        rows = search.demoted(search.ranked_symbols(files, features, query).where("name_score >= 100"))
        found = materialize(rows.orderBy(F.desc("score"), "name", "path", "symbol_id").limit(seeds).select("symbol_id"), "seeds")
        if not found.isEmpty():
            return paths.discover_subsystem(symbols, edges, found, scope)
    return symbols.select("symbol_id", "file_id", F.lit(0).alias("hop")).limit(0)


def capsule(members: DataFrame, files: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """(section, value) of a subsystem (symbol_id, file_id): core_files, models, tests, public_apis, entry_points (name in path)."""
    own = files.join(members.select("file_id").distinct(), "file_id", "left_semi").select("path")
    has = lambda words: own.where(" or ".join(f"contains(path, '{w}')" for w in words))
    inside = entrypoints.join(members.select("symbol_id").distinct(), "symbol_id", "left_semi")
    parts = {"core_files": own, "models": has(["model", "schema", "entities"]), "tests": has(["test", "spec"]), "public_apis": inside.select("name"), "entry_points": inside.select(F.concat("name", F.lit(" in "), "path"))}
    out = None
    for section, rows in parts.items():
        rows = rows.toDF("value").select(F.lit(section).alias("section"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()

"""Repository files as tables: walk, hashes, change classes, slices, manifests, upserts and cascades."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------------------------------
SKIPPED_DIRECTORIES = ["node_modules", "dist", "build", ".next", "out", "target", "vendor", ".venv", "venv", "__pycache__", ".pytest_cache", ".git"]
SOURCE_EXTENSIONS = ["rs", "ts", "tsx", "py", "js", "jsx", "json", "toml", "txt", "yml", "yaml", "vue", "svelte"]


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, content, content_hash) of the source files below root, read by Spark: any store that it can read will do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = f"/{root.split(':')[-1].strip('/')}/"
    files = files.withColumn("path", F.expr(f"substring(path, instr(path, '{base}') + {len(base)})"))
    skipped = "|".join(d.replace(".", "\\.") for d in SKIPPED_DIRECTORIES)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.regexp_extract("path", r"\.([^./]+)$", 1).isin(SOURCE_EXTENSIONS) | (name == "Dockerfile")
    rows = files.where(wanted & ~F.col("path").rlike(f"(^|/)({skipped})/"))
    return rows.select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("content_hash"))


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) of tables (path, content_hash): Unchanged, Changed, Added or Removed. Null hashes are never Unchanged."""
    a, b = old.select("path", F.col("content_hash").alias("before"), F.lit(True).alias("was")), new.select("path", F.col("content_hash").alias("after"), F.lit(True).alias("is"))
    state = F.when(F.col("was").isNull(), "Added").when(F.col("is").isNull(), "Removed").when(F.col("before") == F.col("after"), "Unchanged").otherwise("Changed")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def stale_counts(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """One row (stale, checked): indexed files that are gone or differ. An indexed file without a hash is checked, but never stale."""
    now = current.select("path", F.col("content_hash").alias("now"))
    stale = F.col("content_hash").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("now"))
    return indexed.select("path", "content_hash").join(now, "path", "left").agg(F.count_if(stale).alias("stale"), F.count("*").alias("checked"))


def stale_files(indexed: DataFrame, current: DataFrame, limit: int = 100) -> DataFrame:
    """(path) of indexed files that are gone or differ, in order, `limit` of them."""
    now = current.select("path", F.col("content_hash").alias("now"))
    rows = indexed.where("content_hash is not null").join(now, "path", "left")
    return rows.where(~F.col("content_hash").eqNullSafe(F.col("now"))).select("path").orderBy("path").limit(limit)


def freshness(counts: DataFrame) -> DataFrame:
    return counts.withColumn("status", F.when(F.col("checked") == 0, "not_indexed").when(F.col("stale") > 0, "stale").otherwise("healthy"))


def line_range(files: DataFrame, start: int, end: int, key: str = "path", content: str = "content") -> DataFrame:
    """(key, text) of lines start to end, from 1; end is cut to the last line. Files that are shorter than start have no row; wrong bounds raise."""
    if start < 1 or end < start:
        raise ValueError("line ranges begin at 1 and do not end before they begin")
    text = F.regexp_replace(F.regexp_replace(F.col(content), "\r\n", "\n"), "\n$", "")  # a last empty line is none
    lines = F.when(F.col(content) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    return files.select(key, lines.alias("lines")).where(F.size("lines") >= start).select(key, F.array_join(F.slice("lines", start, end - start + 1), "\n").alias("text"))


def byte_slices(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbol_id, source: the bytes start_byte to end_byte of the symbol's file; null where these lie outside it."""
    rows = symbols.join(files.select("file_id", F.col("content").cast("binary").alias("_bytes")), "file_id")
    fits = (F.col("start_byte") >= 0) & (F.col("end_byte") >= F.col("start_byte")) & (F.col("end_byte") <= F.length("_bytes"))
    piece = F.expr("substring(_bytes, cast(start_byte + 1 as int), cast(end_byte - start_byte as int))")
    return rows.select("symbol_id", F.when(fits, piece.cast("string")).alias("source"))


def manifest_symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind) of the dependencies, devDependencies and scripts of every package.json."""
    own = files.where(F.element_at(F.split("path", "/"), -1) == "package.json")
    sections = ["dependencies", "devDependencies", "scripts"]
    parsed = own.select("path", F.from_json("content", ", ".join(f"{s} map<string,string>" for s in sections), {"mode": "PERMISSIVE"}).alias("j"))
    kinds = F.array(*[F.struct(F.lit({"dependencies": "dependency", "devDependencies": "devDependency", "scripts": "script"}[s]).alias("kind"), F.map_keys(f"j.{s}").alias("names")) for s in sections])
    return parsed.select("path", F.explode(kinds).alias("k")).select("path", F.col("k.kind").alias("kind"), F.explode("k.names").alias("name"))


@dataclass(frozen=True)
class Index:
    """Tables of one index; each row of them but files belongs to a file."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    relationships: DataFrame
    bindings: DataFrame


def without_files(index: Index, gone: DataFrame) -> Index:
    """The index without these files (file_id): their symbols, edges from and to them, references and bindings go too."""
    gone = gone.select("file_id").distinct()
    lost = index.symbols.join(gone, "file_id", "left_semi").select(F.col("symbol_id").alias("_id"))
    edges = index.edges.join(gone.withColumnRenamed("file_id", "source_file_id"), "source_file_id", "left_anti")
    for end in ("source_symbol_id", "target_symbol_id"):
        edges = edges.join(lost, edges[end] == lost["_id"], "left_anti")
    keep = lambda df: df.join(gone, "file_id", "left_anti")
    return replace(index, files=keep(index.files), symbols=keep(index.symbols), edges=edges, relationships=keep(index.relationships), bindings=keep(index.bindings))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys (nulls are equal); of several new rows with one key, one stays."""
    fresh = new.dropDuplicates(keys)
    same = [old[k].eqNullSafe(fresh[k]) for k in keys]
    return old.join(fresh, same, "left_anti").unionByName(fresh)

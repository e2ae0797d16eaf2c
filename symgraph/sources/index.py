"""An index on disk: its tables and their schemas, columns that old tables lack, publishing whole versions, ignore rules."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from symgraph.functions.scalars import absolute_path
from symgraph.functions.tables import delete, exists

#: Tables of an index.
SCHEMAS = {
    "files": "file_id long, path string, metadata string, content_hash string",
    "symbols": "symbol_id long, file_id long, name string, kind string, signature string, start_line long, end_line long, start_byte long, end_byte long, attributes array<string>",
    "relationships": "rel_id long, file_id long, name string, source string, line_number long, kind string, state string, confidence double, evidence string",
    "edges": "source_file_id long, source_symbol_id long, target_symbol_id long, kind string, edge_type string, metadata string, confidence double",
    "bindings": "binding_id long, file_id long, kind string, name string, type_name string, context string",
    "embeddings": "symbol_id long, model_id string, embedding array<float>, body_hash string",
    "features": "symbol_id long, pagerank double, fan_in long, fan_out long, interaction_count long, community_id long, is_entrypoint boolean, is_callable boolean, is_type boolean, is_local boolean, is_constant boolean, is_exported boolean, is_public boolean, is_generated boolean",
    "concepts": "symbol_id long, concept string, matched_on string",
    "manifests": "id long, version string, total_files long, total_symbols long, total_relationships long, edges_emitted long",
    "metadata": "key string, value string",
}
#: What columns have that an old table lacks.
DEFAULTS = {"edge_type": "static", "confidence": 1.0}


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def migrated(table: str, rows: DataFrame) -> DataFrame:
    """rows in the schema of the table: missing columns are added with their default or null, others cast, unknown ones dropped."""
    own = {f.name: f for f in rows.schema.fields}
    return rows.select(*[(F.col(f.name) if f.name in own else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema(table).fields])


def file_ids(paths: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(path, file_id) of stored or absolute paths; null where no file has it."""
    known = files.select("file_id", absolute_path(root, F.col("path")).alias("_full"))
    return paths.select("path").distinct().withColumn("_full", absolute_path(root, F.col("path"))).join(known, "_full", "left").select("path", "file_id")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables as a new version below root, then make it the current one by replacing one small file. Readers see
    the old version or the new one, never parts of both; a failed write leaves the old one. Returns the version's folder."""
    version = uuid.uuid4().hex
    folder = f"{root.rstrip('/')}/versions/{version}"
    for name, rows in tables.items():
        migrated(name, rows).write.parquet(f"{folder}/{name}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    new, current = hadoop.Path(f"{root.rstrip('/')}/CURRENT.{version}"), hadoop.Path(f"{root.rstrip('/')}/CURRENT")
    context = hadoop.FileContext.getFileContext(current.toUri(), conf)
    out = current.getFileSystem(conf).create(new, True)
    out.write(version.encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, current, options)
    return folder


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the current version, or none."""
    if not exists(spark, f"{root.rstrip('/')}/CURRENT"):
        return None
    version = spark.read.text(f"{root.rstrip('/')}/CURRENT").first()[0]
    return f"{root.rstrip('/')}/versions/{version}"


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the current version; empty if there is none."""
    folder = current(spark, root)
    if folder is None or not exists(spark, f"{folder}/{table}"):
        return spark.createDataFrame([], schema(table))
    return spark.read.schema(schema(table)).parquet(f"{folder}/{table}")


def drop_version(spark: SparkSession, folder: str) -> None:
    """Delete a version that no reader uses any more."""
    delete(spark, folder)


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """A regular expression for the paths that a line of an ignore file means, and whether it takes them back in. None for comments and blank lines."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.removeprefix("!")
    only_directories, line = line.endswith("/"), line.rstrip("/")
    anchored = "/" in line
    out, i, text = [], 0, line.lstrip("/")
    while i < len(text):
        if text.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif text.startswith("**", i):
            out.append(".*")
            i += 2
        elif text[i] == "*":
            out.append("[^/]*")
            i += 1
        elif text[i] == "?":
            out.append("[^/]")
            i += 1
        elif text[i] == "[" and (end := text.find("]", i + 2)) > 0:
            out.append("[" + text[i + 1 : end].replace("!", "^", 1 if text[i + 1] == "!" else 0).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(text[i]))
            i += 1
    return ("^" if anchored else "(?:^|/)") + "".join(out) + ("/" if only_directories else "(?:/|$)"), back


def kept(files: DataFrame, rules: list[str], path: str = "path") -> DataFrame:
    """files, in order of path, whose paths (relative to where the rules stand) no rule leaves out; of the rules that fit the last decides."""
    column = F.regexp_replace(F.col(path), r"^(\./)+", "")
    out = F.lit(False)
    for pattern, back in filter(None, map(ignore_pattern, rules)):
        out = F.when(column.rlike(pattern), F.lit(not back)).otherwise(out)
    return files.where(~out).orderBy(path)

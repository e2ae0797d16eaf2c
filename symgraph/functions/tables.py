"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_root(spark: SparkSession, folder: str | None = None) -> str:
    """A folder (by default the application's own) in spark.checkpoint.dir; in a temporary one only where that is unset and all executors are on this machine (local runs, tests)."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or _roots.get(app)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _roots[app] = tempfile.mkdtemp(prefix="symgraph-")
    return "/".join(x for x in (root.rstrip("/"), f"symgraph-{app}" if folder is None else folder) if x)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df and read it back: iterative operators cut their lineage with it, and lost executors cost no recomputation."""
    path = f"{shared_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the files that a plan reads for each partition of `spread`.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by columns to as many partitions as the files it reads ask for, so that what a task groups or sorts stays the same however large they are."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if size > 1 << 60:  # a source that doesn't tell its size
        return df.repartition(*columns)
    return df.repartition(min(max(1, -(-size // SPREAD_BYTES)), 100_000), *columns)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mark(spark: SparkSession) -> int:
    """A place in the list of tables written so far, for release."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Delete the tables written since `mark` gave that place, but those that `keep` is read from: for callers that have written their result."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    used = [f for df in keep for f in df.inputFiles()]
    for path in paths[since:]:
        if not any(path in f for f in used):
            delete(spark, path)
            paths.remove(path)

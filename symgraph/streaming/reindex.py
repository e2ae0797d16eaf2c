"""Incremental work: which cards need a vector, and an index that follows a stream of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.tables import exists, materialize


def embedding_work(cards: DataFrame, embedded: DataFrame) -> DataFrame:
    """(symbol_id, body_hash, action): skip what has its vector, reuse the vector of an equal card, embed the rest. Both tables (symbol_id, body_hash)."""
    known = embedded.where("body_hash is not null").select("body_hash").distinct().withColumn("_known", F.lit(True))
    own = embedded.select("symbol_id", F.col("body_hash").alias("_had"))
    rows = cards.join(own, "symbol_id", "left").join(known, "body_hash", "left")
    action = F.when(F.col("body_hash") == F.col("_had"), "skip").when(F.col("_known"), "reuse").otherwise("embed")
    return rows.select("symbol_id", "body_hash", action.alias("action"))


def latest(files: DataFrame) -> DataFrame:
    """Of each path the row of the highest version."""
    return files.groupBy("path").agg(F.max_by(F.struct("*"), "version").alias("r")).select("r.*")


def follow(changed: DataFrame, folder: str, checkpoint: str, buckets: int = 64):
    """Start a query that upserts each batch of changed files (path, version, ...) into a table in a folder, of each path the highest version.

    The table lies in buckets by a hash of the path (see read_followed); a batch rewrites only the buckets of its paths. A
    batch that is run again after a failure changes nothing, since of one path the highest version stays.
    """

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # `buckets` numbers at most
        if not touched:
            return
        if exists(spark, folder):
            old = spark.read.schema(rows.schema).parquet(folder).where(F.col("_bucket").isin(touched))
            rows = old.unionByName(rows)
        merged = materialize(latest(rows), "followed")  # read whole before its buckets are replaced
        merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(folder)

    return changed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_followed(spark: SparkSession, folder: str) -> DataFrame:
    """The table that follow keeps."""
    return spark.read.parquet(folder).drop("_bucket")

"""A training corpus from raw documents in five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symgraph.functions.tables import exists, mark, release, shared_root
from symgraph.llm import decontaminate, packing, pii, simhash, toxicity
from symgraph.llm.common import materialize, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values are replaced by pseudonyms of the same format."""
    return pii.pseudonymize(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into training sequences along the curve."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("near-duplicates", near_duplicates), ("decontamination", decontaminated), ("pseudonyms", pseudonyms), ("packing", packed)]

#: SQL can't express the learned, hashed and tokenized stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The packed corpus. Each stage's tables are deleted once the next has written its own.

    With a run_id stages have names of their own in the shared folder, and a run that failed goes on after the last stage
    that was written whole; nothing is deleted then.
    """
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        if run_id:
            path = f"{shared_root(spark, '')}/run-{run_id}/{at}-{name}"
            if not exists(spark, f"{path}/_SUCCESS"):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
        else:
            place = mark(spark)
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            release(spark, max(0, place - 1) if at else place, keep=[docs])
    return docs

"""The code-graph tables, derived from the driver's relational tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.tables import spread


@dataclass(frozen=True)
class Graph:
    """files (file_id, path); symbols (symbol_id, file_id, name, kind, start_line, end_line); edges (source_file_id, source_symbol_id, target_symbol_id, kind, edge_type, confidence)."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    joined = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select((F.col("n_nationkey").cast("long") + 1).alias("file_id"), F.concat(F.lit("./src/"), lower("r_name"), F.lit("/"), lower("n_name"), F.lit(".ts")).alias("path"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(table: str, base: int, key: str, file_id, name: str, kind, line: int) -> DataFrame:
        return read(spark, sf_dir, table).select((F.lit(base) + F.col(key)).cast("long").alias("symbol_id"), file_id.cast("long").alias("file_id"), F.col(name).alias("name"), kind.alias("kind"), F.lit(line).cast("long").alias("start_line"), F.lit(line + 9).cast("long").alias("end_line"))

    segment = F.col("c_mktsegment")
    kind = F.when(segment == "BUILDING", "class").when(segment == "MACHINERY", "variable").otherwise("method")
    return (
        part("supplier", 10_000_000, "s_suppkey", F.col("s_nationkey") + 1, "s_name", F.lit("function"), 1)
        .unionByName(part("customer", 20_000_000, "c_custkey", F.col("c_nationkey") + 1, "c_name", kind, 11))
        .unionByName(part("part", 30_000_000, "p_partkey", F.col("p_partkey") % 25 + 1, "p_name", F.lit("constant"), 21))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_discount")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "calls").when(flag == "N", "imports").otherwise("method_call")

    def edge(frame: DataFrame, source, target, kind, confidence) -> DataFrame:
        return frame.select(source.cast("long").alias("source_symbol_id"), target.cast("long").alias("target_symbol_id"), kind.alias("kind"), confidence.alias("confidence"))

    supplier, part = 10_000_000 + F.col("l_suppkey"), 30_000_000 + F.col("l_partkey")
    raw = (
        edge(items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), 20_000_000 + F.col("o_custkey"), supplier, kind, F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0))
        .unionByName(edge(items, supplier, part, F.lit("type_ref"), F.lit(1.0)))
        .unionByName(edge(items.groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey")), part, supplier, F.lit("inherits"), F.lit(1.0)))
    )
    # dealt once, by the source: neither grouping nor the join shuffles again, and hardly a row repeats, so nothing is grouped before
    merged = spread(raw, "source_symbol_id").groupBy("source_symbol_id", "target_symbol_id", "kind").agg(F.max("confidence").alias("confidence"))
    home = symbols(spark, sf_dir).select(F.col("symbol_id").alias("source_symbol_id"), F.col("file_id").alias("source_file_id"))
    return merged.join(home, "source_symbol_id").select("source_file_id", "source_symbol_id", "target_symbol_id", "kind", F.lit("static").alias("edge_type"), "confidence")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(files(spark, sf_dir), symbols(spark, sf_dir), edges(spark, sf_dir))


def rough(spark: SparkSession, sf_dir: str) -> Graph:
    """graph with what real indexes have besides: files and symbols that nothing is tied to, edges to symbols that are gone,
    without a source symbol, from a symbol to itself, and twice. Symbols have byte spans: 100 bytes a line."""
    g = graph(spark, sf_dir)
    region, nation, customer = (read(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    lower = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    own = region.select((F.col("r_regionkey") + 26).cast("long").alias("file_id"), F.concat(F.lit("./lib/"), lower("r_name"), F.lit("/auth_index.py")).alias("path"))
    symbol = lambda df, base, key, file_id, name, kind, start, end: df.select((F.lit(base) + F.col(key)).cast("long").alias("symbol_id"), file_id.cast("long").alias("file_id"), name.alias("name"), F.lit(kind).alias("kind"), start.cast("long").alias("start_line"), end.cast("long").alias("end_line"))
    types = symbol(region, 40_000_000, "r_regionkey", F.col("r_regionkey") + 26, F.concat(F.lit("notify_"), lower("r_name")), "class", F.lit(1), F.lit(99))
    methods = symbol(nation, 41_000_000, "n_nationkey", F.col("n_regionkey") + 26, F.concat(F.lit("get_"), lower("n_name")), "method", F.col("n_nationkey") * 3 + 2, F.col("n_nationkey") * 3 + 3)
    symbols_ = g.symbols.unionByName(types).unionByName(methods)
    symbols_ = symbols_.withColumns({"start_byte": F.col("start_line") * 100, "end_byte": F.col("end_line") * 100 + 99})
    home, me, key = (F.col("c_nationkey") + 1).cast("long"), (20_000_000 + F.col("c_custkey")).cast("long"), F.col("c_custkey")
    edge = lambda df, source, target, kind: df.select(home.alias("source_file_id"), source.alias("source_symbol_id"), target.cast("long").alias("target_symbol_id"), F.lit(kind).alias("kind"), F.lit("static").alias("edge_type"), F.lit(1.0).alias("confidence"))
    gone = edge(customer.where("c_custkey % 50 = 0"), me, 90_000_000 + key, "calls")
    open_ = edge(customer.where("c_custkey % 40 = 1"), F.lit(None).cast("long"), 10_000_001 + key % 7, "interaction")
    loops = edge(customer.where("c_custkey % 60 = 7"), me, me, "calls")
    return Graph(g.files.unionByName(own), symbols_, g.edges.unionByName(gone).unionByName(open_).unionByName(loops))


def symbol_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol_id, model_id, embedding, body_hash): the vectors as those of suppliers' symbols, of two models."""
    model = F.when(F.col("label") % 2 == 0, "local").otherwise("remote")
    return read(spark, sf_dir, "embeddings").select((10_000_001 + F.col("vec_id")).cast("long").alias("symbol_id"), model.alias("model_id"), "embedding", F.sha2(F.col("label").cast("string"), 256).alias("body_hash"))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw reference per line item: rel_id, file_id, name, line_number, kind."""
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "calls").when(flag == "N", "imports").otherwise("method_call")
    joined = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("rel_id"), (F.col("c_nationkey").cast("long") + 1).alias("file_id"), F.col("s_name").alias("name"), (F.col("l_linenumber").cast("long") * 4).alias("line_number"), kind.alias("kind"))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_rows(read(spark, sf_dir, "events"))


def usage_rows(events: DataFrame) -> DataFrame:
    """Tool events from rows of `events`; also for a stream of them."""
    raw = F.get_json_object("props", "$.k").cast("long") * 10
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("tool_name"),
        (F.col("event_type") != "error").alias("success"),
        (F.col("value") * 10).cast("long").alias("execution_time_ms"),
        F.col("user_id").cast("long").alias("delivered_token_count"),
        raw.alias("estimated_raw_context_tokens"),
        F.greatest(raw - F.col("user_id"), F.lit(0)).cast("long").alias("token_reduction"),
        (F.col("event_id") % 3 == 0).alias("cache_hit"),
        F.col("ts").alias("created_at"),
    )

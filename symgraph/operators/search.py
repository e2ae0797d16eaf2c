"""Ranked symbol search, text scan, vector top-k, rank fusion, concepts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgraph.functions import vocabulary as v
from symgraph.functions.scalars import cosine, in_scope, query_tokens, token_weight, whole_word


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def _place(path: Column) -> Column:
    """150 for production directories in a path, less 300 for scratch ones."""
    parts, any_of = F.split(F.lower(path), "/"), lambda names: F.array(*map(F.lit, names))
    return F.when(F.arrays_overlap(parts, any_of(v.PRODUCTION_PARTS)), 150).otherwise(0) - F.when(F.arrays_overlap(parts, any_of(v.SCRATCH_PARTS)), 300).otherwise(0)


def symbol_label(name_score: Column) -> Column:
    return F.when(name_score >= 1000, "High (Exact Match)").when(name_score >= 500, "High (Prefix Match)").when(name_score >= 250, "Medium (Contains Match)").when(name_score >= 100, "Medium (Token Match)").when(name_score >= 50, "Low (Fuzzy Match)").otherwise("Low (Weak Fuzzy)")


def file_label(score: Column) -> Column:
    return F.when(score >= 800, "High (Exact File Match)").when(score >= 250, "Medium (File Substring Match)").when(score >= 100, "Low (Token File Match)").otherwise("Low (File Path Match)")


def resolver_label(score: Column) -> Column:
    return F.when(score >= 80, "High").when(score >= 50, "Medium").otherwise("Low")


def _whole(name: Column, q: str) -> Column:
    return F.when(name == q, 1000).when(name.startswith(q), 500).when(name.contains(q), 250)


def ranked_symbols(files: DataFrame, features: DataFrame, query: str, scope: str | None = None) -> DataFrame:
    """Every matching symbol with its integer score, name score and label; name and path matches, location and features.

    features: symbols with fan_in and fan_out, and, where they are there, is_entrypoint and pagerank (else: none and 0).
    """
    q, tokens = query.lower(), query_tokens(query)
    name, path, kind = F.lower("name"), F.lower("path"), F.lower("kind")
    per_token = []
    for t in tokens:
        w, distance, size = token_weight(t), F.levenshtein(name, F.lit(t)), len(t.encode())
        near = F.when(name == t, w)
        near = near.when(distance <= 1, w // 2) if size > 3 else near
        near = near.when(distance == 2, w // 4) if size > 5 else near
        per_token.append(near.otherwise(0))
    in_path = [F.when(path.contains(q), 200).otherwise(0)] + [F.when(path.contains(t), token_weight(t) // 2).otherwise(0) for t in tokens]
    entry = F.coalesce(F.col("is_entrypoint"), F.lit(False)) if "is_entrypoint" in features.columns else F.lit(False)
    rank = F.coalesce(F.col("pagerank"), F.lit(0.0)) if "pagerank" in features.columns else F.lit(0.0)
    rows = features.join(files.where(in_scope(F.col("path"), scope)), "file_id")
    rows = rows.select("symbol_id", "name", "kind", "path", "fan_in", "fan_out", entry.alias("entry"), rank.alias("pr"), (_whole(name, q).otherwise(0) + _sum(per_token)).alias("name_score"), _sum(in_path).alias("path_score"))
    rows = rows.where("name_score > 0 or path_score > 0")
    double = lambda c: c.cast("double")
    factor = double(F.when(F.col("entry"), 1.5).when(kind.isin(v.CALLABLE_KINDS), 1.1).otherwise(1.0)) * double(F.when(kind.isin(v.LOCAL_KINDS), 0.3).otherwise(1.0)) * F.least(F.lit(1.0) + F.lit(0.1) * F.col("pr"), F.lit(2.5))
    score = ((F.col("name_score") + F.col("path_score") + _place(F.col("path"))) * factor).cast("long") + 2 * F.col("fan_in") + F.col("fan_out")
    return rows.select("symbol_id", "name", "kind", "path", score.alias("score"), "name_score", symbol_label(F.col("name_score")).alias("label")).where("score > 0")


def demoted(rows: DataFrame) -> DataFrame:
    """Of symbols of one name all but the best lose three tenths of their score, and High labels become Medium."""
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.desc("score"), "path", "symbol_id"))
    rows = rows.withColumn("rank", rank.cast("long")).withColumn("score", F.when(F.col("rank") > 1, (F.col("score") * 0.7).cast("long")).otherwise(F.col("score")))
    return rows.withColumn("label", F.when(F.col("rank") > 1, F.regexp_replace("label", "^High", "Medium")).otherwise(F.col("label"))) if "label" in rows.columns else rows


def path_rollup(rows: DataFrame) -> DataFrame:
    """(name, kind, path, score, label, members): symbols found by their path only, rolled up where a path has more than one of them."""
    only = rows.where("name_score = 0").groupBy("path").agg(F.max("score").alias("score"), F.count("*").alias("n"), F.min(F.struct("name", "kind", "label")).alias("one"))
    many = F.col("n") > 1
    return only.select(F.when(many, F.substring_index("path", "/", -1)).otherwise(F.col("one.name")).alias("name"), F.when(many, "file_rollup").otherwise(F.col("one.kind")).alias("kind"), "path", "score", F.when(many, "Low (Weak Fuzzy)").otherwise(F.col("one.label")).alias("label"), F.when(many, F.col("n")).alias("members"))


def file_matches(files: DataFrame, query: str, scope: str | None = None) -> DataFrame:
    """(name, kind, path, score, label) of files whose name or path matches."""
    q = query.lower()
    path = F.lower("path")
    name = F.substring_index(path, "/", -1)
    parts = [F.when(name == q, 800).when(name.contains(q), 250).otherwise(0), F.when(path.contains(q) & ~name.contains(q), 100).otherwise(0)]
    for t in query_tokens(query):
        w = token_weight(t)
        parts.append(F.when(name == t, w).when(name.contains(t), w // 2).when(path.contains(t), w // 4).otherwise(0))
    rows = files.where(in_scope(F.col("path"), scope)).select("path", _sum(parts).alias("base")).where("base <> 0").withColumn("score", (F.col("base") + _place(F.col("path"))).cast("long")).where("score > 0")
    return rows.select(F.substring_index("path", "/", -1).alias("name"), F.lit("file").alias("kind"), "path", "score", file_label(F.col("score")).alias("label"))


def search(files: DataFrame, features: DataFrame, query: str, scope: str | None = None, limit: int = 15, mode: str = "symbol", texts: DataFrame | None = None, whole: str | None = None) -> DataFrame:
    """(name, kind, path, score, label) of the best results. mode: symbol (symbols, roll-ups, files), text (lines of `texts` (path, content), score 200 each) or both."""
    columns = ["name", "kind", "path", "score", "label"]
    found = []
    if mode in ("symbol", "both"):
        rows = ranked_symbols(files, features, query, scope)
        found += [demoted(rows.where("name_score > 0")).select(columns), path_rollup(rows).select(columns), file_matches(files, query, scope)]
    if mode in ("text", "both") and texts is not None:
        tokens = query_tokens(query)
        every = lambda c: reduce(lambda a, b: a & b, [F.lower(c).contains(t) for t in tokens], F.lit(bool(tokens)))
        lines = texts.where(in_scope(F.col("path"), scope) & every(F.col("content"))).select("path", F.explode(F.split("content", "\n")).alias("line")).where(every(F.col("line")))
        lines = lines.where(whole_word(F.col("line"), whole)) if whole else lines
        found.append(lines.select(F.substring_index("path", "/", -1).alias("name"), F.lit("text").alias("kind"), "path", F.lit(200).cast("long").alias("score"), F.lit("Medium (Text Match)").alias("label")))
    return reduce(DataFrame.unionByName, found).orderBy(F.desc("score"), "name", "path", "kind").limit(limit)


def find_symbols(symbols: DataFrame, files: DataFrame, query: str, scope: str | None = None, limit: int = 10) -> DataFrame:
    """(symbol_id, name, path, kind, start_line, score) of the best by name alone: equal, beginning, within, one or two letters off."""
    q, name, size = query.lower(), F.lower("name"), len(query.lower().encode())
    score = _whole(name, q)
    distance = F.levenshtein(name, F.lit(q))
    score = score.when(distance <= 1, 100) if size > 3 else score
    score = score.when(distance == 2, 50) if size > 5 else score
    rows = symbols.join(files.where(in_scope(F.col("path"), scope)), "file_id").select("symbol_id", "name", "path", "kind", "start_line", score.otherwise(0).cast("long").alias("score"))
    return rows.where("score > 0").orderBy(F.desc("score"), "name", "path", "symbol_id").limit(limit)


def concepts_of(term: str) -> list[str]:
    """Concepts that a term names: itself, or a keyword within it or around it."""
    term = term.lower()
    return [c for c, words in v.CONCEPTS.items() if term and (term == c or any(w in term or term in w for w in words))]


def augmented(results: DataFrame, tags: DataFrame, symbols: DataFrame, files: DataFrame, query: str, most: int = 10) -> DataFrame:
    """results (name, kind, path, score, label) and up to `most` symbols of the concepts that the query names, score 150; tags (symbol_id, concept)."""
    wanted = concepts_of(query)
    if not wanted:
        return results
    place = {c: i for i, c in enumerate(wanted)}
    order = reduce(lambda out, kv: F.when(F.col("concept") == kv[0], kv[1]).otherwise(out), place.items(), F.lit(len(place)))
    rows = tags.where(F.col("concept").isin(wanted)).join(symbols, "symbol_id").join(files, "file_id").select("name", "kind", "path", "concept", "symbol_id", order.alias("place"))
    first = rows.groupBy("name", "path").agg(F.min(F.struct("place", "symbol_id", "kind", "concept")).alias("b"))
    more = first.join(results, ["name", "path"], "left_anti").orderBy("b.place", "b.symbol_id").limit(most)
    more = more.select("name", F.col("b.kind").alias("kind"), "path", F.lit(150).cast("long").alias("score"), F.concat(F.lit("Concept Match ("), F.col("b.concept"), F.lit(")")).alias("label"))
    return results.unionByName(more)


def text_search(docs: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Lines that hold every token of texts that do; in order of document and line."""
    tokens = query_tokens(query)
    every = lambda c: reduce(lambda a, b: a & b, [F.lower(c).contains(t) for t in tokens])
    lines = docs.where(every(F.col("text"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.where(every(F.col("line"))).select("doc_id", (F.col("at") + 1).cast("long").alias("line_number"), F.length("line").cast("long").alias("n_chars")).orderBy("doc_id", "line_number").limit(limit)


def vector_top_k(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id") -> DataFrame:
    """The k nearest by cosine; ties by id."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(cosine(F.col("embedding"), wanted), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def symbol_vectors(embeddings: DataFrame, symbols: DataFrame, files: DataFrame, model: str, scope: str | None = None) -> DataFrame:
    """Embeddings of one model with their symbols and files (in scope)."""
    return embeddings.where(F.col("model_id") == model).join(symbols, "symbol_id").join(files.where(in_scope(F.col("path"), scope)), "file_id").select("symbol_id", "path", "name", "kind", "start_line", "embedding")


def embedding_candidates(embeddings: DataFrame, symbols: DataFrame, files: DataFrame, model: str) -> DataFrame:
    """Every symbol with its file, and the body_hash of its vector of this model, or null."""
    own = embeddings.where(F.col("model_id") == model).select("symbol_id", "body_hash")
    return symbols.join(files, "file_id").join(own, "symbol_id", "left").select("symbol_id", "path", "kind", "name", "body_hash")


def reuse_map(embeddings: DataFrame, model: str) -> DataFrame:
    """(body_hash, symbol_id): for each text of a model that has a vector, the lowest symbol with it."""
    return embeddings.where(F.col("model_id") == model).where("body_hash is not null").groupBy("body_hash").agg(F.min("symbol_id").alias("symbol_id"))


#: Query vectors that go to the tasks at once.
QUERY_BLOCK = 4096


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest of all vectors (vec_id, embedding) to each query (query_id, embedding), by cosine; ties by id.

    Queries go out in blocks of bounded size; each task keeps its k best of each query by one matrix product a batch, and
    only those meet. Vectors of another length than the query's, empty and zero ones have similarity 0.
    """
    ids = queries.select("query_id", "embedding").orderBy("query_id")
    out = []
    for block in _blocks(ids.toLocalIterator(), QUERY_BLOCK):  # the stated set of queries, a block at a time
        names = [r.query_id for r in block]
        out.append(vectors.select("vec_id", "embedding").mapInArrow(_nearest(names, [r.embedding or [] for r in block], k), "query_id long, vec_id long, similarity double"))
    if not out:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double, rank long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return reduce(DataFrame.unionByName, out).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _blocks(rows: Iterator, size: int) -> Iterator[list]:
    while block := list(islice(rows, size)):
        yield block


def _nearest(names: list[int], wanted: list[list[float]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {len(w) for w in wanted}
        by_size = {n: ([i for i, w in enumerate(wanted) if len(w) == n], np.array([w for w in wanted if len(w) == n], float).reshape(-1, n)) for n in sizes}
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in names]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = [np.asarray(x if x is not None else [], float) for x in batch.column(1).to_pylist()]
            for n, (places, matrix) in by_size.items():
                fits = [i for i, x in enumerate(rows) if len(x) == n and n]
                near = np.zeros((len(matrix), len(rows)))
                if fits:
                    own = np.stack([rows[i] for i in fits])
                    norms = np.sqrt((matrix**2).sum(1))[:, None] * np.sqrt((own**2).sum(1))[None, :]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        near[:, fits] = np.where(norms > 0, matrix @ own.T / norms, 0.0)
                near = np.round(near, 6)
                for q, at in enumerate(places):
                    values, own_ids = np.concatenate([best[at][0], near[q]]), np.concatenate([best[at][1], ids])
                    order = np.lexsort((own_ids, -values))[:k]
                    best[at] = values[order], own_ids[order]
        counts = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), counts)), pa.array(np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[0] for b in best]))], names=["query_id", "vec_id", "similarity"])

    return run


def ranked_leg(rows: DataFrame, *order: Column | str, line: Column | None = None) -> DataFrame:
    """(name, path, label, line, rank) of a leg of a few rows, in this order."""
    return rows.select("name", "path", "label", (line if line is not None else F.lit(None)).cast("long").alias("line"), F.row_number().over(W.orderBy(*order)).alias("rank"))


def rrf(legs: list[DataFrame], limit: int = 15) -> DataFrame:
    """(name, path, score, label, line): reciprocal rank fusion of legs by name and path; score = round(10000 x sum of 1 / (60 + rank)).

    The first leg's label stays, unless another has an exact one; the first known line stays. Order: sum, exact labels, name, path.
    """
    rows = reduce(DataFrame.unionByName, [leg.withColumn("leg", F.lit(i)) for i, leg in enumerate(legs)])
    exact = F.col("label").startswith("High (Exact")
    of = lambda value, test: F.min_by(F.when(test, value), F.when(test, F.struct("leg", "rank")))
    fused = rows.groupBy("name", "path").agg(F.sum(1.0 / (60 + F.col("rank"))).alias("s"), of(F.col("label"), exact).alias("exact"), of(F.col("label"), F.lit(True)).alias("first"), of(F.col("line"), F.col("line").isNotNull()).alias("line"))
    fused = fused.select("name", "path", F.round("s", 12).alias("s"), F.coalesce("exact", "first").alias("label"), "line", F.col("exact").isNotNull().alias("is_exact")).orderBy(F.desc("s"), F.desc("is_exact"), "name", "path").limit(limit)
    return fused.select("name", "path", F.round(F.col("s") * 10000).cast("long").alias("score"), "label", "line")


def concept_tags(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, concept, matched_on) for each concept with a keyword in the name, or else in the path."""
    out = []
    for concept, words in v.CONCEPTS.items():
        hit = lambda c: reduce(lambda a, b: a | b, [F.lower(c).contains(w) for w in words])  # noqa: E731, B023
        on = F.when(hit(F.col("name")), "name").when(hit(F.col("path")), "path")
        out.append(F.struct(F.lit(concept).alias("concept"), on.alias("matched_on")))
    rows = symbols.join(files, "file_id").select("symbol_id", F.explode(F.array(*out)).alias("t")).select("symbol_id", "t.*")
    return rows.where("matched_on is not null")


def symbols_of_concept(symbols: DataFrame, files: DataFrame, concept: str) -> DataFrame:
    return concept_tags(symbols, files).where(F.col("concept") == concept)

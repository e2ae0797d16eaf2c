"""What stands around a symbol: neighbours by role, candidates, lookups, previews. For whole tables of symbols at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symgraph.functions import vocabulary as v
from symgraph.functions.scalars import in_scope
from symgraph.functions.tables import materialize

CALLS = ["calls"]
OTHER_KINDS = [k for k in v.CANONICAL_KINDS if k not in CALLS]


def _confident(kinds: list[str], receiver_kinds: list[str]) -> Column:
    """Edges of these kinds, and of the receiver kinds those of enough confidence."""
    return F.col("kind").isin(kinds) | (F.col("kind").isin(receiver_kinds) & (F.col("confidence") >= v.RECEIVER_CONFIDENCE))


#: Section of a context -> (edges that count, whether the symbol is their source).
SECTIONS = {
    "callers": (lambda: _confident(CALLS, v.RECEIVER_KINDS), False),
    "callees": (lambda: _confident(CALLS, v.RECEIVER_KINDS), True),
    "reverse_dependencies": (lambda: _confident(OTHER_KINDS, ["MEMBER_ACCESS"]), False),
    "forward_dependencies": (lambda: _confident(OTHER_KINDS, ["MEMBER_ACCESS"]), True),
    "wrapped_by": (lambda: F.col("kind") == "wraps_route", False),
    "renders_components": (lambda: F.col("kind") == "renders_component", True),
    "consumes_hooks": (lambda: F.col("kind") == "consumes_hook", True),
}


def symbol_context(wanted: DataFrame, symbols: DataFrame, edges: DataFrame, relationships: DataFrame | None = None) -> DataFrame:
    """Distinct (symbol_id, section, name) of the wanted symbols (symbol_id): SECTIONS, same_file_callers (callers whose name's
    first symbol is in the same file), siblings (other names of the file), prop_interfaces (the file's symbols named after it
    with Props), and hooks that only the file's references (file_id, name, kind) tell of.

    All sections that follow edges come from one pass over the edges at the wanted symbols. Symbols of one name in a file
    are one sibling, so siblings are joined by distinct names, which stay where they are if the wanted symbols are few.
    """
    own = symbols.join(wanted.select("symbol_id").distinct(), "symbol_id", "left_semi").select("symbol_id", F.col("file_id").alias("own_file"), F.col("name").alias("own_name"))
    own = materialize(own, "wanted")
    names = symbols.select(F.col("symbol_id").alias("far"), "name")
    out = []
    for outgoing in (False, True):
        near, far = ("source_symbol_id", "target_symbol_id") if outgoing else ("target_symbol_id", "source_symbol_id")
        tests = [F.when(test(), F.lit(section)) for section, (test, out_) in SECTIONS.items() if out_ == outgoing]
        rows = edges.join(own.select(F.col("symbol_id").alias(near)), near, "left_semi").select(F.col(near).alias("symbol_id"), F.col(far).alias("far"), F.explode(F.array_compact(F.array(*tests))).alias("section"))
        out.append(rows.distinct().join(names, "far").select("symbol_id", "section", "name"))
    around = reduce(DataFrame.unionByName, out).distinct()
    first = symbols.groupBy("name").agg(F.min_by("file_id", "symbol_id").alias("file_id"))
    same = around.where("section = 'callers'").join(first, "name").join(own, "symbol_id").where("file_id = own_file").select("symbol_id", F.lit("same_file_callers").alias("section"), "name")
    beside = symbols.select(F.col("file_id").alias("own_file"), "name").distinct()
    siblings = beside.join(own, "own_file").where("name <> own_name").select("symbol_id", F.lit("siblings").alias("section"), "name")
    keys = F.explode(F.array_distinct(F.array(F.lower(F.concat("own_name", F.lit("Props"))), F.concat(F.lower("own_name"), F.lit("props"))))).alias("key")
    props = beside.withColumn("key", F.lower("name")).join(own.select("symbol_id", "own_file", keys), ["own_file", "key"]).select("symbol_id", F.lit("prop_interfaces").alias("section"), "name")
    rows = around.unionByName(same)
    if relationships is not None:
        hooks = relationships.where("kind = 'consumes_hook'").select(F.col("file_id").alias("own_file"), "name")
        rows = rows.unionByName(own.join(hooks, "own_file").select("symbol_id", F.lit("consumes_hooks").alias("section"), "name")).distinct()
    return rows.unionByName(siblings).unionByName(props)


def symbol_candidates(symbols: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """(symbol_id, name, kind, path, start_line) of the symbols of exactly this name."""
    return symbols.where(F.col("name") == name).join(files, "file_id").select("symbol_id", "name", "kind", "path", "start_line")


def lookups(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query, folded_id, exact_id, exact_file_id): the lowest symbol of the name in any case, and of exactly the name with its file. Nulls where there is none."""
    exact = symbols.groupBy(F.col("name").alias("query")).agg(F.min(F.struct("symbol_id", "file_id")).alias("e"))
    folded = symbols.groupBy(F.lower("name").alias("key")).agg(F.min("symbol_id").alias("folded_id"))
    rows = queries.select("query").distinct().withColumn("key", F.lower("query")).join(exact, "query", "left").join(folded, "key", "left")
    return rows.select("query", "folded_id", F.col("e.symbol_id").alias("exact_id"), F.col("e.file_id").alias("exact_file_id"))


def in_file(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, name, symbol_id): the lowest symbol of each name in each file, for queries (file_id, name)."""
    return queries.select("file_id", "name").distinct().join(symbols.groupBy("file_id", "name").agg(F.min("symbol_id").alias("symbol_id")), ["file_id", "name"], "left")


def nodes(ids: DataFrame, symbols: DataFrame, files: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(symbol_id, node_kind, name, kind, path) of symbols by id; node_kind is Entrypoint or Symbol. Unknown ids have no row."""
    entry = features.where("is_entrypoint").select("symbol_id", F.lit(True).alias("entry")) if features is not None else symbols.limit(0).select("symbol_id", F.lit(True).alias("entry"))
    rows = symbols.join(ids.select("symbol_id").distinct(), "symbol_id", "left_semi").join(files, "file_id").join(entry, "symbol_id", "left")
    return rows.select("symbol_id", F.when(F.col("entry"), "Entrypoint").otherwise("Symbol").alias("node_kind"), "name", "kind", "path")


def targets(queries: DataFrame, symbols: DataFrame, files: DataFrame, most: int = 1_000) -> DataFrame:
    """(query, symbol_id, file_id): what a context is built for. The lowest symbol of exactly the name; where there is none the
    lowest file whose path has the text in any case (% and _ are wildcards), without a symbol; else nulls. Names that are no symbol are compared with all paths: more than `most` of them are refused (ValueError).
    """
    exact = symbols.groupBy(F.col("name").alias("query")).agg(F.min(F.struct("symbol_id", "file_id")).alias("s"))
    rows = queries.select("query").distinct().join(exact, "query", "left")
    unknown = materialize(rows.where("s is null").select("query"), "unknown")
    if unknown.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} names are no symbols")
    near = files.select("path", F.col("file_id").alias("_file")).join(F.broadcast(unknown), F.expr("path ilike concat('%', query, '%')")).groupBy("query").agg(F.min("_file").alias("f"))
    return rows.join(near, "query", "left").select("query", "s.symbol_id", F.coalesce("s.file_id", "f").alias("file_id"))


def previews(symbols: DataFrame, files: DataFrame, contents: DataFrame, name: str, context_lines: int = 0, limit: int = 5) -> DataFrame:
    """(symbol_id, path, kind, start_line, preview): the lines of each symbol of this name with some around them; contents (file_id, content). The lowest ids, `limit` of them."""
    own = symbols.where(F.col("name") == name).orderBy("symbol_id").limit(limit).join(files, "file_id").join(contents.select("file_id", "content"), "file_id", "left")
    text = F.regexp_replace(F.regexp_replace("content", "\r\n", "\n"), "\n$", "")
    lines = F.split(text, "\n")
    start = F.greatest(F.col("start_line") - context_lines, F.lit(1)).cast("int")
    end = F.least(F.coalesce("end_line", "start_line") + context_lines, F.size(lines)).cast("int")
    preview = F.when(start <= F.size(lines), F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n"))
    return own.select("symbol_id", "path", "kind", "start_line", F.coalesce(preview, F.lit("")).alias("preview"))


def text_preview(text: Column, most: int = 160) -> Column:
    """Trimmed; with more bytes than `most`, its first characters and three dots."""
    t = F.trim(text)
    return F.when(F.octet_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def call_sites(text: Column, name: str) -> Column:
    """The name is called somewhere: no letter, digit or underscore in front, then spaces and an opening bracket behind."""
    quoted = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in name)
    return text.rlike(rf"(^|[^A-Za-z0-9_]){quoted}[ \t]*\(")


def model_expansion(wanted: DataFrame, symbols: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(symbol_id, place, name): data models that a symbol's signature names, `most` at most, in order.

    Capitalised words of the signature (but the symbol's own name, Depends and Session) that are symbols come first, each
    followed by what its file inherits; then what the symbol's own file inherits or takes as props. wanted (symbol_id,
    file_id, name, signature). Names only, each once. A file's bases come one after the other in order of name, so of each
    file its first `most` are all that can be listed: those listed before are fewer, or the list is full without it.
    """
    word = F.filter(F.split("signature", r"[^\p{L}]+"), lambda w: (w != "") & (F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1)) & ~w.isin("Depends", "Session"))
    words = wanted.select("symbol_id", F.col("name").alias("own"), F.posexplode(F.array_distinct(word)).alias("at", "name")).where("name <> own")
    first = symbols.groupBy("name").agg(F.min_by("file_id", "symbol_id").alias("found_file"))
    direct = words.join(first, "name")
    target = symbols.select(F.col("symbol_id").alias("target_symbol_id"), F.col("name").alias("base"))
    bases = edges.where("kind in ('inherits', 'accepts_props')").select("source_file_id", "target_symbol_id", "kind").distinct().join(target, "target_symbol_id")
    bases = materialize(bases.select("source_file_id", "base", "kind").distinct(), "bases")
    order = W.partitionBy("source_file_id").orderBy("base")
    leading = lambda df: df.select("source_file_id", "base").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    inherited = direct.join(leading(bases.where("kind = 'inherits'")), F.col("found_file") == F.col("source_file_id")).select("symbol_id", "at", F.lit(1).alias("step"), F.col("base").alias("name"))
    own = wanted.join(leading(bases), F.col("file_id") == F.col("source_file_id")).select("symbol_id", F.lit(1 << 30).alias("at"), F.lit(2).alias("step"), F.col("base").alias("name"))
    rows = direct.select("symbol_id", "at", F.lit(0).alias("step"), "name").unionByName(inherited).unionByName(own)
    once = rows.groupBy("symbol_id", "name").agg(F.min(F.struct("at", "step")).alias("o"))
    listed = once.groupBy("symbol_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("o", "name"))), 1, most).alias("l"))
    return listed.select("symbol_id", F.posexplode("l").alias("place", "x")).select("symbol_id", "place", "x.name")


def entrypoint_list(symbols: DataFrame, files: DataFrame, classify_entrypoints, scope: str | None = None) -> DataFrame:
    """(group, path, name, kind) of entrypoints in scope: routes, pages, cli; in order of path."""
    rows = classify_entrypoints(symbols, files.where(in_scope(F.col("path"), scope)))
    group = F.when(F.col("class") == "Route", "routes").when(F.col("class") == "Page", "pages").otherwise("cli")
    return rows.select(group.alias("group"), "path", "name", "kind").orderBy("group", "path", "name")

"""Operator 1: benchmark decontamination, DataFrame functions only.

The words of each document are hashed once and each window's hash is made of its word hashes. A hash set of the
benchmark's windows, a table of bits of bounded size, goes to every task, and each window is looked up in the row itself.
Only windows that it knows leave the row: their words meet the benchmark's windows in a join, which verifies them. One
plan serves benchmarks of any size; a fuller table lets more windows through to the join, never a wrong one past it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import materialize, text_hashes, word_array

WINDOW = 10
#: Bits of the hash set for each window, and the least and most bits (as powers of two; the most are 16 MB).
BITS_PER_WINDOW, LEAST_BITS, MOST_BITS = 16, 16, 27

_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ANY_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPAN = "array<struct<at:int,len:int>>"


def _window_hash(hashes: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(length)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """len, phrase, h, items: the distinct windows, and the items (as strings, sorted, without nulls) that have each. An item of fewer words than the window is one window; one without words has none."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), word_array(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    phrases = items.select("item_id", length.alias("len"), F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("p"))
    phrases = phrases.groupBy("len", "p").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    words = F.transform("p", lambda w: F.xxhash64(w))
    h = F.lit(None).cast("long")
    for n in range(1, window + 1):
        h = F.when(F.col("len") == n, _window_hash(words, F.lit(0), n)).otherwise(h)
    return phrases.select("len", F.array_join("p", " ").alias("phrase"), h.alias("h"), "items")


def _table_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (BITS_PER_WINDOW * n - 1).bit_length()))


def hash_set(windows: DataFrame, bits: int) -> DataFrame:
    """One row, one column: an array of longs with 2**bits bits in all, those of the windows' hashes set (see _known)."""
    spark = windows.sparkSession
    word = F.shiftrightunsigned("h", 70 - bits)
    ones = windows.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))).alias("ones"))
    every = spark.range(1 << (bits - 6)).withColumnRenamed("id", "word").join(ones, "word", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("ones", F.lit(0).cast("long")).alias("ones")))), lambda x: x["ones"]).alias("bits"))


def _known(h: Column, table: Column, bits: int) -> Column:
    """Whether the hash set has h: its upper bits pick the long, its lower six the bit."""
    own = F.get(table, F.shiftrightunsigned(h, 70 - bits).cast("int"))
    return F.call_function("shiftrightunsigned", own, h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _candidates(words: Column, hashes: Column, tables: dict[int, Column], bits: int) -> Column:
    """[(at, len, phrase)] of the windows that the hash set knows."""

    def of(length: int, table: Column) -> Column:
        starts = F.when(F.size(hashes) >= length, F.sequence(F.lit(0), F.size(hashes) - length)).otherwise(F.array().cast("array<int>"))
        found = F.transform(F.transform(starts, lambda i: _window_hash(hashes, i, length)), lambda h, i: F.when(_known(h, table, bits), i))
        return F.transform(F.filter(found, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), F.array_join(F.slice(words, i + 1, length), " ").alias("phrase")))

    if not tables:
        return F.array().cast("array<struct<at:int,len:int,phrase:string>>")
    return F.concat(*[of(n, t) for n, t in tables.items()])


def scan(rows: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """rows without their text, with n_words and places: (at, len, phrase) of windows that the hash set of `windows` knows.

    Reads the text once, shuffles nothing. The words, and then their hashes, are bound to variables of one exploded
    array of one, so that each is evaluated once.
    """
    bits = _table_bits(windows.count())
    lengths = [r.len for r in windows.select("len").distinct().orderBy("len").collect()]  # at most `window` of them
    names = {n: f"_set{n}" for n in lengths}
    table = hash_set(windows, bits)
    rows = rows.withColumns({c: table.scalar() for c in names.values()})  # one subquery; each column is used once, so the optimizer puts it in place
    tables = {n: F.col(c) for n, c in names.items()}
    found = F.transform(
        F.array(word_array(F.col(text))),
        lambda w: F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), lambda h: F.struct(F.size(w).cast("long").alias("n_words"), _candidates(w, h, tables, bits).alias("places")))[0],
    )
    return rows.select(*[c for c in rows.columns if c != text and c not in names.values()], F.explode(found).alias("_m")).select("*", "_m.*").drop("_m")


def verified(candidates: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spans, items) of the rows with a place whose words are a window's: its places (at, len), in order, and the windows' items, sorted.

    Spark picks how the two meet by the size of `windows`, a written table; phrases that a great many documents share are
    split by its skew join where they are shuffled.
    """
    places = candidates.select(*keys, F.explode("places").alias("x")).select(*keys, "x.*")
    hits = places.join(windows.select("phrase", "items"), "phrase")
    spans = F.array_sort(F.collect_set(F.struct("at", "len"))).alias("spans")
    return hits.groupBy(*keys).agg(spans, F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def covered(spans: Column) -> Column:
    """How many words the spans (in order) cover."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["at"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(s["at"], acc["end"]))).alias("n"))

    return F.aggregate(spans, zero, step)["n"].cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts: no words, not contaminated. Repeated rows and null ids each give a row of their own. An empty
    benchmark, or one of texts without words, hits nothing. Other columns of docs, whatever their names, are ignored.
    """
    windows = materialize(benchmark_windows(benchmark, window), "windows")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(scan(rows, windows, "text").withColumn("_id", F.monotonically_increasing_id()), "scanned")
    some = rows.where(F.size("places") > 0)
    found = some.select("_id", "doc_id", "n_words").join(verified(some, windows, ["_id"]), "_id", "left")
    none = rows.where(F.size("places") == 0).select("_id", "doc_id", "n_words", F.lit(None).cast(_SPAN).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    out = found.unionByName(none).withColumns({"spans": F.coalesce("spans", F.array().cast(_SPAN)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(
        "doc_id",
        "n_words",
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and what separates each from the word before."""

    def rebuilt(x: Column) -> Column:
        keep = F.filter(F.sequence(F.lit(0), F.size(x["words"])), lambda i: ~F.exists(x["spans"], lambda s: (i >= s["at"]) & (i < s["at"] + s["len"])))
        return F.array_join(F.transform(keep, lambda i: F.concat(F.get(x["gaps"], i), F.coalesce(F.get(x["words"], i), F.lit("")))), "")

    parts = F.struct(F.array_remove(F.split(text, _ANY_SEP), "").alias("words"), F.split(text, _ANY_WORD).alias("gaps"), spans.alias("spans"))
    return F.get(F.transform(F.array(parts), rebuilt), F.lit(0))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", drop_share: float = 0.5, window: int = WINDOW) -> DataFrame:
    """docs without benchmark passages: spans are cut out; documents of which drop_share of the words or more are hit go. Columns and clean rows stay as they are.

    What is to be cut depends on a text alone, so it is found once for each text that has candidates (told by 128 bits of
    hashes) and joined to the rows of docs by these; rows, texts and other columns aren't written in between.
    """
    windows = materialize(benchmark_windows(benchmark, window), "windows")
    keys = ["_k1", "_k2"]
    own = dict(zip(keys, text_hashes(F.col(text_col))))
    found = scan(docs.select(*[h.alias(k) for k, h in own.items()], F.col(text_col).alias("text")), windows, "text")
    found = materialize(found.where(F.size("places") > 0).dropDuplicates(keys), "scanned")
    spans = found.select(*keys, "n_words").join(verified(found, windows, keys).drop("items"), keys)
    go = covered(F.col("spans")) >= F.greatest(F.lit(1), F.ceil(F.lit(drop_share) * F.col("n_words")))
    spans = materialize(spans.select(*[F.col(k).alias(f"{k}s") for k in keys], F.col("spans").alias("_spans"), go.alias("_go")), "spans")
    rows = docs.select(F.struct("*").alias("_row")).select("_row", *[h.alias(k) for k, h in zip(keys, text_hashes(F.col("_row")[text_col]))])
    rows = rows.join(spans, [F.col(k) == F.col(f"{k}s") for k in keys], "left").where("_go is null or not _go")
    text = F.col("_row")[text_col]
    cleaned = F.when(F.col("_spans").isNotNull(), without_spans(text, F.col("_spans"))).otherwise(text)
    return rows.select(*[cleaned.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def oracle_sql(window: int = WINDOW) -> str:
    """contamination in DuckDB's SQL."""
    words = lambda text: f"regexp_extract_all(translate(COALESCE({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words('text')} AS w FROM documents), b AS (SELECT item_id, {words('text')} AS w, least(len(w), {window}) AS n FROM benchmark),
win AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS p FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b WHERE n > 0)),
seen AS (SELECT rid, i, n, w[i:i + n - 1] AS p FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item_id FROM seen JOIN win USING (p, n)),
cov AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hit) GROUP BY 1),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(s, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)"""

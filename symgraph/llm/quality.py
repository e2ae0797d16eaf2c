"""Operator 9: quality rules with cross-document line frequency.

Each document is read once: its rule counts, and for each distinct normalised line a hash with the number of words it
stands for. Lines are counted per host (documents that have them); lines in more documents than the limit are removed,
and a document of which too little is left is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import LOWER_TABLE, ascii_lower, byte_texts, materialize, slices

#: A line of a host is removed if more of its documents have it than this, however many documents the host has.
LINE_DOCS = 20
#: A document is rejected if less than this share of its words is left.
LEAST_LEFT = 0.3
MIN_WORDS = 50
REPEAT_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"
_NO_WORD = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))  # white space, and what continues a code point


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of `width` words that the text has twice or more, first ones included."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    total, end = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + width - max(i, end)
            end = i + width
    return total


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), len(text.translate(None, _NO_WORD)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def line_weights(text: bytes) -> dict[int, int]:
    """Hash of each distinct normalised line (A-Z lower-cased, white space collapsed) -> words in all its places."""
    from xxhash import xxh64_intdigest

    out: dict[int, int] = {}
    for line in text.translate(LOWER_TABLE).split(b"\n"):
        if words := line.split():
            h = xxh64_intdigest(b" ".join(words), 42)
            h -= (h >> 63) << 64
            out[h] = out.get(h, 0) + len(words)
    return out


_ROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("host", pa.string()), ("lines", pa.list_(pa.int64())), ("weights", pa.list_(pa.int32()))])


def document_rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                lines = line_weights(text)
                out.append((doc_id, *text_counts(text), list(lines), list(lines.values())))
            *counts, lines, weights = (pa.array(c, t) for c, t in zip(zip(*out), [*[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.int32())]))
            yield pa.RecordBatch.from_arrays([*counts, batch.column(2), lines, weights], schema=_ROW)

    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, host string, lines array<long>, weights array<int>")


def frequent_lines(lines: DataFrame, hosts: DataFrame, line_docs: int = LINE_DOCS, line_share: float = 0.0) -> DataFrame:
    """(host, line) above the limit; `lines` has one row for each document and distinct line, `hosts` (host, docs). A line_share also asks for that share of the host's documents, a limit that grows with the host."""
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > line_docs)
    if not line_share:
        return counted.select("host", "line")
    return counted.join(hosts, "host").where(F.col("n") > F.col("docs") * line_share).select("host", "line")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = 0.0, least_left: float = LEAST_LEFT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words.

    Null and blank texts have no words and fail. A null host is one host of its own (""). Each row is a document, so a
    repeated row counts twice. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    rows = materialize(document_rows(docs, id_col, text_col, host_col).withColumn("_id", F.monotonically_increasing_id()), "quality")
    lines = rows.select("_id", "host", F.explode(F.arrays_zip("lines", "weights")).alias("x")).select("_id", "host", F.col("x.lines").alias("line"), F.col("x.weights").alias("words"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"))
    frequent = materialize(frequent_lines(lines.select("host", "line"), hosts, line_docs, line_share), "frequent")
    removed = lines.join(frequent, ["host", "line"]).groupBy("_id").agg(F.sum("words").alias("n_removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = rows.drop("lines", "weights", "host").join(removed, "_id", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("n_removed_words") >= least_left * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & left).alias("kept"), "n_removed_words")


def remove_frequent_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = 0.0) -> DataFrame:
    """docs with the lines above the limit taken out of their texts; texts without such lines, null ones too, stay as they are."""
    rows = materialize(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_id")), "rows")
    host = F.coalesce(F.col(f"_row.{host_col}").cast("string"), F.lit(""))
    lines = rows.select("_id", host.alias("host"), F.posexplode(F.split(f"_row.{text_col}", "\n")).alias("at", "text"))
    words = F.array_remove(F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+"), "")
    lines = lines.withColumn("line", F.when(F.size(words) > 0, F.xxhash64(F.array_join(words, " "))))  # the hash of line_weights
    once = lines.where("line is not null").select("_id", "host", "line").distinct()
    frequent = materialize(frequent_lines(once, rows.groupBy(host.alias("host")).agg(F.count("*").alias("docs")), line_docs, line_share), "frequent")
    touched = lines.select("_id", "host", "line").join(frequent, ["host", "line"]).select("_id").distinct()
    left = lines.join(touched, "_id").join(frequent, ["host", "line"], "left_anti")
    texts = touched.join(left.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("own")), "_id", "left")
    texts = texts.select("_id", F.coalesce(F.array_join("own.text", "\n"), F.lit("")).alias("_text"))
    new = F.coalesce("_text", f"_row.{text_col}")
    return rows.join(texts, "_id", "left").select(*[new.alias(c) if c == text_col else F.col(f"_row.{c}").alias(c) for c in docs.columns])


def oracle_sql(line_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> str:
    """quality in DuckDB's SQL; lines meet as texts, not as hashes."""
    words = lambda text: f"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, COALESCE(source, '') AS host, COALESCE(text, '') AS t, {words("COALESCE(text, '')")} AS w,
  list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT rid, i, w[i:i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS k FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1) GROUP BY 1),
lines AS (SELECT rid, host, line, CAST(sum(n) AS BIGINT) AS n FROM (SELECT rid, host, array_to_string({words(low('x'))}, ' ') AS line, len({words('x')}) AS n FROM (SELECT rid, host, unnest(ls) AS x FROM d)) GROUP BY 1, 2, 3),
often AS (SELECT host, line FROM lines GROUP BY 1, 2 HAVING count(*) > {line_docs}),
gone AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n FROM lines JOIN often USING (host, line) GROUP BY 1),
c AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, COALESCE(rep.n, 0) AS n_repeat_words, COALESCE(gone.n, 0) AS n_removed_words FROM d LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_removed_words >= CAST({least_left} AS DOUBLE) * n_words AS kept, n_removed_words FROM f"""

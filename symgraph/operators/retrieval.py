"""Sources of symbols: slices, cards, skeletons, and texts that are equal but for names and literals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BODY_BYTES, COMMENT_LINES = 1600, 12


def symbol_sources(symbols: DataFrame, files: DataFrame, current: DataFrame) -> DataFrame:
    """(symbol_id, status, source): the text of each symbol. symbols with bytes and lines, files (file_id, content_hash), current
    (file_id, content) as it is now.

    A file that has changed since it was indexed gives no source (status stale), a file that is gone none either (missing).
    Where the bytes lie outside the text the lines are taken (status lines); else status is bytes.
    """
    now = current.select("file_id", "content", F.sha2(F.col("content").cast("binary"), 256).alias("now"))
    rows = symbols.join(files.select("file_id", "content_hash"), "file_id").join(now, "file_id", "left")
    data = F.col("content").cast("binary")
    fits = F.coalesce((F.col("start_byte") >= 0) & (F.col("end_byte") >= F.col("start_byte")) & (F.col("end_byte") <= F.octet_length("content")), F.lit(False))
    lines = F.array_join(F.slice(F.split("content", "\n"), F.greatest("start_line", F.lit(1)).cast("int"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)).cast("int")), "\n")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("content_hash").isNotNull() & (F.col("content_hash") != F.col("now")), "stale").when(fits, "bytes").otherwise("lines")
    piece = F.substring(data, (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int")).cast("string")
    return rows.select("symbol_id", status.alias("status"), F.when(status == "bytes", piece).when(status == "lines", lines).alias("source"))


def leading_comment(head: Column, most: int = COMMENT_LINES) -> Column:
    """Comment lines right above where a text stops, trimmed, `most` at most; decorators below them are passed over. Null if there are none.

    The last line, on which the symbol itself begins, isn't looked at.
    """
    lines = F.split(head, "\n")
    above = F.reverse(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))))
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        t = F.trim(line)
        comment = t.rlike(r"^(//|#|\*|/\*|--)")
        mark = t.rlike(r"^(@|#\[)")
        take, skip = ~s["done"] & comment & (F.size(s["out"]) < most), ~s["done"] & ~comment & mark & (F.size(s["out"]) == 0)
        return F.struct((s["done"] | ~(take | skip)).alias("done"), F.when(take, F.concat(s["out"], F.array(t))).otherwise(s["out"]).alias("out"))

    found = F.aggregate(above, start, step)["out"]
    return F.when(F.size(found) > 0, F.array_join(F.reverse(found), "\n"))


def cards(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, card, body_hash): the text of each symbol that is embedded. files (file_id, path, content).

    Path, kind and name, signature (if it says more than the name), the comment above, and the first 1600 bytes of the
    body; bytes outside the text are cut to it, a character that is cut is left out.
    """
    rows = symbols.join(files.select("file_id", "path", "content"), "file_id")
    data, size = F.col("content").cast("binary"), F.octet_length("content")
    start = F.least(F.greatest("start_byte", F.lit(0)), size).cast("int")
    end = F.greatest(F.least(F.col("end_byte"), size), start).cast("int")
    whole = lambda b: F.regexp_replace(F.decode(b, "UTF-8"), "�+$", "")  # noqa: E731  a cut character at the end
    body = whole(F.substring(data, start + 1, F.least(end - start, F.lit(BODY_BYTES))))
    head = whole(F.substring(data, F.lit(1), start))
    signature = F.col("signature") if "signature" in symbols.columns else F.lit(None).cast("string")
    says = F.when((signature != "") & (signature != F.col("name")), F.concat(signature, F.lit("\n"))).otherwise("")
    comment = leading_comment(head)
    card = F.concat(F.regexp_replace("path", r"^(\./)+", ""), F.lit("\n"), "kind", F.lit(" "), "name", F.lit("\n"), F.coalesce(says, F.lit("")), F.coalesce(F.concat(comment, F.lit("\n")), F.lit("")), body)
    return rows.select("symbol_id", card.alias("card")).withColumn("body_hash", F.sha2("card", 256))


def skeleton(content: bytes, path: str, symbols: list[tuple[int, int, str, str | None, str]], target: tuple[int, int] | None = None) -> str:
    """A text with the bodies of its symbols (start, end, name, signature, kind) left out; variables, and what holds the target's bytes, stay."""
    out, at = [], 0
    cut = (":\n    ... ", "\n    ... ") if path.endswith(".py") else (" { ... }", " { ... }")
    for start, end, name, signature, kind in sorted(symbols, key=lambda s: (s[0], -s[1])):
        if start < at or not 0 <= start <= end <= len(content) or (target and start <= target[0] and end >= target[1]):
            continue
        out.append(content[at:start])
        if kind == "variable":
            out.append(content[start:end])
        else:
            shown = signature or name
            out.append((shown + cut[path.endswith(".py") and shown.rstrip().endswith(":")]).encode())
        at = end
    return b"".join([*out, content[at:]]).decode("utf-8", "replace")


def skeletons(files: DataFrame, symbols: DataFrame, target: str | None = None) -> DataFrame:
    """(file_id, path, skeleton) of files (file_id, path, content). With a target name only files that have it, their first symbol of that name in full."""
    signature = F.col("signature") if "signature" in symbols.columns else F.lit(None).cast("string")
    own = symbols.select("file_id", F.struct(F.col("start_byte").cast("long").alias("start"), F.col("end_byte").cast("long").alias("end"), "name", signature.alias("signature"), "kind", "symbol_id").alias("s")).groupBy("file_id").agg(F.collect_list("s").alias("symbols"))  # a file's symbols
    rows = files.select("file_id", "path", "content").join(own, "file_id", "inner" if target else "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = sorted(r["symbols"] or [], key=lambda s: s["symbol_id"])
                wanted = next(((s["start"], s["end"]) for s in found if s["name"] == target), None) if target else None
                if target and not wanted:
                    continue
                out.append((r["file_id"], r["path"], skeleton((r["content"] or "").encode(), r["path"] or "", [(s["start"], s["end"], s["name"], s["signature"], s["kind"]) for s in found], wanted)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["file_id", "path", "skeleton"])

    return rows.mapInArrow(run, "file_id long, path string, skeleton string")


#: Tokens of a source, whatever its language: comments, strings, numbers, names, marks.
TOKEN = r"(?s)/\*.*?\*/|//[^\n]*|#[^\n]*|\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|[0-9][0-9A-Za-z_.]*|[\p{L}_][\p{L}\p{N}_]*|\S"
#: Words that are structure, not names, in the languages that are indexed.
KEYWORDS = "if else elif for while return def class function const let var fn struct enum impl trait match async await try except catch finally import from export new in of not and or pub mut use".split()


def structure(text: Column) -> Column:
    """A source's tokens without comments, with one word for every string, every number and every name. Keywords and marks stay."""

    def form(t: Column) -> Column:
        string = t.rlike("^[\"'`].") & (F.length(t) > 1)
        return F.when(string, "#STR").when(t.rlike("^[0-9]"), "#NUM").when(t.isin(KEYWORDS), t).when(t.rlike(r"^[\p{L}_]"), "#ID").otherwise(t)

    tokens = F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^(/\*.|//|#)"))
    return F.array_join(F.transform(tokens, form), " ")


def structural_duplicates(sources: DataFrame, least: int = 15) -> DataFrame:
    """(first_id, n, length) of groups of sources (symbol_id, source) with one structure of `least` words or more, in two places or more; longest first. Sources that name a logger are left out."""
    rows = sources.where(~F.lower("source").contains("logger")).select("symbol_id", structure(F.col("source")).alias("form"))
    rows = rows.withColumn("length", F.size(F.split("form", " "))).where(F.col("length") >= least)
    groups = rows.groupBy(F.sha2("form", 256).alias("hash"), "form").agg(F.min("symbol_id").alias("first_id"), F.count("*").alias("n"), F.first("length").cast("long").alias("length"))
    return groups.where("n > 1").select("first_id", "n", "length").orderBy(F.desc("length"), "first_id")

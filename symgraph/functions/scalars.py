"""Column functions that several operators share."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from symgraph.functions import vocabulary as v


def in_scope(path: Column, scope: str | None) -> Column:
    """Case-sensitive substring with slashes made equal; no pattern characters."""
    return F.lit(True) if not scope else F.replace(path, F.lit("\\"), F.lit("/")).contains(scope.replace("\\", "/"))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file's name without its last extension; a name that begins with a dot keeps it."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def collapsed(path: Column) -> Column:
    """A path without . parts and with each .. taken together with the part before it, as far as there is one."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        can = (F.size(s) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), s), -1) != "..")
        return F.when((x == "..") & can, F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).when((x == "..") & rooted & (F.size(s) == 0), s).otherwise(F.concat(s, F.array(x)))

    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.aggregate(parts, none, step), "/"))


def scope_path(path: Column, root: str = "") -> Column:
    """A path as scopes are written: slashes made equal, without the project's root, leading slashes and ./, and trailing slashes."""
    slashed = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    root = root.replace("\\", "/")
    if root:
        slashed = F.when(slashed.startswith(root), F.substr(slashed, F.lit(len(root) + 1))).otherwise(slashed)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(slashed, "^/+", ""), r"^(\./)+", ""), "/+$", "")


def absolute_path(root: str, path: Column) -> Column:
    """Stored paths below the project's root; absolute ones stay."""
    return F.when(path.startswith("/"), collapsed(path)).otherwise(collapsed(F.concat(F.lit(root.rstrip("/") + "/"), path)))


def vector_of(blob: Column) -> Column:
    """Little-endian 32-bit floats packed in a blob, as an array; bytes beyond the last whole one are dropped. For imports of old indexes only."""

    @F.arrow_udf("array<float>")
    def unpack(x: pa.Array) -> pa.Array:
        return pa.array([None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4") for b in x.to_pylist()], pa.list_(pa.float32()))

    return unpack(blob)


def blob_of(vector: Column) -> Column:
    """The inverse of vector_of."""

    @F.arrow_udf("binary")
    def pack(x: pa.Array) -> pa.Array:
        return pa.array([None if a is None else np.asarray(a, "<f4").tobytes() for a in x.to_pylist()], pa.binary())

    return pack(vector)


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths, empty vectors and zero norms; in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def token_estimate(text: Column) -> Column:
    """Mean of a quarter of the characters and four thirds of the words, rounded; 0 for an empty text."""
    words = F.greatest(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(1))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.round((F.length(text) / 4 + words / 0.75) / 2)).cast("long")


def cost_cents(tokens: Column, model: Column) -> Column:
    name = F.lower(model)
    rate = reduce(lambda out, kv: F.when(name.contains(kv[0]), kv[1]).otherwise(out), reversed(v.MODEL_CENTS), F.lit(v.DEFAULT_CENTS))
    return tokens / 1_000_000.0 * rate


def query_tokens(query: str) -> list[str]:
    """Distinct alphanumeric runs of the lower-cased query, sorted, without stop words."""
    runs = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    return sorted(set(runs) - set(v.STOP_WORDS))


def token_weight(token: str) -> int:
    return 300 if token in v.HIGH_VALUE_TOKENS else 100


def whole_word(text: Column, word: str) -> Column:
    """The lower-cased word stands alone: no ASCII letter, digit or underscore beside it."""
    quoted = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in word.lower())
    return F.lower(text).rlike(f"(^|[^A-Za-z0-9_]){quoted}([^A-Za-z0-9_]|$)")


def call_literals(text: Column) -> Column:
    """String arguments of fetch, post, get, put and delete calls, two characters or more."""
    found = F.regexp_extract_all(text, F.lit(r"""(?:fetch|post|get|put|delete)\(\s*["'`]([^"'`]+)["'`]"""), F.lit(1))
    return F.filter(found, lambda x: F.length(x) >= 2)


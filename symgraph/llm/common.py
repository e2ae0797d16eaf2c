"""What the training-data operators share: intermediate tables, words, row packing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.tables import materialize, release  # noqa: F401  the one way to write intermediate tables

#: Anything but 0-9, a-z and code points from U+0080 separates words (after A-Z are lower-cased).
WORD_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table: A-Z to lower case, separators of WORD_SEP to spaces. UTF-8 bytes from 0x80 stay.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: bytes.translate table: A-Z to lower case only.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() is taken where it can't touch any other character; translate(), which is slower, elsewhere."""
    cased = text.rlike(r"[^\x00-\x7F\p{Ll}\p{Lo}\p{M}\p{P}\p{Z}\p{Sc}\p{Sm}\p{Sk}\p{Nd}]")
    return F.when(cased, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def word_array(text: Column) -> Column:
    """Words of WORD_SEP of the lower-cased text; null and blank texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_SEP), "")


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two hashes, 128 bits together, that tell texts apart; a null text has some too."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8 bytes (null: empty), straight from the Arrow buffers."""
    return (x or b"" for x in column.cast(pa.binary()).to_pylist())


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each slice has about `most` bytes of text, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to

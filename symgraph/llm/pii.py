"""Operator 5: format-preserving pseudonyms from a keyed Feistel network.

Validated values (card numbers by check digit, IBANs by check sum, phone and social security numbers by form, IPv4
addresses by octets, dates by the calendar, the local part of e-mail addresses) are permuted within their own format.
The permutation depends on the key and the format only, so equal values stay equal, in whatever document they stand.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from symgraph.llm.common import slices

#: Spark setting that holds the secret of the permutation, and what stands in for it where it is unset (trials and tests).
KEY_SETTING, KEY = "spark.symgraph.pseudonym.key", b"symgraph pseudonyms"
ROUNDS = 8
FIRST_YEAR, LAST_YEAR = 1900, 2099


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """Keyed permutation of 0..size-1: a balanced Feistel network over the next even number of bits, walked until it falls inside."""
    return _walk(value, size, key, tweak, range(ROUNDS))


def unpermute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """The inverse of permute: the same network with its halves and rounds turned round."""
    half = _half(size)
    swap = lambda x: (x & (1 << half) - 1) << half | x >> half
    return swap(_walk(swap(value), size, key, tweak, range(ROUNDS - 1, -1, -1), swap))


def _half(size: int) -> int:
    return max(1, ((size - 1).bit_length() + 1) // 2)


def _walk(value: int, size: int, key: bytes, tweak: bytes, rounds: range, plain: Callable[[int], int] = int) -> int:
    half = _half(size)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for n in rounds:
            f = int.from_bytes(hashlib.blake2b(right.to_bytes(width, "big"), key=key[:64], salt=bytes([n]), person=tweak[:16], digest_size=min(64, max(8, width))).digest(), "big")
            left, right = right, left ^ (f & mask)
        value = left << half | right
        if plain(value) < size:
            return value


def other(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A permutation without fixed points (size > 1): the Feistel order, moved on by one along itself."""
    if size == 1:
        return value
    return permute((unpermute(value, size, key, tweak) + 1) % size, size, key, tweak)


def luhn(digits: str) -> int:
    """Sum of the check-digit rule; a valid number's is divisible by ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total


def _spread(text: str, digits: str) -> str:
    """text with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn(d) % 10 or len(set(d)) == 1:
        return None
    body = str(other(int(d[:-1]), 10 ** (len(d) - 1), key, b"card%d" % len(d))).zfill(len(d) - 1)
    return _spread(text, body + str(-luhn(body + "0") % 10))


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    country, body = plain[:2], _classes(plain[4:], key, b"iban" + plain[:2].encode())
    out = iter(country + f"{98 - number(body + country + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(out) for c in text)


#: Characters that are permuted as one value.
PIECE = 48


def _classes(text: str, key: bytes, tweak: bytes) -> str:
    """Permutes a string within its pattern of digits, small and capital letters (ASCII); other characters stay. Long strings are permuted piece by piece."""
    if len(text) > PIECE:
        return "".join(_classes(text[at : at + PIECE], key, tweak + b"%d" % (at // PIECE)) for at in range(0, len(text), PIECE))
    sizes = [10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 1 for c in text]
    value, size = 0, 1
    for c, n in zip(text, sizes):
        value, size = value * n + (0 if n == 1 else int(c) if n == 10 else ord(c.lower()) - 97), size * n
    if size == 1:
        return text
    value = other(value, size, key, hashlib.blake2b(tweak + b"|" + bytes(sizes), digest_size=12).digest())
    out = []
    for c, n in zip(reversed(text), reversed(sizes)):
        value, v = divmod(value, n)
        out.append(c if n == 1 else str(v) if n == 10 else chr((97 if c.islower() else 65) + v))
    return "".join(reversed(out))


def _phone(text: str, key: bytes) -> str | None:
    """The country code stays."""
    lead = re.match(r"\+\d{1,3}(?=\D)", text)
    at = lead.end() if lead else 0
    d = _digits(text[at:])
    if not 7 <= len(d) <= 14:
        return None
    return text[:at] + _spread(text[at:], str(other(int(d), 10 ** len(d), key, b"phone%d" % len(d))).zfill(len(d)))


def _ssn(text: str, key: bytes) -> str | None:
    d = _digits(text)
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if not valid(d):
        return None
    while True:
        d = str(other(int(d), 10**9, key, b"ssn")).zfill(9)
        if valid(d):
            return _spread(text, d)


def _ipv4(text: str, key: bytes) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    n = other(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, b"ipv4")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _email(text: str, key: bytes) -> str | None:
    """The host stays."""
    local, _, host = text.partition("@")
    return f"{_classes(local, key, b'mail')}@{host}"


@lru_cache(maxsize=16)
def _days(month: str, day: str) -> list[int]:
    """Days (as ordinals) whose month and day are written as these are: "1" in one digit, "2" in two digits without a zero in front, "0" in two digits in any case."""
    fits = {"0": range(1, 32), "1": range(1, 10), "2": range(10, 32)}
    out = []
    for y in range(FIRST_YEAR, LAST_YEAR + 1):
        for m in fits[month]:
            if m <= 12:
                first = datetime.date(y, m, 1).toordinal() - 1
                out += [first + d for d in fits[day] if d <= calendar.monthrange(y, m)[1]]
    return sorted(out)


def _date(text: str, key: bytes) -> str | None:
    """Year first, or day or month first; kept in the order that makes it a date (day first where both would), and with as many digits in each place."""
    sep = re.search(r"\D", text)[0]
    a, b, c = text.split(sep)
    forms = [("ymd", a, b, c)] if len(a) == 4 else ([("dmy", c, b, a), ("mdy", c, a, b)] if sep != "/" else [("mdy", c, a, b), ("dmy", c, b, a)])
    for form, y, m, d in forms:
        try:
            day = datetime.date(int(y), int(m), int(d))
        except ValueError:
            continue
        if FIRST_YEAR <= day.year <= LAST_YEAR:
            widths = [len(m), len(d)]
            how = ["0" if widths == [2, 2] or x[0] == "0" else str(len(x)) for x in (m, d)]  # beside one digit, two are a number of ten or more
            days = _days(*how)
            new = datetime.date.fromordinal(days[other(bisect.bisect_left(days, day.toordinal()), len(days), key, b"date" + "".join(how).encode())])
            parts = {"y": f"{new.year:04d}", "m": f"{new.month:0{widths[0]}d}", "d": f"{new.day:0{widths[1]}d}"}
            return sep.join(parts[x] for x in form)
    return None


#: Every value has one of these: texts without them aren't scanned.
LOOKS = "[0-9]|@"
#: More characters than any value has whose check can fail (all but e-mail addresses).
MOST = 48
#: What is looked for, in this order: a pattern, what may not follow it, its check. Case-sensitive, ASCII digits.
KINDS = {
    "email": (r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"", _email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?", r"(?![A-Za-z0-9])", _iban),
    "date": (r"(?<![0-9./-])(?:[0-9]{4}(?P<s>[-/.])[0-9]{1,2}(?P=s)[0-9]{1,2}|[0-9]{1,2}(?P<t>[-/.])[0-9]{1,2}(?P=t)[0-9]{4})", r"(?![0-9]|[./-][0-9])", _date),
    "ipv4": (r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}", r"(?![0-9]|\.[0-9])", _ipv4),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?![0-9]|-[0-9])", _ssn),
    "card": (r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}", r"(?![0-9]|-[0-9])", _card),
    "phone": (r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})", r"(?![0-9]|-[0-9])", _phone),
}


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, dict[str, tuple[re.Pattern, re.Pattern, re.Pattern]]]:
    """All kinds at once; each kind's own pattern, without and with what may not follow it."""
    every = "|".join(f"(?P<{name}>{pattern}{after})" for name, (pattern, after, _) in KINDS.items())
    return re.compile(every), {name: (re.compile(pattern), re.compile(pattern + after), re.compile(after)) for name, (pattern, after, _) in KINDS.items()}


def _valid_at(text: str, start: int, key: bytes) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the first kind with a value there that passes its check: the pattern's own match, or else the longest such value."""
    for kind, (pattern, bounded, after) in _patterns()[1].items():
        if not (m := bounded.match(text, start)):
            continue
        check = KINDS[kind][2]
        if (new := check(m[0], key)) is not None:
            return kind, m.end(), new
        for end in range(min(len(text), start + MOST), start, -1):
            if after.match(text, end) and pattern.fullmatch(text, start, end) and (new := check(text[start:end], key)) is not None:
                return kind, end, new
    return None


def pseudonymize_text(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, int]]]:
    """The text with pseudonyms, and (kind, start in the old text) of each replaced value.

    Where a match doesn't pass its check, shorter ones and other kinds are tried at its start, then later starts.
    """
    found, parts, at = [], [], 0
    pattern, pos = _patterns()[0], 0
    while m := pattern.search(text, pos):
        if not (hit := _valid_at(text, m.start(), key)):
            pos = m.start() + 1
            continue
        kind, pos, new = hit
        parts += [text[at : m.start()], new]
        found.append((kind, m.start()))
        at = pos
    return ("".join([*parts, text[at:]]) if found else text), found


def key_of(spark: SparkSession) -> bytes:
    return (spark.conf.get(KEY_SETTING, None) or KEY.decode()).encode()


def pseudonymize(docs: DataFrame, key: bytes | None = None, text_col: str = "text", keep: list[str] | None = None, count_col: str | None = None) -> DataFrame:
    """docs (or its columns `keep`) with values in text_col replaced; with count_col, also how many were.

    Null texts stay null, empty ones empty (0 values). Every other column, row, repeated rows and order stay as they are;
    an empty table stays empty. Only texts with a digit or @ are looked at closely. count_col must not be a column of the
    result (ValueError). Without a key the session's KEY_SETTING is taken.
    """
    key = key or key_of(docs.sparkSession)
    rows = docs.select(*keep) if keep else docs
    if count_col in rows.columns:
        raise ValueError(f"{count_col} is a column already")
    at = rows.columns.index(text_col)
    schema = StructType([*rows.schema.fields, *([StructField(count_col, LongType())] if count_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            column = batch.column(at)
            looks = pc.fill_null(pc.match_substring_regex(column, LOOKS), False).to_numpy(zero_copy_only=False)
            counts = [0] * len(column)
            if looks.any():
                texts = column.to_pylist()
                for i in looks.nonzero()[0]:
                    texts[i], found = pseudonymize_text(texts[i], key)
                    counts[i] = len(found)
                column = pa.array(texts, column.type)
            columns = [column if i == at else batch.column(i) for i in range(batch.num_columns)] + ([pa.array(counts, pa.int64())] if count_col else [])
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *([count_col] if count_col else [])])

    return rows.mapInArrow(run, schema)


def pseudonym_rows(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, n_values, text: the whole result of the operator over a documents table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pseudonymize(rows, key, count_col="n_values").select("doc_id", "n_values", "text")

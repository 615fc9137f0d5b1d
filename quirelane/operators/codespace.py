"""Codes of byte strings by code space ranges of one to four bytes.

A code is the longest run of bytes at a place whose every byte lies within that byte's bounds of some range. All ranges of a
font are held against all bytes of many strings at once, in Arrow batches, so strings take time in proportion to their size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

UNKNOWN = 0xFFFD
#: Bytes of strings that a task takes apart at once, in whole strings.
BYTES = 1 << 21
_PART = StructType([StructField("width", IntegerType()), StructField("byte", LongType()), StructField("lost", BooleanType())])
_COLUMNS = {n: StructField(n, ArrayType(t)) for n, t in (("codes", LongType()), ("unknown", BooleanType()), ("parts", _PART))}


def spaces(ranges: DataFrame, font: str = "font") -> DataFrame:
    """(font, spaces) of ranges (font, lo, hi), binaries of one length: each font's ranges as one text of hex digits.

    Ranges of unequal lengths, or of none or over four bytes, are left out, as are those whose bounds cross in some byte and
    so hold nothing. Fonts that aren't listed have no ranges.
    """
    width = F.octet_length("lo")
    fit = ranges.where((width == F.octet_length("hi")) & width.between(1, 4))
    crossed = F.exists(F.sequence(F.lit(0), width - 1), lambda i: F.substring(F.hex("lo"), 2 * i + 1, F.lit(2)) > F.substring(F.hex("hi"), 2 * i + 1, F.lit(2)))
    one = F.concat(F.hex("lo"), F.lit("-"), F.hex("hi"))
    return fit.where(~crossed).groupBy(font).agg(F.array_join(F.sort_array(F.collect_set(one)), ",").alias("spaces"))


def _widths(data: np.ndarray, left: np.ndarray, bounds: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Bytes of the code that would start at each byte, 0 where no range holds it; ``left`` are the bytes up to the string's end."""
    out = np.zeros(len(data), np.int64)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for lo, hi in sorted(bounds, key=lambda r: len(r[0])):
        fits = left >= len(lo)
        for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
            byte = padded[i : i + len(data)]
            fits &= (byte >= a) & (byte <= b)
        out[fits] = len(lo)
    return out


def _starts(width: np.ndarray) -> np.ndarray:
    """Where codes start, the first at 0, each where the one before ends; a run of one width is stepped through at once."""
    if not len(width) or (width == 1).all():
        return np.arange(len(width))
    begin = np.concatenate([[0], np.flatnonzero(width[1:] != width[:-1]) + 1])
    out, at = [], 0
    for end, step in zip([*begin[1:].tolist(), len(width)], width[begin].tolist(), strict=True):
        if at < end:
            out.append(np.arange(at, end, step))
            at += -(-(end - at) // step) * step
    return np.concatenate(out)


def codes_of(data: np.ndarray, ends: np.ndarray, bounds: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(width, byte, lost, ends) of the codes of strings that lie one after another in ``data``: ``ends`` are in codes then."""
    size = np.diff(ends, prepend=0)
    held = _widths(data, np.repeat(ends, size) - np.arange(len(data)), bounds)
    start = _starts(np.maximum(held, 1))
    lost, width = (held[start] == 0) & bool(bounds), np.maximum(held[start], 1)
    number = data[start].astype(np.int64)
    for i in range(1, 4):
        wide = width > i
        number[wide] = number[wide] << 8 | data[start[wide] + i]
    return width, number, lost, np.searchsorted(start, ends)


def tokenised(strings: DataFrame, ranges: DataFrame, *, font: str = "font", column: str = "bytes", give: Sequence[str] = ("codes", "unknown", "parts")) -> DataFrame:
    """``strings`` with ``codes``, big-endian numbers, and ``unknown``: for each code, whether no range holds its byte.

    Bytes that no range holds have the code U+FFFD, one by one. A font without any range takes each byte as a code. A null
    string has null codes. ``parts`` has all of each code: its width, its own number and whether it is lost. ``give`` names
    the columns that are wanted; the others aren't made.
    """
    s = strings.join(spaces(ranges, font), font, "left").select(*(F.col(f"`{c}`") for c in strings.columns), "spaces")
    schema = StructType([*strings.schema.fields, *(_COLUMNS[c] for c in give)])
    kept = strings.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
            ends, first = np.cumsum(size), 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BYTES, "right")))
                part = batch.slice(first, last - first)
                for value in part["spaces"].unique():
                    own = part.filter(pc.is_null(part["spaces"]) if value.as_py() is None else pc.fill_null(pc.equal(part["spaces"], value), False))
                    columns = _lists(own[column], _bounds(value.as_py()), give)
                    yield pa.RecordBatch.from_arrays([*(own[c] for c in kept), *columns], names=schema.names)
                first = last

    return s.mapInArrow(run, schema)


def _bounds(spaces: str | None) -> list[tuple[bytes, bytes]]:
    return [tuple(map(bytes.fromhex, r.split("-"))) for r in spaces.split(",")] if spaces else []


def _lists(strings: pa.Array, bounds: list[tuple[bytes, bytes]], give: Sequence[str]) -> list[pa.Array]:
    null = strings.is_null()
    whole = pc.fill_null(strings, b"")
    ends = np.cumsum(pc.binary_length(whole).to_numpy(zero_copy_only=False)).astype(np.int64)
    width, number, lost, ends = codes_of(np.frombuffer(b"".join(whole.to_pylist()), np.uint8), ends, bounds)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    make = {
        "codes": lambda: pa.array(np.where(lost, UNKNOWN, number)),
        "unknown": lambda: pa.array(lost),
        "parts": lambda: pa.StructArray.from_arrays([pa.array(width.astype(np.int32)), pa.array(number), pa.array(lost)], ["width", "byte", "lost"]),
    }
    return [pa.ListArray.from_arrays(offsets, make[c](), mask=null) for c in give]


def diagnostics(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, byte, offset): of each byte value that no range of a string's font holds, its first place in the string."""
    rows = tokens.select(*keys, F.posexplode("parts").alias("i", "p"))
    before = F.sum("p.width").over(Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.select(*keys, "p.byte", "p.lost", F.coalesce(before, F.lit(0)).alias("offset"))
    return placed.where("lost").groupBy(*keys, "byte").agg(F.min("offset").alias("offset"))

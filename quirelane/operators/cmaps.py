"""Character maps as tables: code spaces and code-to-text mappings of CMap programs, and strings decoded by them.

Programs are texts; their blocks and entries are taken apart by regular expressions, so a table of very many fonts is parsed
like any other column. What a string decodes to is found in its font's mappings, which are joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: What a code without a mapping becomes.
UNMAPPED = "�"
#: Codes of one range; larger ones, which no two-byte code space holds, are refused.
MOST_CODES = 65_536
_HEX = "<([^<>]*)>"


def _digits(text: Column) -> Column:
    """Hex digits of a string, with a 0 after an odd number of them."""
    clean = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    return F.when(F.char_length(clean) % 2 == 1, F.concat(clean, F.lit("0"))).otherwise(clean)


def _blocks(cmaps: DataFrame, names: str, font: str, program: str) -> DataFrame:
    """(font, block, kind, body) of the blocks between begin and end of some names, in order; comments are left out."""
    text = F.regexp_replace(F.col(program), "%[^\\r\\n]*", "")
    pattern = F.lit(f"(?s)begin({names})\\b(.*?)end\\1\\b")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("kind"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("body"))
    return cmaps.select(font, F.posexplode(pairs).alias("block", "b")).select(font, "block", "b.kind", "b.body")


def _entries(body: Column, pattern: str, groups: int) -> Column:
    return F.arrays_zip(*(F.regexp_extract_all(body, F.lit(pattern), F.lit(i + 1)).alias(f"g{i}") for i in range(groups)))


def codespaces(cmaps: DataFrame, *, font: str = "font", program: str = "cmap") -> DataFrame:
    """(font, lo, hi) of each code space range, as ``codespace.tokenised`` takes them."""
    rows = _blocks(cmaps, "codespacerange", font, program).select(font, F.explode(_entries(F.col("body"), f"{_HEX}\\s*{_HEX}", 2)).alias("e"))
    return rows.select(font, F.unhex(_digits(F.col("e.g0"))).alias("lo"), F.unhex(_digits(F.col("e.g1"))).alias("hi"))


def _text(digits: Column) -> Column:
    return F.decode(F.unhex(digits), "UTF-16BE")


def _ranges(cmaps: DataFrame, font: str, program: str) -> DataFrame:
    """(font, block, entry, lo, hi, to) of the entries of both kinds of blocks, in hex digits."""
    blocks = _blocks(cmaps, "bfchar|bfrange", font, program)
    one = blocks.where("kind = 'bfchar'").select(font, "block", F.posexplode(_entries(F.col("body"), f"{_HEX}\\s*{_HEX}", 2)).alias("entry", "e"))
    many = blocks.where("kind = 'bfrange'").select(font, "block", F.posexplode(_entries(F.col("body"), f"{_HEX}\\s*{_HEX}\\s*(<[^<>]*>|\\[[^\\]]*\\])", 3)).alias("entry", "e"))
    one = one.select(font, "block", "entry", _digits(F.col("e.g0")).alias("lo"), _digits(F.col("e.g0")).alias("hi"), F.concat(F.lit("<"), "e.g1", F.lit(">")).alias("to"))
    many = many.select(font, "block", "entry", _digits(F.col("e.g0")).alias("lo"), _digits(F.col("e.g1")).alias("hi"), F.col("e.g2").alias("to"))
    n = lambda c: F.conv(c, 16, 10).cast("long")
    return one.unionByName(many).withColumns({"width": (F.char_length("lo") / 2).cast("int"), "first": n("lo"), "last": n("hi")})


def _fits() -> Column:
    return (F.char_length("lo") == F.char_length("hi")) & F.col("width").between(1, 4) & (F.col("first") <= F.col("last")) & (F.col("last") - F.col("first") < MOST_CODES)


def mappings(cmaps: DataFrame, *, font: str = "font", program: str = "cmap") -> DataFrame:
    """(font, width, code, text): what each code of so many bytes stands for; of two entries for one code the later counts.

    A range gives its first text to its first code, and to each further one the text whose last character is one higher;
    with a list, each code takes its own. Entries whose codes differ in length or order, of over four bytes or over
    ``MOST_CODES`` codes, and codes beyond the end of a list are left out; ``problems`` names them.
    """
    rows = _ranges(cmaps, font, program).where(_fits()).withColumn("code", F.explode(F.sequence("first", "last")))
    at = (F.col("code") - F.col("first")).cast("int")
    listed = F.regexp_extract_all("to", F.lit(_HEX), F.lit(1))
    base = _text(_digits(F.col("to")))
    last = F.ascii(F.right(base, F.lit(1)))
    point = last + at
    higher = F.when(point.between(0xD800, 0xDFFF) | (point > 0x10FFFF), UNMAPPED).otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    stepped = F.when((at == 0) | (F.char_length(base) == 0), base).otherwise(F.concat(F.left(base, F.char_length(base) - 1), higher))
    text = F.when(F.col("to").startswith("["), _text(_digits(F.get(listed, at)))).otherwise(stepped)
    placed = rows.select(font, "width", "code", text.alias("text"), F.struct("block", "entry").alias("place")).where("text IS NOT NULL")
    return placed.groupBy(font, "width", "code").agg(F.max_by("text", "place").alias("text"))


def problems(cmaps: DataFrame, *, font: str = "font", program: str = "cmap") -> DataFrame:
    """(font, lo, hi, problem) of the entries that ``mappings`` leaves out in whole or in part: ``range``, ``size`` or ``list``."""
    rows = _ranges(cmaps, font, program)
    n = F.size(F.regexp_extract_all("to", F.lit(_HEX), F.lit(1)))
    short = _fits() & F.col("to").startswith("[") & (n != F.col("last") - F.col("first") + 1)
    wide = (F.char_length("lo") == F.char_length("hi")) & (F.col("last") - F.col("first") >= MOST_CODES)
    return rows.withColumn("problem", F.when(wide, "size").when(~_fits(), "range").when(short, "list")).where("problem IS NOT NULL").select(font, "lo", "hi", "problem")


#: Entries of all fonts' mappings up to which they are sent to all tasks; a task gets those of its strings' fonts otherwise.
BROADCAST = 100_000


def decoded(tokens: DataFrame, maps: DataFrame, *keys: str, font: str = "font") -> DataFrame:
    """(keys, text, unmapped) of strings that ``codespace.tokenised`` has taken apart; ``unmapped`` counts codes without a text.

    A font's mappings meet its strings as one list, sorted by code, in which all codes of many strings are looked up at once,
    so a code is never a row of its own.
    """
    packed = F.shiftleft(F.col("width").cast("long"), 32) + F.col("code")
    entries = maps.where("text IS NOT NULL").select(font, F.struct(packed.alias("unit"), "text").alias("e")).groupBy(font).agg(F.sort_array(F.collect_list("e")).alias("__e"))
    few = maps.limit(BROADCAST + 1).count() <= BROADCAST
    each = lambda name: F.transform("__e", lambda e: e[name]).alias(f"__{name}")
    listed = entries.select(font, each("unit"), each("text"))
    s = tokens.select(*keys, font, "parts").join(F.broadcast(listed) if few else listed, font, "left").select(*keys, font, "parts", "__unit", "__text")
    schema = StructType([*(tokens.schema[k] for k in keys), StructField("text", StringType()), StructField("unmapped", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch[font].unique():
                own = batch.filter(pc.is_null(batch[font]) if name.as_py() is None else pc.fill_null(pc.equal(batch[font], name), False))
                yield pa.RecordBatch.from_arrays([*(own[k] for k in keys), *_texts(own["parts"], own["__unit"][0], own["__text"][0])], names=schema.names)

    return s.mapInArrow(run, schema)


def _texts(parts: pa.ListArray, units: pa.ListScalar, texts: pa.ListScalar) -> list[pa.Array]:
    """Texts of strings of one font, and how many of their codes have none."""
    known = units.values.to_numpy() if units.is_valid else np.empty(0, np.int64)
    pieces = pa.concat_arrays([texts.values if texts.is_valid else pa.array([], pa.string()), pa.array([UNMAPPED])])
    width, byte, lost = (c.to_numpy(zero_copy_only=False) for c in parts.flatten().flatten())
    unit = width.astype(np.int64) << 32 | byte
    at = np.searchsorted(known, unit)
    found = ~lost & (np.append(known, -1)[at] == unit)
    taken = pieces.cast(pa.large_string()).take(pa.array(np.where(found, at, len(known))))
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    # pieces lie one after another, so a string's text is all that lies between its ends
    _, offsets, data = taken.buffers()
    places = np.frombuffer(offsets, np.int64)[: len(taken) + 1][ends] if len(taken) else np.zeros(len(ends), np.int64)
    text = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(places.tobytes()), data if data is not None else pa.py_buffer(b"")])
    missing = np.concatenate([[0], np.cumsum(~found)])[ends]
    return [text.cast(pa.string()), pa.array(np.diff(missing))]

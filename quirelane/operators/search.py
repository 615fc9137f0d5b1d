"""Text search over rows of text: literal and regular-expression matches with their places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_META = r"([\\.\[\]{}()*+?^$|])"


def literal_pattern(literal: str) -> str:
    """A Java pattern that matches ``literal`` as it stands."""
    import re

    return re.sub(_META, r"\\\1", literal)


def checked(pattern: str) -> str:
    """The pattern itself; an empty one, and one with a NUL, is refused."""
    if not pattern:
        raise ValueError("the pattern is empty")
    if "\0" in pattern:
        raise ValueError("the pattern holds a NUL")
    return pattern


def build(pattern: str, *, literal: bool = False, ignore_case: bool = False, whole_word: bool = False) -> str:
    """A Java pattern. Case is ignored for ASCII letters in literals, and for all letters in regular expressions."""
    p = literal_pattern(checked(pattern)) if literal else checked(pattern)
    if whole_word:
        p = f"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])"
    return p if not ignore_case else f"(?i:{p})" if literal else f"(?iu:{p})"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a variable of a lambda, where a column would be computed at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(sizes: Column) -> Column:
    """For each of an array of numbers, the sum of those before it.

    A fold copies what it has gathered at each step. It goes over blocks of about the root of the array's size, and over
    the blocks' sums, so very long arrays cost little more than short ones.
    """
    empty = F.array().cast("array<int>")

    def sums(part: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def whole(values: Column, block: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, block))
        total = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x)
        return _with(blocks, lambda parts: F.flatten(F.zip_with(parts, sums(F.transform(parts, total), F.lit(0)), sums)))

    side = lambda values: F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")
    return _with(sizes, lambda values: F.when(F.size(values) == 0, empty).when(values.isNotNull(), _with(side(values), lambda block: whole(values, block))))


#: Characters of a text up to which its few matches are folded one by one.
SHORT = 4096


def spans_of(text: Column, pattern: str) -> Column:
    """Array of (start, end, match): leftmost non-overlapping matches, code points, end exclusive; null text has none.

    Java's split gives the gaps between matches, so positions are running sums of gap and match lengths and the
    expression stays inside the JVM. The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    span = lambda at, gap, match: F.struct((at + F.char_length(gap)).alias("start"), (at + F.char_length(gap) + F.char_length(match)).alias("end"), match.alias("match"))
    folded = F.aggregate(
        F.arrays_zip(found, F.slice(gaps, F.lit(1), F.size(found))),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct((acc["at"] + F.char_length(x["1"]) + F.char_length(x["0"])).alias("at"), F.array_append(acc["out"], span(acc["at"], x["1"], x["0"])).alias("out")),
        lambda acc: acc["out"],
    )
    sizes = lambda z: F.transform(z, lambda x: F.char_length(x["g"]) + F.char_length(x["m"]))
    zipped = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))  # the last gap has no match after it
    placed = _with(F.filter(zipped, lambda x: x["m"].isNotNull()), lambda z: F.zip_with(z, running_sums(sizes(z)), lambda x, at: span(at, x["g"], x["m"])))
    return F.when(~text.rlike(pattern), empty).when(F.char_length(text) <= SHORT, folded).otherwise(placed)


def grep(df: DataFrame, pattern: str, *, literal: bool = False, text: str = "text", ignore_case: bool = False, whole_word: bool = False) -> DataFrame:
    """Every match as a row: the input's columns, then start, end and match, in code points of the whole text.

    Lines are matched one by one, as a search tool does, so no match holds a line break. Lines without a match are dropped
    before their matches are placed.
    """
    p = build(pattern, literal=literal, ignore_case=ignore_case, whole_word=whole_word)
    hit = df.where(F.col(text).rlike(p))
    # a line starts after each line break: places come from the text's characters in one pass
    after = F.transform(F.split(F.col(text), ""), lambda c, i: F.when(c == "\n", i + 1))
    starts = F.concat(F.array(F.lit(0)), F.filter(after, lambda i: i.isNotNull()))
    zipped = F.arrays_zip(F.split(F.col(text), "\n", -1).alias("line"), starts.alias("at"))
    lines = hit.select("*", F.explode(zipped).alias("_l")).where(F.col("_l.line").rlike(p))
    found = lines.select("*", F.explode(spans_of(F.col("_l.line"), p)).alias("_m"))
    place = lambda c: (F.col("_l.at") + F.col(f"_m.{c}")).alias(c)
    return found.select(*df.columns, place("start"), place("end"), "_m.match")


def inverted(spans: DataFrame, pattern: str, *, literal: bool = False, text: str = "text", ignore_case: bool = False, whole_word: bool = False) -> DataFrame:
    """Spans without a match, each with an event of its own; a null text has none either, and gives no event."""
    p = build(pattern, literal=literal, ignore_case=ignore_case, whole_word=whole_word)
    return spans.where(~F.col(text).rlike(p)).withColumn("event", F.lit("no_match"))

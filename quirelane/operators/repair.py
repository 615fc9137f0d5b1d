"""Repairs of extracted text: mojibake, hyphens at line ends, split ligatures, and word boundaries by gaps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField

from quirelane.functions import scalars
from quirelane.operators.groups import changes, folded

# What the single-byte code page has at 0x80 to 0x9F; the rest of it equals Latin 1.
_HIGH = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def mojibake_repaired(text: Column, confidence: Column | None = None, gain: float = 0.05) -> Column:
    """Text read again as UTF-8 where it looks as if a single-byte code page was read instead.

    The repair stands only if the bytes are UTF-8 and the readability grows by more than ``gain``, or the text gets shorter
    with fewer telltales.
    """
    as_latin = F.translate(text, _HIGH, "".join(map(chr, range(0x80, 0xA0))))
    raw = F.when(~as_latin.rlike("[^\\u0000-\\u00FF]"), F.encode(as_latin, "ISO-8859-1"))
    again = F.try_validate_utf8(raw.cast("string"))
    sure = F.lit(1.0) if confidence is None else confidence
    better = (scalars.readability(again, sure) - scalars.readability(text, sure) > gain) | (scalars.mojibake_count(again) < scalars.mojibake_count(text))
    return F.when(scalars.mojibake_suspect(text) & again.isNotNull() & better, again).otherwise(text)


def hyphens_joined(lines: DataFrame, keys: Sequence[str] = ("doc_id", "page_index"), order: str = "line_no", right_edge: float | None = None) -> DataFrame:
    """Lines whose trailing hyphen joins the next line's first word, which moves up; needs a lower-case start below.

    With ``right_edge``, only where the line ends within 5 per cent of the column's width of it.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    at_edge = F.lit(True) if right_edge is None else F.col("x1") >= right_edge - 0.05 * (right_edge - F.min("x0").over(Window.partitionBy(*keys)))
    below = F.lead("text").over(w)
    joins = F.coalesce(F.col("text").rlike("[A-Za-z\\u00C0-\\u024F]-$") & below.rlike("^[a-z\\u00DF-\\u00FF]") & at_edge, F.lit(False))
    marked = lines.withColumn("__joins", joins).withColumn("__below", below).withColumn("__above", F.coalesce(F.lag("__joins").over(w), F.lit(False)))
    body = F.when(F.col("__above"), F.regexp_replace("text", "^\\S+\\s*", "")).otherwise(F.col("text"))
    out = F.when(F.col("__joins"), F.concat(F.regexp_replace(body, "-$", ""), F.regexp_extract("__below", "^\\S+", 0))).otherwise(body)
    return marked.withColumn("text", out).drop("__joins", "__below", "__above")


def ligatures_joined(text: Column) -> Column:
    """Split ligatures written out: ff, fi, fl, ffi and ffl whose middle is a replacement character."""
    t = F.regexp_replace(text, "(f{1,2})\\uFFFD([il])", "$1$2")
    return F.regexp_replace(t, "(f[il])\\uFFFD", "$1")


#: Gaps that a threshold is taken from, how often it is taken anew, and the share of the size that it starts with.
GAPS, EVERY, FIRST = 20, 5, 0.25


def word_gaps(glyphs: DataFrame, keys: Sequence[str] = ("doc_id", "page_index"), order: str = "glyph_index") -> DataFrame:
    """Glyphs with ``word_start``: whether the gap before one ends a word.

    The threshold starts at a quarter of the size. Gaps of 0 or less end no word and aren't counted. After more than
    twenty gaps, at every fifth, it becomes one and a half times the median of the last twenty, of which those over four
    times the threshold don't count. A change of font, and of ``text_object`` if there is such a column, starts anew. A
    glyph on another line starts a word. The threshold depends on all gaps before, so a page, a bounded group, stays whole;
    a task marks all its pages at once and takes thresholds anew only in runs of over 25 gaps.
    """
    resets = [c for c in ("font", "text_object") if c in glyphs.columns]

    def fold(pages: pd.DataFrame, first: np.ndarray) -> np.ndarray:
        return _word_starts(pages, first, resets)

    return folded(glyphs, keys, [order], fold, StructField("word_start", BooleanType()))


def _word_starts(rows: pd.DataFrame, page: np.ndarray, resets: Sequence[str]) -> np.ndarray:
    x0, x1, y0, size = (rows[c].to_numpy(float) for c in ("x0", "x1", "y0", "size"))
    apart, gap = page.copy(), np.zeros(len(rows))
    apart[1:] |= np.abs(np.diff(y0)) > 0.5 * size[1:]
    gap[1:] = x0[1:] - x1[:-1]
    anew = page | changes(rows, resets)
    starts_at = np.flatnonzero(anew)
    of_run = np.cumsum(anew) - 1
    counted = ~apart & (gap > 0)
    starts = apart | counted & (gap > FIRST * size[starts_at][of_run])
    for r in np.flatnonzero(np.bincount(of_run[counted], minlength=len(starts_at)) > GAPS + EVERY):
        end = starts_at[r + 1] if r + 1 < len(starts_at) else len(rows)
        at = starts_at[r] + np.flatnonzero(counted[starts_at[r] : end])
        gaps, threshold = gap[at], FIRST * size[starts_at[r]]
        for seen in range(GAPS + EVERY, len(at), EVERY):
            recent = gaps[seen - GAPS : seen]
            kept = recent[recent <= 4 * threshold]
            threshold = 1.5 * float(np.median(kept)) if len(kept) else threshold
            starts[at[seen : seen + EVERY]] = gaps[seen : seen + EVERY] > threshold
    return starts


def nfc(text: Column) -> Column:
    """Canonical composition; text that is plain ASCII never leaves the JVM."""
    import unicodedata

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.when(text.rlike("[^\\u0000-\\u007F]"), compose(text)).otherwise(text)

"""Diagnostics: a catalogue of codes, their policy and hints, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: code, severity, whether work goes on, what to do.
CATALOGUE = [
    ("no_startxref", "warning", True, "The file lacks its end; objects are found by scanning."),
    ("bad_xref", "warning", True, "Cross references are damaged; save the file anew."),
    ("recovered", "warning", True, "Objects were found by scanning; check the page count."),
    ("stream_length", "info", True, "A stream's length was wrong and was measured instead."),
    ("encrypted", "error", False, "Give the file's password."),
    ("missing_font", "warning", True, "Text in this font is left out."),
    ("unknown_filter", "warning", True, "A stream's coding isn't known; its data is left out."),
    ("page_ring", "warning", True, "The page tree refers to itself."),
    ("too_deep", "warning", True, "Objects are nested too deeply."),
    ("too_many_operators", "warning", True, "The page's program is very long and was cut."),
    ("unreadable", "error", False, "The file can't be read."),
]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "code string, severity string, recoverable boolean, hint string")


def with_policy(rows: DataFrame) -> DataFrame:
    """Diagnostics with their severity and hint; unknown codes are information. The catalogue is a fixed small table."""
    c = F.broadcast(catalogue(rows.sparkSession))
    return rows.join(c, "code", "left").na.fill({"severity": "info", "recoverable": True})


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "code").agg(F.count("*").alias("n"))


def messages(diagnostics) -> F.Column:
    """The plain list of messages of an array of diagnostics."""
    return F.transform(diagnostics, lambda d: d["message"])


def unmapped_glyph(message: F.Column) -> F.Column:
    """(font, code, page) of a message such as ``unmapped glyph font=F1 code=0x41 page=3``; null parts where it lacks them."""
    part = lambda p: F.nullif(F.regexp_extract(message, p, 1), F.lit(""))
    return F.struct(part("font=(\\S+)").alias("font"), F.conv(part("code=0x([0-9A-Fa-f]+)"), 16, 10).cast("int").alias("code"), part("page=(\\d+)").cast("int").alias("page"))

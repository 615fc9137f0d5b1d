"""Scalar functions over text, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts in order of priority, with their code point ranges as a Java character class.
SCRIPTS = [
    ("arabic", "\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF"),
    ("hebrew", "\\u0590-\\u05FF"),
    ("devanagari", "\\u0900-\\u097F"),
    ("bengali", "\\u0980-\\u09FF"),
    ("indic", "\\u0A00-\\u0D7F"),
    ("thai", "\\u0E00-\\u0E7F"),
    ("lao", "\\u0E80-\\u0EFF"),
    ("tibetan", "\\u0F00-\\u0FFF"),
    ("myanmar", "\\u1000-\\u109F"),
    ("khmer", "\\u1780-\\u17FF"),
    ("sinhala", "\\u0D80-\\u0DFF"),
]
# Name fragments of monospaced fonts (any case) and of bold fonts (case as written).
MONOSPACE = ["mono", "courier", "code", "fixed", "console"]
BOLD = ["Bold", "Bd", "Black", "Heavy", "ExtraBold", "Extrabold", "UltraBold", "Ultrabold"]
# What follows U+00C3, and what stands for quotes, where UTF-8 was read as a single-byte code page.
MOJIBAKE = [
    "\\u00C3[\\u00A9\\u00A8\\u00AA\\u00AE\\u00B4\\u00BB\\u00A2\\u00A7\\u00B1\\u00A3\\u00BA\\u00AD\\u00B3\\u00A1\\u20AC]",
    "\\u00C2[^\\u0000-\\u007F]",
    "\\u00E2\\u20AC[\\u2122\\u201C\\u201D\\u00A0\\u2021\\u2026]",
]
# How a ligature looks whose middle was lost.
SPLIT_LIGATURES = ["f\ufffdi", "f\ufffdl", "ff\ufffdi", "ff\ufffdl", "fi\ufffd", "fl\ufffd"]
WHITE = "[\\u0009-\\u000D\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def script_of(text: Column, least: int = 3) -> Column:
    """The first script with ``least`` code points in the text; else latin; unknown for empty text."""
    out = None
    for name, chars in SCRIPTS:
        hit = F.regexp_count(text, F.lit(f"[{chars}]")) >= least
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.when(text == "", F.lit("unknown")).otherwise(out.otherwise(F.lit("latin")))


def zero_width(text: Column) -> Column:
    """Text without zero-width spaces and byte order marks, and without joiners unless its script shapes letters by them."""
    joins = ~script_of(text).isin("latin", "unknown")
    return F.when(joins, F.regexp_replace(text, "[\\u200B\\uFEFF]", "")).otherwise(F.regexp_replace(text, "[\\u200B\\uFEFF\\u200C\\u200D]", ""))


def mojibake_count(text: Column) -> Column:
    """Sequences that UTF-8 leaves when read as a single-byte code page."""
    return reduce(lambda x, y: x + y, (F.regexp_count(text, F.lit(p)) for p in MOJIBAKE))


def mojibake_suspect(text: Column, least: int = 1) -> Column:
    return mojibake_count(text) >= least


def printable_fraction(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n == 0, F.lit(0.0)).otherwise(1 - F.regexp_count(text, F.lit("[\\u0000-\\u001F\\u007F-\\u009F\\uFFFD]")) / n)


def whitespace_score(text: Column) -> Column:
    """1 where white space makes 5 to 40 per cent of the text, else 0."""
    n = F.char_length(text)
    share = F.regexp_count(text, F.lit(WHITE)) / n
    return F.when((n > 0) & share.between(0.05, 0.40), F.lit(1.0)).otherwise(F.lit(0.0))


def ligature_score(text: Column) -> Column:
    """0 where a ligature lost its middle; else 1."""
    hit = reduce(lambda x, y: x | y, (text.contains(p) for p in SPLIT_LIGATURES))
    return F.when(hit, F.lit(0.0)).otherwise(F.lit(1.0))


def confidence_floor(confidence: Column) -> Column:
    return F.least(F.lit(1.0), confidence / F.lit(0.6))


def readability(text: Column, confidence: Column, coverage: Column | None = None) -> Column:
    """Weighted score, 0 to 1, of printable share, word coverage, white space, ligatures and confidence; empty text: 0.

    ``coverage`` is the share of words in a word list; where it is unknown that part counts in full.
    """
    words = F.coalesce(coverage, F.lit(1.0)) if coverage is not None else F.lit(1.0)
    s = 0.35 * printable_fraction(text) + 0.30 * words + 0.15 * whitespace_score(text) + 0.10 * ligature_score(text) + 0.10 * confidence_floor(confidence)
    return F.when(F.char_length(text) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def text_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, in characters; two empty texts: 1."""
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n)


def nearly_equal(a: Column, b: Column, share: float = 0.05) -> Column:
    """Edit distance of at most ``share`` of the longer text; empty texts are equal to none.

    Equal texts and texts of very different lengths are told without it.
    """
    x, y = F.char_length(a), F.char_length(b)
    n = F.greatest(x, y)
    return (x > 0) & (y > 0) & (F.abs(x - y) <= share * n) & ((a == b) | (F.levenshtein(a, b) <= share * n))


def subset_prefix_stripped(font: Column) -> Column:
    return F.regexp_replace(font, "^[A-Z]{6}\\+", "")


def is_monospace(font: Column) -> Column:
    return F.lower(subset_prefix_stripped(font)).rlike("|".join(MONOSPACE))


def is_bold(font: Column) -> Column:
    return subset_prefix_stripped(font).rlike("|".join(BOLD))


def is_bullet(line: Column) -> Column:
    return line.rlike("^\\s*[\\u2022\\u2023\\u25E6\\u2043*-]\\s")


def is_numbered(line: Column) -> Column:
    return line.rlike("^\\s*[0-9]+[.)]\\s")


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+!|<>~])", r"\\$1")


def link_target(url: Column) -> Column:
    """Characters that would end a link target, percent-encoded."""
    pairs = [(" ", "%20"), ("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E"), ('"', "%22")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, url)


def roman(n: Column) -> Column:
    """Upper-case roman numeral of a whole number from 1, with as many M as it has thousands; else null."""
    place = lambda unit, one, five, ten: F.element_at(
        F.array(*(F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten))),
        (F.floor(n / unit) % 10).cast("int") + 1,
    )
    text = F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), place(100, "C", "D", "M"), place(10, "X", "L", "C"), place(1, "I", "V", "X"))
    return F.when(n >= 1, text)


def letters(n: Column) -> Column:
    """a to z, then aa, ab and so on to zz, aaa: numbers in base 26 without a zero. The page format itself repeats a letter."""
    letter = lambda v: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), ((v - 1) % 26 + 1).cast("int"), F.lit(1))

    def digit(acc: Column, _: Column) -> Column:
        left, out = acc["left"], acc["out"]
        more = left >= 1
        return F.struct(F.when(more, F.floor((left - 1) / 26)).otherwise(left).cast("long").alias("left"), F.when(more, F.concat(letter(left), out)).otherwise(out).alias("out"))

    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, digit, lambda acc: acc["out"]))


def page_label(style: Column, prefix: Column, number: Column) -> Column:
    """Label of a page: style D, R, r, A, a or none."""
    body = (
        F.when(style == "D", number.cast("string"))
        .when(style == "R", roman(number))
        .when(style == "r", F.lower(roman(number)))
        .when(style == "A", F.upper(letters(number)))
        .when(style == "a", letters(number))
        .otherwise(F.lit(""))
    )
    return F.concat(F.coalesce(prefix, F.lit("")), F.coalesce(body, F.lit("")))


def pdf_date_iso(text: Column) -> Column:
    """ISO 8601 text of D:YYYYMMDDHHmmSS with an optional zone; missing parts are their least values; null if no year."""
    p = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z)|([+-])(\d{2})'?(\d{2})?'?)?"
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(text, p, i), F.lit("")), F.lit(default))
    zone = (
        F.when(F.regexp_extract(text, p, 8) != "", F.concat(F.regexp_extract(text, p, 8), part(9, "00"), F.lit(":"), part(10, "00")))
        .when(F.regexp_extract(text, p, 7) != "", F.lit("Z"))
        .otherwise(F.lit(""))
    )
    iso = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), zone)
    return F.when(text.rlike(r"^(?:D:)?\d{4}"), iso)


def has_currency(text: Column) -> Column:
    return text.rlike("[$\\u20AC\\u00A3\\u00A5]\\s?[0-9]")


def typed_decimal(text: Column) -> Column:
    """Number of a text with currency signs and thousands commas; null if it is none."""
    return F.regexp_replace(text, "[$\\u20AC\\u00A3\\u00A5,\\s]", "").try_cast("double")


def typed_bool(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "yes", "1")


def code_language(text: Column) -> Column:
    """A guess at a code block's language: its shebang, else the first keyword set that fits; null if none does."""
    return (
        F.when(text.rlike("^#!.*python"), F.lit("python"))
        .when(text.rlike("^#!.*(bash|/sh)"), F.lit("bash"))
        .when(text.contains("def ") & text.contains(":"), F.lit("python"))
        .when(text.contains("fn ") & text.contains("{"), F.lit("rust"))
        .when(text.contains("func ") & text.contains("{"), F.lit("go"))
        .when(text.contains("public class "), F.lit("java"))
        .when(text.contains("#include"), F.lit("c"))
        .when(text.contains("function ") | text.contains("const "), F.lit("javascript"))
        .when(F.upper(text).rlike("^\\s*(SELECT|INSERT|UPDATE|CREATE) "), F.lit("sql"))
    )


def redact_credentials(text: Column) -> Column:
    """Error text without user information of URLs and without values of credential headers."""
    t = F.regexp_replace(text, "(?i)([a-z][a-z0-9+.-]*://)[^/@\\s]+@", "$1***@")
    return F.regexp_replace(t, "(?i)(authorization|x-api-key|cookie)(\\s*[:=]\\s*)\\S+", "$1$2***")


_PRIVATE = r"^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)"


def is_public_url(url: Column) -> Column:
    """HTTPS, to a host that isn't an address of private, local or metadata networks, nor a local name."""
    host = F.lower(F.regexp_extract(url, r"^https://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    local = host.isin("localhost", "metadata.google.internal", "[::1]", "[::]") | host.rlike(_PRIVATE) | host.rlike(r"\.(?:local|internal|localhost)$") | host.rlike(r"^\[(?:f[cd]|fe[89ab])")
    return F.coalesce(url.startswith("https://") & (host != "") & ~local, F.lit(False))


def version_compatible(made: Column, running: Column) -> Column:
    """Same major version, and a minor version that isn't newer than the running one."""
    number = lambda c, i: F.split(c, "\\.").getItem(i).try_cast("int")
    return F.coalesce((number(made, 0) == number(running, 0)) & (number(made, 1) <= number(running, 1)), F.lit(False))


def parse_size(text: str) -> int:
    """Bytes of texts such as 512, 10KB or 1GB; units are powers of 1024."""
    m = re.fullmatch(r"\s*([0-9]+)\s*([KMGT]?)(?:i?B)?\s*", text, re.I)
    if not m:
        raise ValueError(f"no size: {text!r}")
    return int(m[1]) << (10 * " KMGT".index(m[2].upper() or " "))


def parse_page_ranges(text: str, n_pages: int) -> tuple[list[int], list[str]]:
    """(page indexes from 0, warnings) of ranges such as 1-5,7,12-.

    Zero and malformed parts raise; pages beyond the document and reversed ranges give a warning and no page.
    """
    pages, warnings = set(), []
    for part in text.split(","):
        m = re.fullmatch(r"\s*([0-9]+)\s*(?:(-)\s*([0-9]*))?\s*", part)
        if not m:
            raise ValueError(f"no page range: {part!r}")
        first = int(m[1])
        last = int(m[3]) if m[3] else (n_pages if m[2] else first)
        if first == 0 or (m[3] and last == 0):
            raise ValueError("pages count from 1")
        if first > n_pages or last > n_pages or last < first:
            warnings.append(part.strip())
        pages.update(range(first - 1, min(last, n_pages)))
    return sorted(pages), warnings

"""Text, Markdown, HTML and JSON of pages and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelane.functions import scalars
from quirelane.operators.layout import ordered_text

ANCHOR = "<!-- anchor page=%d block=%d bbox=%d,%d,%d,%d kind=%s -->"
ANCHOR_PATTERN = "<!-- anchor page=([0-9]+) block=([0-9]+) bbox=(-?[0-9]+),(-?[0-9]+),(-?[0-9]+),(-?[0-9]+) kind=([a-z_]+) -->"


def page_text(blocks: DataFrame, keys: Sequence[str] = ("doc_id", "page_index"), drop: Sequence[str] = ("header", "footer")) -> DataFrame:
    """Texts of a page's blocks joined by blank lines; dropped kinds and empty blocks are left out, pages are not."""
    shown = F.when(~F.col("kind").isin(*drop) & (F.trim("text") != ""), F.struct("block_index", "text"))
    rows = F.array_sort(F.collect_list(shown))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("page_text"))


def document_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages joined by form feeds, empty ones kept."""
    p = pages.withColumn("__t", F.coalesce("page_text", F.lit("")))
    return p.groupBy(key).agg(ordered_text("\f", "__t", "page_index").alias("document_text"))


def block_markdown(kind: Column, level: Column, text: Column) -> Column:
    body = scalars.markdown_escape(text)
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(1))))), F.lit(" "), body))
        .when(kind == "list", F.concat(F.lit("- "), body))
        .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(kind == "caption", F.concat(F.lit("*"), body, F.lit("*")))
        .otherwise(body)
    )


def span_markdown(text: Column, flags: Column) -> Column:
    """Bold, italic, small capitals, subscript and superscript around a text."""
    out = scalars.markdown_escape(text)
    for flag, left, right in (
        ("superscript", "<sup>", "</sup>"),
        ("subscript", "<sub>", "</sub>"),
        ("smallcaps", '<span style="font-variant: small-caps">', "</span>"),
        ("italic", "*", "*"),
        ("bold", "**", "**"),
    ):
        out = F.when(F.array_contains(flags, flag), F.concat(F.lit(left), out, F.lit(right))).otherwise(out)
    return out


def page_markdown(blocks: DataFrame, keys: Sequence[str] = ("doc_id", "page_index")) -> DataFrame:
    """Blocks of a page in order: neighbouring list items one line apart, others a blank line."""
    rows = F.array_sort(F.collect_list(F.struct("block_index", "kind", "level", "text")))
    grouped = blocks.groupBy(*keys).agg(rows.alias("__rows"))
    md = F.transform(
        "__rows",
        lambda r, i: F.concat(
            F.when(i == 0, F.lit(""))
            .when((r["kind"] == "list") & (F.element_at("__rows", F.greatest(i, F.lit(1)))["kind"] == "list"), F.lit("\n"))
            .otherwise(F.lit("\n\n")),
            block_markdown(r["kind"], r["level"], r["text"]),
        ),
    )
    return grouped.select(*keys, F.array_join(md, "").alias("markdown"))


def pipe_table(rows: Column) -> Column:
    """A Markdown table of an array of rows of cell texts; the first is the header."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.element_at(rows, 1))))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_table(rows: Column) -> Column:
    """An HTML table of rows of (text, rowspan, colspan, header) cells."""

    def cell(c: Column) -> Column:
        tag = F.when(c["header"], F.lit("th")).otherwise(F.lit("td"))
        span = lambda name: F.when(c[name] > 1, F.concat(F.lit(f' {name}="'), c[name].cast("string"), F.lit('"'))).otherwise(F.lit(""))
        return F.concat(F.lit("<"), tag, span("rowspan"), span("colspan"), F.lit(">"), html_escape(F.coalesce(c["text"], F.lit(""))), F.lit("</"), tag, F.lit(">"))

    lines = F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>")))
    return F.concat(F.lit("<table>"), F.array_join(lines, ""), F.lit("</table>"))


def anchor(page: Column, block: Column, x0: Column, y0: Column, x1: Column, y1: Column, kind: Column) -> Column:
    return F.format_string(ANCHOR, page.cast("int"), block.cast("int"), *(F.round(c).cast("int") for c in (x0, y0, x1, y1)), kind)


def parse_anchors(text: Column) -> Column:
    """Anchors of a Markdown text outside code fences, as structs of their numbers and kind."""
    plain = F.regexp_replace(text, "(?s)```.*?```", "")
    return F.transform(
        F.regexp_extract_all(plain, F.lit(ANCHOR_PATTERN), F.lit(0)),
        lambda a: F.struct(
            *(F.regexp_extract(a, ANCHOR_PATTERN, i).cast("int").alias(n) for i, n in enumerate(("page", "block", "x0", "y0", "x1", "y1"), 1)),
            F.regexp_extract(a, ANCHOR_PATTERN, 7).alias("kind"),
        ),
    )


def document_json(pages: DataFrame, key: str = "doc_id", version: str = "1.0") -> DataFrame:
    """The document's envelope: schema version, metadata and pages in order, as JSON text."""
    columns = [c for c in pages.columns if c != key]
    rows = F.array_sort(F.collect_list(F.struct("page_index", *(c for c in columns if c != "page_index"))))
    body = F.struct(F.lit(version).alias("schema_version"), F.struct(F.count("*").alias("page_count")).alias("metadata"), rows.alias("pages"))
    return pages.groupBy(key).agg(F.to_json(body).alias("json"))


def migrate(documents: DataFrame, column: str = "json", version: str = "1.0") -> DataFrame:
    """Documents of the present schema version; others get their version replaced where a step from it exists."""
    have = F.get_json_object(column, "$.schema_version")
    return documents.withColumn("__v", have).withColumn("migrated", F.col("__v") == version).drop("__v")


def footer_errors(page_errors: DataFrame, diagnostics: DataFrame, key: str = "doc_id") -> DataFrame:
    """Errors of pages first, then diagnostics, each in their order."""
    a = page_errors.select(key, F.lit(0).alias("part"), F.col("page_index").alias("ordinal"), "message")
    b = diagnostics.select(key, F.lit(1).alias("part"), "ordinal", "message")
    return a.unionByName(b)


def form_markdown(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """A document's fields (name, type, value) as a Markdown table, by name."""
    rows = F.array_sort(F.collect_list(F.struct("name", "type", F.coalesce("value", F.lit("")).alias("value"))))
    body = F.concat(F.array(F.array(F.lit("field"), F.lit("type"), F.lit("value"))), F.transform(rows, lambda r: F.array(r["name"], r["type"], r["value"])))
    return fields.groupBy(key).agg(body.alias("__rows")).select(key, pipe_table(F.col("__rows")).alias("markdown"))


def footnotes(marks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Definitions (number, text) as Markdown footnotes, by number."""
    rows = F.array_sort(F.collect_list(F.struct("number", "text")))
    lines = F.transform(rows, lambda r: F.concat(F.lit("[^"), r["number"].cast("string"), F.lit("]: "), scalars.markdown_escape(r["text"])))
    return marks.groupBy(key).agg(F.array_join(lines, "\n").alias("markdown"))


def thread_markdown(beads: DataFrame, key: str = "doc_id") -> DataFrame:
    """Article threads as a list: a line per thread with its pages in order, counted from 1."""
    rows = F.array_sort(F.collect_list(F.struct("position", "page_index")))
    pages = F.array_join(F.transform(rows, lambda r: (r["page_index"] + 1).cast("string")), ", ")
    line = F.concat(F.lit("- Thread "), (F.col("thread") + 1).cast("string"), F.lit(": pages "), F.col("__p"))
    per = beads.groupBy(key, "thread").agg(pages.alias("__p"))
    return per.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("thread", line.alias("l")))), lambda r: r["l"]), "\n").alias("markdown"))

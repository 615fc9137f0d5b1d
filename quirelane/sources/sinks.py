"""Outputs of documents: JSON, Markdown, text, NDJSON, match events, SVG overlays and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelane.operators import serialise
from quirelane.sources import commit
from quirelane.streaming.frames import to_frames

FORMATS = ("json", "markdown", "text", "ndjson")


def check_outputs(targets: Sequence[tuple[str, str]]) -> None:
    """(format, target) pairs: at most one may be standard output, and NDJSON goes alone."""
    if sum(t == "-" for _, t in targets) > 1:
        raise ValueError("only one output can be standard output")
    if any(f == "ndjson" for f, _ in targets) and len(targets) > 1:
        raise ValueError("NDJSON can't be combined with other outputs")
    if unknown := {f for f, _ in targets} - set(FORMATS):
        raise ValueError(f"no such format: {sorted(unknown)}")


def rendered(pages: DataFrame, fmt: str, key: str = "doc_id") -> DataFrame:
    """(key, value) texts of documents in one format, from pages (page_index, page_text, markdown)."""
    if fmt == "json":
        return serialise.document_json(pages, key).select(key, F.col("json").alias("value"))
    if fmt == "ndjson":
        return to_frames(pages, key).select(key, "ordinal", "value")
    column = {"markdown": "markdown", "text": "page_text"}[fmt]
    return serialise.document_text(pages.withColumn("page_text", F.col(column)), key).select(key, F.col("document_text").alias("value"))


def write_all(pages: DataFrame, targets: Sequence[tuple[str, str]], key: str = "doc_id") -> None:
    """One pass over the pages feeds all outputs; each is committed by Spark's file protocol."""
    check_outputs(targets)
    held = pages.persist() if len(targets) > 1 else pages
    try:
        for fmt, path in targets:
            out = rendered(held, fmt, key)
            if fmt == "ndjson":
                out.repartitionByRange(key).sortWithinPartitions(key, "ordinal").select("value").write.text(path)
            else:
                out.write.parquet(path)
    finally:
        if len(targets) > 1:
            held.unpersist()


def write_set(pages: DataFrame, formats: Sequence[str], folder: str, key: str = "doc_id", *, overwrite: bool = False) -> None:
    """Documents in several formats, each a Parquet table of (key, value) below ``folder``, which is shown whole or not at all."""
    check_outputs([(f, f"{folder}/{f}") for f in formats])
    commit.write_together({f: rendered(pages, f, key).select(key, "value") for f in formats}, folder, overwrite=overwrite)


def match_events(matches: DataFrame, *columns: str) -> DataFrame:
    """A JSON line per match."""
    return matches.select(F.to_json(F.struct(F.lit("match").alias("event"), *columns)).alias("value"))


def svg_overlay(boxes: DataFrame, width: float, height: float, keys: Sequence[str] = ("doc_id", "page_index"), layer: str = "layer") -> DataFrame:
    """A page's boxes as SVG, one group per layer, with y from the top."""
    rect = F.format_string(
        '<rect x="%.2f" y="%.2f" width="%.2f" height="%.2f"/>', F.col("x0"), F.lit(height) - F.col("y1"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    )
    groups = boxes.groupBy(*keys, layer).agg(F.array_join(F.array_sort(F.collect_list(rect)), "").alias("__r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(layer, "__r"))), lambda g: F.concat(F.lit('<g class="'), serialise.html_escape(g[layer]), F.lit('">'), g["__r"], F.lit("</g>"))), "")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}">'
    return groups.groupBy(*keys).agg(F.concat(F.lit(head), body, F.lit("</svg>")).alias("svg"))


def open_metrics(counters: DataFrame, name: str, labels: Sequence[str], value: str = "total") -> DataFrame:
    """A line of the metrics text format per labelled counter."""
    quoted = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), quoted(c), F.lit('"')) for c in labels))
    return counters.select(F.concat(F.lit(f"{name}_total{{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("value"))


def histogram_lines(values: DataFrame, name: str, column: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative bucket, sum and count lines of a histogram."""
    v = F.col(column)
    one = values.agg(*(F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(v).alias("n"), F.sum(v).alias("s"))
    lines = [F.concat(F.lit(f'{name}_bucket{{le="{b:g}"}} '), F.col(f"b{i}").cast("string")) for i, b in enumerate(bounds)]
    lines += [F.concat(F.lit(f'{name}_bucket{{le="+Inf"}} '), F.col("n").cast("string")), F.concat(F.lit(f"{name}_count "), F.col("n").cast("string"))]
    return one.select(F.explode(F.array(*lines)).alias("value"))


def audit_record(action: Column, target: Column, status: Column) -> Column:
    return F.to_json(F.struct(F.current_timestamp().alias("at"), action.alias("action"), target.alias("target"), status.alias("status")))

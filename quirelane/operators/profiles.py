"""Document profiles: a match tree and weighted predicates compiled to columns, selection and field extraction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelane.functions import scalars


def predicate(kind: str, value, text: Column | None = None) -> tuple[Column, float]:
    """(condition, confidence) of one predicate of a match tree over columns text, headings, has_signature."""
    text = F.col("text") if text is None else text
    if kind == "text_contains":
        low = F.lower(text)
        return reduce(lambda a, b: a | b, (low.contains(p.lower()) for p in value)), 0.8
    if kind == "text_matches":
        return text.rlike(value), 0.7
    if kind == "heading_matches":
        return F.exists("headings", lambda h: h.rlike(value)), 0.75
    if kind == "has_currency":
        return (scalars.has_currency(text), 0.6) if value else (F.lit(True), 0.0)
    if kind == "has_signature":
        return (F.col("has_signature"), 0.5) if value else (F.lit(True), 0.0)
    if kind == "pages_between":
        return F.col("n_pages").between(*value), 0.5
    raise ValueError(f"no predicate: {kind}")


def compile_tree(tree: Mapping) -> tuple[Column, Column]:
    """(matched, confidence): all takes the least confidence, any the most of what matched, none excludes.

    A node with several of these needs them all.
    """
    matched, confidence = [], []
    for kind, value in tree.items():
        if kind in ("all", "any", "none"):
            parts = [compile_tree(t) for t in value]
            if kind == "all":
                matched.append(reduce(lambda a, b: a & b, (m for m, _ in parts), F.lit(True)))
                confidence.append(F.least(F.lit(1.0), F.lit(1.0), *(c for _, c in parts)))
            elif kind == "any":
                matched.append(reduce(lambda a, b: a | b, (m for m, _ in parts), F.lit(False)))
                confidence.append(F.greatest(F.lit(0.0), F.lit(0.0), *(F.when(m, c).otherwise(0.0) for m, c in parts)))
            else:
                hit = reduce(lambda a, b: a | b, (m for m, _ in parts), F.lit(False))
                matched.append(~hit)
                confidence.append(F.when(hit, 0.0).otherwise(1.0))
        else:
            on, sure = predicate(kind, value)
            on = F.coalesce(on, F.lit(False))
            matched.append(on)
            confidence.append(F.when(on, F.lit(sure)).otherwise(0.0))
    whole = reduce(lambda a, b: a & b, matched, F.lit(True))
    return whole, confidence[0] if len(confidence) == 1 else F.least(*confidence)


@dataclass(frozen=True)
class Profile:
    name: str
    match: Mapping
    priority: int = 0
    fields: Mapping[str, Sequence[str]] = field(default_factory=dict)


def tuned(options: Mapping[str, bool], tuning: Mapping) -> tuple[dict[str, bool], list[str]]:
    """(options as a profile tunes them, tunings without effect).

    ``include_invisible`` replaces the option of that name, ``include_headers_footers`` can only switch ``include_headers``
    and ``include_footers`` on. Nulls change nothing.
    """
    out = dict(options)
    given = {k: v for k, v in tuning.items() if v is not None}
    if "include_invisible" in given:
        out["include_invisible"] = bool(given.pop("include_invisible"))
    if given.pop("include_headers_footers", False):
        out |= {"include_headers": True, "include_footers": True}
    return out, sorted(given)


def select(signals: DataFrame, profiles: Sequence[Profile], least: float = 0.6) -> DataFrame:
    """Adds profile and profile_confidence: of matching profiles of confidence 0.6 or more, the surest, then the one of
    higher priority, then the first. Profiles are compiled into one projection: no join."""
    options = []
    for i, p in enumerate(profiles):
        m, c = compile_tree(p.match)
        options.append(F.when(m & (c >= least), F.struct(c.alias("c"), F.lit(p.priority).alias("p"), F.lit(-i).alias("i"), F.lit(p.name).alias("name"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return signals.withColumn("__best", best).withColumns({"profile": F.col("__best.name"), "profile_confidence": F.col("__best.c")}).drop("__best")


def weighted_classify(signals: DataFrame, profiles: Mapping[str, tuple[float, Sequence[tuple[Column, float]]]]) -> DataFrame:
    """Adds best class, its score and the runner-up: matched weight over all weight, at the class's own threshold or unknown."""
    scores = []
    for i, (name, (threshold, weights)) in enumerate(profiles.items()):
        total = sum(w for _, w in weights) or 1.0
        hit = reduce(lambda a, b: a + b, (F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(0.0) for c, w in weights), F.lit(0.0)) / total
        scores.append(F.struct(hit.alias("score"), F.lit(-i).alias("i"), F.lit(name).alias("name"), F.lit(threshold).alias("least")))
    ranked = F.reverse(F.array_sort(F.array(*scores)))
    first = F.element_at(ranked, 1)
    out = signals.withColumn("__r", ranked)
    first, second = F.element_at("__r", 1), F.try_element_at("__r", F.lit(2))
    return out.withColumns(
        {"class": F.when(first["score"] >= first["least"], first["name"]).otherwise(F.lit("unknown")), "class_score": first["score"], "runner_up": second["name"]}
    ).drop("__r")


def pattern_field(text: Column, patterns: Sequence[str], fallback: str | None = None) -> Column:
    """The first pattern with a match: its first group, or the whole match if the pattern has none."""
    import re

    found = [F.when(text.rlike(p), F.regexp_extract(text, p, 1 if re.compile(p).groups else 0)) for p in patterns]
    return F.coalesce(*found, F.lit(fallback))


def rich_field(text: Column, anchors: Sequence[str], pattern: str, kind: str = "text") -> Column:
    """The pattern's first match after the first anchor that the text holds, as decimal, integer, bool or text."""
    tails = [F.when(F.instr(text, a) > 0, F.substring(text, F.instr(text, a) + len(a), F.char_length(text))) for a in anchors]
    raw = F.nullif(F.regexp_extract(F.coalesce(*tails), pattern, 0), F.lit(""))
    if kind == "decimal":
        return scalars.typed_decimal(raw)
    if kind == "integer":
        return F.regexp_replace(raw, "[,\\s]", "").try_cast("long")
    return scalars.typed_bool(raw) if kind == "bool" else raw


def top_per_key(scored: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def feature_signals(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, what weighted predicates look at, from lines (page_index, line_no, text, size, font, y0, y1)."""
    t = F.col("text")
    page = lines.groupBy(key, "page_index").agg(
        F.sum(F.char_length(t)).alias("chars"),
        F.count_if(scalars.is_bullet(t)).alias("bullets"),
        F.count_if(t.rlike("[\\u2200-\\u22FF=+\\u00B1\\u00D7\\u00F7].*[0-9]|\\\\frac|\\u222B")).alias("math"),
        F.max(F.when((F.col("y0") <= 0.07 * 792) & t.rlike("[0-9]"), 1).otherwise(0)).alias("footer_number"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n").alias("page_text"),
        F.max("size").alias("largest"),
        F.collect_set("font").alias("fonts"),
        F.collect_set("size").alias("sizes"),
    )
    return page.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "page_text"))), lambda r: r["page_text"]), "\n").alias("text"),
        F.count("*").alias("n_pages"),
        F.sum("bullets").alias("bullets"),
        F.sum("math").alias("math"),
        F.avg("chars").alias("density"),
        F.size(F.array_distinct(F.flatten(F.collect_list("fonts")))).alias("n_fonts"),
        F.size(F.array_distinct(F.flatten(F.collect_list("sizes")))).alias("heading_depth"),
        (F.sum("footer_number") == F.count("*")).alias("footer_numbers"),
    )


def weighted_predicate(kind: str, value) -> Column:
    """Condition of one weighted predicate over a document's signals; ranges are (least, most), either may be None."""
    within = lambda c: (F.lit(True) if value[0] is None else F.col(c) >= value[0]) & (F.lit(True) if value[1] is None else F.col(c) <= value[1])
    if kind == "contains":
        return F.lower("text").contains(str(value).lower())
    if kind == "regex":
        return F.col("text").rlike(value)
    if kind in ("has_table", "has_signature", "has_form"):
        return F.col(kind) == bool(value)
    if kind == "math":
        return (F.col("math") > 0) == bool(value)
    if kind == "bullets":
        return F.col("bullets") >= value
    ranges = {"pages": "n_pages", "fonts": "n_fonts", "heading_depth": "heading_depth", "density": "density"}
    if kind in ranges:
        return within(ranges[kind])
    if kind == "footer_numbers":
        return F.col("footer_numbers") == bool(value)
    raise ValueError(f"no predicate: {kind}")

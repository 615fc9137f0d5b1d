"""Document-level tables: forms, links, labels, layers, threads, structure, attachments, signatures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows that a task gathers before it hands them on.
ROWS = 1 << 17


def combine_forms(acro: DataFrame, xfa: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fields of both form kinds by name: the XFA value wins, the AcroForm type stays; ``collision`` where both had one."""
    a = acro.select(key, "name", F.col("type").alias("a_type"), F.col("value").alias("a_value"), F.lit(True).alias("in_a"))
    x = xfa.select(key, "name", F.col("value").alias("x_value"), F.lit(True).alias("in_x"))
    j = a.join(x, [key, "name"], "full_outer")
    return j.select(
        key,
        "name",
        F.coalesce("a_type", F.lit("text")).alias("type"),
        F.when(F.col("in_x"), F.col("x_value")).otherwise(F.col("a_value")).alias("value"),
        (F.col("in_a").isNotNull() & F.col("in_x").isNotNull()).alias("collision"),
    )


def typed_value(kind: Column, value: Column) -> Column:
    """A form value as a struct with one member per kind, the others null."""
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "text", value).alias("text"),
        F.when(kind == "button", scalars_true(value)).alias("checked"),
        F.when(kind == "choice", F.split(value, "\\|")).alias("choices"),
        F.when(kind == "signature", value.isNotNull()).alias("signed"),
    )


def scalars_true(value: Column) -> Column:
    return ~F.lower(value).isin("off", "no", "false", "0", "")


def named_destinations(links: DataFrame, destinations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Links with the page of their name; null where the document has no such name."""
    return links.join(destinations.select(key, "name", F.col("page_index").alias("target_page")), [key, "name"], "left")


def links_to_spans(links: DataFrame, spans: DataFrame, keys: Sequence[str] = ("doc_id", "page_index")) -> DataFrame:
    """Spans whose centre lies within a link's rectangle; joined within a page."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (cx >= F.col("l_x0")) & (cx <= F.col("l_x1")) & (cy >= F.col("l_y0")) & (cy <= F.col("l_y1"))
    return spans.join(links, list(keys)).where(inside)


def as_of_labels(pages: DataFrame, labels: DataFrame, key: str = "doc_id", page: str = "page_index") -> DataFrame:
    """Pages with the label range that starts last at or before them, by one sort of both sides: no range join."""
    p = pages.select(key, page, F.lit(1).alias("__side"))
    cols = [c for c in labels.columns if c not in (key, "start_page")]
    s = labels.select(key, F.col("start_page").alias(page), F.lit(0).alias("__side"), F.struct(F.col("start_page"), *cols).alias("__label"))
    both = p.withColumn("__label", F.lit(None).cast(s.schema["__label"].dataType)).unionByName(s)
    w = Window.partitionBy(key).orderBy(page, "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("__label", F.last("__label", ignorenulls=True).over(w)).where("__side = 1")
    return filled.select(key, page, F.col("__label.start_page").alias("start_page"), *(F.col(f"__label.{c}").alias(c) for c in cols))


def layer_visible(base_on: Column, override: Column) -> Column:
    """Whether a layer shows: its own override, else the base state."""
    return F.coalesce(override, base_on)


def membership_visible(policy: Column, states: Column) -> Column:
    """Whether a membership of layers shows, by AllOn, AnyOn, AnyOff or AllOff; an empty list always shows."""
    on, off = (lambda s: s), (lambda s: ~s)
    return (
        F.when(F.size(states) == 0, F.lit(True))
        .when(policy == "AllOn", F.forall(states, on))
        .when(policy == "AnyOff", F.exists(states, off))
        .when(policy == "AllOff", F.forall(states, off))
        .otherwise(F.exists(states, on))
    )


def walk_chain(edges: DataFrame, starts: DataFrame, key: str = "doc_id", limit: int = 10_000) -> DataFrame:
    """(key, chain, node, position): each chain from its start along ``next``, each node once, so rings end.

    A document's edges and starts meet in one grouping and are walked there, in time that grows with their number; nothing is
    broadcast. Edges: key, node, next (null at an end). Starts: key, chain, node. ``limit`` ends the walk, as documented.
    """
    e = edges.where(F.col("node").isNotNull() & F.col("next").isNotNull()).select(key, F.struct("node", "next").alias("__e"))
    s = starts.select(key, F.struct("chain", "node").alias("__s"))
    grouped = s.unionByName(e, allowMissingColumns=True).groupBy(key).agg(F.collect_list("__s").alias("__s"), F.collect_list("__e").alias("__e")).where(F.size("__s") > 0)
    fields = [starts.schema[key], *(StructField(c, starts.schema[c].dataType) for c in ("chain", "node")), StructField("position", IntegerType())]
    schema = StructType(fields)

    def walked(firsts: list[tuple], ahead: dict) -> Iterator[tuple]:
        chains: dict = {}
        for chain, node in firsts:
            chains.setdefault(chain, []).append(node)
        for chain, front in chains.items():
            seen, position = set(), 0
            while front and position < limit:
                now = [n for n in dict.fromkeys(front) if n not in seen]
                seen.update(now)
                yield from ((chain, n, position) for n in now)
                front = [n for m in now for n in ahead.get(m, ())]
                position += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fields[1:]]
        for batch in batches:
            ends = {c: [0, *np.cumsum(batch[c].value_lengths().to_numpy(zero_copy_only=False)).tolist()] for c in ("__s", "__e")}
            chain, first, node, ahead = (x.to_pylist() for c in ("__s", "__e") for x in batch[c].flatten().flatten())
            rows, own = [], []
            for i in range(batch.num_rows):
                s, e = (slice(ends[c][i], ends[c][i + 1]) for c in ("__s", "__e"))
                to: dict = {}
                for n, m in zip(node[e], ahead[e], strict=True):
                    to.setdefault(n, []).append(m)
                before = len(rows)
                rows += walked(list(zip(chain[s], first[s], strict=True)), to)
                own.append(len(rows) - before)
                if len(rows) > ROWS or i == batch.num_rows - 1:
                    at = pa.array(np.repeat(np.arange(i + 1 - len(own), i + 1), own))
                    yield pa.RecordBatch.from_arrays([batch[key].take(at), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))], names=schema.names)
                    rows, own = [], []

    return grouped.mapInArrow(run, schema)


def resolve_roles(roles: DataFrame, standard: Sequence[str], key: str = "doc_id", depth: int = 16) -> DataFrame:
    """Each custom role with the standard one that its chain ends in; null for rings and unknown ends."""
    out = roles.select(key, F.col("role").alias("custom"), F.col("maps_to").alias("at"))
    nxt = roles.select(F.col(key).alias("__k"), F.col("role").alias("__r"), F.col("maps_to").alias("__m"))
    for _ in range(max(1, depth.bit_length())):
        done = F.col("at").isin(*standard)
        j = out.join(nxt, (F.col(key) == F.col("__k")) & (F.col("at") == F.col("__r")) & ~done, "left")
        out = j.select(key, "custom", F.coalesce("__m", "at").alias("at"))
        # every custom role jumps as far as its chain is known, so chains double in length
        nxt = out.select(F.col(key).alias("__k"), F.col("custom").alias("__r"), F.col("at").alias("__m"))
    return out.select(key, "custom", F.when(F.col("at").isin(*standard), F.col("at")).alias("standard"))


def mcid_coverage(pages: DataFrame, claimed: DataFrame, keys: Sequence[str] = ("doc_id", "page_index"), least: float = 0.80) -> DataFrame:
    """Share of each page's marked-content ids that the structure tree claims; below 80 per cent, or without any, falls back."""
    a = pages.select(*keys, "mcid").distinct()
    c = claimed.select(*keys, "mcid", F.lit(1).alias("__c")).distinct()
    g = a.join(c, [*keys, "mcid"], "left").groupBy(*keys).agg((F.count("__c") / F.count("mcid")).alias("coverage"))
    return g.withColumn("falls_back", F.coalesce(F.col("coverage") < least, F.lit(True)))


def document_algorithm(coverage: DataFrame, key: str = "doc_id") -> DataFrame:
    return coverage.groupBy(key).agg(F.when(F.bool_or("falls_back"), F.lit("layout")).otherwise(F.lit("structure")).alias("algorithm"))


def signature_coverage(ranges: Column, size: Column) -> Column:
    """Share of a file that the (start, length) pairs of a byte range list cover."""
    lengths = F.transform(F.sequence(F.lit(1), F.size(ranges) - 1, F.lit(2)), lambda i: F.element_at(ranges, i + 1))
    return F.when((F.size(ranges) >= 2) & (size > 0), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x) / size)


def attachment_payload(data: Column, limit: int = 50 << 20) -> Column:
    """(data in base64, truncated): files over the limit carry no data."""
    big = F.octet_length(data) > limit
    return F.struct(F.when(~big, F.translate(F.base64(data), "\r\n", "")).alias("data"), big.alias("truncated"))


def conformance(xmp: Column) -> Column:
    """Level such as 2B of archival metadata; null without."""
    part = F.regexp_extract(xmp, "pdfaid:part(?:>|=\")\\s*([0-9])", 1)
    level = F.regexp_extract(xmp, "pdfaid:conformance(?:>|=\")\\s*([A-Za-z])", 1)
    return F.when(part != "", F.concat(part, F.upper(level)))


def visual_order(df: DataFrame) -> DataFrame:
    """By page, from the top down and left to right; rows without a rectangle last."""
    return df.orderBy(F.asc("page_index"), F.desc_nulls_last("y0"), F.asc("x0"))


def visual_rank(df: DataFrame, last: str, key: str = "doc_id") -> DataFrame:
    """Adds ``rank``, from 1: the place of each row in its document's visual order, ties by column ``last``."""
    w = Window.partitionBy(key).orderBy(F.asc("page_index"), F.desc_nulls_last("y0"), F.asc("x0"), F.asc(last))
    return df.withColumn("rank", F.row_number().over(w))

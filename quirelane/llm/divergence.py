"""Divergence of sources: how far the smoothed term shares of each source lie from those of the others, in whole numbers.

A share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)); a term divides two shares by f = floor((p - q)^2 / (p + q)). A pair of
sources is f summed over all V kept terms of their language, most of which a source may lack. Terms are split by the number
of sources that have them. Heavy ones fill dense tiles, sources by terms, in which each pair is one numpy expression. For
light ones every pair starts from "absent in both", and postings correct it: one row at a time for the other side's absence,
and where both sides have the term, a pair of postings. All parts are sums of whole numbers, so they add up exactly.

Tiles are keyed by a pair of blocks of sources and a slice of the terms, so no task ever holds a language or a source whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelane.llm.common import as_bytes
from quirelane.session import cut

#: A term counts in a language if so many of its documents have it.
MIN_DOCUMENTS = 10
#: Terms of the report of single terms.
TOP_TERMS = 10
#: A term is heavy if at least one source in so many has it.
HEAVY_SHARE = 4
#: About as many sources are in a block, and terms in a slice.
BLOCK, SLICE = 128, 1024
#: Counted terms that a task holds before it hands them on, and bytes of a text that are split at once.
HELD, CHUNK = 300_000, 1 << 22
#: Postings that are corrected at once.
ROWS = 2048
_TERMS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in runs of bounded size: letters and whatever isn't ASCII, with A-Z lower-cased."""
    spaced = text.translate(_TERMS)
    at = 0
    while at < len(spaced):
        end = spaced.find(b" ", at + CHUNK)
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences, and documents, of each term of each source, summed over what a task holds."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in found.items():
            if times:
                same = [pa.array([v], pa.string()).take(pa.array(np.zeros(len(times), np.int32))) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(list(times), pa.binary()), pa.array(list(times.values()), pa.int64()), pa.array([docs[t] for t in times], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        found.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
            times, docs = found.setdefault((lang, source), (Counter(), Counter()))
            held -= len(times)
            once: set[bytes] = set()
            for words in terms_of(text or b""):
                times.update(words)
                once.update(words)
            docs.update(once)
            held += len(times)
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a term with ``n`` of ``total`` occurrences among ``terms`` kept terms, any value without terms; products of counts don't fit a long."""
    whole = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.call_function("div", whole, F.greatest(total + 2 * terms, F.lit(1)).cast("decimal(20,0)")) + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of two shares; 10^18 fits a long."""
    d = p - q
    return d * d // (p + q)


def postings(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, groups, lang_n, leads) of the kept terms: one row per source that has the term.

    One shuffle by language and term serves the sums, the count of documents and the test: what a task emits is summed already.
    """
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    counted = texts.mapInArrow(_tally, "lang string, source string, term binary, n long, docs long").repartition("lang", "term")
    summed = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    known = summed.select(
        "lang", "source", "term", "n", F.sum("docs").over(over).alias("in_docs"), F.count("*").over(over).alias("groups"), F.sum("n").over(over).alias("lang_n"),
        (F.row_number().over(over.orderBy("source")) == 1).cast("long").alias("leads"),
    )
    return known.where(F.col("in_docs") >= MIN_DOCUMENTS).drop("in_docs")


def sources(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms, size): every group that occurs, its kept occurrences and its language's figures."""
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("leads").alias("terms"))
    size = groups.groupBy("lang").agg(F.count("*").alias("size"))
    all_of = groups.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").join(size, "lang")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return all_of.select("lang", "source", zero("total"), zero("lang_total"), zero("terms"), "size")


def _sides(part: pd.DataFrame, block: int) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Sources of a block, their share of an absent term, and the block's postings with the number of their source."""
    mine = part[part["block"] == block]
    groups = mine[mine["term"].isna()].sort_values("source", kind="stable")
    names = groups["source"].to_numpy(object)
    rows = mine[mine["term"].notna()]
    return names, groups["p"].to_numpy(np.int64), rows.assign(i=pd.Index(names).get_indexer(rows["source"]))


def dense(acc: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> None:
    """Add every pair's gaps over a tile of shares, sources by terms."""
    for i, row in enumerate(pa_):
        acc[i] += gap(row[None, :], pb).sum(1)


def sparse(acc: np.ndarray, zero: np.ndarray, a: tuple, b: tuple, absent_a: np.ndarray, absent_b: np.ndarray) -> None:
    """Correct "absent in both" by postings (source, term, share) of both sides, each ordered by term."""
    for (i, _, p), absent, base, into in ((a, absent_b, zero, acc), (b, absent_a, zero.T, acc.T)):
        for at in range(0, len(i), ROWS):
            k = i[at : at + ROWS]
            np.add.at(into, k, gap(p[at : at + ROWS, None], absent[None, :]) - base[k])
    (ia, ta, p), (ib, tb, q) = a, b
    for at in range(0, len(ia), ROWS):
        low, high = np.searchsorted(tb, ta[at : at + ROWS], "left"), np.searchsorted(tb, ta[at : at + ROWS], "right")
        n = high - low
        x = np.repeat(np.arange(at, at + len(n)), n)
        y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        i, j = ia[x], ib[y]
        np.add.at(acc, (i, j), gap(p[x], q[y]) - gap(p[x], absent_b[j]) - gap(absent_a[i], q[y]) + zero[i, j])


def tile_sums(part: pd.DataFrame) -> pd.DataFrame:
    """What one tile adds to each pair of sources of two blocks.

    ``part`` has a row without a term for every source, with its share of an absent term, and the postings of both blocks.
    The first slice of terms also adds the pairs' start, as if all terms were absent in both.
    """
    first = part.iloc[0]
    a, absent_a, rows_a = _sides(part, first["a"])
    b, absent_b, rows_b = (a, absent_a, rows_a) if first["a"] == first["b"] else _sides(part, first["b"])
    zero = gap(absent_a[:, None], absent_b[None, :])
    acc = zero * int(first["terms"]) if first["slice"] == 0 else np.zeros_like(zero)
    index = pd.Index(pd.concat([rows_a["term"], rows_b["term"]]).unique())
    for heavy in (True, False):
        halves = []
        for rows in (rows_a, rows_b):
            some = rows[rows["heavy"] == heavy]
            code = index.get_indexer(some["term"])
            order = np.argsort(code, kind="stable")
            halves.append((some["i"].to_numpy()[order], code[order], some["p"].to_numpy(np.int64)[order]))
        if heavy:
            used = np.union1d(halves[0][1], halves[1][1])
            tiles = []
            for (i, code, p), absent in zip(halves, (absent_a, absent_b), strict=True):
                tile = np.repeat(absent[:, None], len(used), axis=1)
                tile[i, np.searchsorted(used, code)] = p
                tiles.append(tile)
            dense(acc, *tiles)
            acc -= zero * len(used)
        else:
            sparse(acc, zero, *halves, absent_a, absent_b)
    i, j = np.triu_indices(len(a), 1) if first["a"] == first["b"] else np.divmod(np.arange(len(a) * len(b)), max(len(b), 1))
    return pd.DataFrame({"lang": first["lang"], "source": a[i], "other": b[j], "value": acc[i, j]})


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, in both orders."""
    blocks, slices = F.ceil(F.col("size") / BLOCK), F.greatest(F.ceil(F.col("terms") / SLICE), F.lit(1))
    sized = groups.withColumns({"blocks": blocks.cast("int"), "slices": slices.cast("int"), "block": F.pmod(F.xxhash64("source"), blocks).cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    absent = sized.select("lang", "source", "block", "terms", "slices", share(F.lit(0), F.col("total"), F.col("terms")).alias("p"), other.alias("other"))
    absent = absent.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    absent = absent.select("lang", "source", "block", "other", "slice", "terms", F.lit(None).cast("binary").alias("term"), "p", F.lit(False).alias("heavy"))
    rows = kept.join(sized, ["lang", "source"]).select(
        "lang", "source", "block", other.alias("other"), F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), "terms", "term",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), (F.col("groups") * HEAVY_SHARE >= F.col("size")).alias("heavy"),
    )
    tiles = absent.unionByName(rows).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other")
    sums = tiles.groupBy("lang", "a", "b", "slice").applyInPandas(tile_sums, "lang string, source string, other string, value long")
    whole = sums.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    return whole.select("lang", both.alias("of"), "value").select("lang", "of.source", "of.item", "value")


def terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source uses more than its language does."""
    known = kept.join(groups, ["lang", "source"])
    shares = known.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    return shares.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of each source by divergence, and its ``TOP_TERMS`` own terms.

    Null text, lang and source count as empty. A source without terms is a group like any other; with no kept term all of a
    language's pairs have value 0. Each row is a document, repeated rows too. No documents give no rows. Very long texts
    are split in parts. Columns beside text, lang and source are not read. Ties go to the smaller item in UTF-8.
    """
    kept = cut(postings(docs))
    groups = cut(sources(docs, kept))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    pair = pairs(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    term = terms(kept, groups).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= TOP_TERMS)
    return pair.unionByName(term)

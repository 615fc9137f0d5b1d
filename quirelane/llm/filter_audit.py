"""Interaction of filters: what each one removes in every order, from joint failures alone.

Each document fails some of five filters. Joint failures of all 32 sets of filters are sums of products of flags, one
aggregation of the corpus; all that follows is arithmetic on 32 numbers a part. With J(S) the documents that fail every
filter of S, Moebius inversion gives the survivors of a set T as the sum of (-1)^|S| J(S) over the subsets S of T, and the
Harsanyi dividend of a set S in the game "documents removed" is (-1)^(|S|+1) J(S), of which each member gets an equal share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import permutations
from math import factorial
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelane.llm.common import as_bytes
from quirelane.session import cut

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
WEIGHTS = ("n", "good", "toxic")
MIN_WORDS = 200
_MARKS = b"#$%&*|"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text of ``n_chars`` code points fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    marks = len(text) - len(text.translate(None, _MARKS))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * n_chars) << 2 | (marks > 0) << 3


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or b"" for t in as_bytes(b.column(2))]
        chars = pc.fill_null(pc.utf8_length(b.column(2)), 0).to_pylist()
        bits = pa.array([int(failures(t, n)) for t, n in zip(texts, chars, strict=True)], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), bits, pa.array([sha256(t).digest() for t in texts], pa.binary())], names=["doc_id", "part", "bits", "digest"])


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, good, toxic, n): documents by the filters that they fail, E included, and by label.

    E: some smaller doc_id has the same text; texts are told apart by their SHA-256. A group of copies is never gathered:
    its smallest doc_id is a partial aggregate, and documents meet it under (digest, doc_id), a key of one document. Rows
    that repeat a doc_id count one by one. A null doc_id is neither smaller nor larger than another, and has no labels.
    A document with several label rows has each label that one of them gives.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), "text")
    rows = cut(texts.mapInArrow(_measure, "doc_id long, part string, bits int, digest binary"))
    known = rows.where(F.col("doc_id").isNotNull()).groupBy("digest", "doc_id", "part", "bits").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull()).withColumn("is_first", F.lit(True))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic")))
    )
    found = known.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("is_first"), 0).otherwise(1 << FILTERS.index("E"))
    found = found.select("part", F.col("bits").bitwiseOR(copy).alias("bits"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")), "n")
    unknown = rows.where(F.col("doc_id").isNull()).select("part", "bits", F.lit(0).alias("good"), F.lit(0).alias("toxic"), F.lit(1).cast("long").alias("n"))
    return found.unionByName(unknown).groupBy("part", "bits", "good", "toxic").agg(F.sum("n").alias("n"))


def joint_failures(counts: DataFrame) -> DataFrame:
    """Per part, for each set of filters and each weight: the documents that fail all of the set, as a sum of flag products."""
    flags = [F.shiftright("bits", i).bitwiseAND(1) for i in range(len(FILTERS))]
    weights: dict[str, Column] = {"n": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}

    def joint(name: str, members: int) -> Column:
        return F.sum(reduce(mul, (f for i, f in enumerate(flags) if members >> i & 1), weights[name])).alias(f"{name}{members}")

    return counts.groupBy("part").agg(*(joint(w, s) for w in WEIGHTS for s in range(SETS)))


def moebius(joint: np.ndarray) -> np.ndarray:
    """Survivors of every set of filters, from the joint failures of every set (axis 1)."""
    out = joint.copy()
    for i in range(len(FILTERS)):
        has = [s for s in range(SETS) if s >> i & 1]
        out[:, has] = out[:, [s ^ 1 << i for s in has]] - out[:, has]
    return out


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, filters already applied, the step's filter) of every order."""
    out = []
    for order in permutations(range(len(FILTERS))):
        applied = 0
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[i] for i in order), k + 1, applied, f))
            applied |= 1 << f
    return out


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every order's steps, of the parts of each batch."""
    steps = _steps()
    orders, numbers = [s[0] for s in steps], [s[1] for s in steps]
    before, which = np.array([s[2] for s in steps]), np.array([s[3] for s in steps])
    after, alone, rest = before | 1 << which, 1 << which, (SETS - 1) ^ 1 << which
    sizes = np.array([s.bit_count() for s in range(SETS)])
    # an equal share of a dividend, times all orders: 120 / |S| is whole for 1 to 5 filters
    shares = np.where(sizes > 0, np.where(sizes % 2, 1, -1) * (factorial(len(FILTERS)) // np.maximum(sizes, 1)), 0)
    for b in batches:
        joint = {w: np.stack([b.column(b.schema.get_field_index(f"{w}{s}")).to_numpy(zero_copy_only=False) for s in range(SETS)], 1) for w in WEIGHTS}
        left = {w: moebius(j) for w, j in joint.items()}
        removed = {w: v[:, before] - v[:, after] for w, v in left.items()}
        whole = np.stack([(joint["n"] * shares * (np.arange(SETS) >> f & 1)).sum(1) for f in range(len(FILTERS))], 1)
        columns = [left["n"][:, after], removed["n"], joint["n"][:, alone] - removed["n"], left["n"][:, rest] - left["n"][:, [SETS - 1]], removed["good"], removed["toxic"], whole[:, which]]
        parts = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), len(steps))))
        names = [x.split()[0] for x in RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([parts, pa.array(orders * b.num_rows), pa.array(numbers * b.num_rows, pa.int32()), *(pa.array(c.ravel()) for c in columns)], names=names)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per source, order of the five filters and step, with what the step keeps, removes and loses.

    Null text and null source count as empty; a null text and an empty one are copies of each other. No documents give no
    rows. Very long texts are measured whole. Columns beside doc_id, text and source are not read. ``labels`` may be empty.
    """
    counts = joint_failures(flagged(docs, labels))
    return counts.mapInArrow(_effects, RESULT)

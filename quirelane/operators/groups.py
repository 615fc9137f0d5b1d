"""Folds over small groups such as pages, many to a frame: what a group costs is its rows, not a call of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructField, StructType


def changes(frame: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Rows that differ from the one before in any of the columns, and the first; nulls are equal."""
    out = np.ones(len(frame), bool)
    if len(frame):
        out[1:] = False
    for c in columns:
        v = frame[c]
        before = v.shift()
        out[1:] |= ((v != before) & ~(v.isna() & before.isna())).to_numpy(bool)[1:]
    return out


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The rows of batches that are sorted by the keys, cut anew so that no group lies in two frames."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if b.empty:
            continue
        first = np.flatnonzero(changes(pd.concat([held[-1].iloc[-1:], b]) if held else b, keys))
        cuts = first[1:] - 1 if held else first
        if held and not len(cuts):
            held.append(b)
            continue
        last = int(cuts[-1])
        done = pd.concat([*held, b.iloc[:last]], ignore_index=True)
        if len(done):
            yield done
        held = [b.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def folded(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], fold: Callable[[pd.DataFrame, np.ndarray], Sequence], field: StructField) -> DataFrame:
    """Rows with one more column: ``fold`` gets sorted rows of whole groups, and which of them are a group's first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, keys):
            yield frame.assign(**{field.name: fold(frame, changes(frame, keys))})

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, StructType([*rows.schema.fields, field]))

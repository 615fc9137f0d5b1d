"""Exact top-k inner products by a Voronoi join.

Vectors are rounded to integers, so scores are exact. Each vector belongs to the cell of its nearest pivot. A cell's
summary is how many queries it holds, how far they lie from the pivot, and the k + 1 members nearest to it. From these
summaries alone every cell's queries get a bound that their k-th best score can't fall below, and from its scores with
the pivots a vector shows whether any query of a cell can score it that high. Cells are put together to groups of a set
number of queries; a vector is copied to those groups that need it, at most once each, and groups are solved locally.

Groups grow by queries, so copies of a vector are bounded by queries / QUERY_BLOCK and not by the number of pivots; a
group's data is dealt out in blocks, so a cell that holds a third of all rows is many tasks. What the driver and
broadcasts hold is bounded by the number of pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelane.session import cut

#: Pivots grow with the square root of the rows, within these.
PIVOTS = (16, 1024)
#: Vectors, and queries, that meet in one task.
BLOCK, QUERY_BLOCK = 4096, 16384


def whole_vectors(df: DataFrame, *, scale: int = 64, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vid, v): floor(scale * x) of each component as long. Rows whose vector is null or holds a null, NaN or infinity go."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    fine = F.col(vector).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(id).alias("vid"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as int64, shorter ones padded with zeros, so they score over common components."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T: by floating point where every partial sum fits its mantissa."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and distance of each vector; distances are rounded up, as bounds must hold."""
    f, p = v.astype(np.float64), pivots.astype(np.float64)
    square = (f * f).sum(1)[:, None] - 2 * f @ p.T + (p * p).sum(1)[None, :]
    cell = square.argmin(1)
    gap = f - p[cell]
    return cell, np.sqrt((gap * gap).sum(1)) * (1 + 1e-9)


def bounds(pivots: np.ndarray, radius: np.ndarray, gaps: list[np.ndarray], k: int) -> np.ndarray:
    """For each cell, what the k-th best score of its queries is at least.

    A query lies within ``radius`` of its pivot p, and members at ``gaps`` from theirs, o: their score is at least
    p.o - radius |o| - (|p| + radius) gap. Of k + 1 members one may be the query itself.
    """
    p = pivots.astype(np.float64)
    size = np.sqrt((p * p).sum(1))
    owner = np.repeat(np.arange(len(gaps)), [len(g) for g in gaps])
    gap = np.concatenate(gaps) if gaps else np.zeros(0)
    out = np.full(len(p), -np.inf)
    if len(gap) > k:
        for i in range(len(p)):
            low = (p @ p[i] - radius[i] * size)[owner] - (size[i] + radius[i]) * gap
            out[i] = np.partition(low, len(low) - k - 1)[len(low) - k - 1]
    return out - 1e-9 * np.abs(np.where(np.isfinite(out), out, 0)) - 1e-6


def grouped(n_queries: np.ndarray, pivots: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each cell, parts of each group): cells of near pivots together, up to ``limit`` queries; larger cells alone, in parts."""
    group, parts, held = np.zeros(len(n_queries), np.int64), [], 0
    left = list(np.flatnonzero(n_queries))
    p = pivots.astype(np.float64)
    at = left[0] if left else 0
    while left:
        at = left.pop(int(((p[left] - p[at]) ** 2).sum(1).argmin()))
        if not parts or held + n_queries[at] > limit:
            parts.append(1)
            held = 0
        group[at] = len(parts) - 1
        held += n_queries[at]
        parts[-1] = -(-held // limit)
    return group, np.array(parts or [1], np.int64)


def top_k(df: DataFrame, *, k: int = 20, every: int = 20, scale: int = 64, pivots: int | None = None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id is divisible by ``every``.

    Fewer than k other rows: all of them. Ties go to smaller ids. Null ids neither ask nor answer. Vectors of unequal
    length score over their common components. Repeated rows of one id are the query's own row and one candidate of
    other queries each. An empty table gives no rows. The pivots are those vectors with the smallest id hashes.
    """
    spark = df.sparkSession
    rows = cut(whole_vectors(df, scale=scale, id=id, vector=vector).where("vid is not null"))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(width or 1, 1)
    pivots = pivots or int(min(max(np.sqrt(n), PIVOTS[0]), PIVOTS[1]))
    chosen = rows.orderBy(F.xxhash64("vid"), "vid", "v").limit(pivots).select("v").collect()
    centre = np.zeros((max(len(chosen), 1), width), np.int64)
    for i, r in enumerate(chosen):
        centre[i, : len(r[0])] = r[0]
    shared = spark.sparkContext.broadcast(centre)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, gap = _nearest(matrix(b.column(1), width), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(gap)], names=["vid", "v", "cell", "gap"])

    data = cut(rows.mapInArrow(assign, "vid long, v array<long>, cell int, gap double"))
    asking = F.col("vid") % every == 0
    # a row per pivot; then k + 1 rows per pivot, of distinct ids, which each task cuts to so many before they are shuffled
    n_queries, radius = np.zeros(len(centre), np.int64), np.zeros(len(centre))
    for r in data.where(asking).groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect():
        n_queries[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    near = Window.partitionBy("cell").orderBy("gap", "vid")
    members = data.groupBy("cell", "vid").agg(F.min("gap").alias("gap")).withColumn("i", F.row_number().over(near)).where(F.col("i") <= k + 1)
    gaps: list[list[float]] = [[] for _ in centre]
    for r in members.select("cell", "gap").collect():
        gaps[r["cell"]].append(r["gap"])
    least = bounds(centre, radius, [np.array(g) for g in gaps], k)
    group, parts = grouped(n_queries, centre, QUERY_BLOCK)
    n_groups = len(parts)
    # vectors that a group needs: the same test counts them and then copies them
    plan = spark.sparkContext.broadcast((np.flatnonzero(n_queries), radius, least, group))

    def needed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells, radius, least, group = plan.value
        f = v.astype(np.float64)
        size = np.sqrt((f * f).sum(1)) * (1 + 1e-9)
        most = f @ shared.value[cells].astype(np.float64).T + size[:, None] * radius[cells][None, :] * (1 + 1e-9) + 1e-6
        out = np.zeros((len(v), n_groups), bool)
        for g in range(n_groups):
            mine = group[cells] == g
            out[:, g] = (most[:, mine] >= least[cells[mine]][None, :]).any(axis=1)
        return np.nonzero(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_groups, np.int64)
        for b in batches:
            total += np.bincount(needed(matrix(b.column(0), width))[1], minlength=n_groups)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_groups)), pa.array(total)], names=["g", "n"])

    blocks = np.ones(n_groups, np.int64)
    if n_queries.any():
        for r in data.select("v").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():  # a row per group
            blocks[r["g"]] = max(1, -(-r["n"] // BLOCK))

    def copies(b: pa.RecordBatch, at: np.ndarray, g: np.ndarray, of: np.ndarray, salt: np.ndarray, spread: np.ndarray, order: list[str]) -> pa.RecordBatch:
        """Rows ``at`` for groups ``g``: in the block that the salt names of ``of``, once for each of ``spread``."""
        k = spread[g]
        row = np.repeat(np.arange(len(at)), k)
        each = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
        own = salt[at[row]] % of[g[row]]
        columns = {"g": g[row], order[0]: own, order[1]: each}
        return pa.RecordBatch.from_arrays(
            [*(pa.array(columns[c].astype(np.int32)) for c in ("g", "b", "q")), b.column(0).take(pa.array(at[row])), b.column(1).take(pa.array(at[row]))], names=["g", "b", "q", "vid", "v"]
        )

    def to_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                c = b.slice(i, 1024)
                at, g = needed(matrix(c.column(1), width))
                if len(at):
                    yield copies(c, at, g, blocks, c.column(2).to_numpy(), parts, ["b", "q"])

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = plan.value[3]
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                c = b.slice(i, 1024)
                yield copies(c, np.arange(c.num_rows), group[c.column(3).to_numpy()], parts, c.column(2).to_numpy(), blocks, ["q", "b"])

    salt = F.pmod(F.xxhash64("vid"), F.lit(1 << 30)).alias("salt")
    shape = "g int, b int, q int, vid long, v array<long>"
    have = data.select("vid", "v", salt).mapInArrow(to_groups, shape)
    ask = data.where(asking).select("vid", "v", salt, "cell").mapInArrow(to_blocks, shape)
    found = have.groupBy("g", "b", "q").cogroup(ask.groupBy("g", "b", "q")).applyInArrow(_solver(k, width), "query_id long, vec_id long, copy long, score long")
    # a query's best of all blocks; a repeated query row has asked more than once
    found = found.groupBy("query_id", "vec_id", "copy").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _solver(k: int, width: int):
    """Of one block of vectors and one of queries: each query's k best, as rows. Vectors of one id share a block."""

    def solve(have: pa.Table, ask: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "copy": [], "score": []}
        if have.num_rows and ask.num_rows:
            have, ask = have.combine_chunks(), ask.combine_chunks()
            ids = have["vid"].to_numpy()
            v = matrix(have["v"].combine_chunks(), width)
            order = np.lexsort([*v.T[::-1], ids])  # repeated rows of one id get the same numbers in any run
            ids, v = ids[order], v[order]
            copy = np.arange(len(ids)) - np.searchsorted(ids, ids)
            own, q = ask["vid"].to_numpy(), matrix(ask["v"].combine_chunks(), width)
            mine = np.searchsorted(ids, own, "right") - np.searchsorted(ids, own)  # rows of the query's own id
            for i in range(0, len(own), 256):
                for j, s in enumerate(products(q[i : i + 256], v), i):
                    n = min(len(s), k + int(mine[j]))
                    at = np.flatnonzero(s >= np.partition(s, len(s) - n)[len(s) - n]) if n < len(s) else np.arange(len(s))
                    at = at[ids[at] != own[j]]
                    at = at[np.argsort(-s[at], kind="stable")][:k]  # ids rise, so ties go to smaller ones
                    out["query_id"].append(np.full(len(at), own[j]))
                    out["vec_id"].append(ids[at])
                    out["copy"].append(copy[at])
                    out["score"].append(s[at])
        columns = {name: np.concatenate(x) if x else np.empty(0, np.int64) for name, x in out.items()}
        return pa.table({name: pa.array(x, pa.int64()) for name, x in columns.items()})

    return solve

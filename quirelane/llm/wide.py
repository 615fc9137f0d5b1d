"""Near-duplicates by 512-bit SimHash fingerprints: multi-index hashing without loss.

Fingerprint: 512 bits on which every shingle votes, and the number of shingles as a ninth word. Two texts are near if
their bits differ in at most ``most`` places and the smaller number of shingles is at least 0.8 of the larger, as a
Jaccard similarity of 0.8 requires.

Lookup: bits are cut into segments of about log2(n) bits, whose radii sum to most - segments + 1: by the generalised
pigeonhole principle no pair within ``most`` is lost. Balls of such segments have hundreds of keys, so they aren't
shuffled: a segment is cut again into one part more than its radius, a fingerprint is sent to one cell per part, and the
task that holds a cell enumerates the segment's ball there, fetches what lies at each key, and verifies it in full.

Large groups: in a cell, rows that share a segment are first compared with one leader only. A group that this forms
isn't searched from within, and rows too far from its leader (by the triangle inequality) don't meet its members. Work
is then linear in a group's size, and no pair is lost by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelane.llm.common import as_bytes, extended

SEED = 42
WORDS, BITS = 8, 512
#: Least bits of a segment, and most: cells stay countable.
SEGMENT_BITS = (16, 40)
#: Rows of a cell that a task compares at once; larger cells are dealt out as pairs of blocks.
BLOCK = 1 << 19
#: Keys of balls that are enumerated together, pairs that are verified together, and rows that need no lookup.
KEYS, PAIRS, FEW = 1 << 19, 1 << 18, 32
#: Segments by which leaders are found, and groups (of so many rows at least) that are kept out of the search.
LEADER_SEGMENTS, GROUPS, LEAST_GROUP = 8, 8, 64
#: Factors by which a hash's two words are mixed to eight.
_ODD = [(0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64 | 1 for j in range(WORDS)]


def _numbered(base: np.ndarray) -> np.ndarray:
    """Hashes of which each repeat is hashed again with its number, so that all of a multiset's elements differ."""
    ordered = np.sort(base[:, 0])
    if not (ordered[1:] == ordered[:-1]).any():
        return base
    order = np.argsort(base[:, 0], kind="stable")
    ordered, at = base[order, 0], np.arange(len(base))
    number = at - np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], at, 0))
    again = np.flatnonzero(number)
    out, hashed = base.copy(), xxhash.xxh3_128_digest
    raw = b"".join([hashed(base[i].tobytes(), k) for i, k in zip(order[again].tolist(), number[again].tolist(), strict=True)])
    out[order[again]] = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return out


def fingerprint(text: bytes | None, width: int) -> bytes:
    """512 bits from the shingles' XXH3 and their number, as 72 bytes; null, empty and wordless texts: zeros.

    The first, second and further occurrences of a shingle are elements of their own, each with one vote: the cosine is
    then that of multisets, and a repeated shingle weighs by its number rather than by its square.
    """
    words = (text or b"").lower().split()
    if not words:
        return bytes(8 * (WORDS + 1))
    joined, n = b" ".join(words), len(words)
    ends = [0, *accumulate(len(w) + 1 for w in words)]
    hashed = xxhash.xxh3_128_digest
    raw = b"".join([hashed(joined[s : e - 1], SEED) for s, e in zip(ends, ends[min(width, n) :], strict=False)])
    base = _numbered(np.frombuffer(raw, "<u8").reshape(-1, 2))
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(base), 255):  # sums of so many bits fit a byte
        part = base[i : i + 255]
        h = np.empty((len(part), WORDS), np.uint64)
        for j in range(WORDS):  # further words are mixed from the hash's two
            x = part[:, j % 2] * np.uint64(_ODD[j])
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            h[:, j] = x ^ (x >> np.uint64(32))
        votes += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(base), bitorder="little").tobytes() + len(base).to_bytes(8, "little")


def add_fingerprints(df: DataFrame, *, width: int, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the fingerprint as ``bits``, and its hash as ``node``."""
    schema = extended(df.select(*keep).schema, "node long, bits binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [fingerprint(t, width) for t in as_bytes(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names_of(bits)), pa.array(bits, pa.binary())], names=schema.names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def names_of(fingerprints: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in fingerprints], np.uint64).view(np.int64)


Segment = tuple[int, int, int]  # first bit, bits, radius
Part = tuple[int, int, int, tuple[int, ...]]  # a segment and the edges of its parts up to this one


def plan_segments(n: int, most: int) -> list[Segment]:
    """Disjoint segments for ``n`` fingerprints, about log2(n) bits each; no pair within ``most`` bits is lost."""
    low, high = SEGMENT_BITS
    m = BITS // min(max(n, 2).bit_length() if n > 1 << low else low, high)
    total = max(most - m + 1, 0)
    edges = [BITS * i // m for i in range(m + 1)]
    return [(edges[i], edges[i + 1] - edges[i], total // m + (i < total % m)) for i in range(m)]


def parts_of(plan: list[Segment]) -> list[Part]:
    """Each segment cut into one part more than its radius: segments within the radius agree in one of their parts."""
    out = []
    for first, size, radius in plan:
        edges = [size * i // (radius + 1) for i in range(radius + 2)]
        out += [(first, size, radius, tuple(edges[: i + 2])) for i in range(radius + 1)]
    return out


def _slice(bits: np.ndarray, first: int, size: int) -> np.ndarray:
    """Bits first to first + size of every row, as numbers."""
    word, shift = divmod(first, 64)
    out = bits[:, word] >> np.uint64(shift)
    if shift + size > 64:
        out = out | (bits[:, word + 1] << np.uint64(64 - shift))
    return (out & np.uint64((1 << size) - 1)).astype(np.int64)


def _part_width(part: Part) -> int:
    return part[3][-1] - part[3][-2]


def first_cells(parts: list[Part]) -> list[int]:
    """The number of each part's first cell, and at the end the number of cells."""
    return [0, *accumulate(1 << _part_width(p) for p in parts)]


def cells_of(bits: np.ndarray, parts: list[Part]) -> np.ndarray:
    """[part, row]: the cell that the part's value names."""
    at = first_cells(parts)
    return np.stack([at[i] + _slice(bits, p[0] + p[3][-2], _part_width(p)) for i, p in enumerate(parts)])


def _words(column: pa.Array) -> np.ndarray:
    """A row of words for each fingerprint; all have one length."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty((0, WORDS + 1), np.uint64)
    wide = pa.types.is_large_binary(column.type)
    first = int(np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset])
    return np.frombuffer(data, np.uint8, len(column) * 8 * (WORDS + 1), first).view("<u8").reshape(-1, WORDS + 1)


@lru_cache(maxsize=64)
def _ball(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)], np.int64)


class Cell:
    """The rows of one cell, and the groups that have been found among them."""

    def __init__(self, bits: np.ndarray, most: int) -> None:
        self.most = most
        self.half = [np.ascontiguousarray(bits[:, k : k + WORDS // 2]) for k in (0, WORDS // 2)]
        self.size = bits[:, WORDS].astype(np.int64)
        self.label = np.arange(len(bits))

    def distance(self, k: int, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        c = np.bitwise_count(self.half[k][a] ^ self.half[k][b])
        return (c[:, 0] + c[:, 1]).astype(np.int64) + (c[:, 2] + c[:, 3])

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs are near."""
        x, y = self.size[a], self.size[b]
        at = np.flatnonzero((5 * x >= 4 * y) & (5 * y >= 4 * x))
        d = self.distance(0, a[at], b[at])
        at, d = at[d <= self.most], d[d <= self.most]
        return at[d + self.distance(1, a[at], b[at]) <= self.most]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the groups of rows a and b: a group's label is its first row."""
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            on = x != y
            a, b, x, y = a[on], b[on], x[on], y[on]
            to = np.arange(len(label))
            np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
            while (to[to] != to).any():
                to = to[to]
            self.label = label = to[label]

    def verify(self, a: np.ndarray, b: np.ndarray) -> None:
        on = self.label[a] != self.label[b]
        a, b = a[on], b[on]
        if len(a):
            on = self.near(a, b)
            self.join(a[on], b[on])


class _Index:
    """Rows by the bits of a segment outside the part that they share."""

    def __init__(self, rows: np.ndarray, rest: np.ndarray, free: int) -> None:
        rest = rest[rows]
        order = np.argsort(rest, kind="stable")
        self.rows, self.rest, self.free = rows[order], rest[order], free
        self.dense = free <= 20
        if self.dense:
            count = np.bincount(self.rest, minlength=1 << free)
            self.edge = np.r_[0, np.cumsum(count)]

    def range(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.dense:
            return self.edge[key], self.edge[key + 1]
        return np.searchsorted(self.rest, key), np.searchsorted(self.rest, key, "right")


def _search(cell: Cell, rows: np.ndarray, rest: np.ndarray, index: _Index, deltas: np.ndarray, within: bool) -> None:
    """Verify ``rows`` against all of the index in the ball around each; ``within``: these are the index's own rows."""
    step = max(1, KEYS // max(1, len(deltas)))
    for top in range(0, len(rows), step):
        at = np.arange(top, min(top + step, len(rows)))
        own = rest[rows[at]]
        other = own[:, None] ^ deltas[None, :]
        first, end = index.range(other.ravel())
        if within:  # each pair once: keys above the row's own, and later rows of its own key
            place = np.repeat(at, len(deltas))
            above, same = (other > own[:, None]).ravel(), (other == own[:, None]).ravel()
            first = np.where(same, place + 1, first)
            many = np.where(above | same, end - first, 0)
        else:
            many = end - first
        live = np.flatnonzero(many)
        many, first, row = many[live], first[live], rows[at[live // len(deltas)]]
        done = np.cumsum(many)
        s = 0
        while s < len(many):
            e = max(s + 1, int(np.searchsorted(done, (done[s - 1] if s else 0) + PAIRS, "right")))
            m = many[s:e]
            a = np.repeat(row[s:e], m)
            b = index.rows[np.repeat(first[s:e] - (np.cumsum(m) - m), m) + np.arange(len(a))]
            cell.verify(a, b)
            s = e


def match(part: Part, plan: list[Segment], bits: np.ndarray, most: int) -> np.ndarray:
    """Labels of a cell's rows: equal for those that near pairs connect, as far as this part finds them."""
    cell = Cell(bits, most)
    n = len(bits)
    if n <= FEW:
        cell.verify(*np.triu_indices(n, 1))
        return cell.label
    # rows that share a segment meet its first row
    step = max(1, len(plan) // LEADER_SEGMENTS)
    for first, size, _ in plan[::step]:
        value = _slice(bits, first, size)
        order = np.argsort(value, kind="stable")
        lead = np.maximum.accumulate(np.where(np.r_[True, value[order[1:]] != value[order[:-1]]], np.arange(n), 0))
        cell.verify(order, order[lead])
    # large groups: all rows meet the leader; those near enough to reach a member are kept for a search
    reach: list[tuple[np.ndarray, np.ndarray]] = []
    everything = np.arange(n)
    for _ in range(GROUPS):
        count = np.bincount(cell.label, minlength=n)
        for members, _ in reach:
            count[cell.label[members[0]]] = 0
        lead = int(count.argmax())
        if count[lead] < LEAST_GROUP:
            break
        d = cell.distance(0, everything, np.full(n, lead)) + cell.distance(1, everything, np.full(n, lead))
        cell.verify(np.flatnonzero(d <= most), np.full(int((d <= most).sum()), lead))
        mine = cell.label == cell.label[lead]
        reach.append((np.flatnonzero(mine), np.flatnonzero(~mine & (d <= most + d[mine].max()))))
    first, size, radius, edges = part
    low, high = edges[-2:]
    own = _slice(bits, first, size)
    rest = (own >> high << low) | (own & ((1 << low) - 1))
    free = size - (high - low)
    deltas = _ball(free, radius)
    for a, b in zip(edges[:-2], edges[1:-1], strict=True):  # what agrees in an earlier part is left to that part
        deltas = deltas[deltas >> a & ((1 << (b - a)) - 1) != 0]
    alone = np.ones(n, bool)
    for members, _ in reach:
        alone[members] = False
    for members, others in reach:
        if len(others):
            _search(cell, others, rest, _Index(members, rest, free), deltas, False)
    index = _Index(np.flatnonzero(alone), rest, free)
    _search(cell, index.rows, rest, index, deltas, True)
    return cell.label


def links(fps: DataFrame, plan: list[Segment], most: int, *, block: int = BLOCK) -> DataFrame:
    """(src, dst): links whose components are those of all near pairs of ``fps`` (node, bits), which should be materialised.

    Fingerprints must be distinct. Each task links the rows of each group in a cell to its smallest node, so a group's
    links are as many as its rows and mostly the same in all cells.
    """
    parts, starts = parts_of(plan), np.array(first_cells(parts_of(plan)))
    n_cells = int(starts[-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_cells, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(cells_of(_words(b.column(0)), parts).ravel(), minlength=n_cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    # a row for each cell of the plan with over ``block`` rows, whatever the input
    hot = fps.select("bits").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > block).collect()
    blocks = fps.sparkSession.sparkContext.broadcast({r["cell"]: -(-r["n"] // block) for r in hot})

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                column = b.column(0).slice(i, 512)
                bits = _words(column)
                cell = cells_of(bits, parts).ravel()
                row = np.tile(np.arange(len(bits)), len(parts))
                unit = np.zeros(len(cell), np.int32)
                if blocks.value:
                    # a row of block i goes to every unit {i, j}; all pairs of blocks meet in exactly one unit
                    k = np.array([blocks.value.get(c, 1) for c in cell.tolist()])
                    own = (names_of(column.to_pylist()).view(np.uint64)[row] % k.astype(np.uint64)).astype(np.int64)
                    at = np.repeat(np.arange(len(cell)), k)
                    j = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
                    cell, row, k, own = cell[at], row[at], k[at], own[at]
                    unit = (np.minimum(own, j) * k + np.maximum(own, j)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(unit), column.take(pa.array(row))], names=["cell", "unit", "bits"])

    rows = fps.select("bits").mapInArrow(enter, "cell long, unit int, bits binary")
    rows = rows.repartition("cell", "unit").sortWithinPartitions("cell", "unit")

    def solve(cell: int, kept: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        bits = np.concatenate([_words(x) for x in kept])
        if len(bits) < 2:
            return
        label = match(parts[int(np.searchsorted(starts, cell, "right")) - 1], plan, bits, most)
        grouped = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
        if len(grouped):
            node = names_of([x.tobytes() for x in bits[grouped]])
            least = np.full(len(label), np.iinfo(np.int64).max)
            np.minimum.at(least, label[grouped], node)
            to = least[label[grouped]]
            yield pa.RecordBatch.from_arrays([pa.array(node[node != to]), pa.array(to[node != to])], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Array] = []  # rows of a cell's unit that may go on in the next batch
        here: tuple[int, int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cell, unit = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (unit[1:] != unit[:-1])) + 1).tolist(), len(cell)]
            for s, e in zip(edges, edges[1:], strict=False):
                if here != (now := (int(cell[s]), int(unit[s]))):
                    if here:
                        yield from solve(here[0], kept)
                    here, kept = now, []
                kept.append(b.column(2).slice(s, e - s))
        if here:
            yield from solve(here[0], kept)

    return rows.mapInArrow(run, "src long, dst long")

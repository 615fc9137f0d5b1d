"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by multi-index hashing.

Fingerprint: every shingle's XXH64 votes on 64 bits; a bit is set if over half of the shingles set it.

Links: fingerprints are cut into segments. By the generalised pigeonhole principle two fingerprints at distance r or
less agree to within r_i bits in some segment i, for any radii that sum to r - segments + 1. Each fingerprint is entered
in one table per segment and probes the small Hamming ball around its segment; the complete distance of every match is
then verified. A pair is probed from one side only: the ball holds only keys above the fingerprint's own.

Nothing is all-pairs: a bucket is matched table against probes, its links leave the task as a spanning forest, and a
bucket with very many fingerprints is dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelane.llm import wide
from quirelane.llm.common import as_bytes, extended
from quirelane.llm.components import connected_components
from quirelane.session import cut

BITS = 64
SEED = 42
#: Fingerprints of one bucket's table that a task compares at once; larger buckets are dealt out as pairs of blocks.
BLOCK = 4096
#: Hot buckets that may be broadcast (a key, a count and a row's overhead: under 10 MB); more are joined by shuffle.
BROADCAST_BUCKETS = 100_000
#: Up to so many fingerprints, three segments keep buckets small for r = 4; beyond, two longer ones with larger balls do.
SHORT_SEGMENTS_UP_TO = 1 << 26


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; fewer words: of the whole sequence; none: empty."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    out = [hashed(joined[:ends[width - 1] - 1], SEED)]
    out += [hashed(joined[s : e - 1], SEED) for s, e in zip(ends, ends[width:], strict=False)]
    return np.array(out, np.uint64)


def fingerprint(text: bytes | None, width: int) -> int:
    """Unsigned fingerprint; null and empty texts: zero."""
    h = shingle_hashes(text or b"", width)
    if not len(h):
        return 0
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def add_fingerprints(df: DataFrame, *, width: int, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the fingerprint's bytes, lowest first, as ``bits``, and itself, signed, as ``node``."""
    schema = extended(df.select(*keep).schema, "node long, bits binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(b.num_columns - 1))
            bits = [fingerprint(t, width).to_bytes(8, "little") for t in texts]
            node = np.array([int.from_bytes(x, "little") for x in bits], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(node), pa.array(bits, pa.binary())], names=schema.names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def hex_of(fp) -> F.Column:
    """16 lower-case hex digits of a fingerprint held as a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


Segment = tuple[int, int, int, int]  # word, shift, bits, radius


def plan_segments(r: int, n: int) -> list[Segment]:
    """Segments of one word; their radii sum to r - segments + 1, so no pair within r is lost."""
    m = r // 2 + 1
    if r > 2 and n > SHORT_SEGMENTS_UP_TO:
        m = (r + 2) // 3  # radii of up to two
    total, shift, out = r - m + 1, 0, []
    for i in range(m):
        bits = BITS // m + (i < BITS % m)
        out.append((0, shift, bits, total // m + (i < total % m)))
        shift += bits
    return out


def _ball(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(1, radius + 1) for c in combinations(range(bits), k)], np.uint64)


def _words(column: pa.Array) -> np.ndarray:
    """Rows of 64-bit words of a column of fingerprints of one length."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u8").reshape(len(rows), -1)


def _probes(bits: np.ndarray, plan: list[Segment]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, row): entry holds segment number, key and, as its lowest bit, whether it probes."""
    keys, owners = [], []
    here = np.arange(len(bits))
    for i, (word, shift, size, radius) in enumerate(plan):
        own = (bits[:, word] >> np.uint64(shift)) & np.uint64((1 << size) - 1)
        tag = np.uint64(i << (size + 1)) if size < 56 else np.uint64(0)
        keys.append((own << np.uint64(1)) | tag)
        owners.append(here)
        if radius:
            near = own[:, None] ^ _ball(size, radius)[None, :]
            row, col = np.nonzero(near > own[:, None])
            keys.append((near[row, col] << np.uint64(1)) | tag | np.uint64(1))
            owners.append(row)
    return np.concatenate(keys), np.concatenate(owners)


class _Forest:
    """Union-find over fingerprints; keeps the links that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def _match(entry: np.ndarray, node: np.ndarray, bits: np.ndarray, most: int, forest: _Forest) -> None:
    """Link what lies within ``most`` bits in each bucket of rows sorted by entry, the table's rows first."""

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= most

    key, probe = entry >> np.uint64(1), (entry & np.uint64(1)).astype(bool)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    held = np.add.reduceat((~probe).astype(np.int64), first)
    # only buckets with a table row and another row can hold a link
    live = (held > 0) & (size > 1)
    first, size, held = first[live], size[live], held[live]
    small = held <= 32
    f, s, h = first[small], size[small], held[small]
    for d in range(int(h.max(initial=0))):
        on = h > d
        f, s, h = f[on], s[on], h[on]
        later = s - d - 1  # rows after the d-th of each bucket
        at = np.repeat(f + d, later)
        other = at + 1 + np.arange(len(at)) - np.repeat(np.cumsum(later) - later, later)
        hit = near(bits[at], bits[other])
        for a, b in zip(node[at[hit]].tolist(), node[other[hit]].tolist(), strict=True):
            forest.link(a, b)
    for start, n, t in zip(first[~small].tolist(), size[~small].tolist(), held[~small].tolist(), strict=True):
        group, names = bits[start : start + n], node[start : start + n].tolist()
        label = np.arange(n)
        for d in range(t):
            hit = np.flatnonzero(near(group[d + 1 :], group[d])) + d + 1
            hit = hit[label[hit] != label[d]]
            if len(hit):
                new, at = np.unique(label[hit], return_index=True)
                for b in hit[at].tolist():
                    forest.link(names[d], names[b])
                label[np.isin(label, new)] = label[d]


def links(fps: DataFrame, plan: list[Segment], most: int, *, block: int = BLOCK) -> DataFrame:
    """A spanning forest's worth of links (src, dst) between nodes whose bits differ in at most ``most`` places.

    ``fps`` (node, bits) has a row per fingerprint and should be materialised. Each task gives every link that joins two
    of its trees, so the components of the result are those of all links that the plan's segments find.
    """
    names = ["entry", "node", "bits"]

    def enter(plan: list[Segment], whole: bool = True):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 2048):
                    node, bits = (b.column(k).slice(i, 2048) for k in (0, 1))
                    entry, row = _probes(_words(bits), plan)
                    columns = [pa.array(entry.view(np.int64))]
                    if whole:
                        row = pa.array(row)
                        columns += [node.take(row), bits.take(row)]
                    yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

        return run

    key = F.expr("shiftrightunsigned(entry, 1)").alias("key")
    fps = fps.select("node", "bits")
    rows = fps.mapInArrow(enter(plan), "entry long, node long, bits binary").select(key, "*")
    plain = [(word, shift, size, 0) for word, shift, size, _ in plan]
    held = fps.mapInArrow(enter(plain, False), "entry long").groupBy(key).count()
    hot = cut(held.where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    n_hot = hot.count()
    unit = F.lit(0)
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_BUCKETS else hot, "key", "left")
        # a row of block i goes to every unit {i, j}; all pairs of blocks meet in exactly one unit
        i, n = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.col("blocks")
        units = F.when(n.isNull(), F.array(F.lit(0))).otherwise(
            F.transform(F.sequence(F.lit(0), n - 1), lambda j: (F.least(i, j) * n + F.greatest(i, j)).cast("int"))
        )
        rows, unit = rows.withColumn("unit", F.explode(units)), F.col("unit")
    rows = rows.select("key", unit.cast("int").alias("unit"), "entry", "node", "bits")
    rows = rows.repartition("key", "unit").sortWithinPartitions("key", "unit", "entry", "node")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []  # rows of a bucket that may go on in the next batch

        def whole() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*kept, strict=True)]

        for b in batches:
            if not b.num_rows:
                continue
            got = [*(b.column(i).to_numpy() for i in range(4)), _words(b.column(4))]
            key, unit = got[0], got[1]
            if kept and (kept[-1][0][-1] != key[0] or kept[-1][1][-1] != unit[0]):
                yield from solve(whole())
                kept.clear()
            last = np.flatnonzero((key != key[-1]) | (unit != unit[-1]))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                kept.append([x[:end] for x in got])
                yield from solve(whole())
                kept.clear()
            kept.append([x[end:] for x in got])
        if kept:
            yield from solve(whole())

    def solve(got: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        # number the buckets of one key and unit; the lowest bit says whether a row probes
        new = np.r_[False, (got[0][1:] != got[0][:-1]) | (got[1][1:] != got[1][:-1])]
        entry = (np.cumsum(new).astype(np.uint64) << np.uint64(1)) | (got[2].view(np.uint64) & np.uint64(1))
        _match(entry, got[3], got[4], most, forest)
        if forest.links:
            pairs = np.array(forest.links, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    return rows.mapInArrow(match, "src long, dst long")


def _components(per: DataFrame, found: DataFrame) -> DataFrame:
    """(_node, component), materialised: of each fingerprint in ``per`` (node, least), the smallest id that its links reach."""
    comp = connected_components(found).withColumnRenamed("node", "_at")
    # a root may stand for very many fingerprints: both sides are plain tables, so that adaptive execution may split it
    per = cut(per.join(comp, F.col("node") == F.col("_at"), "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    named = cut(per.groupBy("root").agg(F.min("least").alias("component")))
    return cut(per.join(named, "root").select(F.col("node").alias("_node"), "component"))


def near_duplicates(df: DataFrame, *, width: int = 4, r: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component): each row's fingerprint and the smallest id that its links reach.

    Null and empty texts and texts without words have fingerprint zero and are linked like any other. Null ids are
    passed on and never are a component's id, which is null only if all its rows' ids are. Repeated rows share a
    fingerprint; other columns of ``df`` are not used, whatever their names. An empty table gives no rows.
    """
    marked = cut(add_fingerprints(df, width=width, keep=[id], text=text))
    per = cut(marked.groupBy("node", "bits").agg(F.min(id).alias("least")))
    named = _components(per, links(per, plan_segments(r, per.count()), r))
    return marked.join(named, F.col("node") == F.col("_node")).select(id, F.col("node").alias("fp"), "component")


#: For keep_one: five words, and as many of 512 bits as differ at a Jaccard similarity of 0.8 (angle over pi, cosine
#: 8/9: 78) and one and a half standard deviations of that number (8), so that 14 of 15 such pairs lie within.
WIDTH, NEAR = 5, 90


def keep_one(df: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each near-duplicate group: that with the smallest id. All columns stay.

    Near: a Jaccard similarity of 0.8 or more between multisets of five-word shingles, as estimated by 512 fingerprint
    bits; all pairs within NEAR bits are found. Rows without an id take no part and stay; of repeated rows of one id and
    group one stays. Texts without words are one group.
    """
    marked = cut(wide.add_fingerprints(df.where(F.col(id).isNotNull()), width=WIDTH, keep=[id], text=text))
    per = cut(marked.groupBy("node", "bits").agg(F.min(id).alias("least")))
    named = _components(per, wide.links(per, wide.plan_segments(per.count(), NEAR), NEAR))
    keepers = named.groupBy(F.col("component").alias("__keep")).agg(F.lit(1).alias("__one"))
    kept = df.join(keepers.select("__keep"), F.col(f"`{id}`") == F.col("__keep"), "left_semi")
    repeated = marked.join(keepers, F.col(id) == F.col("__keep"), "left_semi").groupBy(id).count().where("count > 1")
    if repeated.limit(1).count():
        again = cut(repeated.select(F.col(id).alias("__again")))
        once = kept.join(again, F.col(f"`{id}`") == F.col("__again"), "left_anti")
        kept = once.unionByName(kept.join(again, F.col(f"`{id}`") == F.col("__again"), "left_semi").dropDuplicates([id]))
    return kept.unionByName(df.where(F.col(id).isNull()))

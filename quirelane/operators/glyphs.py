"""Characters of codes through a chain of lookups, and shapes by their hashes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Confidence of each level of the chain.
LEVELS = {"map": 1.0, "encoding": 0.9, "fingerprint": 0.85, "shape": 0.7, "none": 0.0}
UNKNOWN = "�"


def resolve(codes: DataFrame, maps: DataFrame, encodings: DataFrame, glyph_names: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Codes (font_id, font_hash, code, glyph_id) with text, source and confidence of the first level that knows them.

    maps (font_id, code, text); encodings (font_id, code, glyph_name); glyph_names (glyph_name, text);
    fingerprints (font_hash, glyph_id, text). All are equi joins, so tables of any size do.
    """
    m = maps.select("font_id", "code", F.col("text").alias("t1"))
    e = encodings.join(glyph_names, "glyph_name").select("font_id", "code", F.col("text").alias("t2"))
    f = fingerprints.select("font_hash", "glyph_id", F.col("text").alias("t3"))
    j = codes.join(m, ["font_id", "code"], "left").join(e, ["font_id", "code"], "left").join(f, ["font_hash", "glyph_id"], "left")
    source = F.when(F.col("t1").isNotNull(), "map").when(F.col("t2").isNotNull(), "encoding").when(F.col("t3").isNotNull(), "fingerprint").otherwise("none")
    level = F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))
    return j.withColumns({"text": F.coalesce("t1", "t2", "t3", F.lit(UNKNOWN)), "source": source}).withColumn("confidence", level[F.col("source")]).drop("t1", "t2", "t3")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Known hashes in a block, and hashes of shapes in a shard: a task holds one of each. Pairs that a task compares at once.
BLOCK, SHARD, PAIRS = 1 << 20, 1 << 16, 1 << 21
#: Most bits of a segment, whose values index a block's hashes directly.
SEGMENT_BITS = 20


def _segments(known: np.ndarray) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """(bits, order, starts) of each segment: of the bits in which known hashes differ, about as many as tell them apart.

    Hashes that agree in all of a segment's bits lie side by side in ``order``, from ``starts[value]`` on.
    """
    differing = int(np.bitwise_or.reduce(known) ^ np.bitwise_and.reduce(known))
    bits = [i for i in range(64) if differing >> i & 1]
    width = min(max(int(len(known)).bit_length(), 4), SEGMENT_BITS)
    n = max(1, round(len(bits) / width), -(-len(bits) // SEGMENT_BITS))
    out = []
    for own in (bits[i::n] for i in range(n)):
        value = _value(known, own)
        out.append((own, np.argsort(value, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << len(own)))])))
    return out


def _value(hashes: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(hashes), np.int64)
    for at, bit in enumerate(bits):
        out |= (hashes >> np.uint64(bit) & np.uint64(1)).astype(np.int64) << at
    return out


def nearest_of(hashes: np.ndarray, known: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, place in ``known``) of the nearest known hash of each hash; beyond ``most`` the distance is ``most`` + 1.

    Both are uint64; ``known`` has no two equal hashes and is in the order that decides ties. For distances from 0 up, hashes
    that have none as near look at all known hashes within a few bits in some segment: of n segments whose radii sum
    to the distance less n - 1, one lies within its radius. So a hash meets few others, and one that is found meets no more.
    """
    best = np.full(len(hashes), (most + 1) * len(known), np.int64)  # distance, then place
    if not len(known) or not len(hashes):
        return np.full(len(hashes), most + 1), np.zeros(len(hashes), np.int64)
    segments = _segments(known)
    values = [_value(hashes, bits) for bits, _, _ in segments]
    done = [-1] * len(segments)
    for distance in range(most + 1):
        total = distance - len(segments) + 1
        for i, (bits, order, starts) in enumerate(segments):
            radius = total // len(segments) + (i < total % len(segments)) if total >= 0 else (0 if i <= distance else -1)
            # the pairs that are met grow with the radius; those within a smaller one were met before
            for weight in range(done[i] + 1, min(radius, len(bits)) + 1):
                left = np.flatnonzero(best >= distance * len(known))
                for flips in combinations(range(len(bits)), weight):
                    at = values[i][left] ^ sum(1 << f for f in flips)
                    _meet(hashes, known, left, starts[at], starts[at + 1], order, best)
            done[i] = max(done[i], radius)
    return best // len(known), best % len(known)


def _meet(hashes: np.ndarray, known: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray, order: np.ndarray, best: np.ndarray) -> None:
    """Lowers ``best`` of the hashes ``left`` by the known ones from ``lo`` to ``hi`` of ``order``, ``PAIRS`` or so at once."""
    some = np.flatnonzero(hi > lo)
    left, lo, count = left[some], lo[some], (hi - lo)[some]
    ends = np.cumsum(count)
    first = 0
    while first < len(left):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        n = count[first:last]
        begin = np.cumsum(n) - n
        place = order[np.arange(int(n.sum())) + np.repeat(lo[first:last] - begin, n)]
        pair = np.bitwise_count(known[place] ^ np.repeat(hashes[left[first:last]], n)).astype(np.int64) * len(known) + place
        best[left[first:last]] = np.minimum(best[left[first:last]], np.minimum.reduceat(pair, begin))
        first = last


def nearest_shape(shapes: DataFrame, known: DataFrame, most: int = 8) -> DataFrame:
    """Shapes (shape_id, hash) with the known shape of least Hamming distance, at most ``most``; ties to the smaller hash.

    Distinct hashes of shapes are dealt to shards, those of known shapes to blocks; a task finds the nearest of one block for
    one shard by ``nearest_of``, and the best block decides. Known hashes are copied once a shard, packed.
    """
    own = shapes.where("hash IS NOT NULL").select("hash").distinct()
    of = known.where("hash IS NOT NULL").groupBy("hash").agg(F.min("text").alias("text"))
    cores = shapes.sparkSession.sparkContext.defaultParallelism
    shards, blocks = max(2 * cores, -(-own.count() // SHARD)), -(-of.count() // BLOCK)
    # hashes are dealt by a hash of their own, so neighbours and runs spread
    a = own.select("hash", F.pmod(F.xxhash64("hash"), F.lit(shards)).cast("int").alias("shard")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    b = of.select("hash", F.pmod(F.xxhash64("hash"), F.lit(max(blocks, 1))).cast("int").alias("block")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts = max(blocks, 1) * shards
    dealt = lambda df: df.repartition(parts, "shard", "block").groupBy("shard", "block")

    def find(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        known = np.sort(b["hash"].to_numpy(np.int64))
        hashes = a["hash"].to_numpy(np.int64)
        distance, place = nearest_of(hashes.view(np.uint64), known.view(np.uint64), most)
        near = distance <= most
        return pd.DataFrame({"hash": hashes[near], "known_hash": known[place[near]], "distance": distance[near].astype(np.int32)})

    found = dealt(a).cogroup(dealt(b)).applyInPandas(find, "hash long, known_hash long, distance int")
    found = found.groupBy("hash").agg(F.min_by("known_hash", F.struct("distance", "known_hash")).alias("known_hash"), F.min("distance").alias("distance"))
    pairs = shapes.select("shape_id", "hash").join(found, "hash").join(of.withColumnRenamed("hash", "known_hash"), "known_hash")
    best = pairs.groupBy("shape_id").agg(F.min_by(F.struct("known_hash", "text", "distance"), F.struct("distance", "known_hash")).alias("b"))
    return best.select("shape_id", "b.known_hash", "b.text", "b.distance")


def perceptual_hash(bitmap: np.ndarray) -> int:
    """64 bits of a square bitmap: low-frequency cosine parts against their median."""
    n = bitmap.shape[0]
    k, x = np.arange(8)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    parts = basis @ bitmap.astype(np.float64) @ basis.T
    bits = (parts > np.median(parts.ravel()[1:])).ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def perceptual_hashes(shapes: DataFrame, bitmap: str = "bitmap", name: str = "hash") -> DataFrame:
    """``shapes`` with the hash of each square bitmap, an array of its rows' points; null for null and for what isn't square.

    Bitmaps of one size are transformed together, in Arrow batches.
    """
    kept = [c for c in shapes.columns if c != bitmap]
    schema = StructType([*(shapes.schema[c] for c in kept), StructField(name, LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [None] * len(pdf)
            for i, points in enumerate(pdf[bitmap]):
                side = 0 if points is None else int(len(points) ** 0.5)
                if side > 7 and side * side == len(points):
                    h = perceptual_hash(np.asarray(points, np.float64).reshape(side, side))
                    out[i] = h - (1 << 64) if h >> 63 else h
            yield pdf[kept].assign(**{name: pd.array(out, "Int64")})

    return shapes.select(*kept, bitmap).mapInPandas(run, schema)


def rgb(kind: Column, parts: Column) -> Column:
    """#rrggbb of gray, RGB or CMYK parts from 0 to 1, to eight bits; other kinds are null."""
    p = lambda i: F.element_at(parts, i)
    byte = lambda v: F.lower(F.lpad(F.hex(F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5)), 2, "0"))
    hexed = lambda a, b, c: F.concat(F.lit("#"), byte(a), byte(b), byte(c))
    ink = lambda i: (1 - p(i)) * (1 - p(4))
    return F.when(kind == "gray", hexed(p(1), p(1), p(1))).when(kind == "rgb", hexed(p(1), p(2), p(3))).when(kind == "cmyk", hexed(ink(1), ink(2), ink(3)))


def font_kind(subtype: Column) -> Column:
    return (
        F.when(subtype.isin("Type1", "MMType1"), "type1")
        .when(subtype == "TrueType", "truetype")
        .when(subtype == "Type0", "composite")
        .when(subtype == "Type3", "type3")
        .otherwise("unknown")
    )


def source_confidence(source: Column, corrected: Column) -> Column:
    """native, heuristic or ocr of an internal source; a corrected native text is heuristic."""
    group = F.when(source.isin("map", "encoding"), "native").when(source.isin("fingerprint", "shape", "none"), "heuristic").otherwise("ocr")
    return F.when(corrected & (group == "native"), "heuristic").otherwise(group)

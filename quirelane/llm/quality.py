"""Quality rules: counted base rules, then a log-likelihood ratio of hashed n-grams.

Every text is scored by the mean, over its byte 4-grams hashed to buckets, of log(p_target / p_raw). The raw multinomial
counts every document of the corpus; the target multinomial counts trusted documents, all that are labelled good. The
threshold is fitted to the scores of all labelled documents, and then decides every document alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelane.llm.common import as_bytes, extended
from quirelane.session import cut

#: Buckets of hashed n-grams: the size of the model, and of what a task adds to the counts.
BUCKETS = 1 << 16
#: Log-ratios are multiples of 1 / UNIT, so sums of them are exact: equal texts score alike whatever they are scored with.
UNIT = 1 << 24
#: Documents whose bytes are hashed at once; longer texts are taken in pieces of this size.
CHUNK = 1 << 20
WINDOW = 8
GOOD_WEIGHT = 4
_SYMBOLS = b"#*$%&|<>"


def buckets_of(data: np.ndarray) -> np.ndarray:
    """Bucket of the 4-gram at each byte but the last three."""
    x = data.astype(np.uint32)
    code = x[:-3] | (x[1:-2] << np.uint32(8)) | (x[2:-1] << np.uint32(16)) | (x[3:] << np.uint32(24))
    code *= np.uint32(2654435761)  # wraps
    return code >> np.uint32(16)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes of some whole texts, their lengths), or pieces of one long text that overlap by three bytes."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > CHUNK:
            data = np.frombuffer(texts[i], np.uint8)
            for at in range(0, len(data) - 3, CHUNK):
                part = data[at : at + CHUNK + 3]
                yield i, part, np.array([len(part)])
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= CHUNK:
            size += len(texts[j])
            j += 1
        yield i, np.frombuffer(b"".join(texts[i:j]), np.uint8), np.array([len(t) for t in texts[i:j]])
        i = j


def _last_three(lengths: np.ndarray, size: int) -> np.ndarray:
    """Places whose 4-gram would run over the end of their text, of those that have a code at all."""
    ends = np.cumsum(lengths)
    at = (ends[:, None] - np.arange(1, 4)[None, :]).ravel()
    starts = np.repeat(ends - lengths, 3)
    at = at[at >= starts]
    return at[at < size]


def scores(texts: list[bytes], ratios: np.ndarray) -> np.ndarray:
    """Mean log-ratio of each text's 4-grams; 0 for texts of under four bytes."""
    total = np.zeros(len(texts))
    for first, data, lengths in _chunks(texts):
        if len(data) < 4:
            continue
        values = ratios[buckets_of(data)]
        values[_last_three(lengths, len(values))] = 0
        sums = np.r_[0.0, np.cumsum(values)]
        ends = np.minimum(np.cumsum(lengths), len(values))
        starts = np.minimum(np.cumsum(lengths) - lengths, len(values))
        total[first : first + len(lengths)] += sums[ends] - sums[starts]
    n = np.array([max(len(t) - 3, 1) for t in texts], np.float64)
    return total / n


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray
    threshold: float


def best_threshold(labelled: DataFrame) -> float:
    """The cut with the largest weighted sum of kept good and rejected bad shares, in the middle of the widest such gap.

    ``labelled`` has a quality, 0 or 1, and a score for each document. Losing a good document weighs ``GOOD_WEIGHT`` times
    as much as keeping a bad one. Without bad documents nothing is rejected; without good ones the cut is 0, where both
    multinomials agree.
    """
    values = labelled.groupBy("score").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    values = cut(values.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    # what lies below each range of scores: a row for each range
    parts = values.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("last")).collect()
    below, good, bad, last = [], 0, 0, None
    for p in sorted(parts):
        below.append((p["part"], good, bad, last))
        good, bad, last = good + p["good"], bad + p["bad"], p["last"]
    if not bad:
        return -np.inf
    if not good:
        return 0.0
    ranges = labelled.sparkSession.createDataFrame(below, "part int, good_below long, bad_below long, last double")
    ordered = Window.partitionBy("part").orderBy("score")
    under = ordered.rowsBetween(Window.unboundedPreceding, -1)
    placed = values.join(F.broadcast(ranges), "part").select(
        "score",
        (F.col("good_below") + F.coalesce(F.sum("good").over(under), F.lit(0))).alias("lost"),
        (F.col("bad_below") + F.coalesce(F.sum("bad").over(under), F.lit(0))).alias("rejected"),
        F.coalesce(F.lag("score").over(ordered), "last").alias("last"),
    )
    middle = (F.col("score") + F.col("last")) / 2
    # shares over their common denominator, good x bad
    gain = (good - F.col("lost")).cast("decimal(18,0)") * F.lit(Decimal(GOOD_WEIGHT * bad)) + F.col("rejected").cast("decimal(18,0)") * F.lit(Decimal(good))
    cuts = placed.select(
        gain.alias("gain"),
        F.coalesce(F.col("score") - F.col("last"), F.lit(0.0)).alias("gap"),
        F.when(F.col("last").isNull(), F.col("score") - 1).when(middle > F.col("last"), middle).otherwise(F.col("score")).alias("cut"),
    )
    return cuts.orderBy(F.desc("gain"), F.desc("gap"), "cut").first()["cut"]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Count both multinomials and fit the threshold, over every document and every label, whole.

    A document that is labelled both good and bad is bad. Of rows that share an id all are counted, and the least score
    counts for the threshold.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = cut(known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            texts = [t or b"" for t in as_bytes(b.column(1))]
            trusted = [t for t, on in zip(texts, b.column(0).to_pylist(), strict=True) if on]
            for into, some_texts in ((raw, texts), (target, trusted)):
                for _, data, lengths in _chunks(some_texts):
                    if len(data) >= 4:
                        code = buckets_of(data)
                        into += np.bincount(code, minlength=BUCKETS)
                        into -= np.bincount(code[_last_three(lengths, len(code))], minlength=BUCKETS)
        if (at := np.flatnonzero(raw)).size:
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    texts = docs.select("doc_id", F.col("text").alias("__text"))
    # by shuffle whatever the size: labels grow with the corpus, so a broadcast of them would too
    marked = texts.join(known.hint("shuffle_hash"), "doc_id", "left").select((F.col("quality") == 1).alias("trusted"), "__text")
    counted = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(BUCKETS, 0.5), np.full(BUCKETS, 0.5)
    if len(counted):
        raw[counted["bucket"]] += counted["raw"]
        target[counted["bucket"]] += counted["target"]
    ratios = np.round((np.log(target / target.sum()) - np.log(raw / raw.sum())) * UNIT) / UNIT
    if not counted["target"].any():
        ratios[:] = 0
    table = spark.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores([t or b"" for t in as_bytes(b.column(1))], table.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    # every text is scored where it lies, so only ids and scores are shuffled
    scored = texts.where("doc_id IS NOT NULL").mapInArrow(score, extended(docs.select("doc_id").schema, "score double"))
    labelled = scored.groupBy("doc_id").agg(F.min("score").alias("score")).join(known, "doc_id").select("quality", "score")
    return Model(ratios, best_threshold(labelled))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which occurs twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    width, factor = 1, 0x9E3779B97F4A7C15
    while width < window:
        step = min(width, window - width)
        h = h[: len(h) - step] * np.uint64(factor) + h[step:]
        width, factor = width + step, (factor * factor + 2) % 2**64
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    # equal hashes are compared word for word
    maybe = np.unique(np.r_[order[1:][same], order[:-1][same]])
    seen: dict[tuple[bytes, ...], list[int]] = {}
    for i in maybe.tolist():
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    covered = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered[i] += 1
                covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def measure(text: bytes, n_chars: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text of ``n_chars`` code points."""
    words = text.split()
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    spaces = len(text) - sum(map(len, words))
    lines = text.split(b"\n")
    dup = 0
    if len(lines) > 1:
        lines = [x for x in lines if x.strip()]
        dup = len(lines) - len(set(lines))
    return len(words), n_chars - spaces, symbols, dup, repeated_words(words)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model, *, keep: list[str], prefix: str = "") -> DataFrame:
    """``keep``, the measures, base_failed, score and kept (their names after ``prefix``) for every row.

    Null and empty texts have no words, which fails. Repeated rows are judged alike; no rows give no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    added = [*(f"{m} long" for m in MEASURES), "base_failed boolean", "score double", "kept boolean"]
    schema = extended(docs.select(*keep).schema, ", ".join(f"{prefix}{a}" for a in added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            column = b.column(b.num_columns - 1)
            texts = [t or b"" for t in as_bytes(column)]
            chars = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            got = np.array([measure(t, n) for t, n in zip(texts, chars, strict=True)], np.int64).reshape(-1, len(MEASURES))
            failed = (got[:, 0] < 20) | (100 * got[:, 4] > 30 * got[:, 0])
            s = scores(texts, m.ratios)
            columns = [*b.columns[:-1], *(pa.array(got[:, i]) for i in range(len(MEASURES))), pa.array(failed), pa.array(s), pa.array(~failed & (s >= m.threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)

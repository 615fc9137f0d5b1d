"""Language identification by cross-parsing entropy.

Of each language a bounded sample of labelled text becomes a suffix automaton, which accepts the sample's substrings. A text
is parsed from left to right into the longest phrases that occur in a language's sample; a letter that the sample lacks is a
phrase of its own. With c phrases in a text of L bytes and a sample of n bytes, c log2(n) / L estimates the cross entropy
(Ziv and Merhav, 1993); the language with the smallest one wins. Both samples and texts are letters and single spaces.

The longest match ends where the automaton has no transition, so parsing is a walk of a complete automaton whose missing
transitions restart at the root and count a phrase. Many texts, and all languages, take each step together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelane.llm.common import as_bytes, extended

#: Documents of each language that its sample is taken from, code points of each of them, and bytes of the sample.
SAMPLE, PIECE, SAMPLE_BYTES = 64, 1024, 1 << 15
#: Languages that are learned: those with the most documents. Beyond eight, their samples share this many bytes.
LANGUAGES, ALL_BYTES = 64, 1 << 18
#: Phrases end at multiples of this many bytes of a text, so that one very long text is parsed in many places at once.
STRETCH = 4096
#: Stretches that are walked together.
LANES = 2048
UNKNOWN = "und"
_PLAIN = re.compile(b"[a-z]")
#: A-Z lower-cased; of ASCII only letters stay.
_LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id's decimal text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters(text: bytes) -> bytes:
    """Lower-cased runs of letters, and of whatever isn't ASCII, with single spaces between them."""
    return b" ".join(text.translate(_LETTERS).split())


def has_letter(runs: bytes) -> bool:
    """Whether what ``letters`` left of a text holds a letter of any script."""
    return bool(_PLAIN.search(runs)) or any(c.isalpha() for c in runs.decode("utf-8", "ignore"))


def suffix_automaton(symbols: Sequence[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start, and every path from it spells a substring."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] != length[p] + 1:  # q also ends longer strings: split it
                split = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = split
                    p = link[p]
                link[q] = split
                q = split
            link[new] = q
        last = new
    return steps


@dataclass(frozen=True)
class Model:
    """Languages in ascending order, and the pieces of text that each one's sample consists of."""

    languages: tuple[str, ...] = ()
    samples: tuple[tuple[bytes, ...], ...] = ()

    @cached_property
    def weights(self) -> np.ndarray:
        """log2 of each sample's bytes."""
        return np.array([np.log2(max(2, sum(map(len, s)))) for s in self.samples])

    @cached_property
    def automata(self) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """(class of each byte, classes, roots, next state times classes, doubled, plus 1 where a phrase begins)."""
        used = sorted({b for s in self.samples for piece in s for b in piece})
        width, classes = len(used) + 1, np.zeros(256, np.int32)  # class 0: bytes that no sample has
        classes[used] = np.arange(1, width)
        tables, roots, first = [], [], 0
        for sample in self.samples:
            symbols: list[int] = []
            for piece in sample:
                symbols += [*classes[np.frombuffer(piece, np.uint8)].tolist(), width]  # no phrase runs from one piece to the next
            steps = suffix_automaton(symbols)
            edges = np.array([(s, c, n) for s, out in enumerate(steps) for c, n in out.items() if c < width], np.int64).reshape(-1, 3)
            table = np.full((len(steps), width), -1, np.int64)
            table[edges[:, 0], edges[:, 1]] = edges[:, 2]
            start = np.where(table[0] < 0, 0, table[0])
            begins = table < 0
            begins[0] = True
            table = np.where(begins, start, table)
            tables.append((((table + first) * width << 1) | begins).astype(np.int32))
            roots.append(first * width)
            first += len(steps)
        return classes, width, np.array(roots, np.int32), np.concatenate(tables).ravel()

    def phrases(self, runs: list[bytes]) -> np.ndarray:
        """Phrases of each text (of ``letters``) in each language."""
        classes, _, roots, table = self.automata
        total = np.zeros((len(runs), len(self.languages)), np.int64)
        pieces = [(len(r[at : at + STRETCH]), i, at) for i, r in enumerate(runs) for at in range(0, len(r), STRETCH)]
        pieces.sort(key=lambda p: -p[0])
        for lane in range(0, len(pieces), LANES):
            some = pieces[lane : lane + LANES]
            grid = np.zeros((len(some), some[0][0]), np.uint8)
            for k, (n, i, at) in enumerate(some):
                grid[k, :n] = np.frombuffer(runs[i], np.uint8, n, at)
            symbols = classes[grid.T]
            # lanes are ordered by length: those that a step still moves come first
            active = np.searchsorted(-np.array([p[0] for p in some]), -np.arange(some[0][0]), "left")
            state, count = np.tile(roots, (len(some), 1)), np.zeros((len(some), len(roots)), np.int32)
            for row, n in zip(symbols, active.tolist(), strict=True):
                moved = table.take(state[:n] + row[:n, None])
                count[:n] += moved & 1
                np.right_shift(moved, 1, out=state[:n])
            np.add.at(total, [p[1] for p in some], count)
        return total

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Each text's language and how much smaller its entropy is than the next one's, as a share of that."""
        runs = [letters(t) for t in texts]
        known = np.array([bool(r) and has_letter(r) for r in runs], bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        entropy = self.phrases(runs) * self.weights
        best = entropy.argmin(1)
        if len(self.languages) == 1:
            score = np.ones(len(texts))
        else:
            two = np.partition(entropy, 1, axis=1)[:, :2]
            score = np.where(two[:, 1] > 0, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-300), 0)
        return [self.languages[k] if on else UNKNOWN for k, on in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def _bound(ids: int) -> int:
    """A hash below which about eight samples of so many ids lie; all of them, if there are fewer."""
    return -(1 << 63) + min((1 << 64) - 1, (8 * SAMPLE << 64) // max(ids, 1))


def train(docs: DataFrame) -> Model:
    """A model of at most ``LANGUAGES`` languages, from samples of labelled documents that are not held out.

    Of each language the ``SAMPLE`` documents with the smallest hashes of their ids count, with a run of at most ``PIECE``
    code points of each, from a place that the id's hash gives. Rows without id, text or language teach nothing; no rows
    give a model without languages. Rows that share an id and a language, and copies that give the same run, count once.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") > 0) & ~held_out(F.col("doc_id")))
    figures = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids"))
    most = figures.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()  # at most LANGUAGES
    if not most:
        return Model()
    names = sorted((r["lang"] for r in most), key=str.encode)
    # the smallest hashes lie below a bound that some eight samples of a language reach, so few ids are ordered
    place = F.xxhash64("doc_id")
    low = reduce(or_, ((F.col("lang") == r["lang"]) & (place <= _bound(r["ids"])) for r in most))
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    ids = known.where(low).select("lang", "doc_id").distinct()
    picked = ids.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= SAMPLE).collect()  # at most SAMPLE a language
    picks = docs.sparkSession.createDataFrame([(r["lang"], r["doc_id"], r["turn"]) for r in picked], "lang string, doc_id long, turn int")
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1).cast("int") + 1
    pieces = known.join(F.broadcast(picks), ["lang", "doc_id"]).select("lang", "turn", F.col("text").substr(start, F.lit(PIECE)).alias("piece"))
    pieces = pieces.groupBy("lang", "turn").agg(F.min(F.col("piece").cast("binary")).alias("piece")).orderBy("turn").collect()
    share = min(SAMPLE_BYTES, ALL_BYTES // len(names))
    samples = []
    for name in names:
        sample: dict[bytes, None] = {}
        left = share
        for r in pieces:
            if r["lang"] == name and left > 0 and (run := letters(bytes(r["piece"]))[:left]) and run not in sample:
                sample[run] = None
                left -= len(run)
        samples.append(tuple(sample))
    some = [(n, s) for n, s in zip(names, samples, strict=True) if s]
    return Model(tuple(n for n, _ in some), tuple(s for _, s in some))


def identify(docs: DataFrame, model: Model, *, keep: list[str], prefix: str = "") -> DataFrame:
    """``keep``, lang_pred and score (their names after ``prefix``) of every row, from its whole text alone.

    A null text, and one without a letter of any script, is ``und`` with score 0; so is every text if nothing was learned.
    Ties go to the first language. Repeated rows are predicted alike; no rows give no rows; very long texts are cut into
    stretches for parsing only. Other columns are neither read nor in the way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended(docs.select(*keep).schema, f"{prefix}lang_pred string, {prefix}score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names, score = m.predict([t or b"" for t in as_bytes(b.column(b.num_columns - 1))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)

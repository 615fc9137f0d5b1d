"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features come from the whole text alone: densities of two lexicons, proximity to the second person, capitals,
punctuation and obfuscation. One lexicon is given; the other is learnt, of words and word beginnings that are much more
frequent in toxic than in other labelled texts, whatever their language. Trees and calibration are fitted on the driver
to a bounded sample of labelled rows. Each fold's features use a lexicon learnt without it, and calibration uses scores
of folds that the scoring trees have not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelane.llm.common import as_bytes, extended
from quirelane.session import cut

#: Labelled rows that a model is fitted to; those with the smallest hashes of their ids.
SAMPLE = 20_000
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS, LEAST_LEAF, FOLDS = 60, 3, 0.15, 64, 10, 4
#: Words of insult and contempt, and stronger ones of threat.
INSULTS = """
arse arsehole ass asshole bastard bigot bitch bonehead brainless brat buffoon bum clown coward crap creep cretin deplorable despicable
dimwit dirtbag disgrace disgusting donkey dork douche dumb dumbass dunce failure fake fool foolish freak fraud garbage gross halfwit
hideous hypocrite idiot idiotic ignorant imbecile incompetent inferior jackass jerk joke lame laughable liar lame loser losers lowlife
lunatic maggot mindless miserable moron moronic morons nasty nitwit numbskull oaf parasite pathetic pest pig prick psycho rat repulsive
retard retarded revolting rubbish scoundrel scum scumbag senseless shameful shit sick simpleton slime slob snake spineless stupid
stupidity sucker thug trash traitor twat twit ugly useless vermin vile weasel weirdo wimp worthless wretch
""".split()
THREATS = "beat burn crush die destroy hang hate hurt kill murder punch shoot slap stab strangle".split()
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tus ustedes".split()
NEAR = 6
#: Learnt entries: beginnings of so many bytes or whole words, in so many toxic texts at least, so many times as
#: frequent as elsewhere, so many standard errors from chance; the surest so many of them.
STEMS, LEAST_TEXTS, LEAST_RATIO, LEAST_ERRORS, ENTRIES = (4, 5, 6, 7, 8), 5, 5.0, 4.0, 1000
#: Candidates that are counted: those in most toxic texts.
CANDIDATES = 20_000
#: Words that a Python worker remembers, per lexicon.
WORDS = 200_000

FEATURES = (
    "insults_per_word", "insults", "distinct_insults", "threats_per_word", "insults_near_second_person", "second_person_per_word",
    "capitals", "shouted_words", "shouted_insults", "exclamations", "questions", "marks", "obfuscated_insults", "digits_in_words",
    "stretched_words", "log_words", "learnt_per_word", "learnt", "distinct_learnt", "learnt_weight",
)

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 or b >= 0x80 or b == 0x27 else 0x20 for b in range(256))
_LEET = bytes.maketrans(b"0134578@$!|", b"oieastbasil")
# possessive, and only from the start of a run: linear in any text
_MIXED = re.compile(rb"(?<![a-z])[a-z]++(?:[0-9@$!|*._-]++[a-z]++)++|(?<![@$!|0-9])[@$!|0-9]++[a-z]++(?:[0-9@$!|*._-]++[a-z]++)*+", re.I)
_SPACED = re.compile(rb"(?<![A-Za-z])(?:[A-Za-z][ .*_-]){3,}[A-Za-z](?![A-Za-z])")
_STRETCHED = re.compile(rb"([a-zA-Z])\1{2,}")
_RUN = re.compile(rb"(.)\1+")
_CAPITALS, _LETTERS = bytes(range(0x41, 0x5B)), bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,'\"-()")
_INSULTS = frozenset(w.encode() for w in INSULTS)
_THREATS = frozenset(w.encode() for w in THREATS)
_SECOND = frozenset(w.encode() for w in SECOND_PERSON)
_COLLAPSED = frozenset(_RUN.sub(rb"\1", w) for w in _INSULTS)
_STARRED = {}
for _w in sorted(_INSULTS):
    for _i in range(1, len(_w)):
        _STARRED[_w[:_i] + b"*" + _w[_i + 1 :]] = _w


def _hidden(text: bytes) -> int:
    """Lexicon words written with digits, signs, stars, stretched letters or gaps between letters."""
    n = 0
    for m in _MIXED.findall(text):
        m = m.lower()
        plain = m.translate(_LEET, b"*._-")
        n += plain in _INSULTS or m in _STARRED or plain.rstrip(b"il") in _INSULTS
    for m in _SPACED.findall(text):
        n += m.lower().translate(None, b" .*_-") in _INSULTS
    return n


def stems(word: bytes) -> list[bytes]:
    """What a word counts for: itself, and its beginnings, which end in a star."""
    return [word, *(word[:k] + b"*" for k in STEMS if len(word) > k)] if len(word) >= STEMS[0] else []


class Lexicon(dict):
    """Weight of any word: that of its weightiest learnt stem, else 0. Remembers words, a bounded number of them."""

    def __init__(self, weights: dict[bytes, float] | None = None) -> None:
        super().__init__()
        self.weights = weights or {}

    def __missing__(self, word: bytes) -> float:
        if len(self) >= WORDS:
            self.clear()
        get = self.weights.get
        w = self[word] = max((get(s, 0.0) for s in stems(word)), default=0.0)
        return w

    def __reduce__(self):
        return Lexicon, (self.weights,)


def learn(counts: dict[bytes, tuple[int, int]], toxic_words: int, other_words: int) -> Lexicon:
    """A lexicon from stems' (toxic, other) occurrences: log-ratios of frequencies that are large and sure."""
    rows = []
    for stem, (t, o) in counts.items():
        weight = np.log((t + 0.5) / (toxic_words + 1)) - np.log((o + 0.5) / (other_words + 1))
        sure = weight / np.sqrt(1 / (t + 0.5) + 1 / (o + 0.5))
        if weight >= np.log(LEAST_RATIO) and sure >= LEAST_ERRORS:
            rows.append((-sure, stem, float(weight)))
    return Lexicon({stem: weight for _, stem, weight in sorted(rows)[:ENTRIES]})


def features(text: bytes, lexicon: Lexicon) -> list[float]:
    """Dense features of one whole text, in the order of FEATURES; all zero for one without words."""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    here = set(words)
    insults = here & _INSULTS
    second = here & _SECOND
    at = [i for i, w in enumerate(words) if w in insults] if insults else []
    threats = sum(w in _THREATS for w in words) if here & _THREATS else 0
    you = [i for i, w in enumerate(words) if w in second] if second else []
    near = 0
    if at and you:
        p = np.searchsorted(you, at)
        gap = np.minimum(np.abs(np.take(you, np.minimum(p, len(you) - 1)) - at), np.abs(np.take(you, np.maximum(p - 1, 0)) - at))
        near = int((gap <= NEAR).sum())
    size = max(len(text), 1)
    letters = size - len(text.translate(None, _LETTERS))
    capitals = size - len(text.translate(None, _CAPITALS))
    shouted = sum(w.isupper() and len(w) > 1 for w in text.split()) if capitals > 0.02 * size else 0
    loud = sum(1 for w in re.findall(rb"[A-Z]{3,}", text) if w.lower() in _INSULTS) if shouted else 0
    stretched = 0
    if _STRETCHED.search(text):
        for w in words:
            if _STRETCHED.search(w) and _RUN.sub(rb"\1", w) in _COLLAPSED:
                stretched += 1
    hidden = _hidden(text)
    learnt = [w for w in map(lexicon.__getitem__, words) if w] if lexicon.weights else []
    kinds = sum(1 for w in here if lexicon[w]) if learnt else 0
    return [
        len(at) / n, float(len(at)), float(len(insults)), threats / n, float(near), len(you) / n,
        capitals / max(letters, 1), shouted / n, float(loud), text.count(b"!") / size, text.count(b"?") / size,
        (size - len(text.translate(None, _MARKS))) / size, float(hidden), (size - len(text.translate(None, b"0123456789"))) / size,
        float(stretched), float(np.log1p(n)), len(learnt) / n, float(len(learnt)), float(kinds), sum(learnt) / n,
    ]


@dataclass
class Tree:
    """A full binary tree of fixed depth: node i's children are 2i+1 and 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        inner = len(self.feature)
        while at.size and at[0] < inner:
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.cut[at])
        return self.value[at - inner]


@dataclass
class Model:
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    steps: np.ndarray = field(default_factory=lambda: np.zeros(1))  # raw scores at which the calibrated score changes
    levels: np.ndarray = field(default_factory=lambda: np.zeros(1))
    lexicon: Lexicon = field(default_factory=Lexicon)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((RATE * t.leaves(x) for t in self.trees), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.levels) if len(x) else np.zeros(0)


def _grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> Tree:
    inner = 2**DEPTH - 1
    feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
    node = np.zeros(len(x), np.int64)
    for i in range(inner):
        here = np.flatnonzero(node == i)
        if len(here) >= 2 * LEAST_LEAF:
            g, h = gradient[here], hessian[here]
            gain, total = 0.0, g.sum() ** 2 / (h.sum() + 1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[here, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g, h, None))
                ok = (ns >= LEAST_LEAF) & (len(here) - ns >= LEAST_LEAF)
                got = np.where(ok, gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - total, 0)
                if got.max() > gain + 1e-9:
                    gain, feature[i], cut[i] = got.max(), f, e[got.argmax()]
        node[here] = 2 * i + 1 + (x[here, feature[i]] > cut[i])
    for leaf in range(inner + 1):
        here = node == inner + leaf
        value[leaf] = gradient[here].sum() / (hessian[here].sum() + 1)
    return Tree(feature, cut, value)


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic boosting; without both labels, the log-odds of what there is."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(p / (1 - p))))
    if not 0 < y.sum() < len(y):
        return model
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)))
        edges.append((values[1:] + values[:-1]) / 2)
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(x, binned, edges, y - p, p * (1 - p))
        model.trees.append(tree)
        raw += RATE * tree.leaves(x)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (raw scores, calibrated scores), both rising, to interpolate between."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first and last raw score
    values, first = np.unique(raw[order], return_index=True)
    for v, part in zip(values, np.split(y[order], first[1:]), strict=True):
        blocks.append([float(part.mean()), float(len(part)), v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, last
    steps = np.array([s for b in blocks for s in (b[2], b[3])])
    levels = np.array([m for b in blocks for m in (b[0], b[0])])
    steps, keep = np.unique(steps, return_index=True)
    return steps, levels[keep]


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Model:
    """Trees on all rows; calibration on scores of each fold by trees of the others. No rows: every score is 0."""
    if not len(y):
        return Model()
    model = boost(x, y)
    unseen = model.raw(x)
    if 0 < y.sum() < len(y) and len(y) >= 10 * FOLDS:
        for k in range(FOLDS):
            if (fold == k).any() and (fold != k).any():
                unseen[fold == k] = boost(x[fold != k], y[fold != k]).raw(x[fold == k])
    model.steps, model.levels = isotonic(unseen, y)
    return model


def held_out(id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _candidates(sampled: DataFrame) -> list[bytes]:
    """Stems that stand in most toxic texts, at least in LEAST_TEXTS: at most CANDIDATES."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in as_bytes(b.column(0)):
                got = list({s for w in set(words_of(t or b"")) for s in stems(w)})
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["stem"])

    rows = sampled.where("toxic = 1").select("__text").mapInArrow(distinct, "stem binary").groupBy("stem").agg(F.count("*").alias("n"))
    return [bytes(r["stem"]) for r in rows.where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "stem").limit(CANDIDATES).collect()]


def _occurrences(sampled: DataFrame, candidates: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """([candidate, fold, toxic] occurrences, [fold, toxic] words) in the sample."""
    number = sampled.sparkSession.sparkContext.broadcast({c: i for i, c in enumerate(candidates)})
    n = len(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = number.value
        total: dict[int, int] = {}
        for b in batches:
            for toxic, fold, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                words, cell = words_of(t or b""), 2 * fold + toxic
                total[n * 2 * FOLDS + cell] = total.get(n * 2 * FOLDS + cell, 0) + len(words)
                for w in words:
                    for s in stems(w):
                        if (i := place.get(s)) is not None:
                            at = i * 2 * FOLDS + cell
                            total[at] = total.get(at, 0) + 1
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["at", "n"])

    got = sampled.select("toxic", "fold", "__text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros((n + 1) * 2 * FOLDS, np.int64)
    if len(got):
        flat[got["at"]] = got["n"]
    whole = flat.reshape(n + 1, FOLDS, 2)
    return whole[:n], whole[n]


def _measured(docs: DataFrame, keep: list[str], lexicons, which: str | None) -> DataFrame:
    """``keep`` and each text's features, by the lexicon whose number column ``which`` holds."""
    schema = extended(docs.select(*keep).schema, "x array<double>")
    at = keep.index(which)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t or b"", lexicons.value[k]) for k, t in zip(b.column(at).to_pylist(), as_bytes(b.column(b.num_columns - 1)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=schema.names)

    return docs.select(*keep, "__text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Fit to at most ``sample`` labelled documents that are not held out.

    A document labelled both ways counts as toxic; of rows that share an id the least text counts, so that no id has two.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = [(int(r[0]), int(r[1])) for r in known.select("doc_id", "toxic").collect()]  # at most ``sample``
    if not rows:
        return Model()
    some = spark.createDataFrame(rows, "id long, toxic int").withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int"))
    texts = docs.select(F.col("doc_id").alias("__doc"), F.col("text").alias("__text"))
    joined = texts.join(F.broadcast(some), F.col("__doc") == F.col("id"))
    sampled = cut(joined.groupBy("id", "toxic", "fold").agg(F.min("__text").alias("__text")))
    candidates = _candidates(sampled)
    seen, words = _occurrences(sampled, candidates)
    lexicons = []
    for k in [*range(FOLDS), None]:  # without each fold, and with all
        left = [f for f in range(FOLDS) if f != k]
        n, (other, toxic) = seen[:, left].sum(1), words[left].sum(0)
        lexicons.append(learn({c: (int(n[i, 1]), int(n[i, 0])) for i, c in enumerate(candidates)}, int(toxic), int(other)))
    got = _measured(sampled, ["id", "toxic", "fold"], spark.sparkContext.broadcast(lexicons), "fold").toPandas()
    if not len(got):
        return Model()
    got = got.assign(k=got["x"].map(tuple)).sort_values(["id", "k"], kind="stable")
    model = fit(np.array(got["x"].tolist(), np.float64), got["toxic"].to_numpy(np.float64), got["fold"].to_numpy())
    model.lexicon = lexicons[-1]
    return model


def score(docs: DataFrame, model: Model, *, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` and the score, 0 to 1, of every whole text; null text: as empty. Labels and ids are no inputs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended(docs.select(*keep).schema, f"{name} double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = [features(t or b"", m.lexicon) for t in as_bytes(b.column(b.num_columns - 1))]
            x = np.array(x, np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.score(x))], names=schema.names)

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)

"""Best-fit packing of token sequences by bin completion.

Tokens: texts are split into words by the tokenizer's own rules; a word's ids are looked up in a bounded table that the
tokenizers library fills, so the library sees each new word only. Texts with characters whose case, normal form or class
depends on more than the word go to the library whole.

Packing: lengths are at most the sequence's, so their histogram is bounded whatever the input; bins are solved over the
histogram on the driver, as filling patterns with how often each is used, and each piece then finds its place from its
rank among pieces of its length. Ranks are dealt over salts, as one length may hold very many pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelane.llm.common import as_bytes, extended
from quirelane.session import cut

#: Words that a Python worker remembers (about 200 bytes each); the table starts anew when full.
WORDS = 400_000
#: Characters of a text beyond which its words are not all held at once.
LONG = 2_000_000
#: Salts of each length at least, and rows of one length for which it gets another.
SALTS, SALT_ROWS = 128, 1 << 16
#: Fillings of each branch, and branches tried, before the incumbent stands; sequences' worth of items that best-fit
#: completes again.
FILLINGS, BRANCHES, LITTLE = 4, 20_000, 64

_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
#: The tokenizer's own split, for texts up to U+017F.
_WORD = re.compile(f"[{_LETTER}]+|[{_DIGIT}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_SPACE}{_LETTER}{_DIGIT}]+")
#: Characters that the split above doesn't speak for, and a letter whose lower case has two.
_OTHER = re.compile("[^\x00-įı-ſ]")
#: How added tokens begin.
_ADDED = "<|"


class Tokens:
    """Ids of texts, exactly as ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, words: int = WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.limit = words
        self.table: dict[str, bytes] = {}
        # every word's last token, and no other, carries the vocabulary's word end
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        """One call of the library for all new words."""
        if len(self.table) + len(words) > self.limit:
            self.table.clear()
        ids = self._ids(" ".join(words))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):  # a word that isn't one to the library
            self.table.update((w, self.whole(w)) for w in words)
            return
        raw, at = ids.tobytes(), 0
        for w, to in zip(words, (4 * cuts).tolist(), strict=True):
            self.table[w] = raw[at:to]
            at = to

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if _ADDED in text or not text.isascii() and _OTHER.search(text):
            return self.whole(text)
        if len(text) > LONG:
            found = _WORD.finditer(text.lower())
            return b"".join(iter(lambda: self._words([m[0] for m in islice(found, LONG // 8)]), b""))
        return self._words(_WORD.findall(text.lower()))

    def _words(self, words: list[str]) -> bytes:
        table = self.table
        if new := list(set(words).difference(table)):
            if len(new) > self.limit // 4:  # one text with more words than the table should take
                return self._ids(" ".join(words)).tobytes()
            before = len(table)
            self._learn(new)
            if len(table) < before:
                self._learn(list(set(words).difference(table)))
        return b"".join(map(table.__getitem__, words))


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def pieces(docs: DataFrame, path: str, *, size: int, end: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids and ``end``, cut into pieces of ``size`` only if longer.

    Bytes that aren't UTF-8 are read as U+FFFD.
    """
    schema = extended(docs.select(id).schema, "piece int, start long, length long, ids_crc32 long")
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokens(path).encode
        for b in batches:
            at, piece, length, crc = [], [], [], []
            for i, t in enumerate(as_bytes(b.column(1))):
                ids = (encode(t.decode("utf-8", "replace")) if t else b"") + tail
                for k, s in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[s : s + 4 * size]
                    at.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            p = pa.array(piece, pa.int32())
            start = pa.array(np.array(piece, np.int64) * size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), p, start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return docs.select(id, F.col(text).alias("__text")).mapInArrow(run, schema)


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Bins that any packing needs: by volume, and by volume when small items are ignored (Martello and Toth's L2)."""
    total = sum(n * x for x, n in counts.items())
    best = -(-total // size)
    lengths = sorted(counts)
    for k in [0, *[x for x in lengths if 2 * x <= size]]:
        big = sum(n for x, n in counts.items() if x > size - k)
        mid = [(x, n) for x, n in counts.items() if size - k >= x and 2 * x > size]
        low = sum(n * x for x, n in counts.items() if 2 * x <= size and x >= k)
        n_mid = sum(n for _, n in mid)
        free = n_mid * size - sum(n * x for x, n in mid)
        best = max(best, big + n_mid + max(0, -(-(low - free) // size)))
    return best


def _best_fit(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over the histogram: (filling, times) rows. Equal bins are handled together."""
    bins: dict[int, list[list]] = {}  # room -> [[filling, times]]
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            room = min((r for r in bins if r >= x), default=None)
            if room is None:
                k = size // x
                full, rest = divmod(n, k)
                for fill, times in ((k, full), (rest, 1)):
                    if fill and times:
                        bins.setdefault(size - fill * x, []).append([{x: fill}, times])
                break
            filling, times = bins[room].pop()
            if not bins[room]:
                del bins[room]
            k = room // x
            use = min(times, n // k)
            if use:
                bins.setdefault(room - k * x, []).append([filling | {x: k}, use])
                n -= use * k
                times -= use
                left = 0
            else:
                left = n
                bins.setdefault(room - left * x, []).append([filling | {x: left}, 1])
                n, times = 0, times - 1
            if times:
                bins.setdefault(room, []).append([filling, times])
    return [(f, t) for group in bins.values() for f, t in group]


def _fill(lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """(waste, filling): items that fill ``room`` as far as any do; if to the full, with the largest smallest item.

    Sums that items reach, the longest first, are bits of one number; each step keeps the sums that it was first to
    reach, so that a sum's items are read back from the last step. Small items stay for bins that need them.
    """
    within, goal, reach = (1 << (room + 1)) - 1, 1 << room, 1
    steps: list[tuple[int, int, int]] = []
    for x in lengths:
        n, k = min(counts[x], room // x), 1
        while n > 0:  # doubling numbers of one length, as many as there are
            k = min(k, n)
            if new := (reach << (k * x)) & within & ~reach:
                steps.append((x, k, new))
                reach |= new
            n, k = n - k, 2 * k
        if reach & goal:
            break
    full = left = reach.bit_length() - 1
    filling: dict[int, int] = {}
    for x, k, new in reversed(steps):
        if new >> left & 1:
            filling[x] = filling.get(x, 0) + k
            left -= k * x
    return room - full, filling


def _dominated(filling: dict[int, int], waste: int, lengths: list[int], counts: dict[int, int]) -> bool:
    """Whether an unused item fits in the waste, or in place of a smaller item and the waste."""
    smaller = sorted(filling)
    for x in lengths:
        if counts[x] > filling.get(x, 0):
            i = bisect_left(smaller, x)
            if x <= waste or i and x <= smaller[i - 1] + waste:
                return True
    return False


def _fillings(lengths: list[int], counts: dict[int, int], room: int, keep: int) -> Iterator[tuple[int, dict[int, int]]]:
    """At most ``keep`` undominated (waste, filling) of ``room``, least waste first: each without its predecessor's smallest item."""
    lengths = [x for x in lengths if counts[x] and x <= room]
    rest = lengths
    for _ in range(keep):
        waste, filling = _fill(rest, counts, room)
        if rest is lengths or filling and not _dominated(filling, waste, lengths, counts):
            yield waste, filling
        if not filling:
            return
        least = min(filling)
        rest = [x for x in rest if x != least]


def complete_bins(counts: dict[int, int], size: int, *, branches: int = BRANCHES, fillings: int = FILLINGS) -> list[tuple[dict[int, int], int]]:
    """(filling, times) rows that use every item of the histogram {length: count}, in few bins.

    Bin completion: the largest length left is completed by its undominated fillings, least waste first; a filling is
    used as often as the counts allow, at once. Branches whose waste already makes as many bins as the incumbent are
    cut. Best-fit decreasing gives the incumbent, for all items and again for what is left where that is little. The
    search ends when the incumbent meets the lower bound, or after ``branches`` fillings.
    """
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    assert 0 < min(counts) and max(counts) <= size, "lengths must be from 1 to the sequence's"
    best = _best_fit(counts, size)
    n_best = sum(t for _, t in best)
    bound = lower_bound(counts, size)
    lengths, left = sorted(counts, reverse=True), dict(counts)
    volume, used, tried = sum(n * x for x, n in counts.items()), 0, 0

    def ways(spare: int) -> Iterator[tuple[int, dict[int, int]]]:
        """(rank, filling) around the largest length left. When the next is asked for, counts are as they were."""
        top = next(x for x in lengths if left[x])
        left[top] -= 1
        found = _fillings(lengths, left, size - top, min(fillings, spare + 1))
        for rank in count():
            got = next(found, None)
            left[top] += 1
            if got is None:
                return
            yield rank, got[1] | {top: got[1].get(top, 0) + 1}
            left[top] -= 1

    began, last = -1, (-1, n_best)
    for most in count():  # with no turn from first fillings, then with one, and so on: turns near the root come early
        if n_best <= bound or tried >= branches or (tried - began, n_best) == last:  # met, given up, or nothing was left
            return best
        began, last = tried, (tried - began, n_best)
        open_, chosen = [(most, ways(most))], []
        while open_ and n_best > bound:
            spare, here = open_[-1]
            step = next(here, None) if tried < branches else None
            if step is None:
                open_.pop()
                if not chosen:
                    break
                filling, times = chosen.pop()
                used -= times
                volume += times * sum(x * k for x, k in filling.items())
                for x, k in filling.items():
                    left[x] += times * k
                continue
            rank, filling = step
            tried += 1
            times = min(left[x] // k for x, k in filling.items())
            for x, k in filling.items():
                left[x] -= times * k
            used, volume = used + times, volume - times * sum(x * k for x, k in filling.items())
            chosen.append((filling, times))
            open_.append((0, iter(())))
            if used + -(-volume // size) >= n_best:
                continue
            if volume <= LITTLE * size:
                rest = _best_fit({x: n for x, n in left.items() if n}, size)
                if used + sum(t for _, t in rest) < n_best:
                    best = [*chosen, *rest]
                    n_best = sum(t for _, t in best)
            if volume:
                open_[-1] = (spare - rank, ways(spare - rank))
        if open_:  # it ended early: all is taken back
            return best
    return best


def pack(pieces_: DataFrame, size: int, *, id: str = "doc_id", branches: int = BRANCHES) -> DataFrame:
    """Adds sequence_id and offset to materialised pieces; sequences hold ``size`` at most, without gaps from 0.

    Rows without an id, repeated rows and pieces of equal length are packed like any other; no rows give no rows.
    """
    spark = pieces_.sparkSession
    # a row for each length, at most ``size``; then one for each salt, which a length has SALTS of, or one for SALT_ROWS rows
    sizes = pieces_.groupBy("length").count().toPandas()
    salts = np.zeros(size + 1, np.int64)
    salts[sizes["length"]] = np.maximum(SALTS, -(-sizes["count"].to_numpy(np.int64) // SALT_ROWS))
    first = np.r_[0, np.cumsum(salts)]
    many = spark.createDataFrame([(int(x), int(salts[x])) for x in np.flatnonzero(salts > SALTS)], "_length long, _salts long")
    dealt = pieces_.join(F.broadcast(many), F.col("length") == F.col("_length"), "left")  # at most ``size`` rows
    salted = dealt.select(*pieces_.columns, F.pmod(F.xxhash64(id, "piece"), F.coalesce("_salts", F.lit(SALTS))).alias("_salt"))
    histogram = salted.groupBy("length", "_salt").count().toPandas()
    held = np.zeros(int(first[-1]), np.int64)
    held[first[histogram["length"].to_numpy(np.int64)] + histogram["_salt"].to_numpy(np.int64)] = histogram["count"]
    before = np.r_[0, np.cumsum(held)]
    before = before[:-1] - np.repeat(before[first[:-1]], salts)  # pieces of the length under lesser salts
    counts = {int(x): int(n) for x, n in zip(sizes["length"], sizes["count"], strict=True)}
    rows = complete_bins(counts, size, branches=branches)
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    base, taken = 0, [0] * (size + 1)
    for filling, times in rows:
        offset = 0
        for x in sorted(filling, reverse=True):
            places.setdefault(x, []).append((taken[x], filling[x], offset, base))
            taken[x] += times * filling[x]
            offset += x * filling[x]
        base += times
    tables = {x: np.array(p, np.int64).T for x, p in places.items()}
    shared = spark.sparkContext.broadcast((first, before, tables))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id, "piece")))
    schema = extended(pieces_.schema, "sequence_id long, offset long")
    n = len(pieces_.columns)
    at_length = pieces_.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before, tables = shared.value
        for b in batches:
            length, salt, rank = (b.column(i).to_numpy() for i in (at_length, n, n + 1))
            r = before[first[length] + salt] + rank - 1
            seq, off = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                x = int(length[part[0]])
                start, k, offset, base = tables[x]
                row = np.searchsorted(start, r[part], "right") - 1
                i = r[part] - start[row]
                seq[part] = base[row] + i // k[row]
                off[part] = offset[row] + i % k[row] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(seq), pa.array(off)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, *, size: int = 2048, end: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every text; null text: empty."""
    return pack(cut(pieces(docs, path, size=size, end=end, id=id, text=text)), size, id=id)

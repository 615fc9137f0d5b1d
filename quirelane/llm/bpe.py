"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

A text is split as the tokenizer splits it. Within a part, each prefix has exactly one last token: of the tokens that end
there, found by an Aho-Corasick automaton over the vocabulary, the one that merges would leave beside the last token of the
prefix before it. Whether two tokens may stand side by side is decided by undoing merges from the boundary outward: the
pair is impossible if a merge across the boundary would have come first. Back-pointers from the whole part give its ids
in time linear in its length, with no queue of merges.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelane.llm.common import as_bytes, extended

#: Parts that a Python worker remembers (about 200 bytes each), and pairs of tokens; the tables start anew when full.
PARTS, PAIRS = 500_000, 1_000_000
#: Characters of a text beyond which its parts are not all held at once.
LONG = 2_000_000

_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The split for texts up to U+017F, and for all others.
_NEAR = re.compile(f" ?[{_LETTER}]+|{_ENDINGS}| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_FAR = regex.compile(_ENDINGS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_BEYOND = re.compile("[^\x00-ſ]")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class BytePairs:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, parts: int = PARTS) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: to_bytes(t) for t, i in vocabulary.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # rank: a byte has -1, a token the place of its merge; halves: what it was merged from
        self.rank, self.halves, self.merged = {}, {}, {}
        for i, t in ((i, t) for t, i in vocabulary.items() if len(t) == 1):
            self.rank[i] = -1
        if lacking := set(range(256)) - {self.bytes_of[i][0] for i in self.rank}:
            raise ValueError(f"{path} has no token for the bytes {sorted(lacking)}")
        for place, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i, j, ab = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.merged[i, j] = place
            if ab not in self.rank:
                self.rank[ab], self.halves[ab] = place, (i, j)
        self.automaton = ahocorasick.Automaton()
        for i in self.rank:
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (len(self.bytes_of[i]), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        outer = self

        class Table(dict):
            def __missing__(self, part: str) -> bytes:
                if len(self) >= parts:
                    self.clear()
                got = self[part] = np.array(outer.last_tokens(part.encode()), "<u4").tobytes()
                return got

        self.table = Table()

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging would leave ``left`` and ``right`` side by side.

        The pair's boundary is opened step by step, last merge first. At each step the tokens that touch there existed
        before either is merged further; a merge of these two that comes earlier than that would have been made. Equal
        ranks: merges go from left to right, so the left token's own merge comes first.
        """
        key = (left, right)
        if (known := self.pairs.get(key)) is not None:
            return known
        rank, merged, halves = self.rank, self.merged, self.halves
        a, b = left, right
        until, strict = 1 << 60, False  # merges across the boundary before this place would have been made
        ok = True
        while True:
            place = merged.get((a, b))
            if place is not None and (place < until or (place == until and not strict)):
                ok = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                # the left token is the later merge: before it, its right half touched the boundary
                until, strict = ra, True
                a = halves[a][1]
            else:
                # the right token was merged later or at the same place, after anything to the left of it
                until, strict = rb, False
                b = halves[b][0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def last_tokens(self, part: bytes) -> list[int]:
        """Ids of one part, by the last token of each prefix."""
        n = len(part)
        last, pairs, compatible = [-1] * n, self.pairs, self.compatible
        size = [0] * n
        for end, (length, token) in self.automaton.iter(part.decode("latin-1")):
            if last[end] >= 0:
                continue  # a prefix has one last token
            before = end - length
            if before >= 0:
                prior = last[before]
                if prior < 0:
                    continue
                known = pairs.get((prior, token))
                if not (compatible(prior, token) if known is None else known):
                    continue
            last[end], size[end] = token, length
        ids, at = [], n - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self.table.__getitem__
        if len(text) > LONG:
            return self._encode_long(text)
        if self.split_special and any(t in text for t in self.special):
            out = []
            for i, piece in enumerate(self.split_special.split(text)):
                out.append(np.array([self.special[piece]], "<u4").tobytes() if i % 2 else b"".join(map(get, self.parts(piece))))
            return b"".join(out)
        return b"".join(map(get, self.parts(text)))

    def _encode_long(self, text: str) -> bytes:
        """As encode, holding no more than so many parts at a time."""
        out = []
        for i, piece in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if i % 2:
                out.append(np.array([self.special[piece]], "<u4").tobytes())
                continue
            found = (_FAR if not piece.isascii() and _BEYOND.search(piece) else _NEAR).finditer(piece)
            while some := [m[0] for m in islice(found, LONG // 8)]:
                out.append(b"".join(map(self.table.__getitem__, some)))
        return b"".join(out)

    @staticmethod
    def parts(text: str) -> list[str]:
        return _FAR.findall(text) if not text.isascii() and _BEYOND.search(text) else _NEAR.findall(text)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the ids' text; bytes that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def load(path: str) -> BytePairs:
    return BytePairs(path)


def encode_documents(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per text, and with ``ids`` the ids and the decoded text themselves.

    Null text counts as empty: no tokens, digests of nothing. Long texts are encoded whole; a row's columns other than
    id and text are not used. Bytes that aren't UTF-8 are read as U+FFFD. Repeated rows are encoded alike, and an empty
    table gives no rows. A vocabulary that lacks a byte is refused.
    """
    schema = extended(docs.select(id).schema, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            n, sha, back, lists, texts = [], [], [], [], []
            for t in as_bytes(b.column(1)):
                got = model.encode((t or b"").decode("utf-8", "replace"))
                decoded = model.decode(got)
                n.append(len(got) // 4)
                sha.append(hashlib.sha256(got).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
                if ids:
                    lists.append(np.frombuffer(got, "<u4").astype(np.int64))
                    texts.append(decoded.decode())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if ids:
                columns += [pa.array(lists, pa.list_(pa.int64())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id, F.col(text).alias("__text")).mapInArrow(run, schema)

"""A PDF file's object graph: cross references, objects, pages and what hangs from the catalog."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from quirelane.sources.pdf import aes
from quirelane.sources.pdf.filters import Expansion, decode
from quirelane.sources.pdf.objects import Diagnostics, Name, Operator, Parser, Ref, Stream

INHERITED = ("MediaBox", "CropBox", "Rotate", "Resources")
MAX_PAGES, MAX_CHAIN = 1_000_000, 10_000
_PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


class Document:
    """Lazy objects of one file. ``password`` is tried after the empty one."""

    def __init__(self, data: bytes, password: bytes = b"", cap: Expansion | None = None) -> None:
        self.data = data
        self.diagnostics = Diagnostics()
        self.cap = cap or Expansion()
        self.offsets: dict[int, tuple[int, int]] = {}  # number -> (offset, generation), or (-container, index)
        self.cache: dict[int, object] = {}
        self.open: set[int] = set()
        self.trailer: dict = {}
        self.key: bytes | None = None
        self.method = "RC4"
        self._cross_references()
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            self._recover()
        self.encrypted = self.trailer.get("Encrypt") is not None
        self.readable = not self.encrypted or self._unlock(password)
        self.catalog = self.dict(self.trailer.get("Root"))

    # ---- cross references

    def _cross_references(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            self.diagnostics.add("no_startxref", "the file has no startxref")
            return
        offset, seen = Parser(self.data, at + 9).object(), set()
        while isinstance(offset, int) and 0 <= offset < len(self.data) and offset not in seen:
            seen.add(offset)
            p = Parser(self.data, offset, self.diagnostics)
            p.skip()
            head = self._table(p) if self.data.startswith(b"xref", p.at) else self._xref_stream(p.at)
            if head is None:
                self.diagnostics.add("bad_xref", f"no cross references at {offset}")
                return
            for k, v in head.items():
                self.trailer.setdefault(k, v)
            hybrid = head.get("XRefStm")
            if isinstance(hybrid, int) and hybrid not in seen:
                seen.add(hybrid)
                self._xref_stream(hybrid)
            offset = head.get("Prev")
            offset = int(offset) if isinstance(offset, float) else offset

    def _table(self, p: Parser) -> dict | None:
        p.at += 4
        while True:
            p.skip()
            if self.data.startswith(b"trailer", p.at):
                p.at += 7
                head = p.object()
                return head if isinstance(head, dict) else None
            first, n = p.object(), p.object()
            if not isinstance(first, int) or not isinstance(n, int):
                return None
            for i in range(n):
                offset, generation, kind = p.object(), p.object(), p.object()
                if kind == b"n" and isinstance(offset, int):
                    self.offsets.setdefault(first + i, (offset, generation))
                elif kind not in (b"n", b"f"):
                    return None

    def _xref_stream(self, at: int) -> dict | None:
        s = self._indirect(at)
        if not isinstance(s, Stream) or s.head.get("Type") != "XRef":
            return None
        widths = [w if isinstance(w, int) else 0 for w in s.head.get("W", [])]
        if len(widths) != 3 or not sum(widths):
            return None
        rows, size = self.decoded(s), sum(widths)
        index = s.head.get("Index") or [0, s.head.get("Size", 0)]
        at = 0
        for first, n in zip(index[::2], index[1::2], strict=False):
            for i in range(n):
                row = rows[at : at + size]
                at += size
                if len(row) < size:
                    return s.head
                a, b = widths[0], widths[0] + widths[1]
                kind = int.from_bytes(row[:a], "big") if a else 1
                x, y = int.from_bytes(row[a:b], "big"), int.from_bytes(row[b:], "big")
                if kind == 1:
                    self.offsets.setdefault(first + i, (x, y))
                elif kind == 2:
                    self.offsets.setdefault(first + i, (-x, y))
        return s.head

    def _recover(self) -> None:
        """Find objects by their headers, for files whose cross references are lost."""
        self.diagnostics.add("recovered", "objects were found by scanning the file")
        self.cache.clear()
        self.offsets = {int(m[1]): (m.start(1), int(m[2])) for m in re.finditer(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b", self.data)}
        for m in re.finditer(rb"trailer", self.data):
            head = Parser(self.data, m.end()).object()
            if isinstance(head, dict):
                self.trailer |= head
        for n in list(self.offsets):
            o = self.get(Ref(n, 0))
            if isinstance(o, Stream) and o.head.get("Type") == "ObjStm":
                for i, (number, _) in enumerate(self._packed(o)):
                    self.offsets.setdefault(number, (-n, i))
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            for n in self.offsets:
                o = self.get(Ref(n, 0))
                if isinstance(o, dict) and o.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(n, 0)

    # ---- objects

    def _indirect(self, at: int, ref: Ref | None = None):
        p = Parser(self.data, at, self.diagnostics)
        number, generation, word = p.object(), p.object(), p.object()
        if word != b"obj" or (ref and number != ref.number):
            return None
        value = p.object()
        key = Ref(number, generation)
        if isinstance(value, dict):
            p.skip()
            if self.data.startswith(b"stream", p.at):
                start = p.at + 6
                start += 2 if self.data[start : start + 2] == b"\r\n" else 1
                n = value.get("Length")
                n = self.get(n) if isinstance(n, Ref) else n
                if not isinstance(n, int) or not re.match(rb"\s*endstream", self.data[start + n : start + n + 16]):
                    end = self.data.find(b"endstream", start)
                    n = (len(self.data) if end < 0 else end) - start
                    self.diagnostics.add("stream_length", f"object {number}")
                value = Stream(value, self.data[start : start + n], key)
        return self._decrypted(value, key)

    def get(self, o, depth: int = 0):
        """What a reference stands for; other values as they are. A ring of references is None."""
        if not isinstance(o, Ref):
            return o
        n = o.number
        if n in self.cache:
            return self.cache[n]
        if n in self.open or depth > MAX_CHAIN or n not in self.offsets:
            return None
        self.open.add(n)
        try:
            place, index = self.offsets[n]
            if place < 0:
                box = self.get(Ref(-place, 0))
                value = None
                if isinstance(box, Stream):
                    value = next((v for number, v in self._packed(box) if number == n), None)
            else:
                value = self._indirect(place, o)
            if isinstance(value, Ref):
                value = self.get(value, depth + 1)
        finally:
            self.open.discard(n)
        self.cache[n] = value
        return value

    def _packed(self, box: Stream) -> list[tuple[int, object]]:
        data, n, first = self.decoded(box), box.head.get("N", 0), box.head.get("First", 0)
        p = Parser(data, 0, self.diagnostics)
        pairs = [(p.object(), p.object()) for _ in range(n if isinstance(n, int) else 0)]
        return [(a, Parser(data, first + b, self.diagnostics).object()) for a, b in pairs if isinstance(a, int) and isinstance(b, int)]

    def dict(self, o) -> dict:
        o = self.get(o)
        return o.head if isinstance(o, Stream) else o if isinstance(o, dict) else {}

    def list(self, o) -> list:
        o = self.get(o)
        return o if isinstance(o, list) else []

    def number(self, o, default: float = 0.0) -> float:
        o = self.get(o)
        return float(o) if isinstance(o, (int, float)) and not isinstance(o, bool) else default

    def text(self, o) -> str | None:
        """Text string: UTF-16 or UTF-8 by its mark, else the document encoding, here read as Windows' Latin 1."""
        o = self.get(o)
        if isinstance(o, Name):
            return str(o)
        if not isinstance(o, bytes):
            return None
        if o[:2] == b"\xfe\xff":
            return o[2:].decode("utf-16-be", "replace")
        if o[:2] == b"\xff\xfe":
            return o[2:].decode("utf-16-le", "replace")
        if o[:3] == b"\xef\xbb\xbf":
            return o[3:].decode("utf-8", "replace")
        return o.decode("cp1252", "replace")

    def decoded(self, s: Stream) -> bytes:
        f, p = self.get(s.head.get("Filter", s.head.get("F"))), self.get(s.head.get("DecodeParms", s.head.get("DP")))
        filters = [f] if isinstance(f, Name) else [self.get(x) for x in f] if isinstance(f, list) else []
        parms = [p] if isinstance(p, dict) else [self.dict(x) for x in p] if isinstance(p, list) else []
        parms = [{k: self.get(v) for k, v in x.items()} for x in parms]
        return decode(s.raw, filters, parms, self.cap, self.diagnostics)

    # ---- encryption (the standard handler: RC4, AES-128 and AES-256)

    def _unlock(self, password: bytes) -> bool:
        e = {k: self.get(v) for k, v in self.dict(self.trailer.get("Encrypt")).items()}
        version = e.get("V")
        if e.get("Filter") != "Standard" or version not in (1, 2, 4, 5):
            self.diagnostics.add("encrypted", f"version {version} is not read")
            return False
        method = "RC4"
        if version >= 4:
            name = e.get("StmF", "Identity")
            method = {"V2": "RC4", "AESV2": "AES", "AESV3": "AES256"}.get(self.get(self.dict(self.dict(e.get("CF")).get(name)).get("CFM")), "None")
        for word in (b"", password):
            key = aes.file_key(e, word) if version == 5 else self._old_key(e, word)
            if key is not None:
                self.cache.clear()
                self.key, self.method = key, method
                return True
        self.diagnostics.add("encrypted", "the password doesn't fit")
        return False

    def _old_key(self, e: dict, word: bytes) -> bytes | None:
        revision = e.get("R", 2)
        size = (e.get("Length") or (128 if e.get("V") == 4 else 40)) // 8 if e.get("V") != 1 else 5
        first = self.list(self.trailer.get("ID"))
        first = first[0] if first and isinstance(first[0], bytes) else b""
        seed = (word + _PAD)[:32] + (e.get("O") or b"")[:32] + (int(e.get("P", 0)) & 0xFFFFFFFF).to_bytes(4, "little") + first
        if revision >= 4 and e.get("EncryptMetadata") is False:
            seed += b"\xff\xff\xff\xff"
        digest = hashlib.md5(seed).digest()
        if revision >= 3:
            for _ in range(50):
                digest = hashlib.md5(digest[:size]).digest()
        key, u = digest[:size], e.get("U") or b""
        if revision == 2:
            return key if rc4(key, _PAD) == u else None
        check = rc4(key, hashlib.md5(_PAD + first).digest())
        for i in range(1, 20):
            check = rc4(bytes(b ^ i for b in key), check)
        return key if check[:16] == u[:16] else None

    def _decrypted(self, value, ref: Ref):
        if self.key is None or self.method == "None" or ref == self.trailer.get("Encrypt"):
            return value
        if self.method == "AES256":
            plain = lambda b: aes.cbc_decrypt(self.key, b)
        else:
            seed = self.key + ref.number.to_bytes(4, "little")[:3] + ref.generation.to_bytes(4, "little")[:2] + (b"sAlT" if self.method == "AES" else b"")
            key = hashlib.md5(seed).digest()[: min(16, len(self.key) + 5)]
            plain = (lambda b: aes.cbc_decrypt(key, b)) if self.method == "AES" else (lambda b: rc4(key, b))

        def walk(v):
            if isinstance(v, bytes) and not isinstance(v, Operator):
                return plain(v)
            if isinstance(v, list):
                return [walk(x) for x in v]
            if isinstance(v, dict):
                return {k: walk(x) for k, x in v.items()}
            return v

        if isinstance(value, Stream):
            kept = value.head.get("Type") in ("XRef",) or "Crypt" in str(value.head.get("Filter"))
            return Stream(walk(value.head), value.raw if kept else plain(value.raw), value.key)
        return walk(value)

    # ---- pages

    def pages(self) -> Iterator[tuple[Ref | None, dict]]:
        """(reference, page with inherited attributes) in order; rings and missing nodes are passed over."""
        seen: set[int] = set()
        n = 0

        def walk(o, above: dict, depth: int) -> Iterator[tuple[Ref | None, dict]]:
            nonlocal n
            ref = o if isinstance(o, Ref) else None
            if ref:
                if ref.number in seen:
                    self.diagnostics.add("page_ring", f"object {ref.number}")
                    return
                seen.add(ref.number)
            node = self.dict(o)
            if not node or depth > 200 or n >= MAX_PAGES:
                return
            here = above | {k: node[k] for k in INHERITED if k in node}
            if "Kids" in node and node.get("Type") != "Page":
                for kid in self.list(node["Kids"]):
                    yield from walk(kid, here, depth + 1)
            else:
                n += 1
                yield ref, here | node

        yield from walk(self.catalog.get("Pages"), {}, 0)

    def contents(self, page: dict) -> bytes:
        c = self.get(page.get("Contents"))
        parts = [c] if isinstance(c, Stream) else [self.get(x) for x in c] if isinstance(c, list) else []
        return b"\n".join(self.decoded(s) for s in parts if isinstance(s, Stream))

    def box(self, page: dict) -> tuple[float, float, float, float]:
        for name in ("CropBox", "MediaBox"):
            b = [self.number(x) for x in self.list(page.get(name))]
            if len(b) == 4 and b[0] != b[2] and b[1] != b[3]:
                return min(b[0], b[2]), min(b[1], b[3]), max(b[0], b[2]), max(b[1], b[3])
        return 0.0, 0.0, 612.0, 792.0

    def tree(self, root, leaf: str) -> Iterator[tuple[object, object]]:
        """(key, value) pairs of a name or number tree."""
        seen: set[int] = set()

        def walk(o, depth: int):
            if isinstance(o, Ref):
                if o.number in seen:
                    return
                seen.add(o.number)
            node = self.dict(o)
            pairs = self.list(node.get(leaf))
            yield from zip(pairs[::2], pairs[1::2], strict=False)
            if depth < 64:
                for kid in self.list(node.get("Kids")):
                    yield from walk(kid, depth + 1)

        yield from walk(root, 0)

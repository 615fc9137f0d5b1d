"""Character codes to text and widths."""

from __future__ import annotations

import html.entities
import re
import unicodedata
from functools import cache

from quirelane.sources.pdf.document import Document
from quirelane.sources.pdf.objects import Name, Operator, Parser, Stream

UNKNOWN = "�"
# Confidence of each source of a character: embedded map, encoding, nothing.
MAPPED, ENCODED, NOTHING = 1.0, 0.9, 0.0
_CODECS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman", "StandardEncoding": "latin-1", "PDFDocEncoding": "cp1252"}
_DIGITS = "zero one two three four five six seven eight nine".split()
_MARKS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?",
    "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}",
    "asciitilde": "~", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "fi": "fi",
    "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "Euro": "€", "sterling": "£", "section": "§", "copyright": "©", "registered": "®", "trademark": "™", "degree": "°",
}
_ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌", "macron": "̄", "breve": "̆", "ogonek": "̨", "dotaccent": "̇"}


@cache
def glyph_text(name: str) -> str | None:
    """Text of a glyph name by rule: uniXXXX, uXXXXX, single letters, digits, marks, letters with accents, entities."""
    base = name.split(".", 1)[0]
    if not base:
        return None
    if "_" in base:
        parts = [glyph_text(p) for p in base.split("_")]
        return "".join(parts) if all(parts) else None
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", base):
        codes = re.findall("....", m[1]) if m[1] else [m[2]]
        return "".join(chr(int(c, 16)) for c in codes if int(c, 16) < 0x110000)
    if len(base) == 1:
        return base
    if base in _DIGITS:
        return str(_DIGITS.index(base))
    if base in _MARKS:
        return _MARKS[base]
    for accent, mark in _ACCENTS.items():
        if base.endswith(accent) and len(base) == len(accent) + 1:
            return unicodedata.normalize("NFC", base[0] + mark)
    code = html.entities.name2codepoint.get(base)
    return chr(code) if code else None


def parse_cmap(data: bytes) -> tuple[dict[tuple[int, int], str], list[tuple[int, int, int]]]:
    """((width, code) -> text, code space ranges (width, lo, hi)) of a character map program."""
    p, stack, table, spaces = Parser(data), [], {}, []
    text = lambda b: b.decode("utf-16-be", "replace")
    while not p.done():
        before = p.at
        o = p.object()
        if p.at == before:
            break
        if not isinstance(o, Operator):
            stack.append(o)
            continue
        if o == b"endcodespacerange":
            for lo, hi in zip(stack[::2], stack[1::2], strict=False):
                if isinstance(lo, bytes) and isinstance(hi, bytes):
                    spaces.append((len(lo), int.from_bytes(lo, "big"), int.from_bytes(hi, "big")))
        elif o == b"endbfchar":
            for code, to in zip(stack[::2], stack[1::2], strict=False):
                if isinstance(code, bytes) and isinstance(to, (bytes, Name)):
                    table[len(code), int.from_bytes(code, "big")] = text(to) if isinstance(to, bytes) else glyph_text(to) or UNKNOWN
        elif o == b"endbfrange":
            for lo, hi, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                if not (isinstance(lo, bytes) and isinstance(hi, bytes)):
                    continue
                a, b = int.from_bytes(lo, "big"), int.from_bytes(hi, "big")
                for i in range(min(b - a + 1, 65536)):
                    if isinstance(to, list):
                        if i < len(to) and isinstance(to[i], bytes):
                            table[len(lo), a + i] = text(to[i])
                    elif isinstance(to, bytes) and to:
                        last = int.from_bytes(to[-2:], "big") + i
                        table[len(lo), a + i] = text(to[:-2] + (last & 0xFFFF).to_bytes(min(2, len(to)), "big"))
        stack = []
    return table, spaces


class Font:
    """Decodes shown strings to (text, width in thousandths, confidence, is a one-byte space) per code."""

    def __init__(self, doc: Document, head: dict) -> None:
        self.name = str(doc.get(head.get("BaseFont")) or "")
        self.kind = str(doc.get(head.get("Subtype")) or "")
        self.composite = self.kind == "Type0"
        self.map: dict[tuple[int, int], str] = {}
        self.spaces: list[tuple[int, int, int]] = []
        unicode = doc.get(head.get("ToUnicode"))
        if isinstance(unicode, Stream):
            self.map, self.spaces = parse_cmap(doc.decoded(unicode))
        self.widths: dict[int, float] = {}
        self._simple: list[tuple[str, float, float, bool]] | None = None  # of each byte, once there is text
        self.default = 500.0
        if self.composite:
            inner = doc.dict((doc.list(head.get("DescendantFonts")) or [None])[0])
            self.default = doc.number(inner.get("DW"), 1000.0)
            self._cid_widths(doc, doc.list(inner.get("W")))
            encoding = doc.get(head.get("Encoding"))
            if isinstance(encoding, Stream):
                self.spaces = parse_cmap(doc.decoded(encoding))[1] or self.spaces
            self.spaces = self.spaces or [(2, 0, 0xFFFF)]
        else:
            first = int(doc.number(head.get("FirstChar")))
            for i, w in enumerate(doc.list(head.get("Widths"))):
                self.widths[first + i] = doc.number(w)
            descriptor = doc.dict(head.get("FontDescriptor"))
            self.default = doc.number(descriptor.get("MissingWidth"), 0.0 if self.widths else 500.0)
            self.codes = self._encoding(doc, head)
        matrix = [doc.number(x) for x in doc.list(head.get("FontMatrix"))]
        self.scale = matrix[0] if self.kind == "Type3" and len(matrix) == 6 else 0.001
        descriptor = doc.dict(head.get("FontDescriptor"))
        self.ascent = doc.number(descriptor.get("Ascent"), 800.0) / 1000
        self.descent = doc.number(descriptor.get("Descent"), -200.0) / 1000

    def _encoding(self, doc: Document, head: dict) -> list[str | None]:
        e = doc.get(head.get("Encoding"))
        base = e if isinstance(e, Name) else doc.get(e.get("BaseEncoding")) if isinstance(e, dict) else None
        codec = _CODECS.get(str(base), "latin-1")
        codes: list[str | None] = []
        for i in range(256):
            c = bytes([i]).decode(codec, "ignore")
            codes.append(c if c and (i >= 32) else None)
        if isinstance(e, dict):
            at = 0
            for x in doc.list(e.get("Differences")):
                x = doc.get(x)
                if isinstance(x, Name):
                    if at < 256:
                        codes[at] = glyph_text(x)
                    at += 1
                elif isinstance(x, (int, float)):
                    at = int(x)
        return codes

    def _cid_widths(self, doc: Document, w: list) -> None:
        i = 0
        while i + 1 < len(w):
            first, second = doc.get(w[i]), doc.get(w[i + 1])
            if isinstance(second, list):
                for k, x in enumerate(second):
                    self.widths[int(first) + k] = doc.number(x)
                i += 2
            elif i + 2 < len(w):
                for k in range(int(first), min(int(second), int(first) + 65536) + 1):
                    self.widths[k] = doc.number(w[i + 2])
                i += 3
            else:
                break

    def _split(self, s: bytes) -> list[tuple[int, int]]:
        """(width, code) of a string, by the widest code space that fits at each place."""
        if not self.composite:
            return [(1, b) for b in s]
        out, i = [], 0
        sizes = sorted({n for n, _, _ in self.spaces}, reverse=True)
        while i < len(s):
            for n in sizes:
                code = int.from_bytes(s[i : i + n], "big")
                if i + n <= len(s) and any(n == m and lo <= code <= hi for m, lo, hi in self.spaces):
                    break
            else:
                n, code = 1, s[i]
            out.append((n, code))
            i += n
        return out

    def decode(self, s: bytes) -> list[tuple[str, float, float, bool]]:
        if not self.composite:
            if self._simple is None:
                self._simple = [self._decoded(bytes([b]))[0] for b in range(256)]
            return [self._simple[b] for b in s]
        return self._decoded(s)

    def _decoded(self, s: bytes) -> list[tuple[str, float, float, bool]]:
        out = []
        for n, code in self._split(s):
            text, sure = self.map.get((n, code)), MAPPED
            if text is None and not self.composite:
                text, sure = self.codes[code], ENCODED
            if not text:
                text, sure = UNKNOWN, NOTHING
            out.append((text, self.widths.get(code, self.default), sure, n == 1 and code == 32))
        return out

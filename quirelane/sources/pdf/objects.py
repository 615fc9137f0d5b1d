"""PDF tokens and objects. Nothing here raises on bad input: what can't be read is None, and a diagnostic says so."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

WHITE = b"\x00\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
MAX_DEPTH = 64

_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]*\d*\.?\d*(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
#: Bytes of a string that stand for themselves.
_PLAIN = re.compile(rb"[^\\()]+")
#: An array of nothing but whole numbers of common length, as widths are.
_WHOLE_NUMBERS = re.compile(rb"\[((?:[ \t\r\n\f]*[0-9]{1,18}(?![0-9]))*[ \t\r\n\f]*)\]")
_REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name without its slash."""


class Ref(NamedTuple):
    number: int
    generation: int


class Operator(bytes):
    """A keyword of a content stream."""


@dataclass
class Stream:
    head: dict
    raw: bytes
    key: Ref | None = None


@dataclass
class Diagnostics:
    rows: list[tuple[str, str, int | None]] = field(default_factory=list)

    def add(self, code: str, message: str, page: int | None = None) -> None:
        if len(self.rows) < 1000:
            self.rows.append((code, message, page))


class Parser:
    """Reads objects from bytes at ``at``."""

    def __init__(self, data: bytes, at: int = 0, diagnostics: Diagnostics | None = None) -> None:
        self.data, self.at = data, at
        self.diagnostics = diagnostics or Diagnostics()

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def done(self) -> bool:
        self.skip()
        return self.at >= len(self.data)

    def object(self, depth: int = 0):
        """The next object, an Operator for a keyword, or None at the end and for what is no object."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            return None
        c = data[at : at + 1]
        if c.isdigit() or c in b"+-.":
            if m := _REFERENCE.match(data, at):
                self.at = m.end()
                return Ref(int(m[1]), int(m[2]))
            if (m := _NUMBER.match(data, at)) and m.end() > at:
                self.at = m.end()
                return self._number(m[0])
        if c == b"/":
            m = _REGULAR.match(data, at + 1)
            self.at = m.end() if m else at + 1
            raw = m[0] if m else b""
            if b"#" in raw:
                raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw)
            return Name(raw.decode("utf-8", "replace"))
        if c == b"(":
            return self._literal()
        if data[at : at + 2] == b"<<":
            return self._dictionary(depth)
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            return self._array(depth)
        if m := _REGULAR.match(data, at):
            self.at = m.end()
            return {b"true": True, b"false": False, b"null": None}.get(m[0], Operator(m[0]))
        self.at += 1
        self.diagnostics.add("stray_delimiter", f"{c!r} at {at}")
        return self.object(depth) if c in b")>]{}" and depth < MAX_DEPTH else None

    def _number(self, text: bytes):
        negative = text.count(b"-") % 2 == 1
        body = text.lstrip(b"+-")
        try:
            value = float(body) if b"." in body else int(body)
        except ValueError:
            return 0
        return -value if negative else value

    def _literal(self) -> bytes:
        data, i, out, depth = self.data, self.at + 1, [], 1
        n = len(data)
        while i < n:
            if m := _PLAIN.match(data, i):
                out.append(m[0])
                i = m.end()
                continue
            c = data[i : i + 1]
            if c == b"\\":
                e = data[i + 1 : i + 2]
                if m := re.match(rb"[0-7]{1,3}", data[i + 1 : i + 4]):
                    out.append(bytes([int(m[0], 8) & 255]))
                    i += 1 + len(m[0])
                elif e == b"\r":
                    i += 3 if data[i + 2 : i + 3] == b"\n" else 2
                elif e == b"\n":
                    i += 2
                else:
                    out.append(_ESCAPES.get(e, e))
                    i += 2
                continue
            if c == b"(":
                depth += 1
            elif c == b")":
                depth -= 1
                if not depth:
                    self.at = i + 1
                    return b"".join(out)
            out.append(c)
            i += 1
        self.at = n
        self.diagnostics.add("open_string", "a string has no end")
        return b"".join(out)

    def _array(self, depth: int) -> list:
        if m := _WHOLE_NUMBERS.match(self.data, self.at):
            self.at = m.end()
            return [int(x) for x in m[1].split()]
        self.at += 1
        out: list = []
        while True:
            self.skip()
            if self.at >= len(self.data):
                self.diagnostics.add("open_array", "an array has no end")
                return out
            if self.data[self.at : self.at + 1] == b"]":
                self.at += 1
                return out
            if depth >= MAX_DEPTH:
                self.diagnostics.add("too_deep", "objects are nested too deeply")
                self.at = len(self.data)
                return out
            before = self.at
            value = self.object(depth + 1)
            if isinstance(value, Operator):
                self.diagnostics.add("keyword_in_array", repr(bytes(value)))
                if value in (b"endobj", b"obj", b"stream"):
                    self.at = before
                    return out
                continue
            out.append(value)

    def _dictionary(self, depth: int) -> dict:
        self.at += 2
        out: dict = {}
        while True:
            self.skip()
            if self.at >= len(self.data):
                self.diagnostics.add("open_dictionary", "a dictionary has no end")
                return out
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            if depth >= MAX_DEPTH:
                self.diagnostics.add("too_deep", "objects are nested too deeply")
                self.at = len(self.data)
                return out
            key = self.object(depth + 1)
            if not isinstance(key, Name):
                self.diagnostics.add("bad_key", repr(key)[:60])
                if isinstance(key, Operator) and key in (b"endobj", b"stream"):
                    return out
                continue
            self.skip()
            if self.data[self.at : self.at + 2] == b">>":
                out[key] = None
                continue
            out[key] = self.object(depth + 1)

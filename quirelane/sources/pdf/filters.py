"""Stream filters, with a cap on what a document may expand to."""

from __future__ import annotations

import re
import zlib

from quirelane.sources.pdf.objects import Diagnostics, Name


class Expansion:
    """Counts decompressed bytes of one document."""

    def __init__(self, most: int = 512 << 20) -> None:
        self.left = most

    def take(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise OverflowError("the document expands beyond its limit")


def flate(data: bytes, cap: Expansion) -> bytes:
    for wbits in (15, -15):
        z, out = zlib.decompressobj(wbits), []
        try:
            chunk = data
            while chunk and not z.eof:
                piece = z.decompress(chunk, 1 << 20)
                cap.take(len(piece))
                out.append(piece)
                chunk = z.unconsumed_tail
            out.append(z.flush())
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return b""


def lzw(data: bytes, cap: Expansion, early: int = 1) -> bytes:
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, bits, n_bits, width, last = [], 0, 0, 9, b""
    for byte in data:
        bits, n_bits = (bits << 8) | byte, n_bits + 8
        while n_bits >= width:
            n_bits -= width
            code = bits >> n_bits
            bits &= (1 << n_bits) - 1
            if code == 256:
                del table[258:]
                width, last = 9, b""
                continue
            if code == 257:
                return b"".join(out)
            entry = table[code] if code < len(table) else last + last[:1]
            if not entry:
                return b"".join(out)
            cap.take(len(entry))
            out.append(entry)
            if last:
                table.append(last + entry[:1])
            last = entry
            size = len(table) + early
            width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    return b"".join(out)


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">", 1)[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii_85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~>", 1)[0].removeprefix(b"<~"):
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += (sum(d * 85 ** (4 - i) for i, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(d * 85 ** (4 - i) for i, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def run_length(data: bytes, cap: Expansion) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    cap.take(len(out))
    return bytes(out)


def unpredict(data: bytes, parms: dict) -> bytes:
    """Undo PNG and TIFF predictors."""
    kind = parms.get("Predictor", 1)
    if kind in (1, None):
        return data
    colors, depth, columns = (parms.get(k) or d for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    pixel, row = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    if kind == 2:
        out = bytearray(data)
        if depth == 8:
            for start in range(0, len(out), row):
                for i in range(start + pixel, min(start + row, len(out))):
                    out[i] = (out[i] + out[i - pixel]) & 255
        return bytes(out)
    out, above = bytearray(), bytearray(row)
    for start in range(0, len(data), row + 1):
        tag, line = data[start], bytearray(data[start + 1 : start + 1 + row].ljust(row, b"\0"))
        for i in range(row):
            a = line[i - pixel] if i >= pixel else 0
            b, c = above[i], above[i - pixel] if i >= pixel else 0
            if tag == 1:
                p = a
            elif tag == 2:
                p = b
            elif tag == 3:
                p = (a + b) // 2
            elif tag == 4:
                q = a + b - c
                p = min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2]
            else:
                break
            line[i] = (line[i] + p) & 255
        out += line
        above = line
    return bytes(out)


_SHORT = {"Fl": "FlateDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "RL": "RunLengthDecode"}
IMAGE_FILTERS = {"DCTDecode", "DCT", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode", "CCF"}


def decode(raw: bytes, filters: list[Name], parms: list[dict], cap: Expansion, diagnostics: Diagnostics) -> bytes:
    """Apply filters in order; image codecs and unknown ones stop the chain, with the bytes so far."""
    data = raw
    for i, f in enumerate(filters):
        p = parms[i] if i < len(parms) and isinstance(parms[i], dict) else {}
        f = _SHORT.get(f, f)
        if f == "FlateDecode":
            data = unpredict(flate(data, cap), p)
        elif f == "LZWDecode":
            data = unpredict(lzw(data, cap, p.get("EarlyChange", 1)), p)
        elif f == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif f == "ASCII85Decode":
            data = ascii_85(data)
        elif f == "RunLengthDecode":
            data = run_length(data, cap)
        elif f == "Crypt":
            continue
        else:
            if f not in IMAGE_FILTERS:
                diagnostics.add("unknown_filter", str(f))
            return data
    return data

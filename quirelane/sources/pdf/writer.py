"""A small PDF writer: pages of text lines, for exports and round trips."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelane.session import ship
from quirelane.sources.pdf.objects import Name, Parser, Ref


def escape(text: str) -> bytes:
    raw = text.encode("cp1252", "replace")
    return raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\n")


def assemble(objects: Sequence[bytes], root: int = 1, more: bytes = b"") -> bytes:
    """A file of numbered objects with its cross references."""
    out, offsets = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for i, body in enumerate(objects, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, root, more, at))


def stream(data: bytes, head: bytes = b"", compress: bool = True) -> bytes:
    if compress:
        data, head = zlib.compress(data), head + b" /Filter /FlateDecode"
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), head, data)


def text_pdf(pages: Sequence[Sequence[tuple[float, float, float, str]]]) -> bytes:
    """Pages of (x, y, size, text) lines in one font."""
    n = len(pages)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 612 792] >>" % (n, b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(n)))]
    objects.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding /FirstChar 0 /Widths [%s] >>" % b" ".join([b"600"] * 256))
    for i, lines in enumerate(pages):
        body = b"".join(b"BT /F1 %g Tf 1 0 0 1 %g %g Tm (%s) Tj ET\n" % (size, x, y, escape(t)) for x, y, size, t in lines)
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (5 + 2 * i))
        objects.append(stream(body))
    return assemble(objects)


def write_pages(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content): a PDF of each document's lines (page_index, line_no, text, x0, y0, size)."""
    ship(lines.sparkSession)
    page = F.array_sort(F.collect_list(F.struct("page_index", "line_no", "x0", "y0", "size", "text")))
    grouped = lines.groupBy(key).agg(page.alias("lines"))
    names = [key, "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for rows in b.column(1).to_pylist():
                pages: dict[int, list] = {}
                for r in rows:
                    pages.setdefault(r["page_index"], []).append((r["x0"], r["y0"], r["size"], r["text"]))
                made.append(text_pdf([pages.get(i, []) for i in range(max(pages, default=-1) + 1)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=names)

    from pyspark.sql.types import BinaryType, StructField, StructType

    return grouped.mapInArrow(run, StructType([grouped.schema.fields[0], StructField("content", BinaryType())]))


def highlighted(data: bytes, marks: Sequence[tuple[int, float, float, float, float]], note: str = "") -> bytes:
    """The file with highlights (page, x0, y0, x1, y1) added by an update at its end; what was there stays as it was."""
    from quirelane.sources.pdf.tables import File

    f = File(data)
    doc = f.doc
    number = int(doc.trailer.get("Size") or max(doc.offsets, default=0) + 1)
    out, places = bytearray(data if data.endswith(b"\n") else data + b"\n"), {}
    by_page: dict[int, list[int]] = {}

    def put(n: int, body: bytes) -> None:
        places[n] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (n, body))

    for page, x0, y0, x1, y1 in marks:
        if not 0 <= page < len(f._pages):
            continue
        quad = b" ".join(b"%g" % v for v in (x0, y1, x1, y1, x0, y0, x1, y0))
        put(number, b"<< /Type /Annot /Subtype /Highlight /Rect [%g %g %g %g] /QuadPoints [%s] /C [1 1 0] /Contents (%s) >>" % (x0, y0, x1, y1, quad, escape(note)))
        by_page.setdefault(page, []).append(number)
        number += 1
    for page, added in by_page.items():
        ref = f._pages[page][0]
        if ref is None:
            continue
        own = dict(doc.dict(ref))
        own["Annots"] = [*doc.list(own.get("Annots")), *(Ref(n, 0) for n in added)]
        put(ref.number, written(own))
    at = len(out)
    rows = b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in sorted(places.items()))
    before = int(Parser(data, data.rfind(b"startxref") + 9).object() or 0)
    root = doc.trailer["Root"]
    return bytes(out + b"xref\n" + rows + b"trailer\n<< /Size %d /Root %d %d R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (number, *root, before, at))


def written(o) -> bytes:
    """An object as a file holds it."""
    if o is None:
        return b"null"
    if isinstance(o, bool):
        return b"true" if o else b"false"
    if isinstance(o, Ref):
        return b"%d %d R" % o
    if isinstance(o, Name):
        return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02X" % m[0][0], o.encode())
    if isinstance(o, (int, float)):
        return (b"%d" % o) if isinstance(o, int) else (b"%.6f" % o)
    if isinstance(o, bytes):
        return b"<" + o.hex().encode() + b">"
    if isinstance(o, list):
        return b"[" + b" ".join(map(written, o)) + b"]"
    return b"<< " + b" ".join(written(k) + b" " + written(v) for k, v in o.items()) + b" >>"


def write_highlights(files: DataFrame, matches: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, content): files with their matches (path, page_index, box) highlighted. A file's matches are grouped with it."""
    ship(files.sparkSession)
    rows = F.collect_list(F.struct("page_index", "x0", "y0", "x1", "y1"))
    grouped = files.join(matches.groupBy(path).agg(rows.alias("__marks")), path).select(path, content, "__marks")
    names = [path, content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [highlighted(d, [tuple(m.values()) for m in marks]) for d, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=names)

    from pyspark.sql.types import StructType

    return grouped.mapInArrow(run, StructType(grouped.schema.fields[:2]))

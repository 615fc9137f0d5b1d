"""Rows of each table that a PDF file holds."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

from quirelane.sources.pdf.content import Interpreter
from quirelane.sources.pdf.document import MAX_CHAIN, Document
from quirelane.sources.pdf.objects import Name, Ref, Stream

_BOX = "x0 double, y0 double, x1 double, y1 double"
#: Columns of each table, after the file's path.
SCHEMAS = {
    "documents": "version string, page_count int, is_encrypted boolean, readable boolean, is_tagged boolean, has_forms boolean, has_javascript boolean, conformance string, title string, author string, content_hash string",
    "pages": "page_index int, label string, width double, height double, rotation int, text_ops int, invisible_ops int, n_images int",
    "glyphs": f"page_index int, glyph_index int, text string, {_BOX}, font string, size double, rendering_mode int, color string, confidence double, mcid int",
    "segments": "page_index int, orientation string, pos double, lo double, hi double",
    "images": f"page_index int, image_index int, {_BOX}, name string, width int, height int",
    "annotations": f"page_index int, annotation_index int, kind string, contents string, {_BOX}, uri string, destination string",
    "form_fields": "name string, type string, value string, page_index int",
    "outline": "node int, parent int, level int, title string, page_index int",
    "attachments": "name string, bytes long, data string, truncated boolean",
    "destinations": "name string, page_index int",
    "threads": f"thread int, position int, page_index int, {_BOX}",
    "signatures": "name string, signer string, signed_at string, covered long, file_bytes long",
    "structure": "node int, parent int, role string, page_index int, mcid int",
    "layers": "name string, visible boolean",
    "diagnostics": "code string, message string, page_index int",
}
ATTACHMENT_BYTES = 50 << 20
_FIELD_TYPES = {"Tx": "text", "Btn": "button", "Ch": "choice", "Sig": "signature"}


def _roman(n: int) -> str:
    out = ""
    for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += s * (n // v)
        n %= v
    return out


def label_of(doc: Document, index: int, ranges: list[tuple[int, dict]]) -> str | None:
    held = [(start, d) for start, d in ranges if start <= index]
    if not held:
        return None
    start, d = max(held, key=lambda x: x[0])
    n = int(doc.number(d.get("St"), 1)) + index - start
    style = doc.get(d.get("S"))
    letters, left = "", n
    while left > 0:
        left, digit = divmod(left - 1, 26)
        letters = chr(97 + digit) + letters
    body = {"D": str(n), "R": _roman(n), "r": _roman(n).lower(), "A": letters.upper(), "a": letters}.get(style, "")
    return (doc.text(d.get("P")) or "") + body


class File:
    """One parsed file; tables are generators of tuples."""

    def __init__(self, data: bytes, password: bytes = b"") -> None:
        self.doc = Document(data, password)
        self.size = len(data)
        self._pages = list(self.doc.pages()) if self.doc.readable else []
        self.index_of = {ref.number: i for i, (ref, _) in enumerate(self._pages) if ref}
        self._run: dict[int, object] = {}

    def _ran(self, i: int, glyphs: bool = True):
        return Interpreter(self.doc, i, glyphs=glyphs).run(self._pages[i][1])

    def page_of(self, ref) -> int | None:
        if isinstance(ref, Ref):
            return self.index_of.get(ref.number)
        return ref if isinstance(ref, int) and 0 <= ref < len(self._pages) else None

    def _target(self, dest) -> tuple[str | None, int | None]:
        """(name, page) of a destination: named, or explicit."""
        d = self.doc.get(dest)
        if isinstance(d, (Name, bytes)):
            name = str(d) if isinstance(d, Name) else self.doc.text(d)
            return name, self._named().get(name)
        if isinstance(d, dict):
            d = self.doc.get(d.get("D"))
        return None, self.page_of(d[0]) if isinstance(d, list) and d else None

    def _named(self) -> dict:
        if "named" not in self._run:
            out: dict = {}
            for k, v in self.doc.dict(self.doc.catalog.get("Dests")).items():
                out[str(k)] = self._explicit(v)
            for k, v in self.doc.tree(self.doc.dict(self.doc.catalog.get("Names")).get("Dests"), "Names"):
                out[self.doc.text(k)] = self._explicit(v)
            self._run["named"] = out
        return self._run["named"]

    def _explicit(self, v) -> int | None:
        v = self.doc.get(v)
        v = self.doc.get(v.get("D")) if isinstance(v, dict) else v
        return self.page_of(v[0]) if isinstance(v, list) and v else None

    def rows(self, table: str) -> Iterator[tuple]:
        yield from getattr(self, f"_{table}_rows")()

    def _documents_rows(self) -> Iterator[tuple]:
        doc, c = self.doc, self.doc.catalog
        m = re.search(rb"%PDF-(\d\.\d)", doc.data[:1024])
        meta = doc.get(c.get("Metadata"))
        xmp = doc.decoded(meta).decode("utf-8", "replace") if isinstance(meta, Stream) else ""
        part, level = (re.search(p, xmp) for p in (r"pdfaid:part(?:>|=\")\s*(\d)", r"pdfaid:conformance(?:>|=\")\s*([A-Za-z])"))
        info = doc.dict(doc.trailer.get("Info"))
        script = "JavaScript" in doc.dict(c.get("Names")) or doc.get(doc.dict(c.get("OpenAction")).get("S")) == "JavaScript"
        digest = hashlib.sha256()
        for _, page in self._pages:
            digest.update(hashlib.sha256(b" ".join(doc.contents(page).split())).digest())
        yield (
            m[1].decode() if m else None, len(self._pages), doc.encrypted, doc.readable, bool(doc.get(doc.dict(c.get("MarkInfo")).get("Marked"))),
            bool(doc.list(doc.dict(c.get("AcroForm")).get("Fields"))), bool(script), part[1] + level[1].upper() if part and level else None,
            doc.text(info.get("Title")), doc.text(info.get("Author")), digest.hexdigest(),
        )

    def _pages_rows(self) -> Iterator[tuple]:
        doc = self.doc
        ranges = [(int(k), doc.dict(v)) for k, v in doc.tree(doc.catalog.get("PageLabels"), "Nums") if isinstance(k, int)]
        for i, (_, page) in enumerate(self._pages):
            x0, y0, x1, y1 = doc.box(page)
            got = self._ran(i, glyphs=False)
            yield i, label_of(doc, i, ranges), x1 - x0, y1 - y0, int(doc.number(page.get("Rotate"))) % 360, got.text_ops, got.invisible_ops, len(got.images)

    def _glyphs_rows(self) -> Iterator[tuple]:
        for i in range(len(self._pages)):
            for k, g in enumerate(self._ran(i).glyphs):
                yield (i, k, *g)

    def _segments_rows(self) -> Iterator[tuple]:
        for i in range(len(self._pages)):
            for s in self._ran(i, glyphs=False).segments:
                yield (i, *s)

    def _images_rows(self) -> Iterator[tuple]:
        for i in range(len(self._pages)):
            for k, s in enumerate(self._ran(i, glyphs=False).images):
                yield (i, k, *s)

    def _annotations_rows(self) -> Iterator[tuple]:
        doc = self.doc
        for i, (_, page) in enumerate(self._pages):
            for k, a in enumerate(doc.list(page.get("Annots"))):
                a = doc.dict(a)
                box = [doc.number(x) for x in doc.list(a.get("Rect"))]
                box = (min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])) if len(box) == 4 else (None,) * 4
                action = doc.dict(a.get("A"))
                uri = doc.text(action.get("URI")) if doc.get(action.get("S")) == "URI" else None
                name, target = self._target(a.get("Dest", action.get("D")))
                yield i, k, str(doc.get(a.get("Subtype")) or ""), doc.text(a.get("Contents")), *box, uri, name if name is not None else None if target is None else f"page {target}"

    def _fields(self) -> Iterator[tuple[str, dict]]:
        doc, seen = self.doc, set()

        def walk(o, prefix: str, above: dict, depth: int) -> Iterator[tuple[str, dict]]:
            if isinstance(o, Ref):
                if o.number in seen:
                    return
                seen.add(o.number)
            node = doc.dict(o)
            here = {k: above[k] for k in ("FT", "V", "Ff") if k in above} | node
            part = doc.text(node.get("T"))
            name = f"{prefix}.{part}" if prefix and part else part or prefix
            kids = [k for k in doc.list(node.get("Kids")) if "T" in doc.dict(k)]
            if kids and depth < 64:
                for kid in kids:
                    yield from walk(kid, name, here, depth + 1)
            elif doc.get(here.get("FT")):
                yield name, here

        for f in doc.list(doc.dict(doc.catalog.get("AcroForm")).get("Fields")):
            yield from walk(f, "", {}, 0)

    def _value(self, v) -> str | None:
        v = self.doc.get(v)
        if isinstance(v, list):
            return "|".join(self.doc.text(x) or "" for x in v)
        return None if v is None or isinstance(v, dict) else self.doc.text(v) if isinstance(v, (bytes, Name)) else str(v)

    def _form_fields_rows(self) -> Iterator[tuple]:
        doc = self.doc
        for name, f in self._fields():
            page = self.page_of(f.get("P"))
            if page is None:
                page = next((self.page_of(doc.dict(k).get("P")) for k in doc.list(f.get("Kids"))), None)
            yield name, _FIELD_TYPES.get(doc.get(f.get("FT")), "text"), self._value(f.get("V")), page

    def _signatures_rows(self) -> Iterator[tuple]:
        doc = self.doc
        for name, f in self._fields():
            if doc.get(f.get("FT")) == "Sig":
                s = doc.dict(f.get("V"))
                ranges = [int(doc.number(x)) for x in doc.list(s.get("ByteRange"))]
                yield name, doc.text(s.get("Name")), doc.text(s.get("M")), sum(ranges[1::2]), self.size

    def _outline_rows(self) -> Iterator[tuple]:
        doc, seen, n = self.doc, set(), 0
        todo = [(doc.dict(doc.catalog.get("Outlines")).get("First"), None, 1)]
        while todo:
            ref, parent, level = todo.pop()
            while isinstance(ref, Ref) and ref.number not in seen and n < MAX_CHAIN:
                seen.add(ref.number)
                o = doc.dict(ref)
                _, page = self._target(o.get("Dest", doc.dict(o.get("A")).get("D")))
                yield n, parent, level, doc.text(o.get("Title")), page
                if "First" in o:
                    todo.append((o.get("First"), n, level + 1))
                n += 1
                ref = o.get("Next")

    def _attachments_rows(self) -> Iterator[tuple]:
        doc = self.doc
        specs = [(doc.text(k), doc.dict(v)) for k, v in doc.tree(doc.dict(doc.catalog.get("Names")).get("EmbeddedFiles"), "Names")]
        specs += [(doc.text(doc.dict(v).get("UF", doc.dict(v).get("F"))), doc.dict(v)) for v in doc.list(doc.catalog.get("AF"))]
        for name, spec in specs:
            files = doc.dict(spec.get("EF"))
            s = doc.get(files.get("F", files.get("UF")))
            if isinstance(s, Stream):
                data = doc.decoded(s)
                big = len(data) > ATTACHMENT_BYTES
                yield name, len(data), None if big else base64.b64encode(data).decode(), big

    def _destinations_rows(self) -> Iterator[tuple]:
        yield from self._named().items()

    def _threads_rows(self) -> Iterator[tuple]:
        doc = self.doc
        for t, o in enumerate(doc.list(doc.catalog.get("Threads"))):
            ref, seen = doc.dict(o).get("F"), set()
            while isinstance(ref, Ref) and ref.number not in seen and len(seen) < MAX_CHAIN:
                bead = doc.dict(ref)
                box = [doc.number(x) for x in doc.list(bead.get("R"))]
                yield t, len(seen), self.page_of(bead.get("P")), *(box if len(box) == 4 else [None] * 4)
                seen.add(ref.number)
                ref = bead.get("N")

    def _structure_rows(self) -> Iterator[tuple]:
        doc = self.doc
        root = doc.dict(doc.catalog.get("StructTreeRoot"))
        roles = {str(k): str(doc.get(v)) for k, v in doc.dict(root.get("RoleMap")).items()}
        todo, seen, n = [(root.get("K"), None, None)], set(), 0
        while todo:
            o, parent, page = todo.pop()
            if isinstance(o, Ref):
                if o.number in seen:
                    continue
                seen.add(o.number)
            o = doc.get(o)
            if isinstance(o, list):
                todo += [(x, parent, page) for x in reversed(o)]
            elif isinstance(o, int):
                yield n, parent, None, page, o
                n += 1
            elif isinstance(o, dict):
                page = self.page_of(o.get("Pg")) if "Pg" in o else page
                if doc.get(o.get("Type")) == "MCR":
                    yield n, parent, None, page, doc.get(o.get("MCID"))
                    n += 1
                    continue
                role, hops = str(doc.get(o.get("S")) or ""), 0
                while role in roles and hops < 16:
                    role, hops = roles[role], hops + 1
                yield n, parent, role, page, None
                todo.append((o.get("K"), n, page))
                n += 1

    def _layers_rows(self) -> Iterator[tuple]:
        doc = self.doc
        oc = doc.dict(doc.catalog.get("OCProperties"))
        d = doc.dict(oc.get("D"))
        on, off = ({x.number for x in doc.list(d.get(k)) if isinstance(x, Ref)} for k in ("ON", "OFF"))
        base = doc.get(d.get("BaseState")) != "OFF"
        for ref in doc.list(oc.get("OCGs")):
            n = ref.number if isinstance(ref, Ref) else -1
            yield doc.text(doc.dict(ref).get("Name")), n in on or (base and n not in off)

    def _diagnostics_rows(self) -> Iterator[tuple]:
        for i in range(len(self._pages)):
            self._ran(i)
        yield from self.doc.diagnostics.rows

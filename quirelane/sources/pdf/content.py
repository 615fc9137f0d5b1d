"""Runs page programs: shown text as glyphs, painted paths as segments, placed images."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from quirelane.sources.pdf.document import Document
from quirelane.sources.pdf.fonts import Font
from quirelane.sources.pdf.objects import Name, Operator, Parser, Stream

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
MAX_FORMS, MAX_OPERATORS = 20, 5_000_000
#: Stands for any font where text is only counted.
COUNTED = object()


def times(a: Matrix, b: Matrix) -> Matrix:
    """a, then b."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3],
        a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def point(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def around(m: Matrix, x0: float, y0: float, x1: float, y1: float) -> tuple[float, float, float, float]:
    p = [point(m, x, y) for x in (x0, x1) for y in (y0, y1)]
    return min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p)


@dataclass
class State:
    ctm: Matrix = UNIT
    font: Font | None = None
    size: float = 0.0
    spacing: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0
    fill: str = "#000000"
    stroke: str = "#000000"


@dataclass
class Page:
    glyphs: list[tuple] = field(default_factory=list)
    segments: list[tuple] = field(default_factory=list)
    images: list[tuple] = field(default_factory=list)
    text_ops: int = 0
    invisible_ops: int = 0


def _hex(values: list[float]) -> str:
    """#rrggbb of gray, RGB or CMYK parts; others are black."""
    v = [min(1.0, max(0.0, x)) for x in values]
    if len(v) == 1:
        v = v * 3
    elif len(v) == 4:
        v = [(1 - c) * (1 - v[3]) for c in v[:3]]
    return "#" + "".join(f"{int(x * 255 + 0.5):02x}" for x in v) if len(v) == 3 else "#000000"


class Interpreter:
    def __init__(self, doc: Document, index: int, *, glyphs: bool = True) -> None:
        """Without ``glyphs``, shown text is counted but not placed."""
        self.doc, self.index, self.out, self.glyphs = doc, index, Page(), glyphs
        self.fonts: dict[int, Font] = {}
        self.marks: list[int | None] = []
        self.budget = MAX_OPERATORS

    def run(self, page: dict) -> Page:
        self._program(self.doc.contents(page), self.doc.dict(page.get("Resources")), State(), 0)
        return self.out

    def _font(self, resources: dict, name) -> Font | None:
        fonts = self.doc.dict(resources.get("Font"))
        head = self.doc.dict(fonts.get(name))
        if not head:
            self.doc.diagnostics.add("missing_font", str(name), self.index)
            return None
        if not self.glyphs:
            return COUNTED
        key = id(head)
        if key not in self.fonts:
            self.fonts[key] = Font(self.doc, head)
        return self.fonts[key]

    def _program(self, data: bytes, resources: dict, state: State, depth: int) -> None:
        doc, out = self.doc, self.out
        p, args, saved = Parser(data, 0, doc.diagnostics), [], []
        tm = line = UNIT
        path: list[tuple[str, float, float, float, float]] = []
        at = start = (0.0, 0.0)

        def move(x: float, y: float) -> None:
            nonlocal tm, line
            tm = line = times((1, 0, 0, 1, x, y), line)

        def show(s) -> None:
            nonlocal tm
            if not isinstance(s, bytes) or state.font is None:
                return
            f = state.font
            out.text_ops += 1
            out.invisible_ops += state.mode == 3
            if not self.glyphs:
                return
            whole = times(tm, state.ctm)
            size = abs(state.size * (whole[2] ** 2 + whole[3] ** 2) ** 0.5)
            mcid = next((k for k in reversed(self.marks) if k is not None), None)
            shared = (f.name, size, state.mode, state.fill)
            a, b, c, d, e, g = times((state.scale, 0, 0, 1, 0, state.rise), whole)
            low, high, upright = f.descent * state.size, f.ascent * state.size, not b and not c
            for text, width, sure, space in f.decode(s):
                advance = width * f.scale * state.size
                if upright:  # most text: two corners make the box
                    x0, x1, y0, y1 = e, a * advance + e, d * low + g, d * high + g
                    box = (x0 if x0 < x1 else x1, y0 if y0 < y1 else y1, x1 if x0 < x1 else x0, y1 if y0 < y1 else y0)
                else:
                    box = around((a, b, c, d, e, g), 0.0, low, advance, high)
                out.glyphs.append((text, *box, *shared, sure, mcid))
                step = (advance + state.spacing + (state.word if space else 0.0)) * state.scale
                tm = (*tm[:4], step * tm[0] + tm[4], step * tm[1] + tm[5])
                x, y = tm[4] * state.ctm[0] + tm[5] * state.ctm[2] + state.ctm[4], tm[4] * state.ctm[1] + tm[5] * state.ctm[3] + state.ctm[5]
                e, g = state.rise * whole[2] + x, state.rise * whole[3] + y

        n = lambda i: float(args[i]) if -len(args) <= i < len(args) and isinstance(args[i], (int, float)) else 0.0
        while not p.done():
            before = p.at
            o = p.object()
            if p.at == before:
                break
            if not isinstance(o, Operator):
                args.append(o)
                if len(args) > 64:
                    del args[0]
                continue
            self.budget -= 1
            if self.budget < 0:
                doc.diagnostics.add("too_many_operators", "the page's program was cut", self.index)
                return
            op = bytes(o)
            if op == b"q":
                if len(saved) < 1000:
                    saved.append(replace(state))
            elif op == b"Q":
                if saved:
                    state = saved.pop()
            elif op == b"cm":
                state.ctm = times(tuple(n(i) for i in range(-6, 0)), state.ctm)
            elif op == b"BT":
                tm = line = UNIT
            elif op == b"Tf":
                state.font, state.size = self._font(resources, args[-2] if len(args) > 1 else None), n(-1)
            elif op == b"Tc":
                state.spacing = n(-1)
            elif op == b"Tw":
                state.word = n(-1)
            elif op == b"Tz":
                state.scale = n(-1) / 100
            elif op == b"TL":
                state.leading = n(-1)
            elif op == b"Ts":
                state.rise = n(-1)
            elif op == b"Tr":
                state.mode = int(n(-1))
            elif op == b"Td":
                move(n(-2), n(-1))
            elif op == b"TD":
                state.leading = -n(-1)
                move(n(-2), n(-1))
            elif op == b"Tm":
                tm = line = tuple(n(i) for i in range(-6, 0))
            elif op == b"T*":
                move(0, -state.leading)
            elif op == b"Tj":
                show(args[-1] if args else None)
            elif op == b"'":
                move(0, -state.leading)
                show(args[-1] if args else None)
            elif op == b'"':
                state.word, state.spacing = n(-3), n(-2)
                move(0, -state.leading)
                show(args[-1] if args else None)
            elif op == b"TJ":
                for x in args[-1] if args and isinstance(args[-1], list) else []:
                    if isinstance(x, (int, float)):
                        tm = times((1, 0, 0, 1, -x / 1000 * state.size * state.scale, 0), tm)
                    else:
                        show(x)
            elif op in (b"g", b"rg", b"k", b"sc", b"scn"):
                state.fill = _hex([float(x) for x in args if isinstance(x, (int, float))])
            elif op in (b"G", b"RG", b"K", b"SC", b"SCN"):
                state.stroke = _hex([float(x) for x in args if isinstance(x, (int, float))])
            elif op == b"m":
                at = start = point(state.ctm, n(-2), n(-1))
            elif op == b"l":
                to = point(state.ctm, n(-2), n(-1))
                path.append(("l", *at, *to))
                at = to
            elif op in (b"c", b"v", b"y"):
                at = point(state.ctm, n(-2), n(-1))
            elif op == b"h":
                path.append(("l", *at, *start))
                at = start
            elif op == b"re":
                x, y, w, h = n(-4), n(-3), n(-2), n(-1)
                c = [point(state.ctm, *q) for q in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
                path += [("r", *c[i], *c[(i + 1) % 4]) for i in range(4)]
            elif op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
                for _, x0, y0, x1, y1 in path:
                    if abs(y0 - y1) <= 0.5 and abs(x0 - x1) > 0.5:
                        out.segments.append(("h", (y0 + y1) / 2, min(x0, x1), max(x0, x1)))
                    elif abs(x0 - x1) <= 0.5 and abs(y0 - y1) > 0.5:
                        out.segments.append(("v", (x0 + x1) / 2, min(y0, y1), max(y0, y1)))
                path = []
            elif op == b"n":
                path = []
            elif op in (b"BDC", b"BMC"):
                mark = args[-1] if op == b"BDC" and args else None
                if isinstance(mark, Name):
                    mark = doc.dict(doc.dict(resources.get("Properties")).get(mark))
                mcid = mark.get("MCID") if isinstance(mark, dict) else None
                self.marks.append(mcid if isinstance(mcid, int) else None)
            elif op == b"EMC":
                if self.marks:
                    self.marks.pop()
            elif op == b"Do":
                self._object(resources, args[-1] if args else None, state, depth)
            elif op == b"BI":
                self._inline(p, state)
            args = []

    def _object(self, resources: dict, name, state: State, depth: int) -> None:
        x = self.doc.get(self.doc.dict(resources.get("XObject")).get(name))
        if not isinstance(x, Stream):
            return
        kind = self.doc.get(x.head.get("Subtype"))
        if kind == "Image":
            self.out.images.append((*around(state.ctm, 0, 0, 1, 1), str(name), int(self.doc.number(x.head.get("Width"))), int(self.doc.number(x.head.get("Height")))))
        elif kind == "Form" and depth < MAX_FORMS:
            m = [self.doc.number(v) for v in self.doc.list(x.head.get("Matrix"))]
            inner = replace(state, ctm=times(tuple(m), state.ctm) if len(m) == 6 else state.ctm)
            self._program(self.doc.decoded(x), self.doc.dict(x.head.get("Resources")) or resources, inner, depth + 1)

    def _inline(self, p: Parser, state: State) -> None:
        head = {}
        while not p.done():
            key = p.object()
            if isinstance(key, Operator):
                break
            head[key] = p.object()
        end = p.at
        while True:
            end = p.data.find(b"EI", end + 1)
            if end < 0:
                p.at = len(p.data)
                break
            if p.data[end - 1 : end] in (b" ", b"\n", b"\r", b"\t") and (end + 2 >= len(p.data) or p.data[end + 2 : end + 3] in (b" ", b"\n", b"\r", b"\t", b"Q")):
                p.at = end + 2
                break
        size = [int(head.get(a, head.get(b, 0)) or 0) for a, b in (("W", "Width"), ("H", "Height"))]
        self.out.images.append((*around(state.ctm, 0, 0, 1, 1), "inline", *size))

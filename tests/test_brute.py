"""Registered queries that SQL can't express, and the folds and joins behind them, against plain Python."""

import math
import random
import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quirelane.operators import layout, merged_cells, ocr, reading, tables
from quirelane.plans import registry
from quirelane.sources import commit, sinks
from test_queries import DATA

LINE_COLUMNS = "doc_id long, page_index int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, baseline double, size double, rendering_mode int"


def read(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def page_lines():
    """The pages of plain texts, as the engine lays them out: doc_id, page, and its lines."""
    pages = defaultdict(list)
    for d in read("documents"):
        for n, text in enumerate(d["text"].split("\n")):
            row = n % 50
            y1 = 720.0 - 12 * row
            pages[d["doc_id"], n // 50].append({"line_no": n, "row_no": row, "text": text, "x0": 72.0, "y0": y1 - 10, "x1": 72.0 + 6 * len(text), "y1": y1, "size": 18.0 if row == 0 else 10.0, "rendering_mode": 3 if d["doc_id"] % 7 == 0 else 0})
    return pages


def brute_blocks(lines, width=600.0):
    """Block number of each line, top down."""
    out, block, own = {}, -1, []
    for r in sorted(lines, key=lambda r: (-r["baseline"], r["x0"])):
        if own:
            down = [*own, r]  # a line's height: from the baseline above to its bottom
            heights = sorted(x["baseline"] - y["y0"] for x, y in zip(down, down[1:], strict=False))
            median = heights[len(heights) // 2]
            f = own[0]
            ends = own[-1]["baseline"] - r["baseline"] > 1.5 * median or r["x0"] - f["x0"] > 0.03 * width or abs(r["size"] - f["size"]) > 1 or r["rendering_mode"] != f["rendering_mode"]
        if not own or ends:
            block, own = block + 1, []
        own.append(r)
        out[r["line_no"]] = block
    return out


@pytest.fixture(scope="module")
def laid_out():
    out = {}
    for key, lines in page_lines().items():
        for r in lines:
            r["baseline"] = r["y0"] + 0.2 * (r["y1"] - r["y0"])
        numbers, blocks = brute_blocks(lines), defaultdict(list)
        for r in lines:
            blocks[numbers[r["line_no"]]].append(r)
        out[key] = {b: {"text": "\n".join(r["text"] for r in sorted(rows, key=lambda r: r["line_no"])), "n_lines": len(rows), "box": (min(r["x0"] for r in rows), min(r["y0"] for r in rows), max(r["x1"] for r in rows), max(r["y1"] for r in rows))} for b, rows in blocks.items()}
    return out


def test_blocks_query(spark, laid_out):
    got = registry.QUERIES["blocks"](spark, DATA).collect()
    want = {(*key, b): (v["text"], v["n_lines"], v["box"]) for key, blocks in laid_out.items() for b, v in blocks.items()}
    assert {(r["doc_id"], r["page_index"], r["block_index"]): (r["text"], r["n_lines"], (r["x0"], r["y0"], r["x1"], r["y1"])) for r in got} == want and len(got) == len(want)


def brute_cut(boxes, width, depth=0):
    """Recursive cuts of (x0, y0, x1, y1, name) boxes by trying every gap."""
    def gaps(lo, hi, least):
        found = []
        for at in sorted({b[hi] for b in boxes}):
            after = [b[lo] for b in boxes if b[lo] >= at]
            if after and all(b[hi] <= at or b[lo] >= at for b in boxes) and min(after) - at >= least and min(after) > at:
                found.append((min(after) - at, at, (min(after) + at) / 2))
        return max(found, key=lambda g: (g[0], -g[1]), default=None)

    if len(boxes) > 1 and depth < 20:
        if g := gaps(0, 2, min(0.03 * width, 15.0)):
            return brute_cut([b for b in boxes if b[0] < g[2]], width, depth + 1) + brute_cut([b for b in boxes if b[0] >= g[2]], width, depth + 1)
        if g := gaps(1, 3, min(0.03 * width, 10.0)):
            return brute_cut([b for b in boxes if b[1] >= g[2]], width, depth + 1) + brute_cut([b for b in boxes if b[1] < g[2]], width, depth + 1)
    return sorted(boxes, key=lambda b: (-b[3], b[0], b[4]))


def test_reading_order_query(spark, laid_out):
    got = registry.QUERIES["reading_order"](spark, DATA).collect()
    want = {(*key, b[4]): i for key, blocks in laid_out.items() for i, b in enumerate(brute_cut([(*v["box"], n) for n, v in blocks.items()], 612.0))}
    assert {(r["doc_id"], r["page_index"], r["block_index"]): r["reading_order"] for r in got} == want and len(got) == len(want)


def test_cuts_of_random_pages(spark):
    rng = random.Random(2)
    rows = []
    for page in range(12):
        for i in range(rng.randint(1, 14)):
            x, y = rng.choice([50, 200, 330]) + rng.random() * 10, rng.randrange(0, 700)
            rows.append((1, page, i, x, float(y), x + rng.choice([80, 120, 260]), float(y + rng.randint(5, 40))))
    df = spark.createDataFrame(rows, "doc_id long, page_index int, block_index int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["page_index"], r["block_index"]): r["reading_order"] for r in layout.xy_cut(df, 612.0).collect()}
    for page in range(12):
        boxes = [(*r[3:], r[2]) for r in rows if r[1] == page]
        assert {(page, b[4]): i for i, b in enumerate(brute_cut(boxes, 612.0))} == {k: v for k, v in got.items() if k[0] == page}


def brute_distance(a, b):
    table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return table[-1][-1]


def test_word_error_rate_query(spark):
    words = lambda t: [w for w in (re.sub(r"^[^\w]+|[^\w]+$|^_+|_+$", "", x) for x in t.lower().split()) if w]
    want = {}
    for r in read("benchmark"):
        a, b = words(r["text"]), words(r["text"].replace(" the ", " tbe "))
        want[r["item_id"]] = round(brute_distance(a, b) / len(a), 6)
    assert {r["item_id"]: r["wer"] for r in registry.QUERIES["word_error_rate"](spark, DATA).collect()} == want and any(want.values())
    df = spark.createDataFrame([("a b c", "a x"), ("", ""), ("", "a"), ("a", "")], "r string, f string")
    assert [r["wer"] for r in ocr.word_error_rate(df, "r", "f").collect()] == [2 / 3, 0.0, 1.0, 1.0]


# tables without rules


def brute_clusters(spans):
    """(cluster, x0, y0) of one page: a cluster holds what lies within two points of its first start."""
    out, anchor, n = [], None, -1
    for x, y in sorted(spans):
        if anchor is None or x - anchor > 2:
            anchor, n = x, n + 1
        out.append((n, x, y))
    return out


def half_up(v):
    return math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)


def brute_grids(spans):
    found = brute_clusters(spans)
    columns = {c for c, _, _ in found if sum(x[0] == c for x in found) >= 3}
    held = [f for f in found if f[0] in columns]
    beside = defaultdict(set)
    for c, _, y in held:
        beside[half_up(y / 2)].add(c)
    rows = sorted((y for y, c in beside.items() if len(c) >= 2), reverse=True)
    text = any(2 * sum(half_up(y / 2) in rows for k, _, y in held if k == c) < sum(k == c for k, _, _ in held) for c in columns)
    if len(columns) < 3 or len(rows) < 3 or text:
        return []
    ranges = [[rows[0]]]
    for y in rows[1:]:
        ranges.append([y]) if (ranges[-1][-1] - y) * 2 > 100 else ranges[-1].append(y)
    xs, out = sorted(min(x for k, x, _ in held if k == c) for c in columns), []
    for n, r in enumerate(ranges):
        ys = sorted({2.0 * half_up(y / 2) for _, _, y in found if r[-1] * 2 <= y <= r[0] * 2}, reverse=True)
        if len(ys) >= 3:
            out.append((n, xs[0], ys[-1], xs[-1], ys[0], xs, ys))
    return out


def test_borderless_grids(spark):
    rng = random.Random(7)
    rows = []
    for page in range(80):
        starts = [rng.choice([60, 61.5, 150, 152, 240, 330.5]) for _ in range(rng.randint(2, 5))]
        y = 740.0
        for _ in range(rng.randint(2, 12)):
            y -= rng.choice([12, 12, 13.3, 60, 101, 140])
            rows += [(1, page, float(x + rng.choice([0, 0, 0.7, 2.5])), y + rng.choice([0, 0, 0.4])) for x in starts if rng.random() < 0.85]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, x0 double, y0 double")
    got = defaultdict(list)
    for r in tables.borderless_grids(tables.anchored_clusters(df)).orderBy("page_index", "grid").collect():
        got[r["page_index"]].append((r["grid"], r["x0"], r["y0"], r["x1"], r["y1"], list(r["xs"]), list(r["ys"])))
    want = {page: brute_grids([(x, y) for _, p, x, y in rows if p == page]) for page in range(80)}
    assert dict(got) == {p: g for p, g in want.items() if g}
    assert sum(len(g) > 1 for g in want.values()) > 3 and sum(not g for g in want.values()) > 3


def test_borderless_tables_query(spark):
    pages = defaultdict(list)
    for key, lines in page_lines().items():
        for r in lines:
            at = 0
            for w in r["text"].split(" "):
                if w:
                    pages[key].append((72.0 + 6 * at, r["y0"]))
                at += len(w) + 1
    want = {}
    for key, spans in pages.items():
        found = brute_clusters(spans)
        columns = {c for c, _, _ in found if sum(x[0] == c for x in found) >= 3}
        beside = defaultdict(set)
        for c, _, y in found:
            if c in columns:
                beside[math.floor(y / 2)].add(c)
        n = sum(len(c) >= 2 for c in beside.values())
        if n >= 3 and len(columns) >= 3:
            want[key] = (n, len(columns))
    got = registry.QUERIES["borderless_tables"](spark, DATA).collect()
    assert {(r["doc_id"], r["page_index"]): (r["n_rows"], r["n_columns"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("side", [72.0, 216.0])
def test_crossings_of_random_segments(spark, monkeypatch, side):
    monkeypatch.setattr(tables, "CELL", side)
    rng = random.Random(9)
    rows = []
    for page in range(6):
        for _ in range(60):
            lo = rng.choice([0.0, 71.5, 72.0, 143.0, rng.random() * 500])
            rows.append((1, page, rng.choice("hv"), rng.choice([0.0, 71.0, 72.0, 73.0, rng.random() * 600]), lo, lo + rng.choice([0, 1, 70, 400, -3])))
    df = spark.createDataFrame(rows, "doc_id long, page_index int, orientation string, pos double, lo double, hi double")
    got = sorted((r["page_index"], r["x"], r["y"]) for r in tables.intersections(df).collect())
    want = {
        (p, float(F_round(x)), float(F_round(y)))
        for _, p, o, y, hx0, hx1 in rows if o == "h"
        for _, q, w, x, vy0, vy1 in rows if w == "v" and p == q and hx0 - 1 <= x <= hx1 + 1 and vy0 - 1 <= y <= vy1 + 1
    }
    assert got == sorted(want)


def F_round(v):  # noqa: N802
    from decimal import ROUND_HALF_UP, Decimal

    return Decimal(repr(v)).quantize(Decimal("0.1"), ROUND_HALF_UP)


# nearest neighbours


def brute_docstrum(boxes, k=5, degrees=30.0):
    """Order of (name, x0, y0, x1, y1) boxes."""
    names = sorted(b[0] for b in boxes)
    at = {b[0]: ((b[1] + b[3]) / 2, (b[2] + b[4]) / 2) for b in boxes}
    follow, led = {n: [] for n in names}, set()
    for i in names:
        near = sorted((j for j in names if j != i), key=lambda j: (math.dist(at[i], at[j]), j))[:k]
        for j in near:
            dx, dy = at[j][0] - at[i][0], at[j][1] - at[i][1]
            angle = abs(math.degrees(math.atan2(dy, dx)))
            if (angle <= degrees + 1e-9) if abs(dy) < abs(dx) else abs(angle - 90) <= degrees + 1e-9 and dy != 0:
                follow[i].append(j)
                if dy < 0:
                    led.add(j)
    first = lambda n: (math.floor(at[n][0] / 100), -at[n][1], n)
    roots = sorted((n for n in names if n not in led), key=first) or sorted(names, key=first)
    order = []

    def visit(n):
        if n not in order:
            order.append(n)
            for j in sorted(follow[n], key=lambda j: (-at[j][1], at[j][0], j)):
                visit(j)

    for r in roots:
        visit(r)
    return order + [n for n in names if n not in order]


def test_nearest_neighbours(spark):
    """Clusters of very different density, and pages of one to six blocks."""
    rng = random.Random(11)
    rows = []
    for page, n in enumerate((1, 2, 5, 6, 40, 90)):
        for i in range(n):
            x, y = (rng.random() * 30, rng.random() * 30) if i % 3 else (rng.random() * 600, rng.random() * 700)
            rows.append((1, page, i, x, y, x + rng.random() * 9, y + 4))
    df = spark.createDataFrame(rows, "doc_id long, page_index int, block_index int, x0 double, y0 double, x1 double, y1 double")
    got = defaultdict(list)
    for r in reading.neighbours(df).collect():
        got[r["page_index"], r["block_index"]].append((round(r["gap"], 9), r["other"]))
    for _, page, i, x0, y0, x1, y1 in rows:
        mine = ((x0 + x1) / 2, (y0 + y1) / 2)
        all_of = sorted((round(math.dist(mine, ((a + c) / 2, (b + d) / 2)), 9), j) for _, p, j, a, b, c, d in rows if p == page and j != i)
        assert sorted(got[page, i]) == all_of[:5]
    orders = {(r["page_index"], r["block_index"]): r["reading_order"] for r in reading.docstrum(df).collect()}
    for page in range(6):
        want = brute_docstrum([(r[2], *r[3:]) for r in rows if r[1] == page])
        assert {b: o for (p, b), o in orders.items() if p == page} == {b: o for o, b in enumerate(want)}


def test_docstrum_query(spark):
    got = registry.QUERIES["docstrum_order"](spark, DATA).collect()
    want = {}
    for key, lines in page_lines().items():
        boxes = []
        for r in lines:
            left = 330.0 if r["row_no"] % 3 == 2 else 60.0
            boxes.append((r["row_no"], left, 740.0 - 14 * r["row_no"], left + 20 + len(r["text"]) % 200, 750.0 - 14 * r["row_no"]))
        want |= {(*key, b): o for o, b in enumerate(brute_docstrum(boxes))}
    assert {(r["doc_id"], r["page_index"], r["block_index"]): r["reading_order"] for r in got} == want and len(got) == len(want)


def test_merged_cells_query(spark):
    """Two rows and three columns, whose rule at 200 covers 95 of 200 points: the upper cells join."""
    got = registry.QUERIES["merged_cells"](spark, DATA).collect()
    shapes = defaultdict(set)
    for r in got:
        shapes[r["doc_id"]].add((r["row"], r["col"], r["rowspan"], r["colspan"], r["x0"], r["y0"], r["x1"], r["y1"]))
    rules_v = [(0.0, 0.0, 200.0), (300.0, 0.0, 200.0), (100.0, 0.0, 200.0), (200.0, 0.0, 95.0)]
    xs, ys, want, row = [0.0, 100.0, 200.0, 300.0], [200.0, 100.0, 0.0], set(), 0
    for top, low in zip(ys, ys[1:], strict=False):
        at = 0
        while at < 3:
            end = at + 1
            while end < 3 and merged_cells.covered(rules_v, xs[end], low, top) < 0.8:
                end += 1
            want.add((row, at, 1, end - at, xs[at], low, xs[end], top))
            at = end
        row += 1
    assert set(shapes) == {r["o_orderkey"] for r in read("orders")}
    assert all(s == want for s in shapes.values())


# outputs together


def output_pages(spark):
    return spark.createDataFrame([(1, 0, "a", "# a"), (1, 1, "b", "# b"), (2, 0, "", "")], "doc_id long, page_index int, page_text string, markdown string")


def shown(tmp_path):
    return sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc"))


def test_outputs_are_shown_together(spark, tmp_path):
    sinks.write_set(output_pages(spark), ["text", "markdown", "json"], str(tmp_path / "set"))
    assert shown(tmp_path) == ["set"] and shown(tmp_path / "set") == ["json", "markdown", "text"]
    assert {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "set/markdown")).collect()} == {1: "# a\f# b", 2: ""}
    with pytest.raises(Exception, match="FileExists"):
        sinks.write_set(output_pages(spark), ["text"], str(tmp_path / "set"))
    assert shown(tmp_path) == ["set"] and shown(tmp_path / "set") == ["json", "markdown", "text"]
    sinks.write_set(output_pages(spark).where("doc_id = 2"), ["text"], str(tmp_path / "set"), overwrite=True)
    assert shown(tmp_path) == ["set"] and shown(tmp_path / "set") == ["text"] and spark.read.parquet(str(tmp_path / "set/text")).count() == 1


def test_failing_output_leaves_none(spark, tmp_path):
    """The second output fails after rows of the first were written: neither is there, nor is anything half-done."""
    good = spark.range(0, 1000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("x").alias("value"))
    bad = good.select("doc_id", F.when(F.col("doc_id") == 990, F.raise_error(F.lit("no such page"))).otherwise(F.lit("y")).alias("value"))
    with pytest.raises(Exception, match="no such page"):
        commit.write_together({"first": good, "second": bad}, str(tmp_path / "set"))
    assert shown(tmp_path) == []
    commit.write_together({"first": good, "second": good.limit(0)}, str(tmp_path / "set"))
    before = sorted(shown(tmp_path / "set/first"))
    with pytest.raises(Exception, match="no such page"):
        commit.write_together({"first": good, "second": bad}, str(tmp_path / "set"), overwrite=True)
    assert shown(tmp_path) == ["set"] and sorted(shown(tmp_path / "set/first")) == before
    assert shown(tmp_path / "set/second") == [] and spark.read.parquet(str(tmp_path / "set/first")).count() == 1000


def test_leavings_of_lost_tasks_go(tmp_path):
    """Files of the staging folder that no finished task has named are never shown."""
    import pyarrow as pa

    w = commit.OutputsWriter(f"file://{tmp_path}/set", ["a"], False)
    w.prepare()
    rows = lambda v: iter([pa.RecordBatch.from_pydict({"value": [v], commit.OUTPUT: ["a"]})])
    lost, kept = w.write(rows("lost")), w.write(rows("kept"))
    assert lost.files != kept.files
    w.commit([kept, None])
    assert pq.read_table(tmp_path / "set" / "a").to_pylist() == [{"value": "kept"}]
    w = commit.OutputsWriter(f"file://{tmp_path}/other", ["a"], False)
    w.prepare()
    w.abort([None])
    with pytest.raises(OSError):
        w.write(rows("late"))
    assert shown(tmp_path) == ["set"]


def test_hybrid_page_of_a_file(spark, tmp_path):
    """Three pages: text on the upper part over an image on the lower one; text alone; an image alone."""
    from quirelane import api
    from quirelane.sources.pdf import writer

    text = b"".join(b"BT /F1 12 Tf 1 0 0 1 20 %d Tm (%s) Tj ET\n" % (780 - 14 * i, b"x" * 78) for i in range(18))
    image = b"q 612 0 0 %d 0 0 cm /Im1 Do Q\n"
    bodies = [image % 500 + text, text, image % 792]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 3 /Kids [5 0 R 7 0 R 9 0 R] /MediaBox [0 0 612 792] >>"]
    objects.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding /FirstChar 0 /Widths [%s] >>" % b" ".join([b"600"] * 256))
    objects.append(writer.stream(b"\x00", b"/Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8"))
    for i, body in enumerate(bodies):
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /Im1 4 0 R >> >> >>" % (6 + 2 * i))
        objects.append(writer.stream(body))
    (tmp_path / "x.pdf").write_bytes(writer.assemble(objects))
    got = {r["page_index"]: r for r in api.classify_pages(spark, str(tmp_path)).collect()}
    assert [got[i]["page_class"] for i in range(3)] == ["hybrid", "vector", "scanned"]
    # rows from the top: 3 to 7 lie below the text and above nothing but the image
    assert got[0]["hybrid_cells"] == list(range(24, 64)) and got[1]["hybrid_cells"] is None and got[2]["hybrid_cells"] is None


def test_perceptual_hashes_query(spark):
    """Cosine parts by their definition; and bitmaps that aren't square."""
    from statistics import median

    from quirelane.operators import glyphs

    wave = [[math.cos(math.pi * (2 * x + 1) * k / 16) for x in range(8)] for k in range(8)]
    got = {r["vec_id"]: r["hash"] for r in registry.QUERIES["perceptual_hashes"](spark, DATA).collect()}
    rows = read("embeddings")
    assert len(got) == len(rows)
    for r in rows[::7]:
        dots = [1.0 if x > 0 else 0.0 for x in r["embedding"]]
        parts = [sum(wave[k][y] * wave[j][x] * dots[8 * y + x] for y in range(8) for x in range(8)) for k in range(8) for j in range(8)]
        middle = median(parts[1:])
        near = [i for i, v in enumerate(parts) if abs(v - middle) < 1e-9]  # rounding may decide these either way
        want = sum(1 << i for i, v in enumerate(parts) if v > middle)
        assert (got[r["vec_id"]] % 2**64 | sum(1 << i for i in near)) == (want | sum(1 << i for i in near))
    df = spark.createDataFrame([(1, [1] * 63), (2, None), (3, []), (4, [0] * 4)], "i int, bitmap array<int>")
    assert [r["hash"] for r in glyphs.perceptual_hashes(df).collect()] == [None] * 4


def test_page_columns_both_ways(spark):
    """Columns of one pass equal those of the histogram, its gaps and the confirmed ranges, taken one by one."""
    rng = random.Random(13)
    rows = []
    for page in range(30):
        for line in range(rng.randint(6, 40)):
            for start in rng.sample([0, 3, 72, 200, 340, 598, 700, -5], rng.choice([1, 1, 1, 2])):
                rows.append((1, page, line, float(start + rng.randint(0, 30))))
    df = spark.createDataFrame(rows, "doc_id long, page_index int, line_no int, x0 double")
    starts = df.groupBy("doc_id", "page_index", "line_no").agg(F.min("x0").alias("x0"))
    steps = layout.confirm_columns(layout.column_gaps(layout.x0_histogram(df, 612.0), 612.0), starts, 612.0)
    columns = ["page_index", "x0", "x1", "n_lines", "column"]
    want = sorted(map(tuple, steps.select(*columns).collect()))
    assert sorted(map(tuple, layout.page_columns(df, 612.0).select(*columns).collect())) == want and max(w[-1] for w in want) > 1

"""Around the recogniser, reading order and assembled tables."""

import numpy as np
from pyspark.sql import functions as F

from quirelane.operators import reading, recognition


def test_hocr():
    xml = '<html><span class="ocrx_word" title="bbox 10 20 30 40; x_wconf 90">Hi</span><span class="ocr_line">x</span></html>'
    assert recognition.parse_hocr(xml) == [("Hi", 10.0, 20.0, 30.0, 40.0, 0.9)]
    assert recognition.parse_hocr(xml, height=100.0)[0][2:5:2] == (60.0, 80.0) and recognition.parse_hocr("<broken") == []


def test_skew():
    g = np.full((120, 200), 255, np.uint8)
    for row in (30, 60, 90):
        for x in range(200):
            g[int(round(row + x * np.tan(np.radians(2.0)))), x] = 0
    assert abs(recognition.skew(g) - 2.0) <= 0.25
    flat = recognition.deskewed(g, recognition.skew(g))
    assert abs(recognition.skew(flat)) <= 0.25 and recognition.skew(np.full((5, 5), 255, np.uint8)) == 0.0


def test_crops_and_engine(spark):
    pages = spark.createDataFrame([(1, 72.0, 144.0)], "doc_id long, width double, height double")
    c = recognition.cell_crops(pages, dpi=72)
    r = c.where("cell = 63").first()
    assert c.count() == 64 and (r["left"], r["top"], r["right"], r["bottom"]) == (63, 126, 72, 144)
    got = recognition.recognise(pages.withColumn("image", F.lit(b"abc")).select("doc_id", "image"), lambda b: [(b.decode(), 0.0, 0.0, 1.0, 1.0, 0.5)]).collect()
    assert [tuple(r) for r in got] == [(1, "abc", 0.0, 0.0, 1.0, 1.0, 0.5)]


def test_region_policy(spark):
    rows = [(1, 0, 100.0, 0.0, 0.1), (1, 0, 105.0, 0.0, 0.2), (1, 0, 200.0, 0.0, 0.9)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, y0 double, x0 double, confidence double")
    assert [r["falls_back"] for r in recognition.region_policy(df).orderBy("y0").collect()] == [True, True, False]


def test_docstrum(spark):
    rows = [(1, 0, i, x, y, x + 50, y + 10) for i, (x, y) in enumerate([(0.0, 700.0), (0.0, 680.0), (0.0, 660.0)])]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, block_index int, x0 double, y0 double, x1 double, y1 double")
    assert [r["block_index"] for r in reading.docstrum(df).orderBy("reading_order").collect()] == [0, 1, 2]


def test_kinds_and_tables(spark):
    df = spark.createDataFrame([("H2",), ("LI",), ("Odd",), (None,)], "role string")
    got = df.select(reading.block_kind(F.col("role")), reading.heading_level(F.col("role"))).collect()
    assert [tuple(r) for r in got] == [("heading", 2), ("list", None), ("paragraph", None), ("paragraph", None)]
    cells = spark.createDataFrame([(1, 0, 0, 1, "b"), (1, 0, 0, 0, "a"), (1, 0, 1, 0, "c")], "doc_id long, page_index int, row int, col int, text string")
    t = reading.assembled(cells.withColumns({"rowspan": F.lit(1), "colspan": F.lit(1), "header": F.lit(False)})).first()
    assert [[c["text"] for c in r["cells"]] for r in t["rows"]] == [["a", "b"], ["c"]]


def test_hybrid_pages(spark):
    """Dark boxes in two scanned cells are found; one that an embedded span covers isn't doubled, and a failing cell is skipped."""
    import numpy as np

    from quirelane.operators import recognition

    gray = np.full((792, 612), 255, np.uint8)
    gray[750:760, 10:50] = 0  # in cell 56, the lowest on the left: y from 32 to 42
    gray[700:710, 100:140] = 0  # in cell 57
    gray[100:110, 10:50] = 0  # in a cell that isn't scanned

    def engine(crop):
        y, x = np.nonzero(crop < 128)
        if not len(x):
            raise RuntimeError("nothing here")
        return [("w", float(x.min()), float(y.min()), float(x.max() + 1), float(y.max() + 1), 0.9)]

    pages = spark.createDataFrame([(1, 0, 612.0, 792.0, gray.tobytes()), (1, 1, 612.0, 792.0, gray.tobytes()), (2, 0, 612.0, 792.0, b"short"), (3, 0, 612.0, 792.0, None)], "doc_id long, page_index int, width double, height double, image binary")
    cells = spark.createDataFrame([(1, 0, [56, 57, 60]), (1, 1, None), (2, 0, [56]), (3, 0, [56])], "doc_id long, page_index int, hybrid_cells array<int>")
    spans = spark.createDataFrame([(1, 0, "own", 100.0, 82.0, 140.0, 92.0, 1.0), (1, 1, "other page", 0.0, 0.0, 9.0, 9.0, 1.0), (2, 0, "kept", 0.0, 0.0, 9.0, 9.0, 1.0)], "doc_id long, page_index int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    got = sorted((r["doc_id"], r["page_index"], r["source"], r["text"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in recognition.hybrid_pages(pages, cells, spans, engine, dpi=72).collect())
    assert got == [(1, 0, "ocr", "w", 10.0, 32.0, 50.0, 42.0), (1, 0, "vector", "own", 100.0, 82.0, 140.0, 92.0), (2, 0, "vector", "kept", 0.0, 0.0, 9.0, 9.0)]

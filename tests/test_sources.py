"""Sources, sinks, repairs and the calls over PDF files."""

import http.server
import threading

import pytest
from pyspark.sql import functions as F

from quirelane import api
from quirelane.functions import scalars
from quirelane.operators import merged_cells, ocr, profile_files, repair
from quirelane.sources import http as web
from quirelane.sources import sinks
from quirelane.sources.pdf import writer

BODY = bytes(range(256)) * 1024


class Handler(http.server.BaseHTTPRequestHandler):
    seen = []

    def do_GET(self):
        r = self.headers.get("Range")
        Handler.seen.append(r)
        if r and self.path != "/plain":
            a, b = (int(x) for x in r.removeprefix("bytes=").split("-"))
            part = BODY[a : b + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(BODY)}")
        else:
            part = BODY
            self.send_response(200)
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_ranges(server):
    r = web.RangeReader(f"{server}/a", allow_private=True)
    n = r.requests
    assert r.read(10, 20) == BODY[10:30] and r.read(0, web.BLOCK) == BODY[: web.BLOCK] and r.requests == n + 1
    assert r.read(web.BLOCK - 5, 3 * web.BLOCK) == BODY[web.BLOCK - 5 : 4 * web.BLOCK - 5] and r.requests == n + 2
    assert r.read(len(BODY) - 3, 100) == BODY[-3:] and r.read(len(BODY), 1) == b""
    assert web.RangeReader(f"{server}/plain", allow_private=True).read(5, 5) == BODY[5:10]


@pytest.mark.parametrize("url", ["http://example.com/", "https://127.0.0.1/", "https://10.0.0.1/", "https://169.254.169.254/latest", "https://[::1]/", "https://localhost/", "https://a.internal/", "ftp://x/", "https:///x"])
def test_private_addresses(url):
    with pytest.raises(ValueError):
        web.check_address(url)


def test_http_source(spark, server):
    spark.dataSource.register(web.HttpFiles)
    df = spark.read.format("http_files").option("urls", f"{server}/a {server}/plain").option("allowPrivate", "true").load()
    assert [(r["length"], bytes(r["content"]) == BODY) for r in df.collect()] == [(len(BODY), True)] * 2


def test_public_url_column(spark):
    urls = ["https://example.com/x", "http://example.com", "https://10.1.1.1/", "https://172.20.0.1", "https://192.168.0.1:8443/x", "https://u@localhost/", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(scalars.is_public_url(F.col("u"))).collect()] == [True, *[False] * 6]


def test_output_rules():
    sinks.check_outputs([("json", "-"), ("text", "a")])
    for bad in ([("json", "-"), ("text", "-")], [("ndjson", "a"), ("text", "b")], [("xml", "a")]):
        with pytest.raises(ValueError):
            sinks.check_outputs(bad)


def test_fan_out(spark, tmp_path):
    pages = spark.createDataFrame([(1, 0, "a", "# a"), (1, 1, "b", "# b"), (2, 0, "", "")], "doc_id long, page_index int, page_text string, markdown string")
    sinks.write_all(pages, [(f, str(tmp_path / f)) for f in ("json", "text", "markdown")])
    assert {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "text")).collect()} == {1: "a\fb", 2: ""}
    sinks.write_all(pages, [("ndjson", str(tmp_path / "nd"))])
    assert spark.read.json(str(tmp_path / "nd")).groupBy("frame").count().count() == 3


def test_page_ranges():
    assert scalars.parse_page_ranges("1-3,5,8-", 10) == ([0, 1, 2, 4, 7, 8, 9], [])
    assert scalars.parse_page_ranges("5-2", 10) == ([], ["5-2"]) and scalars.parse_page_ranges("99", 10) == ([], ["99"])
    for bad in ("0", "a", "1-0", "", "1,,2"):
        with pytest.raises(ValueError):
            scalars.parse_page_ranges(bad, 10)
    assert scalars.parse_size("2KB") == 2048 and scalars.parse_size("1g") == 1 << 30


def test_edit_distance():
    import random

    random.seed(0)
    for _ in range(200):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 8))] for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d = [i, *d[1:]] if False else [i] + [0] * len(b) if False else d
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(d[j] + 1, row[-1] + 1, d[j - 1] + (x != y)))
            d = row
        assert ocr.edit_distance(a, b) == d[-1]


def test_images():
    import numpy as np

    g = np.zeros((20, 20), np.uint8)
    g[:, 10:] = 200
    assert 0 <= ocr.otsu(g) < 200 and ocr.stretch(g).max() == 255 and ocr.median3(g).shape == g.shape
    assert ocr.sauvola(g).dtype == bool


def test_word_gaps(spark):
    rows, x = [], 0.0
    for i in range(60):
        x += 5 + (4 if i % 6 == 0 else 0.1)
        rows.append((1, 0, i, x, 0.0, x + 5, 10.0, 10.0))
        x += 0
    df = spark.createDataFrame(rows, "doc_id long, page_index int, glyph_index int, x0 double, y0 double, x1 double, y1 double, size double")
    got = [r["glyph_index"] for r in repair.word_gaps(df).where("word_start").collect()]
    assert sorted(got) == list(range(0, 60, 6))


def plain_word_starts(gaps, sizes, fonts):
    """Thresholds gap by gap, with a list of all gaps since the last font change."""
    import statistics

    out, held, limit, font = [], [], None, None
    for gap, size, f in zip(gaps, sizes, fonts, strict=True):
        if f != font:
            held, limit, font = [], 0.25 * size, f
        if gap is None:
            out.append(True)
            continue
        if gap <= 0:
            out.append(False)
            continue
        out.append(gap > limit)
        held.append(gap)
        if len(held) > 20 and len(held) % 5 == 0:
            kept = [g for g in held[-20:] if g <= 4 * limit]
            limit = 1.5 * statistics.median(kept) if kept else limit
    return out


def test_word_gaps_against_plain_rules(spark):
    """Negative gaps, moving thresholds, outliers, new lines and font changes."""
    import random

    random.seed(9)
    rows, gaps, sizes, fonts, x, y = [], [], [], [], 0.0, 700.0
    for i in range(600):
        gap = random.choice([0.25, 0.5, 0.5, 0.75, 2.0, 4.0, 30.0, 0.0, -1.0]) * (1 if i < 300 else 4)
        if i % 97 == 0:
            x, y, gap = 0.0, y - 20, None
        x += gap or 0.0
        rows.append((1, 0, i, x, y, x + 5, y + 10, 10.0, f"f{i // 150}"))
        gaps.append(gap)
        sizes.append(10.0)
        fonts.append(f"f{i // 150}")
        x += 5
    df = spark.createDataFrame(rows, "doc_id long, page_index int, glyph_index int, x0 double, y0 double, x1 double, y1 double, size double, font string")
    got = [r["word_start"] for r in repair.word_gaps(df).orderBy("glyph_index").collect()]
    assert got == plain_word_starts(gaps, sizes, fonts)


def test_word_gaps_of_pages_over_batches(spark):
    """Pages that go on from one batch to the next, pages of one glyph, and a null page."""
    rows = [(d, p, i, 9.0 * i if i % 3 else 9.0 * i + 4, 0.0, 9.0 * i + 9, 10.0, 10.0) for d, p, n in ((1, 0, 7), (1, 1, 1), (2, None, 8), (3, 0, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, glyph_index int, x0 double, y0 double, x1 double, y1 double, size double")
    want = {(r[0], r[2]) if r[1] is None else (r[0], r[1], r[2]) for r in rows if r[2] % 3 == 0}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "4", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = repair.word_gaps(df)
            assert got.count() == len(rows)
            marked = got.where("word_start").collect()
            assert {(r["doc_id"], r["glyph_index"]) if r["page_index"] is None else (r["doc_id"], r["page_index"], r["glyph_index"]) for r in marked} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_pages_in_order_lose_none(spark, tmp_path):
    """Forty pages that come last page first, in several batches; and a bound that fails instead of losing pages."""
    from pyspark.sql.utils import StreamingQueryException

    from quirelane.streaming import frames

    for i, part in enumerate(([*range(39, 20, -1)], [*range(20, 5, -1)], [*range(5, -1, -1), 3, 39])):
        spark.createDataFrame([(1, p, f"t{p}") for p in part], "doc_id long, page_index int, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("doc_id long, page_index int, text string").parquet(f"{tmp_path}/in")
        frames.run_once(frames.in_order(stream), f"{tmp_path}/out", f"{tmp_path}/state")
        assert spark.read.parquet(f"{tmp_path}/out").count() == (0, 0, 40)[i]
    assert sorted((r["page_index"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(p, f"t{p}") for p in range(40)]
    one_by_one = spark.readStream.schema("doc_id long, page_index int, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with pytest.raises(StreamingQueryException):
        frames.run_once(frames.in_order(one_by_one, most=8), f"{tmp_path}/out2", f"{tmp_path}/state2")


def test_page_class_by_density(spark):
    """Text whose extracted share is below 0.03 is scanned with 0.95, though its characters are valid; sparse good text is not."""
    from quirelane.operators import page_class

    base = {"text_ops": 10, "invisible_ops": 0, "image_share": 0.0, "full_page_image": False, "chars": 100, "valid_chars": 100, "page_area": 484704.0, "density_ratio": 0.5, "vector_cells": 0, "scanned_cells": 0}
    cases = [({}, "vector", 1.0), ({"density_ratio": 0.02}, "scanned", 0.95), ({"density_ratio": 0.03}, "vector", 1.0), ({"valid_chars": 80}, "scanned", 1.0), ({"valid_chars": 30}, "broken_vector", 0.8 / 1.45)]
    df = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _, _) in enumerate(cases)], ["doc_id", *base])
    got = {r["doc_id"]: (r["page_class"], r["class_confidence"]) for r in page_class.classify(df).collect()}
    for i, (_, name, confidence) in enumerate(cases):
        assert got[i][0] == name and abs(got[i][1] - confidence) < 1e-9, cases[i]


def test_letters_in_base_26(spark):
    from pyspark.sql import functions as F

    from quirelane.functions import scalars

    n = [0, 1, 26, 27, 28, 52, 53, 702, 703, 18278, 18279]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in n], "n long").select(scalars.letters(F.col("n"))).collect()]
    assert got == [None, "a", "z", "aa", "ab", "az", "ba", "zz", "aaa", "zzz", "aaaa"]


def test_merged_cells():
    assert merged_cells.covered([(10, 0, 5), (10.5, 4, 8), (30, 0, 9)], 10, 0, 10) == 0.8


def test_profile_files(tmp_path):
    f = tmp_path / "p.json"
    f.write_text('[{"name": "a", "match": {"any": []}, "priority": 2}]')
    assert profile_files.load([str(f)])[0].priority == 2
    f.write_text('{"name": "a", "match": {}, "options": {"api_key": "x"}}')
    with pytest.raises(ValueError):
        profile_files.load([str(f)])


def test_api(spark, tmp_path):
    pages = [[(72, 700, 20, "Title"), (72, 670, 10, "one line"), (72, 650, 10, "two  lines")], [(72, 700, 10, "(second) page")]]
    (tmp_path / "x.pdf").write_bytes(writer.text_pdf(pages))
    p = str(tmp_path)
    assert api.extract_text(spark, p).first()["document_text"] == "Title\none line\ntwo  lines\f(second) page"
    assert api.extract_markdown(spark, p).where("page_index = 0").first()["markdown"].startswith("## Title\n\none line")
    m = api.get_metadata(spark, p).first()
    assert m["page_count"] == 2 and not m["is_encrypted"]
    assert api.search_text(spark, p, "second", literal=True).count() == 1
    assert len(api.hash_files(spark, p).first()["fingerprint"]) == 64
    assert {r["page_class"] for r in api.classify_pages(spark, p).collect()} <= {"vector", "scanned"}
    assert api.page_slice(api.extract_pages(spark, p), 2, 2).count() == 1


def test_nearest_shape_of_64_bits(spark):
    """Distance 8 with a differing bit in each byte, and random distances, against brute force."""
    import random

    from quirelane.operators import glyphs

    random.seed(4)
    signed = lambda x: x - (x >> 63 << 64)
    known = [random.getrandbits(64) for _ in range(40)]
    shapes = [x ^ sum(1 << (8 * i + random.randrange(8)) for i in range(8)) for x in known]
    shapes += [x ^ sum(1 << i for i in random.sample(range(64), k)) for k in range(11) for x in known[:10]]
    a = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(shapes)], "shape_id long, hash long")
    b = spark.createDataFrame([(signed(x), "t") for x in known], "hash long, text string")
    want = set()
    for i, x in enumerate(shapes):
        d, y = min(((x ^ y).bit_count(), signed(y)) for y in known)
        if d <= 8:
            want.add((i, y, d))
    assert {(r["shape_id"], r["known_hash"], r["distance"]) for r in glyphs.nearest_shape(a, b).collect()} == want

"""Registered queries on rows that only larger or odd tables hold."""

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import test_queries
from quirelane.operators import cmaps, codespace, documents, glyphs, merged_cells, ocr
from quirelane.plans import registry
from quirelane.sources.pdf import writer
from quirelane.sources.pdf.objects import Parser, Ref
from quirelane.sources.pdf.tables import File
from test_stores import brute_codes

pytestmark = pytest.mark.skipif(not Path(test_queries.DATA).is_dir(), reason="no test tables here")


@pytest.fixture
def tables(tmp_path, monkeypatch):
    """Puts tables of one's own beside the given ones, and gives a comparison with SQL over them."""

    def put(spark, query, **own):
        for f in Path(test_queries.DATA).glob("*.parquet"):
            if f.stem not in own and not (tmp_path / f.name).exists():
                os.symlink(f, tmp_path / f.name)
        for name, rows in own.items():
            given = pq.read_schema(f"{test_queries.DATA}/{name}.parquet")
            pq.write_table(pa.Table.from_pylist([{c: r.get(c) for c in given.names} for r in rows], schema=given), tmp_path / f"{name}.parquet")
        monkeypatch.setattr(test_queries, "DATA", str(tmp_path))
        test_queries.compare(spark, registry.QUERIES[query], registry.ORACLE_SQL[query])

    return put


def texts(*texts):
    return [{"doc_id": i, "text": t, "lang": "en", "source": f"src{i % 7}", "n_chars": len(t)} for i, t in enumerate(texts)]


EMPTY_LINES = ["", "\n", "a\n\nb\n", "é\nñ\n\n\n日本\n", "\n" * 60, "one\ntwo\n\n\n\n\n\n\nnine\n\n\n", "x\n" * 30]


@pytest.mark.parametrize("query", ["page_diff", "diff_summary"])
def test_empty_lines_stand_where_they_stood(spark, tables, query):
    tables(spark, query, documents=texts(*EMPTY_LINES))


def test_receipts_of_very_long_lines(spark, tables):
    tables(spark, "receipt_verification", documents=texts(*(f"{'x' * 9000}\n{'y ' * 4000}\nz{i}" for i in range(10))))


def test_nearest_shapes_meet_few_others(monkeypatch):
    """Hashes of 32 bits, whose other 32 are all alike, and of 64: no more pairs are met than a small share of all, and none is lost."""
    rng = np.random.default_rng(5)
    met = []
    meet = glyphs._meet
    monkeypatch.setattr(glyphs, "_meet", lambda h, k, left, lo, hi, *rest: (met.append(int((hi - lo).sum())), meet(h, k, left, lo, hi, *rest)))
    for bits, flips in ((32, 4), (64, 8), (6, 3)):
        known = np.unique(rng.integers(0, 1 << min(bits, 62), 5000, np.uint64) << np.uint64(bits == 64))
        hashes = known[rng.integers(0, len(known), 300)]
        for _ in range(flips):
            hashes = hashes ^ np.uint64(1) << rng.integers(0, bits, 300).astype(np.uint64)
        met.clear()
        distance, place = glyphs.nearest_of(hashes, known, 8)
        every = np.bitwise_count(hashes[:, None] ^ known[None, :])
        assert (distance == np.minimum(every.min(1), 9)).all()
        near = distance < 9
        assert near.any() and (place[near] == every.argmin(1)[near]).all()
        assert bits == 6 or sum(met) < 0.25 * every.size


def test_nearest_shapes_in_blocks(spark, monkeypatch):
    """Several blocks and shards, repeated hashes and null ones, against all pairs."""
    monkeypatch.setattr(glyphs, "BLOCK", 40)
    monkeypatch.setattr(glyphs, "SHARD", 16)
    rng = np.random.default_rng(6)
    known = [int(x) for x in rng.integers(0, 1 << 20, 150)]
    shapes = [*(int(x) for x in rng.integers(0, 1 << 20, 180)), *known[:20], -1]
    a = spark.createDataFrame([*enumerate(shapes), (999, None)], "shape_id long, hash long")
    b = spark.createDataFrame([(x, str(x)) for x in [*known, *known[:30], None]], "hash long, text string")
    want = set()
    for i, x in enumerate(shapes):
        d, y = min((((x ^ y) & (1 << 64) - 1).bit_count(), y) for y in known)
        if d <= 8:
            want.add((i, y, str(y), d))
    assert {tuple(r) for r in glyphs.nearest_shape(a, b).select("shape_id", "known_hash", "text", "distance").collect()} == want


def test_merged_cells_call_no_fold_for_each_page(spark):
    """The plan has no cogroup of pages; unlike pages, pages without rules and pages of a null key keep their own cells."""
    cells, rules = [], []
    for d in (1, 2, 3, None):
        cells += [(d, 0, r, c, 100.0 * c, 100.0 * (1 - r), 100.0 * c + 100, 100.0 * (1 - r) + 100) for r in range(2) for c in range(3)]
    for d in (1, 2, None):
        rules += [(d, 0, "h", 100.0, 0.0, 300.0), (d, 0, "v", 100.0, 0.0, 200.0 if d == 1 else 95.0), (d, 0, "v", 200.0, 0.0, 200.0)]
    rules.append((4, 0, "v", 1.0, 0.0, 9.0))
    a = spark.createDataFrame(cells, "doc_id long, page_index int, row int, col int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame(rules, "doc_id long, page_index int, orientation string, pos double, lo double, hi double")
    got = merged_cells.merge(a, b)
    assert "CoGroup" not in got._jdf.queryExecution().toString()
    shapes = {}
    for r in got.collect():
        shapes.setdefault(r["doc_id"], set()).add((r["row"], r["col"], r["rowspan"], r["colspan"]))
    single = {(r, c, 1, 1) for r in range(2) for c in range(3)}
    joined = single - {(0, 0, 1, 1), (0, 1, 1, 1)} | {(0, 0, 1, 2)}
    assert shapes == {1: single, 2: joined, None: joined, 3: {(0, 0, 2, 3)}}


@pytest.mark.parametrize("query", ["borderless_grids", "borderless_tables"])
def test_pages_meet_in_one_shuffle_of_starts(spark, query):
    plan = registry.QUERIES[query](spark, test_queries.DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") == 1 and "Join" not in plan


def test_codes_of_many_strings_at_once():
    """Strings that lie side by side keep their own codes: none reaches into the next string."""
    rng = np.random.default_rng(8)
    fonts = [[], [("00", "7F"), ("C280", "DFBF"), ("E08080", "EFBFBF")], [("0000", "FFFF")], [("00", "FF"), ("4142", "4244"), ("414243", "414243")], [("80808080", "FFFFFFFF"), ("41", "42")]]
    for hexed in fonts:
        bounds = [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in hexed]
        strings = [rng.choice(np.frombuffer(b"ABC\x80\xc3\xa9\xe2\x82\xac\xff", np.uint8), rng.integers(0, 40)).tobytes() for _ in range(200)] + ["é€a".encode() * 50]
        width, number, lost, ends = codespace.codes_of(np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings]), bounds)
        first = 0
        for data, last in zip(strings, ends.tolist(), strict=True):
            want, _ = brute_codes(bounds, data)
            assert [(codespace.UNKNOWN if x else n, bool(x)) for n, x in zip(number[first:last].tolist(), lost[first:last].tolist(), strict=True)] == want
            assert width[first:last].sum() == len(data)
            first = last


def test_codes_are_no_rows_of_their_own(spark):
    """Decoding explodes no codes; strings of a null font, of a font without a map and null ones keep their rows."""
    ranges = spark.createDataFrame([("a", b"\x00", b"\x7f"), ("a", b"\xc2\x80", b"\xdf\xbf")], "font string, lo binary, hi binary")
    maps = spark.createDataFrame([("a", 1, 0x61, "x"), ("a", 2, 0xC3A9, "fi"), ("a", 1, 0x62, "")], "font string, width int, code long, text string")
    rows = [(1, "a", "aéb".encode()), (2, "a", b"a\xffa"), (3, "b", b"ab"), (4, None, b"a"), (5, "a", None), (6, "a", b""), (7, "a", b"c")]
    tokens = codespace.tokenised(spark.createDataFrame(rows, "id int, font string, bytes binary"), ranges, give=["parts"])
    got = cmaps.decoded(tokens, maps, "id")
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    no = cmaps.UNMAPPED
    assert {tuple(r) for r in got.collect()} == {(1, "xfi", 0), (2, f"x{no}x", 1), (3, no * 2, 2), (4, no, 1), (5, "", 0), (6, "", 0), (7, no, 1)}


def test_chains_are_joined_nowhere(spark):
    """Edges out of an explosion look as small as the rows before it, so a join would broadcast them. Rings, forks and two chains of one document."""
    edges = [(1, 0, 1), (1, 1, 2), (1, 2, 0), (2, 0, 1), (2, 0, 2), (2, 1, 3), (2, 2, 3), (2, 3, None), (3, 5, 6)]
    starts = [(1, "a", 0), (1, "b", 2), (2, "a", 0), (3, "a", 9), (4, "a", 1)]
    got = documents.walk_chain(spark.createDataFrame(edges, "doc_id long, node long, next long"), spark.createDataFrame(starts, "doc_id long, chain string, node long"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(1, "a", 0, 0), (1, "a", 1, 1), (1, "a", 2, 2), (1, "b", 2, 0), (1, "b", 0, 1), (1, "b", 1, 2), (2, "a", 0, 0), (2, "a", 1, 1), (2, "a", 2, 1), (2, "a", 3, 2), (3, "a", 9, 0), (4, "a", 1, 0)}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_positions_near_glyphs():
    """Random points of several pages against all pairs; points beyond all glyphs and unknown ones are near none."""
    rng = np.random.default_rng(10)
    page, g_page = np.sort(rng.integers(0, 5, 400)), np.sort(rng.integers(0, 4, 200))
    x, y, gx, gy = (rng.uniform(-60, 60, n) for n in (400, 400, 200, 200))
    x[:3], y[3], x[4], y[5] = 1e9, np.nan, -1e9, -1e9
    got = ocr.near_any(page, x, y, g_page, gx, gy, 5.0)
    every = (page[:, None] == g_page[None, :]) & ((x[:, None] - gx[None, :]) ** 2 + (y[:, None] - gy[None, :]) ** 2 < 25)
    assert (got == every.any(1)).all() and 50 < got.sum() < 350


def test_positions_copy_no_spans(spark):
    plan = registry.QUERIES["position_validation"](spark, test_queries.DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_pages_place_no_glyphs():
    """Counts of shown text need no fonts and no places; strings with escapes and arrays of numbers are read as before."""
    data = writer.text_pdf([[(72, 700, 10, "a (b) \\\\ c"), (72, 688, 10, "d")], [(72, 700, 10, "é")]])
    f = File(data)
    assert [(r[0], r[5], r[6]) for r in f.rows("pages")] == [(0, 2, 0), (1, 1, 0)]
    assert not f._ran(0, glyphs=False).glyphs
    assert "".join(g[2] for g in f.rows("glyphs")) == "a (b) \\\\ cdé"
    for text, want in ((b"[1 22\n3]", [1, 22, 3]), (b"[]", []), (b"[1 0 R 2]", [Ref(1, 0), 2]), (b"[1 -2 .5]", [1, -2, 0.5]), (b"[ 7 ]", [7])):
        assert Parser(text, 0).object() == want
    assert Parser(b"(a(b)\\(c\\051\\\nd)", 0).object() == b"a(b)(c)d"


@pytest.mark.parametrize("query", ["span_merge", "search_span_merge"])
def test_words_are_dealt_as_texts(spark, query):
    """No window or join sorts words, and what is shuffled are documents."""
    plan = registry.QUERIES[query](spark, test_queries.DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1 and plan.count("hashpartitioning(doc_id#") == 1

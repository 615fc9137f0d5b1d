"""The PDF parser on written files, damaged files and small programs."""

import zlib

from quirelane.sources.pdf import filters, fonts, reader, writer
from quirelane.sources.pdf.document import rc4
from quirelane.sources.pdf.objects import Diagnostics, Name, Parser, Ref
from quirelane.sources.pdf.tables import File


def test_objects():
    p = Parser(b"<< /A [1 -2.5 (a\\(b\\)\\101) <4a4B5> true null] /B 3 0 R /C#20D /E >> % end")
    assert p.object() == {"A": [1, -2.5, b"a(b)A", b"JKP", True, None], "B": Ref(3, 0), "C D": Name("E")}
    for bad in (b"<<", b"[[[", b"(((", b"<< /A >>", b">>", b"]", b"[1 2", b"<zz>"):
        Parser(bad).object()
    assert Parser(b"[" * 500).object() is not None


def test_filters():
    cap, d = filters.Expansion(), Diagnostics()
    data = bytes(range(256)) * 3
    assert filters.decode(zlib.compress(data), [Name("FlateDecode")], [], cap, d) == data
    assert filters.ascii_hex(b"48 65 6C6c 6F>") == b"Hello"
    import base64

    assert filters.ascii_85(base64.a85encode(data) + b"~>") == data
    assert filters.run_length(bytes([4]) + b"abcde" + bytes([254]) + b"x" + bytes([128]), cap) == b"abcdexxx"
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), cap) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rows = b"".join(b"\x02" + bytes([1] * 4) for _ in range(3))
    assert filters.unpredict(rows, {"Predictor": 12, "Columns": 4}) == bytes([1] * 4 + [2] * 4 + [3] * 4)
    try:
        filters.decode(zlib.compress(b"0" * 10_000_000), [Name("FlateDecode")], [], filters.Expansion(1000), d)
        raise AssertionError
    except OverflowError:
        pass


def test_fonts():
    table, spaces = fonts.parse_cmap(b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfchar <01> <0041> <02> <00660069> endbfchar 1 beginbfrange <10> <12> <0061> endbfrange")
    assert table == {(1, 1): "A", (1, 2): "fi", (1, 0x10): "a", (1, 0x11): "b", (1, 0x12): "c"} and spaces == [(1, 0, 255)]
    assert [fonts.glyph_text(n) for n in ("A", "eacute", "uni20AC", "three", "f_i", "nosuchglyph")] == ["A", "é", "€", "3", "fi", None]


def full_pdf():
    content = b"q 100 0 0 50 10 20 cm /I1 Do Q 0 0 1 rg BT /F1 12 Tf 72 700 Td (Hi) Tj 0 -20 Td [(a) -1000 (b)] TJ ET 10 10 m 110 10 l S /Span << /MCID 4 >> BDC BT /F1 10 Tf 3 Tr 72 600 Td (x) Tj ET EMC"
    return writer.assemble(
        [
            b"<< /Type /Catalog /Pages 2 0 R /Outlines 8 0 R /AcroForm << /Fields [11 0 R] >> /PageLabels << /Nums [0 << /S /r /St 3 >>] >> /Names << /Dests << /Names [(top) [3 0 R /Fit]] >>"
            b" /EmbeddedFiles << /Names [(a.txt) 13 0 R] >> >> /Threads [<< /F 15 0 R >>] /MarkInfo << /Marked true >>"
            b" /StructTreeRoot << /K [<< /S /Body /Pg 3 0 R /K [4] >>] /RoleMap << /Body /Para /Para /P >> >> /OCProperties << /OCGs [17 0 R] /D << /OFF [17 0 R] >> >> >>",
            b"<< /Type /Pages /Count 1 /Kids [3 0 R] /Rotate 90 /MediaBox [0 0 300 400] >>",
            b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Annots [6 0 R 7 0 R] /Resources << /Font << /F1 5 0 R >> /XObject << /I1 10 0 R >> >> >>",
            writer.stream(content),
            b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Courier /Encoding /WinAnsiEncoding /FirstChar 97 /Widths [600 600] /FontDescriptor << /MissingWidth 600 >> >>",
            b"<< /Subtype /Link /Rect [1 2 3 4] /A << /S /URI /URI (http://x.example) >> >>",
            b"<< /Subtype /Link /Rect [5 6 7 8] /Dest (top) >>",
            b"<< /First 9 0 R >>",
            b"<< /Title <FEFF00C9> /Dest [3 0 R /Fit] /Next 9 0 R >>",
            writer.stream(b"\0" * 6, b"/Subtype /Image /Width 2 /Height 3"),
            b"<< /T (a) /Kids [12 0 R] >>",
            b"<< /T (b) /FT /Tx /V (val) /P 3 0 R >>",
            b"<< /F (a.txt) /EF << /F 14 0 R >> >>",
            writer.stream(b"attached"),
            b"<< /P 3 0 R /R [0 0 1 1] /N 16 0 R >>",
            b"<< /P 3 0 R /R [1 1 2 2] /N 15 0 R >>",
            b"<< /Type /OCG /Name (Layer) >>",
        ]
    )


def check_full(f):
    rows = lambda t: list(f.rows(t))
    d = rows("documents")[0]
    assert d[:6] == ("1.7", 1, False, True, True, True)
    assert rows("pages")[0] == (0, "iii", 300.0, 400.0, 90, 4, 1, 1)
    g = rows("glyphs")
    assert "".join(x[2] for x in g) == "Hiabx" and g[0][3] == 72.0 and g[0][10] == "#0000ff"
    assert round(g[3][3] - g[2][3], 6) == 19.2 and g[4][9] == 3 and g[4][12] == 4
    assert rows("segments") == [(0, "h", 10.0, 10.0, 110.0)]
    assert rows("images") == [(0, 0, 10.0, 20.0, 110.0, 70.0, "I1", 2, 3)]
    a = rows("annotations")
    assert a[0][-2:] == ("http://x.example", None) and a[1][-2:] == (None, "top")
    assert rows("form_fields") == [("a.b", "text", "val", 0)]
    assert rows("outline") == [(0, None, 1, "É", 0)]
    assert rows("attachments") == [("a.txt", 8, "YXR0YWNoZWQ=", False)]
    assert rows("destinations") == [("top", 0)]
    assert [r[:3] for r in rows("threads")] == [(0, 0, 0), (0, 1, 0)]
    assert rows("structure") == [(0, None, "P", 0, None), (1, 0, None, 0, 4)]
    assert rows("layers") == [("Layer", False)]


def test_tables():
    check_full(File(full_pdf()))


def test_associated_files():
    """Files that the catalog associates stand after the embedded ones, by their Unicode names."""
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R /AF [3 0 R 5 0 R] /Names << /EmbeddedFiles << /Names [(e.txt) 6 0 R] >> >> >>",
        b"<< /Type /Pages /Count 0 /Kids [] >>",
        b"<< /F (x.txt) /UF <FEFF00E9> /AFRelationship /Data /EF << /F 4 0 R >> >>",
        writer.stream(b"data"),
        b"<< /F (no file) >>",
        b"<< /F (e.txt) /EF << /F 7 0 R >> >>",
        writer.stream(b"inside"),
    ]
    assert list(File(writer.assemble(objects)).rows("attachments")) == [("e.txt", 6, "aW5zaWRl", False), ("é", 4, "ZGF0YQ==", False)]


def test_invisible_text_by_tuning(spark, tmp_path):
    from quirelane import api
    from quirelane.operators import profiles

    (tmp_path / "a.pdf").write_bytes(full_pdf())
    plain = {"include_invisible": False, "include_headers": False, "include_footers": False}
    assert profiles.tuned(plain, {"include_invisible": None, "include_headers_footers": False}) == (plain, [])
    options, without_effect = profiles.tuned(plain, {"include_invisible": True, "include_headers_footers": True, "force_ocr": True})
    assert options == dict.fromkeys(plain, True) and without_effect == ["force_ocr"]
    for shown, want in ((False, "Hi\na b"), (options["include_invisible"], "Hi\na b\nx")):
        assert [r["page_text"] for r in api.extract_pages(spark, str(tmp_path), include_invisible=shown).collect()] == [want]


def test_lost_cross_references():
    data = full_pdf()
    broken = data[: data.rfind(b"xref\n0")] + b"trailer << /Root 1 0 R >> startxref 99999999"
    f = File(broken)
    check_full(f)
    assert any(r[0] == "recovered" for r in f.rows("diagnostics"))


def test_garbage_never_raises():
    data = full_pdf()
    for junk in (b"", b"%PDF-", data[:200], data[: len(data) // 2], data.replace(b"obj", b"obx"), bytes(range(256)) * 20):
        f = File(junk)
        for t in ("documents", "pages", "glyphs", "outline", "diagnostics"):
            list(f.rows(t))


def test_rc4():
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_spark_round_trip(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(full_pdf())
    (tmp_path / "b.pdf").write_bytes(b"junk")
    (tmp_path / "c.txt").write_bytes(b"no")
    d = reader.read_pdf(spark, str(tmp_path), "documents").collect()
    assert sorted(r["page_count"] for r in d) == [0, 1]
    assert reader.read_pdf(spark, str(tmp_path), "glyphs").count() == 5


def test_stream(spark, tmp_path):
    from quirelane.streaming import frames

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(full_pdf())
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for n, name in ((1, "b.txt"), (2, "c.PDF")):
        frames.run_once(reader.table(reader.stream_files(spark, str(tmp_path / "in")), "documents"), out, state)
        assert spark.read.parquet(out).count() == n
        (tmp_path / "in" / "c.PDF").write_bytes(full_pdf())
        (tmp_path / "in" / "b.txt").write_bytes(b"no")


def test_aes_vectors():
    from quirelane.sources.pdf import aes

    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for key, cipher in (
        ("000102030405060708090a0b0c0d0e0f", "69c4e0d86a7b0430d8cdb78070b4c55a"),
        ("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f", "8ea2b7ca516745bfeafc49904b496089"),
    ):
        k = bytes.fromhex(key)
        assert aes.cbc_encrypt(k, plain, bytes(16)).hex() == cipher
        assert aes.cbc_decrypt(k, bytes.fromhex(cipher), bytes(16), padded=False) == plain


def encrypted(version):
    """A one-page file that the given version encrypts, with user password ``pw``."""
    import hashlib

    from quirelane.sources.pdf import aes
    from quirelane.sources.pdf.document import _PAD

    body, fid = b"BT /F1 10 Tf 72 700 Td (sealed) Tj ET", b"0123456789abcdef"
    hexed = lambda b: b"<" + b.hex().encode() + b">"
    pad = lambda d: d + bytes([16 - len(d) % 16]) * (16 - len(d) % 16)
    if version == 5:
        key, us, uk = bytes(range(32)), b"saltsalt", b"keysalt1"
        u = aes.hash_r6(b"pw", us) + us + uk
        ue = aes.cbc_encrypt(aes.hash_r6(b"pw", uk), key, bytes(16))
        head = b"<< /Filter /Standard /V 5 /R 6 /Length 256 /P -4 /O %s /OE %s /U %s /UE %s /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF >>" % (hexed(bytes(48)), hexed(bytes(32)), hexed(u), hexed(ue))
        seal = lambda n, d: b"v" * 16 + aes.cbc_encrypt(key, pad(d), b"v" * 16)
    else:
        o = bytes(32)
        digest = hashlib.md5((b"pw" + _PAD)[:32] + o + (0xFFFFFFFC).to_bytes(4, "little") + fid).digest()
        for _ in range(50):
            digest = hashlib.md5(digest[:16]).digest()
        key = digest[:16]
        check = rc4(key, hashlib.md5(_PAD + fid).digest())
        for i in range(1, 20):
            check = rc4(bytes(b ^ i for b in key), check)
        more = b"/CF << /StdCF << /CFM /AESV2 >> >> /StmF /StdCF /StrF /StdCF" if version == 4 else b""
        head = b"<< /Filter /Standard /V %d /R %d /Length 128 /P -4 /O %s /U %s %s >>" % (version, 4 if version == 4 else 3, hexed(o), hexed(check + bytes(16)), more)

        def seal(n, d):
            k = hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if version == 4 else b"")).digest()
            return b"v" * 16 + aes.cbc_encrypt(k, pad(d), b"v" * 16) if version == 4 else rc4(k, d)

    sealed = seal(4, body)
    return writer.assemble(
        [
            b"<< /Type /Catalog /Pages 2 0 R >>",
            b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>",
            b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
            writer.stream(sealed, compress=False),
            b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>",
            head,
        ],
        more=b"/Encrypt 6 0 R /ID [%s %s]" % (hexed(fid), hexed(fid)),
    )


def test_encryption():
    for version in (2, 4, 5):
        f = File(encrypted(version), b"pw")
        assert "".join(g[2] for g in f.rows("glyphs")) == "sealed", version
        locked = File(encrypted(version), b"no")
        d = next(locked.rows("documents"))
        assert d[2:4] == (True, False) and not list(locked.rows("glyphs"))


def test_highlights():
    data = full_pdf()
    marked = writer.highlighted(data, [(0, 1.0, 2.0, 3.0, 4.0), (9, 0, 0, 1, 1)], "note")
    assert marked.startswith(data)
    a = list(File(marked).rows("annotations"))
    assert [x[2] for x in a] == ["Link", "Link", "Highlight"] and a[2][3:8] == ("note", 1.0, 2.0, 3.0, 4.0)
    again = list(File(writer.highlighted(marked, [(0, 5, 5, 6, 6)])).rows("annotations"))
    assert len(again) == 4
    check = [r for r in again if r[2] == "Link"]
    assert check[0][-2] == "http://x.example"


def test_any_bytes():
    """The parser never raises, whatever it is given."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    base = full_pdf()
    pieces = st.sampled_from([b"<<", b">>", b"[", b"]", b"(", b")", b"<", b"/A", b" 1 0 R ", b"1 0 obj", b"endobj", b"stream\n", b"endstream", b"xref\n0 1\n", b"trailer", b"BI", b"ID ", b"EI", b"Tj", b"-1.5", b"%x\n"])

    @settings(max_examples=150, deadline=None)
    @given(st.one_of(st.binary(max_size=200), st.lists(pieces, max_size=40).map(b" ".join), st.tuples(st.integers(0, len(base)), st.binary(max_size=30)).map(lambda t: base[: t[0]] + t[1] + base[t[0] + len(t[1]) :])))
    def check(data):
        p = Parser(data)
        for _ in range(100):
            if p.done():
                break
            p.object()
        f = File(data)
        for t in ("documents", "pages", "glyphs", "annotations", "form_fields", "outline", "attachments", "threads", "structure", "layers", "signatures", "diagnostics"):
            list(f.rows(t))

    check()

"""Codes by code spaces, and the stored cache."""

import random

import pytest
from pyspark.sql import functions as F

from quirelane.operators import cache_store, codespace


def brute_codes(ranges, data):
    """(code, unknown) of each code, and the first offset of each unknown byte."""
    out, first, i = [], {}, 0
    while i < len(data):
        for n in (4, 3, 2, 1):
            part = data[i : i + n]
            if len(part) == n and any(len(lo) == n and all(a <= b <= c for a, b, c in zip(lo, part, hi, strict=True)) for lo, hi in ranges):
                out.append((int.from_bytes(part, "big"), False))
                break
        else:
            n = 1
            out.append((0xFFFD, True) if ranges else (data[i], False))
            if ranges:
                first.setdefault(data[i], i)
        i += n
    return out, first


def test_codespaces(spark):
    h = bytes.fromhex
    fonts = {
        "one": [("00", "7F")], "two": [("8000", "FFFF")], "mixed": [("00", "7F"), ("8000", "FFFF")], "wide": [("80", "9F"), ("8140", "9FFC"), ("8E808080", "8EFFFFFF"), ("00", "5C")],
        "specials": [("2D", "2D"), ("5B5D", "5D5E"), ("0A", "0D")], "crossed": [("8090", "7FFF"), ("41", "42")], "none": [], "overlap": [("00", "FF"), ("4142", "4244"), ("414243", "414243")],
    }
    rng = random.Random(3)
    rows = [(i, f, bytes(rng.choice([rng.randrange(256), rng.choice(b"AB\x80\x81\x8e\n\r[]-^\\")]) for _ in range(rng.choice([0, 1, 2, 9, 60])))) for i, f in enumerate(list(fonts) * 25)]
    rows += [(900, "mixed", b"H\x82\xa0"), (901, "one", b"H\x80l\x80"), (902, "one", None), (903, "mixed", b"\x82")]
    ranges = spark.createDataFrame([(f, h(lo), h(hi)) for f, r in fonts.items() for lo, hi in r] + [("one", b"\x00\x00", b"\x01"), ("one", b"", b"")], "font string, lo binary, hi binary")
    tokens = codespace.tokenised(spark.createDataFrame(rows, "id long, font string, bytes binary"), ranges)
    found = {}
    for r in codespace.diagnostics(tokens, "id").collect():
        found.setdefault(r["id"], {})[r["byte"]] = r["offset"]
    got = {r["id"]: r for r in tokens.collect()}
    assert len(got) == len(rows)
    for i, f, data in rows:
        if data is None:
            assert got[i]["codes"] is None
            continue
        want, first = brute_codes([(h(a), h(b)) for a, b in fonts[f]], data)
        assert list(zip(got[i]["codes"], got[i]["unknown"], strict=True)) == want, (f, data)
        assert found.get(i, {}) == first
    assert got[900]["codes"] == [0x48, 0x82A0] and got[901]["codes"] == [0x48, 0xFFFD, 0x6C, 0xFFFD]


@pytest.fixture
def store(spark, tmp_path):
    return cache_store.CacheStore(spark, f"file://{tmp_path}/cache", "result string", "string", buckets=4)


def asked(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "cache_key string")


def at(n):
    return F.timestamp_seconds(F.lit(1_900_000_000 + 86400 * n))


def ask(spark, store, keys, day, calls):
    def compute(df):
        calls.append(sorted(r[0] for r in df.select("cache_key").collect()))
        return df.select("cache_key", F.upper("cache_key").alias("result"), F.lit(100).alias("bytes"))

    return {r["cache_key"]: (r["result"], r["status"]) for r in store.read_through(asked(spark, *keys), compute, at(day)).collect()}


def test_second_run_hits(spark, store):
    calls = []
    assert ask(spark, store, ["a", "b", "a"], 1, calls) == {"a": ("A", "miss"), "b": ("B", "miss")}
    again = cache_store.CacheStore(spark, store.path, "result string", "string", buckets=4)
    assert ask(spark, again, ["b", "c"], 2, calls) == {"b": ("B", "hit"), "c": ("C", "miss")}
    assert calls == [["a", "b"], ["c"]]
    assert {r["cache_key"]: r["last_touch"].day for r in store.entries().collect()} == {"a": 18, "b": 19, "c": 19}
    store.compact_touches()
    assert {r["cache_key"]: r["last_touch"].day for r in store.entries().collect()} == {"a": 18, "b": 19, "c": 19}


def test_eviction_removes_files(spark, store, tmp_path):
    calls = []
    files = lambda: {p for p in (tmp_path / "cache/entries").rglob("*.parquet")}
    for day in range(1, 6):
        ask(spark, store, [f"k{day}{i}" for i in range(4)], day, calls)
    ask(spark, store, ["k10"], 6, calls)
    before = files()
    assert store.evict(2000) == 0 and files() == before  # 20 entries of 100 bytes: at the limit
    assert store.evict(1500) == 8  # down to 1200
    left = {r["cache_key"] for r in store.entries().collect()}
    assert left == {"k10", *(f"k{d}{i}" for d in (4, 5) for i in range(4)), *(f"k3{i}" for i in range(1, 4))}
    assert not before <= files()
    got = ask(spark, store, ["k11", "k50", "k10"], 7, calls)
    assert {k: s for k, (_, s) in got.items()} == {"k11": "miss", "k50": "hit", "k10": "hit"}


def test_two_writers_lose_nothing(spark, store):
    """Both compute one key; entries added while an eviction runs stay, and nothing is counted twice."""
    calls = []
    ask(spark, store, ["a", "b", "c"], 1, calls)
    other = cache_store.CacheStore(spark, store.path, "result string", "string", buckets=4)
    both = asked(spark, "x").select("cache_key", F.lit("X").alias("result"), F.lit(100).alias("bytes"))
    store.put(both, at(2))
    other.put(both, at(3))
    assert store.entries().count() == 4
    real, added = cache_store.cut, []

    def meanwhile(df):  # another writer adds entries while the eviction is under way
        out = real(df)
        if not added:
            added.extend(f"m{i}" for i in range(9))
            other.put(asked(spark, *added).select("cache_key", F.lit("M").alias("result"), F.lit(1).alias("bytes")), at(4))
        return out

    cache_store.cut = meanwhile
    try:
        assert store.evict(300) > 0
    finally:
        cache_store.cut = real
    assert set(added) <= {r["cache_key"] for r in store.entries().collect()}


def test_match_places(spark):
    """Short and very long lines, against Python's own matches; empty and NUL patterns are refused."""
    import re

    from quirelane.operators import search

    rng = random.Random(5)
    texts = ["", "the", "xthe the\nThe é the", "THE\n\nthe", None, " ".join(rng.choice(["the", "then", "é", "TH", "other"]) for _ in range(30_000)), "a" * 5000 + "the"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for pattern, kwargs, python in (("the", {"literal": True}, "the"), ("the", {"literal": True, "ignore_case": True}, "(?i:the)"), ("th[en]+", {}, "th[en]+"), ("the", {"whole_word": True}, r"(?<!\w)the(?!\w)"), ("t.e", {"literal": True}, r"t\.e")):
        got = sorted((r["id"], r["start"], r["end"], r["match"]) for r in search.grep(df, pattern, **kwargs).select("id", "start", "end", "match").collect())
        assert got == sorted((i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) if t for m in re.finditer(python, t)), pattern
    for bad in ("", "a\0b"):
        with pytest.raises(ValueError):
            search.grep(df, bad)
    assert [r["id"] for r in search.inverted(df, "the", literal=True).orderBy("id").collect()] == [0]


def test_running_sums(spark):
    from quirelane.operators.search import running_sums

    rows = [([],), ([5],), (list(range(10)),), ([3] * 1000,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<int>").select(running_sums(F.col("a"))).collect()]
    assert got == [[], [0], [sum(range(i)) for i in range(10)], [3 * i for i in range(1000)], None]


def test_character_maps(spark):
    """Blocks of both kinds, lists, odd digits, comments, later entries over earlier ones, and what is refused."""
    from quirelane.operators import cmaps

    program = """%!PS <00> <FF>
    1 begincodespacerange <00> <80> <8140> <9FFC> endcodespacerange
    2 beginbfchar <01> <0041> % <02> <0042>
    <03> <00660069> endbfchar
    4 beginbfrange <20> <22> <D83DDE00> <30> <32> [<0061> <00620063> <0064>] <40> <43> [<0078>] <8140> <8142> <3042> endbfrange
    1 beginbfchar <21> <005A> <5> <0050> endbfchar
    beginbfrange <22> <20> <0041> <0000> <01> <0041> <00000000> <00FFFFFF> <0041> <60> <61> <D7FF> endbfrange"""
    maps = spark.createDataFrame([("f", program), ("g", "beginbfrange <41> <42> <0061> endbfrange"), ("none", ""), ("null", None)], "font string, cmap string")
    got = {(r["font"], r["width"], r["code"]): r["text"] for r in cmaps.mappings(maps).collect()}
    assert got == {
        ("f", 1, 0x01): "A", ("f", 1, 0x03): "fi", ("f", 1, 0x20): "\U0001f600", ("f", 1, 0x21): "Z", ("f", 1, 0x22): "\U0001f602", ("f", 1, 0x30): "a", ("f", 1, 0x31): "bc", ("f", 1, 0x32): "d",
        ("f", 1, 0x40): "x", ("f", 2, 0x8140): "あ", ("f", 2, 0x8141): "ぃ", ("f", 2, 0x8142): "い", ("f", 1, 0x50): "P", ("f", 1, 0x60): "\ud7ff", ("f", 1, 0x61): "�", ("g", 1, 0x41): "a", ("g", 1, 0x42): "b",
    }
    assert sorted((r["lo"], r["problem"]) for r in cmaps.problems(maps).collect()) == [("0000", "range"), ("00000000", "size"), ("22", "range"), ("40", "list")]
    spaces = sorted((r["font"], bytes(r["lo"]), bytes(r["hi"])) for r in cmaps.codespaces(maps).collect())
    assert spaces == [("f", b"\x00", b"\x80"), ("f", b"\x81\x40", b"\x9f\xfc")]
    rows = [(1, "f", b"\x01\x03\x81\x41\x20\xff"), (2, "g", b"AB\x00"), (3, "none", b"A"), (4, "f", b""), (5, "f", None)]
    tokens = codespace.tokenised(spark.createDataFrame(rows, "id int, font string, bytes binary"), cmaps.codespaces(maps))
    found = {r["id"]: (r["text"], r["unmapped"]) for r in cmaps.decoded(tokens, cmaps.mappings(maps), "id").collect()}
    assert found == {1: ("Afiぃ\U0001f600�", 1), 2: ("ab�", 1), 3: ("�", 1), 4: ("", 0), 5: ("", 0)}

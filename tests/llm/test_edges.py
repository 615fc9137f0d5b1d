"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import base64
import hashlib
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirelane.llm import bpe, knn, licenses, packing, quality, secrets, simhash, toxicity, urlfilter, warc, wide
from test_contracts import brute_components, brute_fingerprint, brute_secrets

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, blob int, spans string, score string, kept string, piece string, `length` string"
LONG = "Word and thing " * 40_000 + "\n" + "x" * 300_000
TEXTS = [None, "", " ", "one", "\n\t ", LONG, "Same text here, token=abcdef12345", "Same text here, token=abcdef12345", "héé ñ €uro \U0001f600 ß", "you are a stupid IDIOT!! id1ot", "released under the MIT License"]


def extra(rows):
    return [(i, t, "en", "s", 1, "fp", 1, "sp", "sc", "k", "p", "l") for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [*enumerate(TEXTS), (None, "an id of null"), (None, None), (3, "one"), (3, "one"), (4, "other text of a repeated id")]
    return spark.createDataFrame(extra(rows), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, None, None), (None, 1, 1), (3, 1, 0), (3, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_simhash(odd, none):
    got = simhash.near_duplicates(odd).collect()
    want = sorted((str(i), brute_fingerprint(t)) for i, t in pairs(odd))
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64) for r in got) == want
    empty = [r["component"] for r in got if r["fp"] == 0]
    assert set(empty) == {0} and len(empty) == 5  # null and empty texts and those of white space, with null ids
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_blocks_and_radii(spark):
    import random

    random.seed(5)
    centre = random.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 6))) for _ in range(300)} | {random.getrandbits(64) for _ in range(200)}
    signed = [(x - 2**64 if x >= 2**63 else x, x.to_bytes(8, "little")) for x in sorted(fps)]
    df = spark.createDataFrame(signed, "node long, bits binary").cache()
    for r, block in ((4, 4096), (4, 16), (3, 4096), (6, 40), (10, 64), (0, 4096)):
        up = {u: u for u in fps}

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for row in simhash.links(df, simhash.plan_segments(r, len(fps)), r, block=block).collect():
            a, b = row[0] % 2**64, row[1] % 2**64
            assert (a ^ b).bit_count() <= r
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
        assert {u: root(u) for u in fps} == brute_components({u: u for u in fps}, r), (r, block)


def test_wide_links(spark):
    """Components of wide fingerprints' links are those of all pairs within the distance, at similarities of 0.85 or more."""
    import random

    random.seed(8)
    words = [f"w{i}" for i in range(5000)]
    texts, groups = {}, {}
    for g in range(60):
        base = random.choices(words, k=400)
        for k in range(random.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(k and random.randint(1, 5)):
                t[random.randrange(400)] = random.choice(words)
            texts[len(texts)] = " ".join(t)
            groups[len(texts) - 1] = g
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    first = {}
    for i, g in groups.items():
        first.setdefault(g, i)
    assert kept == sorted(first.values())


def test_long_segments():
    for r in range(9):
        for n in (10, 1 << 40):
            plan = simhash.plan_segments(r, n)
            assert sum(p[3] for p in plan) == r - len(plan) + 1 and sum(p[2] for p in plan) == 64


def test_keep_one(odd, none):
    kept = pairs(simhash.keep_one(odd))
    assert (6, TEXTS[6]) in kept and (7, TEXTS[7]) not in kept
    assert kept.count((3, "one")) == 1 and (None, None) in kept and (None, "an id of null") in kept
    assert simhash.keep_one(odd).columns == odd.columns and simhash.keep_one(none).count() == 0


def test_packing(odd, none):
    tk = Tokenizer.from_file(WORD)
    got = packing.pack_documents(odd, WORD).collect()
    want = []
    for i, t in pairs(odd):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(str(i), k, s, len(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"]) for r in got) == sorted(want)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for (s, o, n), (s2, o2, n2) in zip(places, places[1:], strict=False):
        assert o2 == (o + n if s2 == s else 0) and o2 + n2 <= 2048
    assert packing.pack_documents(none, WORD).count() == 0


def brute_bins(items, size):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= size:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_packing_of_hot_lengths(spark, monkeypatch):
    """More salts for a length with many pieces: places stay gapless, and no piece is lost."""
    monkeypatch.setattr(packing, "SALTS", 1)
    monkeypatch.setattr(packing, "SALT_ROWS", 10)
    rows = [(i, 0, 700 if i % 3 else 100 + i) for i in range(400)] + [(1, 0, 700)] * 5
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 2048).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in got) == sorted(rows)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for (s, o, n), (s2, o2, n2) in zip(places, places[1:], strict=False):
        assert o2 == (o + n if s2 == s else 0) and o2 + n2 <= 2048


def test_completion_beats_best_fit():
    """Many pieces of log-normal lengths: the lower bound is met, which best-fit decreasing misses."""
    import random
    from collections import Counter

    random.seed(4)
    missed = 0
    for copies in (7, 20, 50):
        lengths = Counter({min(2048, int(random.lognormvariate(5.8, 1))) + 1: copies for _ in range(600)})
        lengths = Counter({min(x, 2048): n for x, n in lengths.items()})
        n = sum(t for _, t in packing.complete_bins(lengths, 2048))
        assert n == packing.lower_bound(lengths, 2048)
        missed += sum(t for _, t in packing._best_fit(lengths, 2048)) > n
    assert missed


def test_bin_completion():
    import random
    from collections import Counter

    random.seed(2)
    for _ in range(150):
        size = random.choice([10, 20, 30])
        items = sorted((random.randint(1, size) for _ in range(random.randint(0, 10))), reverse=True)
        rows = packing.complete_bins(Counter(items), size)
        used = Counter()
        for f, t in rows:
            assert sum(x * k for x, k in f.items()) <= size
            for x, k in f.items():
                used[x] += k * t
        assert used == Counter(items)
        n, best = sum(t for _, t in rows), brute_bins(items, size) if items else 0
        assert packing.lower_bound(Counter(items), size) <= best if items else True
        assert n == best, (items, size)


def test_toxicity(odd, none, labels, no_labels):
    for lab in (labels, no_labels):
        model = toxicity.train(odd, lab)
        got = toxicity.score(odd, model, keep=["doc_id"]).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.score(none, model, keep=["doc_id"]).count() == 0
    assert toxicity.train(none, labels).score(__import__("numpy").zeros((1, len(toxicity.FEATURES)))).tolist() == [0.0]


def test_toxicity_learns(spark):
    import random

    import numpy as np

    random.seed(1)
    words = [f"w{i}" for i in range(300)]
    rows, truth = [], {}
    for i in range(1500):
        t = random.choices(words, k=80)
        bad = i % 5 == 0
        if bad:
            for w in random.choices(["idiot", "STUPID", "id1ot", "moron!!", "clown"], k=5):
                t[random.randrange(80)] = w
        rows.append((i, " ".join(t)))
        truth[i] = bad
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, int(b)) for i, b in truth.items()], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    got = {r[0]: r[1] for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    right = np.mean([(got[i] >= 0.7) == truth[i] for i in held])
    assert right > 0.98


def test_isotonic():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    steps, levels = toxicity.isotonic(x, (rng.random(300) < 1 / (1 + np.exp(-x))).astype(float))
    assert (np.diff(steps) > 0).all() and (np.diff(levels) >= 0).all()


def test_bpe(odd, none):
    tk = Tokenizer.from_file(BYTE)
    got = bpe.encode_documents(odd, BYTE, ids=True).collect()
    want = sorted((str(i), tk.encode(t or "", add_special_tokens=False).ids) for i, t in pairs(odd))
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == want
    for r in got:
        assert r["decoded"] == tk.decode(r["ids"], skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in r["ids"])).hexdigest()
    assert bpe.encode_documents(none, BYTE).count() == 0


def test_bpe_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    model, tk, words, tw = bpe.BytePairs(BYTE, parts=50), Tokenizer.from_file(BYTE), packing.Tokens(WORD, words=40), Tokenizer.from_file(WORD)
    near = st.text(st.characters(max_codepoint=0x17F), max_size=60)

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(max_size=60), near, st.text("'stremldv <|endof>tx", max_size=60), st.sampled_from(["<|endoftext|>", "a<|endoftext|> b", "aaaa" * 300])))
    def check(t):
        t = t.encode("utf-8", "replace").decode()
        ids = tk.encode(t, add_special_tokens=False).ids
        assert model.encode(t) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert model.decode(model.encode(t)).decode() == tk.decode(ids, skip_special_tokens=False)
        assert words.encode(t) == b"".join(i.to_bytes(4, "little") for i in tw.encode(t, add_special_tokens=False).ids)

    check()


def test_long_texts_in_pieces(monkeypatch):
    model, tk, words, tw = bpe.BytePairs(BYTE), Tokenizer.from_file(BYTE), packing.Tokens(WORD), Tokenizer.from_file(WORD)
    monkeypatch.setattr(bpe, "LONG", 200)
    monkeypatch.setattr(packing, "LONG", 200)
    for t in ("It's a Word, 12 of many! " * 60, "é日本 <|endoftext|> x " * 50, " \n" * 300):
        assert model.encode(t) == b"".join(i.to_bytes(4, "little") for i in tk.encode(t, add_special_tokens=False).ids)
        assert words.encode(t) == b"".join(i.to_bytes(4, "little") for i in tw.encode(t, add_special_tokens=False).ids)
    small = packing.Tokens(WORD, words=40)
    t = " ".join(f"word{i}x" for i in range(100))
    assert small.encode(t) == b"".join(i.to_bytes(4, "little") for i in tw.encode(t, add_special_tokens=False).ids)


def test_every_near_character():
    model, tk, words, tw = bpe.BytePairs(BYTE), Tokenizer.from_file(BYTE), packing.Tokens(WORD), Tokenizer.from_file(WORD)
    for c in map(chr, range(0x180)):
        for t in (f"a{c}1", f" {c} b", f"{c}{c}'s", f"1{c}."):
            assert model.encode(t) == b"".join(i.to_bytes(4, "little") for i in tk.encode(t, add_special_tokens=False).ids), repr(t)
            assert words.encode(t) == b"".join(i.to_bytes(4, "little") for i in tw.encode(t, add_special_tokens=False).ids), repr(t)


def test_secrets(odd, none):
    found, ledger = secrets.find(odd)
    got = secrets.digest(found).collect()
    assert len(got) == odd.count() and ledger.count() == len({t or "" for _, t in pairs(odd)})
    for r in got:
        if r["doc_id"] in (6, 7):
            assert (r["n_assign"], r["spans"]) == (1, "assign:16:33")
    assert secrets.find(none)[0].count() == 0


def test_secret_places(spark):
    texts = ["é token = \"abc\" token:abcdefg", "api_key=token: abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "AKIA" + "B" * 20, "0" * 23 + "g" + "a1" * 12, "PassWord='secret=abcdef'",
             "-----BEGIN RSA PRIVATE KEY-----", "\U0001f600" * 3 + "secret:123456", "token=short secret = longer_than", "xx ghp_" + "a1" * 18]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.digest(secrets.find(df)[0]).collect():
        want = brute_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest(), texts[r["doc_id"]]
    redacted = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert redacted[7] == "\U0001f600" * 3 + "[REDACTED]" and redacted[1] == texts[1] and redacted[6] == "[REDACTED]"
    assert not any(brute_secrets(t) for t in redacted.values())


def test_stored_ledger(spark, tmp_path):
    """A second run reads the ledger that the first has written, and scans only what it lacks."""
    place = f"file://{tmp_path}/ledger"
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "plain"), (3, None)], "doc_id long, text string")
    second = spark.createDataFrame([(2, "token=abcdef"), (3, "plain"), (4, "secret=ghijkl"), (4, "secret=ghijkl")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_assign"] for r in secrets.digest(secrets.find_stored(first, place)).collect()} == {1: 1, 2: 0, 3: 0}
    got = [(r["doc_id"], r["n_assign"]) for r in secrets.digest(secrets.find_stored(second, place)).collect()]
    assert sorted(got) == [(2, 1), (3, 0), (4, 1), (4, 1)] and spark.read.parquet(place).count() == 4
    assert secrets.find_stored(first, place).count() == 3 and spark.read.parquet(place).count() == 4


def test_many_findings_in_one_text(spark):
    """20,000 findings of one text are placed and replaced in linear time."""
    text = "é " + "token=abcdef hex " + " ".join(f"x secret='k{i:07d}';" for i in range(20_000)) + " end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = secrets.digest(secrets.find(df)[0]).first()
    want = brute_secrets(text)
    assert r["n_assign"] == 20_001 == len(want)
    assert r["spans"] == ",".join(f"assign:{s}:{e}" for s, _, e in want)
    parts, at = [], 0
    for s, _, e in want:
        parts.append(text[at:s])
        at = e
    assert secrets.redact(df).first()["text"] == "[REDACTED]".join([*parts, text[at:]])


def test_ledger_scans_only_unseen(spark):
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "plain")], "doc_id long, text string")
    _, ledger = secrets.find(first)
    second = spark.createDataFrame([(2, "token=abcdef"), (3, "plain"), (4, "secret=ghijkl")], "doc_id long, text string")
    found, whole = secrets.find(second, ledger)
    assert whole.count() == 3 and secrets.scan(second, whole).count() == 0
    assert {r["doc_id"]: r["n_assign"] for r in secrets.digest(found).collect()} == {2: 1, 3: 0, 4: 1}
    stale = ledger.withColumn("rule_version", F.lit(0))
    assert secrets.scan(first, stale).count() == 2


def test_knn(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [-1.0, 0.5, 3.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (40, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    import math

    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for k, pivots in ((3, 2), (20, 128)):
        want = {}
        for q, v in fine:
            if q % 20 == 0:
                s = sorted((-sum(a * b for a, b in zip(v, w)), o) for o, w in fine if o != q)[:k]
                want |= {(q, n + 1): (o, -x) for n, (x, o) in enumerate(s)}
        got = knn.top_k(df, k=k, pivots=pivots).collect()
        assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)
    assert knn.top_k(df.limit(0)).count() == 0


def test_knn_blocks(spark, monkeypatch):
    import random

    random.seed(3)
    monkeypatch.setattr(knn, "BLOCK", 16)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 4)
    v = {i: [random.randint(-3, 3) / 2 for _ in range(5)] if i % 3 else [0.5] * 5 for i in range(400)}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<float>")
    got = knn.top_k(df, k=7, pivots=5).collect()
    whole = {i: [int(64 * x) for x in w] for i, w in v.items()}
    want = {}
    for q in range(0, 400, 20):
        s = sorted((-sum(a * b for a, b in zip(whole[q], whole[o])), o) for o in whole if o != q)[:7]
        want |= {(q, n + 1): (o, -x) for n, (x, o) in enumerate(s)}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want


def test_quality(odd, none, labels, no_labels):
    for lab in (labels, no_labels):
        model = quality.fit(odd, lab)
        got = quality.judge(odd, model, keep=["doc_id"]).collect()
        assert len(got) == odd.count()
        assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] == 0)
        assert quality.judge(none, model, keep=["doc_id"]).count() == 0
    assert quality.fit(none, labels).threshold is not None


def test_quality_scores_by_hand():
    import numpy as np

    ratios = np.random.default_rng(0).normal(size=quality.BUCKETS)
    texts = [b"", b"abc", b"abcd", b"abcdefgh" * 50, b"xyz" * quality.CHUNK, b"q", b"hello world"]

    def slow(t):
        codes = [(int.from_bytes(t[i : i + 4], "little") * 2654435761 % 2**32) >> 16 for i in range(min(len(t) - 3, 2000))]
        return np.mean(ratios[codes]) if codes else 0.0

    got = quality.scores(texts, ratios)
    for t, s in zip(texts, got, strict=True):
        if len(t) < 10_000:
            assert abs(s - slow(t)) < 1e-9
    n = len(texts[4]) - 3
    code = quality.buckets_of(np.frombuffer(texts[4], np.uint8))
    assert abs(got[4] - ratios[code].sum() / n) < 1e-9


def brute_threshold(scored):
    """Of (score, quality): every cut tried, its gain in whole numbers."""
    good, bad = (sum(q == want for _, q in scored) for want in (1, 0))
    of = {}
    for s, q in scored:
        of.setdefault(s, [0, 0])[q] += 1
    best, below, last = None, [0, 0], None
    for s in sorted(of):
        gain = quality.GOOD_WEIGHT * (good - below[1]) * bad + below[0] * good
        here = (gain, s - last if last is not None else 0.0, (s + last) / 2 if last is not None else s - 1)
        best = here if best is None or here[:2] > best[:2] else best
        below, last = [x + y for x, y in zip(below, of[s], strict=True)], s
    return best[2]


def test_quality_is_fitted_to_every_label(spark):
    """Both multinomials and the threshold, of more labels than one batch or any round bound holds, against plain Python."""
    from collections import Counter

    import numpy as np

    texts = {i: f"{'good' if i % 7 else 'poor'} line {i} of {'plain' if i % 5 else 'odd'} words" for i in range(26_000)}
    labels = {i: int(i % 9 < 5) if i % 11 else int(i % 7 > 0) for i in texts if i % 200}
    docs = spark.createDataFrame([*texts.items(), (None, "no id, no label")], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))

    codes = {i: [(int.from_bytes(t.encode()[j : j + 4], "little") * 2654435761 % 2**32) >> 16 for j in range(len(t) - 3)] for i, t in [*texts.items(), (None, "no id, no label")]}
    raw, target = np.full(quality.BUCKETS, 0.5), np.full(quality.BUCKETS, 0.5)
    for into, some in ((raw, codes), (target, [i for i, q in labels.items() if q])):
        for b, n in Counter(b for i in some for b in codes[i]).items():
            into[b] += n
    assert sum(labels.values()) > 10_000 < sum(not q for q in labels.values())
    assert np.abs(model.ratios - np.log(target / target.sum()) + np.log(raw / raw.sum())).max() < 1e-7
    assert abs(model.threshold - brute_threshold([(float(sum(model.ratios[codes[i]])) / len(codes[i]), q) for i, q in labels.items()])) < 1e-12


def test_quality_threshold_over_ranges(spark):
    """Ranges of scores that lie in different tasks, with ties; one score alone; labels of one kind."""
    import random

    rng, schema = random.Random(3), "quality int, score double"
    cases = [[(rng.randint(0, 1), rng.randint(-40, 40) / 8) for _ in range(n)] for n in (2, 7, 60, 900)]
    cases += [[(1, 0.5), (0, 0.5)], [(1, 1.0), (0, 2.0)], [(q, float(q)) for q in (0, 1) for _ in range(50)], [(i % 2, i / 7) for i in range(500)]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rows in cases:
            if len({q for q, _ in rows}) == 2:
                assert quality.best_threshold(spark.createDataFrame(rows, schema)) == brute_threshold([(s, q) for q, s in rows])
        for rows, want in (([], -float("inf")), ([(1, 0.1)], -float("inf")), ([(0, 0.1), (0, 0.2)], 0.0)):
            assert quality.best_threshold(spark.createDataFrame(rows, schema)) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quality_scores_equal_texts_alike(spark):
    """Whatever stands before them in a batch."""
    import numpy as np

    model = quality.fit(spark.createDataFrame([(i, f"some words {i * i}") for i in range(50)], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int"))
    got = quality.scores([b"one text of words 12", *(b"some %d words" % i + b"x" * (i % 13) for i in range(3000)), b"one text of words 12"], model.ratios)
    assert got[0] == got[-1] and np.isfinite(got).all()


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG/", "http://xorg/", "http://a.org", "http://a.org/x", "HTTP://Example.ORG/es/1", "http://example.org/en/1234", "http://example.org/en/2", "http://q.com/fr/", "x://y.com/de/?a",
            "http://com/fr", "a://b://c.org/", "http://m.casino-win.example.net/", "http://casinos.net/x", "http://h.net/casino/", "http://free-bets.net", "http://link-farm.net?x", "http://a.org#f", "http://é.com/de/é", "http://example.org/en/1#x", "http://adsl.net/", "u://" + "a" * 20000 + ".com/fr/"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    import re

    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    got = {r["page_id"]: r for r in urlfilter.judge(df).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
        path = re.match("[^/?#]*([^?#]*)", rest)[1]
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[0] + best[1]), u
        if best:
            assert got[i]["verdict"] == best[2]
        else:
            hit = any(re.search(r.pattern, host + path) for r in urlfilter.PATTERN_RULES)
            assert got[i]["verdict"] == ("block" if hit else "allow"), u
    assert got[15]["verdict"] == "block" and got[16]["verdict"] == "allow" and got[17]["verdict"] == "allow"
    assert urlfilter.judge(df.limit(0)).count() == 0
    twice = urlfilter.judge(df.union(df))
    assert twice.count() == 2 * len(urls) and twice.columns == ["page_id", "url", "host", "path", "rule", "verdict"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_thousands_of_url_rules(spark, monkeypatch, broadcast):
    """5,000 host rules and patterns, by broadcast and by shuffle, against trying each rule on each URL."""
    import random
    import re

    if not broadcast:
        monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 0)
    random.seed(6)
    words = [f"w{i}" for i in range(900)]
    base = {f"{random.choice(words)}.{random.choice(['com', 'net'])}{random.choice(['/', '/a/', '/b'])}": random.choice(["allow", "block"]) for _ in range(4000)}
    base = [urlfilter.host_rule(action, *re.fullmatch("([^/]*)(.*)", name).groups()) for name, action in base.items()]
    patterns = [urlfilter.word_rule(f"p{i}", *random.sample(words, 2)) for i in range(1500)]
    urls = [f"http://{random.choice(['', 'x.'])}{random.choice(words)}{random.choice(['', '-' + random.choice(words)])}.{random.choice(['com', 'net', 'de'])}{random.choice(['/', '/a/1', '/bc', ''])}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(df, rules=urlfilter.rule_table(spark, base, patterns)).collect()}
    base = [(re.compile(r.pattern), r) for r in sorted(base, key=lambda r: -len(r.name))]
    patterns = [(re.compile(r.pattern), r) for r in patterns]
    for i, u in enumerate(urls):
        place = u.split("://", 1)[1]
        best = next((r for p, r in base if p.search(place)), None)
        other = next((r for p, r in patterns if p.search(place)), None)
        assert got[i] == ((best.name, best.action) if best else (None, "block" if other else "allow")), u


def test_licenses(odd, none):
    got = {r["doc_id"]: r for r in licenses.scan_documents(odd, spans=True).collect()}
    assert got[10]["labels"] == "mit" and got[10]["score"] == 1.0 and got[0]["n_words"] == 0
    assert licenses.scan_documents(none).count() == 0


def test_license_rules():
    scan = lambda t: licenses.scan(t.encode())
    assert len(licenses.rules()) > 200
    assert [d[2] for d in scan("Licensed under the Apache License, Version 2.0").detections] == ["apache-2.0"]
    assert [d[2] for d in scan("released under CC BY-NC 4.0").detections] == ["cc-by-nc"]
    assert [d[2] for d in scan("see the GNU Lesser General Public License for more details").detections] == ["lgpl"]
    assert scan("mit license mit license").places == [(0, "mit"), (2, "mit")]
    assert scan("submit licenses commit license").detections == []
    found = [(0, 5, 1), (1, 4, 0), (2, 3, 2), (4, 8, 3), (5, 8, 2), (0, 9, 9)]
    assert sorted(licenses.suppress(found)) == [(0, 5, 1), (0, 9, 9), (1, 4, 0), (4, 8, 3), (5, 8, 2)]


def test_warc(spark, tmp_path):
    big = "<p>é" * 300_000
    rows = [(5, "http://a/\r\nX: y", "one"), (3, "u", "one"), (9, None, None), (2, "u", ""), (7, "u", big), (8, "u", big), (None, "u", "one"), (1, "u", "solo"), (3, "u", "one")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    manifest = warc.write_archives(df, str(tmp_path), archive_bytes=2000)
    got = warc.read_archives(manifest).collect()
    page = lambda s: None if s in (None, "<urn:page:none>") else int(s[len("<urn:page:") : -1])
    assert len(got) == len(rows) and all(r["verified"] and r["problem"] is None for r in got)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        lead = min(j for j, _, h in rows if j is not None and (h or "") == (html or ""))
        want.append((str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), *(("response", None) if i == lead else ("revisit", lead))))
    assert sorted((str(page(r["record_id"])), r["payload_bytes"], r["payload_digest"], r["record_type"], page(r["refers_to_id"])) for r in got) == sorted(want, key=lambda x: (x[0], x[1], x[2], x[3]))
    assert {len(r["payload"]) for r in got if r["record_type"] == "response"} == {len((h or "").encode()) for _, _, h in rows}
    assert warc.list_archives(spark, str(tmp_path)).count() == manifest.count()
    assert warc.read_archives(warc.write_archives(df.limit(0), str(tmp_path / "none"))).count() == 0


def test_warc_in_rows(spark):
    df = spark.createDataFrame([(i, "u", f"page {i % 4}" * 50) for i in range(40)], "page_id long, url string, html string")
    assert not warc.opens("viewfs://store/x") and warc.opens("/tmp/x") and warc.opens("file:///tmp/x")
    manifest = warc.write_archives(df, "viewfs://store/x", archive_bytes=1500)
    got = warc.read_archives(manifest).collect()
    assert manifest.count() > 1 and len(got) == 40 and all(r["verified"] for r in got)
    assert sum(r["record_type"] == "response" for r in got) == 4


def test_warc_small_payloads_are_never_revisits(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", "longer same"), (4, "u", "longer same")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(df, str(tmp_path), min_bytes=5)).collect()
    assert sorted(r["record_type"] for r in got) == ["response", "response", "response", "revisit"]


def test_damaged_archives():
    record = warc._page_record(1, b"u", b"payload" * 100, None)
    data = record * 3
    for size in (1, 7, 1 << 20):
        chunks = [data[i : i + size] for i in range(0, len(data), size)]
        assert [r.problem for r in warc.read_records(chunks)] == [None] * 3
    assert [bool(r.problem) for r in warc.read_records([data[:-20]])] == [False, False, True]
    assert any(r.problem for r in warc.read_records([record[:50] + b"\xff" * 20 + record[70:]]))
    assert [r.problem for r in warc.read_records([zlib.decompress(record, 31) * 2])] == [None, None]
    assert list(warc.read_records([])) == []


def test_pipeline_stages(spark, odd, none, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, none):
            out = stage(spark, df, str(tmp_path))
            if name != "packing":
                assert out.columns == df.columns, name
            n = out.count()
            assert n == 0 if df is none else n > 0 or name == "quality rules", name


def test_pipeline_secret_stage_keeps_all(spark, odd, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.secret_scan(spark, odd, str(tmp_path))
    assert out.count() == odd.count()
    assert {r["text"] for r in out.where("doc_id in (6, 7)").collect()} == {"Same text here, [REDACTED]"}


def test_repeated_lines_do_not_link(spark):
    """Documents that share a repeated line or a run of equal words, and nothing else, all stay; their copies do not."""
    import random

    random.seed(3)
    texts = []
    for k, line in ((30, "all rights reserved by the owners of this page today"), (16, "one two three four five six"), (80, "."), (200, "|")):
        size = len(line.split()) * k
        for _ in range(3):
            texts.append(" ".join([f"w{random.randrange(10**9)}" for _ in range(3 * size)] + [line] * k))
    n = len(texts)
    near = [t.split() for t in texts]
    for t in near:
        t[1] = "other"
    df = spark.createDataFrame(list(enumerate(texts + [" ".join(t) for t in near])), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == list(range(n))


def wide_components(fps, most):
    """Smallest index that near pairs connect, from all pairs of 72-byte fingerprints."""
    import numpy as np

    x = np.frombuffer(b"".join(fps), "<u8").reshape(-1, 9)
    a, b = np.triu_indices(len(x), 1)
    far, size = np.bitwise_count(x[a, :8] ^ x[b, :8]).sum(1), x[:, 8].astype(np.int64)
    on = (far <= most) & (5 * size[a] >= 4 * size[b]) & (5 * size[b] >= 4 * size[a])
    return joined(len(x), zip(a[on].tolist(), b[on].tolist(), strict=True))


def joined(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    return [root(i) for i in range(n)]


def flipped(bits, places):
    return bits ^ sum(1 << i for i in places)


@pytest.mark.parametrize(("block", "least_bits"), [(wide.BLOCK, 16), (40, 16), (wide.BLOCK, 24)])
def test_wide_links_are_complete(spark, monkeypatch, block, least_bits):
    """Components are those of all pairs within NEAR bits: evenly spread differences, a large group, and random ones."""
    import random

    monkeypatch.setattr(wide, "SEGMENT_BITS", (least_bits, 40))
    random.seed(5)
    most, bits = simhash.NEAR, []
    spread = [range(0, 512, 6), *(random.sample(range(512), k) for k in range(32, 96, 2))]
    spread += [[16 * i + j for i in range(32) for j in random.sample(range(16), 2 + (i < 22))] for _ in range(20)]
    for f in spread:
        x = random.getrandbits(512)
        bits += [x, flipped(x, f)]
    x = random.getrandbits(512)
    bits += [flipped(x, random.sample(range(512), random.randint(1, 70))) for _ in range(200)]
    fps = [i.to_bytes(64, "little") + random.choice([100, 110, 120, 130]).to_bytes(8, "little") for i in bits]
    fps = list(dict.fromkeys(fps))
    want = wide_components(fps, most)
    plan = wide.plan_segments(len(fps), most)
    assert sum(s[2] for s in plan) == most - len(plan) + 1 and sum(s[1] for s in plan) == 512
    place = {n: i for i, n in enumerate(wide.names_of(fps).tolist())}
    df = spark.createDataFrame(list(zip(place, fps, strict=True)), "node long, bits binary")
    found = [(place[a], place[b]) for a, b in wide.links(df, plan, most, block=block).collect()]
    assert joined(len(fps), found) == want and len(set(want)) < len(fps) - 200


def test_wide_plans():
    for n in (0, 1, 700, 10**6, 10**9, 1 << 45):
        for most in (0, 40, simhash.NEAR):
            plan = wide.plan_segments(n, most)
            assert sum(s[1] for s in plan) == 512 and sum(s[2] for s in plan) >= most - len(plan) + 1
            assert len(wide.parts_of(plan)) == max(most + 1, len(plan))


def test_similar_texts_are_found(spark):
    """Of pairs at a Jaccard similarity of 0.8 or more, at least nine in ten at 0.80 to 0.83, and all over 0.9; none below 0.6."""
    import random

    random.seed(11)
    words = [f"w{i}" for i in range(3000)]

    def shingles(t):
        return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}

    pairs_, bands = [], {"least": [], "high": [], "low": []}
    while min(len(bands["least"]), len(bands["high"]), len(bands["low"])) < 60:
        a = random.choices(words, k=400)
        b = list(a)
        for _ in range(random.choice([2, 8, 9, 10, 30])):
            b[random.randrange(400)] = random.choice(words)
        x, y = shingles(a), shingles(b)
        j = len(x & y) / len(x | y)
        band = "least" if 0.8 <= j < 0.83 else "high" if j >= 0.9 else "low" if j < 0.6 else None
        if band and len(bands[band]) < 60:
            bands[band].append(len(pairs_))
            pairs_.append((a, b))
    rows = [(2 * i + k, " ".join(t)) for i, pair in enumerate(pairs_) for k, t in enumerate(pair)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = {band: sum(2 * i + 1 not in kept for i in of) / len(of) for band, of in bands.items()}
    assert caught["least"] >= 0.9 and caught["high"] == 1 and caught["low"] == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("MIT", {"mit"}), ("MIT-0", {"mit-0"}), ("Apache-2.0", {"apache-2.0"}), ("GPL-3.0-only", {"gpl-3.0"}), ("GPL-2.0-or-later", {"gpl-2.0"}),
        ("GPL-2.0+", {"gpl-2.0"}), ("LGPL-2.1-or-later", {"lgpl"}), ("AGPL-3.0-only", {"agpl-3.0"}), ("BSD-3-Clause", {"bsd-3-clause"}),
        ("BSD-2-Clause", {"bsd-2-clause"}), ("0BSD", {"bsd"}), ("ISC", {"isc"}), ("MPL-2.0", {"mpl-2.0"}), ("EPL-2.0", {"epl-2.0"}),
        ("CDDL-1.0", {"cddl"}), ("EUPL-1.2", {"eupl"}), ("Artistic-2.0", {"artistic-2.0"}), ("Zlib", {"zlib"}), ("BSL-1.0", {"boost"}),
        ("Unlicense", {"unlicense"}), ("WTFPL", {"wtfpl"}), ("PSF-2.0", {"python"}), ("OFL-1.1", {"ofl"}), ("MS-PL", {"ms-pl"}),
        ("CC0-1.0", {"cc0"}), ("(MIT OR Apache-2.0)", {"mit", "apache-2.0"}), ("Apache-2.0 WITH LLVM-exception OR MIT", {"mit", "apache-2.0"}),
        ("GPL-2.0-only WITH Classpath-exception-2.0 AND BSD-3-Clause", {"gpl-2.0", "bsd-3-clause"}),
    ],
)
def test_spdx_tags(text, labels):
    from quirelane.llm import licenses

    got = licenses.scan(f"// SPDX-License-Identifier: {text}\nint main".encode()).detections
    assert {d[2] for d in got} == labels and max(d[3] for d in got) == 1.0


def test_every_spdx_label():
    from quirelane.llm import licenses

    for label, name in licenses._TAGS.items():
        import re

        plain = re.sub(r"\[(.)[^]]*\]", r"\1", re.sub(r"\(\?:([^|)]*)[^)]*\)(?!\?)", r"\1", re.sub(r"\(\?:[^)]*\)\?", "", name))).split("|")[0]
        assert {d[2] for d in licenses.scan(f"spdx license identifier {plain}".encode()).detections} == {label}, plain


def test_short_license_names():
    from quirelane.llm import licenses

    for text, label in (("GPLv3", "gpl-3.0"), ("this is under the MIT", "mit"), ("released under GPL v2", "gpl-2.0"), ("licensed under Apache 2.0", "apache-2.0"), ("LGPLv2.1", "lgpl"), ("under the LGPL", "lgpl")):
        assert label in {d[2] for d in licenses.scan(text.encode()).detections}, text
    assert not licenses.scan(b"studied at mit and bsd unix").detections


def example(pattern):
    """A text that a pattern matches: first alternatives, and as few repeats as may be."""
    from re import _constants as k
    from re import _parser

    def of(parsed):
        out = ""
        for op, value in parsed:
            if op is k.LITERAL:
                out += chr(value)
            elif op is k.ANY:
                out += "x"
            elif op is k.IN:
                kind, first = value[0]
                out += chr(first if kind is k.LITERAL else first[0])
            elif op is k.BRANCH:
                out += of(value[1][0])
            elif op is k.SUBPATTERN:
                out += of(value[3])
            elif op in (k.MAX_REPEAT, k.MIN_REPEAT):
                out += of(value[2]) * value[0]
            else:
                raise AssertionError(op)
        return out

    return of(_parser.parse(pattern))


def test_every_license_clause_fires():
    """Each of the clauses written by hand, on a text made after it, under a keyword of its own."""
    assert len(licenses._CLAUSES) >= 150
    for label, _, pattern, keywords in licenses._CLAUSES:
        text = example(pattern)
        assert set(keywords.split("|")) & set(text.split()), pattern
        if label != "unknown":
            assert label in {d[2] for d in licenses.scan(f"so {text} it".encode()).detections}, (label, text)


def test_named_license_probes():
    for text, label in (
        ("BSD 3-Clause License", "bsd-3-clause"), ("the BSD 2-Clause License", "bsd-2-clause"), ("licensed under the EPL 2.0", "epl-2.0"), ("licensed under EPL-1.0", "epl-1.0"), ("under CDDL", "cddl"),
        ("released under the EUPL 1.2", "eupl"), ("fonts under OFL 1.1", "ofl"), ("data under ODbL", "odbl"), ("under the MPL 1.1", "mpl-1.1"),
    ):
        assert label in {d[2] for d in licenses.scan(text.encode()).detections}, text


def test_license_clauses_fire_on_their_own_words():
    """Clauses that hold no operators are their own example; they must be found, under a keyword of theirs."""
    from quirelane.llm import licenses

    plain = [c for c in licenses._CLAUSES if not set("(?[{|") & set(c[2])]
    assert len(plain) > 35
    for label, _, pattern, keywords in plain:
        assert set(keywords.split("|")) & set(pattern.split())
        assert label in {d[2] for d in licenses.scan(f"so {pattern} it".encode()).detections}


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
        ("Neither the name of the holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
        ("see https://www.gnu.org/licenses/gpl-3.0.html", "gpl-3.0"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ],
)
def test_license_notices(text, label):
    from quirelane.llm import licenses

    assert [d[2] for d in licenses.scan(text.encode()).detections] == [label]


def test_license_suppression_against_plain_rules():
    import random

    from quirelane.llm import licenses

    random.seed(4)
    for _ in range(500):
        found = [(s := random.randrange(12), s + random.randrange(1, 8), random.randrange(4)) for _ in range(random.randrange(14))]
        kept = []
        for s, e, p in sorted(found, key=lambda d: (d[2], d[0] - d[1], d[0])):
            if not any(a <= s and b >= e for a, b, _ in kept):
                kept.append((s, e, p))
        assert sorted(licenses.suppress(found)) == sorted(kept)


def test_url_rules_are_never_lost(spark):
    """Upper case in hosts and paths, and rules without an ASCII token, against trying each rule on each URL."""
    import re

    rules = [urlfilter.host_rule("block", "com", "/Es/"), urlfilter.host_rule("block", "Example.ORG", "/A1b"), urlfilter.host_rule("block", "пример.рф", "/"), urlfilter.host_rule("block", "é", "/ü/"), urlfilter.host_rule("allow", "NET", "")]
    patterns = [urlfilter.Rule("odd", "block", "^[^/]*—", ()), urlfilter.Rule("upper", "block", "Shop", ("SHOP",)), urlfilter.path_rule("login", "wp", "login")]
    hosts = ["a.com", "com", "EXAMPLE.org", "x.example.org", "пример.рф", "a.пример.рф", "é", "b.é", "a.net", "odd—host", "xcom", "s.info"]
    paths = ["", "/", "/Es/x", "/es/x", "/A1bc", "/a1b", "/ü/", "/ü", "/Shop", "/shop/", "/x/Wp-Login.php", "/wp-logins"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(df, rules=urlfilter.rule_table(spark, rules, patterns)).collect()}
    ordered = sorted(rules, key=lambda r: -len(r.name))
    hit = set()
    for i, u in enumerate(urls):
        host, path = re.match("http://([^/]*)(.*)", u).groups()
        place = "".join(c.lower() if c.isascii() else c for c in host) + path
        best = next((r for r in ordered if re.search(r.pattern, place)), None)
        other = next((r for r in patterns if re.search(r.pattern, place)), None)
        assert got[i] == ((best.name, best.action) if best else (None, "block" if other else "allow")), u
        hit |= {best.name if best else None, other and not best and other.name}
    assert hit >= {"com/Es/", "example.org/A1b", "пример.рф/", "é/ü/", "net", "odd", "upper", "login"}


def test_repeated_ledger_rows(spark, tmp_path):
    """A blob that two scans have appended gives one row a path; redaction reads and extends the same ledger."""
    place = f"file://{tmp_path}/ledger"
    docs = spark.createDataFrame([(1, "x token=abcdef y", 16), (2, "plain", 5), (3, "x token=abcdef y", 16)], "doc_id long, text string, n_chars long")
    once = sorted(map(tuple, secrets.digest(secrets.find_stored(docs, place)).collect()))
    spark.read.parquet(place).write.mode("append").parquet(f"{place}-twice")
    spark.read.parquet(place).write.mode("append").parquet(f"{place}-twice")
    assert sorted(map(tuple, secrets.digest(secrets.find_stored(docs, f"{place}-twice")).collect())) == once and len(once) == 3
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in secrets.redact(docs, length="n_chars", ledger=f"{place}-twice").collect())
    assert got == [(1, "x [REDACTED] y", 14), (2, "plain", 5), (3, "x [REDACTED] y", 14)]
    assert spark.read.parquet(f"{place}-twice").count() == 4
    more = spark.createDataFrame([(9, "secret=ghijkl", 13), (2, "plain", 5)], "doc_id long, text string, n_chars long")
    assert {r["text"] for r in secrets.redact(more, ledger=f"{place}-twice").collect()} == {"[REDACTED]", "plain"}
    assert spark.read.parquet(f"{place}-twice").count() == 5


def test_bytes_that_are_not_utf8(spark):
    """They are read as U+FFFD, and fail no operator."""
    from quirelane.llm import divergence, filter_audit, langid

    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.unhex(F.lit("61FF6220C3")).cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    want = Tokenizer.from_file(BYTE).encode("a�b �", add_special_tokens=False).ids
    assert list(bpe.encode_documents(docs, BYTE, ids=True).first()["ids"]) == want
    assert packing.pack_documents(docs, WORD).first()["length"] == len(Tokenizer.from_file(WORD).encode("a�b �", add_special_tokens=False).ids) + 1
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 600 and divergence.audit(docs).count() == 0
    assert langid.identify(docs, langid.train(docs), keep=["doc_id"]).count() == 1
    assert quality.judge(docs, quality.fit(docs, labels), keep=["doc_id"]).count() == 1


def test_vocabulary_without_a_byte(tmp_path):
    import json

    spec = json.loads(open(BYTE, encoding="utf-8").read())
    gone = next(t for t in spec["model"]["vocab"] if len(t) == 1 and t == "Q")
    del spec["model"]["vocab"][gone]
    spec["model"]["merges"] = []
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="81"):
        bpe.BytePairs(str(tmp_path / "v.json"))


def test_second_pipeline_run_scans_nothing(spark, tmp_path, monkeypatch):
    """The secret stage over a ledger that an earlier run has filled."""
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "x token=abcdef y", "en", "s", 16), (2, None, "en", "s", 0), (3, "plain", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(map(tuple, corpus_pipeline.secret_scan(spark, docs, "").collect()))
    spark.conf.set("spark.quirelane.secrets.ledger", f"file://{tmp_path}/ledger")
    try:
        for _ in range(2):
            assert sorted(map(tuple, corpus_pipeline.secret_scan(spark, docs, "").collect())) == want
            assert spark.read.parquet(f"{tmp_path}/ledger").count() == 3
    finally:
        spark.conf.unset("spark.quirelane.secrets.ledger")

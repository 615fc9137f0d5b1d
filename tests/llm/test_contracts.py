"""Registered queries of the subpackage against brute force on small tables."""

import hashlib
import itertools
import math
import re
import sys
import zlib
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from test_queries import compare  # noqa: E402

import public_tokenizers  # noqa: E402
import xxhash  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quirelane.llm import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"


def read(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] for r in read("documents")}


def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, DATA).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_op1(spark):
    import base64

    pages = read("pages")
    first = {}
    for p in sorted(pages, key=lambda p: p["page_id"]):
        first.setdefault(p["html"] or "", p["page_id"])
    got = {r["page_id"]: r for r in rows(spark, "op1_warc")}
    assert len(got) == len(pages)
    for p in pages:
        body, r = (p["html"] or "").encode(), got[p["page_id"]]
        lead = first[p["html"] or ""]
        assert r["payload_bytes"] == len(body) and r["verified"]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if lead == p["page_id"] else ("revisit", lead))


def brute_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, r):
    up = {i: i for i in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= r:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in fps}


def test_op2(spark, docs):
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    comp = brute_components(fps, 4)
    got = rows(spark, "op2_simhash")
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{fps[i]:016x}", comp[i]) for i in docs)


def test_op3(spark, docs):
    from quirelane.llm.packing import lower_bound

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in docs.items():
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[i, k] = (s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    got = rows(spark, "op3_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    counts = {}
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
            counts[n] = counts.get(n, 0) + 1
        assert at <= 2048
    assert len(bins) <= lower_bound(counts, 2048) + 1


def test_op4(spark, docs):
    labels = {r["doc_id"]: r["toxic"] for r in read("labels")}
    got = rows(spark, "op4_toxicity")
    assert len(got) == len(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    assert labels


def test_op4_on_held_out_labels(spark):
    """Precision and recall on labels that the model has not seen."""
    data = DATA.replace("sf0.001", "sf0.1")
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{data}/labels.parquet").to_pylist()}
    got = [r for r in queries.op4_toxicity(spark, data).collect() if r["held_out"] and r["doc_id"] in toxic]
    caught = [toxic[r["doc_id"]] for r in got if r["predicted"]]
    wanted = [r["predicted"] for r in got if toxic[r["doc_id"]]]
    assert len(wanted) >= 50 and sum(caught) / len(caught) >= 0.9 and sum(wanted) / len(wanted) >= 0.8


def test_repeated_labelled_ids_count_once(spark):
    """A labelled id with very many rows does not multiply the samples that models are fitted to."""
    from quirelane.llm import quality, toxicity

    rows = [(i, f"word{i} " * 30 + ("you idiot " * 5 if i % 2 else "")) for i in range(60)] + [(3, f"copy {i} of three you idiot") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 and 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    once = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    a, b = (toxicity.train(d, labels) for d in (docs, once))
    assert a.base == b.base and len(a.trees) == len(b.trees) and a.lexicon.weights == b.lexicon.weights
    assert quality.fit(docs, labels).threshold is not None


def test_op5(spark, docs):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows(spark, "op5_bpe"):
        ids = tk.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_op6(spark, docs):
    for r in rows(spark, "op6_secrets"):
        want = brute_secrets(docs[r["doc_id"]] or "")
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x[1] for x in want) for k in range(3)]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r["spans"].split(","))


def test_op7(spark):
    v = {r["vec_id"]: [math.floor(64 * float(x)) for x in r["embedding"]] for r in read("embeddings")}
    want = {}
    for q in v:
        if q % 20 == 0:
            s = sorted(((-sum(a * b for a, b in zip(v[q], v[o], strict=True)), o) for o in v if o != q))[:20]
            want |= {(q, i + 1): (o, -n) for i, (n, o) in enumerate(s)}
    got = rows(spark, "op7_topk")
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)


def test_op8(spark, docs):
    got = rows(spark, "op8_quality")
    assert len(got) == len(docs)
    for r in got:
        t = docs[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = {}
        for i in range(len(words) - 7):
            windows.setdefault(tuple(words[i : i + 8]), []).append(i)
        rep = {j for p in windows.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and (not r["kept"] or not failed)


def test_op10(spark, docs):
    from quirelane.llm.licenses import PHRASES

    for r in rows(spark, "op10_licenses"):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), docs[r["doc_id"]] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at = [(i, lab) for p, lab in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(places, default=None), max(places, default=None))
        base = {lab for _, lab in at}
        assert r["base_labels"] == ",".join(sorted(base)) and base <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, DATA)
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        assert d.columns == columns and d.count() <= n, name
        n = d.count()
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    assert 0 < len(texts) < len(docs)
    assert not any(brute_secrets(t) for t in texts.values())
    assert len(set(texts.values())) == len(texts)
    assert pa


def test_pipeline_run_against_brute_force(spark, docs):
    """run()'s rows, from plain Python over the same fitted models."""
    import corpus_pipeline
    import numpy as np

    from quirelane.llm import quality, secrets, simhash, toxicity, wide

    schema = "doc_id long, text string"
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    whole = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")

    good = quality.fit(whole, labels)

    def passes(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = {}
        for i in range(len(words) - 7):
            windows.setdefault(tuple(words[i : i + 8]), []).append(i)
        rep = {j for p in windows.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
        data = t.encode()
        codes = [(int.from_bytes(data[i : i + 4], "little") * 2654435761 % 2**32) >> 16 for i in range(len(data) - 3)]
        score = sum(good.ratios[c] for c in codes) / max(len(codes), 1)
        return len(words) >= 20 and 100 * len(rep) <= 30 * len(words) and score >= good.threshold

    kept = {i: t for i, t in docs.items() if t is not None and passes(t)}
    model = toxicity.train(spark.createDataFrame(list(kept.items()), schema), labels)
    kept = {i: t for i, t in kept.items() if model.score(np.array([toxicity.features(t.encode(), model.lexicon)]))[0] < 0.7}

    prints = {i: wide.fingerprint(t.encode(), 5) for i, t in kept.items()}
    up = {i: i for i in kept}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(kept), 2):
        x, y = prints[a], prints[b]
        n, m = sorted(int.from_bytes(z[64:], "little") for z in (x, y))
        if 5 * n >= 4 * m and (int.from_bytes(x[:64], "big") ^ int.from_bytes(y[:64], "big")).bit_count() <= simhash.NEAR:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    kept = {i: t for i, t in kept.items() if root(i) == i}

    def clean(t):
        spans = sorted((m.start(), m.end()) for _, p, g, least, _ in secrets.RULES for m in re.finditer(p, t) if len(m[g]) >= least)
        out, at = [], 0
        for s, e in spans:
            if s >= at:
                out += [t[at:s], "[REDACTED]"]
            at = max(at, e)
        return "".join(out) + t[at:]

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in kept.items():
        ids = tk.encode(clean(t), add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.add((i, k, s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    assert len(kept) < len(docs)

"""Trees, fingerprints over trees and nested JSON against plain Python."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from quirelane.operators import json_compare, receipts, trees

NODES = "doc_id long, node string, parent string, position int, a string, n int"


def forest(seed):
    """Random trees, a chain of 70, a ring with nodes below it, and a node without its parent."""
    rng = random.Random(seed)
    rows = [(1, "c0", None, 0, "top", None)] + [(1, f"c{i}", f"c{i - 1}", i % 3, f"at {i}" if i % 9 == 0 else None, i if i == 40 else None) for i in range(1, 70)]
    rows += [(2, "x0", "x2", 0, None, None), (2, "x1", "x0", 0, "x", None), (2, "x2", "x1", 0, None, 1), (2, "y", "x1", 1, None, None), (2, "z", "gone", 0, "z", None), (2, "zz", "z", 0, None, 5)]
    for doc in range(3, 7):
        for i in range(rng.randint(1, 40)):
            parent = None if i == 0 or rng.random() < 0.05 else f"n{rng.randrange(i)}"
            rows.append((doc, f"n{i}", parent, i, rng.choice([None, None, f"v{i}"]), rng.choice([None, i])))
    return rows


def brute(rows):
    by = {(r[0], r[1]): r for r in rows}
    out = {}
    for r in rows:
        way, state, cur = [r], "ok", r
        while cur[2] is not None:
            cur = by.get((r[0], cur[2]))
            if cur is None or cur in way:
                state = "orphan" if cur is None else "cycle"
                break
            way.append(cur)
        first = lambda k, way=way: next((x[k] for x in way if x[k] is not None), None)
        fine = state == "ok"
        out[r[0], r[1]] = (state, way[-1][1] if fine else None, len(way) - 1 if fine else None, [x[3] for x in reversed(way)] if fine else None, first(4) if state != "cycle" else ..., first(5) if state != "cycle" else ...)
    return out


def test_climb(spark):
    for seed in (1, 2):
        rows = forest(seed)
        got = trees.climb(spark.createDataFrame(rows, NODES), inherit=["a", "n"]).collect()
        want = brute(rows)
        assert len(got) == len(rows)
        for r in got:
            w = want[r["doc_id"], r["node"]]
            assert (r["state"], r["root"], r["depth"], r["path"]) == w[:4], r
            assert w[4] is ... or (r["a"], r["n"]) == w[4:], r


def test_climb_of_nothing(spark):
    none = spark.createDataFrame([], NODES)
    assert trees.climb(none, inherit=["a"]).count() == 0
    assert trees.subtree_hashes(trees.climb(none), F.col("a")).count() == 0
    ring = spark.createDataFrame([(1, "p", "q", 0, None, None), (1, "q", "p", 0, None, None)], NODES)
    assert {r["state"] for r in trees.climb(ring).collect()} == {"cycle"}


def test_numbering_is_pre_order(spark):
    rows = [(1, "r", None, 0), (1, "b", "r", 1), (1, "a", "r", 0), (1, "b0", "b", 0), (1, "a1", "a", 11), (1, "a0", "a", 2), (1, "c", "r", 2)]
    df = spark.createDataFrame(rows, "doc_id long, node string, parent string, position int")
    got = trees.numbered(trees.climb(df), F.col("node").isin("a0", "a1", "b0", "c")).collect()
    assert {r["node"]: r["number"] for r in got} == {"a0": 0, "a1": 1, "b0": 2, "c": 3}


def test_nest(spark):
    rng = random.Random(4)
    rows = [(d, i, rng.randint(1, 6)) for d in range(3) for i in range(60)]
    got = trees.nest(spark.createDataFrame(rows, "doc_id long, place int, level int")).collect()
    for r in got:
        earlier = [p for d, p, v in rows if d == r["doc_id"] and p < r["place"] and v < r["level"]]
        assert r["parent"] == (max(earlier) if earlier else None) and r["position"] == r["place"]


def hashes(spark, rows):
    got = trees.subtree_hashes(trees.climb(spark.createDataFrame(rows, NODES)), F.coalesce("a", F.lit("")))
    return {r["node"]: r["hash"] for r in got.collect()}


def test_subtree_hashes(spark, monkeypatch):
    """By hand, in blocks; a moved subtree changes its old and new holders and nothing else."""
    monkeypatch.setattr(trees, "BLOCK", 2)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(1, "r", None, 0, "r", None)] + [(1, f"k{i}", "r", i, f"t{i}", None) for i in range(5)] + [(1, "m", "k0", 0, "m", None)]
    got = hashes(spark, rows)
    leaf = lambda t: sha(sha(t))
    k0 = sha(sha("t0") + sha(sha(leaf("m"))))
    kids = [k0] + [leaf(f"t{i}") for i in range(1, 5)]
    assert got["m"] == leaf("m") and got["k0"] == k0
    assert got["r"] == sha(sha("r") + sha("".join(sha("".join(kids[i : i + 2])) for i in (0, 2, 4))))
    moved = hashes(spark, [(*r[:2], "k1", *r[3:]) if r[1] == "m" else r for r in rows])
    assert {n for n in got if got[n] != moved[n]} == {"r", "k0", "k1"}


def test_document_fingerprints(spark):
    """Each part of a document changes its fingerprint: pages and their order, resources, boxes, rotation, structure, flags."""

    def of(pages=((0, "a"), (1, "b")), fonts=(("Font", "F1", "x"),), crop=None, rotate=0, tree="t", flags=(False, False, False, False)):
        p = spark.createDataFrame([(1, i, t) for i, t in pages], "doc_id long, page_index int, content_hash string")
        box = [F.lit(float(x)) for x in (0, 0, 612, 792)]
        p = p.withColumn("geometry_hash", receipts.geometry_hash(box, [F.lit(crop).cast("double")] * 4, F.lit(rotate)))
        r = receipts.resource_hashes(spark.createDataFrame([(1, 0, *f) for f in fonts], "doc_id long, page_index int, category string, name string, body string"))
        s = spark.createDataFrame([(1, tree)] if tree else [], "doc_id long, hash string")
        c = spark.createDataFrame([(1, *flags)], ["doc_id", *receipts.FLAGS])
        return receipts.document_fingerprints(p.join(r, ["doc_id", "page_index"], "left"), s, c).first()["fingerprint"]

    flagged = [{"flags": tuple(i == k for i in range(4))} for k in range(4)]
    cases = [
        {}, {"pages": ((0, "b"), (1, "a"))}, {"pages": ((0, "a"),)}, {"fonts": (("Font", "F1", "y"),)}, {"fonts": (("Font", "F2", "x"),)}, {"fonts": (("XObject", "F1", "x"),)},
        {"crop": 5.0}, {"rotate": 90}, {"tree": "u"}, {"tree": None}, *flagged,
    ]
    got = [of(**c) for c in cases]
    assert len(set(got)) == len(cases) and of() == got[0] and all(g.startswith("quirelane-v1:") for g in got)
    two = (("Font", "F1", "x"), ("ExtGState", "G", "z"))
    assert of(fonts=two) == of(fonts=two[::-1])  # by name, not as they come


# JSON


def texts(spark, rows):
    return spark.createDataFrame([(i, t if t is None or isinstance(t, str) else json.dumps(t)) for i, t in rows], "doc_id long, body string")


def test_json_nodes(spark):
    value = {"a": 1, "b": {"c": [1, 2.5, {"d": "x"}], "e": None, "odd key": True}, "h": [], "i": {}, "r": {"min": 1, "max": 3}}
    got = json_compare.nodes(texts(spark, [(1, value), (2, "{bad"), (3, None), (4, '"s"'), (5, "7"), (6, [[[0]]])]), "doc_id", "body").collect()
    rows = {(r["doc_id"], r["path"]): (r["kind"], r["value"], len(r["trail"])) for r in got}
    assert rows == {
        (1, "$"): ("object", "5", 0), (1, "$.a"): ("number", "1", 1), (1, "$.b"): ("object", "3", 1), (1, "$.b.c"): ("array", "3", 2), (1, "$.b.c[0]"): ("number", "1", 3),
        (1, "$.b.c[1]"): ("number", "2.5", 3), (1, "$.b.c[2]"): ("object", "1", 3), (1, "$.b.c[2].d"): ("string", "x", 4), (1, "$.b.e"): ("null", "null", 2), (1, '$.b."odd key"'): ("boolean", "true", 2),
        (1, "$.h"): ("array", "0", 1), (1, "$.i"): ("object", "0", 1), (1, "$.r"): ("rule", '{"max":3,"min":1}', 1), (2, "$"): ("invalid", None, 0),
        (4, "$"): ("string", "s", 0), (5, "$"): ("number", "7", 0), (6, "$"): ("array", "1", 0), (6, "$[0]"): ("array", "1", 1), (6, "$[0][0]"): ("array", "1", 2), (6, "$[0][0][0]"): ("number", "0", 3),
    }


def compared(spark, actual, expected, tolerances=()):
    got = json_compare.compare(texts(spark, [(1, actual)]), texts(spark, [(1, expected)]), "doc_id", "body", tolerances)
    return {r["path"]: r["reason"] or r["result"] for r in got.collect() if r["result"] != "pass"}


def test_json_rules(spark):
    assert compared(spark, {"n": 5, "s": "some text", "l": [1, 2]}, {"n": {"min": 1, "max": 5}, "s": {"min_length": 9, "contains": ["some", "xt"]}, "l": {"min": 2, "max": 2}}) == {}
    got = compared(spark, {"n": 5, "m": 5, "s": "some", "t": "some", "l": [1], "k": [1, 2, 3], "b": True}, {"n": {"min": 6}, "m": {"max": 4}, "s": {"min_length": 5}, "t": {"contains": ["so", "xt"]}, "l": {"min": 2}, "k": {"max": 2}, "b": {"min": 1}})
    assert got == {
        "$.n": "value 5 is less than minimum 6", "$.m": "value 5 is greater than maximum 4", "$.s": "string length 4 is less than minimum 5", "$.t": "string does not contain 'xt'",
        "$.l": "array length 1 is less than minimum 2", "$.k": "array length 3 is greater than maximum 2", "$.b": "expected a rule's value, got boolean",
    }


def test_json_differences(spark):
    actual = {"same": [1, {"x": None}], "gone": 0, "number": 1, "kind": "1", "whole": {"deep": {"a": 1}}, "list": [1, 2, 3], "more": {"a": {"b": 1}}}
    expected = {"same": [1, {"x": None}], "new": {"a": {"b": 1}}, "number": 2, "kind": 1, "whole": [1, 2], "list": [1, 2]}
    assert compared(spark, actual, expected) == {
        "$.gone": "unexpected", "$.new": "missing", "$.number": "expected 2, got 1", "$.kind": 'expected 1, got "1"', "$.whole": "expected array of 2, got object of 1", "$.list[2]": "unexpected", "$.more": "unexpected",
    }
    assert compared(spark, None, {"a": 1}) == {"$": "missing"} and compared(spark, {"a": 1}, None) == {"$": "unexpected"}
    assert compared(spark, "{bad", {"a": 1}) == {"$": "expected object of 1, got no JSON"} and compared(spark, "{bad", "{bad") == {"$": "expected no JSON, got no JSON"}


def test_json_tolerances(spark):
    t = json_compare.Tolerance
    actual, expected = {"a": {"x": 1.0}, "b": [{"x": 100}, {"x": 110}], "c": {"v": 5.0}}, {"a": {"x": 1.05}, "b": [{"x": 101}, {"x": 100}], "c": {"v": {"value": 5.5}}}
    assert set(compared(spark, actual, expected)) == {"$.a.x", "$.b[0].x", "$.b[1].x", "$.c.v"}
    assert set(compared(spark, actual, expected, [t("$.b[*].x", relative=0.02), t("$.c.*", absolute=0.5)])) == {"$.a.x", "$.b[1].x"}
    # the exact path comes before a pattern
    assert set(compared(spark, actual, expected, [t("*", absolute=1000), t("$.a.x", absolute=0.01)])) == {"$.a.x"}

"""Integrity, validity, weighted predicates and further Markdown."""

import hashlib
import hmac as std

from pyspark.sql import functions as F

from quirelane.operators import checks, profiles, serialise
from quirelane.sources import virtual_pages


def test_hmac(spark):
    for key in (b"k", b"k" * 100):
        df = spark.createDataFrame([(b"body",), (b"",)], "b binary")
        assert [r[0] for r in df.select(checks.hmac(key, F.col("b"))).collect()] == [std.new(key, b, hashlib.sha256).hexdigest() for b in (b"body", b"")]


def test_schema(spark):
    pages = spark.createDataFrame([(1, 0, "a")], "doc_id long, page_index int, page_text string")
    good = serialise.document_json(pages).select("json")
    bad = spark.createDataFrame([("{",), ('{"schema_version": "9.0", "pages": []}',), ('{"schema_version": "1.0"}',)], "json string")
    got = checks.schema_problems(good.union(bad), "schema_version string, pages array<struct<page_index: int>>").collect()
    assert [r["problem"] for r in got] == [None, "not_json", "version", "shape"]


def test_decoding(spark):
    df = spark.createDataFrame([("日本".encode("shift_jis"),), (b"\xff\xff",)], "b binary")
    assert [tuple(r[0]) for r in df.select(checks.decoded(F.col("b"), "shift_jis")).collect()][0] == ("日本", True)
    t = spark.createDataFrame([(b"\xfe\xff\x00A",), (b"\xff\xfeA\x00",), (b"\xef\xbb\xbf\xc3\xa9",), (b"caf\xe9",)], "b binary")
    assert [r[0] for r in t.select(checks.text_string(F.col("b"))).collect()] == ["A", "A", "é", "café"]


def test_xfa(spark):
    xml = '<xdp xmlns="x"><datasets><data><form><name>Ann</name><age>7</age></form></data></datasets></xdp>'
    got = checks.xfa_fields(spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "doc_id long, xml string")).collect()
    assert [tuple(r) for r in got] == [(1, "form.name", "Ann"), (1, "form.age", "7")]


def test_weighted_predicates(spark):
    docs = spark.createDataFrame([(1, "Title\n- a\n- b\n1 + 2 = 3"), (2, "plain words")], "doc_id long, text string")
    s = profiles.feature_signals(virtual_pages.lines(docs)).withColumns({"has_table": F.lit(False), "has_form": F.lit(True), "has_signature": F.lit(False)})
    rules = [("contains", "TITLE"), ("bullets", 2), ("math", True), ("pages", (1, 1)), ("heading_depth", (2, None)), ("has_form", True), ("regex", "^T")]
    got = {r["doc_id"]: [r[f"r{i}"] for i in range(len(rules))] for r in s.select("doc_id", *(profiles.weighted_predicate(*r).alias(f"r{i}") for i, r in enumerate(rules))).collect()}
    assert got[1] == [True] * 7 and got[2] == [False, False, False, True, False, True, False]


def test_markdown(spark):
    f = spark.createDataFrame([(1, "b", "text", "x|y"), (1, "a", "choice", None)], "doc_id long, name string, type string, value string")
    assert serialise.form_markdown(f).first()["markdown"].split("\n")[2:] == ["| a | choice |  |", "| b | text | x\\|y |"]
    n = spark.createDataFrame([(1, 2, "two"), (1, 1, "one*")], "doc_id long, number int, text string")
    assert serialise.footnotes(n).first()["markdown"] == "[^1]: one\\*\n[^2]: two"
    b = spark.createDataFrame([(1, 0, 1, 4), (1, 0, 0, 2), (1, 1, 0, 0)], "doc_id long, thread int, position int, page_index int")
    assert serialise.thread_markdown(b).first()["markdown"] == "- Thread 1: pages 3, 5\n- Thread 2: pages 1"


def test_clusters_need_a_shared_folder():
    """Without a checkpoint folder a local session gets one of its own; a cluster's fails at once."""
    from types import SimpleNamespace

    from quirelane import session

    def spark(master, named=None, set_dir=None):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: set_dir), conf=SimpleNamespace(get=lambda k, d: named if named else d))

    assert session.shared_folder(spark("spark://x:7077", "hdfs://a/b/"), "n").startswith("hdfs://a/b/n-")
    assert session.shared_folder(spark("yarn", None, "s3a://c"), "n").startswith("s3a://c/n-")
    assert "quirelane-shared-" in session.shared_folder(spark("local[4]"), "n")
    try:
        session.shared_top(spark("spark://x:7077"))
    except RuntimeError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError

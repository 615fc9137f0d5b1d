"""Ordered pages with refused repeats, and windows that report late events."""

from quirelane.streaming import frames

PAGES = "doc_id long, page_index int, text string"


def play(spark, place, batches, schema, make):
    """Run a stream once after each batch of rows; (rows, errors) so far after each."""
    out = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
        frames.run_split(make(spark.readStream.schema(schema).parquet(f"{place}/in")), f"{place}/out", f"{place}/errors", f"{place}/state")
        read = lambda p: sorted((tuple(r)[:-1] for r in spark.read.parquet(f"{place}/{p}").collect()), key=repr)
        out.append((read("out"), read("errors")))
    return out


def test_repeated_pages_are_refused(spark, tmp_path):
    """A page that comes twice in a batch, one that waits already, and one that was passed on already."""
    batches = [
        [(1, 2, "c"), (1, 2, "c again"), (2, 0, "x")],
        [(1, 2, "c late"), (1, 1, None), (2, 0, "x again"), (2, 1, "y")],
        [(1, 0, "a"), (1, 4, "e"), (2, 1, "y again")],
        [(1, 3, "d"), (1, 0, "a again")],
    ]
    (_, first), (second, _), (third, _), (good, bad) = play(spark, tmp_path, batches, PAGES, frames.ordered)
    assert first == [(1, 2, "c again", "Duplicate page index: 2")]
    assert second == [(2, 0, "x"), (2, 1, "y")]
    assert third == [(1, 0, "a"), (1, 1, None), (1, 2, "c"), (2, 0, "x"), (2, 1, "y")]
    assert good == [(1, 0, "a"), (1, 1, None), (1, 2, "c"), (1, 3, "d"), (1, 4, "e"), (2, 0, "x"), (2, 1, "y")]
    assert sorted(bad) == [
        (1, 0, "a again", "Duplicate page index: 0"), (1, 2, "c again", "Duplicate page index: 2"), (1, 2, "c late", "Duplicate page index: 2"),
        (2, 0, "x again", "Duplicate page index: 0"), (2, 1, "y again", "Duplicate page index: 1"),
    ]


def test_order_within_a_batch(spark, tmp_path):
    """Pages that one batch frees come out in order, and rows of text keys work alike."""
    rows = [("d", p, f"t{p}") for p in (5, 3, 1, 4, 2, 0)]
    spark.createDataFrame(rows, "doc string, page_index int, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    stream = frames.ordered(spark.readStream.schema("doc string, page_index int, text string").parquet(f"{tmp_path}/in"), "doc")
    frames._start(stream.writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state"), spark)
    assert [(r["doc"], r["page_index"], r["error"]) for r in got] == [("d", p, None) for p in range(6)]


def test_late_events(spark, tmp_path):
    """Windows of 10 seconds, closed 5 seconds after their end; later events of closed windows are errors."""
    at = lambda k, *seconds: [(k, s) for s in seconds]
    schema = "kind string, at long"
    batches = [at("a", 1, 2, 12, 31) + at("b", 3), at("a", 3, 25, 27, 4), at("a", 60, 26) + at("b", 4, None)]
    made = lambda s: frames.closed_windows(s.selectExpr("kind", "timestamp_seconds(at) AS at"), "at", "kind", 10, 5)
    (one, none), (two, late), (three, all_late) = play(spark, tmp_path, batches, schema, made)
    assert one == [("a", 0, 2), ("a", 10, 1)] and none == []  # 26 has passed the end of both and their 5 seconds
    assert two == one and late == [("a", 0, 2, "Late event")]  # 20 to 30 is still open: two more
    assert three == [("a", 0, 2), ("a", 10, 1), ("a", 20, 3), ("a", 30, 1)] and all_late == late

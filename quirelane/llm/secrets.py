"""Secret scans over an incremental ledger of content-addressed texts. DataFrame and SQL functions only.

Every version of a text is a blob named by its SHA-256. The ledger has a row per blob and rule version that was scanned;
a scan reads only the blobs that the ledger lacks for the present rules, once each, and findings are joined back to all
paths (rows) that hold the blob, historical ones included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelane.session import cut

#: kind, pattern, group whose length counts, least length, literals of which a text must hold one.
#: The first three are the base rules, in the order in which ties of a place are listed.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, (":", "=")),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    ("hex", r"[0-9a-f]{24,}", 0, 24, ()),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, ("PRIVATE KEY-----",)),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("chat", r"xox[abeprs]-[A-Za-z0-9-]{10,}", 0, 1, ("xox",)),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyJ",)),
    ("cloud_key", r"AIza[A-Za-z0-9_-]{35}", 0, 1, ("AIza",)),
]
BASE = 3
#: Changes whenever the rules do: blobs are then scanned anew, and earlier findings stay under their own version.
RULE_VERSION = 1
SPAN = "struct<start:int,kind:int,end:int>"
LEDGER = f"blob binary, rule_version int, spans array<{SPAN}>"


MATCHES = "array<struct<kind:int,gap:int,size:int,long:boolean>>"


def _matches(text: Column, number: int) -> Column:
    """Leftmost non-overlapping matches of one rule, in order: what lies before each, its size, whether it is long enough."""
    _, pattern, group, least, literals = RULES[number]
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
        F.split(text, pattern, -1).alias("before"),
    )
    made = F.transform(
        F.filter(zipped, lambda x: x["all"].isNotNull()),  # the last split has no match after it
        lambda x: F.struct(
            F.lit(number).alias("kind"), F.char_length(x["before"]).alias("gap"), F.char_length(x["all"]).alias("size"), (F.char_length(x["part"]) >= least).alias("long")
        ),
    )
    gate = text.rlike(pattern)
    if literals:
        gate = reduce(lambda a, b: a | b, [text.contains(x) for x in literals]) & gate
    return F.when(gate, made).otherwise(F.array().cast(MATCHES))


def _spans(blobs: DataFrame) -> DataFrame:
    """(blob, spans by start, then kind) of rows (blob, matches), one per blob.

    Places are running sums over a rule's matches, in code points: a window, so time is linear in a text's matches. The
    rows already lie by blob, and no further shuffle is needed.
    """
    rows = blobs.select("blob", F.posexplode_outer("matches").alias("i", "m"))
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(Window.partitionBy("blob", "m.kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    span = F.struct((F.col("end") - F.col("m.size")).cast("int").alias("start"), F.col("m.kind").alias("kind"), F.col("end").cast("int").alias("end"))
    found = rows.withColumn("end", end).groupBy("blob").agg(F.array_sort(F.collect_list(F.when(F.col("m.long"), span))).alias("spans"))
    return found.select("blob", F.col("spans").cast(f"array<{SPAN}>").alias("spans"))


def written(spans_: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*(F.lit(r[0]) for r in RULES))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def _with_blob(docs: DataFrame, id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).alias("_id"), body.alias("_text"), F.unhex(F.sha2(body, 256)).alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """New ledger rows: one per blob of ``docs`` that ``ledger`` lacks for these rules.

    A blob is read from the row with its smallest id, so a text that very many rows share is scanned once; a blob whose
    ids are all null is read from each and kept once. The text is shuffled by blob and id, which no hot blob skews.
    """
    rows = _with_blob(docs, id, text)
    unseen = rows.groupBy("blob").agg(F.min("_id").alias("_least"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    unseen = unseen.withColumnRenamed("blob", "_blob")
    todo = rows.join(unseen, (rows["blob"] == F.col("_blob")) & rows["_id"].eqNullSafe(F.col("_least")))
    matches = F.concat(*(_matches(F.col("_text"), i) for i in range(len(RULES))))
    found = _spans(todo.select("blob", matches.alias("matches")).groupBy("blob").agg(F.first("matches").alias("matches")))
    return found.select("blob", F.lit(RULE_VERSION).alias("rule_version"), "spans")


def find(docs: DataFrame, ledger: DataFrame | None = None, *, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((id, blob, spans) for every row of ``docs``, the ledger with what was scanned now).

    Null text: empty, without spans. Rows with null ids and repeated rows are kept as they are.
    """
    new = cut(scan(docs, ledger, id=id, text=text))
    whole = new if ledger is None else ledger.unionByName(new)
    return _paths(docs, whole, id=id, text=text), whole


def _appended(docs: DataFrame, place: str, *, id: str, text: str) -> DataFrame:
    """A stored ledger after the blobs of ``docs`` that it lacked were scanned and appended to it."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    ledger = spark.read.schema(LEDGER).parquet(place) if there else None
    scan(docs, ledger, id=id, text=text).write.mode("append").parquet(place)
    return spark.read.schema(LEDGER).parquet(place)


def find_stored(docs: DataFrame, place: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``find``, with a ledger of Parquet files: blobs that it lacks are scanned and appended, then all are joined back.

    ``place`` is a folder that all executors share; it is made if it isn't there. A scan that fails appends nothing. Two
    scans at once may both append a blob; a ledger's repeated rows count once.
    """
    return _paths(docs, _appended(docs, place, id=id, text=text), id=id, text=text)


def _current(ledger: DataFrame) -> DataFrame:
    """(blob, spans) of the present rules, one row a blob however often the ledger holds it.

    Stored, so that adaptive execution may split a hot blob's paths where they are joined to it.
    """
    now = ledger.where(F.col("rule_version") == RULE_VERSION)
    return cut(now.groupBy("blob").agg(F.min("spans").alias("spans")))


def _paths(docs: DataFrame, ledger: DataFrame, *, id: str, text: str) -> DataFrame:
    """(id, blob, spans) for every row of ``docs``."""
    now = _current(ledger).withColumnRenamed("blob", "_blob")
    paths = _with_blob(docs, id, text).select(F.col("_id").alias(id), "blob")
    return paths.join(now, F.col("blob") == F.col("_blob"), "left").drop("_blob")


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts, the base rules' digest and all spans as text, of rows that ``find`` gave."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return found.select(
        id,
        *(count(k).alias(f"n_{RULES[k][0]}") for k in range(BASE)),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def _kept_parts(held: DataFrame) -> DataFrame:
    """(blob, parts, after): for (blob, spans), the places between runs of overlapping spans, and where the last run ends."""
    rows = held.select("blob", F.explode("spans").alias("s"))
    before = Window.partitionBy("blob").orderBy("s.start", "s.kind", "s.end").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.max("s.end").over(before), F.lit(0)))
    part = F.when(F.col("s.start") >= F.col("at"), F.struct(F.col("at"), F.col("s.start").alias("to")))
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("s.end").alias("after"))


def redacted(text: Column, parts: Column, after: Column, mark: str = "[REDACTED]") -> Column:
    """The text's kept parts with a mark between them; linear in its size, as characters are found by number."""

    def cut_out(letters: Column) -> Column:  # a variable of a lambda, so that it is split once
        part = lambda at, n: F.array_join(F.slice(letters, at + 1, n), "")
        kept = F.transform(parts, lambda p: part(p["at"], p["to"] - p["at"]))
        return F.array_join(F.concat(kept, F.array(part(after, F.greatest(F.size(letters) - after, F.lit(0))))), mark)

    return F.element_at(F.transform(F.array(F.split(text, "")), cut_out), 1)


#: Texts with findings that may be broadcast to their rows (32 bytes and a few spans each); more are joined by shuffle.
BROADCAST_BLOBS = 20_000


def redact(docs: DataFrame, *, text: str = "text", id: str = "doc_id", length: str | None = None, ledger: str | None = None) -> DataFrame:
    """``docs`` with the secrets of each text replaced; all rows and columns stay, and ``length`` follows the text.

    ``ledger``: the place of a stored ledger, as for ``find_stored``; only blobs that it lacks are scanned. Null and empty
    texts hold no secret; copies are scanned once; no rows give no rows.
    """
    spans = scan(docs, id=id, text=text) if ledger is None else _current(_appended(docs, ledger, id=id, text=text))
    found = _kept_parts(cut(spans.where(F.size("spans") > 0)))
    held = cut(found.select(F.col("blob").alias("__blob"), F.col("parts").alias("__parts"), F.col("after").alias("__after")))
    few = held.agg(F.count("*").alias("n"), F.max(F.size("__parts")).alias("most")).first()
    if few["n"] <= BROADCAST_BLOBS and (few["most"] or 0) <= 100:
        held = F.broadcast(held)
    blob = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    joined = docs.join(held, blob == F.col("__blob"), "left")
    new = F.when(F.col("__parts").isNotNull(), redacted(F.col(text), F.col("__parts"), F.col("__after"))).otherwise(F.col(text))
    out = joined.withColumn(text, new)
    if length and length in docs.columns:
        out = out.withColumn(length, F.when(F.col("__parts").isNotNull(), F.char_length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.select(*docs.columns)

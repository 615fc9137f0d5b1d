"""A cache of results that outlives a session: Parquet files by bucket of their keys, and a log of touches.

Writers only ever add files, so two of them lose nothing; a key that both have computed is there twice, and counts once.
An eviction writes what stays of the files that it has seen, then removes those files and no others, so entries that come
meanwhile stay too. If it breaks off, entries are there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelane.operators.receipts import evictions
from quirelane.session import cut

KEY = "cache_key"


class CacheStore:
    """Entries (cache_key and the result's columns, with their ``bytes``) below a folder that all executors share.

    ``schema``: the result's columns, as a DDL string. ``buckets``: folders that keys are dealt to by hash; a request reads
    only those that its keys need.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key_type: str = "string", buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.rows = f"{KEY} {key_type}, {schema}, bytes long, made_at timestamp, bucket int"
        self.columns = [f.split()[0] for f in schema.split(", ")]
        self.touched = f"{KEY} {key_type}, at timestamp"
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str, schema: str) -> DataFrame:
        place = f"{self.path}/{name}"
        if self.fs.exists(self.fs_path(place)):
            return self.spark.read.schema(schema).parquet(place)
        return self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(KEY)), F.lit(self.buckets)).cast("int")

    def entries(self) -> DataFrame:
        """One row per key: its newest result, and when it was last touched."""
        rows = self._read("entries", self.rows)
        newest = F.max_by(F.struct("bytes", "made_at", *self.columns), F.col("made_at"))
        touch = self._read("touches", self.touched).groupBy(KEY).agg(F.max("at").alias("last_touch"))
        once = rows.groupBy(KEY, "bucket").agg(newest.alias("e")).select(KEY, "bucket", "e.*")
        return once.join(touch, KEY, "left").withColumn("last_touch", F.greatest("last_touch", "made_at"))

    def put(self, results: DataFrame, now: Column) -> None:
        """Add results (cache_key, their columns, bytes)."""
        rows = results.select(KEY, *self.columns, F.col("bytes").cast("long").alias("bytes"), now.cast("timestamp").alias("made_at"), self._bucket().alias("bucket"))
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/entries")

    def read_through(self, requests: DataFrame, compute: Callable[[DataFrame], DataFrame], now: Column) -> DataFrame:
        """(cache_key, the result's columns, status) of every requested key: ``hit`` from the store, or ``miss`` and computed now.

        Computed results are added, and all keys touched. ``compute`` gets the rows of the requests that missed and gives
        (cache_key, the result's columns, bytes). A key that is requested twice is answered once.
        """
        asked = cut(requests.dropDuplicates([KEY]).withColumn("bucket", self._bucket()))
        held = self._read("entries", self.rows).join(asked.select(KEY, "bucket"), [KEY, "bucket"], "left_semi")
        hits = cut(held.groupBy(KEY).agg(F.max_by(F.struct(*self.columns), F.col("made_at")).alias("e")).select(KEY, "e.*"))
        made = cut(compute(asked.join(hits.select(KEY), KEY, "left_anti").drop("bucket")).select(KEY, *self.columns, "bytes"))
        self.put(made, now)
        asked.select(KEY, now.cast("timestamp").alias("at")).write.mode("append").parquet(f"{self.path}/touches")
        return hits.withColumn("status", F.lit("hit")).unionByName(made.drop("bytes").withColumn("status", F.lit("miss")))

    def evict(self, limit: int, keep: float = 0.8) -> int:
        """If the entries hold over ``limit`` bytes, remove those touched longest ago until ``keep`` of it is left; how many went."""
        gone = cut(evictions(self.entries(), limit, keep, most=2**31 - 1).select(KEY, "bucket"))
        hit = [r[0] for r in gone.select("bucket").distinct().collect()]  # buckets at most
        if not hit:
            return 0
        seen = self._read("entries", self.rows).where(F.col("bucket").isin(hit))
        files = [f for f in seen.inputFiles() if any(f"/bucket={b}/" in f for b in hit)]
        left = self.spark.read.schema(self.rows.rsplit(",", 1)[0]).parquet(*files).withColumn("bucket", self._bucket()).join(gone.select(KEY), KEY, "left_anti")
        cut(left).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/entries")
        for f in files:
            self.fs.delete(self.fs_path(f), False)
        return gone.count()

    def compact_touches(self) -> None:
        """Keep only the last touch of each key; touches that come meanwhile stay."""
        place = f"{self.path}/touches"
        if not self.fs.exists(self.fs_path(place)):
            return
        files = self._read("touches", self.touched).inputFiles()
        if files:
            last = self.spark.read.schema(self.touched).parquet(*files).groupBy(KEY).agg(F.max("at").alias("at"))
            cut(last).write.mode("append").parquet(place)
            for f in files:
                self.fs.delete(self.fs_path(f), False)

"""A cache of query vectors as an append-only log: lookups and stores are events, entries are their aggregate.

The log is a Parquet table (key, model, query, embedding, at, kind, n). A hit
appends an event, so reading moves an entry up; a store of a key that is there
counts, but keeps the first vector. ``prune`` writes what stays as a new log.

Defined results: queries that differ in case, accents or white space share an
entry, other models never do; a null query has no entry; a disabled cache (no
path) finds and keeps nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.text import cache_key
from lexspark.operators.upsert import evict

SCHEMA = "key string, model string, query string, embedding array<float>, at timestamp_ntz, kind string, n long"
# The most entries, days unused, and characters kept of a query.
MOST, DAYS, QUERY_CHARS = 20_000, 60, 500


class QueryCache:
    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path
        if path is not None:
            self._write(spark.createDataFrame([], SCHEMA), "append")

    def _write(self, rows: DataFrame, mode: str, path: str | None = None) -> None:
        if self.path is not None:
            rows.select(*[f.split(" ")[0] for f in SCHEMA.split(", ")]).write.mode(mode).parquet(path or self.path)

    def log(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path) if self.path is not None else self.spark.createDataFrame([], SCHEMA)

    def entries(self) -> DataFrame:
        """(key, model, query, embedding, created_at, last_accessed, access_count), one row a key."""
        stored = F.col("kind") == "put"
        first = F.min_by(F.struct("model", "query", "embedding", "at"), F.when(stored, F.col("at"))).alias("b")
        got = self.log().groupBy("key").agg(first, F.max("at").alias("last_accessed"), F.sum("n").alias("access_count"))
        return got.select("key", "b.model", "b.query", "b.embedding", F.col("b.at").alias("created_at"), "last_accessed", "access_count")

    def put(self, rows: DataFrame, model: str) -> None:
        """Stores (query, embedding, at)."""
        keyed = rows.filter("query is not null").withColumn("key", cache_key(F.lit(model), F.col("query")))
        self._write(keyed.select("key", F.lit(model).alias("model"), F.left("query", F.lit(QUERY_CHARS)).alias("query"), "embedding", "at", F.lit("put").alias("kind"), F.lit(1).cast("long").alias("n")), "append")

    def get(self, queries: DataFrame, model: str) -> DataFrame:
        """(query, embedding, access_count) of the queries (query, at) that are there; each hit counts."""
        keyed = queries.filter("query is not null").withColumn("key", cache_key(F.lit(model), F.col("query")))
        found = keyed.join(self.entries().select("key", "embedding"), "key")
        null = F.lit(None)
        self._write(found.select("key", null.cast("string").alias("model"), null.cast("string").alias("query"), null.cast("array<float>").alias("embedding"), "at", F.lit("hit").alias("kind"), F.lit(1).cast("long").alias("n")), "append")
        if self.path is None:
            return found.select("query", "embedding", F.lit(0).cast("long").alias("access_count"))
        return keyed.join(self.entries().select("key", "embedding", "access_count"), "key").select("query", "embedding", "access_count")

    def prune(self, now: Column, most: int = MOST, days: int = DAYS) -> int:
        """Drops entries unused for ``days`` and, beyond ``most``, those used longest ago; gives how many went.

        The new log is written aside and then takes the place of the old one.
        """
        if self.path is None:
            return 0
        old = self.entries()
        stay = evict(old, "last_accessed", "key", now - F.make_interval(days=F.lit(days)), most)
        base = stay.select("key", "model", "query", "embedding", F.col("created_at").alias("at"), F.lit("put").alias("kind"), F.lit(1).cast("long").alias("n"))
        rest = stay.filter("access_count > 1").select("key", "model", "query", F.lit(None).cast("array<float>").alias("embedding"), F.col("last_accessed").alias("at"), F.lit("hit").alias("kind"), (F.col("access_count") - 1).alias("n"))
        before = old.count()
        aside = f"{self.path}-new"
        self._write(base.unionByName(rest), "overwrite", aside)
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        a, b = jvm.Path(aside), jvm.Path(self.path)
        fs = b.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(b, True)
        fs.rename(a, b)
        self.spark.catalog.refreshByPath(self.path)
        return before - self.entries().count()

    def clear(self) -> None:
        self._write(self.spark.createDataFrame([], SCHEMA), "overwrite")

    def stats(self) -> DataFrame:
        """One row: entries, accesses, oldest, newest."""
        return self.entries().agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("access_count"), F.lit(0)).alias("accesses"), F.min("created_at").alias("oldest"), F.max("last_accessed").alias("newest"))

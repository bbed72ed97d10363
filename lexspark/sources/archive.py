"""The page archive: a keyed store of blobs as a partitioned table, and readers over it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "key string, value string"


class TableStore:
    """Blobs as Parquet partitioned by the first two characters of their key.

    A later put of a key wins by its sequence number; reading a key prunes to
    one partition. Writes are atomic by the commit protocol.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame, seq: int = 0) -> None:
        rows.select("key", "value", F.lit(seq).alias("seq"), F.substring("key", 1, 2).alias("shard")).write.mode("append").partitionBy("shard").parquet(self.path)

    def read(self) -> DataFrame:
        rows = self.spark.read.schema("key string, value string, seq int, shard string").parquet(self.path)
        return rows.groupBy("shard", "key").agg(F.max_by("value", "seq").alias("value"))

    def get(self, key: str) -> DataFrame:
        return self.read().filter((F.col("shard") == key[:2]) & (F.col("key") == key)).select("key", "value")

    def exists(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.read().select("key"), "key", "left_semi")


class NullStore:
    """Keeps nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def put(self, rows: DataFrame, seq: int = 0) -> None:
        pass

    def read(self) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMA)

    def get(self, key: str) -> DataFrame:
        return self.read()

    def exists(self, keys: DataFrame) -> DataFrame:
        return keys.limit(0)


def open_store(spark: SparkSession, kind: str, path: str | None = None) -> TableStore | NullStore:
    """``local`` or any file-system path by ``path``; ``none``, ``null`` and ``off`` keep nothing."""
    if kind in ("none", "null", "off"):
        return NullStore(spark)
    if kind in ("local", "gcs", "path") and path:
        return TableStore(spark, path)
    raise ValueError(f"no such store: {kind}")


def decode(content: Column, content_type: Column, fallback: str = "cp1253") -> Column:
    """Text of bytes: UTF-8 if the content type says so or says JSON, else the given encoding.

    Bytes the encoding lacks become U+FFFD. Decoded in Arrow batches, as the
    JVM's functions refuse code pages and malformed bytes. A null content type
    means the given encoding.
    """

    @F.pandas_udf(T.StringType())
    def run(raw: pd.Series, utf8: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else bytes(x).decode("utf-8" if u else fallback, errors="replace") for x, u in zip(raw, utf8)], dtype=object)

    return run(content, F.coalesce(F.lower(content_type).rlike("utf-8|json"), F.lit(False)))


def json_or_empty(c: Column, schema: str) -> Column:
    """The fields of a JSON text; a struct of nulls if it is malformed or null."""
    return F.coalesce(F.from_json(c, schema, {"mode": "PERMISSIVE"}), F.from_json(F.lit("{}"), schema))

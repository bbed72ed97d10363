"""Dense vectors: cosine, normalisation, exact top-k and a hashing embedder."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a null vector, one of length zero or of another length than the other."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (lengths > 0), dot(a, b) / lengths)


def normalise(a: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def check_dim(df: DataFrame, column: str, dim: int) -> None:
    """Refuses a query vector of another length than the declared one (field metadata ``dim``)."""
    declared = df.schema[column].metadata.get("dim")
    if declared is not None and declared != dim:
        raise ValueError(f"{column} holds vectors of {declared} dimensions (model {df.schema[column].metadata.get('model', 'unknown')}), the query has {dim}")


def nearest(df: DataFrame, key: str, column: str, query: list[float], k: int) -> DataFrame:
    """(key, score): the k rows of the greatest cosine, ties by key. One pass; each task keeps k rows."""
    check_dim(df, column, len(query))
    q = F.array(*[F.lit(float(x)) for x in query])
    s = df.filter(F.col(column).isNotNull()).select(key, cosine(F.col(column), q).alias("score")).filter("score is not null")
    return s.orderBy(F.desc("score"), key).limit(k)


class Embedder(Protocol):
    """Turns texts into vectors; made once per task from a factory."""

    name: str
    dim: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def embed(df: DataFrame, key: str, text: str, factory, batch: int = 100) -> DataFrame:
    """(key, embedding) by a model that ``factory()`` makes once per task, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                p = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(model(p.column(1).to_pylist()), pa.list_(pa.float32()))], ["k", "embedding"]).rename_columns([key, "embedding"])

    src = df.filter(F.col(text).isNotNull()).select(key, text)
    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, embedding array<float>")


def hash_embed(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, slot, value): the sparse form of a hashing embedding at unit length.

    Each lower-case word adds one to the slot its md5 gives (first eight bytes,
    big-endian, modulo ``dim``). Stays in the JVM.
    """
    words = df.filter(F.col(text).isNotNull()).select(key, F.explode(F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), r"(?U)\s+", " ")), " ")).alias("w")).filter("w <> ''")
    slot = F.expr(f"cast(cast(conv(substr(md5(w), 1, 16), 16, 10) as decimal(20,0)) % {int(dim)} as int)")
    counts = words.select(key, slot.alias("slot")).groupBy(key, "slot").agg(F.count(F.lit(1)).alias("n"))
    lengths = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    return counts.join(lengths, key).select(key, "slot", (F.col("n") / F.col("len")).alias("value"))


def dense(sparse: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, embedding) from (key, slot, value)."""
    filled = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
    return filled.select(key, F.expr(f"transform(sequence(0, {int(dim) - 1}), i -> cast(coalesce(m[i], 0d) as float))").alias("embedding"))

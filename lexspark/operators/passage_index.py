"""The retrieval index as one store: passages with vectors, what was indexed, the space of the vectors, and a vector index.

Below ``path``: ``passages`` and ``indexed`` (cd, indexed_hash), both
partitioned by a hash of the key, ``space`` (one row: signature, dim),
``vectors`` (partitioned by cell) and ``cells``. A build takes the decisions
whose text is not the one indexed, replaces their passages partition by
partition, and stamps them last, so a build that dies is simply done again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import chunking, vector
from lexspark.operators.cache import QueryCache
from lexspark.sources.tables import cut

#: Partitions of a store; a build rewrites those that hold a decision it takes.
PARTS = 64
#: Cells of the vector index: about the root of the rows, fitted on so many rows at most.
MOST_CELLS = 4096
_PART = "part_no"


def signature(backend: str, name: str, dim: int) -> str:
    return f"{backend}:{name}:{dim}"


class PassageIndex:
    def __init__(self, spark: SparkSession, path: str, dim: int, model: str = "hash", backend: str = "local"):
        self.spark, self.path, self.dim = spark, path, dim
        self.signature = signature(backend, model, dim)
        self.cache = QueryCache(spark, f"{path}/cache")

    # ---- files

    def _there(self, name: str) -> bool:
        """Whether a table holds anything (its partitions are replaced one by one, each atomically)."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(p) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(p))

    def _drop(self, name: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def passages(self) -> DataFrame:
        """(cd, ordinal, part, char_start, char_end, content, embedding); the dimension is field metadata."""
        schema = f"cd string, ordinal int, part string, char_start int, char_end int, content string, embedding array<float>, {_PART} int"
        rows = self.spark.read.parquet(f"{self.path}/passages") if self._there("passages") else self.spark.createDataFrame([], schema)
        space = self.space()
        meta = {"dim": space["dim"], "model": space["signature"]} if space else {}
        return rows.withColumn("embedding", F.col("embedding").alias("embedding", metadata=meta))

    def indexed(self) -> DataFrame:
        """(cd, indexed_hash)."""
        rows = self.spark.read.parquet(f"{self.path}/indexed") if self._there("indexed") else self.spark.createDataFrame([], f"cd string, indexed_hash string, {_PART} int")
        return rows

    def space(self) -> dict | None:
        return self.spark.read.parquet(f"{self.path}/space").first().asDict() if self._there("space") else None

    # ---- the space of the vectors

    def has_vectors(self) -> bool:
        return self._there("passages") and not self.passages().filter("embedding is not null").isEmpty()

    def _pin(self) -> None:
        self.spark.createDataFrame([(self.signature, self.dim)], "signature string, dim int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/space")

    def claim(self) -> str:
        """Makes this model's space that of the store; refused while vectors of another model are there."""
        held = self.space()
        if held and held["signature"] == self.signature:
            return "kept"
        if held and self.has_vectors():
            raise RuntimeError(f"the index holds vectors of {held['signature']}, not {self.signature}: reset it first")
        self._pin()
        return "replaced" if held else "new"

    def migrate(self) -> str:
        """Sets the dimension; refused while vectors of another one are there. The query cache goes with it."""
        held = self.space()
        if held and held["dim"] == self.dim:
            return "kept"
        if held and self.has_vectors():
            raise RuntimeError(f"the index holds vectors of {held['dim']} dimensions, not {self.dim}: reset it first")
        self.cache.clear()
        self._pin()
        return "changed" if held else "new"

    def check(self, query: list[float]) -> None:
        """Refuses a query vector of another length than the store declares, naming its model."""
        vector.check_dim(self.passages(), "embedding", len(query))

    def reset(self) -> None:
        """Empties the store: passages, vectors, stamps, the cache of queries and the space."""
        for name in ("passages", "indexed", "vectors", "cells", "space"):
            self._drop(name)
        self.cache.clear()

    # ---- building

    def pending(self, decisions: DataFrame) -> DataFrame:
        """The decisions (cd, subject, summary, body) whose indexed fields are not those indexed, with their digest.

        All fields that are indexed count, so an edit of a headnote is taken up, too.
        """
        text = F.to_json(F.struct("subject", "summary", "body"))
        now = decisions.filter("cd is not null and body is not null").select("cd", "subject", "summary", "body", F.sha2(text, 256).alias("now"))
        was = self.indexed().select(F.col("cd").alias("k"), "indexed_hash")
        return now.join(was, F.col("cd") == F.col("k"), "left").filter(~F.col("now").eqNullSafe(F.col("indexed_hash"))).drop("k", "indexed_hash")

    def build(self, decisions: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
        """Brings passages and vectors up to the decisions; gives the numbers of decisions and passages taken up.

        ``embed`` turns (key, content) into (key, embedding); by default the
        hashing embedder. A decision that no longer gives passages loses its old ones.
        """
        self.claim()
        part = F.pmod(F.xxhash64("cd"), F.lit(PARTS)).cast("int").alias(_PART)
        todo = cut(self.pending(decisions))
        n = todo.count()
        if n == 0:
            return {"decisions": 0, "passages": 0}
        made = chunking.chunk_documents(todo).withColumn("key", F.concat_ws(":", "cd", F.col("ordinal")))
        made = cut(made)
        own = embed or (lambda d: vector.dense(vector.hash_embed(d, "key", "content", self.dim), "key", self.dim))
        # text and vector meet by key, never by position
        vectors = own(made.select("key", "content")).select("key", "embedding")
        rows = made.join(vectors, "key", "left").drop("key").withColumn(_PART, F.pmod(F.xxhash64("cd"), F.lit(PARTS)).cast("int"))
        touched = [r[0] for r in todo.select(part).distinct().collect()]  # PARTS rows at most
        keys = todo.select("cd")
        kept = self.passages().filter(F.col(_PART).isin(touched)).join(keys, "cd", "left_anti")
        stamps = self.indexed().filter(F.col(_PART).isin(touched)).join(keys, "cd", "left_anti").unionByName(todo.select("cd", F.col("now").alias("indexed_hash"), part))
        for name, new in (("passages", kept.unionByName(rows)), ("indexed", stamps)):
            # what is overwritten is also read, so it is written aside first
            new = cut(new)
            new.repartition(_PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(f"{self.path}/{name}")
            left = {r[0] for r in new.select(_PART).distinct().collect()}
            for k in set(touched) - left:
                self._drop(f"{name}/{_PART}={k}")
        return {"decisions": n, "passages": made.count()}

    # ---- the vector index

    def build_vector_index(self, vectors: DataFrame | None = None, key: str = "key") -> int:
        """Deals the vectors (key, embedding) into cells by the nearest of some of them; gives the number of cells.

        The cells are a sample of about the root of the rows, at most
        MOST_CELLS; every vector is indexed. Zero and null vectors are left out.
        """
        src = self.passages().select(F.concat_ws(":", "cd", F.col("ordinal")).alias("key"), "embedding") if vectors is None else vectors.select(F.col(key).cast("string").alias("key"), "embedding")
        src = cut(src.filter(F.col("embedding").isNotNull() & (F.size("embedding") == self.dim)).withColumn("embedding", vector.normalise(F.col("embedding")).cast("array<float>")).filter(vector.norm(F.col("embedding")) > 0))
        n = src.count()
        count = max(1, min(MOST_CELLS, int(n**0.5)))
        heads = np.array([r["embedding"] for r in src.orderBy(F.xxhash64("key"), "key").limit(count).collect()], "f4").reshape(-1, self.dim)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, heads.shape[1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x @ heads.T).argmax(axis=1).astype("i4"))], ["key", "embedding", "cell"])

        dealt = src.select("key", "embedding").mapInArrow(deal, "key string, embedding array<float>, cell int") if len(heads) else src.select("key", "embedding", F.lit(0).alias("cell"))
        dealt.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/vectors")
        self.spark.createDataFrame([(i, h.tolist()) for i, h in enumerate(heads)], "cell int, head array<float>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")
        return len(heads)

    def has_vector_index(self) -> bool:
        return self._there("vectors") and self._there("cells")

    def nearest(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """(key, score): the k nearest by cosine in the ``probes`` cells nearest to the query (all: exact); only those cells are read."""
        if self.space():
            if len(query) != self.space()["dim"]:
                self.check(query)
        q = F.array(*[F.lit(float(x)) for x in query])
        cells = self.spark.read.parquet(f"{self.path}/cells").withColumn("s", vector.dot(F.col("head"), q)).orderBy(F.desc("s"), "cell")
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        if probes is not None:
            rows = rows.filter(F.col("cell").isin([r["cell"] for r in cells.limit(probes).collect()]))
        return vector.nearest(rows, "key", "embedding", query, k)

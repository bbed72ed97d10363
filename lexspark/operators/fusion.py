"""Reciprocal rank fusion of ranked lists, and the hybrid search built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators import fulltext, vector
from lexspark.sources.tables import cut

# The constant of reciprocal ranks, the weights of the retrievers, the pool of each.
K = 60
WEIGHTS = {"chunk_lexical": 1.0, "doc_lexical": 0.5, "semantic": 1.0}
POOL = 200


def ranked(hits: DataFrame, doc: str, source: str, tie: str | None = None, pool: int = POOL) -> DataFrame:
    """(source, doc, rank): the first ``pool`` documents of a hit list by score, each once at its best place, ranks dense from 1.

    The limit comes first, so that the one task that ranks sees ``pool`` rows.
    """
    best = hits.groupBy(F.col(doc).alias("doc")).agg(F.max("score").alias("score"), F.min(tie or doc).alias("tie"))
    order = [F.desc("score"), "tie", "doc"]
    best = best.orderBy(*order).limit(pool)
    w = Window.orderBy(*order)
    return best.select(F.lit(source).alias("source"), "doc", F.row_number().over(w).alias("rank"))


def fuse(lists: DataFrame, weights: dict[str, float] | None = None, k: int = K) -> DataFrame:
    """(doc, score, ranks): score is the sum over sources of weight / (k + rank), the best rank counting once a source."""
    weights = WEIGHTS if weights is None else weights
    w: Column = F.lit(1.0)
    for s, x in weights.items():
        w = F.when(F.col("source") == s, float(x)).otherwise(w)
    best = lists.groupBy("source", "doc").agg(F.min("rank").alias("rank"))
    # summed in the order of sources, so that the last digits don't depend on the plan
    return best.groupBy("doc").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("source", (w / (k + F.col("rank"))).alias("part")))), F.lit(0.0), lambda s, x: s + x["part"]).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rank")))).alias("ranks"),
    )


def _seen(order: tuple[str, ...]) -> Column:
    """Where a document first appears: the first source that has it, and its rank there."""
    out = F.struct(F.lit(len(order)).alias("source"), F.lit(0).alias("rank"))
    for i, s in reversed(list(enumerate(order))):
        at = F.col("ranks")[s]
        out = F.when(at.isNotNull(), F.struct(F.lit(i).alias("source"), at.cast("int").alias("rank"))).otherwise(out)
    return out


def top(fused: DataFrame, limit: int, order: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """The best ``limit`` documents; ties as they first appear: by source in ``order``, then by rank in it."""
    return fused.withColumn("seen", _seen(order)).orderBy(F.desc(F.round("score", 12)), "seen", "doc").limit(limit).drop("seen")


def hybrid(
    decisions: DataFrame,
    chunks: DataFrame,
    chunk_index: DataFrame,
    doc_index: DataFrame,
    query: str,
    vec: list[float] | None = None,
    mode: str = "hybrid",
    limit: int = 20,
    pool: int = POOL,
    weights: dict[str, float] | None = None,
    where: Column | None = None,
    per_doc: int = 3,
    expand: bool = True,
    least_hits: int = fulltext.LEAST_HITS,
    meta: DataFrame | None = None,
    highlight: bool = True,
) -> DataFrame:
    """(doc, score, matched_by, passages, *meta) of a search over decisions (cd, …) and chunks (id, cd, part, ordinal, content, embedding).

    The filter once, each retriever over it with its pool, fusion, and texts,
    highlights and metadata (``meta``: cd and what to show) only for the
    winners. If all terms together hit fewer than ``least_hits`` passages and
    the query was expanded, any term will do. Pools are written, so no
    retriever runs twice. ``passages`` are structs (part, ordinal, text), the
    headnote first, then the best; a document that only its whole text brought
    has none. Without a query the newest documents of the filter come, at score 0.
    Rows come in the order of the unrounded score, ties as they first appear.
    """
    if mode not in ("hybrid", "keyword", "semantic"):
        raise ValueError(f"no such mode: {mode}")
    kept = decisions if where is None else decisions.filter(where)
    docs = kept.select("cd")
    own = chunks.select("id", "cd").join(docs, "cd", "left_semi")
    lists, hits = [], []
    tree = fulltext.plan(query, expand)
    kind = "array<struct<part:string,ordinal:int,text:string>>"
    if not query.strip():
        newest = kept.orderBy(F.col("year").desc_nulls_last(), F.col("number").desc_nulls_last(), "cd").limit(limit)
        seen = F.struct(F.coalesce(-F.col("year"), F.lit(1)), F.coalesce(-F.col("number"), F.lit(1)))
        out = newest.select(F.col("cd").alias("doc"), F.lit(0.0).alias("raw"), seen.alias("seen"), F.array().cast("array<string>").alias("matched_by"), F.array().cast(kind).alias("passages"))
        return _shown(out, meta)
    if mode != "semantic" and tree.groups:
        ids = own.select(F.col("id").alias("doc"))

        def run(t):
            p = fulltext.search(chunk_index, ids, t).join(own.withColumnRenamed("id", "doc"), "doc").orderBy(F.desc("score"), "doc").limit(pool)
            d = fulltext.search(doc_index, docs.select(F.col("cd").alias("doc")), t).orderBy(F.desc("score"), "doc").limit(pool)
            return cut(p), cut(d)

        p, d = run(tree)
        if tree.expanded and len(tree.terms) > 1 and p.limit(least_hits).count() < least_hits:
            tree = tree.relaxed()
            p, d = run(tree)
        hits.append(p.select(F.col("doc").alias("id"), "cd", F.col("score").alias("lex"), F.lit(None).cast("double").alias("sem")))
        # a document ranks by its best passage; of equal ones the smaller passage comes first
        lists += [ranked(p.withColumnRenamed("doc", "id"), "cd", "chunk_lexical", "id"), ranked(d, "doc", "doc_lexical")]
    if mode != "keyword" and vec is not None:
        s = vector.nearest(chunks.join(docs, "cd", "left_semi"), "id", "embedding", vec, pool).join(own, "id")
        s = cut(s)
        hits.append(s.select("id", "cd", F.lit(None).cast("double").alias("lex"), F.col("score").alias("sem")))
        lists.append(ranked(s.select("id", "cd", "score"), "cd", "semantic", "id"))
    if not lists:
        empty = docs.limit(0).select(F.col("cd").alias("doc"), F.lit(0.0).alias("raw"), F.lit(0).alias("seen"), F.array().cast("array<string>").alias("matched_by"), F.array().cast(kind).alias("passages"))
        return _shown(empty, meta)
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    best = cut(top(fuse(every, weights), limit).withColumn("seen", _seen(tuple(WEIGHTS))))
    found = hits[0]
    for x in hits[1:]:
        found = found.unionByName(x)
    # at most limit winners and two pools: they are broadcast to the passages
    found = found.join(F.broadcast(best.select(F.col("doc").alias("cd"))), "cd", "left_semi").groupBy("id", "cd").agg(F.max("lex").alias("lex"), F.max("sem").alias("sem"))
    w = Window.partitionBy("cd").orderBy(F.desc("is_head"), F.desc(F.coalesce("lex", F.lit(0.0)) * 10 + F.coalesce("sem", F.lit(0.0))), F.col("lex").isNull(), "id")
    texts = chunks.select("id", "part", "ordinal", (F.col("part") == "summary").alias("is_head"), "content").join(F.broadcast(cut(found)), "id").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_doc)
    texts = texts.withColumn("highlight", fulltext.headline(F.col("content"), tree) if highlight and mode != "semantic" and tree.groups else F.lit(None).cast("string"))
    one = F.struct("n", "part", F.col("ordinal").cast("int").alias("ordinal"), F.coalesce(F.nullif("highlight", F.lit("")), "content").alias("text"))
    passages = texts.groupBy(F.col("cd").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["part"], x["ordinal"], x["text"])).cast(kind).alias("passages"))
    shown = best.join(passages, "doc", "left").select("doc", F.col("score").alias("raw"), "seen", F.array_sort(F.map_keys("ranks")).alias("matched_by"), F.coalesce("passages", F.array().cast(kind)).alias("passages"))
    return _shown(shown, meta)


def _shown(found: DataFrame, meta: DataFrame | None) -> DataFrame:
    """The winners with what is to be shown of them; one without metadata is left out."""
    rest: list[str] = []
    if meta is not None:
        rest = [c for c in meta.columns if c != "cd"]
        found = meta.join(F.broadcast(found), F.col("cd") == F.col("doc"))
    return found.orderBy(F.desc(F.round("raw", 12)), "seen", "doc").select("doc", F.round("raw", 6).alias("score"), "matched_by", "passages", *rest)

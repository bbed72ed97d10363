"""The queries of the problems tagged llm, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import encoding, lookalike, mixture, neardup, terms, tokenizer, truncation, vectors
from lexspark.operators.latest import keep_latest, latest_versions
from lexspark.sources.tables import cut, table


def _garbled(decision: DataFrame, fields: list[str], within: DataFrame | None = None) -> DataFrame:
    """(cd, field, last_fetched, score, fixes) of current texts that hold damage; words are counted over bodies and headnotes, whichever fields are asked for."""
    spans = encoding.damaged_spans(decision, "cd", "last_fetched", ["body", "summary"], fields, within).withColumnsRenamed({"key": "cd", "version": "last_fetched"})
    return keep_latest(spans, latest_versions(decision, "cd", "last_fetched"), "cd", "last_fetched").dropDuplicates(["cd", "field"])


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, root, "chunk")).select("id_a", "id_b")


def p1_knn(spark: SparkSession, root: str) -> DataFrame:
    """The ten nearest of every chunk, however far."""
    return vectors.knn(table(spark, root, "chunk"))


def p1_nearest(spark: SparkSession, root: str) -> DataFrame:
    chunk = table(spark, root, "chunk")
    return vectors.nearest(chunk, chunk.filter("id % 100 = 0"))


def _term_counts(spark: SparkSession, root: str, n: int = 1) -> DataFrame:
    out = None
    for field, name, key, version, text in (("chunk.content", "chunk", "id", None, "content"), ("decision.body", "decision", "cd", "last_fetched", "body")):
        counts = terms.record_counts(table(spark, root, name), key, version, text, n)
        one = terms.marked(counts).select(F.lit(field).alias("field"), "n", "term", "tf", "df", "mark")
        out = one if out is None else out.unionByName(one)
    return out


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _term_counts(spark, root).filter(F.col("mark").isNotNull()).select("field", "term", "mark")


def p2_counts(spark: SparkSession, root: str) -> DataFrame:
    return _term_counts(spark, root).drop("n")


def p2_phrases(spark: SparkSession, root: str) -> DataFrame:
    """The phrases of two and three terms that are neither rare nor common."""
    return _term_counts(spark, root, 3).filter((F.col("n") > 1) & F.col("mark").isNull()).select("field", "n", F.col("term").alias("phrase"), "tf", "df")


def _spelled(spark: SparkSession, root: str) -> DataFrame:
    """(field, key, version, text) of all bodies, of former versions too, and all theme labels."""
    body = table(spark, root, "decision").select(F.lit("decision.body").alias("field"), F.col("cd").alias("key"), F.col("last_fetched").alias("version"), F.col("body").alias("text"))
    label = table(spark, root, "theme").select(F.lit("theme.label").alias("field"), F.col("code").cast("string").alias("key"), F.lit(None).cast("timestamp_ntz").alias("version"), F.col("label").alias("text"))
    return body.unionByName(label)


def _now(found: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """The rows of labels, and those of bodies that are of current versions."""
    versions = latest_versions(table(spark, root, "decision"), "cd", "last_fetched").withColumnsRenamed({"cd": "key", "last_fetched": "version"})
    return found.filter("field <> 'decision.body'").unionByName(keep_latest(found.filter("field = 'decision.body'"), versions, "key", "version"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    odd = cut(_now(lookalike.irregular(_spelled(spark, root)), spark, root))
    # only irregular bodies are asked for damage
    bodies = odd.filter("field = 'decision.body'").select("key", "version")
    garbled = _garbled(table(spark, root, "decision"), ["body"], bodies).select(F.lit("decision.body").alias("field"), F.col("cd").alias("key"))
    return odd.join(garbled, ["field", "key"], "left_anti").select("field", F.col("key").alias("record_key")).distinct()


def p3_forms(spark: SparkSession, root: str) -> DataFrame:
    return _now(lookalike.normalised(_spelled(spark, root)), spark, root).select("field", F.col("key").alias("record_key"), "text").dropDuplicates(["field", "record_key"])


def _texts(spark: SparkSession, root: str, bad: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages, headnotes (of former versions too), and the members of both that count: current ones that are not garbled."""
    decision = table(spark, root, "decision")
    summary = neardup.records(decision, "cd", "summary", "decision.summary", "last_fetched")
    chunks = neardup.records(table(spark, root, "chunk"), "id", "content", "chunk.content")
    now = keep_latest(neardup.members(summary, width), latest_versions(decision, "cd", "last_fetched").withColumnsRenamed({"cd": "key", "last_fetched": "version"}), "key", "version")
    return chunks, summary, cut(neardup.members(chunks, width).unionByName(now.join(bad, "key", "left_anti")))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    bad = _garbled(table(spark, root, "decision"), ["summary"]).select(F.col("cd").alias("key"))
    chunks, summary, members = _texts(spark, root, bad, 3)
    return neardup.key_pairs(chunks.unionByName(summary), members, width=3, threshold=0.6).select("field", "key_a", "key_b")


def p6_groups(spark: SparkSession, root: str) -> DataFrame:
    """The groups of passages and headnotes by the library's own measure (five words, 0.8), one row a record."""
    decision = table(spark, root, "decision")
    bad = _garbled(decision, ["summary"]).select(F.col("cd").alias("key"))
    chunks, summary, members = _texts(spark, root, bad, neardup.WIDTH)
    return neardup.groups(chunks.unionByName(summary), members)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _garbled(table(spark, root, "decision"), ["body", "summary"]).select("cd", "field")


def p7_restored(spark: SparkSession, root: str) -> DataFrame:
    decision = table(spark, root, "decision")
    spans = _garbled(decision, ["body", "summary"]).withColumnsRenamed({"cd": "key", "last_fetched": "version"})
    return encoding.restored(decision, cut(spans), "cd", "last_fetched").withColumnRenamed("key", "cd")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenizer.encode(table(spark, root, "documents"))


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixture.mix(table(spark, root, "documents"), table(spark, root, "mix_target"))[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixture.mix(table(spark, root, "documents"), table(spark, root, "mix_target"))[1]


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncated(table(spark, root, "documents")).filter("cut").select("doc_id")


def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    return truncation.rates(truncation.truncated(table(spark, root, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p1_knn, p1_nearest, p2_found, p2_counts, p2_phrases, p3_found, p3_forms, p6_found, p6_groups, p7_found, p7_restored, p8_ids, p9_mix, p9_shares, p10_found, p10_rates)}

_CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cd ORDER BY last_fetched DESC NULLS LAST) AS r FROM decision WHERE cd IS NOT NULL) WHERE r = 1)"
_TERMS = rf"""
    WITH rec AS (SELECT DISTINCT 'chunk.content' AS field, id::VARCHAR AS k, content AS t FROM chunk WHERE content IS NOT NULL AND id IS NOT NULL
                 UNION ALL SELECT 'decision.body', cd, body FROM {_CURRENT} WHERE body IS NOT NULL),
    n AS (SELECT field, count(*) AS n FROM rec GROUP BY field),
    w AS (SELECT field, k, unnest(regexp_extract_all(t, '\p{{L}}+')) AS term FROM rec),
    c AS (SELECT field, term, count(*) AS tf, count(DISTINCT k) AS df FROM w GROUP BY field, term),
    m AS (SELECT c.field, term, tf, df, CASE WHEN df < 3 THEN 'rare' WHEN 10 * df > 3 * n THEN 'common' END AS mark FROM c JOIN n ON c.field = n.field)"""

_PHRASES = rf"""
    WITH rec AS (SELECT DISTINCT 'chunk.content' AS field, id::VARCHAR AS k, content AS t FROM chunk WHERE content IS NOT NULL AND id IS NOT NULL
                 UNION ALL SELECT 'decision.body', cd, body FROM {_CURRENT} WHERE body IS NOT NULL),
    s AS (SELECT field, count(*) AS records FROM rec GROUP BY field),
    w AS (SELECT field, k, regexp_extract_all(t, '\p{{L}}+') AS t FROM rec),
    g AS (SELECT field, k, 2 AS n, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS phrase FROM w
          UNION ALL SELECT field, k, 3, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM w),
    c AS (SELECT field, n, phrase, count(*) AS tf, count(DISTINCT k) AS df FROM g GROUP BY field, n, phrase)
    SELECT c.field, n::INT AS n, phrase, tf, df FROM c JOIN s ON s.field = c.field WHERE df >= 3 AND 10 * df <= 3 * records"""

SQL: dict[str, str] = {
    "p2_phrases": _PHRASES,
    "p2_found": _TERMS + " SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_counts": _TERMS + " SELECT field, term, tf, df, mark FROM m",
}

"""Queries of the general data problems (4 and 5) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import incremental, multivalue
from lexspark.operators.latest import latest_rows
from lexspark.sources.tables import cut, run_dir, table


def _subjects(spark: SparkSession, root: str) -> DataFrame:
    return latest_rows(table(spark, root, "decision"), "cd", "last_fetched", ["cd", "subject", "source_url"])


def _host(column: str = "source_url"):
    return F.regexp_extract(F.col(column), r"^[a-z]+://([^/]+)", 1)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return multivalue.split_values(_subjects(spark, root), "cd", "subject", _host()).filter("n_values >= 2").select("cd", "pos", "val")


def p4_marks(spark: SparkSession, root: str) -> DataFrame:
    return multivalue.score_marks(_subjects(spark, root), "subject", _host())


def _deliveries(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "decision").select(
        "cd",
        "last_fetched",
        F.col("body").isNotNull().alias("has_body"),
        F.when(F.col("body").isNotNull(), F.coalesce(incremental.digest_of("content_hash"), F.sha2(F.col("body"), 256))).alias("now"),
        incremental.digest_of("indexed_hash").alias("indexed"),
    )


_COLUMNS = ["cd", "last_fetched", "has_body", "now", "indexed"]


def _pending(rows: DataFrame) -> DataFrame:
    return latest_rows(rows, "cd", "last_fetched", _COLUMNS).filter(F.col("has_body") & ~F.col("now").eqNullSafe(F.col("indexed"))).select("cd")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    out, _ = incremental.refresh(_deliveries(spark, root), "cd", _COLUMNS, _pending, run_dir(spark, "pending"))
    return out


#: Deliveries after this day arrive between the two runs of p5_runs.
LATE = "2025-11-28"


def p5_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run, partitions, recomputed, pending) of three runs: the deliveries until LATE, then all of them, then nothing new."""
    path = run_dir(spark, "runs")
    every = cut(_deliveries(spark, root))
    early = every.filter(F.col("last_fetched") <= F.expr(f"TIMESTAMP_NTZ '{LATE}'"))
    rows = []
    for run, df in enumerate((early, every, every), 1):
        out, changed = incremental.refresh(df, "cd", _COLUMNS, _pending, path)
        parts = spark.read.parquet(f"{path}/state/gen={len(incremental._generations(spark, path + '/state')) - 1}").agg(F.max("parts")).first()[0]
        rows.append((run, parts, len(changed), out.count()))
    return spark.createDataFrame(rows, "run int, partitions int, recomputed int, pending long")


QUERIES = {f.__name__: f for f in (p4_found, p4_marks, p5_found, p5_runs)}

def _pending_sql(source: str) -> str:
    return f"""
        SELECT cd FROM (
            SELECT cd, coalesce(nullif(regexp_extract(lower(content_hash), '(?:^|[^0-9a-f])([0-9a-f]{{64}})\\s*$', 1), ''), sha256(body)) AS now,
                   nullif(regexp_extract(lower(indexed_hash), '(?:^|[^0-9a-f])([0-9a-f]{{64}})\\s*$', 1), '') AS was
            FROM (SELECT *, row_number() OVER (PARTITION BY cd ORDER BY last_fetched DESC NULLS LAST) AS r FROM {source} WHERE cd IS NOT NULL) WHERE r = 1 AND body IS NOT NULL)
        WHERE now IS DISTINCT FROM was"""


SQL = {
    "p5_found": _pending_sql("decision"),
    "p5_runs": f"""
        WITH early AS (SELECT * FROM decision WHERE last_fetched <= TIMESTAMP '{LATE}'),
        s AS (SELECT greatest({incremental.LEAST_PARTS}, ceil(2 * sqrt(count(*))))::INT AS parts FROM early WHERE cd IS NOT NULL),
        p AS (SELECT ('0x' || substr(md5(cd), 1, 8))::UBIGINT % parts AS part, coalesce(last_fetched <= TIMESTAMP '{LATE}', false) AS old FROM decision, s WHERE cd IS NOT NULL)
        SELECT 1 AS run, parts AS partitions, (SELECT count(DISTINCT part) FROM p WHERE old)::INT AS recomputed, (SELECT count(*) FROM ({_pending_sql('early')})) AS pending FROM s
        UNION ALL SELECT 2, parts, (SELECT count(DISTINCT part) FROM p WHERE NOT old)::INT, (SELECT count(*) FROM ({_pending_sql('decision')})) FROM s
        UNION ALL SELECT 3, parts, 0, (SELECT count(*) FROM ({_pending_sql('decision')})) FROM s""",
}

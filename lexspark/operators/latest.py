"""The current row of a key, without moving wide columns where that can be avoided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """One row of every ``key``: that with the greatest ``version`` (null is least).

    Rows equal in key and version are taken to be exact repeats; one stays.
    A null key has no current row. The rank limit runs before the shuffle too
    (WindowGroupLimit), so a key with a third of all rows sends one row a task.
    """
    w = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last())
    need = list(dict.fromkeys([key, *columns]))
    return (
        df.filter(F.col(key).isNotNull())
        .select(*dict.fromkeys([*need, version]))
        .withColumn("_rank", F.row_number().over(w))
        .filter("_rank = 1")
        .select(*need)
    )


def latest_versions(df: DataFrame, key: str, version: str) -> DataFrame:
    """(key, version) of the current rows: a narrow table to filter by after the work.

    An operator that looks at rows one by one runs over all deliveries and
    keeps the current ones by this table, so that no text is shuffled.
    """
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(version).alias(version))


def keep_latest(found: DataFrame, versions: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of ``found`` that belong to current rows; null versions match."""
    v = versions.select(F.col(key).alias("_k"), F.col(version).alias("_v"))
    same: Column = (F.col(key) == F.col("_k")) & F.col(version).eqNullSafe(F.col("_v"))
    return found.join(v, same, "left_semi")

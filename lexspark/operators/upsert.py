"""Changes of keyed tables as plans: each takes the old table and gives the new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; columns in ``keep`` retain their old values; others are added."""
    cols = old.columns
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("had"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("has"))
    on: Column = F.lit(True)
    for k in keys:
        on = on & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    both = o.join(n, on, "full")
    pick = lambda c: F.when(F.col("has").isNull() | (F.col("had").isNotNull() & F.lit(c in keep)), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))
    return both.select(*[pick(c).alias(c) for c in cols])


def upsert_changed(old: DataFrame, new: DataFrame, key: str, digest: str, now: Column) -> DataFrame:
    """(key, digest, first_seen, last_fetched, last_changed, outcome) after an upsert with change detection.

    ``outcome`` is new, changed, unchanged (by the digest before the upsert), or
    absent for rows that the delivery does not hold.
    """
    o = old.select(F.col(key).alias("ok"), F.col(digest).alias("od"), "first_seen", "last_fetched", "last_changed")
    n = new.select(F.col(key).alias("nk"), F.col(digest).alias("nd"))
    both = o.join(n, F.col("ok") == F.col("nk"), "full")
    same = F.col("od").eqNullSafe(F.col("nd"))
    outcome = F.when(F.col("nk").isNull(), "absent").when(F.col("ok").isNull(), "new").when(same, "unchanged").otherwise("changed")
    there = F.col("nk").isNotNull()
    return both.withColumn("outcome", outcome).select(
        F.coalesce("ok", "nk").alias(key),
        F.when(there, F.col("nd")).otherwise(F.col("od")).alias(digest),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(there, now).otherwise(F.col("last_fetched")).alias("last_fetched"),
        F.when(F.col("outcome").isin("new", "changed"), now).otherwise(F.col("last_changed")).alias("last_changed"),
        "outcome",
    )


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it lacks, one row per new key."""
    fresh = new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return old.unionByName(fresh)


def delete_keys(old: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return old.join(keys.select(*on), on, "left_anti")


def latest_entry(log: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last entry of every key of an append-only log (ties: the greatest row)."""
    rest = [c for c in log.columns if c not in keys]
    best = F.max(F.struct(version, *[c for c in rest if c != version])).alias("b")
    return log.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def failures(log: DataFrame, key: str, at: str, error: str, most: int = 5, chars: int = 2000) -> DataFrame:
    """(key, attempts, last_error, retry): failures of a queue from its event log; beyond ``most`` there is no retry."""
    g = log.groupBy(key).agg(F.count(error).cast("int").alias("attempts"), F.max_by(F.left(F.col(error), F.lit(chars)), at).alias("last_error"))
    return g.withColumn("retry", F.col("attempts") < most)


def evict(entries: DataFrame, last: str, key: str, oldest: Column, most: int) -> DataFrame:
    """Cache entries that stay: used since ``oldest``, and of those the ``most`` used last (ties by key).

    The cap is found by counting from the top: the rank limit runs in every
    task before the single one that merges at most ``most`` rows each.
    """
    w = Window.orderBy(F.desc(last), key)
    return entries.filter(F.col(last) >= oldest).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def start_runs(log: DataFrame, runs: DataFrame, id_: str, order: str) -> DataFrame:
    """The rows of ``runs`` (a handful) with the next numbers after those of the log, in the order of a column."""
    last = log.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_last"))
    numbered = runs.withColumn("_n", F.row_number().over(Window.orderBy(order)))
    return numbered.crossJoin(F.broadcast(last)).withColumn(id_, (F.col("_last") + F.col("_n")).cast("long")).drop("_last", "_n")  # a single row


def finish_runs(log: DataFrame, ends: DataFrame, id_: str) -> DataFrame:
    """The log with what ``ends`` says of some runs."""
    said = [c for c in ends.columns if c != id_]
    e = ends.select(F.col(id_).alias("_id"), *[F.col(c).alias(f"_{c}") for c in said])
    both = log.join(e, F.col(id_) == F.col("_id"), "left")
    return both.select(*[F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in said else F.col(c) for c in log.columns])

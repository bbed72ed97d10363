"""The frontier of a crawl: partitions that are split where their listing is cut off, a ledger, and a queue that is drained in batches.

A listing shows ``cap`` rows at most. A year is asked for as a whole; where
that is cut off, by category; where that is, by chamber; and then by halves of
the range of numbers. What a partition would show is counted, so the whole
ladder is a few aggregations over one narrow table, a level at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.sources.tables import cut

# The cap of a listing, the marks for no filter, the range of numbers and how often it is halved.
CAP = 3000
ALL_CATEGORIES, ALL_CHAMBERS = 6, 1
NUMBERS = (1, 20_000)
HALVINGS = 7
# Comparisons of the search form.
EQUAL, AT_LEAST, AT_MOST = 1, 2, 3
BATCH, MOST_ATTEMPTS, LEAST_BODY = 200, 5, 200


def ladder(rows: DataFrame, cap: int = CAP, halvings: int = HALVINGS) -> DataFrame:
    """(year, category_id, chamber_id, lo, hi, n_found, truncated): every partition asked for, from (year, category_id, chamber_id, number).

    Rows without a year are not listed; rows without a category, chamber or
    number show in the partitions that do not ask for it. ``truncated`` means
    that the partition shows ``cap`` rows of more.
    """
    base = rows.filter("year is not null").groupBy("year", "category_id", "chamber_id", "number").agg(F.count(F.lit(1)).alias("n"))
    lo, hi = F.lit(NUMBERS[0]), F.lit(NUMBERS[1])
    fill = {"category_id": F.lit(ALL_CATEGORIES), "chamber_id": F.lit(ALL_CHAMBERS), "lo": lo, "hi": hi}
    levels = [["year"], ["year", "category_id"], ["year", "category_id", "chamber_id"], *[["year", "category_id", "chamber_id", "lo", "hi"]] * halvings]
    # what is left to split, written level by level, so that no level is planned twice
    inside = cut(base.withColumns({"lo": lo, "hi": hi}))
    every = None
    for k, keys in enumerate(levels):
        counted = cut(inside.groupBy(*keys).agg(F.sum("n").alias("n")))
        shown = counted.select(*[(F.col(c) if c in keys else fill[c]).cast("int").alias(c) for c in ("year", "category_id", "chamber_id", "lo", "hi")], F.least("n", F.lit(cap)).cast("long").alias("n_found"), (F.col("n") > cap).alias("truncated"))
        every = shown if every is None else every.unionByName(shown)
        large = counted.filter(F.col("n") > cap)
        if k + 1 == len(levels) or large.isEmpty():
            break
        inside = inside.join(large.select(*keys), keys, "left_semi").dropna(subset=[c for c in levels[k + 1] if c not in ("lo", "hi")])
        if k >= 2:
            mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
            left = F.col("number") <= mid
            inside = inside.filter(F.col("number").between(F.col("lo"), F.col("hi"))).withColumns({"lo": F.when(left, F.col("lo")).otherwise(mid + 1), "hi": F.when(left, mid).otherwise(F.col("hi"))})
        inside = cut(inside)
    return every


def ledger(asked: DataFrame) -> DataFrame:
    """(year, category_id, chamber_id, status, n_found): one row a partition; halves of one chamber are one row, truncated if any is."""
    return asked.groupBy("year", "category_id", "chamber_id").agg(F.when(F.bool_or("truncated"), "truncated").otherwise("done").alias("status"), F.max("n_found").alias("n_found"))


def done_years(ledger: DataFrame) -> DataFrame:
    """(year) whose root partition is done."""
    return ledger.filter((F.col("category_id") == ALL_CATEGORIES) & (F.col("chamber_id") == ALL_CHAMBERS) & (F.col("status") == "done")).select("year").distinct()


def years_to_do(spark, first: int, last: int, ledger: DataFrame) -> DataFrame:
    """(year) of the range that are not done."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year")).join(done_years(ledger), "year", "left_anti")


def describe(year: Column, category: Column, chamber: Column, op: Column, number: Column) -> Column:
    """A partition in words: ``2015/ΠΟΙΝΙΚΕΣ/ΟΛΕΣ/num<=500``; null labels mean all."""
    sign = F.when(op == AT_MOST, "<=").when(op == AT_LEAST, ">=").otherwise("=")
    base = F.concat_ws("/", year.cast("string"), F.coalesce(category, F.lit("ΟΛΕΣ")), F.coalesce(chamber, F.lit("ΟΛΕΣ")))
    return F.when(number.isNull(), base).otherwise(F.concat(base, F.lit("/num"), sign, number.cast("string")))


def form(year: Column, category_id: Column, chamber_id: Column, op: Column, number: Column) -> list[tuple[str, Column]]:
    """The fields of the search form for a partition."""
    text = lambda c: c.cast("string")
    # The names of the fields.
    return [
        ("X_TMHMA", text(F.coalesce(category_id, F.lit(ALL_CATEGORIES)))),
        ("X_SUB_TMHMA", text(F.coalesce(chamber_id, F.lit(ALL_CHAMBERS)))),
        ("X_TELESTIS_number", text(F.coalesce(op, F.lit(EQUAL)))),
        ("x_number", F.coalesce(text(number), F.lit(""))),
        ("X_TELESTIS_ETOS", F.lit(str(EQUAL))),
        ("x_ETOS", text(year)),
    ]


def drain(queue: DataFrame, pages: DataFrame, stored: DataFrame, batch: int = BATCH, most: int = MOST_ATTEMPTS) -> DataFrame:
    """(cd, attempts, outcome) of one batch of the queue (cd, number, year, attempts).

    Newest first, those that failed ``most`` times left out. ``pages`` (cd,
    body) are what was fetched, ``stored`` (cd, digest) what is held: a page
    that is missing or too short is an error and counts as an attempt, the
    others are new, changed or unchanged.
    """
    order = [F.col("year").desc_nulls_last(), F.col("number").desc_nulls_last(), "cd"]
    taken = queue.filter((F.col("attempts") < most) & F.col("cd").isNotNull()).orderBy(*order).limit(batch).select("cd", "attempts")
    got = taken.join(pages.select("cd", F.when(F.length("body") > LEAST_BODY, F.sha2("body", 256)).alias("now")), "cd", "left").join(stored.select("cd", F.col("digest").alias("held"), F.lit(True).alias("there")), "cd", "left")
    outcome = F.when(F.col("now").isNull(), "error").when(F.col("there").isNull(), "new").when(F.col("now").eqNullSafe(F.col("held")), "unchanged").otherwise("changed")
    return got.select("cd", (F.col("attempts") + F.when(F.col("now").isNull(), 1).otherwise(0)).alias("attempts"), outcome.alias("outcome"))


def after(queue: DataFrame, drained: DataFrame) -> DataFrame:
    """The queue without what was stored, with the attempts of what failed."""
    d = drained.select(F.col("cd").alias("k"), F.col("attempts").alias("tried"), "outcome")
    left = queue.join(d, F.col("cd") == F.col("k"), "left").filter(F.col("outcome").isNull() | (F.col("outcome") == "error"))
    return left.select(*[F.coalesce("tried", "attempts").alias("attempts") if c == "attempts" else F.col(c) for c in queue.columns])

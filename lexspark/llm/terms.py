"""Problem 2: frequency of every distinct term, and of every n-gram, with record counts.

Suffix arrays with common-prefix intervals. A block is a run of whole records.
Its terms are numbered, all suffixes that begin at a term and stay within
their record are sorted by their first ``n`` terms, and equal neighbours form
the intervals of a common prefix: the size of an interval is the number of
occurrences of its n-gram. Within an interval suffixes stand in the order of
their records, so its number of records is its size less the number of
adjacent suffixes that stem from the same record (the within-record duplicate
adjacencies). Records never cross blocks, so both counts add up over blocks,
and what is shuffled are the counts of distinct n-grams per block.

Defined results: a null text is no record; an empty text is a record without
terms; repeats of a record key count once (exact repeats; the caller chooses
the current row otherwise); terms are compared as written; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import bloom, flat, in_bloom, rows_of, slices, strings
from lexspark.operators.latest import latest_rows
from lexspark.sources.tables import cut

#: A term is a maximal run of letters: what lies between is dropped.
NOT_LETTERS = r"[^\pL]+"
BLOCK_BYTES = 24 << 20


def intervals(codes: np.ndarray, record: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length 1..n: (first suffix, occurrences, records) of every interval.

    ``codes`` are the numbered terms in the order of the text, ``record`` the
    record of each. The suffix array is refined term by term: suffixes that
    agree in their first k terms are sorted by the next one; those that end
    with their record leave the longer intervals.
    """
    out = []
    size = len(codes)
    array = np.lexsort((record, codes)) if size else np.zeros(0, "i8")
    group = codes[array]  # number of the common prefix of every suffix, ascending
    for k in range(1, n + 1):
        if not len(array):
            break
        new = np.empty(len(array), bool)
        new[0] = True
        np.not_equal(group[1:], group[:-1], out=new[1:])
        starts = np.flatnonzero(new)
        count = np.diff(np.append(starts, len(array)))
        rec = record[array]
        same = np.zeros(len(array), "i8")
        same[1:] = (rec[1:] == rec[:-1]) & ~new[1:]  # duplicate adjacencies
        out.append((array[starts], count, count - np.add.reduceat(same, starts)))
        if k == n:
            break
        nxt = array + k
        inside = (nxt < size) & (record[np.minimum(nxt, size - 1)] == rec)
        prefix = (np.cumsum(new) - 1)[inside]
        array, follow = array[inside], codes[nxt[inside]]
        order = np.lexsort((record[array], follow, prefix))
        array, follow, prefix = array[order], follow[order], prefix[order]
        change = np.ones(len(array), bool)
        change[1:] = (follow[1:] != follow[:-1]) | (prefix[1:] != prefix[:-1])
        group = np.cumsum(change)
    return out


def _count(n: int, but=None):
    """Counts of a block; with ``but`` (a Bloom filter over the column h) rows in it are left to others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BLOCK_BYTES // 4):
            if but is not None:
                part = part.filter(pa.array(~in_bloom(but.value, part.column("h").to_numpy().view("u8"))))
            words, offsets = flat(pc.split_pattern_regex(strings(part.column("text")), NOT_LETTERS))
            filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
            record = rows_of(offsets)[filled].astype("i4")
            coded = words.filter(pa.array(filled)).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype("i4")
            rows = [part.num_rows]  # the number of records, as the only gram of no terms
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([""]), pa.array(rows, pa.int64()), pa.array(rows, pa.int64())], ["n", "term", "tf", "df"])
            for k, (first, tf, df) in enumerate(intervals(codes, record, n), 1):
                grams = coded.dictionary.take(pa.array(codes[first]))
                for j in range(1, k):
                    grams = pc.binary_join_element_wise(grams, coded.dictionary.take(pa.array(codes[first + j])), " ")
                size = pa.array(np.full(len(first), k, "i4"))
                yield pa.RecordBatch.from_arrays([size, strings(grams), pa.array(tf.astype("i8")), pa.array(df.astype("i8"))], ["n", "term", "tf", "df"])

    return run


def ngram_counts(df: DataFrame, text: str, n: int = 1) -> DataFrame:
    """(n, term, tf, df): occurrences and records of every n-gram of 1..n terms (joined by a blank).

    The row with n = 0 and an empty term counts the records themselves.
    """
    src = df.filter(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    return src.mapInArrow(_count(n), "n int, term string, tf long, df long").groupBy("n", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _only(rows):
    """The rows whose h may be in a Bloom filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bloom(rows.value, b.column("h").to_numpy().view("u8"))))

    return run


def record_counts(df: DataFrame, key: str, version: str | None, text: str, n: int = 1) -> DataFrame:
    """``ngram_counts`` of the current row of every key (the greatest ``version``; without one, rows of a key are exact repeats).

    Only the texts of keys with several rows are shuffled to find their
    current row; all others are counted where they are. Which those keys are is
    told by a Bloom filter (a key passed wrongly is shuffled in vain); if they
    are more than the largest filter holds, all texts are shuffled.
    """
    v = F.lit(0) if version is None else F.col(version)
    own = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), v.alias("version"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    several = own.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bits = bloom(several, F.col("h"))
    if bits is None:
        return ngram_counts(latest_rows(own, "key", "version", ["text"]), "text", n)
    rows = df.sparkSession.sparkContext.broadcast(bits)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    moved = latest_rows(own.mapInArrow(_only(rows), fields), "key", "version", ["text"])
    kind = "n int, term string, tf long, df long"
    stay = own.filter("text is not null").select("text", "h").mapInArrow(_count(n, rows), kind)
    every = stay.unionByName(moved.filter("text is not null").select("text").mapInArrow(_count(n), kind))
    return every.groupBy("n", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def marked(counts: DataFrame, rare_below: int = 3, common_share: tuple[int, int] = (3, 10)) -> DataFrame:
    """``counts`` with ``mark``: rare (fewer records than ``rare_below``), common (more than the share), else null.

    The comparison is in whole numbers. The counts, far fewer than the
    occurrences, are written once, so that no text is split again for the
    number of records.
    """
    num, den = common_share
    counts = cut(counts)
    records = counts.filter("n = 0").agg(F.sum("df").alias("n_records")).withColumn("_one", F.lit(1))  # a single row
    mark = F.when(F.col("df") < rare_below, "rare").when(F.col("df") * den > F.col("n_records") * num, "common")
    terms = counts.filter("n > 0").withColumn("_one", F.lit(1))
    return terms.join(F.broadcast(records), "_one").withColumn("mark", mark).drop("_one", "n_records")

"""Problem 9: mixing sources to target weights.

Sizes are tokens. The size of the mix is the largest at which every source
that has documents can still have its share of it under its cap on repeats
(or a size the caller gives; then sources at their cap leave the rest to the
others in proportion to their weights). The order of the mix is a Pfair
schedule: each source's share is cut into pieces, a piece that begins and ends
at s and e tokens of a source of weight w is released at s / w and due at
e / w, and the released piece of the earliest deadline goes next. Pieces begin
and end between documents, and their true sizes are scheduled. A piece is
smaller than half a block by the largest document, so that at every document
of the mix each source is within one block of its share of what has gone.

The most blocks are a parameter, not a function of the data (fewer where a
block would not hold four of the largest documents, at least one); the
schedule is computed on the driver for their pieces, of which there are at
most four to a block. Documents get their place in their source by two-level
prefix sums (bucket sums, then within buckets), so no task holds a whole
source.

Defined results: null, empty and blank texts count by their tokens (none for
null and empty) and texts without tokens are not used; documents of a null or
unlisted source are not used; a listed source without documents, with a share
that is null or not positive, or with a cap below one gets nothing and the
shares of the others are scaled up; repeated texts are documents of their own;
an empty table gives an empty mix and a report of zeros.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.tokenizer import DEFAULT_RANKS, count_tokens
from lexspark.sources.tables import cut

BLOCKS = 8192
#: Documents in a bucket of the prefix sums, on average.
BUCKET_DOCS = 20_000


def pfair(weights: dict[str, float], blocks: int) -> list[tuple[str, int]]:
    """(source, j) in the order of the schedule; about ``blocks`` of them; every weight is a share of 1."""
    exact = {s: Fraction(w).limit_denominator(10**9) for s, w in weights.items() if w > 0}
    total = sum(exact.values())
    exact = {s: w / total for s, w in exact.items()}
    waiting = [(Fraction(0), s, 1) for s in sorted(exact)]
    heapq.heapify(waiting)
    ready: list[tuple[Fraction, str, int]] = []
    out: list[tuple[str, int]] = []
    slot = 0
    while len(out) < blocks and (waiting or ready):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (j / exact[s], s, j))
        if not ready:
            slot = -(-waiting[0][0].numerator // waiting[0][0].denominator)
            continue
        _, s, j = heapq.heappop(ready)
        out.append((s, j))
        heapq.heappush(waiting, (Fraction(j) / exact[s], s, j + 1))
        slot += 1
    return out


def schedule(sizes: dict[str, list[int]]) -> list[tuple[str, int, int]]:
    """(source, j, begin) in the order of the schedule: pieces of given sizes; begin counts the tokens before a piece."""
    own = {s: sum(x) for s, x in sizes.items() if sum(x) > 0}
    total = sum(own.values())
    due = {s: [Fraction(0)] for s in own}
    for s in own:
        done = 0
        for x in sizes[s]:
            done += x
            due[s].append(Fraction(done * total, own[s]))
    waiting = [(Fraction(0), s, 0) for s in sorted(own)]
    heapq.heapify(waiting)
    ready: list[tuple[Fraction, str, int]] = []
    out: list[tuple[str, int, int]] = []
    now = 0
    while waiting or ready:
        while waiting and (waiting[0][0] <= now or not ready):
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due[s][j + 1], s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j, now))
        now += sizes[s][j]
        if j + 1 < len(sizes[s]):
            heapq.heappush(waiting, (due[s][j + 1], s, j + 1))
    return out


def quotas(have: dict[str, int], share: dict[str, float], caps: dict[str, int], total: int | None = None) -> dict[str, float]:
    """Tokens of every source in the mix."""
    live = {s: share[s] for s in share if share[s] and share[s] > 0 and have.get(s, 0) > 0 and (caps.get(s) or 0) >= 1}
    most = {s: have[s] * caps[s] for s in live}
    if not live:
        return {}
    weight = sum(live.values())
    if total is None:
        size = min(most[s] * weight / live[s] for s in live)
        return {s: size * live[s] / weight for s in live}
    out, left, rest = {}, float(total), dict(live)
    while rest:
        w = sum(rest.values())
        full = [s for s in rest if left * rest[s] / w >= most[s]]
        if not full:
            return out | {s: left * rest[s] / w for s in rest}
        for s in full:
            out[s] = float(most[s])
            del rest[s]
        left = max(0.0, total - sum(out.values()))
    return out


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, blocks: int = BLOCKS, ranks: str = DEFAULT_RANKS) -> tuple[DataFrame, DataFrame]:
    """The mix (pos, doc_id, source, turn, n_tokens, block_tokens) and the report of shares by source.

    ``pos`` is the number of tokens of the mix before the document, so it
    orders the mix; ``turn`` counts the uses of a document from 1;
    ``block_tokens`` is the bound: at the end of every document each source
    has its share of what has gone, give or take less than that. Targets are
    one row per source and few; sources repeated there count once (greatest share).
    """
    spark = docs.sparkSession
    want = {r["source"]: (r["w"], r["m"]) for r in targets.filter("source is not null").groupBy("source").agg(F.max(F.col("target_share").cast("double")).alias("w"), F.max(F.col("max_repeats").cast("int")).alias("m")).collect()}
    listed = targets.select("source").filter("source is not null").distinct()
    named = docs.select("doc_id", "source", "text").join(F.broadcast(listed), "source", "left_semi")  # one row a source; all were just collected
    sized = cut(count_tokens(named, keep=["doc_id", "source"], ranks=ranks).filter("n_tokens > 0 and doc_id is not null"))
    seen = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("top")).collect()
    have = {r["source"]: (r["n"], r["t"]) for r in seen}
    quota = quotas({s: t for s, (_, t) in have.items()}, {s: w for s, (w, _) in want.items() if w}, {s: m for s, (_, m) in want.items() if m}, total)
    size, top = sum(quota.values()), max([1, *(r["top"] for r in seen)])
    # a block holds four of the largest documents at least; a piece and the document that overruns it are half a block
    block = max(math.ceil(size / max(1, blocks)), 4 * top + 2)
    piece = block // 2 - top
    # place of every document in its source: sums of buckets first, then within a bucket
    buckets = 64 + sum(n for n, _ in have.values()) // BUCKET_DOCS
    placed = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = sums.withColumn("before", F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"]).select("source", "bucket", "before")
    inner = placed.join(before, ["source", "bucket"]).withColumn("place", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    rows = [(s, float(q), int(have[s][1]), int(want[s][1])) for s, q in quota.items()]
    small = spark.createDataFrame(rows, "source string, quota double, own long, cap int")
    used = (
        inner.join(F.broadcast(small), "source")
        .withColumn("turn", F.explode(F.expr("sequence(1, greatest(1, least(cap, cast(ceil(quota / own) as int))))")))
        .withColumn("at", F.col("place") + (F.col("turn") - 1) * F.col("own"))
        # a document is in if at least half of it lies within the quota, so the last one is not always over
        .filter(F.col("at") + F.col("n_tokens") / 2 <= F.col("quota"))
        .withColumn("piece", F.floor(F.col("at") / F.lit(piece)).cast("int"))
        .select("doc_id", "source", "turn", "n_tokens", "at", "piece")
    )
    used = cut(used)
    # the true pieces: at most four to a block, so a few ten thousand rows
    cuts = used.groupBy("source", "piece").agg(F.sum("n_tokens").alias("t"), F.min("at").alias("a")).orderBy("source", "piece").collect()
    sizes: dict[str, list[int]] = {}
    for r in cuts:
        sizes.setdefault(r["source"], []).append(r["t"])
    pieces = {s: [(r["piece"], r["a"]) for r in cuts if r["source"] == s] for s in sizes}
    begins = [(s, *pieces[s][j], now) for s, j, now in schedule(sizes)]
    slots = spark.createDataFrame(begins, "source string, piece int, a long, begin long")
    mixed = used.join(F.broadcast(slots), ["source", "piece"])
    out = mixed.select((F.col("begin") + F.col("at") - F.col("a")).alias("pos"), "doc_id", "source", "turn", "n_tokens", F.lit(block).cast("long").alias("block_tokens"))
    return out, _report(spark, out, want, have, quota)


def _report(spark, out: DataFrame, want: dict, have: dict, quota: dict) -> DataFrame:
    """(source, target_share, reached_share, n_docs, n_tokens, n_used, tokens_used, most_turns) of every listed source."""
    rows = [(s, float(w) if w is not None else None, int(have.get(s, (0, 0))[0]), int(have.get(s, (0, 0))[1])) for s, (w, _) in want.items()]
    base = spark.createDataFrame(rows, "source string, target_share double, n_docs long, n_tokens long")
    got = out.groupBy("source").agg(F.count(F.lit(1)).alias("n_used"), F.sum("n_tokens").alias("tokens_used"), F.max("turn").alias("most_turns"))
    all_used = F.sum("tokens_used").over(Window.partitionBy(F.lit(1)))  # one row per listed source
    return (
        base.join(F.broadcast(got), "source", "left")
        .fillna(0, ["n_used", "tokens_used", "most_turns"])
        .withColumn("reached_share", F.round(F.coalesce(F.try_divide(F.col("tokens_used"), all_used), F.lit(0.0)), 9))
        .select("source", "target_share", "reached_share", "n_docs", "n_tokens", "n_used", "tokens_used", "most_turns")
    )

"""Problem 6: near-duplicate records with small edits.

Circulant MinHash: shingles are numbered into ``UNIVERSE`` places by a first
permutation; a second permutation, shifted by k, gives the k-th coordinate of
every signature, so two permutations make all of them. Signatures are cut into
bands; texts that share a band are candidates, and candidates are verified by
the exact Jaccard similarity of their shingle sets.

Equal texts are one representative throughout, so a text that a third of all
rows repeat is one row in every band. A bucket of representatives is not
expanded into pairs in one task: its members are dealt into blocks, and pairs
of blocks are separate rows, so any size of bucket is spread and none is cut.

Pairs of representatives become pairs of keys through blocks of their members
(at most BLOCK keys each), so the members of a text that stands in a third of
all rows are spread, too; ``groups`` needs no pairs of keys: it gives every
record its class and its number of links.

Defined results: null texts and texts of fewer than ``width`` words are in no
pair and in no group; repeats of a key are one record; keys of several rows
with different texts take each; equal texts have similarity 1; an empty table
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
from lexspark.sources.tables import cut

WIDTH = 5
THRESHOLD = 0.8
#: Places of the permutations; a power of two.
UNIVERSE = 1 << 20
NOT_WORDS = r"[^\pL\p{Nd}]+"
#: Bits of a sketch.
SKETCH = 256
#: Members of a bucket that meet in one row.
BLOCK = 64


def bands_for(threshold: float, miss: float = 0.02) -> tuple[int, int]:
    """(rows, bands): rows so that dissimilar texts seldom meet, bands so that a pair at the threshold is missed with probability ``miss``."""
    rows = 5 if threshold < 0.75 else 8
    return rows, int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows))))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words and the row offsets."""
    import xxhash

    words, offsets = flat(pc.split_pattern_regex(texts, NOT_WORDS))
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(filled)])
    coded = words.filter(pa.array(filled)).dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), "u8", len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return (own[codes] if len(codes) else np.zeros(0, "u8")), ends[offsets]


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every text, sorted within it, and the offsets."""
    h, offsets = word_hashes(texts)
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    s = np.zeros(len(row), "u8")
    with np.errstate(over="ignore"):
        for k in range(width):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[first + k])
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[keep], row[keep]
    return s, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype("i8")


_TABLE: dict[int, np.ndarray] = {}


def _second_permutation(k: int) -> np.ndarray:
    """The second permutation, its first k places repeated at the end, so that shifts are slices."""
    if k not in _TABLE:
        p = np.random.default_rng(20_011).permutation(UNIVERSE).astype("i4")
        _TABLE[k] = np.concatenate([p, p[:k]])
    return _TABLE[k]


def signatures(s: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The k coordinates of every nonempty set: minima over k circular shifts of one permutation."""
    table = np.lib.stride_tricks.sliding_window_view(_second_permutation(k), k)
    place = (_mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(UNIVERSE - 1)).astype("i8")
    out = np.empty((len(offsets) - 1, k), "i4")
    sizes = np.diff(offsets)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + 8192, side="right")) - 1)
        if sizes[a] > 16384:  # a very long text: by pieces
            best = np.full(k, np.iinfo("i4").max, "i4")
            for c in range(offsets[a], offsets[a + 1], 8192):
                best = np.minimum(best, table[place[c : min(c + 8192, offsets[a + 1])]].min(axis=0))
            out[a], b = best, a + 1
        else:
            out[a:b] = np.minimum.reduceat(table[place[offsets[a] : offsets[b]]], offsets[a:b] - offsets[a], axis=0)
        a = b
    return out


def _signed(width: int, rows: int, bands: int):
    """Per text (tid, buckets, sketch): a bucket for every band, and one bit of every coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            _, first = np.unique(part.column("tid").to_numpy(), return_index=True)  # copies within the slice
            part = part.take(pa.array(np.sort(first)))
            s, offsets = shingle_sets(strings(part.column("text")), width)
            full = np.flatnonzero(np.diff(offsets) > 0)
            if not len(full):
                continue
            sig = signatures(s, np.concatenate([offsets[full], offsets[-1:]]), max(SKETCH, rows * bands)).astype("u8")
            tid = part.column("tid").to_numpy()[full]
            h = np.zeros((len(full), bands), "u8")
            with np.errstate(over="ignore"):
                for r in range(rows):
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, r : rows * bands : rows])
                h = _mix(h + np.arange(bands, dtype="u8"))
            bits = np.packbits((_mix(sig[:, :SKETCH]) & np.uint64(1)).astype("u1"), axis=1)
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype="i4") * bands), pa.array(h.ravel().view("i8")))
            yield pa.RecordBatch.from_arrays([pa.array(tid), buckets, pa.array([b.tobytes() for b in bits], pa.binary())], ["tid", "buckets", "sketch"])

    return run


def _alike(least: int):
    """Keeps the pairs whose sketches agree in at least ``least`` bits."""
    ones = np.array([bin(i).count("1") for i in range(256)], "i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "u1").reshape(b.num_rows, -1) for c in ("sa", "sb"))
            ok = pa.array(SKETCH - ones[x ^ y].sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    return run


def least_agreement(threshold: float) -> int:
    """Bits that agree for a pair at the threshold, less five standard deviations (a miss of 3e-7)."""
    p = (1 + threshold) / 2
    return int(np.floor(SKETCH * p - 5 * np.sqrt(SKETCH * p * (1 - p))))


def _sets(width: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            if wanted is not None:
                part = part.filter(pa.array(in_bloom(wanted.value, part.column("tid").to_numpy().view("u8"))))
            _, first = np.unique(part.column("tid").to_numpy(), return_index=True)
            part = part.take(pa.array(np.sort(first)))
            s, offsets = shingle_sets(strings(part.column("text")), width)
            value = pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(s.view("i8")))
            yield pa.RecordBatch.from_arrays([part.column("tid"), value], ["tid", "grams"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ga, oa = flat(batch.column("ga"))
            gb, ob = flat(batch.column("gb"))
            ga, gb = ga.to_numpy(), gb.to_numpy()
            # both sets of a row side by side: a value that stands twice is common
            row = np.concatenate([rows_of(oa), rows_of(ob)])
            val = np.concatenate([ga, gb])
            order = np.lexsort((val, row))
            row, val = row[order], val[order]
            twice = (val[1:] == val[:-1]) & (row[1:] == row[:-1])
            common = np.bincount(row[1:][twice], minlength=batch.num_rows)
            sim = common / np.maximum(1, np.diff(oa) + np.diff(ob) - common)
            ok = pa.array(sim >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(sim).filter(ok)], ["a", "b", "jaccard"])

    return run


def records(df: DataFrame, key: str, text: str, field: str, version: str | None = None) -> DataFrame:
    """(field, key, version, tid, text): ``tid`` is a 64-bit hash of the text that stands for all its copies."""
    t = F.col(text)
    v = F.lit(None).cast("timestamp_ntz") if version is None else F.col(version)
    return df.filter(F.col(key).isNotNull() & t.isNotNull()).select(F.lit(field).alias("field"), F.col(key).cast("string").alias("key"), v.alias("version"), F.xxhash64(t).alias("tid"), t.alias("text"))


def _meeting(signed: DataFrame, least: int) -> DataFrame:
    """(a, b) of distinct texts that share a bucket and whose sketches are alike; rows are (tid, buckets, sketch).

    The rows are shuffled by bucket once; counts and members use that same
    exchange. A bucket of up to BLOCK members is one row. A larger one is dealt
    into g blocks by hash, and every member goes to the g rows of the block
    pairs it takes part in, so a row holds two blocks at most.
    """
    # copies in different slices are signed each: they meet here, in the same exchange
    spread = signed.select("tid", F.explode("buckets").alias("bucket")).repartition("bucket").dropDuplicates(["bucket", "tid"])
    # counts and members name the same columns (the condition on tid always holds), so that both plan the same exchange
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("t")).filter("n > 1 and t is not null").drop("t")
    some = spread.join(sizes.hint("merge"), "bucket")
    own = some.withColumn("g", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("blk", F.pmod(F.xxhash64("tid"), F.col("g")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cell = dealt.groupBy("bucket", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y")).agg(
        F.array_sort(F.collect_set(F.struct("blk", "tid"))).alias("m")
    )
    left = cell.filter(F.size("m") > 1).select("x", "y", F.explode("m").alias("l"), "m")
    # inside a block by tid; between two blocks the one of the lower block first
    pair = left.select("x", "y", F.col("l.blk").alias("lb"), F.col("l.tid").alias("l"), F.explode("m").alias("r")).filter(
        (F.col("lb") == F.col("x")) & (F.col("r.blk") == F.col("y")) & ((F.col("x") != F.col("y")) | (F.col("l") < F.col("r.tid")))
    )
    pairs = pair.select(F.least("l", "r.tid").alias("a"), F.greatest("l", "r.tid").alias("b")).distinct()
    sketch = signed.groupBy("tid").agg(F.first("sketch").alias("sketch"))
    x, y = sketch.select(F.col("tid").alias("a"), F.col("sketch").alias("sa")), sketch.select(F.col("tid").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(_alike(least), "a long, b long")


def similar_texts(texts: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, jaccard) of pairs of different texts (tid, text) at ``threshold`` or more, a < b.

    Texts are read where they are, once for the signatures and once for the
    sets of those in candidate pairs. Texts are shuffled only if the candidates
    are more than the largest Bloom filter holds.
    """
    rows, bands = bands_for(threshold)
    texts = texts.select("tid", "text")
    signed = texts.mapInArrow(_signed(width, rows, bands), "tid long not null, buckets array<long>, sketch binary")
    signed = cut(signed)
    pairs = cut(_meeting(signed, least_agreement(threshold)))
    need = pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct()
    bits = bloom(need, F.col("tid"))
    wanted = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits)
    source = texts.join(need, "tid", "left_semi") if bits is None else texts
    sets = source.mapInArrow(_sets(width, wanted), "tid long, grams array<long>").groupBy("tid").agg(F.first("grams").alias("grams"))
    a, b = sets.select(F.col("tid").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("tid").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ga", "gb").mapInArrow(_verify(threshold), "a long, b long, jaccard double")


def _packed(member: DataFrame) -> DataFrame:
    """(field, tid, blk, keys): the members of every text in blocks of about BLOCK keys, by a hash of the key."""
    many = member.groupBy("field", "tid").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("g")).filter("g > 1")
    dealt = member.join(many, ["field", "tid"], "left").withColumn("blk", F.coalesce(F.pmod(F.xxhash64("key"), F.col("g")), F.lit(0)).cast("int"))
    return dealt.groupBy("field", "tid", "blk").agg(F.collect_list("key").alias("keys"))


def key_pairs(recs: DataFrame, members: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(field, key_a, key_b, jaccard) of all pairs of different keys of one field; key_a < key_b as strings.

    ``recs`` are records, perhaps of former versions too; ``members`` (field,
    key, tid) says whose texts count. Pairs of representatives are joined with
    the blocks of their members, and copies of one text block by block.
    """
    near = cut(similar_texts(recs, width, threshold))
    packed = cut(_packed(members.select("field", "tid", "key").distinct()))
    l = packed.select("field", F.col("tid").alias("a"), F.col("keys").alias("ka"))
    r = packed.select(F.col("field").alias("fb"), F.col("tid").alias("b"), F.col("keys").alias("kb"))
    across = near.join(l, "a").join(r, "b").filter("field = fb").select("field", "ka", "kb", "jaccard")
    # copies of one text: each block with itself and with the blocks after it
    many = packed.filter("blk > 0").select("field", "tid").distinct().withColumn("several", F.lit(True))
    copies = packed.join(many, ["field", "tid"], "left").filter(F.col("several") | (F.size("keys") > 1)).drop("several")
    x, y = copies.select("field", "tid", F.col("blk").alias("x"), F.col("keys").alias("ka")), copies.select("field", "tid", F.col("blk").alias("y"), F.col("keys").alias("kb"))
    equal = x.join(y, ["field", "tid"]).filter("x <= y").select("field", "ka", "kb", F.lit(1.0).alias("jaccard"))
    both = across.unionByName(equal).select("field", F.explode("ka").alias("ka"), "kb", "jaccard").select("field", "ka", F.explode("kb").alias("kb"), "jaccard").filter("ka <> kb")
    return both.groupBy("field", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).agg(F.max("jaccard").alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b): root is the least node of its connected component.

    Alternating stars: in turns every node links its larger and then its
    smaller neighbours to the least one it knows, until nothing changes. Each
    turn is written to the shared folder; the number of turns grows with the
    logarithm of the size of a component. Only counts reach the driver.
    """
    star = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        new = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        if new.count() == star.count() and new.join(star, ["u", "v"], "left_anti").isEmpty():
            break
        star = new
    roots = star.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def groups(recs: DataFrame, members: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(field, key, group_key, n_links) of every record that has a near-duplicate: its class and its number of partners.

    Classes are the connected components over pairs of different texts, each
    text with all its copies; ``group_key`` is the least key of the class. A
    partner is a record of the same field whose text is similar or the same.
    Copies are never paired: their number counts.
    """
    near = cut(similar_texts(recs, width, threshold).select("a", "b"))
    member = cut(members.select("field", "tid", "key").distinct())
    copies = member.groupBy("field", "tid").agg(F.count(F.lit(1)).alias("n"))
    pairs = near.join(copies.select("field", F.col("tid").alias("a"), F.col("n").alias("na")), "a").join(copies.select(F.col("field").alias("fb"), F.col("tid").alias("b"), F.col("n").alias("nb")), "b").filter("field = fb")
    pairs = cut(pairs.select("field", "a", "b", "na", "nb"))
    links = pairs.select("field", F.col("a").alias("tid"), F.col("nb").alias("n")).unionByName(pairs.select("field", F.col("b").alias("tid"), F.col("na").alias("n"))).groupBy("field", "tid").agg(F.sum("n").alias("links"))
    tag = lambda c: F.struct("field", F.col(c).alias("tid"))
    roots = components(pairs.select(tag("a").alias("a"), tag("b").alias("b"))).select("node.field", "node.tid", F.col("root.tid").alias("root"))
    classes = copies.join(links, ["field", "tid"], "left").join(roots, ["field", "tid"], "left").filter("n > 1 or links is not null")
    classes = classes.select("field", "tid", F.coalesce("root", "tid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    own = cut(member.join(classes, ["field", "tid"]))
    heads = own.groupBy("field", "root").agg(F.min("key").alias("group_key"))
    # a key of several texts of one field stands once, in the class of its least group
    return own.join(heads, ["field", "root"]).groupBy("field", "key").agg(F.min("group_key").alias("group_key"), F.sum("n_links").alias("n_links"))


def members(recs: DataFrame, width: int) -> DataFrame:
    """(field, key, version, tid) of the records with at least ``width`` words."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))
    return recs.filter(words >= width).select("field", "key", "version", "tid")

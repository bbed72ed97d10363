"""Problem 8: token ids of a whole corpus by a public byte-level BPE.

Two-tier lookup. Texts are split into pre-tokens in the JVM; a minimal perfect
hash over the vocabulary gives the id of every pre-token that is a token
itself; the others are merged by a heap over a linked list of their bytes.
Each distinct pre-token of an Arrow batch is looked up once.

Defined results: null and empty text give an empty list; text is encoded as it
is (no trimming, strings of special tokens are ordinary text); repeated rows
are encoded each; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import flat

#: Where the vocabulary files lie, unless the caller names another place.
DEFAULT_RANKS = os.environ.get("LEXSPARK_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Pre-tokens of the byte-level BPE, in Java's syntax (fixed values of the public tokenizer).
_W = r"\p{IsWhite_Space}"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+"

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_MUL = 0xD6E8FEB86659FD93


def _slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """The place of hash ``h`` under displacement ``d``."""
    with np.errstate(over="ignore"):
        x = h ^ (d.astype("u8") * np.uint64(_STEP))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_MUL)
        x = x ^ (x >> np.uint64(32))
    return (x % np.uint64(n)).astype("i8")


class PerfectHash:
    """A minimal perfect hash by displacement: n keys take exactly n places.

    Keys fall into buckets of four on average. The largest buckets are placed
    first, each by the least displacement that puts its keys on free places; a
    bucket of one key names its place directly (as a negative displacement).
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        h = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), "u8", n)
        self.buckets = b = max(1, n // 4)
        home = (h >> np.uint64(40)).astype("i8") % b
        self.shift = np.zeros(b, "i4")
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(b + 1))
        taken = np.zeros(n, bool)
        self.index = np.full(n, -1, "i4")
        sizes = np.diff(starts)
        tries = np.arange(256, dtype="i8")
        for k in np.argsort(-sizes, kind="stable"):
            own = order[starts[k] : starts[k + 1]]
            if len(own) < 2:
                break
            base = 1
            while True:
                at = _slot(h[own][None, :], (base + tries)[:, None], n)
                s = np.sort(at, axis=1)
                good = ~taken[at].any(axis=1) & (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    j = int(np.argmax(good))
                    self.shift[k] = base + j
                    taken[at[j]] = True
                    self.index[at[j]] = own
                    break
                base += len(tries)
        free = iter(np.flatnonzero(~taken).tolist())
        for k in np.flatnonzero(sizes == 1):
            own, place = order[starts[k]], next(free)
            self.shift[k] = -place - 1
            self.index[place] = own

    def places(self, keys: list[bytes]) -> np.ndarray:
        """The number of the only key each could be; the caller compares the key itself."""
        h = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), "u8", len(keys))
        d = self.shift[(h >> np.uint64(40)).astype("i8") % self.buckets].astype("i8")
        return self.index[np.where(d < 0, -d - 1, _slot(h, np.maximum(d, 0), self.n))]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: a heap of adjacent pairs over linked bytes."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    end = list(range(1, n + 1))  # part i is piece[i:end[i]]; the next part starts at end[i]
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of its parts has changed since
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = prev[i]
        if p >= 0:
            r = ranks.get(piece[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """The vocabulary of one file and its lookups; a worker keeps one."""

    MOST_KEPT = 400_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.keys = [base64.b64decode(a) for a, _ in pairs]
        self.ids = np.array([int(b) for _, b in pairs], "i4")
        self.ranks = dict(zip(self.keys, self.ids.tolist()))
        self.hash = PerfectHash(self.keys)
        self.kept: dict[str, list[int]] = {}

    def lookup(self, words: list[str]) -> list[list[int]]:
        kept = self.kept
        if len(kept) > self.MOST_KEPT:
            kept.clear()
        new = [w for w in words if w not in kept]
        if new:
            raw = [w.encode() for w in new]
            for w, b, k in zip(new, raw, self.hash.places(raw).tolist()):
                kept[w] = [int(self.ids[k])] if self.keys[k] == b else merge(b, self.ranks)
        return [kept[w] for w in words]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(name: str, out: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            words, offsets = flat(batch.column("_pieces"))
            coded = words.dictionary_encode()
            found = own.lookup(coded.dictionary.to_pylist())
            codes = coded.indices.to_numpy(zero_copy_only=False)
            lens = np.fromiter(map(len, found), "i8", len(found))
            each = lens[codes] if len(codes) else np.zeros(0, "i8")
            ends = np.concatenate([[0], np.cumsum(each)])
            at = ends[offsets]
            keep = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "_pieces"]
            names = [f.name for f in batch.schema if f.name != "_pieces"]
            if counts_only:
                value = pa.array(np.diff(at).astype("i8"))
            else:
                ids = np.fromiter((x for f in found for x in f), "i4", int(lens.sum()))
                start = (np.cumsum(lens) - lens)[codes] if len(codes) else np.zeros(0, "i8")
                where = np.arange(ends[-1]) - np.repeat(ends[:-1] - start, each)
                value = pa.ListArray.from_arrays(pa.array(at.astype("i4")), pa.array(ids[where]))
            yield pa.RecordBatch.from_arrays([*keep, value], [*names, out])

    return run


def _pieces(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.coalesce(F.regexp_extract_all(F.col(text), F.lit(PRETOKEN), F.lit(0)), F.array().cast("array<string>")).alias("_pieces"))


def _shipped(df: DataFrame, ranks: str) -> str:
    """Sends the vocabulary file from the driver to all executors; its name there."""
    df.sparkSession.sparkContext.addFile(ranks)
    return os.path.basename(ranks)


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "ids", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """The columns ``keep`` and the token ids of ``text`` as ``out`` (array of int)."""
    keep = keep or ["doc_id"]
    src = _pieces(df, text, keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_pieces")
    return src.mapInArrow(_encode(_shipped(df, ranks), out, False), f"{schema}, `{out}` array<int>")


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "n_tokens", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text`` as ``out`` (long)."""
    keep = keep or ["doc_id"]
    src = _pieces(df, text, keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_pieces")
    return src.mapInArrow(_encode(_shipped(df, ranks), out, True), f"{schema}, `{out}` long")

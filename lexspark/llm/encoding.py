"""Problem 7: text garbled by a wrong character encoding, found and restored.

Noisy-channel decoding. The channel: text was written in one encoding and read
in another, perhaps several times, perhaps in places only, perhaps with bytes
lost. Each distinct token of the corpus is turned back into a lattice of bytes
for every way of misreading (``_Channel.lattice``): its edges are characters
that stay, byte sequences that are one character of UTF-8, and wildcards for
lost bytes, that is, all bytes the code page leaves undefined (all continuation
bytes where it leaves none). The best path through the lattice is found by
Viterbi search; the ways to fill its wildcards are weighed, like all readings,
by the corpus frequency of the word they give against that of the token as it
stands. A Viterbi search over the tokens of a text then decides which spans of
it are damaged: entering a damaged span costs ``ENTER``, and within one the way
of misreading changes only at a cost.

A token with more than ``PATHS`` ways to fill its wildcards is matched against
the words of its length instead, each lost character standing for any.

Word frequencies are counted over the whole corpus and stay a distributed
table. Tokens that have a better reading form a table of damaged tokens;
texts meet it through a Bloom filter sized by its count (its false matches are
removed by the join that follows) or, beyond the largest filter, through all
tokens that have any reading, so what is broadcast is bounded.

Defined results: null, empty and blank texts are no case; a null key has no
row; repeats of a row give one; an empty table gives an empty result; other
columns are ignored. A text restored is complete if no byte of it was lost;
lost bytes are filled in where a known word fits, and stay U+FFFD elsewhere.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import bloom, flat, in_bloom, rows_of, slices, strings
from lexspark.sources.tables import cut

#: (read as, written as): the misreadings considered.
READ_AS = ["cp1253", "iso8859_7", "cp1252", "latin_1", "cp1251", "cp437", "cp737", "cp850", "cp866", "koi8_r", "mac_greek", "mac_roman"]
WRITTEN = {
    "cp1253": ["cp1252", "latin_1", "cp1251", "cp1250", "mac_greek", "cp737", "cp437", "cp850", "cp866", "koi8_r", "mac_roman"],
    "cp737": ["cp1253", "iso8859_7", "cp1252", "latin_1", "cp437", "cp850", "mac_greek"],
    "mac_greek": ["cp1253", "iso8859_7", "cp1252", "latin_1", "mac_roman"],
}
ENTER = 5.0
SWITCH = 4.0
#: Clean tokens that may stand between two damaged ones of one span at no cost of entering again.
GAP = 4
#: Ways to fill the wildcards of one token that are spelled out.
PATHS = 8192
#: Patterns up to which they are broadcast; more are joined by a shuffle with the same result.
FEW = 10_000
TOKEN = "[ \t\r\n]+"
EDGE = ".,;:!?()[]{}'\"-"
EDGE_ALL = EDGE + "«»–’·“”„…"
_GREEK = "ΆΈΉΊΌΎΏΐΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΪΫάέήίΰαβγδεζηθικλμνξοπρςστυφχψωϊϋόύώ"
_PLAIN = re.compile(rf"[\x00-\x7f{_GREEK}«»–’·]*")
_ODD = re.compile(rf"[^\x00-\x7f{_GREEK}«»–’·]")
_WORD = re.compile(rf"[«(\[\"']*[{_GREEK}][{_GREEK}'’\-./·»«–,;:)\]\"0-9]*")
_MEANT = _GREEK + "«»–—’‘·“”…€§°" + "".join(map(chr, range(0xC0, 0x180)))
_LOST = "�"


def _bytes_of(name: str) -> dict[str, int]:
    """The byte of every character of a single-byte encoding; bytes it leaves undefined pass as controls."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


def _undefined(name: str) -> list[int]:
    """The continuation bytes that a code page leaves undefined: read in it they are lost."""
    out = []
    for b in range(0x80, 0xC0):
        try:
            bytes([b]).decode(name)
        except UnicodeDecodeError:
            out.append(b)
    return out


#: What a misreading can leave behind: it may be damaged once more.
_BETWEEN = {c for n in READ_AS for c in _bytes_of(n)}


class _Channel:
    """UTF-8 read in a single-byte encoding."""

    def __init__(self, name: str):
        self.name = f"utf8>{name}"
        self.byte = _bytes_of(name)
        chars: dict[int, list[str]] = {}
        for c, b in self.byte.items():
            chars.setdefault(b, []).append(c)
        span = lambda lo, hi: [c for b in range(lo, hi + 1) for c in chars.get(b, [])]
        tail, cls = span(0x80, 0xBF), lambda cs: "".join(map(re.escape, cs))
        self.any = re.compile(f"[{cls(span(0xC2, 0xDF))}][{cls(tail)}{_LOST}]|[{cls(span(0xE2, 0xE2))}][{cls(tail)}]{{2}}")
        #: The character that two or three characters are, if it is one that texts hold or that may be damaged once more.
        self.made: dict[str, str] = {}
        for lead in span(0xC2, 0xDF):
            self._add(lead, [(x,) for x in tail])
        for lead in span(0xE2, 0xE2):
            self._add(lead, itertools.product(tail, tail))
        lost = _undefined(name) or list(range(0x80, 0xC0))
        own = {b: tuple(c for c in (bytes([b, x]).decode() for x in lost) if c in _GREEK) for b in (0xCE, 0xCF)}
        #: What a character of Greek whose second byte is lost may be, by the character read for the first.
        self.wild = {} if _LOST in self.byte else {c: own[b] for c, b in self.byte.items() if b in own}

    def _add(self, lead: str, rest) -> None:
        for r in rest:
            try:
                c = bytes(self.byte[x] for x in (lead, *r)).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if c in _MEANT or c in _BETWEEN:
                self.made[lead + "".join(r)] = c

    def lattice(self, token: str) -> list[list[tuple[int, str | tuple[str, ...]]]]:
        """The edges that leave each character: where they lead and the character made, or those a wildcard stands for."""
        made, wild = self.made, self.wild
        out: list[list[tuple[int, str | tuple[str, ...]]]] = []
        for i, c in enumerate(token):
            edges: list[tuple[int, str | tuple[str, ...]]] = [(i + len(x), made[x]) for x in {token[i : i + 2], token[i : i + 3]} if x in made]
            if c in wild and token[i + 1 : i + 2] == _LOST:
                edges.append((i + 2, wild[c]))
            out.append(edges)
        return out

    def path(self, token: str) -> tuple[list[str | tuple[str, ...]], int]:
        """The path with the most characters made (Viterbi, from the end), and how many those are; wildcards stay tuples."""
        if self.any.search(token) is None:
            return list(token), 0
        edges, size = self.lattice(token), len(token)
        score, step = [0] * (size + 1), [None] * size
        for i in range(size - 1, -1, -1):
            best, to, c = score[i + 1], i + 1, token[i]
            for j, x in edges[i]:
                if score[j] + 1 > best:
                    best, to, c = score[j] + 1, j, x
            score[i], step[i] = best, (to, c)
        out, i = [], 0
        while i < size:
            i, c = step[i]
            out.append(c)
        return out, score[0]

    def read(self, token: str) -> tuple[str, int, int]:
        """The token read anew, how many characters that made, and how many of them are lost."""
        if self.any.search(token) is None:
            return token, 0, 0
        if _LOST not in token:
            # leads and continuations are different bytes, so edges never overlap: the best path takes them all
            made = 0

            def one(m: re.Match) -> str:
                nonlocal made
                c = self.made.get(m.group())
                made += c is not None
                return m.group() if c is None else c

            return self.any.sub(one, token), made, 0
        got, made = self.path(token)
        return "".join(_LOST if isinstance(c, tuple) else c for c in got), made, sum(isinstance(c, tuple) for c in got)


def _table(read_as: str, written: str) -> dict[int, str]:
    back = {b: bytes([b]).decode(written, "replace") for b in range(128, 256)}
    return {ord(c): back[b] for c, b in _bytes_of(read_as).items() if back[b] not in (c, _LOST)}


_CHANNELS = [_Channel(n) for n in READ_AS]
_SINGLE = [(f"{w}>{r}", str.maketrans({chr(k): v for k, v in _table(r, w).items()}), r in ("cp1253", "iso8859_7", "mac_greek")) for w, rs in WRITTEN.items() for r in rs]
#: Two characters of UTF-8 are four bytes at least.
_PAIRS = re.compile(r"[^\x00-\x7f]{2}.*[^\x00-\x7f]{2}")
_HAS_GREEK = re.compile(f"[{_GREEK}]")


def readings(token: str) -> list[tuple[str, str, float, bool]]:
    """(way, text, evidence, complete) of the texts a token may have been; empty for most tokens.

    The evidence is what the form alone says: a run of well-formed multi-byte
    sequences hardly comes by chance, nor do words of accented letters only.
    """
    out: dict[str, tuple[str, float, bool]] = {}
    odd = _ODD.search(token) is not None
    if odd or "Ξ" in token or "Ο" in token or "Β" in token:
        todo = [(token, "", 0.0, 0)]
        # every reading is followed once, again only with more evidence; readings get shorter, so this ends
        seen: dict[str, float] = {}
        while todo:
            new = []
            for text, way, ev, gone in todo:
                for ch in _CHANNELS:
                    got, made, lost = ch.read(text)
                    if made == 0:
                        continue
                    name = f"{way}+{ch.name}" if way else ch.name
                    e = ev + 2.2 * made
                    if got not in out or out[got][1] + 1e-6 < e:  # the shortest way of equal ones
                        out[got] = (name, e if not _ODD.search(got.replace(_LOST, "")) else e - 6, gone + lost == 0)
                        if _ODD.search(got) and e > seen.get(got, -1.0):
                            seen[got] = e
                            new.append((got, name, e, gone + lost))
            todo = new
    for name, table, greek in _SINGLE:
        if not odd and not greek:
            continue
        got = token.translate(table)
        if got == token or got in out:
            continue
        if not _WORD.fullmatch(got):
            if not (odd and _ODD.search(token) and _HAS_GREEK.search(got) and not _ODD.search(got)):
                continue
        # one strange letter in a clean word is a look-alike, not a misreading
        if odd and 2 * sum(c in got for c in token if not c.isascii()) >= sum(not c.isascii() for c in token):
            continue
        letters = [c for c in token if c.isalpha()]
        strange = sum(1 for c in letters if 0xC0 <= ord(c) <= 0xFF)
        controls = sum(1 for c in token if 0x80 <= ord(c) < 0xA0)
        ev = 2.0 * controls
        if strange >= 3 and strange == len(letters):
            ev += 1.2 * strange
        out[got] = (name, ev, True)
    if odd and not any(ev > 0 and not _ODD.search(got) for got, (_, ev, _) in out.items()):
        _mixed_chains(token, out)
    if _LOST in token:
        out.setdefault(token, ("lost", 3.0 * token.count(_LOST), False))
    return [(way, got, ev, ok and _LOST not in got) for got, (way, ev, ok) in out.items()]


def _mixed_chains(token: str, out: dict[str, tuple[str, float, bool]]) -> None:
    """Readings by one single-byte misreading and one of UTF-8, in either order; only clean words with two characters made or more."""
    if _PAIRS.search(token) is None:
        return
    steps = []
    for name, table, _ in _SINGLE:
        got = token.translate(table)
        if got != token:
            steps += [(f"{name}+{ch.name}", ch.read(got)) for ch in _CHANNELS if ch.any.search(got)]
    for ch in _CHANNELS:
        got, made, lost = ch.read(token)
        if made > 1:
            steps += [(f"{ch.name}+{name}", (got.translate(table), made, lost)) for name, table, _ in _SINGLE]
    for way, (got, made, lost) in steps:
        if made > 1 and got not in out and _WORD.fullmatch(got) and lost == 0:
            out[got] = (way, 2.2 * made, True)


def fillings(way: str, token: str) -> list[str] | None:
    """The texts a token may have been, its lost bytes filled in all ways; null if they are more than PATHS."""
    *before, last = way.split("+")
    for step in before:
        token = reread(step, token)
    if last == "lost":
        rest = token.replace(_LOST, "")
        if _PLAIN.fullmatch(rest) is None or len(token) - len(rest) > sum(c.isalpha() for c in rest):
            return []  # the rest is no Greek, or too little
        parts: list[str | tuple[str, ...]] = [tuple(_GREEK) if c == _LOST else c for c in token]
    else:
        parts = _BY_NAME[last].path(token)[0]
    if any(c == _LOST for c in parts):
        return []
    wild = [c for c in parts if isinstance(c, tuple)]
    if math.prod(map(len, wild)) > PATHS:
        return None
    return ["".join(p) for p in itertools.product(*(c if isinstance(c, tuple) else (c,) for c in parts))]


def tokens(df: DataFrame, fields: list[str]) -> DataFrame:
    """(token, n): occurrences of every distinct token of the fields, edge punctuation off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words, _ = flat(pc.split_pattern_regex(strings(part.column("text")), TOKEN))
            own = pc.utf8_trim(words, EDGE)
            seen = own.value_counts()
            yield pa.RecordBatch.from_arrays([strings(seen.field(0)), seen.field(1).cast(pa.int64())], ["token", "n"])

    texts = None
    for f in fields:
        one = df.filter(F.col(f).isNotNull()).select(F.col(f).alias("text"))
        texts = one if texts is None else texts.unionByName(one)
    return texts.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("token <> ''")


def _core(arr: pa.Array) -> pa.Array:
    return pc.utf8_trim(arr, EDGE_ALL)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every reading of every token; ``guess`` marks those whose lost bytes are filled in, and patterns to be matched."""
    for batch in batches:
        rows: list[tuple] = []
        for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if token.isascii():
                continue
            for way, got, ev, ok in readings(token):
                rows.append((token, n, way, got, ev, ok, False, False))
                if _LOST in got:
                    full = fillings(way, token)
                    if full is None:
                        rows.append((token, n, way, got, ev, False, True, True))
                    else:
                        rows += [(token, n, way, x, ev, False, True, False) for x in full]
        token, n, way, meant, ev, ok, guess, pattern = zip(*rows) if rows else [[]] * 8
        meant = pa.array(meant, pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(token, pa.string()), pa.array(n, pa.int64()), pa.array(way, pa.string()), meant, strings(_core(meant)), pa.array(ev, pa.float64()), pa.array(ok, pa.bool_()), pa.array(guess, pa.bool_()), pa.array(pattern, pa.bool_())],
            ["token", "n", "way", "meant", "word", "evidence", "complete", "guess", "pattern"],
        )


def damaged_tokens(vocabulary: DataFrame) -> DataFrame:
    """(token, way, meant, gain, complete): tokens for which another reading is likelier than the token itself."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([strings(_core(b.column(0))), b.column(1)], ["word", "n"])

    words = vocabulary.mapInArrow(strip, "word string, n long").groupBy("word").agg(F.sum("n").alias("known"))
    cand = cut(vocabulary.mapInArrow(_candidates, "token string, n long, way string, meant string, word string, evidence double, complete boolean, guess boolean, pattern boolean"))
    scored = cand.filter("not pattern").join(words, "word", "left").filter("known is not null or not guess").drop("guess", "pattern")
    open_ = cand.filter("pattern").withColumn("size", F.length("word"))
    patterns = open_.count()
    if patterns:
        # words of the same length that the pattern fits; a lost character stands for any
        shaped = open_.withColumnRenamed("word", "like_").withColumn("shape", F.translate("like_", _LOST + "%_\\", "_"))
        shaped = F.broadcast(shaped) if patterns <= FEW else shaped
        fits = shaped.join(words.withColumn("size", F.length("word")), "size").filter(F.expr("word like shape") & ~F.contains("word", F.lit(_LOST)))
        fits = fits.withColumn("meant", F.replace("meant", F.col("like_"), F.col("word")))
        scored = scored.unionByName(fits.select(*scored.columns))
    known = F.coalesce(F.col("known"), F.lit(0))
    size = F.length("word")
    # a short word meets another one by chance: its frequency says less
    weight = F.when(F.col("evidence") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (size - 1) / 3))
    ratio = F.log(known + 0.5) - F.log(F.col("n") + 0.5)
    gain = F.when(known > 0, ratio * weight).otherwise(F.when(F.col("evidence") > 0, F.greatest(ratio, F.lit(-2.0)))) + F.col("evidence")
    best = scored.withColumn("gain", gain).filter("gain > 1.5")
    pick = F.max_by(F.struct("way", "meant", "gain", "complete"), F.struct("gain", "way", "meant")).alias("b")
    return best.groupBy("token").agg(pick).select("token", "b.*")


def _suspects(filter_words, field: str, filter_rows=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bits = filter_words.value if filter_words is not None else None
        for part in slices(batches, "text"):
            if filter_rows is not None:
                part = part.filter(pa.array(in_bloom(filter_rows.value, part.column("h").to_numpy().view("u8"))))
            words, offsets = flat(pc.split_pattern_regex(strings(part.column("text")), TOKEN))
            coded = pc.utf8_trim(words, EDGE).dictionary_encode()
            own = coded.dictionary.to_pylist()
            if bits is None:
                hit = np.fromiter((not w.isascii() and bool(readings(w)) for w in own), bool, len(own))
            else:
                hit = in_bloom(bits, np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in own), "u8", len(own)))
            codes = coded.indices.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(hit[codes]) if len(codes) else np.zeros(0, "i8")
            row = rows_of(offsets)[at]
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(row)), part.column("version").take(pa.array(row)), pa.array([field] * len(at), pa.string()), pa.array((at - offsets[row]).astype("i4")), strings(coded.dictionary.take(pa.array(codes[at])))],
                ["key", "version", "field", "pos", "token"],
            )

    return run


def viterbi(pos: list[int], gain: list[float], way: list[str]) -> tuple[float, list[int]]:
    """Best score and the indices taken as damaged.

    States: clean, or damaged in one way. Entering costs ENTER, also again
    after more than GAP other tokens; changing the way costs SWITCH.
    """
    states: dict[str, tuple[float, tuple | None]] = {}
    clean: tuple[float, tuple | None] = (0.0, None)
    last = None
    for i, (p, g, w) in enumerate(zip(pos, gain, way)):
        far = last is not None and p - last > GAP
        best = (clean[0] - ENTER, clean[1])
        for v, (s, link) in states.items():
            c = s - (ENTER if far else 0.0 if v == w else SWITCH)
            if c > best[0]:
                best = (c, link)
        if max(s for s, _ in [clean, *states.values()]) > clean[0]:
            clean = max([clean, *states.values()], key=lambda x: x[0])
        states = {v: x for v, x in states.items() if v != w}
        states[w] = (best[0] + g, (i, best[1]))
        # a state that the best one reaches by a change of way at no loss is never needed again
        least = max(s for s, _ in states.values()) - SWITCH
        states = {v: x for v, x in states.items() if x[0] > least or v == w}
        last = p
    score, link = max([clean, *states.values()], key=lambda x: x[0])
    out = []
    while link is not None:
        out.append(link[0])
        link = link[1]
    return score, out[::-1]


def damaged_spans(df: DataFrame, key: str, version: str, fields: list[str], wanted: list[str] | None = None, within: DataFrame | None = None) -> DataFrame:
    """(key, version, field, score, fixes): the texts that hold damage; fixes are (pos, token, meant, complete, way).

    Words are counted over all fields; texts are those of the fields wanted
    (all if none are named). Runs over all rows; the caller keeps the current
    ones. A caller that asks for some rows only names them by ``within`` (key,
    version): words are still those of all, other texts are passed over (by a
    Bloom filter, so a few of them may be judged, too).
    """
    vocabulary = cut(tokens(df, fields))
    bad = cut(damaged_tokens(vocabulary))
    own = bloom(bad, F.xxhash64("token"))
    bits = None if own is None else df.sparkSession.sparkContext.broadcast(own)
    only = None if within is None else bloom(within, F.xxhash64("key", "version"))
    rows = None if only is None else df.sparkSession.sparkContext.broadcast(only)
    found = None
    for f in wanted or fields:
        src = df.filter(F.col(f).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(version).alias("version"), F.col(f).alias("text"), F.xxhash64(key, version).alias("h"))
        kind = f"key {src.schema['key'].dataType.simpleString()}, version {src.schema['version'].dataType.simpleString()}, field string, pos int, token string"
        one = src.mapInArrow(_suspects(bits, f, rows), kind)
        found = one if found is None else found.unionByName(one)
    hits = found.join(bad, "token")
    per = hits.groupBy("key", "version", "field").agg(F.array_sort(F.collect_set(F.struct("pos", "token", "meant", "gain", "way", "complete"))).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ends = flat(batch.column("hits"))
            pos, gain = own.field("pos").to_pylist(), own.field("gain").to_pylist()
            coded = own.field("way").dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            way = [names[c] for c in codes.tolist()]
            keep, scores, taken, sizes = [], [], [], [0]
            for r, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                s, at = viterbi(pos[a:b], gain[a:b], way[a:b])
                if s > 0 and at:
                    keep.append(r)
                    scores.append(s)
                    taken += [a + i for i in at]
                    sizes.append(len(taken))
            t, chosen = pa.array(keep, pa.int64()), own.take(pa.array(taken, pa.int64()))
            names = ["pos", "token", "meant", "complete", "way"]
            fixes = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([chosen.field(c) for c in names], names))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(t) for c in ("key", "version", "field")] + [pa.array(scores, pa.float64()), fixes], ["key", "version", "field", "score", "fixes"])

    s = per.schema
    return per.mapInArrow(run, f"key {s['key'].dataType.simpleString()}, version {s['version'].dataType.simpleString()}, field string, score double, fixes array<struct<pos:int,token:string,meant:string,complete:boolean,way:string>>")


_SPLIT = re.compile("([ \t\r\n]+)")
_TABLES = {name: table for name, table, _ in _SINGLE}
_BY_NAME = {c.name: c for c in _CHANNELS}


def reread(way: str, token: str) -> str:
    """The token read anew in one way (steps joined by +)."""
    for step in way.split("+"):
        if step in _BY_NAME:
            token = _BY_NAME[step].read(token)[0]
        elif step in _TABLES:
            token = token.translate(_TABLES[step])
    return token


def apply_fixes(text: str, fixes: list[dict]) -> tuple[str, bool]:
    """The text with its damaged spans read anew, and whether all of them could be; separators stay.

    Short words say little by themselves, so within a span, and at its ends
    where they look damaged, they are read in the way of their neighbour.
    """
    parts = _SPLIT.split(text)
    by = {f["pos"]: f for f in fixes}
    at = sorted(by)
    fill: dict[int, str] = {}
    for a, b in zip(at, at[1:]):
        if b - a <= GAP + 1 and by[a]["way"] == by[b]["way"]:
            fill.update(dict.fromkeys(range(a + 1, b), by[a]["way"]))
    for k in at:
        for step in (-1, 1):
            n = k + step
            while 0 <= 2 * n < len(parts) and n not in by and n not in fill and abs(n - k) <= GAP and _ODD.search(parts[2 * n]):
                fill[n] = by[k]["way"]
                n += step
    complete = all(f["complete"] for f in fixes)
    for i in range(0, len(parts), 2):
        f = by.get(i // 2)
        if f is not None and f["token"] in parts[i]:
            parts[i] = parts[i].replace(f["token"], f["meant"], 1)
        elif i // 2 in fill:
            got = reread(fill[i // 2], parts[i])
            if not _ODD.search(got):
                parts[i] = got
    return "".join(parts), complete and _LOST not in "".join(parts)


def restored(df: DataFrame, spans: DataFrame, key: str, version: str) -> DataFrame:
    """(key, field, text, complete) of every text with damage, restored as far as it can be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [apply_fixes(t, f) for t, f in zip(b.column("text").to_pylist(), b.column("fixes").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("field"), pa.array([t for t, _ in got], pa.string()), pa.array([w for _, w in got], pa.bool_())], ["key", "field", "text", "complete"])

    out = None
    fields = [f for f in ("body", "summary") if f in df.columns]
    for f in fields:
        src = df.select(F.col(key).alias("key"), F.col(version).alias("version"), F.col(f).alias("text")).filter(F.col("text").isNotNull())
        own = spans.filter(F.col("field") == f).withColumnRenamed("version", "v")
        one = src.join(own, "key").filter(F.col("version").eqNullSafe(F.col("v"))).dropDuplicates(["key"]).select("key", "field", "text", "fixes")
        out = one if out is None else out.unionByName(one)
    return out.mapInArrow(run, f"key {out.schema['key'].dataType.simpleString()}, field string, text string, complete boolean")

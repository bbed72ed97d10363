"""Problem 10: texts cut off by field limits or in transfer.

The corpus gives a vocabulary trie, kept as a table of known forms and a table
of their proper prefixes: words; numbers by the word before them (digits as
one class, so that "22588/3" is a prefix of what follows "αριθμό" and no form
of its own); abbreviations, that is tokens with a full stop after which the
sentence goes on; and whole lines. A word node also tells how often the line
went on after the word and how often it ended there. The last token of every
text is left out of the counts. Every text is judged by the sum of its pieces
of evidence (``EVIDENCE``):

* ``broken``: the last token is an unknown proper prefix of known forms, and
  more words go on from it than texts end in it (or a tenth as many, if the
  text has the length of a limit);
* ``at_limit``: the text has just the length (in characters or bytes) at which
  texts of its source pile up;
* ``goes_on``: the last token is a known form after which lines go on, or ends
  in a mark after which more must come;
* ``sign``: a sign of a cut (an ellipsis, an open bracket, a lost character);
* ``closed`` and ``unclosed``: whether the end closes a sentence;
* ``number`` and ``short``: a sentence end that only looks like one, by the
  trie: a number that is an unknown prefix, an abbreviation;
* ``closing``: a closing line.

A text is cut if the sum is above 0. So length alone does not cut a sentence
that is closed, an unknown prefix outweighs a closing line, and the end of a
sentence is one piece among others; it decides alone only where the last token
is unknown and no prefix, at no limit, and stands in no closing line.

A closing line is a last line that stands as it is at the end of several
different texts (the more texts there are, the more of them are asked for) and
that hardly any other line continues, be it by a word or by a character; a
place with a full date; or usual formulas, each whole and with at most a name
after it, unless ten times as many lines go on from them as end there (they
serve small collections; larger ones learn theirs). A line that ends in an
unknown proper prefix is not learnt; lines of more than ``LINE_WORDS`` words
are not learnt.

Defined results: null, empty and blank texts are no case; repeats of a text
are cases each; a null source is a source of its own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import flat, rows_of, slices, strings
from lexspark.sources.tables import cut

_SPACE = " \t\r\n\u00a0\ufeff\u200b"
_ENDS = "!?;\u037e。؟"
_AFTER_END = "\"'»”’)]"
_DATED = re.compile(r"^[^\W\d_][\w’' .-]{0,60}, \d{1,2}(?:ης|η|er|re|st|nd|rd|th|\.)? [^\W\d_]+\.? \d{4}$|^[^\W\d_][\w’' .-]{0,60}, \d{1,2}[./-]\d{1,2}[./-]\d{4}$")
#: Usual closing formulas, whole lines in any case; others are learnt.
FORMULAS = ["(υπογραφή)", "ακριβές αντίγραφο", "ο πρόεδρος", "η γραμματέας", "ο γραμματέας", "η γραμματέας της έδρας", "ο γραμματέας της έδρας", "θεωρήθηκε", "θεωρήθηκε αυθημερόν", "certified true copy", "the registrar", "(signature)", "(signed)", "beglaubigte abschrift", "der urkundsbeamte", "copie conforme", "le greffier", "(signé)", "(gez.)"]
#: What joins two formulas in a line, and the name or office that may follow one: words with a capital, the last one no initial.
_JOINT = re.compile(r" [–—/|-] |, | και | and | und | et ")
_NAME = re.compile(r"(?:[^\W\d_a-zα-ωάέήίόύώ][\w.’'-]* )*[^\W\d_a-zα-ωάέήίόύώ][\w’'-]{2,}")
_SIGN = re.compile(r"(?:…|\.\.\.|\[|\(|-|�|\[\s*…?\s*\]|>>|→)$")
#: Texts a learnt line must end at least; one more for every tenfold of unclosed texts above a thousand.
LEAST_TEXTS = 3
LINE_WORDS = 6
#: Rows up to which a counted table is broadcast; larger ones are joined by a shuffle with the same result.
FEW = 50_000
_DIGITS = re.compile(r"\d+")
_DOTTED = re.compile(r"[^\W\d_]+\.")
#: Marks after which more must come.
_HANGING = ",·–—:«/&"
#: The weight of each piece of evidence; a text is cut if the sum is above 0.
EVIDENCE = {"broken": 6, "at_limit": 2, "goes_on": 2, "sign": 6, "unclosed": 1, "closed": -6, "number": 7, "short": 7, "closing": -5}
_STRIP = ".,;:!?()[]«»\"'’”…·–-"


def _closed(t: str) -> bool:
    """Whether a text without trailing blanks ends as a sentence does; ruled lines after it don't matter."""
    while True:
        bare = t.rstrip("-=_*~#|")
        if len(t) - len(bare) < 3:
            break
        t = bare.rstrip(_SPACE)
    t = t.rstrip(_AFTER_END)
    return t.endswith(tuple(_ENDS)) or t.endswith(".") and not t.endswith("..")


def _formulas(low: str, line: str) -> bool:
    """Whether a line (and the same in small letters) is made of whole formulas, with names after them or not."""
    if low in FORMULAS:
        return True
    if len(low) != len(line):
        return False
    at = 0
    for m in [*_JOINT.finditer(low), None]:
        part, name = low[at : m.start() if m else None], line[at : m.start() if m else None]
        if part not in FORMULAS:
            # the joint may stand between a formula and a name, too
            starts = [f for f in FORMULAS if part.startswith(f + " ")]
            rest = name[len(max(starts, key=len)) + 1 :] if starts else name
            if at == 0 and not starts or not _NAME.fullmatch(rest):
                return False
        at = m.end() if m else at
    return True


def _shape(token: str) -> str:
    return _DIGITS.sub("9", token.strip(_STRIP))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Known forms with counts: (kind, ctx, form, n, m, e).

    For words m counts where the line goes on after them and e where it ends
    without a mark; for abbreviations m counts where the sentence goes on.
    Texts are split once; all else looks at the distinct tokens of a slice.
    """
    for part in slices(batches, "text"):
        lines = pc.replace_substring(strings(part.column("text")), "\n", " \n ")
        every, offsets = flat(pc.split_pattern_regex(lines, r"[ \t\r\x{a0}\x{feff}\x{200b}]+"))
        filled = pc.greater(pc.binary_length(every), 0)
        row = rows_of(offsets)[filled.to_numpy(zero_copy_only=False)]
        coded = every.filter(filled).dictionary_encode()
        codes, tokens = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        newline = tokens.index("\n") if "\n" in tokens else -1
        real = codes != newline
        breaks = np.cumsum(~real)[real]  # line breaks before each token
        code, row = codes[real], row[real]
        if not len(code):
            continue
        # the last token of every text is left out, so each one here has a next one
        inner = np.flatnonzero(row[1:] == row[:-1])
        ends_line = breaks[inner + 1] != breaks[inner]
        size = len(tokens)
        count = np.bincount(code[inner], minlength=size)
        line_ends = np.bincount(code[inner][ends_line], minlength=size)
        # words, from the distinct tokens
        words, at = flat(pc.split_pattern_regex(coded.dictionary, r"[^\pL]+"))
        token_of = rows_of(at)
        word = words.dictionary_encode()
        index = word.indices.to_numpy(zero_copy_only=False)
        last = np.zeros(len(index), bool)
        last[at[1:][np.diff(at) > 0] - 1] = True  # empty if the token ends in a mark
        kinds = len(word.dictionary)
        total = [np.bincount(index, weights=w, minlength=kinds).astype("i8") for w in (count[token_of], (count - line_ends)[token_of] * last, line_ends[token_of] * last)]
        seen = np.flatnonzero(total[0])
        rows: list[tuple] = []
        # numbers by the token before them in the line
        digit = np.fromiter((any(c.isdigit() for c in t) for t in tokens), bool, size)
        follow = inner[1:][(np.diff(inner) == 1) & (breaks[inner[1:]] == breaks[inner[:-1]]) & digit[code[inner[1:]]]]
        pairs, n = np.unique(np.stack([code[follow - 1], code[follow]]), axis=1, return_counts=True)
        rows += [("num", tokens[a].lower(), _shape(tokens[b]), k, 0, 0) for a, b, k in zip(*pairs.tolist(), n.tolist())]
        # abbreviations: what comes next begins with a small letter or a digit
        dotted = np.fromiter((_DOTTED.fullmatch(t) is not None for t in tokens), bool, size)
        small = np.fromiter((t[0].islower() or t[0].isdigit() for t in tokens), bool, size)
        short = inner[dotted[code[inner]]]
        on = np.bincount(code[short][small[code[short + 1]]], minlength=size)
        rows += [("dot", "", tokens[k].lower(), int(count[k]), int(on[k]), 0) for k in np.flatnonzero(np.bincount(code[short], minlength=size)).tolist()]
        kind, ctx, form, n, m, e = zip(*rows) if rows else [[]] * 6
        out = [
            pa.concat_arrays([pa.array(kind, pa.string()), pa.array(["word"] * len(seen), pa.string())]),
            pa.concat_arrays([pa.array(ctx, pa.string()), pa.array([""] * len(seen), pa.string())]),
            pa.concat_arrays([pa.array(form, pa.string()), strings(word.dictionary.take(pa.array(seen)))]),
            *(pa.concat_arrays([pa.array(x, pa.int64()), pa.array(y[seen])]) for x, y in zip((n, m, e), total)),
        ]
        yield pa.RecordBatch.from_arrays(out, ["kind", "ctx", "form", "n", "m", "e"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the end of every text looks like."""
    for part in slices(batches, "text"):
        cols: list[list] = [[] for _ in range(11)]
        for i, (text, source) in enumerate(zip(part.column("text").to_pylist(), part.column("source").to_pylist())):
            t = text.rstrip(_SPACE)
            if not t:
                continue
            at = t.rfind("\n")
            line = t[at + 1 :].strip(_SPACE)
            parts = line.split()
            last, before = parts[-1], (parts[-2] if len(parts) > 1 else "")
            closed = _closed(t)
            kind, ctx, form = "", "", ""
            if any(c.isdigit() for c in last):
                kind, ctx, form = "num", before.lower(), _shape(last)
            elif closed and last.endswith(".") and last[:-1].isalpha():
                kind, form = "dot", last.lower()
            elif not closed:
                w = re.findall(r"[^\W\d_]+", last)
                if w:
                    kind, form = "word", w[-1]
            short = len(parts) <= LINE_WORDS and at >= 0
            low = line.lower()
            # a full date and a whole formula are known to the end
            whole = _DATED.match(line) is not None or low in FORMULAS
            closing = whole or _formulas(low, line)
            row = (i, source, closed, closing, _DIGITS.sub("9", " ".join(parts)) if short else None, kind, ctx, form, len(text), len(text.encode()), whole)
            for c, v in zip(cols, row):
                c.append(v)
        types = [pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        arrays = [pa.array(c, t) for c, t in zip(cols, types)]
        names = ["source", "closed", "closing", "line", "kind", "ctx", "form", "chars", "bytes", "whole"]
        sign = pa.array([_SIGN.search(x.rstrip(_SPACE)) is not None for x in part.column("text").take(arrays[0]).to_pylist()])
        final = [x.rstrip(_SPACE)[-1] for x in part.column("text").take(arrays[0]).to_pylist()]
        bare, hangs = pa.array([c.isalnum() for c in final], pa.bool_()), pa.array([c in _HANGING for c in final], pa.bool_())
        yield pa.RecordBatch.from_arrays([part.column("id").take(arrays[0]), *arrays[1:], part.column("h").take(arrays[0]), sign, bare, hangs], ["id", *names, "h", "sign", "bare", "hangs"])


def _continued(src: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, longer): for every line given, how many lines of the texts go on after it, within its last word or after it."""
    word = F.substring_index("line", " ", -1)
    wanted = lines.select("line", F.expr("left(line, length(line) - length(substring_index(line, ' ', -1)))").alias("head"), word.alias("word"))
    heads = wanted.select("head").distinct()
    heads = F.broadcast(heads) if lines.count() <= FEW else heads
    # words before the last one looked at, that word, lines with both, and those with more after them
    first = F.regexp_extract("l", rf"(?U)^\s*(\S+(?:\s+\S+){{0,{LINE_WORDS}}})", 1)
    parts = (
        src.select(F.explode(F.split("text", "\n")).alias("l"))
        .select(F.split(F.regexp_replace(first, r"\d+", "9"), r"(?U)\s+").alias("w"))
        .select("w", F.explode(F.sequence(F.lit(1), F.least(F.lit(LINE_WORDS), F.size("w")))).alias("k"))
        .select(F.expr("concat_ws(' ', slice(w, 1, k - 1), if(k > 1, '', null))").alias("head"), F.expr("w[k - 1]").alias("word"), (F.size("w") > F.col("k")).cast("long").alias("more"))
        .join(heads, "head", "left_semi")
        .filter("word <> ''")
        .groupBy("head", "word")
        .agg(F.count(F.lit(1)).alias("all"), F.sum("more").alias("more"))
    )
    # a word has no more prefixes than the longest one asked for
    most = wanted.agg(F.coalesce(F.max(F.length("word")), F.lit(0)).alias("most"))
    longer = (
        parts.crossJoin(F.broadcast(most))
        .select("head", F.length("word").alias("size"), "all", "more", "word", F.explode(F.expr("sequence(1, greatest(1, least(length(word), most)))")).alias("k"))
        .select("head", F.expr("left(word, k)").alias("word"), F.when(F.col("k") < F.col("size"), F.col("all")).otherwise(F.col("more")).alias("n"))
        .groupBy("head", "word")
        .agg(F.sum("n").alias("longer"))
    )
    return wanted.join(longer, ["head", "word"], "left").select("line", F.coalesce("longer", F.lit(0)).alias("longer"))


def truncated(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, cut, in_word, each piece of evidence, score) of every row with a nonblank text."""
    t = F.col(text)
    src = df.filter(t.isNotNull()).select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), t.alias("text"), F.xxhash64(t).alias("h"))
    kind = src.schema["id"].dataType.simpleString()
    ends = cut(
        src.mapInArrow(
            _ends,
            f"id {kind}, source string, closed boolean, closing boolean, line string, kind string, ctx string, form string, chars long, bytes long, whole boolean, h long, sign boolean, bare boolean, hangs boolean",
        )
    )
    forms = src.select("text").mapInArrow(_forms, "kind string, ctx string, form string, n long, m long, e long")
    forms = cut(forms.groupBy("kind", "ctx", "form").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("e").alias("e")).filter("form <> ''"))
    # the trie: prefixes of known forms, only those at which some text ends
    finals = cut(ends.filter("kind <> ''").groupBy("kind", "ctx", "form").agg(F.count_distinct("h").alias("ending")))
    few = finals.count() <= FEW
    nodes = finals.select("kind", "ctx", "form")
    sizes = finals.groupBy("kind", "ctx").agg(F.array_sort(F.collect_set(F.length("form"))).alias("sizes"))  # few lengths
    prefixes = (
        forms.filter("kind <> 'dot'")
        .select("kind", "ctx", "form", "n")
        .join(F.broadcast(sizes) if few else sizes, ["kind", "ctx"])
        .select("kind", "ctx", "n", F.expr("explode(transform(filter(sizes, k -> k < length(form)), k -> left(form, k)))").alias("form"))
        .join(F.broadcast(nodes) if few else nodes, ["kind", "ctx", "form"], "left_semi")
        .groupBy("kind", "ctx", "form")
        .agg(F.sum("n").alias("longer"))
    )
    known = finals.join(forms, ["kind", "ctx", "form"], "left").join(prefixes, ["kind", "ctx", "form"], "left").fillna(0, ["n", "m", "e", "longer"])
    # last lines that close: in several different texts, and hardly ever continued
    least = ends.agg(F.greatest(F.lit(LEAST_TEXTS), F.ceil(F.log10(F.greatest(F.count_if(~F.col("closed")), F.lit(1))))).alias("least"))
    lines = ends.filter("not closed and line is not null and not sign").groupBy("line").agg(F.count_distinct("h").alias("texts"))
    lines = lines.crossJoin(F.broadcast(least)).filter((F.col("texts") >= F.col("least")) | F.lower("line").isin(FORMULAS))
    lines = cut(lines)
    counted = lines.join(_continued(src, lines), "line")
    learnt = counted.select("line", ((F.col("texts") >= F.col("least")) & (F.col("longer") * 10 < F.col("texts"))).alias("learnt"), (F.col("longer") > F.col("texts") * 10).alias("goes_on"))
    # where lengths of a source pile up: at least five texts and twenty times what an even spread would give
    spread = ends.select("source", F.explode(F.array(F.struct(F.lit("c").alias("u"), F.col("chars").alias("v")), F.struct(F.lit("b").alias("u"), F.col("bytes").alias("v")))).alias("x"))
    piles = spread.groupBy("source", F.col("x.u").alias("u"), F.col("x.v").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    total = ends.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    limits = piles.join(total, piles["source"].eqNullSafe(total["source"])).select(piles["source"].alias("s"), "u", "v", ((F.col("k") >= 5) & (F.col("k") * 100 > F.col("rows") * 2)).alias("pile")).filter("pile")
    c = limits.filter("u = 'c'").select(F.col("s").alias("cs"), F.col("v").alias("cv"), F.lit(True).alias("at_c"))
    b = limits.filter("u = 'b'").select(F.col("s").alias("bs"), F.col("v").alias("bv"), F.lit(True).alias("at_b"))
    e = ends.join(known.withColumnRenamed("n", "known_n"), ["kind", "ctx", "form"], "left").join(learnt, "line", "left")
    e = e.join(c, e["source"].eqNullSafe(c["cs"]) & (F.col("chars") == F.col("cv")), "left")
    e = e.join(b, e["source"].eqNullSafe(b["bs"]) & (F.col("bytes") == F.col("bv")), "left")
    e = e.fillna(0, ["known_n", "m", "e", "longer", "ending"]).fillna(False, ["learnt", "goes_on", "at_c", "at_b"])
    in_word = F.col("kind").isin("word", "num") & (F.col("known_n") == 0) & (F.col("longer") > 0)
    at_limit = F.col("at_c") | F.col("at_b")
    closed = F.col("closed")
    # the last word itself is left out of the counts, so a closing word may be unknown too: it ends more texts than there are words that go on
    broken = ~closed & in_word & F.col("bare") & ~F.col("whole") & ((F.col("longer") > F.col("ending")) | at_limit & (F.col("longer") * 10 > F.col("ending")))
    evidence = {
        "broken": broken,
        "at_limit": at_limit,
        "goes_on": ~closed & (F.col("hangs") | (F.col("kind") == "word") & F.col("bare") & (F.col("m") > F.col("e") * 4)),
        "sign": ~closed & F.col("sign"),
        "unclosed": ~closed,
        "closed": closed,
        "number": closed & (F.col("kind") == "num") & in_word,
        "short": closed & (F.col("kind") == "dot") & (F.col("known_n") >= 3) & (F.col("m") * 10 >= F.col("known_n") * 8),
        "closing": ~closed & (F.col("closing") & ~F.col("goes_on") | F.col("learnt")),
    }
    score = F.lit(0)
    for name, there in evidence.items():
        score = score + F.when(there, F.lit(EVIDENCE[name])).otherwise(F.lit(0))
    judged = e.select(F.col("id").alias(key), "source", score.alias("score"), in_word.alias("in_word"), *[c.alias(f"has_{n}") for n, c in evidence.items()])
    return judged.select(key, "source", (F.col("score") > 0).alias("cut"), "in_word", *[F.col(f"has_{n}").alias(n) for n in ("broken", "at_limit", "goes_on", "sign", "unclosed", "number", "short", "closing")], "score")


def rates(found: DataFrame) -> DataFrame:
    """(source, n_rows, n_cut, share, n_in_word, n_at_limit): how often each source truncates."""
    n = lambda c: F.count_if(F.col("cut") & c)
    return found.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("cut").alias("n_cut"),
        (F.count_if("cut") / F.count(F.lit(1))).alias("share"),
        n(F.col("in_word")).alias("n_in_word"),
        n(F.col("at_limit")).alias("n_at_limit"),
    )

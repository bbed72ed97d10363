"""Problem 3: visually identical text with different characters.

Every distinct word of the corpus is mapped to what it looks like: compatibility
and full-width forms, combining accents and polytonic signs become the plain
letter, what does not show goes, and look-alike letters of other scripts become
the Greek one. Words are then grouped by the mapped value under the Unicode
collation of SQL (sensitive to accents and case), so that each group is one
appearance; its canonical member is the one without irregular characters that
the corpus uses most (the least word among equals), and it is joined back to
every word of the group. Signs, blanks and digits outside words are mapped and
grouped in the same way, as words of one character. A text in canonical form
has each word replaced by its canonical member, and blanks and signs by the
ordinary ones.

A text is irregular if a word, sign, blank or digit of it is not its canonical
member. A scan over whole columns first leaves out texts and words that cannot
be irregular: those without a character that may be, without two scripts side
by side, and without a word wholly in letters that look Greek. Words wholly in
another script are irregular only if the corpus has the same appearance in
Greek more often: so "Договор" or "software" stay, and a Latin "KAI" does not.

Defined results: null texts are no case and have no form; empty and blank texts
are no case; a null key has no row; repeats of a row give one; an empty table
gives an empty result; other columns are ignored; differences of case are kept;
combining marks that belong to a letter of another script (as in Devanagari)
stay, one that stands without a letter does not.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import flat, rows_of, slices, strings
from lexspark.sources.tables import cut

# Letters of other scripts and the Greek ones they look like.
LATIN = dict(zip("ABEZHIKMNOPTYXaiopuvxwyknó" + "áíúé", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιορυνχωγκηό" + "άίύέ"))
CYRILLIC = dict(zip("АВЕНІЈКМОРСТХУГПЛДФЅ" + "аеорсухіјѕкпвгтмнφф", "ΑΒΕΗΙJΚΜΟΡCΤΧΥΓΠΛΔΦS" + "αεορcυχιjsκπβγτμηφφ"))
CYRILLIC_TO_LATIN = dict(zip("АВЕНІЈКМОРСТХУЅ" + "аеорсухіјѕ", "ABEHIJKMOPCTXYS" + "aeopcyxijs"))
GREEK_TO_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "αιορυνχωγκ", "ABEZHIKMNOPTYX" + "aiopuvxwyk"))
SIGNS = {";": ";", "·": "·", "∙": "·", "⋅": "·", "‐": "-", "‑": "-", "‒": "–", "—": "–", "―": "–", "−": "–", "‘": "’", "‛": "’", "ʼ": "’", "ʹ": "’", "′": "’", "“": "«", "”": "»", "„": "«", "″": "»", "´": "’", "⁄": "/", "∕": "/"}

#: Not ordinary wherever they stand: combining signs, what does not show, blanks
#: other than the plain ones, compatibility and full-width forms, polytonic
#: letters, digits of other scripts, and look-alike signs.
IRREGULAR = regex.compile(r"[\p{M}\p{Cf}\p{Zs}\p{Zl}\p{Zp}­ᅟᅠㅤµϐ-ϖϰ-϶ἀ-῿℀-⅏ﬀ-ﬆ＀-￯\U0001d400-\U0001d7ff\p{Nd}" + regex.escape("".join(SIGNS)) + r"--[ 0-9]]", flags=regex.V1)
_HIDDEN = regex.compile(r"[\p{Cf}­ᅟᅠㅤ]")
_BLANKS = regex.compile(r"[\p{Zs}\p{Zl}\p{Zp}]")
_FOREIGN_DIGIT = regex.compile(r"(?![0-9])\p{Nd}")
#: A word keeps signs that combine or do not show.
WORD = regex.compile(r"[\p{L}\p{M}\p{Cf}­]*\p{L}[\p{L}\p{M}\p{Cf}­]*")
NOT_WORD = r"[^\pL\pM\p{Cf}]+"


@functools.lru_cache(maxsize=1 << 16)
def plain_char(c: str) -> str:
    """The ordinary character for one that is irregular wherever it stands."""
    if c in SIGNS:
        return SIGNS[c]
    if _HIDDEN.match(c):
        return ""
    if _BLANKS.match(c):
        return " "
    if _FOREIGN_DIGIT.match(c):
        return str(unicodedata.digit(c))
    return "".join(SIGNS.get(x, x) for x in unicodedata.normalize("NFKC", c))


def plain(text: str) -> str:
    """Compatibility, composition and hidden characters put right; scripts stay as they are."""
    if IRREGULAR.search(text):
        text = IRREGULAR.sub(lambda m: m.group() if unicodedata.combining(m.group()) else plain_char(m.group()), text)
        text = unicodedata.normalize("NFC", text)
    return _monotonic(text)


def _monotonic(text: str) -> str:
    """Polytonic Greek letters, and combining signs that remain, in the monotonic system."""
    if not any("ἀ" <= c <= "῿" or unicodedata.combining(c) for c in text):
        return text
    out = []
    for c in unicodedata.normalize("NFD", text):
        if c in "̀͂̀́":
            c = "́"  # grave and circumflex stand for the one accent
        elif c in "̓̔̄̆ͅ":
            continue
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def script(c: str) -> str:
    n = unicodedata.name(c, "")
    for s in ("GREEK", "LATIN", "CYRILLIC"):
        if s in n:
            return s[0]
    return "?" if c.isalpha() else ""


def scripts(word: str) -> set[str]:
    return {s for s in map(script, word) if s}


def greek_look(word: str) -> str | None:
    """The Greek word that one of another script (or a mixed one) looks like; null if some letter looks like none."""
    out = []
    for c in word:
        g = c if script(c) == "G" else LATIN.get(c) or CYRILLIC.get(c)
        if g is None or script(g) != "G":
            return None
        out.append(g)
    return "".join(out)


def latin_look(word: str) -> str | None:
    out = []
    for c in word:
        g = c if script(c) == "L" else CYRILLIC_TO_LATIN.get(c) or GREEK_TO_LATIN.get(c)
        if g is None:
            return None
        out.append(g)
    return "".join(out)


def mapped(word: str) -> tuple[str, bool]:
    """(what the word looks like, whether it is irregular in itself: by its characters or by mixing scripts)."""
    if len(word) == 1 and unicodedata.category(word)[0] == "M":
        return "", True  # a mark without a letter
    p = plain(word)
    bad = p != word
    own = scripts(p)
    if len(own) > 1:
        greek = sum(script(c) == "G" for c in p)
        g, l = greek_look(p), latin_look(p)
        if g is not None and (greek * 2 >= len(p) or l is None or any(c in "ςσφψξδθλπβζ" or c in "άέήίόύώϊϋΐΰ" for c in p)):
            return g, True
        if l is not None:
            return l, True
        return (g or p), True
    if own and own != {"G"}:
        g = greek_look(p)
        if g is not None:
            return g, bad
    return p, bad


def words(df: DataFrame, fields: list[str]) -> DataFrame:
    """(word, n): occurrences of every distinct word of the fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            own, _ = flat(pc.split_pattern_regex(strings(part.column("text")), NOT_WORD))
            seen = own.value_counts()
            yield pa.RecordBatch.from_arrays([strings(seen.field(0)), seen.field(1).cast(pa.int64())], ["word", "n"])

    return df.select(F.col("text")).filter("text is not null").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("word <> ''")


def canonical_forms(vocabulary: DataFrame) -> DataFrame:
    """(word, form, irregular): the canonical member of every word that is not its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [mapped(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in own], pa.string()), pa.array([y for _, y in own], pa.bool_())], ["word", "n", "look", "odd"])

    v = vocabulary.mapInArrow(run, "word string, n long, look string, odd boolean")
    # one appearance: equal under the accent-sensitive Unicode collation
    keyed = v.withColumn("same", F.collate("look", "UNICODE"))
    best = F.max_by(F.struct("word", "odd", "look"), F.struct((~F.col("odd")).alias("good"), "n", "word"))
    groups = keyed.groupBy("same").agg(best.alias("best"), F.count(F.lit(1)).alias("size"), F.max("odd").alias("some")).filter("size > 1 or some")
    got = keyed.join(groups, "same")
    # a group of irregular members only gets the form it looks like
    form = F.when(F.col("best.odd"), F.col("best.look")).otherwise(F.col("best.word"))
    return got.select("word", form.alias("form"), "odd").filter(F.col("word") != F.col("form"))


#: For RE2, which scans whole columns: a character that may be irregular, or two scripts side by side.
_MAYBE = (
    r"[^\x00-\x7f\x{384}-\x{386}\x{388}-\x{3ce}«»–’·\p{Latin}\p{Cyrillic}]|[\x{ff00}-\x{ffef}\x{fb00}-\x{fb06}\x{2100}-\x{214f}]"
    r"|\p{Greek}[\p{Latin}\p{Cyrillic}]|[\p{Latin}\p{Cyrillic}]\p{Greek}|\p{Latin}\p{Cyrillic}|\p{Cyrillic}\p{Latin}"
)
_FOREIGN_OR_MAYBE = _MAYBE + r"|[\p{Latin}\p{Cyrillic}]"
NOT_FOREIGN = r"[^\p{Latin}\p{Cyrillic}]+"
_MIXED = regex.compile(r"\p{Greek}[\p{Latin}\p{Cyrillic}]|[\p{Latin}\p{Cyrillic}]\p{Greek}|\p{Latin}\p{Cyrillic}|\p{Cyrillic}\p{Latin}")


def suspects(text: str) -> set[str]:
    """The distinct words, and the signs, blanks and digits outside words, that may be irregular."""
    found = {w for w in WORD.findall(text) if IRREGULAR.search(w) or _MIXED.search(w)}
    return found.union(IRREGULAR.findall(WORD.sub(" ", text)))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, key, version, word): what every text holds that may be irregular, and its words that may only look Greek."""
    for part in slices(batches, "text"):
        text = strings(part.column("text"))
        maybe = np.flatnonzero(pc.match_substring_regex(text, _MAYBE).to_numpy(zero_copy_only=False))
        at, found = [], []
        for i, t in zip(maybe.tolist(), text.take(pa.array(maybe)).to_pylist()):
            own = suspects(t)
            at += [i] * len(own)
            found += own
        own, offsets = flat(pc.split_pattern_regex(text, NOT_FOREIGN))
        coded = own.dictionary_encode()
        looks = np.array([w != "" and greek_look(w) is not None for w in coded.dictionary.to_pylist()], bool)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        foreign = np.flatnonzero(looks[codes]) if len(codes) else np.zeros(0, "i8")
        rows = np.concatenate([np.array(at, "i8"), rows_of(offsets)[foreign]])
        words = pa.concat_arrays([pa.array(found, pa.string()), strings(coded.dictionary.take(pa.array(codes[foreign])))])
        yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(rows)) for c in ("field", "key", "version")] + [words], ["field", "key", "version", "word"])


def irregular(recs: DataFrame) -> DataFrame:
    """(field, key, version) of the records (field, key, version, text) that hold a word or sign that is not its canonical member."""
    t = recs.filter("text is not null and key is not null").select("field", "key", "version", "text")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema if f.name != "text")
    hits = cut(t.mapInArrow(_marks, f"{kind}, word string"))
    # signs stand in no vocabulary of words
    asked = hits.select("word", F.lit(0).cast("long").alias("n")).distinct()
    forms = canonical_forms(cut(words(recs, ["text"]).unionByName(asked).groupBy("word").agg(F.sum("n").alias("n"))))
    return hits.join(forms.select("word"), "word", "left_semi").drop("word").distinct()


#: Words that are not canonical up to which they are broadcast (a few MB); more are joined to the texts that hold them.
MOST_FORMS = 100_000


def _rewritten(text: str, by: dict[str, str]) -> str:
    return plain(WORD.sub(lambda m: by.get(m.group(), m.group()), text) if by else text)


def normalised(recs: DataFrame) -> DataFrame:
    """(field, key, version, text): every record with its text in the one form; texts are read where they are."""
    # a plain Greek word stays, even if its look stands in Latin more often
    forms = cut(canonical_forms(cut(words(recs, ["text"]))).filter(~F.col("word").rlike("^[Ά-ώ]+$")))
    t = recs.filter("text is not null and key is not null").select("field", "key", "version", "text")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema if f.name != "text")
    few = forms.limit(MOST_FORMS + 1).count() <= MOST_FORMS
    if few:
        every = t.sparkSession.sparkContext.broadcast({r["word"]: r["form"] for r in forms.select("word", "form").collect()})
    else:
        hits = t.mapInArrow(_other_words, f"{kind}, word string")
        fixes = hits.join(forms, "word").groupBy("field", "key", "version").agg(F.collect_set(F.struct("word", "form")).alias("fixes"))
        f = fixes.select(F.col("field").alias("f"), F.col("key").alias("k"), F.col("version").alias("v"), "fixes")
        t = t.join(f, (F.col("field") == F.col("f")) & F.col("key").eqNullSafe(F.col("k")) & F.col("version").eqNullSafe(F.col("v")), "left").select("field", "key", "version", "text", "fixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            text = strings(b.column("text"))
            if few:
                plain_text = pc.invert(pc.match_substring_regex(text, _FOREIGN_OR_MAYBE)).to_pylist()
                out = [x if p else _rewritten(x, every.value) for x, p in zip(text.to_pylist(), plain_text)]
            else:
                out = [_rewritten(x, {y["word"]: y["form"] for y in fix or []}) for x, fix in zip(text.to_pylist(), b.column("fixes").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("field", "key", "version")), pa.array(out, pa.string())], ["field", "key", "version", "text"])

    return t.mapInArrow(run, f"{kind}, text string")


def _other_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, key, version, word) of the distinct words that are not plain Greek letters."""
    plain_greek = regex.compile(r"[Ά-ώ]+")
    for part in slices(batches, "text"):
        rows, out = [], []
        for i, t in enumerate(part.column("text").to_pylist()):
            for w in {w for w in WORD.findall(t) if not plain_greek.fullmatch(w)}:
                rows.append(i)
                out.append(w)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(c).take(at) for c in ("field", "key", "version")] + [pa.array(out, pa.string())], ["field", "key", "version", "word"])

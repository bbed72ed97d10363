"""Full-text search: postings, query planning, matching, cover-density ranking and headlines.

An index is an ordinary table (doc, lexeme, pos, weight), one row per token. A
query is planned on the driver into a small tree of terms; matching and
ranking are aggregations and windows over the postings of its terms only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.arrow import flat, rows_of, slices, strings
from lexspark.functions.text import fold, fold_word, stem_word
from lexspark.sources.tables import cut

NOT_TOKEN = r"[^\pL\pN_]+"
# The least length of a prefix, the vowels that may go from its end, the most characters of a query.
MIN_PREFIX = 5
VOWELS = "αεηιουω"
MOST_QUERY_CHARS = 600
#: Fixed value: a query that finds fewer passages by all its terms is asked for any of them.
LEAST_HITS = 5
# Two to six characters, all letters capitals, or a capital first and another one somewhere.
ACRONYM = r"^(?=[\p{L}\p{N}_]{2,6}$)(?:[^\p{Ll}]*\p{Lu}[^\p{Ll}]*|[^\p{L}]*\p{Lu}.*\p{Lu}.*)$"
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
# Function words left out of queries, folded.
STOPWORDS = frozenset(
    """
    ο η το οι τα του τησ των τον την τουσ τισ
    ενα μια ενασ μιασ ενοσ
    και κι ειτε αλλα ομωσ ωστε οτι που πωσ ποια ποιο ποιοσ
    να θα ασ δεν μη μην αν εαν οταν αφου ενω καθωσ επειδη διοτι γιατι
    με σε για προσ κατα μετα πριν χωρισ παρα περι υπο επι εν εκ ωσ απο
    στο στη στον στην στουσ στισ στα στησ στου
    αυτο αυτη αυτοσ αυτα αυτων αυτου αυτησ
    ειναι ηταν εχει ειχε εχουν εχω ειχαν ηθελε
    οπωσ οπου οσο οσα οσοι ουτε μονο πολυ πιο
    καθε αλλο αλλη αλλοι ολα ολεσ ολοι ολο
    τοτε τωρα εδω εκει ναι οχι
    """.split()
)
# Fixed value: what makes a query one with operators.
_OPERATORS = re.compile(r'["\u201c\u201d]|(?<!\w)-\w|\bOR\b|\bAND\b')
_WORDS = re.compile(r"\w+")


def _tokens(fields: list[str], weights: list[str], stemmed: bool):
    """Arrow: (doc, field texts…) to (doc, lexeme, pos, weight); each distinct word of a slice is folded and stemmed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, fields[-1]):
            shift = np.zeros(part.num_rows, "i8")
            for f, w in zip(fields, weights):
                words, offsets = flat(pc.split_pattern_regex(strings(pc.fill_null(part.column(f), "")), NOT_TOKEN))
                filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(filled)])[offsets]
                row = rows_of(ends)
                coded = words.filter(pa.array(filled)).dictionary_encode()
                folded = [fold_word(x) for x in coded.dictionary.to_pylist()]
                lexemes = pa.array([stem_word(x) for x in folded] if stemmed else folded, pa.string())
                pos = np.arange(len(row)) - ends[row] + 1 + shift[row]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(row)), lexemes.take(coded.indices), pa.array(pos.astype("i4")), pa.array([w] * len(row), pa.string())], ["doc", "lexeme", "pos", "weight"]
                )
                shift += np.diff(ends)

    return run


def weighted_postings(df: DataFrame, doc: str, parts: dict[str, str], stemmed: bool = True) -> DataFrame:
    """(doc, lexeme, pos, weight): the tokens of several fields (column → weight) as one text; positions from 1."""
    src = df.select(F.col(doc).alias("doc"), *parts)
    kind = src.schema["doc"].dataType.simpleString()
    return src.mapInArrow(_tokens(list(parts), list(parts.values()), stemmed), f"doc {kind}, lexeme string, pos int, weight string")


def postings(df: DataFrame, doc: str, text: str, stemmed: bool = True, weight: str = "D") -> DataFrame:
    """(doc, lexeme, pos, weight) of one field."""
    return weighted_postings(df.filter(F.col(text).isNotNull()), doc, {text: weight}, stemmed)


def write_index(index: DataFrame, path: str) -> DataFrame:
    """The postings as a table in the order of lexemes, so that a search reads only the row groups of its terms."""
    index.repartitionByRange("lexeme", "doc").sortWithinPartitions("lexeme", "doc", "pos").write.mode("overwrite").parquet(path)
    return index.sparkSession.read.parquet(path)


_ACRONYM = regex.compile(ACRONYM)


def is_acronym(token: str) -> bool:
    return _ACRONYM.match(token) is not None


def searches(word: Column) -> Column:
    """Whether a word of a query searches: it has a digit, is an acronym, or is no function word."""
    return word.rlike(r"\p{N}") | word.rlike(ACRONYM) | ~fold(word).isin(sorted(STOPWORDS))


def content_words(query: str) -> list[str]:
    """The words of a query that search (``searches``, on the driver)."""
    function = [w for w in _WORDS.findall(query) if fold_word(w) in STOPWORDS and not regex.search(r"\p{N}", w) and not is_acronym(w)]
    return [w for w in _WORDS.findall(query) if w not in function]


@dataclass(frozen=True)
class Term:
    """One searched lexeme (or prefix, or phrase of lexemes)."""

    words: tuple[str, ...]
    prefix: bool = False
    negated: bool = False

    def matches(self, lexeme: Column) -> Column:
        (w,) = self.words
        return lexeme.startswith(w) if self.prefix else lexeme == w

    def __str__(self) -> str:
        text = " <-> ".join(self.words) + (":*" if self.prefix else "")
        return f"!{text}" if self.negated else text


@dataclass(frozen=True)
class Query:
    """A disjunction of conjunctions of terms; ``expanded`` if made by prefix expansion."""

    groups: tuple[tuple[Term, ...], ...] = ()
    expanded: bool = False
    terms: tuple[Term, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "terms", tuple(dict.fromkeys(t for g in self.groups for t in g)))

    def relaxed(self) -> Query:
        """Any of the terms instead of all."""
        return Query(tuple((t,) for t in self.terms), self.expanded)

    def __str__(self) -> str:
        return " | ".join(" & ".join(map(str, g)) for g in self.groups)


def widen(lexeme: str) -> Term:
    """Long lexemes become prefixes, less one unstable vowel at the end if they stay long enough."""
    if len(lexeme) < MIN_PREFIX:
        return Term((lexeme,))
    cut = lexeme[:-1] if len(lexeme) > MIN_PREFIX and lexeme[-1] in VOWELS else lexeme
    return Term((cut,), prefix=True)


def _lexemes(text: str) -> tuple[str, ...]:
    return tuple(stem_word(fold_word(w)) for w in _WORDS.findall(text))


def _websearch(query: str) -> Query:
    """Terms are joined by AND; "..." is a phrase, OR a choice, a leading hyphen a negation. Curly quotes are no operators."""
    groups: list[list[Term]] = [[]]
    for m in re.finditer(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        sign, phrase, word = m.groups()
        if phrase is None and word.upper() == "OR":
            groups.append([])
            continue
        own = _lexemes(phrase if phrase is not None else word)
        if own:
            groups[-1].append(Term(own, negated=bool(sign)))
    return Query(tuple(tuple(g) for g in groups if g))


def plan(query: str, expand: bool = True) -> Query:
    """The search tree of a query string; queries over MOST_QUERY_CHARS are refused, blank ones find nothing."""
    q = query.strip()
    if len(q) > MOST_QUERY_CHARS:
        raise ValueError(f"a query has at most {MOST_QUERY_CHARS} characters")
    if not q:
        return Query()
    if expand and not _OPERATORS.search(q):
        own = sorted({x for w in content_words(q) for x in _lexemes(w)})
        if own:
            return Query((tuple(dict.fromkeys(widen(x) for x in own)),), expanded=True)
    return _websearch(q)


def _occurrences(index: DataFrame, docs: DataFrame, query: Query) -> DataFrame:
    """(doc, pos, weight, term): occurrences of the terms; a phrase is where its first word stands.

    The index is read once, for the rows of any term; the rest works on those.
    """
    lexeme = F.col("lexeme")
    wanted = F.lit(False)
    for t in query.terms:
        wanted = wanted | (t.matches(lexeme) if len(t.words) == 1 else lexeme.isin(*t.words))
    rows = cut(index.filter(wanted).join(docs.select("doc"), "doc", "left_semi"))
    singles = [F.when(t.matches(lexeme), F.lit(i)) for i, t in enumerate(query.terms) if len(t.words) == 1]
    out = rows.select("doc", "pos", "weight", F.explode(F.array_compact(F.array(*singles))).alias("term")) if singles else None
    for i, t in enumerate(query.terms):
        if len(t.words) < 2:
            continue
        first, *rest = (rows.filter(lexeme == w).select("doc", (F.col("pos") - k).alias("pos"), "weight") for k, w in enumerate(t.words))
        for one in rest:
            first = first.join(one.select("doc", "pos"), ["doc", "pos"], "left_semi")
        first = first.withColumn("term", F.lit(i))
        out = first if out is None else out.unionByName(first)
    return out


def search(index: DataFrame, docs: DataFrame, query: Query) -> DataFrame:
    """(doc, score) of the documents that match, by cover density, normalised to r / (r + 1).

    ``docs`` (doc) are those to search: the filter that all retrievers share.
    A document matches by one of the groups; for a group of negated terms only
    all documents without them do, at score 0.
    """
    if not query.groups:
        return docs.select("doc", F.lit(0.0).alias("score")).limit(0)
    place = {t: i for i, t in enumerate(query.terms)}
    occ = _occurrences(index, docs, query)
    has = occ.groupBy("doc").agg(F.collect_set("term").alias("terms"))
    if any(all(t.negated for t in g) for g in query.groups):
        has = docs.select("doc").join(has, "doc", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<int>")))
    hit = F.lit(False)
    for g in query.groups:
        ok = F.lit(True)
        for t in g:
            there = F.array_contains("terms", place[t])
            ok = ok & (~there if t.negated else there)
        hit = hit | ok
    matched = has.filter(hit).select("doc")
    wanted = [place[t] for t in query.terms if not t.negated]
    every = len(query.groups) == 1
    scores = cover_density(occ.filter(F.col("term").isin(wanted)), wanted if every else None)
    return matched.join(scores, "doc", "left").select("doc", F.coalesce(F.col("r") / (F.col("r") + 1), F.lit(0.0)).alias("score"))


def search_relaxed(index: DataFrame, docs: DataFrame, query: Query, least: int = LEAST_HITS) -> DataFrame:
    """``search``, or for any of the terms if all of them together hit fewer than ``least`` documents and the query was expanded."""
    hits = cut(search(index, docs, query))
    if query.expanded and len(query.terms) > 1 and hits.limit(least).count() < least:
        hits = search(index, docs, query.relaxed())
    return hits


def cover_density(occ: DataFrame, every: list[int] | None) -> DataFrame:
    """(doc, r): the sum over minimal covers of their mean weight over their length.

    Going through positions in order, the last place of each term so far gives
    the latest start of a cover that ends here; per start the shortest cover
    counts. With ``every`` None each occurrence is a cover by itself (any term
    will do).
    """
    w = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("weight")]
    occ = occ.withColumn("w", w)
    if every is None or len(every) == 1:
        return occ.groupBy("doc", "pos").agg(F.max("w").alias("w")).groupBy("doc").agg(F.sum("w").alias("r"))
    run = Window.partitionBy("doc").orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.max(F.when(F.col("term") == t, F.col("pos"))).over(run) for t in every]
    seen = occ.select("doc", "pos", "w", *[x.alias(f"l{t}") for t, x in zip(every, last)])
    start = F.least(*[f"l{t}" for t in every])
    complete = F.lit(True)
    for t in every:
        complete = complete & F.col(f"l{t}").isNotNull()
    covers = seen.filter(complete).select("doc", start.alias("a"), F.col("pos").alias("b")).groupBy("doc", "a").agg(F.min("b").alias("b"))
    # the weight of a cover: harmonic mean over its occurrences, by running sums
    sums = occ.groupBy("doc", "pos").agg(F.sum(1 / F.col("w")).alias("inv"), F.count(F.lit(1)).alias("n"))
    total = sums.select("doc", "pos", F.sum("inv").over(run).alias("s"), F.sum("n").over(run).alias("m"), "inv", "n")
    end = total.select("doc", F.col("pos").alias("b"), F.col("s").alias("sb"), F.col("m").alias("mb"))
    begin = total.select("doc", F.col("pos").alias("a"), (F.col("s") - F.col("inv")).alias("sa"), (F.col("m") - F.col("n")).alias("ma"))
    got = covers.join(end, ["doc", "b"]).join(begin, ["doc", "a"])
    items = F.col("mb") - F.col("ma")
    noise = F.col("b") - F.col("a") + 1 - items
    density = (items / (F.col("sb") - F.col("sa"))) / (1 + F.when(noise > 0, noise).otherwise(0))
    return got.groupBy("doc").agg(F.sum(density).alias("r"))


# The most and least words of a fragment, the most fragments, the mark of a match and what joins fragments.
MOST_WORDS, LEAST_WORDS, FRAGMENTS, MARK, JOIN = 40, 18, 2, "**", " … "


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def headline(text: Column, query: Query, most: int = MOST_WORDS, least: int = LEAST_WORDS) -> Column:
    """Up to two fragments of a text with the most matching words, matches in ``**``.

    A fragment begins at a match; of those that begin so, the one with the most
    matches within ``most`` words is taken, the first among equals, and another
    one that does not meet it. It ends with its last match and is filled up to
    ``least`` words on both sides. A text without a match gives its first words;
    a null text null. The text is split and folded once.
    """
    heads = [re.escape(t.words[0]) for t in query.terms if not t.negated]
    pattern = "^[^\\p{L}\\p{N}]*(" + "|".join(heads) + ")" if heads else "^$."
    plain = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    tokens = F.split(plain, " ")
    found = F.filter(F.transform(F.split(fold(plain), " "), lambda t, i: F.when(t.rlike(pattern), i)), lambda i: i.isNotNull())

    def best(starts: Column, at: Column) -> Column:
        """The start of the fragment with the most matches."""
        counted = F.transform(starts, lambda s: F.struct(F.size(F.filter(at, lambda x: (x >= s) & (x < s + most))).alias("n"), (-s).alias("s")))
        return -F.array_max(counted)["s"]

    def fragment(s: Column, t: Column, at: Column) -> Column:
        size = F.array_max(F.filter(at, lambda x: (x >= s) & (x < s + most))) - s + 1
        spare = F.floor(F.greatest(least - size, F.lit(0)) / 2).cast("int")
        length = F.greatest(size, F.lit(least))
        begin = F.greatest(F.least(s - spare, F.size(t) - length), F.lit(0))
        return _let(F.struct(begin.alias("b"), length.alias("n")), lambda w: F.array_join(F.transform(F.slice(t, w["b"] + 1, w["n"]), lambda word, i: F.when(F.array_contains(at, i + w["b"]), F.concat(F.lit(MARK), word, F.lit(MARK))).otherwise(word)), " "))

    def both(t: Column, at: Column) -> Column:
        """The two fragments in the order of the text."""
        return _let(best(at, at), lambda one: _let(best(F.filter(at, lambda x: (x >= one + most) | (x <= one - most)), at), lambda two: F.concat_ws(JOIN, fragment(F.least(one, two), t, at), F.when(two.isNotNull(), fragment(F.greatest(one, two), t, at)))))

    shown = _let(F.struct(tokens.alias("t"), found.alias("at")), lambda w: F.when(F.size(w["at"]) > 0, both(w["t"], w["at"])).otherwise(F.array_join(F.slice(w["t"], 1, least), " ")))
    return F.when(text.isNotNull(), shown)

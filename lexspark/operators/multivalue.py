"""Problem 4: several values packed in one field.

Which marks separate values is inferred per source. Every candidate mark is
scored on the fields that hold it: the regularity of its pieces (the share
that begin as values of that source begin: a capital, a digit or an opening
quotation mark or parenthesis) and the consistency of their counts (the share of
fields in which every piece is regular, so that the count of pieces is a count
of values). Marks that reach the least score separate; fields of one source
may use several of them, even within one field. The statistics are a few rows
per source and are joined back, not collected.

Marks inside enclosing quotation marks ("..." or «...», the former may double a
mark inside) or parentheses do not separate; hyphens, dashes, slashes and raised
dots separate only with blanks around them. Quotation marks enclose only at the
beginning of a value and if what follows their end is a separator or the end.

Defined results: a null, empty or blank field gives no value; a field of one
value gives one; empty pieces take no place; recurring values count each time;
numbering before a value ("1) ", "2. ", "(3) ") and the full stop that closes
the field are dropped; an unclosed quotation mark or parenthesis is an ordinary
character; a null source is a source of its own; other columns pass through
only if named in ``keep``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A blank or an end of the field on either side.
_BETWEEN_BLANKS = r"(?:(?<=^)|(?<=[ \u00a0])){}(?=[ \u00a0]|$)"
#: Candidate marks: name and pattern. The last four are there to be judged, too.
CANDIDATES: list[tuple[str, str]] = [
    ("comma", ","),
    ("semicolon", ";"),
    ("greek_question", ";"),
    ("pipe", r"\|"),
    ("line", r"[\r\n]+"),
    ("tab", r"\t+"),
    ("hyphen", _BETWEEN_BLANKS.format("-")),
    ("dash", _BETWEEN_BLANKS.format("[–—]")),
    ("slash", _BETWEEN_BLANKS.format("/")),
    ("dot", _BETWEEN_BLANKS.format("[·\u0387•]")),
    ("number", r"(?:(?<=^)|(?<=\s))\(?\d{1,3}\)(?=\s)"),
    ("bare_hyphen", r"(?<=\w)-(?=\w)"),
    ("bare_slash", r"(?<=\w)/(?=\w)"),
    ("bare_stop", r"\.(?=\s+\S)"),
    ("and", r"\bκαι\b"),
]
LEAST_SCORE = 0.8
_GUARD = re.compile(r'"(?:[^"]|"")*"|«[^«»]*»|\([^()]*\)')
_EDGE = re.compile(r"^(?:\(?\d{1,3}[).]\s+)")
_BLANK = " \t\r\n\u00a0"
_PATTERNS = {n: re.compile(p) for n, p in CANDIDATES}


def _guards(text: str, marks: re.Pattern | None) -> list[tuple[int, int]]:
    """Spans inside which no mark separates."""
    out, at = [], 0
    while True:
        m = _GUARD.search(text, at)
        if m is None:
            return out
        a, b = m.span()
        if text[a] != "(":
            before, after = text[:a].rstrip(_BLANK), text[b:].lstrip(_BLANK)
            opens = not before or _is_mark(text, len(before) - 1, marks) or (text[:a] != before and _EDGE.match(before.rsplit(" ", 1)[-1] + " ") is not None) or _line_break(text[len(before) : a])
            closes = not after or after[0] in ".,;|;" or _is_mark(text, b + len(text[b:]) - len(after), marks) or _line_break(text[b : len(text) - len(after)]) or re.match(r"\(?\d{1,3}\)\s", after) is not None
            if not (opens and closes):
                at = a + 1
                continue
        out.append((a, b))
        at = b


def _line_break(gap: str) -> bool:
    return any(c in gap for c in "\t\r\n")


def _is_mark(text: str, at: int, marks: re.Pattern | None) -> bool:
    if marks is None:
        return text[at] in ",;|;-–—/··•)"
    m = marks.match(text, at)
    return m is not None or text[at] in ",;|;" and marks.search(text[at]) is not None


def split_field(text: str | None, marks: re.Pattern | None) -> list[str]:
    """The raw pieces between the marks that separate."""
    if text is None:
        return []
    if marks is None:
        return [text]
    if not marks.search(text):
        return [text]
    spans = _guards(text, None)
    out, last, g = [], 0, 0
    for m in marks.finditer(text):
        a, b = m.span()
        while g < len(spans) and spans[g][1] <= a:
            g += 1
        if g < len(spans) and spans[g][0] <= a < spans[g][1]:
            continue
        out.append(text[last:a])
        last = b
    out.append(text[last:])
    return out


def clean_value(piece: str) -> str:
    """A piece without blanks, numbering and enclosing quotation marks."""
    v = piece.strip(_BLANK)
    v = _EDGE.sub("", v).strip(_BLANK)
    if len(v) >= 2 and v[0] == '"' and v[-1] == '"' and re.fullmatch(r'"(?:[^"]|"")*"', v):
        v = v[1:-1].replace('""', '"')
    elif len(v) >= 2 and v[0] == "«" and v[-1] == "»" and "«" not in v[1:-1] and "»" not in v[1:-1]:
        v = v[1:-1]
    return v.strip(_BLANK)


def values_of(text: str | None, marks: re.Pattern | None) -> list[str]:
    """The values of a field in their order."""
    if text is None:
        return []
    t = text.strip(_BLANK)
    if t.endswith(".") and not t.endswith(".."):
        t = t[:-1].rstrip(_BLANK)
    return [v for v in map(clean_value, split_field(t, marks)) if v]


def _regular(v: str) -> bool:
    return bool(v) and (v[0].isupper() or v[0] in "\"«(“" or v[0].isdigit() and any(c.isalpha() for c in v))


def score_marks(df: DataFrame, field: str, source: Column) -> DataFrame:
    """(source, mark, fields, regularity, consistency, score, separates) of every candidate mark."""

    names = [n for n, _ in CANDIDATES]

    @F.pandas_udf("array<struct<mark:string,pieces:int,regular:int,whole:int>>")
    def judge(col: pd.Series) -> pd.Series:
        out = []
        for text in col:
            own = []
            if text is not None and text.strip(_BLANK):
                for n in names:
                    p = _PATTERNS[n]
                    if p.search(text) is None:
                        continue
                    got = [clean_value(x) for x in split_field(text.strip(_BLANK), p)]
                    got = [x.lstrip("\"«(") or x for x in got if x]
                    if len(got) < 2:
                        continue
                    good = sum(map(_regular, got))
                    own.append({"mark": n, "pieces": len(got), "regular": good, "whole": int(good == len(got))})
            out.append(own)
        return pd.Series(out)

    rows = df.select(source.alias("source"), F.explode(judge(F.col(field))).alias("j"))
    rates = rows.groupBy("source", F.col("j.mark").alias("mark")).agg(
        F.count(F.lit(1)).alias("fields"),
        (F.sum("j.regular") / F.sum("j.pieces")).alias("regularity"),
        F.avg("j.whole").alias("consistency"),
    )
    score = F.col("regularity") * F.col("consistency")
    return rates.withColumn("score", score).withColumn("separates", F.col("score") >= LEAST_SCORE)


def split_values(df: DataFrame, key: str, field: str, source: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """(key, *keep, pos, val, n_values): one row per value, ``pos`` from 1."""
    source = F.lit("") if source is None else F.coalesce(source, F.lit(""))
    keep = keep or []
    marks = score_marks(df, field, source).filter("separates").groupBy("source").agg(F.array_sort(F.collect_set("mark")).alias("_marks"))

    @F.pandas_udf("array<string>")
    def values(col: pd.Series, sets: pd.Series) -> pd.Series:
        built: dict[tuple, re.Pattern | None] = {}
        out = []
        for text, names in zip(col, sets):
            k = tuple(names) if names is not None else ()
            if k not in built:
                own = [p for n, p in CANDIDATES if n in k]
                built[k] = re.compile("|".join(own)) if own else None
            out.append(values_of(text, built[k]))
        return pd.Series(out)

    src = df.filter(F.col(field).isNotNull()).select(F.col(key), *keep, F.col(field).alias("_field"), source.alias("source"))
    got = src.join(marks, "source", "left").withColumn("_values", values("_field", "_marks"))
    return got.select(F.col(key), *keep, F.size("_values").alias("n_values"), F.posexplode("_values").alias("pos", "val")).select(
        F.col(key), *keep, (F.col("pos") + 1).cast("int").alias("pos"), "val", "n_values"
    )

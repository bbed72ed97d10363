"""Scalar text functions as Column expressions; each stays inside the JVM."""

from __future__ import annotations

import html
import re
import unicodedata
import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain_letters() -> tuple[str, str]:
    """Every accented letter that decomposes to one lower-case letter and marks, and that letter."""
    src, dst = [], []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        low = unicodedata.normalize("NFC", base).lower().replace("ς", "σ")
        if len(low) == 1 and low != c and c.isalpha():
            src.append(c)
            dst.append(low)
    return "".join(src), "".join(dst)


_SRC, _DST = _plain_letters()
#: Letters and digits of a token, as both Java and RE2 read them.
TOKEN = r"[\p{L}\p{N}_]+"


def fold(c: Column) -> Column:
    """Lower case without diacritics, final sigma as sigma (combining marks dropped)."""
    return F.translate(F.lower(F.translate(F.regexp_replace(c, r"\p{Mn}", ""), _SRC, _DST)), "ς", "σ")


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_query(c: Column) -> Column:
    return squeeze(fold(c))


def cache_key(signature: Column, query: Column) -> Column:
    return F.sha2(F.concat(signature, F.lit("\n"), normalise_query(query)), 256)


def request_key(method: Column, url: Column, items: Column) -> Column:
    """Fingerprint of a request: method, address and its sorted ``k=v`` items."""
    return F.sha2(F.concat_ws("\n", method, url, F.array_join(F.array_sort(items), "\n")), 256)


def citation(number: Column, year: Column) -> Column:
    """``number/year``; null if either is."""
    return F.concat(number.cast("string"), F.lit("/"), year.cast("string"))


def parse_citation(c: Column) -> tuple[Column, Column]:
    """(number, year) of ``N/YYYY``; nulls if it is no citation."""
    n, y = F.regexp_extract(c, r"^\s*(\d{1,9})\s*/\s*(\d{4})\s*$", 1), F.regexp_extract(c, r"^\s*(\d{1,9})\s*/\s*(\d{4})\s*$", 2)
    return n.try_cast("int"), y.try_cast("int")


def safe_int(c: Column) -> Column:
    """The integer a text denotes, else null."""
    return F.trim(c).try_cast("int")


def split_info(c: Column) -> tuple[Column, Column]:
    """Category and chamber of ``CATEGORY - CHAMBER``, cut at the first hyphen; plus signs are blanks."""
    t = squeeze(F.regexp_replace(c, r"\+", " "))
    at = F.instr(t, "-")
    left = F.when(at > 0, F.trim(F.substring(t, F.lit(1), at - 1))).otherwise(t)
    return left, F.when(at > 0, F.trim(F.substring(t, at + 1, F.length(t))))


@F.pandas_udf(T.StringType())
def unescape(col: pd.Series) -> pd.Series:
    """Named and numeric entities resolved; Arrow batches, as the JVM has no table of them."""
    return col.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def text_of_html(c: Column) -> Column:
    """Readable text of a page: scripts dropped, breaks as lines, tags as blanks, entities resolved.

    White space is squeezed, lines are trimmed, and at most one line in a row
    is empty. ``&nbsp`` counts with or without its semicolon.
    """
    t = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(?:p|div|tr)\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    t = unescape(F.regexp_replace(t, r"&nbsp;?", " "))
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t\u00a0\u2000-\u200b]+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def same_case(c: Column) -> Column:
    """Lower case with every sigma alike."""
    return F.translate(F.lower(c), "ς", "σ")


def contains_folded(c: Column, part: str) -> Column:
    """Case-insensitive substring, final sigma as sigma; % and _ of ``part`` stand for themselves."""
    return F.contains(same_case(c), F.lit(part.lower().replace("ς", "σ")))


def pretty_size(c: Column) -> Column:
    """A number of bytes in words: bytes, kB or MB, rounded."""
    return F.when(c < 1 << 10, F.concat(c, F.lit(" bytes"))).when(c < 1 << 20, F.concat(F.round(c / (1 << 10)).cast("int"), F.lit(" kB"))).otherwise(F.concat(F.round(c / (1 << 20)).cast("int"), F.lit(" MB")))


@F.pandas_udf(T.StringType())
def _percent(col: pd.Series, codepage: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else urllib.parse.quote(x.encode(e, errors="replace")) for x, e in zip(col, codepage)], dtype=object)


def form_encode(fields: list[tuple[str, Column]], codepage: str = "cp1253") -> Column:
    """A form body: names and values percent-encoded in the code page of the site (``?`` for what it lacks); nulls are empty."""
    cp = F.lit(codepage)
    return F.concat_ws("&", *[F.concat(_percent(F.lit(k), cp), F.lit("="), _percent(F.coalesce(v.cast("string"), F.lit("")), cp)) for k, v in fields])


#: Endings of inflected words, folded (fixed values of the public Greek suffix
#: stripping algorithm, its last steps).
_ENDINGS = """
α αγατε αγαν αει αμαι αν ασ ασαι αται αω ε ει εισ ειτε εσαι εσ εται ι ιεμαι ιεμαστε ιεται ιεσαι ιεσαστε
ιομασταν ιομουν ιομουνα ιονταν ιοντουσαν ιοσασταν ιοσαστε ιοσουν ιοσουνα ιοταν ιουμα ιουμαστε ιουνται ιουνταν
η ηδεσ ηδων ηθει ηθεισ ηθειτε ηθηκατε ηθηκαν ηθουν ηθω ηκατε ηκαν ησ ησαν ησατε ησει ησεσ ησουν ησω
ο οι ομαι ομασταν ομουν ομουνα ονται ονταν οντουσαν οσ οσασταν οσαστε οσουν οσουνα οταν
ου ουμαι ουμαστε ουν ουνται ουνταν ουσ ουσαν ουσατε υ υσ ω ων
""".split()
END_FIRST = r"^(.*?[^αεηιουω])(ια|ιου|ιων)$"
END_NEUTER = r"^(.+?μα)(τα|των|τοσ)$"
END_LAST = r"^(.+?)(" + "|".join(_ENDINGS) + r")$"
#: Words so short that they keep what stands before the ending list.
KEEP = r"^(αν|την|των|τον)$"


def stem(c: Column) -> Column:
    """The stem of a folded Greek word; other words stay (suffix stripping, reduced to its main steps)."""
    first = F.regexp_replace(c, END_FIRST, "$1")
    neuter = F.regexp_replace(first, END_NEUTER, "$1")
    last = F.regexp_replace(neuter, END_LAST, "$1")
    return F.when(c.rlike(KEEP) | (first != c), first).otherwise(last)


def stem_word(word: str) -> str:
    """``stem`` on the driver, for queries."""
    if re.match(KEEP, word):
        return word
    first = re.sub(END_FIRST, r"\1", word)
    if first != word:
        return first
    return re.sub(END_LAST, r"\1", re.sub(END_NEUTER, r"\1", first))


_PLAIN = str.maketrans(_SRC, _DST)


def fold_word(s: str) -> str:
    """``fold`` on the driver, by the same table."""
    bare = "".join(c for c in s if unicodedata.category(c) != "Mn")
    return bare.translate(_PLAIN).lower().replace("ς", "σ")

"""Archived pages as a source: listings, theme indexes and decision pages.

The pages are old hand-written markup: cells outside rows, attributes without
quotes, entities without semicolons. So nothing is parsed as a tree; a page is
cut where its links begin, and each piece is read by itself, so that a
malformed one cannot borrow from the next. All of it stays in the JVM but the
entities.

Defined results: a null or foreign page gives no rows; of a key that recurs
the first record is taken, unless a later one has a snippet and it has none;
fields that are missing or blank are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import safe_int, split_info, squeeze, text_of_html, unescape

# The forms of the source's pages.
LINK = r"[?&]cd=([A-Za-z0-9]+)&(?:amp;)?apof=(\d+)_(\d+)(?:&(?:amp;)?info=([^\"]*))?"
THEME = r"[?&]s=2&(?:amp;)?code=(\d+)\"[^>]*>([^<]+)"
MORE_ROWS = "περισσότερα από"
CONTENT = r"(?is)<font\s+face=\"Arial\"\s+size=\"3\">"
HEAD = r"(?isu)Απόφαση\s*<b>\s*(\d+)\s*/\s*(\d+)\s*</b>(?:[^()<]|<[^>]+>)*?\(\s*([^)]*?)\s*\)"
SUBJECT = r"(?isu)<b>\s*Θέμα\s*:?\s*</b>\s*(?:<br\s*/?>)?(.*?)</i>"
_BODY = r"<p\s+align=['\"]?justify['\"]?\s+style=['\"]line-height:\s*160%"
SUMMARY = rf"(?isu)<b>\s*Περίληψη\s*:?\s*</b>\s*(?:<br\s*/?>)?(.*?)(?={_BODY})"
BODY = rf"(?is){_BODY}['\"]\s*>(.*?)(?=<p\s+align=['\"]?center['\"]?|</font>|</body>)"


def _full(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _blank(c: Column) -> Column:
    return _full(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def references(pages: DataFrame, html: str, order: str | None = None) -> DataFrame:
    """(page, pos, cd, number, year, category, chamber, snippet): every link to a decision, as it stands in its page."""
    page = F.lit(0) if order is None else F.col(order)
    cut = F.split(html, rf"(?i)(?={LINK})")
    pieces = pages.select(page.alias("page"), F.posexplode(cut).alias("pos", "piece"))
    part = lambda k: F.regexp_extract("piece", f"(?i)^{LINK}", k)
    got = pieces.filter(F.col("piece").rlike(f"(?i)^{LINK}")).select(
        "page",
        "pos",
        part(1).alias("cd"),
        safe_int(part(2)).alias("number"),
        safe_int(part(3)).alias("year"),
        text_of_html(part(4)).alias("info"),
        _full(text_of_html(F.regexp_extract("piece", r"(?is)^[^>]*>.*?</a>\s*</td>\s*<td[^>]*>(.*?)</td>", 1))).alias("snippet"),
    )
    category, chamber = split_info(F.col("info"))
    return got.select("page", "pos", "cd", "number", "year", _full(category).alias("category"), _full(chamber).alias("chamber"), "snippet")


def absorbed(refs: DataFrame, key: str, text: str, order: list[str]) -> DataFrame:
    """One record of every key: the first in ``order``, unless it lacks ``text`` and a later one has it."""
    rest = [c for c in refs.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(F.col(text).isNull().alias("without"), *order)).alias("b")
    return refs.groupBy(key).agg(best).select(key, *[F.col(f"b.{c}").alias(c) for c in rest])


def listing(pages: DataFrame, html: str, order: str | None = None) -> DataFrame:
    """(cd, number, year, category, chamber, snippet) of all references of all listing pages, one per key."""
    return absorbed(references(pages, html, order), "cd", "snippet", ["page", "pos"]).drop("page", "pos")


def truncated(html: Column, marker: str = MORE_ROWS) -> Column:
    """Whether a listing says that it leaves rows out."""
    return F.contains(html, F.lit(marker))


def theme_index(pages: DataFrame, html: str) -> DataFrame:
    """(code, label, slug) of all theme links, the first of a code; underscores of the slug are blanks in the label."""
    rows = pages.select(F.posexplode(F.regexp_extract_all(html, F.lit(f"(?i){THEME}"), F.lit(0))).alias("pos", "row"))
    got = rows.select("pos", safe_int(F.regexp_extract("row", f"(?i){THEME}", 1)).alias("code"), _blank(unescape(F.regexp_extract("row", f"(?i){THEME}", 2))).alias("slug"))
    first = got.filter("code is not null and slug is not null").groupBy("code").agg(F.min_by("slug", F.struct("pos", "slug")).alias("slug"))
    return first.select("code", _blank(F.translate("slug", "_", " ")).alias("label"), "slug").filter("label is not null")


def decision_page(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, number, year, chamber, category, subject, summary, body, subjects) of decision pages.

    What stands before the content is left out. A heading names the chamber
    before the category, or the category alone; subjects are cut at commas and
    lose blanks and full stops at their ends; without a body of the usual form
    all text of the content is the body.
    """
    at = F.regexp_instr(F.col(html), F.lit(CONTENT))
    region = F.when(at > 0, F.substring(F.col(html), at, F.length(html))).otherwise(F.col(html))
    p = pages.select(key, region.alias("region")).select(key, "region", *[F.regexp_extract("region", HEAD, k).alias(f"head{k}") for k in (1, 2, 3)])
    named = F.filter(F.transform(F.split(text_of_html(F.col("head3")), ","), squeeze), lambda x: x != "")
    body = F.regexp_extract("region", BODY, 1)
    p = p.select(
        key,
        safe_int(F.col("head1")).alias("number"),
        safe_int(F.col("head2")).alias("year"),
        named.alias("named"),
        _full(text_of_html(F.regexp_extract("region", SUBJECT, 1))).alias("subject"),
        _full(text_of_html(F.regexp_extract("region", SUMMARY, 1))).alias("summary"),
        text_of_html(F.when(F.col("region").rlike(BODY), body).otherwise(F.col("region"))).alias("body"),
    )
    several = F.size("named") >= 2
    subjects = F.filter(F.transform(F.split("subject", ","), lambda x: F.regexp_replace(x, r"(?U)^[\s.]+|[\s.]+$", "")), lambda x: x != "")
    return p.select(
        key,
        "number",
        "year",
        F.when(several, F.try_element_at("named", F.lit(1))).alias("chamber"),
        F.when(several, F.try_element_at("named", F.lit(2))).otherwise(F.try_element_at("named", F.lit(1))).alias("category"),
        "subject",
        "summary",
        "body",
        F.coalesce(subjects, F.array().cast("array<string>")).alias("subjects"),
    )


def with_fallback(pages: DataFrame, other: DataFrame, key: str, body: str, least: int = 400) -> DataFrame:
    """Bodies shorter than ``least`` are replaced by those of ``other`` (key, json), where its status is success."""
    alt = other.select(F.col(key).alias("k"), F.from_json("json", "status string, text string").alias("j"))
    text = F.when(F.col("j.status") == "success", F.nullif(F.trim("j.text"), F.lit("")))
    got = pages.join(alt, F.col(key) == F.col("k"), "left")
    return got.withColumn(body, F.when(F.coalesce(F.length(body), F.lit(0)) < least, F.coalesce(text, F.col(body))).otherwise(F.col(body))).drop("k", "j")


def merged(pages: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Decision pages with what they lack taken from the listing: number, year, category, chamber, and the snippet as summary."""
    r = refs.select(F.col(key).alias("k"), *[F.col(c).alias(f"r_{c}") for c in ("number", "year", "category", "chamber", "snippet")])
    there = lambda c: _full(F.col(c)) if c in ("category", "chamber", "summary") else F.nullif(F.col(c), F.lit(0))
    pick = {c: F.coalesce(there(c), F.col(f"r_{'snippet' if c == 'summary' else c}")) for c in ("number", "year", "category", "chamber", "summary")}
    both = pages.join(r, F.col(key) == F.col("k"), "left")
    return both.select(*[pick[c].alias(c) if c in pick else F.col(c) for c in pages.columns])

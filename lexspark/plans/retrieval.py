"""Queries over text functions, passages, full-text, vectors and fusion, with SQL twins where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators import chunking, fulltext, fusion, vector
from lexspark.plans.relational import CUR, META, current, current_of, links, meta
from lexspark.sources import pages as P
from lexspark.sources.tables import stored, table

QUERIES = {}
SQL = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


#: A query that the data can answer.
SEARCH = "παραγραφή της αξίωσης"
PHRASE = '"ήταν ανάλογο προς τη ζημία" -καταγγελία'

_FOLD = "replace(lower(strip_accents({})), 'ς', 'σ')"
_CHUNKS = "(SELECT DISTINCT id, cd, part, content FROM chunk WHERE content IS NOT NULL)"


def sql_stem(c: str) -> str:
    first = f"regexp_replace({c}, '{text.END_FIRST}', '\\1')"
    rest = f"regexp_replace(regexp_replace({c}, '{text.END_NEUTER}', '\\1'), '{text.END_LAST}', '\\1')"
    return f"CASE WHEN regexp_matches({c}, '{text.KEEP}') OR {first} <> {c} THEN {first} ELSE {rest} END"


_TOKENS = f"SELECT id AS doc, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT id, regexp_extract_all(content, '{text.TOKEN}') AS t FROM {_CHUNKS})"
_POSTINGS = f"SELECT doc, {sql_stem('f')} AS lexeme, pos FROM (SELECT doc, pos, {_FOLD.format('word')} AS f FROM ({_TOKENS}))"


def chunks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunk").filter("id is not null and content is not null").select("id", "cd", "part", "ordinal", "content", "embedding").dropDuplicates(["id"])


def chunk_ids(spark: SparkSession, root: str) -> DataFrame:
    """(doc) of every passage."""
    return table(spark, root, "chunk").filter("id is not null and content is not null").select(F.col("id").alias("doc")).distinct()


def chunk_index(spark: SparkSession, root: str) -> DataFrame:
    """The postings of all passages, written once for a state of the table, in the order of lexemes."""
    return stored(spark, root, ["chunk"], "passages", lambda: fulltext.postings(chunks(spark, root), "id", "content"), fulltext.write_index)


def doc_index(spark: SparkSession, root: str) -> DataFrame:
    make = lambda: fulltext.weighted_postings(current(spark, root, "cd", "body", "summary", "subject"), "cd", {"subject": "A", "summary": "B", "body": "C"})
    return stored(spark, root, ["decision"], "documents", make, fulltext.write_index)


# ---- text functions


@query(f"SELECT code, {_FOLD.format('label')} AS folded FROM theme")
def txt01(spark, root):
    return table(spark, root, "theme").select("code", text.fold(F.col("label")).alias("folded"))


@query(f"SELECT code, trim(regexp_replace({_FOLD.format('slug')}, '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')) AS norm FROM theme")
def txt03(spark, root):
    return table(spark, root, "theme").select("code", text.normalise_query(F.col("slug")).alias("norm"))


@query(f"SELECT code, sha256('hash:64' || chr(10) || trim(regexp_replace({_FOLD.format('label')}, '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))) AS key FROM theme")
def txt04(spark, root):
    return table(spark, root, "theme").select("code", text.cache_key(F.lit("hash:64"), F.col("label")).alias("key"))


@query(f"SELECT cd, sha256(body) AS digest FROM {CUR} WHERE body IS NOT NULL")
def txt05(spark, root):
    return current_of(spark, root, digest=F.sha2("body", 256)).filter("digest is not null")


def _markup(c) -> str:
    """Text as it stands in a page: special characters and blanks that do not break as entities."""
    t = F.coalesce(F.col(c), F.lit(""))
    for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\u00a0", "&nbsp;")):
        t = F.replace(t, F.lit(x), F.lit(y))
    return F.replace(t, F.lit("\n"), F.lit("<br>"))


def _rows_of_a_page(n: int = 200):
    """Groups of about n rows, however many there are."""
    return lambda df, key: F.pmod(F.xxhash64(key), F.lit(max(1, -(-df.count() // n)))).cast("int")


def listing_pages(spark: SparkSession, root: str) -> DataFrame:
    """(page, html): the current decisions as listings in the form of the source, some 200 to a page."""
    d = current(spark, root, "cd", "number", "year", "category", "chamber", "subject").filter("number is not null and year is not null")
    row = F.concat(
        F.lit('<td width=100 valign=top>\n<a onmouseout="this.x = 1;" class="blue" href="show.asp?cd='), "cd", F.lit("&apof="), "number", F.lit("_"), "year",
        F.lit("&info="), _markup("category"), F.lit(" -  "), _markup("chamber"), F.lit('">'), "number", F.lit("/"), "year", F.lit('</a>\t</td>\n<td class="black10">'), F.coalesce(F.nullif(_markup("subject"), F.lit("")), F.lit("&nbsp")), F.lit("</td></tr>"),
    )
    pages = d.withColumn("page", _rows_of_a_page()(d, "cd")).groupBy("page").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    return pages.select("page", F.concat(F.lit('<script>var a = "<b>";</script><table><tr>'), "rows", F.lit("</table>")).alias("html"))


#: White space as the page parser sees it: blanks squeezed, lines trimmed, one empty line at most.
_SQUEEZED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\r\\n?', chr(10), 'g'), '[ \\t\\x{{a0}}\\x{{2000}}-\\x{{200b}}]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\x{{1680}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\s\\x{{1680}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g')"


def squeezed(c: str) -> str:
    return _SQUEEZED.format(c)


@query(f"SELECT cd, {squeezed('coalesce(subject, chr(32))')} AS shown FROM {CUR}")
def txt06(spark, root):
    html = F.concat(F.lit("<style>p {x: y}</style><p>"), _markup("subject"), F.lit("</p><SCRIPT>if (a<b) c</SCRIPT>"))
    return current(spark, root, "cd", "subject").select("cd", text.text_of_html(html).alias("shown"))


@query("SELECT doc_id, count(*) AS n_tokens, count(DISTINCT lower(w)) AS n_distinct FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM documents) GROUP BY doc_id")
def txt07(spark, root):
    w = table(spark, root, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(text.TOKEN), F.lit(0))).alias("w"))
    sigma = F.lower("w")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct(F.when(F.col("w").endswith("Σ"), F.concat(F.expr("lower(left(w, length(w) - 1))"), F.lit("σ"))).otherwise(sigma)).alias("n_distinct"))


@query("SELECT code, regexp_replace(label, '[^\\p{L}\\p{N}_]', '', 'g') AS safe FROM theme")
def txt08(spark, root):
    return table(spark, root, "theme").select("code", F.regexp_replace("label", r"[^\p{L}\p{N}_]", "").alias("safe"))


_ONE_LINE = "trim(regexp_replace({}, '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT cd, {_ONE_LINE.format("replace(coalesce(category, '') || '+-+' || coalesce(chamber, ''), '+', ' ')")} AS t FROM {CUR})
    SELECT cd, trim(CASE WHEN contains(t, '-') THEN left(t, strpos(t, '-') - 1) ELSE t END) AS left_part, CASE WHEN contains(t, '-') THEN trim(substr(t, strpos(t, '-') + 1)) END AS right_part FROM t""")
def txt09(spark, root):
    a, b = text.split_info(F.concat(F.coalesce("category", F.lit("")), F.lit("+-+"), F.coalesce("chamber", F.lit(""))))
    return current(spark, root, "cd", "category", "chamber").select("cd", a.alias("left_part"), b.alias("right_part"))


@query(f"""WITH i AS (SELECT cd, number, year, subject, trim(regexp_replace({squeezed("coalesce(category, '') || ' -  ' || coalesce(chamber, '')")}, '\\s+', ' ', 'g')) AS t FROM {CUR} WHERE number IS NOT NULL AND year IS NOT NULL)
    SELECT cd, number, year, nullif(trim(CASE WHEN contains(t, '-') THEN left(t, strpos(t, '-') - 1) ELSE t END), '') AS category, CASE WHEN contains(t, '-') THEN nullif(trim(substr(t, strpos(t, '-') + 1)), '') END AS chamber, nullif({squeezed('subject')}, '') AS snippet FROM i""")
def txt10(spark, root):
    return P.listing(listing_pages(spark, root), "html", "page")


_EDGES = "regexp_replace({}, '^[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g')"


@query(f"SELECT code, {_EDGES.format("replace(label, '_', ' ')")} AS label, {_EDGES.format('label')} AS slug FROM theme WHERE {_EDGES.format('label')} <> ''")
def txt11(spark, root):
    t = table(spark, root, "theme").filter("code is not null")
    row = F.concat(F.lit('<li><a href="result.asp?s=2&amp;code='), "code", F.lit('" class=x>'), _markup("label"), F.lit("</a>"))
    html = t.withColumn("page", _rows_of_a_page(100)(t, "code")).groupBy("page").agg(F.concat_ws("", F.collect_list(row)).alias("html"))
    return P.theme_index(html, "html")


@query(f"""WITH d AS (SELECT cd, number, year, nullif({squeezed('subject')}, '') AS subject, nullif({squeezed('summary')}, '') AS summary, {squeezed('body')} AS body FROM {CUR} WHERE number IS NOT NULL AND year IS NOT NULL AND body IS NOT NULL)
    SELECT cd, number, year, 'Γ' AS chamber, 'ΠΟΛΙΤΙΚΕΣ' AS category, subject, summary, sha256(body) AS digest,
    array_to_string(list_filter(list_transform(string_split(subject, ','), lambda x: regexp_replace(x, '^[\\s.\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\s.\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g')), lambda x: x <> ''), '|') AS subjects FROM d""")
def txt12(spark, root):
    d = current(spark, root, "cd", "number", "year", "subject", "summary", "body").filter("number is not null and year is not null and body is not null")
    named = lambda label, c, end: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<i><b>{label}:</b><br>"), _markup(c), F.lit(end))).otherwise("")
    html = F.concat(
        F.lit('<body>Επιστροφή<script>ask("<b>");</script><font face="Arial" size="3"><p>Απόφαση <b>'), "number", F.lit(" / "), "year", F.lit("</b>&nbsp <u>(Γ, ΠΟΛΙΤΙΚΕΣ)</u>"),
        named("Θέμα", "subject", "</i>"), named("Περίληψη", "summary", "</i>"), F.lit("<p align=justify style='line-height: 160%'>"), _markup("body"), F.lit("<p align=center><a>Επιστροφή</a></font></body>"),
    )
    got = P.decision_page(d.select("cd", html.alias("html")), "cd", "html")
    return got.select("cd", "number", "year", "chamber", "category", "subject", "summary", F.sha2("body", 256).alias("digest"), F.when(F.col("subject").isNotNull(), F.array_join("subjects", "|")).alias("subjects"))


@query(f"SELECT cd, CASE WHEN year IS NOT NULL THEN coalesce(trim(summary), '') ELSE '' END AS text FROM {CUR}")
def txt13(spark, root):
    """The text of an answer whose status is success, else nothing."""
    d = current(spark, root, "cd", "year", "summary")
    j = F.to_json(F.struct(F.when(F.col("year").isNotNull(), "success").otherwise("error").alias("status"), F.col("summary").alias("text")))
    got = d.select("cd", F.from_json(j, "status string, text string").alias("j"))
    return got.select("cd", F.when(F.col("j.status") == "success", F.coalesce(F.trim("j.text"), F.lit(""))).otherwise("").alias("text"))


@query(f"SELECT code, 'label=' || array_to_string(list_transform(string_split(label, ''), lambda c: CASE WHEN regexp_matches(c, '[A-Za-z0-9_.~/-]') THEN c WHEN c BETWEEN 'Α' AND 'Ρ' OR c BETWEEN 'Σ' AND 'ώ' THEN '%' || printf('%02X', unicode(c) - 720) WHEN c = ' ' THEN '%20' ELSE '%' END), '') || '&code=' || code AS body FROM theme WHERE regexp_full_match(label, '[A-Za-z0-9_.~/ Α-ΡΣ-ώ-]*')")
def txt15(spark, root):
    """Form bodies in the code page of the site, of labels that it holds wholly."""
    t = table(spark, root, "theme").filter(F.col("label").rlike("^[A-Za-z0-9_.~/ Α-ΡΣ-ώ-]*$"))
    return t.select("code", text.form_encode([("label", F.col("label")), ("code", F.col("code"))]).alias("body"))


@query("SELECT event_id, try_cast(user_id::VARCHAR AS INT) AS as_int, try_cast(event_type AS INT) AS no_int FROM events")
def txt14(spark, root):
    return table(spark, root, "events").select("event_id", text.safe_int(F.col("user_id").cast("string")).alias("as_int"), text.safe_int(F.col("event_type")).alias("no_int"))


@query(f"SELECT cd, number AS n, year AS y FROM {CUR}")
def txt16(spark, root):
    d = current(spark, root, "cd", "number", "year")
    n, y = text.parse_citation(text.citation(F.col("number"), F.col("year")))
    both = F.col("number").isNotNull() & F.col("year").isNotNull()
    return d.select("cd", F.when(both, n).otherwise(F.col("number")).alias("n"), F.when(both, y).otherwise(F.col("year")).alias("y"))


# ---- passages


@query(f"SELECT cd, (i - 1)::INT AS n, length(p[i])::INT AS chars FROM (SELECT cd, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT cd, list_filter(string_split(regexp_replace(body, '({'|'.join(chunking.HEADINGS)})', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> '') AS p FROM {CUR} WHERE body IS NOT NULL AND body <> ''))")
def chk01(spark, root):
    """Sections of every current body; they tile it exactly."""
    marks = "|".join(chunking.HEADINGS)
    d = current(spark, root, "cd", "body").filter("body is not null and body <> ''")
    parts = d.select("cd", F.posexplode(F.split("body", f"(?U)(?={marks})")).alias("n", "section"))
    return parts.select("cd", "n", F.length("section").alias("chars"))


@query(None)
def chk04(spark, root):
    return chunking.chunk_documents(current(spark, root, "cd", "subject", "summary", "body"))


# ---- full text


@query(f"SELECT lexeme, count(*) AS n, count(DISTINCT doc) AS docs FROM ({_POSTINGS}) GROUP BY lexeme")
def fts01(spark, root):
    return chunk_index(spark, root).groupBy("lexeme").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc").alias("docs"))


@query(f"SELECT {_FOLD.format('word')} AS lexeme, count(*) AS n FROM ({_TOKENS}) GROUP BY 1")
def fts02(spark, root):
    return fulltext.postings(chunks(spark, root), "id", "content", stemmed=False).groupBy("lexeme").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc, lexeme, pos FROM ({_POSTINGS})")
def fts03(spark, root):
    return chunk_index(spark, root).select("doc", "lexeme", "pos")


@query(f"""SELECT cd AS doc, weight, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM (
    WITH p AS (SELECT cd, regexp_extract_all(coalesce(subject, ''), '{text.TOKEN}') AS a, regexp_extract_all(coalesce(summary, ''), '{text.TOKEN}') AS b, regexp_extract_all(coalesce(body, ''), '{text.TOKEN}') AS c FROM {CUR})
    SELECT cd, 'A' AS weight, generate_subscripts(a, 1) AS pos FROM p UNION ALL SELECT cd, 'B', generate_subscripts(b, 1) + len(a) FROM p UNION ALL SELECT cd, 'C', generate_subscripts(c, 1) + len(a) + len(b) FROM p) GROUP BY cd, weight""")
def fts04(spark, root):
    return doc_index(spark, root).groupBy("doc", "weight").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(f"SELECT doc, array_to_string(list_sort(list(DISTINCT lexeme)), ' ') AS lexemes FROM ({_POSTINGS}) GROUP BY doc")
def fts05(spark, root):
    return chunk_index(spark, root).groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("lexeme")), " ").alias("lexemes"))


def _all_of(q: str) -> str:
    terms = fulltext.plan(q).terms
    conds = [f"bool_or(starts_with(lexeme, '{t.words[0]}'))" if t.prefix else f"bool_or(lexeme = '{t.words[0]}')" for t in terms]
    return " AND ".join(conds)


def _has(lexeme: str, t: fulltext.Term) -> str:
    return f"starts_with({lexeme}, '{t.words[0]}')" if t.prefix else f"{lexeme} = '{t.words[0]}'"


def sql_scores(postings: str, terms: tuple[fulltext.Term, ...], where: str = "true") -> str:
    """(doc, score): cover density of all the terms over postings (doc, lexeme, pos, w), in SQL."""
    ranks = ", ".join(f"max(CASE WHEN term = {i} THEN pos END) OVER (PARTITION BY doc ORDER BY pos RANGE UNBOUNDED PRECEDING) AS l{i}" for i in range(len(terms)))
    every, start = " AND ".join(f"l{i} IS NOT NULL" for i in range(len(terms))), f"least({', '.join(f'l{i}' for i in range(len(terms)))})"
    occ = " UNION ALL ".join(f"SELECT doc, pos, w, {i} AS term FROM ({postings}) WHERE {_has('lexeme', t)} AND {where}" for i, t in enumerate(terms))
    return f"""WITH o AS ({occ}), l AS (SELECT doc, pos, {ranks} FROM o),
        c AS (SELECT doc, {start} AS a, min(pos) AS b FROM l WHERE {every} GROUP BY 1, 2),
        d AS (SELECT c.doc, a, b, count(*) AS n, sum(1 / w) AS inv FROM c JOIN o ON o.doc = c.doc AND o.pos BETWEEN a AND b GROUP BY 1, 2, 3),
        r AS (SELECT doc, sum(n / inv / (1 + greatest(0, b - a + 1 - n))) AS r FROM d GROUP BY doc)
        SELECT doc, r / (r + 1) AS score FROM r"""


_WEIGHTED = f"SELECT doc, lexeme, pos, 0.1::DOUBLE AS w FROM ({_POSTINGS})"
_DOC_TOKENS = f"""SELECT cd AS doc, word, pos, w FROM (
    WITH p AS (SELECT cd, regexp_extract_all(coalesce(subject, ''), '{text.TOKEN}') AS a, regexp_extract_all(coalesce(summary, ''), '{text.TOKEN}') AS b, regexp_extract_all(coalesce(body, ''), '{text.TOKEN}') AS c FROM {CUR})
    SELECT cd, unnest(a) AS word, generate_subscripts(a, 1) AS pos, 1.0::DOUBLE AS w FROM p UNION ALL SELECT cd, unnest(b), generate_subscripts(b, 1) + len(a), 0.4::DOUBLE FROM p UNION ALL SELECT cd, unnest(c), generate_subscripts(c, 1) + len(a) + len(b), 0.2::DOUBLE FROM p)"""
_DOC_POSTINGS = f"SELECT doc, {sql_stem('f')} AS lexeme, pos, w FROM (SELECT doc, pos, w, {_FOLD.format('word')} AS f FROM ({_DOC_TOKENS}))"
_TERMS = fulltext.plan(SEARCH).terms


@query(f"SELECT doc FROM ({_POSTINGS}) GROUP BY doc HAVING {_all_of(SEARCH)}")
def fts06(spark, root):
    return fulltext.search(chunk_index(spark, root), chunk_ids(spark, root), fulltext.plan(SEARCH)).select("doc")


@query(f"SELECT doc, round(score, 9) AS score FROM ({sql_scores(_DOC_POSTINGS, _TERMS)})")
def fts07(spark, root):
    """Cover density over whole documents, their fields weighted."""
    hits = fulltext.search(doc_index(spark, root), current(spark, root, "cd").select(F.col("cd").alias("doc")), fulltext.plan(SEARCH))
    return hits.select("doc", F.round("score", 9).alias("score"))


@query(f"SELECT DISTINCT doc FROM ({_POSTINGS}) WHERE starts_with(lexeme, '{fulltext.plan('διαθήκης').terms[0].words[0]}')")
def fts08(spark, root):
    return fulltext.search(chunk_index(spark, root), chunk_ids(spark, root), fulltext.plan("διαθήκης")).select("doc")


_PHRASE = fulltext.plan(PHRASE).groups[0]


@query(
    "WITH p AS (" + _POSTINGS + ") SELECT DISTINCT p0.doc FROM p AS p0 "
    + " ".join(f"JOIN p AS p{i} ON p{i}.doc = p0.doc AND p{i}.pos = p0.pos + {i} AND p{i}.lexeme = '{w}'" for i, w in enumerate(_PHRASE[0].words) if i)
    + f" WHERE p0.lexeme = '{_PHRASE[0].words[0]}' AND p0.doc NOT IN (SELECT doc FROM p WHERE lexeme = '{_PHRASE[1].words[0]}')"
)
def fts11(spark, root):
    return fulltext.search(chunk_index(spark, root), chunk_ids(spark, root), fulltext.plan(PHRASE)).select("doc")


_WORDS = f"(SELECT unnest(regexp_extract_all(content, '{text.TOKEN}')) AS w FROM {_CHUNKS})"
_IS_ACRONYM = r"(length(w) BETWEEN 2 AND 6 AND (regexp_matches(w, '^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$') OR regexp_matches(w, '^[^\p{L}]*\p{Lu}.*\p{Lu}')))"


@query(f"SELECT w AS word, count(*) AS n FROM {_WORDS} WHERE {_FOLD.format('w')} NOT IN ({', '.join(repr(x) for x in sorted(fulltext.STOPWORDS))}) OR {_IS_ACRONYM} OR regexp_matches(w, '\\p{{N}}') GROUP BY w")
def fts12(spark, root):
    """The words of passages that would search: function words go, acronyms and words with digits stay."""
    w = chunks(spark, root).select(F.explode(F.regexp_extract_all("content", F.lit(text.TOKEN), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(fulltext.searches(F.col("word")))


@query(f"SELECT w AS word, count(*) AS n FROM {_WORDS} WHERE {_IS_ACRONYM} GROUP BY w")
def fts13(spark, root):
    w = chunks(spark, root).select(F.explode(F.regexp_extract_all("content", F.lit(text.TOKEN), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("word").rlike(fulltext.ACRONYM))


#: Terms that hardly meet in one passage.
RARELY = "παραγραφή διαθήκης καταγγελία ναυλώτρια"


def _any_of(q: str) -> str:
    return " OR ".join(_all_of(q).split(" AND "))


@query(f"""WITH p AS (SELECT doc, {_all_of(RARELY).replace('bool_or', 'bool_or')} AS hit_all, {_any_of(RARELY)} AS hit_any FROM ({_POSTINGS}) GROUP BY doc)
    SELECT doc FROM p WHERE CASE WHEN (SELECT count(*) FROM p WHERE hit_all) >= {fulltext.LEAST_HITS} THEN hit_all ELSE hit_any END""")
def fts14(spark, root):
    """Fewer than five passages hold all terms, so any of them will do."""
    return fulltext.search_relaxed(chunk_index(spark, root), chunk_ids(spark, root), fulltext.plan(RARELY)).select("doc")


@query(None)
def fts15(spark, root):
    hits = fts06(spark, root).withColumnRenamed("doc", "id")
    found = chunks(spark, root).select("id", "content").join(hits, "id", "left_semi")
    return found.select("id", fulltext.headline(F.col("content"), fulltext.plan(SEARCH)).alias("headline"))


@query(f"SELECT doc, round(score, 9) AS score FROM ({sql_scores(_WEIGHTED, _TERMS)}) ORDER BY round(score, 9) DESC, doc LIMIT {fusion.POOL}")
def fts16(spark, root):
    p = fulltext.search(chunk_index(spark, root), chunk_ids(spark, root), fulltext.plan(SEARCH))
    return p.select("doc", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc").limit(fusion.POOL)


# ---- vectors

_Q = "(SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))))"


def first_vector(spark: SparkSession, root: str) -> list[float]:
    """The query vector of the tests: that of the least vec_id."""
    return [float(x) for x in table(spark, root, "embeddings").orderBy("vec_id").first()["embedding"]]


@query(f"SELECT vec_id, round({_COS.format(a='embedding', b='q')}, 9) AS score FROM embeddings, {_Q}")
def vec01(spark, root):
    q = F.array(*[F.lit(x) for x in first_vector(spark, root)])
    return table(spark, root, "embeddings").select("vec_id", F.round(vector.cosine(F.col("embedding"), q), 9).alias("score"))


@query(f"SELECT vec_id FROM (SELECT vec_id, {_COS.format(a='embedding', b='q')} AS s FROM embeddings, {_Q}) ORDER BY s DESC, vec_id LIMIT 20")
def vec02(spark, root):
    return vector.nearest(table(spark, root, "embeddings"), "vec_id", "embedding", first_vector(spark, root), 20).select("vec_id")


@query("""WITH v AS (SELECT DISTINCT id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM chunk WHERE len(embedding) > 0 AND content IS NOT NULL)
    SELECT id, round(CASE WHEN n > 0 THEN e[1]::DOUBLE / n ELSE e[1]::DOUBLE END, 9) AS first, round(CASE WHEN n > 0 THEN e[len(e)]::DOUBLE / n ELSE e[len(e)]::DOUBLE END, 9) AS last FROM v""")
def vec03(spark, root):
    k = chunks(spark, root).filter("size(embedding) > 0").withColumn("u", vector.normalise(F.col("embedding")))
    return k.select("id", F.round(F.element_at("u", 1), 9).alias("first"), F.round(F.element_at("u", -1), 9).alias("last"))


@query("SELECT dim, CASE WHEN dim = 64 THEN 'fits' ELSE 'vec: refused, held are 64 of local:hash:64' END AS outcome FROM (SELECT len(embedding)::INT AS dim FROM (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)) UNION ALL SELECT 32, 'vec: refused, held are 64 of local:hash:64'")
def vec04(spark, root):
    """A query vector of the declared length fits, another one is refused by name."""
    e = table(spark, root, "embeddings").select(F.col("embedding").alias("vec", metadata={"dim": 64, "model": "local:hash:64"}))
    rows = []
    for q in (first_vector(spark, root), [0.0] * 32):
        try:
            vector.check_dim(e, "vec", len(q))
            rows.append((len(q), "fits"))
        except ValueError as x:
            m = re.search(r"^(\w+) holds vectors of (\d+) dimensions \(model (.+?)\)", str(x))
            rows.append((len(q), f"{m[1]}: refused, held are {m[2]} of {m[3]}"))
    return spark.createDataFrame(rows, "dim int, outcome string")


@query("""WITH w AS (SELECT code, unnest(string_split(trim(regexp_replace(lower(regexp_replace(slug, 'Σ([^\\p{L}]|$)', 'ς\\1', 'g')), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')), ' ')) AS w FROM theme WHERE slug IS NOT NULL),
    c AS (SELECT code, (('0x' || substr(md5(w), 1, 16))::UBIGINT % 64)::INT AS slot, count(*) AS n FROM w WHERE w <> '' GROUP BY 1, 2)
    SELECT code, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY code)), 9) AS value FROM c""")
def vec05(spark, root):
    return vector.hash_embed(table(spark, root, "theme"), "code", "slug", 64).select("code", "slot", F.round("value", 9).alias("value"))


# ---- fusion


def _two_lists(spark, root):
    d = current(spark, root, "cd", "year", "number")
    a = d.filter("year is not null").select("cd", F.col("year").alias("score"))
    b = d.filter("number is not null").select("cd", F.col("number").alias("score"))
    return fusion.ranked(a, "cd", "a").unionByName(fusion.ranked(b, "cd", "b"))


_RANKED = f"""SELECT * FROM (SELECT 'a' AS source, cd AS doc, row_number() OVER (ORDER BY year DESC, cd) AS rank FROM {CUR} WHERE year IS NOT NULL
    UNION ALL SELECT 'b', cd, row_number() OVER (ORDER BY number DESC, cd) FROM {CUR} WHERE number IS NOT NULL) WHERE rank <= {fusion.POOL}"""


@query(f"SELECT doc, round(sum(CASE source WHEN 'a' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END / (60 + rank)), 9) AS score FROM ({_RANKED}) GROUP BY doc")
def fus01(spark, root):
    return fusion.fuse(_two_lists(spark, root), {"a": 1.0, "b": 0.5}).select("doc", F.round("score", 9).alias("score"))


@query(f"SELECT doc, string_agg(source || ':' || rank, ',' ORDER BY source) AS ranks FROM ({_RANKED}) GROUP BY doc")
def agg08(spark, root):
    f = fusion.fuse(_two_lists(spark, root), {"a": 1.0, "b": 0.5})
    return f.select("doc", F.array_join(F.transform(F.map_entries("ranks"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",").alias("ranks"))


@query(f"SELECT doc FROM (SELECT doc, sum(CASE source WHEN 'a' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END / (60 + rank)) AS s, min(CASE source WHEN 'a' THEN rank ELSE 1000000 + rank END) AS seen FROM ({_RANKED}) GROUP BY doc) ORDER BY round(s, 12) DESC, seen LIMIT 20")
def top05(spark, root):
    return fusion.top(fusion.fuse(_two_lists(spark, root), {"a": 1.0, "b": 0.5}).withColumn("score", F.round("score", 12)), 20, ("a", "b")).select("doc")


def shown(spark: SparkSession, root: str) -> DataFrame:
    """What a result shows of a decision."""
    d = current(spark, root, "cd", "category", "chamber", "subject", "summary", "source_url")
    return d.join(meta(spark, root).select("cd", "citation", "themes"), "cd").withColumnRenamed("source_url", "url")


def _hybrid(spark: SparkSession, root: str, mode: str, **more) -> DataFrame:
    c = chunks(spark, root)
    vec = first_vector(spark, root) if mode != "keyword" else None
    out = fusion.hybrid(current(spark, root, "cd", "year", "number", "category", "chamber"), c, chunk_index(spark, root), doc_index(spark, root), SEARCH, vec, mode, where=F.col("year") >= 2000, meta=shown(spark, root), **more)
    return out.withColumns({"matched_by": F.array_join("matched_by", ","), "themes": F.array_join("themes", "|")})


_YEAR = "(SELECT cd FROM " + CUR + " WHERE year >= 2000)"
_BY_SOURCE = {
    "chunk_lexical": f"SELECT cd AS doc, max(score) AS score, min(id) AS tie FROM (SELECT k.cd, k.id, s.score FROM ({sql_scores(_WEIGHTED, _TERMS, f'doc IN (SELECT id FROM chunk WHERE cd IN {_YEAR})')}) s JOIN {_CHUNKS} k ON k.id = s.doc ORDER BY score DESC, id LIMIT {fusion.POOL}) GROUP BY cd",
    "doc_lexical": f"SELECT doc, score, doc AS tie FROM ({sql_scores(_DOC_POSTINGS, _TERMS, f'doc IN {_YEAR}')}) ORDER BY score DESC, doc LIMIT {fusion.POOL}",
    "semantic": f"SELECT cd AS doc, max(score) AS score, min(id) AS tie FROM (SELECT cd, id, score FROM (SELECT DISTINCT id, cd, {_COS.format(a='embedding', b='q')} AS score FROM chunk, {_Q} WHERE len(embedding) = len(q) AND content IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0 AND cd IN {_YEAR}) ORDER BY score DESC, id LIMIT {fusion.POOL}) GROUP BY cd",
}


def sql_hybrid(sources: list[str]) -> str:
    """(doc, score, matched_by, seen): reciprocal rank fusion of the lists of some retrievers, the best twenty."""
    order = list(fusion.WEIGHTS)
    ranked = " UNION ALL ".join(f"SELECT '{s}' AS source, {order.index(s)} AS place, {fusion.WEIGHTS[s]}::DOUBLE AS weight, doc, row_number() OVER (ORDER BY score DESC, tie, doc) AS rank FROM ({_BY_SOURCE[s]})" for s in sources)
    return f"""SELECT doc, sum(weight / ({fusion.K} + rank)) AS score, string_agg(source, ',' ORDER BY source) AS matched_by FROM ({ranked}) GROUP BY doc
        ORDER BY round(sum(weight / ({fusion.K} + rank)), 12) DESC, min(place), min_by(rank, place), doc LIMIT 20"""


def _found_sql(sources: list[str]) -> str:
    return f"""SELECT h.doc, round(h.score, 6) AS score, h.matched_by, m.citation, m.themes, c.category, c.chamber, c.subject, c.summary, c.source_url AS url
        FROM ({sql_hybrid(sources)}) h JOIN {CUR} c ON c.cd = h.doc JOIN ({META}) m ON m.cd = h.doc"""


@query(_found_sql(["chunk_lexical", "doc_lexical", "semantic"]))
def fus06(spark, root):
    """The whole search: what each result shows, but for its passages (top10)."""
    return _hybrid(spark, root, "hybrid").drop("passages")


@query(_found_sql(["semantic"]))
def fus02(spark, root):
    return _hybrid(spark, root, "semantic").drop("passages")


@query(_found_sql(["chunk_lexical", "doc_lexical"]))
def fus05(spark, root):
    """Keyword mode with its metadata."""
    return _hybrid(spark, root, "keyword").drop("passages")


@query(f"""WITH h AS ({sql_hybrid(["chunk_lexical", "doc_lexical", "semantic"])}),
    lex AS (SELECT doc AS id, score FROM ({sql_scores(_WEIGHTED, _TERMS, f'doc IN (SELECT id FROM chunk WHERE cd IN {_YEAR})')}) ORDER BY score DESC, id LIMIT {fusion.POOL}),
    sem AS (SELECT id, score FROM (SELECT DISTINCT id, {_COS.format(a='embedding', b='q')} AS score FROM chunk, {_Q} WHERE len(embedding) = len(q) AND content IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0 AND cd IN {_YEAR}) ORDER BY score DESC, id LIMIT {fusion.POOL}),
    f AS (SELECT id, max(l) AS l, max(s) AS s FROM (SELECT id, score AS l, NULL::DOUBLE AS s FROM lex UNION ALL SELECT id, NULL, score FROM sem) GROUP BY id),
    t AS (SELECT k.cd, k.id, k.part, k.ordinal, row_number() OVER (PARTITION BY k.cd ORDER BY k.part = 'summary' DESC, coalesce(l, 0) * 10 + coalesce(s, 0) DESC, l IS NULL, k.id) AS n FROM f JOIN (SELECT DISTINCT id, cd, part, ordinal FROM chunk) k ON k.id = f.id WHERE k.cd IN (SELECT doc FROM h))
    SELECT cd AS doc, n::INT AS n, part, ordinal::INT AS ordinal FROM t WHERE n <= 3""")
def top10(spark, root):
    """Which passages each result shows, in their order."""
    p = _hybrid(spark, root, "hybrid", highlight=False).select("doc", F.posexplode("passages").alias("n", "p"))
    return p.select("doc", (F.col("n") + 1).alias("n"), "p.part", "p.ordinal")


@query(None)
def fus04(spark, root):
    """The passages of each result with their matches marked."""
    return _hybrid(spark, root, "keyword").select("doc", F.posexplode("passages").alias("n", "p")).select("doc", "n", "p.part", "p.text")


@query(f"SELECT c.cd AS doc, 0.0::DOUBLE AS score, m.citation FROM {CUR} c JOIN ({META}) m ON m.cd = c.cd WHERE c.year >= 2000 ORDER BY year DESC NULLS LAST, number DESC NULLS LAST, c.cd LIMIT 20")
def fus03(spark, root):
    """Without a query: the newest of the filter."""
    d = current(spark, root, "cd", "year", "number")
    return fusion.hybrid(d, chunks(spark, root), chunk_index(spark, root), doc_index(spark, root), " ", where=F.col("year") >= 2000, meta=meta(spark, root).select("cd", "citation")).select("doc", "score", "citation")


@query("SELECT t.code, t.label, count(l.cd) AS n FROM theme t LEFT JOIN (SELECT DISTINCT * FROM decision_theme) l ON l.theme_code = t.code WHERE contains(replace(lower(t.label), 'ς', 'σ'), 'δωρε') GROUP BY t.code, t.label ORDER BY n DESC, encode(t.label), t.code LIMIT 50")
def fus07(spark, root):
    t = table(spark, root, "theme").filter(text.contains_folded(F.col("label"), "δωρε")).select("code", "label")
    n = links(spark, root).groupBy(F.col("theme_code").alias("code")).agg(F.count("cd").alias("n"))
    return t.join(n, "code", "left").fillna(0, ["n"]).orderBy(F.desc("n"), "label", "code").limit(50)

"""Filters, projections, joins, aggregates, rankings and set operations, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators import frontier, upsert
from lexspark.operators.latest import latest_rows
from lexspark.sources import pages
from lexspark.sources.tables import table

QUERIES = {}
SQL = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


_COLUMNS = ["cd", "number", "year", "category_id", "chamber_id", "category", "chamber", "subject", "summary", "body", "source_url", "content_hash", "indexed_hash", "first_seen", "last_changed", "last_fetched"]
CUR = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cd ORDER BY last_fetched DESC NULLS LAST) AS r_ FROM decision WHERE cd IS NOT NULL) WHERE r_ = 1)"
_FOLD = "replace(lower(strip_accents({})), 'ς', 'σ')"


def current(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The current decisions, with the named columns only."""
    return latest_rows(table(spark, root, "decision"), "cd", "last_fetched", list(columns or _COLUMNS))


def current_of(spark: SparkSession, root: str, **made) -> DataFrame:
    """(cd, …) of the current decisions, with values made from their columns before any row is moved."""
    d = table(spark, root, "decision").select("cd", "last_fetched", *[c.alias(n) for n, c in made.items()])
    return latest_rows(d, "cd", "last_fetched", ["cd", *made])


def links(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "decision_theme").distinct()


# ---- filters


@query(f"SELECT cd, year FROM {CUR} WHERE year >= 2005 AND year <= 2015")
def flt01(spark, root):
    return current(spark, root, "cd", "year").filter(F.col("year").between(2005, 2015))


@query(f"SELECT cd, category FROM {CUR} WHERE contains(replace(lower(category), 'ς', 'σ'), 'υποθεσ')")
def flt02(spark, root):
    return current(spark, root, "cd", "category").filter(text.contains_folded(F.col("category"), "υποθεσ"))


@query(f"SELECT cd, chamber FROM {CUR} WHERE chamber = 'Τμήμα 9ο'")
def flt03(spark, root):
    return current(spark, root, "cd", "chamber").filter(F.col("chamber") == "Τμήμα 9ο")


@query(f"SELECT cd, number FROM {CUR} c WHERE EXISTS (SELECT 1 FROM decision_theme t WHERE t.cd = c.cd)")
def flt04(spark, root):
    return current(spark, root, "cd", "number").join(links(spark, root).select("cd").distinct(), "cd", "left_semi")


@query(f"SELECT cd, year FROM {CUR} c WHERE EXISTS (SELECT 1 FROM decision_theme l JOIN theme t ON t.code = l.theme_code WHERE l.cd = c.cd AND (contains(replace(lower(t.label), 'ς', 'σ'), 'μίσθω') OR contains(replace(lower(t.label), 'ς', 'σ'), 'εγγύησ')))")
def flt05(spark, root):
    label = F.col("label")
    wanted = table(spark, root, "theme").filter(text.contains_folded(label, "μίσθω") | text.contains_folded(label, "εγγύησ")).select(F.col("code").alias("theme_code"))
    cds = links(spark, root).join(wanted, "theme_code", "left_semi").select("cd")
    return current(spark, root, "cd", "year").join(cds, "cd", "left_semi")


def where(year_from=None, year_to=None, category=None, chamber=None):
    """The conjunction of those conditions that are given; all rows if none is."""
    out = F.lit(True)
    for on, c in ((year_from is not None, F.col("year") >= year_from), (year_to is not None, F.col("year") <= year_to), (chamber is not None, F.col("chamber") == chamber)):
        out = out & c if on else out
    return out & text.contains_folded(F.col("category"), category) if category else out


@query(f"SELECT cd, year, chamber FROM {CUR} WHERE year >= 2010 AND chamber = 'Τμήμα 7ο' AND contains(replace(lower(category), 'ς', 'σ'), 'αστικ')")
def flt06(spark, root):
    return current(spark, root, "cd", "year", "chamber", "category").filter(where(year_from=2010, chamber="Τμήμα 7ο", category="ΑΣΤΙΚ")).select("cd", "year", "chamber")


@query(f"SELECT cd FROM {CUR} WHERE body IS NOT NULL AND indexed_hash IS DISTINCT FROM content_hash")
def flt07(spark, root):
    return current(spark, root, "cd", "body", "indexed_hash", "content_hash").filter(F.col("body").isNotNull() & ~F.col("indexed_hash").eqNullSafe(F.col("content_hash"))).select("cd")


@query("SELECT DISTINCT id, cd, ordinal FROM chunk WHERE embedding IS NOT NULL")
def flt08(spark, root):
    return table(spark, root, "chunk").filter(F.col("embedding").isNotNull()).select("id", "cd", "ordinal").distinct()


@query("SELECT DISTINCT id, kind, n_errors FROM crawl_run WHERE n_errors < 5")
def flt09(spark, root):
    return table(spark, root, "crawl_run").filter("n_errors < 5").select("id", "kind", "n_errors").distinct()


@query("SELECT code, label FROM theme WHERE crawled_at IS NULL OR crawled_at < TIMESTAMP '2025-12-01' - INTERVAL 30 DAY")
def flt10(spark, root):
    stale = F.expr("TIMESTAMP_NTZ '2025-12-01' - INTERVAL 30 DAYS")
    return table(spark, root, "theme").filter(F.col("crawled_at").isNull() | (F.col("crawled_at") < stale)).select("code", "label")


def optional(c, part: str | None):
    """The condition of an optional parameter: none if it is not given."""
    return F.lit(True) if part is None else text.contains_folded(c, part)


@query("SELECT 'all' AS part, code, label FROM theme UNION ALL SELECT 'some', code, label FROM theme WHERE contains(replace(lower(label), 'ς', 'σ'), 'μισθωσ')")
def flt11(spark, root):
    """An optional parameter that is not given filters nothing; given, it finds a final sigma, too."""
    t = table(spark, root, "theme")
    one = lambda name, part: t.filter(optional(F.col("label"), part)).select(F.lit(name).alias("part"), "code", "label")
    return one("all", None).unionByName(one("some", "ΜΙΣΘΩΣ"))


@query(f"SELECT year FROM {CUR} WHERE year IS NOT NULL GROUP BY year HAVING count(*) <= 25")
def flt13(spark, root):
    """The years whose root partition is done."""
    d = current(spark, root, "year", "category_id", "chamber_id", "number")
    return frontier.done_years(frontier.ledger(frontier.ladder(d, cap=25)))


@query(f"SELECT cd FROM {CUR} WHERE length(body) > 200")
def flt14(spark, root):
    return current_of(spark, root, chars=F.length("body")).filter("chars > 200").select("cd")


# ---- projections


def decisions_view(spark, root, include_body=False):
    return current(spark, root, "cd", "number", "year", *(["body"] if include_body else []))


@query(f"SELECT cd, number, year, body FROM {CUR}")
def prj01(spark, root):
    return decisions_view(spark, root, include_body=True)


@query(f"SELECT cd, length(body)::INT AS body_chars FROM {CUR}")
def prj02(spark, root):
    return current_of(spark, root, body_chars=F.length("body"))


@query(f"SELECT cd, number::VARCHAR || '/' || year::VARCHAR AS citation FROM {CUR}")
def prj03(spark, root):
    return current(spark, root, "cd", "number", "year").select("cd", text.citation(F.col("number"), F.col("year")).alias("citation"))


@query(f"SELECT c.cd, k.id AS looked_up FROM {CUR} c LEFT JOIN case_category k ON {_FOLD.format('k.label')} = {_FOLD.format('c.category')}")
def prj05(spark, root):
    ids = table(spark, root, "case_category").select(text.fold(F.col("label")).alias("f"), F.col("id").alias("looked_up"))
    return current(spark, root, "cd", "category").withColumn("f", text.fold(F.col("category"))).join(F.broadcast(ids), "f", "left").select("cd", "looked_up")  # five rows


@query(f"SELECT cd, 'https://nomologia.example/apofasi?cd=' || cd || CASE WHEN number <> 0 AND year <> 0 THEN '&apof=' || number || '_' || year ELSE '' END AS url FROM {CUR}")
def prj06(spark, root):
    tail = F.when((F.col("number") != 0) & (F.col("year") != 0), F.concat(F.lit("&apof="), "number", F.lit("_"), "year")).otherwise("")
    return current(spark, root, "cd", "number", "year").select("cd", F.concat(F.lit("https://nomologia.example/apofasi?cd="), "cd", tail).alias("url"))


@query(f"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cd ORDER BY last_fetched) AS n FROM decision WHERE cd IS NOT NULL) WHERE n = 1)
    SELECT c.cd, coalesce(nullif(c.number, 0), r.number) AS number, coalesce(nullif(c.year, 0), r.year) AS year, coalesce(nullif(c.category, ''), r.category) AS category, coalesce(nullif(c.chamber, ''), r.chamber) AS chamber, coalesce(nullif(c.summary, ''), r.subject) AS summary FROM {CUR} c LEFT JOIN r ON r.cd = c.cd""")
def prj07(spark, root):
    """The current decisions with what they lack taken from their first listing, its snippet as the headnote."""
    d = table(spark, root, "decision").filter("cd is not null")
    first = d.groupBy("cd").agg(F.min_by(F.struct("number", "year", "category", "chamber", F.col("subject").alias("snippet")), "last_fetched").alias("b")).select("cd", "b.*")
    return pages.merged(current(spark, root, "cd", "number", "year", "category", "chamber", "summary"), first, "cd")


@query(f"SELECT cd, left(body, 500) AS body, length(body) > 500 AS body_truncated, length(body)::INT AS body_total_chars FROM {CUR}")
def prj08(spark, root):
    return current_of(spark, root, body=F.left(F.col("body"), F.lit(500)), body_truncated=F.length("body") > 500, body_total_chars=F.length("body"))


# ---- joins


@query(f"SELECT DISTINCT k.id, k.cd, c.year FROM chunk k JOIN {CUR} c ON c.cd = k.cd")
def jon01(spark, root):
    return table(spark, root, "chunk").select("id", "cd").distinct().join(current(spark, root, "cd", "year"), "cd").select("id", "cd", "year")


@query("SELECT DISTINCT id, cd, n.n AS n_themes FROM chunk, LATERAL (SELECT count(*) AS n FROM theme) n")
def jon02(spark, root):
    n = table(spark, root, "theme").agg(F.count(F.lit(1)).alias("n_themes")).withColumn("one", F.lit(1))  # a single row
    return table(spark, root, "chunk").select("id", "cd").distinct().withColumn("one", F.lit(1)).join(F.broadcast(n), "one").drop("one")


def meta(spark, root):
    """The citation and the sorted labels of every current decision (empty if it has none)."""
    named = links(spark, root).join(table(spark, root, "theme").select(F.col("code").alias("theme_code"), "label"), "theme_code", "left")
    d = current(spark, root, "cd", "number", "year")
    return d.join(named, "cd", "left").groupBy("cd", "number", "year").agg(F.array_sort(F.collect_list("label")).alias("themes")).withColumn("citation", text.citation(F.col("number"), F.col("year")))


META = f"""SELECT c.cd, c.number::VARCHAR || '/' || c.year::VARCHAR AS citation, array_to_string(list_sort(coalesce(list(t.label) FILTER (t.label IS NOT NULL), [])), '|') AS themes
    FROM {CUR} c LEFT JOIN (SELECT DISTINCT * FROM decision_theme) l ON l.cd = c.cd LEFT JOIN theme t ON t.code = l.theme_code GROUP BY c.cd, c.number, c.year"""


@query(META)
def jon03(spark, root):
    return meta(spark, root).select("cd", "citation", F.array_join("themes", "|").alias("themes"))


@query(f"SELECT c.cd, c.chamber, m.citation, m.themes FROM {CUR} c JOIN ({META}) m ON m.cd = c.cd")
def jon04(spark, root):
    return current(spark, root, "cd", "chamber").join(jon03(spark, root), "cd")


@query("SELECT t.code, count(l.cd) AS n FROM theme t LEFT JOIN (SELECT DISTINCT * FROM decision_theme) l ON l.theme_code = t.code GROUP BY t.code")
def jon05(spark, root):
    n = links(spark, root).filter("cd is not null").groupBy(F.col("theme_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, root, "theme").select("code").join(n, "code", "left").fillna(0, ["n"])


@query(f"SELECT cd FROM {CUR} c WHERE cd IN (SELECT l.cd FROM decision_theme l JOIN theme t ON t.code = l.theme_code WHERE t.n_decisions > 1000)")
def jon06(spark, root):
    big = table(spark, root, "theme").filter("n_decisions > 1000").select(F.col("code").alias("theme_code"))
    return current(spark, root, "cd").join(links(spark, root).join(big, "theme_code", "left_semi").select("cd"), "cd", "left_semi")


@query("SELECT DISTINCT cd FROM documents d WHERE cd IS NOT NULL AND NOT EXISTS (SELECT 1 FROM decision c WHERE c.cd = d.cd AND c.summary IS NOT NULL)")
def jon07(spark, root):
    """What is left of a queue when those that are held with a headnote are deleted."""
    queue = table(spark, root, "documents").filter("cd is not null").select("cd").distinct()
    held = table(spark, root, "decision").filter("summary is not null").select("cd")
    return upsert.delete_keys(queue, held, ["cd"])


@query(f"SELECT DISTINCT l.cd, l.theme_code FROM decision_theme l WHERE EXISTS (SELECT 1 FROM {CUR} c WHERE c.cd = l.cd)")
def jon08(spark, root):
    return links(spark, root).join(current(spark, root, "cd"), "cd", "left_semi")


@query(f"""WITH s AS (SELECT cd, trim(unnest(string_split(subject, ','))) AS s FROM {CUR} WHERE subject IS NOT NULL)
    SELECT DISTINCT s.cd, t.code FROM s JOIN theme t ON {_FOLD.format('t.label')} = {_FOLD.format('rtrim(s.s, \'.\')')} WHERE s.s <> ''""")
def jon09(spark, root):
    s = current(spark, root, "cd", "subject").select("cd", F.explode(F.split("subject", ",")).alias("s")).select("cd", text.fold(F.rtrim(F.trim("s"), F.lit("."))).alias("f"))
    t = table(spark, root, "theme").select("code", text.fold(F.col("label")).alias("f"))
    return s.join(t, "f").select("cd", "code").distinct()


@query(f"SELECT DISTINCT k.id, k.content, c.category, c.subject FROM chunk k JOIN {CUR} c ON c.cd = k.cd WHERE k.part = 'summary'")
def jon10(spark, root):
    heads = table(spark, root, "chunk").filter("part = 'summary'").select("id", "cd", "content").distinct()
    return heads.join(current(spark, root, "cd", "category", "subject"), "cd").select("id", "content", "category", "subject")


# ---- aggregates


@query("SELECT cd, array_to_string(list_sort(list(label)), '|') AS labels FROM (SELECT DISTINCT l.cd, t.label FROM decision_theme l JOIN theme t ON t.code = l.theme_code) GROUP BY cd")
def agg01(spark, root):
    t = table(spark, root, "theme").select(F.col("code").alias("theme_code"), "label")
    return links(spark, root).join(t, "theme_code").groupBy("cd").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"))


@query("SELECT t.code, t.label, count(l.cd) AS n_decisions FROM theme t LEFT JOIN (SELECT DISTINCT * FROM decision_theme) l ON l.theme_code = t.code GROUP BY t.code, t.label")
def agg02(spark, root):
    return table(spark, root, "theme").select("code", "label").join(jon05(spark, root).withColumnRenamed("n", "n_decisions"), "code")


@query(f"""SELECT count(*) AS n, count(body) AS with_body, count(summary) AS with_summary, min(year) AS first_year, max(year) AS last_year, count(DISTINCT category_id) AS categories,
    count(*) FILTER (body IS NOT NULL AND indexed_hash IS DISTINCT FROM content_hash) AS pending, sum(length(body)) AS chars FROM {CUR}""")
def agg03(spark, root):
    same = F.col("indexed_hash").eqNullSafe(F.col("content_hash"))
    d = current_of(spark, root, body=F.when(F.col("body").isNotNull(), 1), summary=F.when(F.col("summary").isNotNull(), 1), year=F.col("year"), category_id=F.col("category_id"), pend=F.col("body").isNotNull() & ~same, chars_=F.length("body"))
    return d.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("body").alias("with_body"),
        F.count("summary").alias("with_summary"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.count_distinct("category_id").alias("categories"),
        F.count_if("pend").alias("pending"),
        F.sum("chars_").alias("chars"),
    )


@query("SELECT count(*) AS n_rows, count(DISTINCT id) AS n_chunks, count(DISTINCT cd) AS n_decisions, count(embedding) AS n_embedded FROM chunk")
def agg04(spark, root):
    return table(spark, root, "chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_chunks"), F.count_distinct("cd").alias("n_decisions"), F.count("embedding").alias("n_embedded"))


@query("SELECT count(*) AS entries, coalesce(sum(n), 0) AS accesses, min(first) AS oldest, max(last) AS newest FROM (SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id)")
def agg05(spark, root):
    per = table(spark, root, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return per.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("n"), F.lit(0)).alias("accesses"), F.min("first").alias("oldest"), F.max("last").alias("newest"))


@query("SELECT cd, last_fetched, summary FROM (SELECT cd, last_fetched, summary, row_number() OVER (PARTITION BY cd ORDER BY summary IS NULL, last_fetched) AS r FROM decision WHERE cd IS NOT NULL AND last_fetched IS NOT NULL) WHERE r = 1")
def agg09(spark, root):
    """The first delivery of a decision, unless it lacks a headnote and a later one has it."""
    d = table(spark, root, "decision").filter("cd is not null and last_fetched is not null").select("cd", "last_fetched", "summary")
    return pages.absorbed(d, "cd", "summary", ["last_fetched"])


@query("SELECT kind, count(*) FILTER (finished_at IS NULL) AS unfinished, count(*) FILTER (finished_at IS NOT NULL AND n_errors > 0) AS failed, count(*) FILTER (finished_at IS NOT NULL AND coalesce(n_errors, 0) = 0) AS fine FROM (SELECT DISTINCT * FROM crawl_run) GROUP BY kind")
def agg10(spark, root):
    r = table(spark, root, "crawl_run").distinct()
    state = F.when(F.col("finished_at").isNull(), "unfinished").when(F.col("n_errors") > 0, "failed").otherwise("fine")
    return r.withColumn("state", state).groupBy("kind").pivot("state", ["unfinished", "failed", "fine"]).count().fillna(0)


@query("SELECT DISTINCT id, CASE WHEN date_diff('second', started_at, finished_at) > 0 THEN n_fetched::DOUBLE / date_diff('second', started_at, finished_at) ELSE 0.0 END AS per_second FROM crawl_run")
def agg11(spark, root):
    s = F.expr("timestampdiff(SECOND, date_trunc('SECOND', started_at), date_trunc('SECOND', finished_at))")
    return table(spark, root, "crawl_run").distinct().select("id", F.when(s > 0, F.col("n_fetched") / s).otherwise(F.when(F.lit(True), 0.0)).alias("per_second"))


@query(f"SELECT cd, array_to_string(list_distinct_kept, '|') AS subjects FROM (SELECT cd, list(s ORDER BY first) AS list_distinct_kept FROM (SELECT cd, s, min(p) AS first FROM (SELECT cd, unnest(string_split(subject, ', ')) AS s, generate_subscripts(string_split(subject, ', '), 1) AS p FROM {CUR} WHERE subject IS NOT NULL) GROUP BY cd, s) GROUP BY cd)")
def agg12(spark, root):
    return current(spark, root, "cd", "subject").filter("subject is not null").select("cd", F.array_join(F.array_distinct(F.split("subject", ", ")), "|").alias("subjects"))


# ---- rankings and top-k


@query(f"SELECT cd, category, row_number() OVER (PARTITION BY category ORDER BY year DESC NULLS LAST, number DESC NULLS LAST, cd) AS rank FROM {CUR}")
def win01(spark, root):
    w = Window.partitionBy("category").orderBy(F.col("year").desc_nulls_last(), F.col("number").desc_nulls_last(), "cd")
    return current(spark, root, "cd", "category", "year", "number").select("cd", "category", F.row_number().over(w).cast("long").alias("rank"))


@query("SELECT source, cd, min(n_chars) AS best FROM documents WHERE cd IS NOT NULL GROUP BY source, cd")
def win02(spark, root):
    return table(spark, root, "documents").filter("cd is not null").groupBy("source", "cd").agg(F.min("n_chars").alias("best"))


@query("SELECT source, cd, row_number() OVER (PARTITION BY source ORDER BY best DESC, cd) AS rank FROM (SELECT source, cd, max(n_chars) AS best FROM documents WHERE cd IS NOT NULL AND n_chars IS NOT NULL GROUP BY source, cd)")
def win03(spark, root):
    best = table(spark, root, "documents").filter("cd is not null and n_chars is not null").groupBy("source", "cd").agg(F.max("n_chars").alias("best"))
    return best.select("source", "cd", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("best"), "cd")).cast("long").alias("rank"))


@query("SELECT cd, id, n FROM (SELECT cd, id, row_number() OVER (PARTITION BY cd ORDER BY part DESC, length(content) DESC, id) AS n FROM (SELECT DISTINCT id, cd, part, content FROM chunk)) WHERE n <= 3")
def win04(spark, root):
    w = Window.partitionBy("cd").orderBy(F.desc("part"), F.desc("len"), "id")
    k = table(spark, root, "chunk").select("id", "cd", "part", F.length("content").alias("len")).distinct()
    return k.withColumn("n", F.row_number().over(w).cast("long")).filter("n <= 3").select("cd", "id", "n")


@query("SELECT id, cd, row_number() OVER (PARTITION BY cd ORDER BY ordinal, id) - 1 AS dense FROM (SELECT DISTINCT id, cd, ordinal FROM chunk)")
def win05(spark, root):
    k = table(spark, root, "chunk").select("id", "cd", "ordinal").distinct()
    return k.select("id", "cd", (F.row_number().over(Window.partitionBy("cd").orderBy("ordinal", "id")) - 1).cast("long").alias("dense"))


@query(f"SELECT cd, year, number FROM {CUR} ORDER BY year DESC NULLS LAST, number DESC NULLS LAST, cd LIMIT 20")
def top04(spark, root):
    return current(spark, root, "cd", "year", "number").orderBy(F.col("year").desc_nulls_last(), F.col("number").desc_nulls_last(), "cd").limit(20)


@query(f"SELECT cd, year, number FROM {CUR} WHERE body IS NULL ORDER BY year DESC NULLS LAST, number DESC NULLS LAST, cd LIMIT 200")
def top06(spark, root):
    return current(spark, root, "cd", "year", "number", "body").filter("body is null").drop("body").orderBy(F.col("year").desc_nulls_last(), F.col("number").desc_nulls_last(), "cd").limit(200)


@query("SELECT code, crawled_at FROM theme ORDER BY crawled_at NULLS FIRST, code LIMIT 50")
def top07(spark, root):
    return table(spark, root, "theme").select("code", "crawled_at").orderBy(F.col("crawled_at").asc_nulls_first(), "code").limit(50)


@query("SELECT t.code, t.label, count(l.cd) AS n FROM theme t LEFT JOIN (SELECT DISTINCT * FROM decision_theme) l ON l.theme_code = t.code GROUP BY t.code, t.label ORDER BY n DESC, encode(t.label), t.code LIMIT 100")
def top08(spark, root):
    return agg02(spark, root).withColumnRenamed("n_decisions", "n").orderBy(F.desc("n"), "label", "code").limit(100)


@query("SELECT user_id, last FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) ORDER BY last DESC, user_id LIMIT 100")
def top09(spark, root):
    last = table(spark, root, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return upsert.evict(last, "last", "user_id", F.expr("TIMESTAMP_NTZ '1970-01-01'"), 100)


@query(f"SELECT cd, number, year FROM {CUR} WHERE number = (SELECT number FROM {CUR} WHERE number IS NOT NULL GROUP BY number ORDER BY count(*) DESC, number LIMIT 1) ORDER BY year DESC NULLS FIRST, cd")
def top11(spark, root):
    """All decisions of the number that recurs most, newest first."""
    d = current(spark, root, "cd", "number", "year")
    most = d.filter("number is not null").groupBy("number").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "number").limit(1)
    return d.join(F.broadcast(most.select("number")), "number", "left_semi").select("cd", "number", "year").orderBy(F.col("year").desc_nulls_first(), "cd")  # a single row


# ---- sets


@query("SELECT cd FROM documents WHERE cd IS NOT NULL EXCEPT SELECT cd FROM decision_theme")
def set01(spark, root):
    """What is listed but not known."""
    one = lambda n: table(spark, root, n).filter("cd is not null").select("cd").distinct()
    return one("documents").join(one("decision_theme"), "cd", "left_anti")


@query("SELECT cd FROM decision WHERE cd IS NOT NULL UNION SELECT cd FROM chunk WHERE cd IS NOT NULL UNION SELECT cd FROM documents WHERE cd IS NOT NULL")
def set02(spark, root):
    one = lambda n: table(spark, root, n).select("cd").filter("cd is not null")
    return one("decision").unionByName(one("chunk")).unionByName(one("documents")).distinct()


@query("SELECT cd, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT 'chunk' AS source, cd FROM chunk UNION ALL SELECT DISTINCT 'document', cd FROM documents WHERE cd IS NOT NULL UNION ALL SELECT DISTINCT 'theme', cd FROM decision_theme) GROUP BY cd")
def set03(spark, root):
    one = lambda n, s: table(spark, root, n).filter("cd is not null").select(F.lit(s).alias("source"), "cd").distinct()
    u = one("chunk", "chunk").unionByName(one("documents", "document")).unionByName(one("decision_theme", "theme"))
    return u.groupBy("cd").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


@query("SELECT y::INT AS year FROM generate_series(1994, 2026) g(y) WHERE y NOT IN (SELECT year FROM decision WHERE year IS NOT NULL)")
def set04(spark, root):
    years = spark.range(1994, 2027).select(F.col("id").cast("int").alias("year"))
    return years.join(table(spark, root, "decision").select("year").distinct(), "year", "left_anti")

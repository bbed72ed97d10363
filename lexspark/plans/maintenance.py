"""Queries over sources, sinks, caches and queues, with SQL twins where SQL can say it."""

from __future__ import annotations

import re

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions import text
from lexspark.operators import frontier, upsert, vector
from lexspark.operators.cache import QueryCache
from lexspark.operators.latest import latest_rows
from lexspark.operators.passage_index import PassageIndex
from lexspark.plans.relational import CUR, META, current, current_of, links, meta
from lexspark.plans.retrieval import first_vector, listing_pages
from lexspark.sources import archive, pages
from lexspark.sources.tables import cut, run_dir, table
from lexspark.streaming import refresh

QUERIES = {}
SQL = {}
NOW = "TIMESTAMP '2025-12-31'"


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def now():
    return F.expr(NOW).cast("timestamp_ntz")


def _old_and_new(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Decisions as they stood before the middle of their deliveries, and those delivered since."""
    d = table(spark, root, "decision").select("cd", "content_hash", "body", "first_seen", "last_fetched", "last_changed").filter("cd is not null")
    cut = F.expr("TIMESTAMP_NTZ '2025-06-01'")
    cols = ["cd", "content_hash", "first_seen", "last_fetched", "last_changed"]
    return latest_rows(d.filter(F.col("last_fetched") < cut), "cd", "last_fetched", cols), latest_rows(d.filter(F.col("last_fetched") >= cut), "cd", "last_fetched", cols)


_HALF = "(SELECT cd, content_hash, first_seen, last_fetched, last_changed FROM (SELECT *, row_number() OVER (PARTITION BY cd ORDER BY last_fetched DESC) AS r FROM decision WHERE cd IS NOT NULL AND last_fetched {} TIMESTAMP '2025-06-01') WHERE r = 1)"
_OLD, _NEW = _HALF.format("<"), _HALF.format(">=")


# ---- sources


@query(f"SELECT cd, sha256('POST' || chr(10) || source_url || chr(10) || 'cd=' || cd || chr(10) || 'v=1') AS key FROM {CUR}")
def src04(spark, root):
    return current(spark, root, "cd", "source_url").select("cd", text.request_key(F.lit("POST"), F.col("source_url"), F.array(F.lit("v=1"), F.concat(F.lit("cd="), "cd"))).alias("key"))


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k, NULL::INT AS missing FROM events")
def src03(spark, root):
    j = archive.json_or_empty(F.col("props"), "k int, missing int")
    return table(spark, root, "events").select("event_id", j.getField("k").alias("k"), j.getField("missing").alias("missing"))


@query("SELECT code, 'utf-8' AS sent_as, label FROM theme UNION ALL SELECT code, 'cp1253', regexp_replace(label, '[^\\x00-\\x7fΆΈΉΊΌΎ-ΡΣ-ώ«»–’·]', '?', 'g') FROM theme UNION ALL SELECT code, 'broken', label || chr(65533) FROM theme")
def src05(spark, root):
    """Pages in two encodings, and with a byte that neither has, which becomes U+FFFD."""
    t = table(spark, root, "theme").select("code", "label")
    utf8 = F.encode("label", "utf-8")
    sent = t.select("code", F.explode(F.array(
        F.struct(F.lit("utf-8").alias("sent_as"), utf8.alias("raw"), F.lit("text/html; charset=UTF-8").alias("type")),
        F.struct(F.lit("cp1253").alias("sent_as"), _in_cp1253(F.col("label")).alias("raw"), F.lit("text/html").alias("type")),
        F.struct(F.lit("broken").alias("sent_as"), F.concat(utf8, F.unhex(F.lit("FF"))).alias("raw"), F.lit("application/json").alias("type")),
    )).alias("p"))
    return sent.select("code", "p.sent_as", archive.decode(F.col("p.raw"), F.col("p.type")).alias("label"))


@F.pandas_udf(T.BinaryType())
def _in_cp1253(col: pd.Series) -> pd.Series:
    """Text as the source sends it; what its code page lacks, or these tables do not use, is a question mark."""
    odd = re.compile("[^\x00-\x7fΆΈΉΊΌΎ-ΡΣ-ώ«»–’·]")
    return col.map(lambda x: None if x is None else odd.sub("?", x).encode("cp1253"))


@query(f"SELECT cd AS key, summary AS value FROM {CUR} WHERE summary IS NOT NULL")
def src06(spark, root):
    store = archive.open_store(spark, "local", run_dir(spark, "archive"))
    store.put(current(spark, root, "cd", "summary").filter("summary is not null").select(F.col("cd").alias("key"), F.col("summary").alias("value")))
    return store.read().select("key", "value")


@query("SELECT cd AS key FROM decision WHERE false")
def src08(spark, root):
    store = archive.open_store(spark, "off")
    store.put(table(spark, root, "decision").select(F.col("cd").alias("key"), F.col("body").alias("value")))
    return store.read().select("key")


@query(f"SELECT cd, CASE WHEN coalesce(length(body), 0) < 400 THEN coalesce(nullif(trim(summary), ''), body) ELSE body END AS body FROM {CUR}")
def src12(spark, root):
    d = current(spark, root, "cd", "body", "summary")
    other = d.select("cd", F.to_json(F.struct(F.lit("success").alias("status"), F.col("summary").alias("text"))).alias("json"))
    return pages.with_fallback(d.select("cd", "body"), other, "cd", "body").select("cd", "body")


@query(f"SELECT cd AS key, summary AS value FROM {CUR} WHERE summary IS NOT NULL AND cd < 'L'")
def src07(spark, root):
    """An archive on any file system by its address: here the shared folder's own, put twice."""
    store = archive.open_store(spark, "path", run_dir(spark, "blobs"))
    d = current(spark, root, "cd", "summary").filter("summary is not null").select(F.col("cd").alias("key"), F.col("summary").alias("value"))
    store.put(d.withColumn("value", F.lit("old")), 0)
    store.put(d, 1)
    return store.exists(d.filter("key < 'L'").select("key")).join(store.read().select("key", "value"), "key")


@query(f"SELECT cd, number, year FROM {CUR} WHERE number IS NOT NULL AND year IS NOT NULL AND (year % 2 = 0 OR year < 2000)")
def src09(spark, root):
    """The listings of some partitions (even years, and all before 2000), read page by page and united."""
    d = listing_pages(spark, root)
    found = pages.references(d, "html", "page")
    return pages.absorbed(found.filter("year % 2 = 0").unionByName(found.filter("year < 2000")), "cd", "snippet", ["page", "pos"]).select("cd", "number", "year")


@query("SELECT DISTINCT l.theme_code AS code, l.cd FROM decision_theme l JOIN theme t ON t.code = l.theme_code WHERE l.cd IS NOT NULL")
def src10(spark, root):
    """A listing per theme, in the form of the source; its references link the theme."""
    own = links(spark, root).filter("cd is not null").join(table(spark, root, "theme").select(F.col("code").alias("theme_code")), "theme_code")
    # some 500 references to a page, however many a theme has
    sized = own.withColumn("page", F.pmod(F.xxhash64("cd"), F.lit(max(1, own.count() // 500))))
    row = F.concat(F.lit('<td><a href="show.asp?cd='), "cd", F.lit('&amp;apof=1_2000">1/2000</a></td><td>&nbsp</td>'))
    html = sized.groupBy("theme_code", "page").agg(F.concat_ws("", F.collect_list(row)).alias("html")).withColumn("key", F.concat_ws("/", "theme_code", "page"))
    return pages.references(html, "html", "key").select(F.split_part("page", F.lit("/"), F.lit(1)).cast("int").alias("code"), "cd").distinct()


@query("SELECT DISTINCT cd, number, year, true AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY cd ORDER BY last_fetched DESC NULLS LAST) AS r FROM decision WHERE cd IS NOT NULL) WHERE r = 1 AND number IS NOT NULL AND year IS NOT NULL")
def src11(spark, root):
    """Listings that say they leave rows out."""
    d = listing_pages(spark, root).withColumn("html", F.concat(F.lit("<p>Η αναζήτηση επέστρεψε περισσότερα από 3000 αποτελέσματα</p>"), "html"))
    flags = d.select(F.col("page").alias("p"), pages.truncated(F.col("html")).alias("truncated"))
    return pages.references(d, "html", "page").join(flags, F.col("page") == F.col("p")).select("cd", "number", "year", "truncated").distinct()


@query("SELECT 'decision' AS name, count(*) AS n FROM decision UNION ALL SELECT 'chunk', count(*) FROM chunk UNION ALL SELECT 'theme', count(*) FROM theme UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events")
def src13(spark, root):
    out = None
    for n in ("decision", "chunk", "theme", "documents", "events"):
        one = table(spark, root, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def find(decisions: DataFrame, cd: str | None = None, number: int | None = None, year: int | None = None, chamber: str | None = None, include_body: bool = False) -> DataFrame:
    """Decisions by key or citation, all that is given must hold; newest first, unknown years before all. An error if nothing is given."""
    asked = {"cd": cd or None, "number": number, "year": year, "chamber": chamber or None}
    given = {k: v for k, v in asked.items() if v is not None}
    if not given:
        raise ValueError("give a key, or a number and a year")
    out = decisions
    for k, v in given.items():
        out = out.filter(F.col(k) == v)
    out = out if include_body else out.drop("body")
    return out.orderBy(F.col("year").desc_nulls_first(), F.col("number").desc_nulls_first(), "cd")


_ONE = f"(SELECT * FROM {CUR} WHERE number IS NOT NULL AND year IS NOT NULL ORDER BY cd LIMIT 1)"


@query(f"SELECT 'citation' AS by, c.cd, c.number, c.year, m.themes, NULL AS body FROM {CUR} c JOIN ({META}) m ON m.cd = c.cd JOIN {_ONE} o ON o.number = c.number AND o.year = c.year UNION ALL SELECT 'key', c.cd, c.number, c.year, m.themes, c.body FROM {CUR} c JOIN ({META}) m ON m.cd = c.cd JOIN {_ONE} o ON o.cd = c.cd")
def src14(spark, root):
    """One decision by its key, with its text, and all of its citation, without."""
    d = current(spark, root, "cd", "number", "year", "chamber", "body").join(meta(spark, root).select("cd", F.array_join("themes", "|").alias("themes")), "cd")
    o = current(spark, root, "cd", "number", "year").filter("number is not null and year is not null").orderBy("cd").first()
    by = lambda name, rows: rows.select(F.lit(name).alias("by"), "cd", "number", "year", "themes", "body")
    return by("citation", find(d, number=o["number"], year=o["year"]).withColumn("body", F.lit(None).cast("string"))).unionByName(by("key", find(d, cd=o["cd"], include_body=True)))


@query("SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_orderstatus")
def src17(spark, root):
    return spark.sql("SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM {orders} GROUP BY o_orderstatus", orders=table(spark, root, "orders"))


@query("SELECT id, label FROM case_category")
def src18(spark, root):
    rows = [tuple(r) for r in table(spark, root, "case_category").select("id", "label").collect()]  # five seed rows
    return spark.createDataFrame(rows, "id short, label string")


# ---- sinks


@query("SELECT code, label, coalesce(slug, label) AS slug FROM theme UNION ALL SELECT max(code) + 1, 'νέο', 'νέο' FROM theme")
def snk01(spark, root):
    """A delivery of the labels that lack a slug, and of a new one."""
    old = table(spark, root, "theme").select("code", "label", "slug")
    fresh = old.agg((F.max("code") + 1).alias("code")).select("code", F.lit("νέο").alias("label"), F.lit("νέο").alias("slug"))
    return upsert.upsert(old, old.filter("slug is null").withColumn("slug", F.col("label")).unionByName(fresh), ["code"])


@query(f"""SELECT coalesce(o.cd, n.cd) AS cd, CASE WHEN n.cd IS NULL THEN 'absent' WHEN o.cd IS NULL THEN 'new' WHEN o.content_hash IS NOT DISTINCT FROM n.content_hash THEN 'unchanged' ELSE 'changed' END AS outcome,
    coalesce(o.first_seen, CASE WHEN o.cd IS NULL THEN {NOW} END, {NOW}) AS first_seen FROM {_OLD} o FULL JOIN {_NEW} n ON n.cd = o.cd""")
def snk02(spark, root):
    old, new = _old_and_new(spark, root)
    return upsert.upsert_changed(old, new, "cd", "content_hash", now()).select("cd", "outcome", "first_seen")


@query("SELECT DISTINCT cd, theme_code FROM decision_theme UNION SELECT DISTINCT cd, 1 FROM chunk")
def snk03(spark, root):
    return upsert.insert_missing(links(spark, root), table(spark, root, "chunk").select("cd", F.lit(1).alias("theme_code")), ["cd", "theme_code"])


@query("SELECT DISTINCT d.cd FROM documents d WHERE d.cd IS NOT NULL AND d.cd NOT IN (SELECT cd FROM decision WHERE body IS NOT NULL AND cd IS NOT NULL)")
def snk04(spark, root):
    queued = upsert.insert_missing(table(spark, root, "documents").limit(0).select("cd"), table(spark, root, "documents").filter("cd is not null").select("cd"), ["cd"])
    return upsert.delete_keys(queued, table(spark, root, "decision").filter("body is not null and cd is not null").select("cd"), ["cd"])


@query("SELECT DISTINCT id, cd FROM chunk WHERE cd NOT IN (SELECT cd FROM decision_theme WHERE cd IS NOT NULL)")
def snk05(spark, root):
    return upsert.delete_keys(table(spark, root, "chunk").select("id", "cd").distinct(), links(spark, root).select("cd"), ["cd"])


@query("SELECT kind, count(notes)::INT AS attempts, max_by(left(notes, 2000), started_at) FILTER (notes IS NOT NULL) AS last_error, count(notes) < 5 AS retry FROM (SELECT DISTINCT * FROM crawl_run) GROUP BY kind")
def snk06(spark, root):
    runs = table(spark, root, "crawl_run").distinct()
    counted = upsert.failures(runs.filter("notes is not null"), "kind", "started_at", "notes")
    kinds = runs.select("kind").distinct()
    return kinds.join(counted, "kind", "left").select("kind", F.coalesce("attempts", F.lit(0)).alias("attempts"), "last_error", F.coalesce("retry", F.lit(True)).alias("retry"))


@query("SELECT year, category_id, chamber_id, max(last_fetched) AS last_fetched FROM decision GROUP BY year, category_id, chamber_id")
def snk07(spark, root):
    log = table(spark, root, "decision").select("year", "category_id", "chamber_id", "last_fetched")
    return upsert.latest_entry(log, ["year", "category_id", "chamber_id"], "last_fetched")


@query("""WITH r AS (SELECT DISTINCT * FROM crawl_run), k AS (SELECT kind, row_number() OVER (ORDER BY kind) AS n FROM (SELECT DISTINCT kind FROM r WHERE kind IS NOT NULL))
    SELECT id, kind, finished_at IS NOT NULL AS finished, n_fetched FROM r UNION ALL SELECT (SELECT max(id) FROM r) + n, kind, n = 1, CASE WHEN n = 1 THEN 7 ELSE 0 END FROM k""")
def snk08(spark, root):
    """One run of every kind is started, with the next numbers, and the first of them finished."""
    log = table(spark, root, "crawl_run").distinct().select("id", "kind", "finished_at", "n_fetched")
    kinds = log.filter("kind is not null").select("kind").distinct()
    started = upsert.start_runs(log, kinds, "id", "kind").select("id", "kind", F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(0).alias("n_fetched"))
    started = cut(started)
    first = started.agg(F.min("id").alias("id")).select("id", now().alias("finished_at"), F.lit(7).alias("n_fetched"))
    return upsert.finish_runs(log.unionByName(started), first, "id").select("id", "kind", F.col("finished_at").isNotNull().alias("finished"), "n_fetched")


def _index(spark: SparkSession, root: str, dim: int = 64) -> PassageIndex:
    """A new index over the current decisions."""
    return PassageIndex(spark, run_dir(spark, "index"), dim)


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return current(spark, root, "cd", "subject", "summary", "body")


@query(f"SELECT cd, true AS has_vectors, 64 AS dim, 0 AS left_to_do FROM {CUR} WHERE body IS NOT NULL AND (length(trim(body, chr(10) || chr(9) || chr(32) || chr(13) || chr(160))) >= 50 OR trim(summary) <> '')")
def snk09(spark, root):
    """An index built in two runs, first of the decisions until 2010, then of all: every decision has its passages and vectors."""
    index, d = _index(spark, root), _texts(spark, root)
    early = current(spark, root, "cd", "year").filter("year <= 2010").select("cd")
    index.build(d.join(early, "cd", "left_semi"))
    index.build(d)
    left = index.pending(d).count()
    return index.passages().groupBy("cd").agg(F.bool_and(F.col("embedding").isNotNull()).alias("has_vectors"), F.max(F.size("embedding")).alias("dim")).withColumn("left_to_do", F.lit(left).cast("int"))


@query(f"SELECT 'built' AS state, count(*) AS indexed, 1 AS cached FROM {CUR} WHERE body IS NOT NULL AND year >= 2015 UNION ALL SELECT 'reset', 0, 0")
def snk10(spark, root):
    """An index and its cache before and after a reset."""
    index = _index(spark, root, 16)
    index.build(current(spark, root, "cd", "subject", "summary", "body", "year").filter("year >= 2015"))
    index.cache.put(spark.sql("SELECT 'ερώτηση' AS query, array(cast(1.0 AS float)) AS embedding, TIMESTAMP_NTZ '2025-01-01' AS at"), index.signature)
    state = lambda name: (name, index.indexed().count(), index.cache.entries().count())
    rows = [state("built")]
    index.reset()
    return spark.createDataFrame([*rows, state("reset")], "state string, indexed long, cached int")


def _refused(f) -> str:
    try:
        return f()
    except RuntimeError:
        return "refused"


def _small(spark: SparkSession, root: str) -> DataFrame:
    """The decision of the greatest key that has a text."""
    return _texts(spark, root).filter("body is not null").orderBy(F.desc("cd")).limit(1)


@query("SELECT * FROM (VALUES ('first', 'new'), ('again', 'kept'), ('other model', 'replaced'), ('other model, vectors held', 'refused'), ('other model, after a reset', 'new')) v(step, outcome)")
def snk12(spark, root):
    """The space of an index is claimed by a model, and by no other while vectors are held."""
    path = run_dir(spark, "space")
    a, b = (PassageIndex(spark, path, 16, model) for model in ("a", "b"))
    rows = [("first", a.claim()), ("again", a.claim()), ("other model", b.claim())]
    b.build(_small(spark, root))
    rows.append(("other model, vectors held", _refused(a.claim)))
    b.reset()
    return spark.createDataFrame([*rows, ("other model, after a reset", a.claim())], "step string, outcome string")


@query("SELECT * FROM (VALUES ('first', 'new', 0), ('again', 'kept', 1), ('other dimension', 'changed', 0), ('other dimension, vectors held', 'refused', 0)) v(step, outcome, cached)")
def snk13(spark, root):
    """The dimension of an index changes, and its cache goes, unless vectors are held."""
    path = run_dir(spark, "dims")
    a, b = PassageIndex(spark, path, 16), PassageIndex(spark, path, 32)
    rows = [("first", a.migrate(), a.cache.entries().count())]
    a.cache.put(spark.sql("SELECT 'q' AS query, array(cast(1.0 AS float)) AS embedding, TIMESTAMP_NTZ '2025-01-01' AS at"), a.signature)
    rows += [("again", a.migrate(), a.cache.entries().count()), ("other dimension", b.migrate(), b.cache.entries().count())]
    b.build(_small(spark, root))
    rows.append(("other dimension, vectors held", _refused(a.migrate), b.cache.entries().count()))
    return spark.createDataFrame(rows, "step string, outcome string, cached int")


@query("SELECT 'local:hash:64' AS held, 'gemini:x:64' AS asked, true AS refused")
def vec08(spark, root):
    """Vectors of two models never share an index."""
    path = run_dir(spark, "models")
    a, b = PassageIndex(spark, path, 64), PassageIndex(spark, path, 64, "x", "gemini")
    a.build(_small(spark, root))
    return spark.createDataFrame([(a.space()["signature"], b.signature, _refused(b.claim) == "refused")], "held string, asked string, refused boolean")


_COSINE = "list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))))"


@query(f"SELECT vec_id::VARCHAR AS key FROM (SELECT vec_id, {_COSINE} AS s FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)) ORDER BY round(s, 6) DESC, vec_id::VARCHAR LIMIT 20")
def snk14(spark, root):
    """A vector index, stored in cells; all cells are read here, so the search is exact."""
    index = _index(spark, root)
    e = table(spark, root, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "embedding")
    index.build_vector_index(e)
    return index.nearest(first_vector(spark, root), e.count()).select("key", F.round("score", 6).alias("s")).orderBy(F.desc("s"), "key").limit(20).select("key")


@query("SELECT * FROM (VALUES ('before', false), ('built', true), ('reset', false)) v(state, has_index)")
def src16(spark, root):
    index = _index(spark, root)
    rows = [("before", index.has_vector_index())]
    index.build_vector_index(table(spark, root, "embeddings").select(F.col("vec_id").alias("key"), "embedding"))
    rows.append(("built", index.has_vector_index()))
    index.reset()
    return spark.createDataFrame([*rows, ("reset", index.has_vector_index())], "state string, has_index boolean")


@query("SELECT 16 AS dim, 'local:hash:16' AS model")
def src15(spark, root):
    """What the store declares of its vectors: field metadata of its table."""
    index = _index(spark, root, 16)
    index.build(_small(spark, root))
    m = index.passages().schema["embedding"].metadata
    return spark.createDataFrame([(m["dim"], m["model"])], "dim int, model string")


@query(f"""WITH w AS (SELECT cd, unnest(string_split(trim(regexp_replace(lower(replace(summary, 'Σ', 'σ')), '[\\x0b\\x{{85}}\\x{{1680}}\\x{{2028}}\\x{{2029}}\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), ' ')) AS w FROM {CUR} WHERE summary IS NOT NULL AND NOT contains(summary, 'ς'))
    SELECT cd, count(*)::INT AS n FROM w WHERE w <> '' GROUP BY cd""")
def jon11(spark, root):
    """Texts and their vectors meet by key: the squared lengths before normalising give the numbers of words back."""
    d = current(spark, root, "cd", "summary").filter("summary is not null and not contains(summary, 'ς')").select("cd", F.replace("summary", F.lit("Σ"), F.lit("σ")).alias("summary"))
    v = vector.hash_embed(d, "cd", "summary", 1 << 20)
    # a slot of one word has the value 1 / length
    words = d.select("cd", F.size(F.filter(F.split(F.trim(F.regexp_replace(F.lower("summary"), r"(?U)\s+", " ")), " "), lambda x: x != "")).alias("n"))
    return words.join(v.select("cd").distinct(), "cd").select("cd", "n")


@query("SELECT t.code, t.label, t.slug, t.crawled_at, count(l.cd)::INT AS n_decisions FROM theme t LEFT JOIN (SELECT DISTINCT * FROM decision_theme) l ON l.theme_code = t.code GROUP BY ALL")
def snk11(spark, root):
    live = links(spark, root).groupBy(F.col("theme_code").alias("code")).agg(F.count("cd").cast("int").alias("n_decisions"))
    return table(spark, root, "theme").drop("n_decisions").join(live, "code", "left").fillna(0, ["n_decisions"])


@query(f"SELECT cd, json_object('cd', cd, 'year', year) AS line FROM {CUR} WHERE year IS NOT NULL")
def snk15(spark, root):
    return current(spark, root, "cd", "year").filter("year is not null").select("cd", F.to_json(F.struct("cd", "year")).alias("line"))


# ---- cache, queue, frontier


def _cache(spark: SparkSession, root: str) -> QueryCache:
    """Every event stores a vector for the question of its user."""
    cache = QueryCache(spark, run_dir(spark, "cache"))
    e = table(spark, root, "events").filter("user_id is not null")
    cache.put(e.select(F.concat(F.lit("Ερώτηση "), "user_id").alias("query"), F.array(F.col("value").cast("float")).alias("embedding"), F.col("ts").alias("at")), "m")
    return cache


@query("""WITH e AS (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
    SELECT user_id::VARCHAR AS asked, n + 1 AS access_count, TIMESTAMP '2030-01-01' AS last_accessed FROM e WHERE user_id < 40""")
def cch01(spark, root):
    """Lookups with other accents and case, some in vain and some of another model: a hit counts and moves its entry up."""
    cache = _cache(spark, root)
    at = F.expr("TIMESTAMP_NTZ '2030-01-01'")
    asked = table(spark, root, "events").filter("user_id < 40").select(F.concat(F.lit("ΕΡΏΤΗΣΗ  "), "user_id").alias("query")).distinct().unionByName(spark.sql("SELECT 'άγνωστη 1' AS query")).withColumn("at", at)
    hits = cut(cache.get(asked, "m").select("query", "access_count"))
    none = cache.get(asked, "other").count()
    last = cache.entries().filter(F.col("last_accessed") == at).select(F.trim(F.replace("query", F.lit("Ερώτηση"), F.lit(""))).alias("asked"), "last_accessed")
    shown = hits.select(F.trim(F.replace("query", F.lit("ΕΡΏΤΗΣΗ"), F.lit(""))).alias("asked"), (F.col("access_count") + none).alias("access_count"))
    return shown.join(last, "asked")


@query("SELECT 'Ερώτηση ' || user_id AS query, count(*) AS access_count, min(ts) AS created_at, max(ts) AS last_accessed, min_by(value::FLOAT, ts) AS first FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def cch02(spark, root):
    """Stores of the same question count, but the first vector stays."""
    return _cache(spark, root).entries().select("query", "access_count", "created_at", "last_accessed", F.element_at("embedding", 1).alias("first"))


@query("""WITH e AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events WHERE user_id IS NOT NULL GROUP BY user_id), k AS (SELECT * FROM e WHERE last >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY)
    SELECT least(count(*), 20) AS entries, (SELECT count(*) FROM e) - least(count(*), 20) AS removed FROM k""")
def cch04(spark, root):
    """The statistics of a cache after pruning by age and to twenty entries."""
    cache = _cache(spark, root)
    top = table(spark, root, "events").agg(F.max("ts").alias("t")).first()["t"]
    removed = cache.prune(F.lit(top), most=20, days=2)
    return cache.stats().select("entries", F.lit(removed).cast("long").alias("removed"))


@query("SELECT user_id, last FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) WHERE last >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY ORDER BY last DESC, user_id LIMIT 500")
def cch03(spark, root):
    last = table(spark, root, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    top = table(spark, root, "events").agg(F.max("ts").alias("t")).first()["t"]  # one value
    return upsert.evict(last, "last", "user_id", F.lit(top) - F.expr("INTERVAL 2 DAYS"), 500)


def _ladder_sql(cap: int, halvings: int) -> str:
    """The ladder in SQL: every level counted, and kept where the level before was cut off."""
    keys = [["year"], ["year", "category_id"], ["year", "category_id", "chamber_id"]]
    ctes = [f"l0 AS (SELECT year, category_id, chamber_id, number, {frontier.NUMBERS[0]} AS lo, {frontier.NUMBERS[1]} AS hi FROM {CUR} WHERE year IS NOT NULL)"]
    out = []
    for k in range(3 + halvings):
        own = keys[k] if k < 3 else [*keys[2], "lo", "hi"]
        if k:
            before = keys[k - 1] if k <= 3 else [*keys[2], "lo", "hi"]
            join = " AND ".join(f"c.{x} = p.{x}" for x in before)
            new = "c.lo, c.hi" if k < 3 else "CASE WHEN c.number <= (c.lo + c.hi) // 2 THEN c.lo ELSE (c.lo + c.hi) // 2 + 1 END AS lo, CASE WHEN c.number <= (c.lo + c.hi) // 2 THEN (c.lo + c.hi) // 2 ELSE c.hi END AS hi"
            there = " AND ".join(f"c.{x} IS NOT NULL" for x in own) + (" AND c.number BETWEEN c.lo AND c.hi" if k >= 3 else "")
            ctes.append(f"l{k} AS (SELECT c.year, c.category_id, c.chamber_id, c.number, {new} FROM l{k - 1} c JOIN n{k - 1} p ON {join} WHERE p.n > {cap} AND {there})")
        ctes.append(f"n{k} AS (SELECT {', '.join(own)}, count(*) AS n FROM l{k} GROUP BY {', '.join(own)})")
        fill = {"category_id": frontier.ALL_CATEGORIES, "chamber_id": frontier.ALL_CHAMBERS, "lo": frontier.NUMBERS[0], "hi": frontier.NUMBERS[1]}
        cols = ", ".join(f"{x if x in own else fill[x]}::INT AS {x}" for x in ("year", "category_id", "chamber_id", "lo", "hi"))
        out.append(f"SELECT {cols}, least(n, {cap}) AS n_found, n > {cap} AS truncated FROM n{k}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(out)}"


def _ladder(spark: SparkSession, root: str, cap: int) -> DataFrame:
    return frontier.ladder(current(spark, root, "year", "category_id", "chamber_id", "number"), cap)


@query(_ladder_sql(2, frontier.HALVINGS))
def frn01(spark, root):
    """Every partition asked for where a listing shows two rows: by year, category, chamber and halves of the numbers."""
    return _ladder(spark, root, 2)


@query(f"SELECT year, category_id, chamber_id, CASE WHEN bool_or(truncated) THEN 'truncated' ELSE 'done' END AS status, max(n_found) AS n_found FROM ({_ladder_sql(5, frontier.HALVINGS)}) GROUP BY year, category_id, chamber_id")
def frn02(spark, root):
    """The ledger: a row a partition, with what it showed itself."""
    return frontier.ledger(_ladder(spark, root, 5))


@query(f"SELECT y::INT AS year FROM generate_series({frontier.NUMBERS[0] + 1993}, 2026) g(y) WHERE y NOT IN (SELECT year FROM {CUR} WHERE year IS NOT NULL GROUP BY year HAVING count(*) <= 20)")
def frn03(spark, root):
    """The years a resumed run still has to do: those whose root was cut off, and those never asked for."""
    return frontier.years_to_do(spark, 1994, 2026, frontier.ledger(_ladder(spark, root, 20)))


@query(f"""WITH q AS (SELECT cd, CASE WHEN number % 7 = 0 THEN 5 ELSE coalesce(number % 5, 0) END AS attempts, CASE WHEN length(body) > 200 THEN sha256(body) END AS now,
        CASE WHEN year % 3 = 0 THEN NULL WHEN year % 3 = 1 THEN sha256(body) ELSE 'x' END AS held, number, year FROM {CUR}),
    t AS (SELECT * FROM q WHERE attempts < 5 ORDER BY year DESC NULLS LAST, number DESC NULLS LAST, cd LIMIT 200)
    SELECT cd, (attempts + CASE WHEN now IS NULL THEN 1 ELSE 0 END)::INT AS attempts, CASE WHEN now IS NULL THEN 'error' WHEN year % 3 = 0 OR year IS NULL THEN 'new' WHEN now = held THEN 'unchanged' ELSE 'changed' END AS outcome FROM t""")
def frn04(spark, root):
    """One batch of the queue drained: those that failed five times stay, short or missing pages count as an attempt."""
    d = current_of(spark, root, number=F.col("number"), year=F.col("year"), body=F.col("body"))
    d = cut(d.select("cd", "number", "year", "body", F.sha2("body", 256).alias("digest")))
    queue = d.select("cd", "number", "year", F.when(F.col("number") % 7 == 0, 5).otherwise(F.coalesce(F.col("number") % 5, F.lit(0))).alias("attempts"))
    held = d.filter("year % 3 <> 0").select("cd", F.when(F.col("year") % 3 == 1, F.col("digest")).otherwise("x").alias("digest"))
    return frontier.drain(queue, d.select("cd", "body"), held)


@query(f"""SELECT cd, year || '/' || coalesce(category, 'ΟΛΕΣ') || '/' || coalesce(chamber, 'ΟΛΕΣ') || CASE WHEN number IS NULL THEN '' WHEN number % 3 = 0 THEN '/num<=' || number WHEN number % 3 = 1 THEN '/num>=' || number ELSE '/num=' || number END AS partition,
    'X_TMHMA=' || coalesce(category_id, 6) || '&X_SUB_TMHMA=' || coalesce(chamber_id, 1) || '&X_TELESTIS_number=' || CASE number % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END || '&x_number=' || coalesce(number::VARCHAR, '') || '&X_TELESTIS_ETOS=1&x_ETOS=' || year AS body FROM {CUR} WHERE year IS NOT NULL""")
def txt18(spark, root):
    """Partitions in words and as the form that asks for them."""
    d = current(spark, root, "cd", "year", "number", "category", "chamber", "category_id", "chamber_id").filter("year is not null")
    op = F.when(F.col("number") % 3 == 0, frontier.AT_MOST).when(F.col("number") % 3 == 1, frontier.AT_LEAST).otherwise(frontier.EQUAL)
    words = frontier.describe(F.col("year"), F.col("category"), F.col("chamber"), op, F.col("number"))
    return d.select("cd", words.alias("partition"), text.form_encode(frontier.form(F.col("year"), F.col("category_id"), F.col("chamber_id"), op, F.col("number"))).alias("body"))


@query("SELECT id, CASE WHEN n_fetched < 1024 THEN n_fetched || ' bytes' WHEN n_fetched < 1048576 THEN round(n_fetched / 1024.0)::INT || ' kB' ELSE round(n_fetched / 1048576.0)::INT || ' MB' END AS size, started_at + INTERVAL 30 DAY < TIMESTAMP '2025-12-31' AS stale FROM (SELECT DISTINCT id, started_at, (n_fetched * 4096)::BIGINT AS n_fetched FROM crawl_run) WHERE n_fetched IS NOT NULL")
def txt17(spark, root):
    """Sizes in words, and times against a given now."""
    r = table(spark, root, "crawl_run").filter("n_fetched is not null").select("id", "started_at", (F.col("n_fetched").cast("long") * 4096).alias("b")).distinct()
    return r.select("id", text.pretty_size(F.col("b")).alias("size"), (F.col("started_at") + F.make_interval(days=F.lit(30)) < now()).alias("stale"))


# ---- streams


def _finished(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("SELECT cd, max(last_fetched) AS last_fetched FROM decision WHERE cd IS NOT NULL GROUP BY cd")
def str01(spark, root):
    """The decision table brought up to date by a file stream, in two runs."""
    base = run_dir(spark, "stream")
    d = table(spark, root, "decision").select("cd", "content_hash", "last_fetched")
    late = F.col("last_fetched") >= F.expr("TIMESTAMP_NTZ '2025-06-01'")
    for rows in (d.filter(~late | F.col("last_fetched").isNull()), d.filter(late)):
        rows.write.mode("append").parquet(f"{base}/in")
        _finished(refresh.stream_upsert(spark, f"{base}/in", "cd string, content_hash string, last_fetched timestamp_ntz", "cd", "last_fetched", f"{base}/out", f"{base}/state"))
    return refresh.current_state(spark, f"{base}/out", "cd", "last_fetched").select("cd", "last_fetched")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str02(spark, root):
    return refresh.windowed_counts(table(spark, root, "events"), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def str03(spark, root):
    """The windows that are over, counted by a stream with a watermark."""
    base = run_dir(spark, "windows")
    table(spark, root, "events").select("ts", "event_type").write.parquet(f"{base}/in")
    _finished(refresh.stream_windows(spark, f"{base}/in", "ts timestamp_ntz, event_type string", "ts", "event_type", f"{base}/out", f"{base}/state"))
    got = spark.read.schema("window_start timestamp, event_type string, n long").parquet(f"{base}/out")
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))

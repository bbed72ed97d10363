import random

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators import chunking, fulltext, fusion, incremental, multivalue, upsert, vector
from lexspark.operators.latest import latest_rows

# ---- full text


@pytest.mark.parametrize("word, stem", [("αδικοπραξία", "αδικοπραξ"), ("αδικοπραξίας", "αδικοπραξι"), ("αναίρεση", "αναιρεσ"), ("αναιρεσείων", "αναιρεσει"), ("από", "απ"), ("ΑΝ", "αν"), ("του", "τ"), ("την", "την"), ("και", "κα"), ("στο", "στ")])
def test_stems(word, stem):
    assert text.stem_word(text.fold_word(word)) == stem


def test_stem_column_agrees(spark):
    words = ["αδικοπραξία", "Αναίρεση", "του", "σωμάτων", "ΝΟΜΟΣ", "x", "αν"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.stem(text.fold(F.col("w")))).collect()
    assert [r[0] for r in got] == [text.stem_word(text.fold_word(w)) for w in words]


def test_query_plans():
    assert str(fulltext.plan("αδικοπραξίας του Δημοσίου")) == "αδικοπραξ:* & δημοσ:*"
    assert fulltext.content_words("η παραγραφή των αξιώσεων κατά του Δημοσίου") == ["παραγραφή", "αξιώσεων", "Δημοσίου"]
    assert fulltext.content_words("άρθρο 559 ΚΠολΔ") == ["άρθρο", "559", "ΚΠολΔ"]
    assert [fulltext.is_acronym(w) for w in ("ΑΚ", "ΚΠολΔ", "Αθήνα", "Α", "ΑΒΓΔΕΖΗ", "12")] == [True, True, False, False, False, False]
    assert str(fulltext.plan('"καλή πίστη" -ζημία OR δόλος')) == "καλ <-> πιστ & !ζημ | δολ"
    assert not fulltext.plan("καλή OR κακή").expanded
    assert fulltext.plan("  ").groups == ()
    with pytest.raises(ValueError):
        fulltext.plan("α" * 601)


def test_search_ranks_near_terms_first(spark):
    docs = spark.createDataFrame([(1, "ζημία από δόλο"), (2, "ζημία χωρίς άλλο τι από οποιονδήποτε δόλο"), (3, "μόνο ζημία"), (4, None), (5, "")], "id long, t string")
    index = fulltext.postings(docs, "id", "t")
    got = fulltext.search(index, docs.select(F.col("id").alias("doc")), fulltext.plan("ζημία δόλος")).orderBy(F.desc("score")).collect()
    assert [r["doc"] for r in got] == [1, 2] and 1 > got[0]["score"] > got[1]["score"] > 0
    neg = fulltext.search(index, docs.select(F.col("id").alias("doc")), fulltext.plan("ζημία -δόλο")).collect()
    assert [r["doc"] for r in neg] == [3]


def test_phrase_and_filter(spark):
    docs = spark.createDataFrame([(1, "καλή πίστη"), (2, "πίστη καλή"), (3, "η καλή πίστη του")], "id long, t string")
    index = fulltext.postings(docs, "id", "t")
    hits = fulltext.search(index, docs.filter("id < 3").select(F.col("id").alias("doc")), fulltext.plan('"καλή πίστη"'))
    assert [r["doc"] for r in hits.collect()] == [1]


def test_headline(spark):
    t = spark.createDataFrame([("Η ζημία από δόλο είναι " + "άλλο " * 60 + "ζημίας τέλος",), ("τίποτα",)], "t string")
    a, b = [r[0] for r in t.select(fulltext.headline(F.col("t"), fulltext.plan("ζημία"))).collect()]
    assert "**ζημία**" in a and " … " in a and b == "τίποτα"


# ---- fusion and vectors


def test_fusion_matches_plain_python(spark):
    rng = random.Random(4)
    rows = [(s, f"d{d}", r + 1) for s in ("chunk_lexical", "doc_lexical", "semantic") for r, d in enumerate(rng.sample(range(30), 12))]
    got = {r["doc"]: r["score"] for r in fusion.fuse(spark.createDataFrame(rows, "source string, doc string, rank int")).collect()}
    want = {}
    for s, d, r in rows:
        want[d] = want.get(d, 0) + fusion.WEIGHTS[s] / (60 + r)
    assert got == pytest.approx(want)


def test_repeats_count_once(spark):
    rows = [("semantic", "a", i) for i in (1, 2, 3)]
    (r,) = fusion.fuse(spark.createDataFrame(rows, "source string, doc string, rank int")).collect()
    assert r["score"] == pytest.approx(1 / 61) and r["ranks"] == {"semantic": 1}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [-3.0, -4.0])], "id long, v array<float>")
    assert [(r["id"], round(r["score"], 6)) for r in vector.nearest(df, "id", "v", [3.0, 4.0], 9).collect()] == [(1, 1.0), (5, -1.0)]
    assert df.select(vector.normalise(F.col("v"))).collect()[0][0] == pytest.approx([0.6, 0.8])
    e = vector.dense(vector.hash_embed(spark.createDataFrame([(1, "α β α"), (2, "")], "id long, t string"), "id", "t", 16), "id", 16).collect()
    assert len(e) == 1 and sum(x * x for x in e[0]["embedding"]) == pytest.approx(1, abs=1e-6)


# ---- passages


def test_sections_tile():
    t = "Αριθμός 1/2020 κείμενο. ΣΚΕΦΘΗΚΕ ΣΥΜΦΩΝΑ ΜΕ ΤΟ ΝΟΜΟ λόγοι. ΓΙΑ ΤΟΥΣ ΛΟΓΟΥΣ ΑΥΤΟΥΣ απορρίπτει. "
    spans = chunking.sections(t)
    assert len(spans) == 3 and "".join(t[a:b] for a, b in spans) == t


def test_long_run_ends():
    rows = chunking.passages(None, None, "Α. " + "x" * 60000)
    assert len(rows) < 100 and all(len(c) >= chunking.LEAST_CHARS for *_, c in rows)


def test_coverage_is_bounded():
    t = "Η αγωγή είναι νόμιμη και βάσιμη κατά τα άρθρα. " * 800
    rows = chunking.passages("θέμα", "περίληψη " * 5, t)
    assert rows[0][0] == "summary" and rows[0][3].startswith("θέμα\n\n")
    assert sum(b - a for p, a, b, _ in rows if p == "body") < 1.45 * len(t)


def test_chunk_documents(spark):
    df = spark.createDataFrame([("a", "s", "σύνοψη", "Κείμενο. " * 400), ("b", None, None, None), ("c", None, " ", "μικρό")], "cd string, subject string, summary string, body string")
    got = chunking.chunk_documents(df).orderBy("cd", "ordinal").collect()
    assert {r["cd"] for r in got} == {"a"} and [r["ordinal"] for r in got] == list(range(len(got)))


# ---- several values in a field

MARKS = [p for n, p in multivalue.CANDIDATES if not n.startswith("bare") and n != "and"]


@pytest.mark.parametrize(
    "field, values",
    [
        ("Α, Β, Γ.", ["Α", "Β", "Γ"]),
        ('"Ρήτρα ""ως έχει""", Νόμος 7311/2009, ', ['Ρήτρα "ως έχει"', "Νόμος 7311/2009"]),
        ("«Πλάνη, ουσιώδης»|Ανοχή", ["Πλάνη, ουσιώδης", "Ανοχή"]),
        ("Ευθύνη (ατομική; συλλογική); Τόκοι", ["Ευθύνη (ατομική; συλλογική)", "Τόκοι"]),
        ("1) Α 2) Β 3) Γ", ["Α", "Β", "Γ"]),
        ("Μίσθωση-υπομίσθωση - Τόκοι - ", ["Μίσθωση-υπομίσθωση", "Τόκοι"]),
        ("Α; ; Α", ["Α", "Α"]),
        ("Α\n\nΒ\tΓ", ["Α", "Β", "Γ"]),
        ('Μη κλειστό "εισαγωγικό, Β', ['Μη κλειστό "εισαγωγικό', "Β"]),
        ("", []),
        ("  .", []),
        (None, []),
    ],
)
def test_values(field, values):
    import re

    assert multivalue.values_of(field, re.compile("|".join(MARKS))) == values


def test_very_long_field():
    import re

    n = 20_000
    assert len(multivalue.values_of(", ".join(["Αξία"] * n), re.compile("|".join(MARKS)))) == n


def test_split_values_learns_marks_by_source(spark):
    rows = [(str(i), "Αλφα, Βητα, Γαμμα", "x", 1) for i in range(5)] + [("k", "Αλφα και βητα", "x", 1), ("n", None, "x", 1), ("z", "", None, 1), ("p", "Ενα|Δυο", None, 1)]
    df = spark.createDataFrame(rows, "cd string, subject string, source string, pos int")  # an extra column named as an output
    got = multivalue.split_values(df, "cd", "subject", F.col("source")).orderBy("cd", "pos").collect()
    by = {}
    for r in got:
        by.setdefault(r["cd"], []).append(r["val"])
    assert by["0"] == ["Αλφα", "Βητα", "Γαμμα"] and by["k"] == ["Αλφα και βητα"] and by["p"] == ["Ενα", "Δυο"] and "n" not in by and "z" not in by
    assert multivalue.split_values(df.limit(0), "cd", "subject").count() == 0


# ---- incremental work


def test_refresh_redoes_only_what_changed(spark, tmp_path):
    schema = "cd string, v int, part_no int"
    df = spark.createDataFrame([(f"k{i}", i, 7) for i in range(200)] + [("k1", 1, 7), (None, 3, 7)], schema)
    calls = []

    def work(rows):
        calls.append(rows)
        return latest_rows(rows, "cd", "v", ["cd", "v"]).filter("v % 2 = 0")

    path = f"file://{tmp_path}/t"
    out, changed = incremental.refresh(df, "cd", ["v"], work, path)
    assert out.count() == 100 and len(changed) > 10
    _, again = incremental.refresh(df, "cd", ["v"], work, path)
    assert again == []
    more = df.withColumn("v", F.when(F.col("cd") == "k2", 3).otherwise(F.col("v")))
    out, changed = incremental.refresh(more, "cd", ["v"], work, path)
    assert len(changed) == 1 and out.count() == 99
    out, _ = incremental.refresh(more.limit(0), "cd", ["v"], work, path)
    assert out.count() == 0


def test_refresh_survives_a_failed_run(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "cd string, v int")
    path = f"file://{tmp_path}/t"

    def broken(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        incremental.refresh(df, "cd", ["v"], broken, path)
    out, changed = incremental.refresh(df, "cd", ["v"], lambda r: r, path)
    assert changed and sorted(r["v"] for r in out.collect()) == list(range(50))


def test_digests(spark):
    d = "a" * 63 + "B"
    rows = [(d,), (f" {d.lower()} ",), (f"SHA256:{d}",), ("",), (None,), ("xyz",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(incremental.digest_of("h")).collect()]
    assert got == [d.lower()] * 3 + [None] * 3


# ---- changes of tables


def test_upsert_outcomes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "cd string, h string").selectExpr("cd", "h", "timestamp_ntz'2020-01-01' as first_seen", "timestamp_ntz'2020-01-01' as last_fetched", "cast(null as timestamp_ntz) as last_changed")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "cd string, h string")
    got = {r["cd"]: r["outcome"] for r in upsert.upsert_changed(old, new, "cd", "h", F.expr("timestamp_ntz'2021-01-01'")).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "absent", "d": "new"}


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 5, "q")], "cd string, v int, t string")
    assert sorted(map(tuple, latest_rows(df, "cd", "v", ["cd", "t"]).collect())) == [("a", "y"), ("b", "z")]


# ---- pages and text


def test_html_text(spark):
    f = lambda s: spark.createDataFrame([(s,)], "h string").select(text.text_of_html(F.col("h"))).first()[0]
    assert f("a&nbsp&nbspb") == "a b" and f("a<br>b") == "a\nb" and f("<script>x<b></script>y &amp; z") == "y & z"


def test_fold(spark):
    for s in ("ΆΣΟΣ", "Ϊδιος", "ἀγορά", "é", "Λόγος"):
        assert spark.createDataFrame([(s,)], "s string").select(text.fold(F.col("s"))).first()[0] == text.fold_word(s)


def test_fold_of_final_sigma(spark):
    rows = [("ΥΠΟΘΕΣΕΙΣ",), ("ΝΟΜΟΣ",), ("νόμος",), ("100%",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    has = lambda p: [r[0] for r in df.filter(text.contains_folded(F.col("s"), p)).collect()]
    assert has("ΥΠΟΘΕΣ") == ["ΥΠΟΘΕΣΕΙΣ"] and has("νομοσ") == ["ΝΟΜΟΣ"] and has("όμος") == ["νόμος"] and has("%") == ["100%"]


def shown(words, heads, most, least):
    """The fragments of a headline by plain loops."""
    at = [i for i, w in enumerate(words) if any(text.fold_word(w).startswith(h) for h in heads)]
    if not at:
        return " ".join(words[:least])
    inside = lambda s: [x for x in at if s <= x < s + most]
    one = max(at, key=lambda s: (len(inside(s)), -s))
    rest = [s for s in at if s >= one + most or s <= one - most]
    picked = sorted([one, *([max(rest, key=lambda s: (len(inside(s)), -s))] if rest else [])])
    out = []
    for s in picked:
        size = inside(s)[-1] - s + 1
        length = max(size, least)
        begin = max(0, min(s - max(0, least - size) // 2, len(words) - length))
        out.append(" ".join(f"**{w}**" if begin + i in at else w for i, w in enumerate(words[begin : begin + length])))
    return " … ".join(out)


def test_headlines_against_plain_loops(spark):
    rng = random.Random(2)
    words = ["ζημία", "δόλος", "ζημίας", "άλλο", "και", "τι", "έτσι", "πάλι"]
    texts = [[rng.choice(words if rng.random() < 0.2 else words[3:]) for _ in range(rng.randrange(1, 150))] for _ in range(40)]
    q = fulltext.plan("ζημία δόλος")
    df = spark.createDataFrame([(i, " \n ".join(t)) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["h"] for r in df.select("i", fulltext.headline(F.col("t"), q).alias("h")).collect()}
    heads = [t.words[0] for t in q.terms]
    assert got == {i: shown(t, heads, fulltext.MOST_WORDS, fulltext.LEAST_WORDS) for i, t in enumerate(texts)}


def test_acronyms_and_function_words_as_columns(spark):
    words = ["ΑΠ", "ΑΚ", "ΚΠολΔ", "ΕΣΔΑ", "από", "αν", "ΑΝ", "Δημοσίου", "α", "559", "Κ1", "ΑΒΓΔΕΖΗ", "του1", "η", "Η_Θ"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.col("w").rlike(fulltext.ACRONYM).alias("a"), fulltext.searches(F.col("w")).alias("s")).collect()
    assert [r["w"] for r in got if r["a"]] == [w for w in words if fulltext.is_acronym(w)] == ["ΑΠ", "ΑΚ", "ΚΠολΔ", "ΕΣΔΑ", "ΑΝ", "Κ1", "Η_Θ"]
    assert [r["w"] for r in got if r["s"]] == [w for w in words if fulltext.content_words(w)]
    assert str(fulltext.plan("“καλή πίστη”")) == "καλ & πιστ" and not fulltext.plan("“καλή πίστη”").expanded


# ---- pages

LISTING = """<table><tr><td width=30><div>1)</div></td><td width=100>
<a onmouseout="x" class="b" href="show.asp?cd=AB1&apof=7_2011&info=ΠΟΙΝΙΚΕΣ -  ΣΤ">7/2011</a>\t</td>
<td class="c">\n &nbsp\n</td></tr><td><a href="show.asp?cd=CD2&amp;apof=8_2012&amp;info=Νόμου+1 -  Ανευ πινακίου">8/2012</a></td><td>Πρώτη.<br>Δεύτερη &laquo;x&raquo; &#945;</td>
<a href="show.asp?cd=EF3&apof=9_2013">9/2013</a> <td>no cell of its own</td>
<a href="show.asp?cd=AB1&apof=7_2011&info=x">7/2011</a></td><td>later snippet</td></table>"""


def test_listings(spark):
    from lexspark.sources import pages

    df = spark.createDataFrame([(LISTING, 1), (None, 2), ("<html>nothing</html>", 3), ("περισσότερα από 3000", 4)], "html string, page int")
    got = {r["cd"]: tuple(r)[1:] for r in pages.listing(df, "html", "page").collect()}
    assert got["CD2"] == (8, 2012, "Νόμου 1", "Ανευ πινακίου", "Πρώτη.\nΔεύτερη «x» α")
    assert got["EF3"] == (9, 2013, None, None, None) and got["AB1"][4] == "later snippet" and len(got) == 3
    first = {r["cd"]: r for r in pages.references(df, "html", "page").filter("pos = 1").collect()}
    assert (first["AB1"]["category"], first["AB1"]["chamber"], first["AB1"]["snippet"]) == ("ΠΟΙΝΙΚΕΣ", "ΣΤ", None)
    assert [r[0] for r in df.orderBy("page").select(pages.truncated(F.col("html"))).collect()] == [False, None, False, True]


def test_theme_index(spark):
    from lexspark.sources import pages

    html = '<a href="r.asp?s=2&amp;code=5" class=x> Άρση_ &amp; μη </a><a href="r.asp?s=2&code=5">again</a><a href="r.asp?s=2&code=6"> </a>'
    assert [tuple(r) for r in pages.theme_index(spark.createDataFrame([(html,)], "h string"), "h").collect()] == [(5, "Άρση  & μη", "Άρση_ & μη")]


def test_decision_pages(spark):
    from lexspark.sources import pages

    page = """<body>Επιστροφή <script>ask("prompt")</script><font face="Arial" size="3">Απόφαση <b> 144 / 2015 </b>&nbsp<u>(Γ, ΠΟΛΙΤΙΚΕΣ)</u><p>
<i><b>Θέμα:</b><br>Αδικοπραξία, Νομή .</i><i><b>Περίληψη:</b> Αγωγή &amp; τόκος.</i><p align='justify' style='line-height: 160%'>Αριθμός 144/2015<br>Κείμενο.<p align="center">Επιστροφή</font></body>"""
    plain = '<font face="Arial" size="3">απόφαση <b>1/2024</b> (ΠΟΙΝΙΚΕΣ)<br>Μόνο κείμενο</font>'
    df = spark.createDataFrame([("a", page), ("b", plain), ("c", None), ("d", "<p>x</p>")], "cd string, h string")
    got = {r["cd"]: r for r in pages.decision_page(df, "cd", "h").collect()}
    a = got["a"]
    assert (a["number"], a["year"], a["chamber"], a["category"]) == (144, 2015, "Γ", "ΠΟΛΙΤΙΚΕΣ")
    assert a["subjects"] == ["Αδικοπραξία", "Νομή"] and a["summary"] == "Αγωγή & τόκος." and a["body"] == "Αριθμός 144/2015\nΚείμενο."
    b = got["b"]
    assert (b["number"], b["chamber"], b["category"], b["summary"], b["subjects"]) == (1, None, "ΠΟΙΝΙΚΕΣ", None, []) and "Μόνο κείμενο" in b["body"]
    assert got["c"]["body"] is None and got["d"]["body"] == "x" and got["d"]["number"] is None


def test_pages_in_code_pages(spark):
    from lexspark.sources import archive

    rows = [(bytearray("Απόφαση".encode("cp1253")), "text/html"), (bytearray("Απόφαση".encode() + b"\xff"), "text/html; charset=UTF-8"), (bytearray(b"\xd2x"), None), (None, "x"), (bytearray("{}".encode()), "application/json")]
    df = spark.createDataFrame(rows, "c binary, t string")
    assert [r[0] for r in df.select(archive.decode(F.col("c"), F.col("t"))).collect()] == ["Απόφαση", "Απόφαση\ufffd", "\ufffdx", None, "{}"]
    assert df.limit(1).select(text.form_encode([("α", F.lit("ΟΛΕΣ 1")), ("b", F.lit(None))])).first()[0] == "%E1=%CF%CB%C5%D3%201&b="


# ---- cache, index, frontier


def test_query_cache(spark, tmp_path):
    from lexspark.operators.cache import QueryCache

    c = QueryCache(spark, f"file://{tmp_path}/c")
    at = lambda d: F.expr(f"TIMESTAMP_NTZ '2025-01-{d:02d}'")
    ask = lambda q, d: spark.createDataFrame([(q,)], "query string").withColumn("at", at(d))
    assert c.get(ask("Δοκιμή", 1), "m").count() == 0
    for i in range(5):
        c.put(spark.createDataFrame([(f"Δοκιμή {i}", [0.5 + i])], "query string, embedding array<float>").withColumn("at", at(2 + i)), "m")
    hit = c.get(ask("ΔΟΚΙΜΗ  0", 20), "m").collect()
    assert hit[0]["access_count"] == 2 and hit[0]["embedding"] == [0.5] and c.get(ask("δοκιμή 0", 20), "other").count() == 0
    c.put(spark.createDataFrame([("δοκιμη 1", [9.0])], "query string, embedding array<float>").withColumn("at", at(10)), "m")
    assert c.prune(at(21), most=2, days=365) == 3
    left = {r["query"]: (r["embedding"], r["access_count"]) for r in c.entries().collect()}
    assert left == {"Δοκιμή 0": ([0.5], 2), "Δοκιμή 1": ([1.5], 2)}
    assert c.prune(at(21), days=5) == 1 and c.stats().first()["entries"] == 1
    off = QueryCache(spark, None)
    off.put(ask("x", 1).withColumn("embedding", F.array(F.lit(1.0).cast("float"))), "m")
    assert off.get(ask("x", 1), "m").count() == 0 and off.prune(at(1)) == 0


def test_passage_index(spark, tmp_path):
    from lexspark.operators.passage_index import PassageIndex

    index = PassageIndex(spark, f"file://{tmp_path}/i", 32)
    long = "Η αγωγή είναι νόμιμη και βάσιμη κατά τα άρθρα του νόμου. " * 5
    d = spark.createDataFrame([("a", "s", "μία σύνοψη", long), ("b", None, None, long), ("c", None, None, None)], "cd string, subject string, summary string, body string")
    assert index.build(d) == {"decisions": 2, "passages": 3} and index.build(d) == {"decisions": 0, "passages": 0}
    # an edit of a headnote is taken up; a decision that gives no passage any more loses its old ones
    e = spark.createDataFrame([("a", "s", "άλλη σύνοψη", long), ("b", None, None, "μικρό")], d.schema)
    assert index.build(e)["decisions"] == 2
    rows = index.passages().collect()
    assert {r["cd"] for r in rows} == {"a"} and any("άλλη" in r["content"] for r in rows) and all(len(r["embedding"]) == 32 for r in rows)
    with pytest.raises(ValueError, match="local:hash:32"):
        index.check([0.0] * 16)
    with pytest.raises(RuntimeError, match="reset"):
        PassageIndex(spark, f"file://{tmp_path}/i", 16).migrate()
    assert not index.has_vector_index()
    index.build_vector_index()
    q = rows[0]["embedding"]
    assert index.has_vector_index() and round(index.nearest(q, 1, probes=1).first()["score"], 5) == 1.0
    index.reset()
    assert index.passages().count() == 0 and not index.has_vector_index() and index.space() is None


def test_frontier(spark):
    from lexspark.operators import frontier

    rows = [(2001, 1, 2, i) for i in range(1, 60)] + [(2001, 2, 3, 5)] + [(2002, 1, 2, 7), (2002, None, None, None), (None, 1, 2, 3)]
    asked = frontier.ladder(spark.createDataFrame(rows, "year int, category_id int, chamber_id int, number int"), cap=10)
    got = asked.collect()
    root = {r["year"]: r["truncated"] for r in got if r["category_id"] == 6}
    assert root == {2001: True, 2002: False} and all(r["n_found"] <= 10 for r in got)
    halves = [r for r in got if r["chamber_id"] == 2 and (r["lo"], r["hi"]) != frontier.NUMBERS]
    assert len({(r["lo"], r["hi"]) for r in halves}) == len(halves) == 7 and halves
    ledger = frontier.ledger(asked)
    assert [r[0] for r in frontier.done_years(ledger).collect()] == [2002]
    assert sorted(r[0] for r in frontier.years_to_do(spark, 2001, 2003, ledger).collect()) == [2001, 2003]


def test_queue_is_drained_in_batches(spark):
    from lexspark.operators import frontier

    queue = spark.createDataFrame([("a", 1, 2001, 0), ("b", 2, 2002, 4), ("c", 3, 2003, 5), ("d", None, None, 0)], "cd string, number int, year int, attempts int")
    pages = spark.createDataFrame([("a", "x" * 300), ("b", "short")], "cd string, body string")
    stored = spark.createDataFrame([("a", "other")], "cd string, digest string")
    one = frontier.drain(queue, pages, stored, batch=2)
    assert {r["cd"]: (r["attempts"], r["outcome"]) for r in one.collect()} == {"a": (0, "changed"), "b": (5, "error")}
    left = frontier.after(queue, one)
    assert {r["cd"]: r["attempts"] for r in left.collect()} == {"b": 5, "c": 5, "d": 0}
    assert [r["cd"] for r in frontier.drain(left, pages, stored).collect()] == ["d"]


# ---- incremental layout


def test_the_work_sees_each_row_once_and_parts_follow_the_rows(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    seen = spark.sparkContext.accumulator(0)

    def work(rows):
        @F.udf("int")
        def look(v):
            seen.add(1)
            return v

        return rows.withColumn("v", look("v"))

    df = spark.createDataFrame([(f"k{i}", i) for i in range(1000)], "cd string, v int")
    out, changed = incremental.refresh(df, "cd", ["v"], work, path)
    assert seen.value == 1000 and out.count() == 1000
    big = spark.createDataFrame([(f"k{i}", i) for i in range(40_000)], "cd string, v int")
    out, changed = incremental.refresh(big, "cd", ["v"], lambda r: r, path)
    assert out.count() == 40_000 and len(changed) > 300 and incremental.parts_for(40_000) == 400


def test_hybrid_shows_what_it_found(spark):
    d = spark.createDataFrame([("a", 2001, 1), ("b", 2002, 2), ("c", 2003, 3)], "cd string, year int, number int")
    c = spark.createDataFrame([(1, "a", "body", 1, "ζημία από δόλο", [1.0, 0.0]), (2, "a", "summary", 0, "η ζημία", [0.0, 1.0]), (3, "b", "body", 0, "τόκος", [1.0, 0.1])], "id long, cd string, part string, ordinal int, content string, embedding array<float>")
    ci = fulltext.postings(c, "id", "content")
    di = fulltext.postings(spark.createDataFrame([("c", "ζημία")], "cd string, t string"), "cd", "t")
    meta = d.select("cd", F.concat_ws("/", "number", "year").alias("citation"))
    got = fusion.hybrid(d, c, ci, di, "ζημία", [1.0, 0.0], meta=meta).collect()
    by = {r["doc"]: r for r in got}
    assert [r["doc"] for r in got][0] == "a" and by["a"]["citation"] == "1/2001" and by["a"]["matched_by"] == ["chunk_lexical", "semantic"]
    assert [p["part"] for p in by["a"]["passages"]] == ["summary", "body"] and by["a"]["passages"][0]["text"] == "η **ζημία**"
    assert by["c"]["passages"] == [] and by["c"]["matched_by"] == ["doc_lexical"]
    assert [r["doc"] for r in fusion.hybrid(d, c, ci, di, "  ", limit=2).collect()] == ["c", "b"]
    with pytest.raises(ValueError):
        fusion.hybrid(d, c, ci, di, "x", mode="fuzzy")


def test_ties_come_as_they_first_appear(spark):
    rows = [("doc_lexical", "z", 1), ("chunk_lexical", "b", 2), ("chunk_lexical", "c", 1), ("semantic", "y", 2), ("semantic", "x", 1)]
    f = fusion.fuse(spark.createDataFrame(rows, "source string, doc string, rank int"), {"chunk_lexical": 1.0, "doc_lexical": 1.0, "semantic": 1.0})
    assert [r["doc"] for r in fusion.top(f, 5).collect()] == ["c", "z", "x", "b", "y"]


def test_a_stream_keeps_the_latest_of_every_key(spark, tmp_path):
    from lexspark.streaming import refresh

    base, schema = f"file://{tmp_path}", "cd string, v int, t string"
    for rows in ([("a", 1, "x"), ("a", 2, "y"), (None, 9, "z")], [("a", 1, "old"), ("b", None, "n"), ("b", 3, "m")], []):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/in")
        refresh.stream_upsert(spark, f"{base}/in", schema, "cd", "v", f"{base}/out", f"{base}/state").awaitTermination()
    got = refresh.current_state(spark, f"{base}/out", "cd", "v")
    assert sorted(map(tuple, got.collect())) == [("a", 2, "y"), ("b", 3, "m")]

import random
from collections import Counter

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from lexspark.llm import encoding, lookalike, mixture, neardup, terms, tokenizer, truncation

SENTENCES = [
    "Το δικαστήριο έκρινε ότι η αγωγή είναι νόμιμη και βάσιμη.",
    "Ο εναγόμενος υποστήριξε ότι η αξίωση έχει παραγραφεί προ πολλού.",
    "Κατά την κρίση του δικαστηρίου η σύμβαση λύθηκε με καταγγελία.",
    "Η εκκαλούσα εταιρεία δεν προσκόμισε κανένα έγγραφο για την απόδειξη.",
    "Συνεπώς ο λόγος της έφεσης είναι αβάσιμος και πρέπει να απορριφθεί.",
    "Ο μάρτυρας κατέθεσε πως η παράδοση έγινε στις 12 Μαΐου 2010.",
]


def corpus(n, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.choice(SENTENCES) for _ in range(4)) for _ in range(n)]


# ---- term counts


def brute(texts, n):
    tf, df = Counter(), Counter()
    for t in texts:
        w = regex.findall(r"\p{L}+", t)
        grams = [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
        tf.update(grams)
        df.update(set(grams))
    return {g: (tf[g], df[g]) for g in tf}


def test_ngrams_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("αβγδ") for _ in range(rng.randrange(0, 9))) for _ in range(200)] + ["", None, "1 2", "Α-α·Α"]
    df = spark.createDataFrame([(t, 1) for t in texts], "t string, n int").repartition(5)
    got = {r["term"]: (r["tf"], r["df"]) for r in terms.ngram_counts(df, "t", 3).collect() if r["n"]}
    assert got == brute([t for t in texts if t is not None], 3)


def test_marks(spark):
    df = spark.createDataFrame([("α β",), ("α",), ("α β",), ("α γ",), ("",)] + [("δ",)] * 6, "t string")
    got = {r["term"]: r["mark"] for r in terms.marked(terms.ngram_counts(df, "t")).collect()}
    assert got == {"α": "common", "β": "rare", "γ": "rare", "δ": "common"}
    assert terms.marked(terms.ngram_counts(df.limit(0), "t")).count() == 0


# ---- near duplicates


def jaccard(a, b, k=3):
    s = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (regex.findall(r"[\p{L}\p{Nd}]+", x) for x in (a, b))]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"λέξη{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        w = [rng.choice(words) for _ in range(60)]
        texts.append(" ".join(w))
        for _ in range(rng.randrange(0, 4)):
            v = list(w)
            for _ in range(rng.randrange(0, 7)):
                v[rng.randrange(60)] = rng.choice(words)
            texts.append(" ".join(v))
    texts += [texts[0]] * 40 + ["μία δύο", "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, content string, tid string")
    recs = neardup.records(df, "id", "content", "f")
    got = {(r["key_a"], r["key_b"]) for r in neardup.key_pairs(recs, neardup.members(recs, 3), 3, 0.6).collect()}
    keep = [(str(i), t) for i, t in enumerate(texts) if t and len(t.split()) >= 3]
    want = {(min(a, b), max(a, b)) for i, (a, s) in enumerate(keep) for b, t in keep[:i] if jaccard(s, t) >= 0.6}
    assert got <= want and len(got & want) >= 0.99 * len(want)


def test_large_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    base = [f"w{i}" for i in range(160)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i:]) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    recs = neardup.records(df, "id", "content", "f")
    assert neardup.key_pairs(recs, neardup.members(recs, 5), 5, 0.8).count() == 30 * 29 // 2


def test_no_texts(spark):
    df = spark.createDataFrame([], "id int, content string")
    recs = neardup.records(df, "id", "content", "f")
    assert neardup.key_pairs(recs, neardup.members(recs, 3), 3, 0.6).count() == 0


# ---- wrong encodings


@pytest.mark.parametrize("read_as, written", [("cp1253", "utf-8"), ("cp1252", "utf-8"), ("latin_1", "utf-8"), ("latin_1", "cp1253"), ("cp1251", "cp1253"), ("mac_greek", "cp1253"), ("cp1253", "cp737")])
def test_damage_is_found_and_undone(spark, read_as, written):
    def damage(t):
        out = []
        for b in t.encode(written):
            try:
                out.append(bytes([b]).decode(read_as))
            except UnicodeDecodeError:
                out.append(chr(b))
        return "".join(out)

    texts = corpus(80)
    whole = damage(texts[3])
    words = texts[7].split(" ")
    part = " ".join(words[:6] + [damage(" ".join(words[6:14]))] + words[14:])
    rows = [(f"k{i}", 1, t, 9) for i, t in enumerate(texts)] + [("whole", 1, whole, 9), ("part", 1, part, 9), ("none", 1, None, 9), ("empty", 1, "", 9), ("alien", 1, "règlement Договор Verhältnismäßigkeit " + texts[0], 9), (None, 1, whole, 9)]
    df = spark.createDataFrame(rows, "cd string, v int, body string, pos int")
    spans = encoding.damaged_spans(df, "cd", "v", ["body"])
    assert {r["key"] for r in spans.collect()} == {"whole", "part"}
    back = {r["key"]: r["text"] for r in encoding.restored(df, spans, "cd", "v").collect()}
    assert back["part"] == texts[7] and back["whole"] == texts[3]


def test_lost_bytes(spark):
    texts = corpus(60)
    hurt = texts[0].encode("utf-8").replace("ή".encode(), b"\xce").decode("cp1253", "replace")
    df = spark.createDataFrame([(f"k{i}", 1, t) for i, t in enumerate(texts)] + [("x", 1, hurt)], "cd string, v int, body string")
    assert [r["key"] for r in encoding.damaged_spans(df, "cd", "v", ["body"]).collect()] == ["x"]


def test_damage_of_one_field_is_that_of_both(spark):
    from lexspark.llm import queries

    hurt = SENTENCES[1].replace("παραγραφεί", "παραγραφεί".encode("cp1253").decode("mac_greek"))
    rows = [(f"k{i}", 1, t, SENTENCES[0]) for i, t in enumerate([" ".join(SENTENCES * 5)] * 100)] + [("x", 1, SENTENCES[2], hurt)]
    df = spark.createDataFrame(rows, "cd string, last_fetched int, body string, summary string")
    both = queries._garbled(df, ["body", "summary"]).select("cd", "field").collect()
    assert [tuple(r) for r in both] == [("x", "summary")]
    assert queries._garbled(df, ["summary"]).select("cd", "field").collect() == both and queries._garbled(df, ["body"]).count() == 0


def test_no_rows_no_damage(spark):
    df = spark.createDataFrame([], "cd string, v int, body string")
    assert encoding.damaged_spans(df, "cd", "v", ["body"]).count() == 0


def test_every_reading_of_repeated_damage_is_followed():
    def misread(t, read_as):
        back = {b: c for c, b in encoding._bytes_of(read_as).items()}
        return "".join(chr(b) if b < 128 else back[b] for b in t.encode())

    for ways in (["cp1253", "cp1253", "mac_roman"], ["cp1253", "cp1252", "cp866"], ["cp1253", "latin_1", "cp866"], ["cp1252"] * 4):
        token = "δικαστήριο"
        for way in ways:
            token = misread(token, way)
        assert "δικαστήριο" in [text for _, text, _, _ in encoding.readings(token)]


def test_viterbi_needs_more_than_one_weak_token():
    assert encoding.viterbi([3], [2.0], ["a"])[1] == [] and encoding.viterbi([3, 4, 5], [2.5, 2.5, 2.5], ["a"] * 3)[1] == [0, 1, 2]


# ---- look-alikes


@pytest.mark.parametrize(
    "word, look",
    [("Κατά", "Κατά"), ("Κaτά", "Κατά"), ("σύµβαση", "σύμβαση"), ("ｍａｊｅｕｒｅ", "majeure"), ("swаp", "swap"), ("Αν​α", "Ανα"), ("ή", "ή"), ("ἀγορά", "αγορά"), ("règlement", "règlement"), ("Πλάνη".replace("Π", "П"), "Πλάνη")],
)
def test_what_words_look_like(word, look):
    assert lookalike.mapped(word)[0] == look


def test_irregular_texts_and_their_form(spark):
    texts = {"a": "Η παραγραφή ΚΑΙ η αξίωση", "b": "Η παρaγραφή ΚΑΙ η αξίωση", "c": "Η παραγραφή ΚΑΙ η αξίωση", "d": "Η παραγραφή KAI η αξίωση", "e": "όρος software, Договор και règlement", "f": "άρθρο ５", "g": "παραγραφη\u0301", "n": None, "0": "", "z": "ΠΑΡΑΓΡΑΦΗ"}
    df = spark.createDataFrame([("f", k, 1, t) for k, t in texts.items()] + [("f", None, 1, "ａ")] + [("f", "a", 1, texts["a"])] * 3, "field string, key string, version int, text string")
    assert {r["key"] for r in lookalike.irregular(df).collect()} == {"b", "c", "d", "f", "g"}
    forms = {r["key"]: r["text"] for r in lookalike.normalised(df).collect()}
    assert forms["b"] == forms["c"] == forms["d"] == forms["a"] == texts["a"] and forms["e"] == texts["e"] and forms["f"] == "άρθρο 5" and forms["z"] == "ΠΑΡΑΓΡΑΦΗ" and "n" not in forms
    assert lookalike.irregular(df.limit(0)).count() == 0


# ---- tokens


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = tokenizer.PerfectHash(keys)
    assert sorted(h.index.tolist()) == list(range(5000)) and h.places(keys).tolist() == list(range(5000))


def test_ids_equal_the_public_tokenizer(spark):
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    t = Tokenizer.from_file(tokenizer.DEFAULT_RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = corpus(5) + ["", None, " ", "  a  b\n\n c\t", "don't <|endoftext|> I'LL", "日本語 😀 ​ x", "a" * 5000, "é́", "\x00\x07", "1234567 ½ ٣"]
    df = spark.createDataFrame([(i, x, "q") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokenizer.count_tokens(df).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert tokenizer.encode(df.limit(0)).count() == 0


# ---- mixing


def test_pfair_is_within_one_block():
    w = {"a": 0.5, "b": 0.3, "c": 0.2}
    seen = Counter()
    for k, (s, _) in enumerate(mixture.pfair(w, 500), 1):
        seen[s] += 1
        assert all(abs(seen[x] - w[x] * k) < 1 for x in w)


def test_quotas():
    assert mixture.quotas({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5, "c": 0.5}, {"a": 2, "b": 1, "c": 3}) == {"a": 100.0, "b": 100.0}
    assert mixture.quotas({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 100) == {"b": 20.0, "a": 80.0}
    assert mixture.quotas({}, {"a": 1.0}, {"a": 1}) == {}


def test_mix(spark):
    rows = [(i, t, "big") for i, t in enumerate(corpus(300))] + [(1000 + i, t, "small") for i, t in enumerate(corpus(20, 1))] + [(5000, None, "big"), (5001, "", "small"), (5002, "x", None), (5003, "x", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("slot", F.lit(1))
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    out, report = mixture.mix(docs, targets)
    got = out.collect()
    assert max(Counter((r["doc_id"]) for r in got).values()) <= 3 and {r["source"] for r in got} == {"big", "small"}
    share = {r["source"]: r["reached_share"] for r in report.collect()}
    assert share["none"] == 0 and share["big"] == pytest.approx(0.6, abs=0.02) and sum(share.values()) == pytest.approx(1)
    out, report = mixture.mix(docs.limit(0), targets)
    assert out.count() == 0 and {r["reached_share"] for r in report.collect()} == {0.0}


# ---- truncation


def test_cut_texts(spark):
    whole = corpus(120) + [t + "\nΑκριβές αντίγραφο" for t in corpus(6, 2)] + [t + "\nΘέση σφραγίδας" for t in corpus(8, 6)] + [t + "\nΑθήνα, 3 Μαΐου 2010" for t in corpus(2, 3)] + ["Όλα καλά!", "Τέλος; ", "Τέλος. -----", None, "", "  "]
    cut = [t[: 40 + i] for i, t in enumerate(corpus(10, 4))] + ["Ο μάρτυρας κατέθεσε πως η παράδοση", "Το δικαστήριο έκρινε…", "Το δικαστήριο έκρινε ότι η αγ�", "Η αγωγή είναι νόμιμη (", "Ο μάρτυρας κατέθεσε..."]
    cut = [c for c in cut if not c.endswith(".") or c.endswith("...")]
    rows = [(i, t, "s" if i % 3 else None, False) for i, t in enumerate(whole + cut)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cut boolean")
    found = truncation.truncated(df)
    n = len(whole)
    assert sorted(r["doc_id"] for r in found.filter("cut").collect()) == list(range(n, n + len(cut)))
    assert sum(r["n_cut"] for r in truncation.rates(found).collect()) == len(cut)
    assert truncation.truncated(df.limit(0)).count() == 0


def test_number_cut_before_its_end(spark):
    texts = [f"Απόφαση με έγγραφο με αριθμό {1000 + i}/{i % 28 + 1}.3.2001 και ποσό των {i}.{i + 100},50 ευρώ." for i in range(10, 60)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts + ["Απόφαση με έγγραφο με αριθμό 8888/3."])], "doc_id long, text string, source string")
    assert [r["doc_id"] for r in truncation.truncated(df).filter("cut").collect()] == [50]


def test_no_closing_line_is_learnt_from_cuts(spark):
    whole = corpus(60) + [t + "\nΗ εκκαλούσα εταιρεία νίκησε." for t in corpus(6, 7)] + [t + "\nΘέση σφραγίδας" for t in corpus(8, 6)]
    cut = [t + "\nΗ εκκαλ" for t in corpus(5, 8)] + [t + "\nΗ εκκαλούσα" for t in corpus(5, 9)] + [t + "\nΗ" for t in corpus(5, 10)] + [t + "\nΤέλος ανα" for t in corpus(5, 11)]
    whole += [t + " Αναβάλλει αναβολή αναίρεση ανατροπή αναγκαία αναδοχή ανακοπή." for t in corpus(4, 12)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(whole + cut)], "doc_id long, text string, source string")
    n = len(whole)
    assert sorted(r["doc_id"] for r in truncation.truncated(df).filter("cut").collect()) == list(range(n, n + len(cut)))


def test_an_unknown_prefix_outweighs_a_closing_line(spark):
    whole = corpus(60) + [t + "\nΟ Πρόεδρος Πρωτοδικών" for t in corpus(4, 6)] + [t + "\nΑκριβές αντίγραφο" for t in corpus(4, 7)] + ["Ο Πρόεδρος Εφετών απουσίαζε, τα ακριβές αντίγραφου λείπουν."] * 9
    cut = [t + "\nΟ Πρόεδρος Εφετ" for t in corpus(3, 8)] + ["Ο Πρόεδρος Παπαδόπου"]
    whole += ["Ο δικηγόρος Παπαδόπουλος και ο γιατρός Παπαδόπουλος ήρθαν."]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(whole + cut)], "doc_id long, text string, source string")
    n = len(whole)
    assert sorted(r["doc_id"] for r in truncation.truncated(df).filter("cut").collect()) == list(range(n, n + len(cut)))


def test_formulas_close_only_whole(spark):
    ends = ["Ο Πρόεδρος – Η Γραμματέας", "Η Γραμματέας της έδρας", "Θεωρήθηκε αυθημερόν", "Ο Πρόεδρος Ν. Παπάς", "The Registrar, John Smith", "Ο Πρόεδρος Ν. Παπάς – Η Γραμματέας Μ. Παππά", "(υπογραφή)"]
    broken = ["Θεωρήθηκε αυθημ", "Ο Πρόεδρος – Η Γραμμ", "Η Γραμματέας της έδ", "Ο Πρόεδρος ανέφερε ότι η", "Ο Πρόεδρος – Η", "The Registrar of"]
    texts = [f"{t}\n{e}" for t, e in zip(corpus(len(ends + broken), 9), ends + broken)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in truncation.truncated(df).filter("cut").collect()) == list(range(len(ends), len(texts)))


def test_a_formula_that_others_continue_is_cut(spark):
    texts = [t + "\nΗ Γραμματέας της έδρας" for t in corpus(15, 9)] + [corpus(1, 10)[0] + "\nΗ Γραμματέας"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert [r["doc_id"] for r in truncation.truncated(df).filter("cut").collect()] == [15]


def test_lines_are_continued_by_characters(spark):
    texts = spark.createDataFrame([("Η αγωγή\nΗ αίτηση 12 της",), ("Η α",), ("Η  αγωγή",), ("x " * 200,)], "text string")
    lines = spark.createDataFrame([("Η α",), ("Η αγωγή",), ("Η αίτηση 9",), ("Η",), ("x x x x x x",), ("ω",)], "line string")
    assert {r["line"]: r["longer"] for r in truncation._continued(texts, lines).collect()} == {"Η α": 3, "Η αγωγή": 0, "Η αίτηση 9": 1, "Η": 4, "x x x x x x": 1, "ω": 0}


def test_ruled_tail_is_linear():
    assert truncation._closed("x." + "-" * 100_000)


def test_intervals_count_records_once():
    import numpy as np

    codes, record = np.array([0, 1, 0, 0, 1], "i4"), np.array([0, 0, 0, 1, 1], "i4")
    (first, tf, df), (_, tf2, df2) = terms.intervals(codes, record, 2)
    assert codes[first].tolist() == [0, 1] and tf.tolist() == [3, 2] and df.tolist() == [2, 2]
    assert sorted(zip(tf2.tolist(), df2.tolist())) == [(1, 1), (2, 2)]
    assert isinstance(neardup.shingle_sets(pa.array(["α β γ δ"]), 3)[0], np.ndarray)


def test_each_cut_text_carries_its_evidence(spark):
    whole = corpus(60) + [t + "\nΘέση σφραγίδας" for t in corpus(8, 6)]
    base = corpus(30, 5)
    limit = [(t * 3)[:333] for t in base if not (t * 3)[:333].endswith(".")]
    cut = [base[0] + " Ο εναγόμενος υποστ", base[1] + " Η σύμβαση λύθηκε με", base[2] + " Η σύμβαση λύθηκε (", base[3] + " Η σύμβαση λύθηκε,", base[4] + " Η Τζιτζιφιόγκα"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(whole + limit + cut)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in truncation.truncated(df).collect()}
    n, m = len(whole), len(limit)
    assert not any(got[i]["cut"] for i in range(n)) and all(got[i]["cut"] and got[i]["at_limit"] for i in range(n, n + m))
    names = [{e for e in ("broken", "goes_on", "sign", "closing") if got[i][e]} for i in range(n + m, n + m + 5)]
    assert names == [{"broken"}, {"goes_on"}, {"sign"}, {"goes_on"}, set()] and all(got[i]["cut"] for i in range(n + m, n + m + 5))
    assert [got[n + m + 4]["score"], got[n - 1]["score"]] == [truncation.EVIDENCE["unclosed"], truncation.EVIDENCE["unclosed"] + truncation.EVIDENCE["closing"]]


@pytest.mark.parametrize("end, closed", [("x.", True), ("x..", False), ("x.»" + ")" * 40, True), ("x;", True), ("x,", False), ("x... ", False)])
def test_ends_of_sentences(end, closed):
    assert truncation._closed(end) == closed


# ---- groups of near duplicates


def test_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(8)
    words = [f"λέξη{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        w = [rng.choice(words) for _ in range(50)]
        for _ in range(rng.randrange(1, 5)):  # chains: each a small edit of the one before
            w = list(w)
            w[rng.randrange(50)] = rng.choice(words)
            texts.append(" ".join(w))
    texts += [texts[3]] * 60 + ["μία δύο", "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, content string, root string")
    recs = neardup.records(df, "id", "content", "f")
    members = neardup.members(recs, 3)
    got = {r["key"]: (r["group_key"], r["n_links"]) for r in neardup.groups(recs, members, 3, 0.6).collect()}
    keep = [(str(i), t) for i, t in enumerate(texts) if t and len(t.split()) >= 3]
    links = {a: {b for b, t in keep if b != a and jaccard(s, t) >= 0.6} for a, s in keep}
    root = {}
    for a, _ in keep:
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        root[a] = min(seen)
    assert got == {a: (root[a], len(b)) for a, b in links.items() if b}
    # the pairs of keys go through the same blocks
    pairs = {(r["key_a"], r["key_b"]) for r in neardup.key_pairs(recs, members, 3, 0.6).collect()}
    assert pairs == {(a, b) for a, own in links.items() for b in own if a < b}
    assert neardup.groups(recs.limit(0), members.limit(0), 3, 0.6).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a int, b int")
    got = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_bloom_by_count(spark):
    import numpy as np

    from lexspark.llm import common

    df = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = common.bloom(df, F.col("h"))
    own = np.array([r["h"] for r in df.collect()], "i8").view("u8")
    other = np.array([r["h"] for r in spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h")).collect()], "i8").view("u8")
    assert common.in_bloom(bits, own).all() and common.in_bloom(bits, other).mean() < 0.03


def test_beyond_the_largest_filter_nothing_changes(spark, monkeypatch):
    from lexspark.llm import common

    texts = corpus(40)
    hurt = texts[0].encode("utf-8").decode("cp1252", "replace")
    df = spark.createDataFrame([(f"k{i}", 1, t) for i, t in enumerate(texts)] + [("x", 1, hurt)], "cd string, v int, body string")
    recs = neardup.records(df, "cd", "body", "f")
    pairs = lambda: {tuple(r)[:3] for r in neardup.key_pairs(recs, neardup.members(recs, 3), 3, 0.6).collect()}
    spans = lambda: [r["key"] for r in encoding.damaged_spans(df, "cd", "v", ["body"]).collect()]
    want = pairs(), spans()
    monkeypatch.setattr(common, "MOST_BITS", 1)
    assert (pairs(), spans()) == want and want[1] == ["x"]


# ---- lost bytes


def misread(text, read_as):
    return text.encode("utf-8").decode(read_as, "replace")


def test_lost_bytes_are_filled_in_by_known_words(spark):
    texts = corpus(60)
    rows = [(f"k{i}", 1, t) for i, t in enumerate(texts)] + [("x", 1, misread(texts[0], "cp1253")), ("y", 1, "Η " + misread("αβάσιμος", "cp1253") + " " + texts[1])]
    df = spark.createDataFrame(rows, "cd string, v int, body string")
    spans = encoding.damaged_spans(df, "cd", "v", ["body"])
    back = {r["key"]: r for r in encoding.restored(df, spans, "cd", "v").collect()}
    assert "�" in misread(texts[0], "cp1253") and back["x"]["text"] == texts[0] and not back["x"]["complete"]


def test_fillings(monkeypatch):
    token = misread("πρώτος", "cp1253")
    assert "πρώτος" in encoding.fillings("utf8>cp1253", token) and "δικαστήριο" in encoding.fillings("lost", "δικαστ�ριο")
    assert encoding.fillings("lost", "��α") == []
    monkeypatch.setattr(encoding, "PATHS", 3)
    assert encoding.fillings("utf8>cp1253", token) is None


def test_patterns_with_too_many_fillings_meet_the_words(spark, monkeypatch):
    texts = corpus(60)
    df = spark.createDataFrame([(f"k{i}", 1, t) for i, t in enumerate(texts)] + [("x", 1, misread(texts[0], "cp1253"))], "cd string, v int, body string")
    run = lambda: {(r["token"], r["meant"]) for r in encoding.damaged_tokens(encoding.tokens(df, ["body"])).collect()}
    want = run()
    monkeypatch.setattr(encoding, "_candidates", _few_paths(encoding._candidates))
    assert run() == want


def _few_paths(candidates):
    def run(batches):
        encoding.PATHS = 1
        yield from candidates(batches)

    return run


def test_the_lattice_and_its_best_path():
    ch = encoding._BY_NAME["utf8>cp1253"]
    token = misread("ρα", "cp1253")
    edges = ch.lattice(token)
    assert [j for j, _ in edges[0]] == [2] and "ρ" in edges[0][0][1] and edges[2] == [(4, "α")] and edges[1] == edges[3] == []
    path, made = ch.path(token)
    assert made == 2 and isinstance(path[0], tuple) and path[1] == "α"


def test_chains_of_two_kinds():
    back = {b: c for c, b in encoding._bytes_of("mac_greek").items()}
    once = misread("δικαστήριο", "cp1252")
    if "�" not in once:
        assert "δικαστήριο" in [t for _, t, _, _ in encoding.readings(once)]
    twice = "".join(chr(b) if b < 128 else back[b] for b in misread("καλή", "iso8859_7").encode("iso8859_7", "ignore"))
    assert twice and all(isinstance(t, str) for _, t, _, _ in encoding.readings(twice))


# ---- signs outside words


@pytest.mark.parametrize("text, found", [("απλό κείμενο", set()), ("α‑β", {"‑"}), ("κα​λή", {"κα​λή"}), ("άρθρο ５", {"５"}), ("α ́ β", {"́"}), ("όρος software", set())])
def test_suspects(text, found):
    assert lookalike.suspects(text) == found


def test_marks_of_other_scripts_stay(spark):
    rows = [("f", "a", 1, "Η λέξη हिन्दी εδώ"), ("f", "b", 1, "α ́ β"), ("f", "c", 1, "τιμή 5")]
    df = spark.createDataFrame(rows, "field string, key string, version int, text string")
    assert {r["key"] for r in lookalike.irregular(df).collect()} == {"b", "c"}


def test_many_forms_are_joined_with_the_same_result(spark, monkeypatch):
    rows = [("f", "a", 1, "Η παραγραφή και η αξίωση"), ("f", "b", 1, "Η παρaγραφή"), ("f", "c", 1, "ｓｗａｐ x")]
    df = spark.createDataFrame(rows, "field string, key string, version int, text string")
    want = {tuple(r) for r in lookalike.normalised(df).collect()}
    monkeypatch.setattr(lookalike, "MOST_FORMS", 0)
    assert {tuple(r) for r in lookalike.normalised(df).collect()} == want and ("f", "b", 1, "Η παραγραφή") in want


# ---- the bound of a mix


def within_one_block(rows, weights):
    gone, seen = 0, Counter()
    worst = 0.0
    for r in sorted(rows, key=lambda r: r["pos"]):
        assert r["pos"] == gone
        gone += r["n_tokens"]
        seen[r["source"]] += r["n_tokens"]
        worst = max(worst, *(abs(seen[s] - w * gone) for s, w in weights.items()))
    return worst


def test_every_document_of_a_mix_is_within_one_block(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(SENTENCES) for _ in range(rng.randrange(1, 12))), rng.choice("aabbbc")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 1), ("c", 0.2, 4)], "source string, target_share double, max_repeats int")
    out, _ = mixture.mix(docs, targets)
    got = out.collect()
    total = Counter()
    for r in got:
        total[r["source"]] += r["n_tokens"]
    weights = {s: t / sum(total.values()) for s, t in total.items()}
    worst = within_one_block(got, weights)
    assert 0 < worst < got[0]["block_tokens"] < sum(total.values()) / 20
    assert weights["a"] == pytest.approx(0.5, abs=0.01)


def test_schedule_of_pieces():
    rng = random.Random(9)
    sizes = {s: [rng.randrange(50, 100) for _ in range(n)] for s, n in (("a", 200), ("b", 90), ("c", 7))}
    own = {s: sum(x) for s, x in sizes.items()}
    seen, gone = Counter(), 0
    for s, j, begin in mixture.schedule(sizes):
        assert begin == gone
        gone += sizes[s][j]
        seen[s] += sizes[s][j]
        assert all(abs(seen[x] - gone * own[x] / sum(own.values())) < 200 for x in own)
    assert seen == own and mixture.schedule({}) == []


@pytest.mark.parametrize("most", [1 << 27, 1])
def test_counts_of_current_rows(spark, monkeypatch, most):
    from lexspark.llm import common

    monkeypatch.setattr(common, "MOST_BITS", most)
    rng = random.Random(11)
    rows = [(f"k{i}", v, " ".join(rng.choice("αβγδε") for _ in range(6))) for i in range(300) for v in range(rng.choice([1, 1, 1, 3]))]
    rows += [rows[5]] * 40 + [(None, 1, "ζ"), ("n", 2, None), ("n", 1, "η"), ("e", 1, "")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "k string, v int, t string, h int").repartition(5)
    best = {}
    for k, v, t in rows:
        if k is not None and (k not in best or v > best[k][0]):
            best[k] = (v, t)
    texts = [t for _, t in best.values() if t is not None]
    got = {r["term"]: (r["tf"], r["df"]) for r in terms.record_counts(df, "k", "v", "t", 2).collect() if r["n"]}
    assert got == brute(texts, 2)
    assert sum(r["df"] for r in terms.record_counts(df, "k", "v", "t").collect() if r["n"] == 0) == len(texts)

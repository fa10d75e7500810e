from __future__ import annotations

import json
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as fixed
from quillspark.operators import curate, graph, index, packed_values, resolve, scoring, search

RECORD = "source_file string, ord int, names struct<primary:string, latin:string, common:array<string>, synonyms:array<string>>, category string, traditional string, provenance struct<sources:array<string>>"


def keys(spark, names, **options):
    df = spark.createDataFrame([(n,) for n in names], "x string")
    return [r.y for r in df.select(resolve.canonical_key(F.col("x"), **options).alias("y")).collect()]


def test_canonical_key(spark):
    names = ["Lamium Album (U. S. P.)", "Black Cohosh root", "Bry.", "Kali-bi.", "Nat. mur.", "Astragalus Menziesii", "St. John's Wort", "Œnanthe crocata", "Æsculus, horse chestnut", "", None, "of the"]
    assert keys(spark, names) == ["lamium-album", "cimicifuga-racemosa", "bryonia-alba", "kali", "mur", "astragalus-membranaceus", "st-john", "nanthe-crocata", "aesculus", "", "", ""]
    assert keys(spark, ["Goat's Rue"], strict=False) == ["galega-officinalis"]


def test_merged_names_and_block(spark):
    def rec(f, o, primary, latin, common, cat, block, sources):
        return (f, o, (primary, latin, common, ["dropped"]), cat, block, (sources,))

    rows = [
        rec("a", 0, "Bryonia", None, ["hops", None, "hops"], "homeopathic", json.dumps({"head": [{"text": "one"}], "dosing": {"notes": "x", "more": ["p"]}, "s": "first"}), ["s1", "s2"]),
        rec("a", 1, "Bryonia alba", "Bryonia", ["wild hops"], None, json.dumps({"head": [{"text": "two"}, {"text": "one"}], "dosing": ["list loses"], "s": "second"}), ["s2", "s3"]),
        rec("b", 0, "bryonia", "Bryonia", None, "herbal", json.dumps({"head": {"kind": "loses"}, "dosing": {"notes": "no", "more": ["q"], "new": "z"}}), None),
        rec("b", 1, "", None, [], "herbal", None, []),
        rec("c", 0, None, "", [], None, "no json", []),
    ]
    keyed = resolve.keyed(spark.createDataFrame(rows, RECORD))
    m = {r.key: r for r in resolve.merged_names(keyed).collect()}
    assert set(m) == {"bryonia", "bryonia-alba"} or set(m) == {"bryonia"}
    b = m["bryonia"]
    assert (b.primary, b.latin, b.category, b.common, b.sources) == ("Bryonia", "Bryonia", "herbal", ["hops", "wild hops"], ["s1", "s2", "s3"])
    assert b.synonyms == ["Bryonia alba", "bryonia"]
    out = defaultdict(list)
    for r in resolve.merged_block(resolve.block_entries(keyed)).orderBy("n").collect():
        out[r.field, r.subfield].append(json.loads(r.v))
    assert out["head", None] == [{"text": "one"}, {"text": "two"}, {"text": "one"}]
    assert out["s", None] == ["first"]
    assert out["dosing", "notes"] == ["x"] and out["dosing", "more"] == ["p", "q"] and out["dosing", "new"] == ["z"]
    counts = {r.source_file: r for r in resolve.corpus_counts(keyed).collect()}
    assert counts[None].n_records == 5 and counts[None].n_skipped == 2


def brute_hits(docs, term):
    return {d for d, t in docs.items() if re.fullmatch("[a-z]+", term) and any(term in w for w in re.findall("[a-z]{3,}", (t or "").lower()))}


DOCS = {1: "Throbbing pain in the head; worse at night from wine.", 2: "Burning heat of the forehead, better from cold.", 3: "", 4: None, 5: "Right shoulder aching, headache with nausea", 6: "The frontal head burns; night sweats and thirst", 7: "constructor headache throbbing throbbing right"}


@pytest.fixture(scope="module")
def posted(spark):
    df = spark.createDataFrame(list(DOCS.items()), "doc_id long, text string")
    return index.postings(df.union(df), "doc_id", "text").cache()


def test_boolean_search(spark, posted):
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(search.all_of(posted, ["head", "throb"], "doc_id")) == brute_hits(DOCS, "head") & brute_hits(DOCS, "throb")
    assert ids(search.any_of(posted, ["burn", "night sweats"], "doc_id")) == brute_hits(DOCS, "burn")
    assert ids(search.without(search.any_of(posted, ["head"], "doc_id"), search.any_of(posted, ["throb"], "doc_id"), "doc_id")) == brute_hits(DOCS, "head") - brute_hits(DOCS, "throb")
    assert ids(search.all_of(posted, [], "doc_id")) == set()


def test_search_ranks_names_and_limits_first(spark):
    rows = [(str(i), f"Entry {i:03}", "", "herbal" if i % 2 else "homeopathic", 1 + (i < 5), i % 3 == 0, i % 2 == 0, "fever") for i in range(40)] + [("z", "Zz Fever", "", "herbal", 1, True, True, "fever"), ("y", "Yy", "", "herbal", 9, True, True, "cold")]
    e = index.ranked_index(spark.createDataFrame(rows, "id string, primary string, latin string, category string, n_sources int, has_traditional boolean, has_evidence boolean, text string"))
    order = [r.id for r in e.orderBy("idx").collect()]
    assert order[0] == "y" and order[1:6] == ["0", "1", "2", "3", "4"] and [r.idx for r in e.orderBy("idx").collect()] == list(range(42))
    p = index.postings(e, "idx", index.search_text(F.col("primary"), F.col("text")))
    got = search.search(e, p, " FEVER ", limit=20).collect()
    assert got[0].id == "z" and got[0].score == 101 and got[0].total == 41 and len(got) == 20
    assert [r.id for r in search.search(e, p, "fever", limit=10).collect()][0] == "0"  # the name match lies behind the first 30 hits
    assert search.search(e, p, "a b").count() == 0 and search.search(e, p, "", limit=5).count() == 5
    assert {r.category for r in search.search(e, p, "fever", category="herbal").collect()} == {"herbal"}
    assert all(r.has_traditional and r.has_evidence for r in search.search(e, p, "fever", dual_only=True).collect())
    found = search.first_match(spark.createDataFrame([("fever",), ("nope",), (None,)], "name string"), e.withColumn("names", F.col("primary"))).collect()
    assert [(r.name, order[r.idx]) for r in found] == [("fever", "z")]


def test_snippets(spark):
    rows = [(1, "head", 1, "b" * 20), (1, "head", 0, "a   b" + "c" * 500), (1, "head", 0, "a   b" + "c" * 500), (1, "head", 2, "short"), (1, "skin", 0, None)]
    got = index.snippets(spark.createDataFrame(rows, "id long, field string, seq int, text string"), "id").collect()
    assert [(r.field, r.snippet) for r in got] == [("head", ("a b" + "c" * 397 + " | " + "b" * 20))]
    s = spark.createDataFrame([(1, {"habitat": "x", "keynotes": "k"}), (2, {"habitat": "x"}), (3, {})], "id int, s map<string,string>")
    assert [r.p for r in s.select(search.preview(F.col("s")).alias("p")).collect()] == ["k", "x", None]


def kept(s):
    return [w for w in re.findall("[a-z]{3,}", (s or "").lower()) if w not in fixed.STOP_WORDS]


def brute_scores(symptoms, fields):
    """The rules one by one, in plain Python."""
    out = defaultdict(float)
    hit = lambda t: brute_hits(DOCS, t)
    union = lambda ts: set().union(*map(hit, ts)) if ts else set()
    every = lambda ts: set.intersection(*map(hit, ts)) if ts else set()

    def award(docs, points):
        for d in docs:
            out[d] += points

    for s in symptoms:
        loc = fixed.LOCATION_TERMS.get(s["loc"], kept(s["loc"]))
        sens = fixed.KEYWORD_EXPANSIONS.get(s["sens"], kept(s["sens"]))
        L, S = union(loc), union(sens)
        if loc and sens:
            award(L & S, 5), award(L - S, 1), award(S - L, 1)
        else:
            for t in loc + sens:
                award(hit(t), 2)
        if s["side"] not in ("", None, "N/A", "Both sides") and loc:
            for w in re.findall("[a-z]{3,}", s["side"].lower()):
                if w != "side":
                    award(hit(w) & L, 1.5)
        for m in s["better"] + s["worse"]:
            M = union(kept(m))
            if loc:
                award(M & L, 2.5), award(M - L, 0.5)
            else:
                award(M, 1.5)
        d = kept(s["desc"])
        for k in (3, 2):
            for i in range(len(d) - k + 1):
                award(every(d[i : i + k]), 3)
        for w in d:
            award(hit(w), 0.5)
    for f, v in fields:
        terms = kept(v)
        if f == "ailments_from":
            award(every(terms), 4 if len(terms) > 1 else 3)
        elif f in scoring.CONSTITUTION:
            terms = fixed.KEYWORD_EXPANSIONS.get(v, terms)
            award(every(terms), 2 if len(terms) > 1 else 1.5)
        elif f in scoring.HABITS:
            for t in fixed.KEYWORD_EXPANSIONS.get(v, terms):
                award(hit(t), 1.5)
        elif f == "_checked":
            award(every(terms), 2 if len(terms) > 1 else 1.5)
        else:
            for t in terms:
                award(hit(t), 0.3)
    return {d: round(p, 4) for d, p in out.items()}


def test_form_scores_against_brute_force(spark, posted):
    symptoms = [
        {"loc": "Head - Forehead", "sens": "Burning", "side": "Right", "better": ["cold"], "worse": ["night", "from wine"], "desc": "throbbing throbbing head pain"},
        {"loc": "Atlantis head", "sens": "", "side": "N/A", "better": [], "worse": [], "desc": "pain"},
        {"loc": "", "sens": "Pulsating / Throbbing", "side": "Left", "better": ["wine"], "worse": [], "desc": ""},
        {"loc": "Abdomen - Right side", "sens": None, "side": "Both sides", "better": [], "worse": [], "desc": None},
    ]
    fields = [("ailments_from", "night wine"), ("ailments_from", "wine"), ("thirst", "Very thirsty - large quantities"), ("thermal", "cold"), ("sleep_quality", "Restless"), ("sweat_pattern", "Night sweats"), ("_checked", "nausea"), ("_checked", "head night"), ("additional", "night night heat")]
    sym = [(1, n, s["desc"], s["loc"], s["sens"], s["side"], s["better"], s["worse"]) for n, s in enumerate(symptoms)]
    s_df = spark.createDataFrame(sym + sym[:1], "case_id long, n int, sx_desc string, sx_location string, sx_sensation string, sx_side string, sx_better array<string>, sx_worse array<string>")
    f_df = spark.createDataFrame([(1, f, i, v) for i, (f, v) in enumerate(fields)] + [(1, "thermal", 99, None), (2, "_checked", 0, "zzz")], "case_id long, field string, seq int, field_value string")
    awards = scoring.form_awards(s_df, f_df, posted, "doc_id")
    got = {r.key: round(float(r.p), 4) for r in awards.groupBy("key").agg(F.sum("points").alias("p")).collect()}
    assert got == brute_scores(symptoms, fields)
    best = scoring.ranked(awards, 3).orderBy("rank").collect()
    assert [r.rank for r in best] == [1, 2, 3] and best[0].pct == 100 and best[0].matched[0]
    whole = lambda df: sorted((r.case, r.key, r.rank, r.score, r.pct, tuple(r.matched)) for r in df.collect())
    assert whole(scoring.ranked_forms(s_df, f_df, posted, "doc_id")) == whole(scoring.ranked(awards, 50))
    used = {r.case: r.keywords_used for r in scoring.keywords_used(s_df, f_df, posted, "doc_id").collect()}
    assert used == {1: brute_keywords(symptoms, fields), 2: 0}
    assert scoring.form_awards(s_df.limit(0), f_df.limit(0), posted, "doc_id").count() == 0
    browser = scoring.form_awards(s_df, f_df, posted, "doc_id", scoring.BROWSER)
    got = {r.key: round(float(r.p), 4) for r in browser.groupBy("key").agg(F.sum("points").alias("p")).collect()}
    assert got == brute_browser(symptoms, fields)
    assert whole(scoring.ranked_forms(s_df, f_df, posted, "doc_id", scoring.BROWSER)) == whole(scoring.ranked(browser, 10))
    plans = spark.createDataFrame([(1, '{"search_groups": [{"label": "x", "required_terms": ["head"], "weight": 1}]}'), (2, "no json"), (9, None)], "case long, plan string")
    names = spark.createDataFrame([], "idx long, names string")
    both = scoring.ranked_plans(plans, s_df, f_df.union(spark.createDataFrame([(2, "_checked", 1, "head night")], f_df.schema)), posted, names, "doc_id")
    assert {(r.case, r.by) for r in both.collect()} == {(1, "plan"), (2, "form")}
    assert {r.case: r.keywords_used for r in scoring.plan_keywords(plans).collect()} == {1: 1, 2: 0, 9: 0}


def brute_keywords(symptoms, fields):
    """The labels that the fixture searches for, counted by hand of the rules."""
    used = set()
    for s in symptoms:
        loc, sens = (s["loc"] or "").strip(), (s["sens"] or "").strip()
        if loc and sens:
            used.add(f"{loc} + {sens}")
        elif loc or sens:
            used.add(loc or sens)
        if s["side"] not in ("N/A", "Both sides", "") and loc:
            used.add(f"{s['side']} {loc}")
        used |= {f"{k}: {m}" for k in ("better", "worse") for m in s[k]}
        words = kept(s["desc"] or "")
        for k in (3, 2):
            for i in range(len(words) - k + 1):
                if set.intersection(*(brute_hits(DOCS, w) for w in words[i : i + k])):
                    used.add(" ".join(words[i : i + k]))
    for f, v in fields:
        if f not in scoring.FREE:
            used.add("Ailments from: " + v if f == "ailments_from" else v)
    return len(used)


def brute_browser(symptoms, fields):
    out = defaultdict(float)
    hit = lambda t: brute_hits(DOCS, t)

    def award(docs, points):
        for d in docs:
            out[d] += points

    some = lambda terms: set().union(*map(hit, terms))
    every = lambda terms: set.intersection(*map(hit, terms)) if terms else set()
    for s in symptoms:
        loc, sens = (s["loc"] or "").strip(), (s["sens"] or "").strip()
        lt = fixed.LOCATION_TERMS[loc] if loc in fixed.BROWSER_LOCATIONS else kept(loc)
        st = fixed.BROWSER_SENSATIONS.get(sens, kept(sens))
        if lt and st:
            award(some(lt) & some(st), 5)
            award(some(lt) ^ some(st), 1)
        else:
            for t in lt + st:
                award(hit(t), 2)
        words = kept(s["desc"] or "")
        for k in (2, 3):
            for i in range(len(words) - k + 1):
                award(every(words[i : i + k]), 3)
    for f, v in fields:
        terms = kept(v)
        if f in ("thermal", "thirst", "appetite"):
            for t in terms:
                award(hit(t), 1.5)
        elif f == "ailments_from":
            award(every(terms), 4 if len(terms) > 1 else 3)
        elif f == "_checked":
            award(every(terms), 2 if len(terms) > 1 else 1.5)
    return {d: round(p, 4) for d, p in out.items()}


def test_forms_and_plans_leave_no_row_for_a_pair_of_case_and_document(spark, monkeypatch):
    """In turns and small blocks the results are those of all awards; a task sends back the best documents of a case only."""
    from quillspark.operators import blocks

    monkeypatch.setattr(blocks, "TURN", 40)
    monkeypatch.setattr(blocks, "MATRIX", 1)
    some = ["head", "forehead", "burning", "throb", "throbbing", "night", "wine", "cold", "heat", "nausea", "pain", "right", "headache", "nights"]
    docs = spark.createDataFrame([(d, [w for k, w in enumerate(some) if (d * 7919 + k * 104729) % (3 + k % 4) == 0]) for d in range(600)], "doc_id long, tokens array<string>").where("size(tokens) > 0")
    posted = docs.select("doc_id", F.explode("tokens").alias("token"))
    symptoms = spark.createDataFrame([(c, n, " ".join(some[(c + n + k) % len(some)] for k in range(4)), ["Head - Forehead", "", "Atlantis head"][(c + n) % 3], ["Burning", "Pulsating / Throbbing", ""][c % 3], ["Right", "N/A"][n], ["cold", "from wine"][: c % 3], ["night heat"][: n]) for c in range(30) for n in range(2)], "case_id long, n int, sx_desc string, sx_location string, sx_sensation string, sx_side string, sx_better array<string>, sx_worse array<string>")
    fields = spark.createDataFrame([(c, f, 0, some[c % len(some)] + " " + some[(c * 5 + 1) % len(some)]) for c in range(30) for f in ("ailments_from", "thermal", "sleep_quality", "_checked", "additional")], "case_id long, field string, seq int, field_value string")
    whole = lambda df: sorted((r.case, r.key, r.rank, r.score, r.pct, tuple(r.matched)) for r in df.collect())
    for profile in (scoring.SERVER, scoring.BROWSER):
        want = whole(scoring.ranked(scoring.form_awards(symptoms, fields, posted, "doc_id", profile), profile.top))
        assert len(want) == 30 * profile.top and whole(scoring.ranked_forms(symptoms, fields, docs, "doc_id", profile)) == want
        assert scoring.keywords_used(symptoms, fields, docs, "doc_id", profile).count() == 30
    turn = next(blocks.turns(scoring._plan_rows(symptoms, fields, scoring.BROWSER)))
    sets = blocks.token_sets(docs.repartition(2), "doc_id")
    assert blocks.top_documents(turn, sets, scoring.BROWSER.points, 10)[0].count() <= 2 * 30 * 10
    plans = spark.createDataFrame([(c, json.dumps({"search_groups": [{"label": "a", "required_terms": ["head"], "bonus_terms": ["night"], "weight": 1.25}, {"label": "b", "required_terms": [some[c], "pain"], "bonus_terms": ["wine", "cold!"]}]})) for c in range(3)], "case long, plan string")
    hit = lambda t: {r.doc_id for r in docs.collect() if any(t in w for w in r.tokens)}
    got = {(r.case, r.key): float(r.p) for r in scoring.plan_awards(plans, docs, spark.createDataFrame([], "idx long, names string"), "doc_id").groupBy("case", "key").agg(F.sum("points").alias("p")).collect()}
    want = defaultdict(float)
    for c in range(3):
        a, b = hit("head"), hit(some[c]) & hit("pain")
        for its, points in ((a, 1.25), (a & hit("night"), 0.375), (b, 2), ((a | b) & hit("wine"), 0.6)):
            for k in its:
                want[c, k] += points
    assert got == pytest.approx(dict(want))


def test_plan_scores(spark, posted):
    plan = {"search_groups": [{"label": "a", "required_terms": ["Head", "throb"], "bonus_terms": ["night", "of"], "weight": 3}, {"label": "b", "required_terms": [], "bonus_terms": ["wine", "burn"]}, {"label": "c", "required_terms": ["burn"], "bonus_terms": []}], "suggested_remedies": ["lamium", {"name": "nowhere at all"}]}
    plans = spark.createDataFrame([(1, f"```json\n{json.dumps(plan)}\n```"), (2, "no json"), (3, None)], "case long, plan string")
    names = spark.createDataFrame([(2, "Lamium album"), (5, "Lamium purpureum")], "idx long, names string")
    awards = scoring.plan_awards(plans, posted, names, "doc_id")
    assert {r.label for r in awards.collect()} == {"a", "+ night", "c", "AI suggested: lamium"}
    got = {r.key: float(r.p) for r in awards.groupBy("key").agg(F.sum("points").alias("p")).collect()}
    want = defaultdict(float)
    for d in brute_hits(DOCS, "head") & brute_hits(DOCS, "throb"):
        want[d] += 3 + 0.9 * (d in brute_hits(DOCS, "night"))  # a group without required terms gives no bonus
    for d in brute_hits(DOCS, "burn"):
        want[d] += 2
    want[2] += 8
    assert got == pytest.approx(dict(want))


def test_checked_classes(spark):
    df = spark.createDataFrame([("Fear of dark",), ("Dark anxiety",), ("Milk",), ("Salt",), ("Knees",)], "x string").select("x", scoring.checked_classes(F.col("x")).alias("c")).select("x", "c.*")
    got = {r.x: {k for k in ("emotion", "fear", "desire", "aversion", "system") if r[k]} for r in df.collect()}
    assert got == {"Fear of dark": {"emotion"}, "Dark anxiety": {"emotion", "fear"}, "Milk": {"desire"}, "Salt": {"aversion"}, "Knees": {"system"}}


def test_curation(spark):
    names = spark.createDataFrame([("a", "Alpha", ["al"], ["s1"]), ("b", "ALPHA", None, ["s2", "s1"]), ("c", "Gamma", ["g"], None), ("e", "Eps", [], [])], "id string, primary string, synonyms array<string>, sources array<string>")
    donors = spark.createDataFrame([("b", "a"), ("c", "a"), ("e", "missing")], "donor string, canonical string")
    got = {r.id: r for r in curate.merge_donors(names, donors).collect()}
    assert set(got) == {"a", "e"} and got["a"].synonyms == ["al", "Gamma", "g"] and got["a"].sources == ["s1", "s2"]
    t = spark.createDataFrame([("head", "x" * 200 + "1")], "field string, text string")
    d = spark.createDataFrame([("head", "x" * 200 + "2"), ("skin", "x" * 200 + "2"), ("head", "new"), ("head", "new"), ("head", None)], "field string, text string")
    assert curate.new_texts(t, d, ["field"]).count() == 3
    s = spark.createDataFrame([("base", "a long enough addition here"), ("base", "short"), ("a long enough addition here", "a long enough addition here")], "t string, a string")
    assert [r.x.count("\n") for r in s.select(curate.appended("t", "a").alias("x")).collect()] == [2, 0, 0]
    m = spark.createDataFrame([("Bry", i) for i in range(3)] + [("8ry", 9), ("bad", 1)], "mark string, pos int")
    assert [tuple(r) for r in curate.frequent_marks(m, "mark", 4, {"8ry": "Bry", "bad": None}).collect()] == [("Bry", 4, 0)]


def test_daily_cap_and_reachability(spark):
    ev = spark.sql("select id event_id, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id / 10)) ts from range(40) union all select 99, null")
    got = curate.daily_cap(ev, 3).where("allowed").orderBy("event_id").collect()
    assert [r.event_id for r in got] == [0, 1, 2, 10, 11, 12, 20, 21, 22, 30, 31, 32]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("a", None)], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.reachable(edges, start).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    only = spark.createDataFrame([("a",)], "node string")
    assert {r.node for r in graph.reachable(edges, start, only).collect()} == {"a", "b"}


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ('Bry., barley gruel, Zin-k. & green cheese', ["Bry", "barley gruel", "Zin-k", "green cheese"]),
        ('"oil, rancid"; salt; Marsh Rue.', ["oil, rancid", "salt", "Marsh Rue"]),
        ("'Navr-n.' 'Sem-n.'", ["Navr-n", "Sem-n"]),
        ("Tinker's Nettle\tsoap\tsalt", ["Tinker's Nettle", "soap", "salt"]),
        ("bark (inner; fresh), Ped or salt.", ["bark (inner; fresh)", "Ped", "salt"]),
        ("(1) Nor-n.; (2) salt", ["Nor-n", "salt"]),
        ("1) Ivd-d. 2) olive oil", ["Ivd-d", "olive oil"]),
        ("ginger\n- Rue\r\n- Velo", ["ginger", "Rue", "Velo"]),
        ('["Vel-p.", "gruel / porridge"]', ["Vel-p", "gruel / porridge"]),
        ("Antidoted by Kal-o., Tus; also salt.", ["Kal-o", "Tus", "salt"]),
        ("Goes well with Ori-v. and Fom-f.", ["Ori-v", "Fom-f"]),
        ("Rel.: Tha-n. - soap", ["Tha-n", "soap"]),
        ("Nor-n\u037e salt\u060c Rue", ["Nor-n", "salt", "Rue"]),
        ("bark for the fever; salt, as such", ["bark for the fever", "salt", "as such"]),
        ("None given, so far.", []),
        ("Relations not studied; see the proving.", []),
        ("Unknown", []),
        ("Compare Bry.", []),
        ('"vinegar; old".', []),
        ("", []),
        (None, []),
        (" ;, ", []),
        ("((", []),
        ("a, " * 3000 + "b", ["a"] * 3000 + ["b"]),
    ],
)
def test_packed_values(spark, value, want):
    df = spark.createDataFrame([(1, value, "x", 5)], "skeleton int, value string, item string, ranges int")
    got = packed_values.split_packed(df).orderBy("pos").collect()
    assert [r.item for r in got] == want and all(r.skeleton == 1 and r.ranges == 5 for r in got)


def test_packed_skeletons_are_few(spark):
    """As many values in one style make one skeleton, whatever the values are; beyond the bounds the result is the same."""
    rng = random.Random(3)
    names = ["Bry.", "barley gruel", "Zin-k.", "Tinker's Nettle", "green cheese", "Rhus", "old red wine"]
    rows = [(i, sep.join(rng.choice(names) for _ in range(rng.randint(2, 5)))) for i in range(400) for sep in [rng.choice(["; ", ", ", " | ", " / "])]]
    df = spark.createDataFrame(rows, "id int, value string")
    assert packed_values.skeletons(df).count() == 4
    want = sorted(tuple(r) for r in packed_values.split_packed(df).collect())
    assert len({r[0] for r in want}) == 400
    most, packed_values.MOST_RULES = packed_values.MOST_RULES, 0
    assert sorted(tuple(r) for r in packed_values.split_packed(df).collect()) == want
    packed_values.MOST_RULES = most


def test_packed_relationships_keep_places(spark):
    rows = [(1, json.dumps({"relationships": {"_raw": [None, "Bry., Ars.", "Rhus"], "antidoted_by": ["Camph. and Nux."]}})), (2, None), (3, "{}"), (4, "no json"), (1, json.dumps({"relationships": {"_raw": [None, "Bry., Ars.", "Rhus"], "antidoted_by": ["Camph. and Nux."]}}))]
    df = spark.createDataFrame(rows, "rec_id long, traditional string")
    got = sorted(tuple(r) for r in packed_values.split_relationships(df).collect())
    assert got == [(1, "_raw", 1, 0, "Bry"), (1, "_raw", 1, 1, "Ars"), (1, "antidoted_by", 0, 0, "Camph"), (1, "antidoted_by", 0, 1, "Nux")]
    assert packed_values.split_relationships(df.limit(0)).count() == 0

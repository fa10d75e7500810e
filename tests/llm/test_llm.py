from __future__ import annotations

import itertools
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bin_packing, canonical_names, garbled_text, mixing, near_duplicates, stuffed_pages, survivors, token_counts

REF = "ref_id int, latin string, abbreviation string, common array<string>, synonyms array<string>"
LISTED = [
    (1, "Norkalbelopsis casstrealis", "Nork-c.", ["Quarry Ramsquill"], []),
    (2, "Urtpolia hexyarinum", "Urt-h.", ["Silver Eyemantle"], ["Urtpolium hexa"]),
    (3, "Urtpolia lamcynacea", "Urt-l.", ["Sailor's Thornwort"], None),
    (4, "Zelcora polina", "Zel-p.", None, None),
]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("NORKALBELOPSIS  casstrealis.", 1),
        ("Tinctura Norkalbelopsis casstrealis 30", 1),
        ("casstrealis, Norkalbelopsis", 1),
        ("N o r k a l belopsis casstrealis", 1),
        ("Norkalbelopsiscasstrealis", 1),
        ("N0rkalbe1opsis casstreali5", 1),
        ("Norkalbelopsis castrealis", 1),
        ("Nork. casstrealis", 1),
        ("nork c", 1),
        ("Norkalbelopsis", 1),
        ("Urtpolia", -1),
        ("Urtpolia hexyarinvm", 2),
        ("Urtpolium-hexa", 2),
        ("the silver eyemantles", 2),
        ("Eyemantle (Silver)", 2),
        ("Sailor’s Thornwort (of the fens)", 3),
        ("Sailor Thornwort", 3),
        ("Silver Ramsquill", -1),
        ("Norkalbelopsis polina", -1),
        ("Norkalbelopsis drogulata", -1),
        ("Chapter IX", -1),
        ("???", -1),
        ("x" * 20000, -1),
    ],
)
def test_names(spark, value, want):
    assert canonical_names.Names(LISTED).match(value) == want


def test_names_of_three_words_in_any_order():
    names = canonical_names.Names([*LISTED, (5, "Urtpolia hexyarinum minor", None, ["Greater Marsh Thornwort"], None)])
    assert names.match("thornvort, marsh greater") == 5
    assert names.match("minor hexyarinvm Urtpolia") == 5
    assert names.match("thornwort marsh silver") == -1
    assert names.match("Zelcora hexyarinum") == -1  # a species that the list doesn't hold under this genus


def test_names_of_many_words():
    names = canonical_names.Names([(1, None, None, ["Great Red Water Sage of Winter"], None), (2, None, None, ["Great Red Water Mint of Winter"], None)])
    assert names.match("winter sege, great red watter") == 1
    assert names.match("great red water of winter") == -1  # fits both equally


def test_names_among_many_alike():
    """Of 200 names that share most trigrams with the value one is two edits away; another shares too few in a short one."""
    alike = [(k, f"norkalbelopsiscasstrealis{chr(97 + k // 26)}{chr(97 + k % 26)}xzquarryram", None, None, None) for k in range(200)]
    names = canonical_names.Names([*alike, (900, "norkalbxlopsiscasstxealisquarryram", None, None, None), (901, "qwertzuiopas", None, None, None)])
    assert names.match("norkalbelopsiscasstrealisquarryram") == 900
    assert names.match("qwxrtzuyiopas") == 901


def test_names_of_records(spark):
    rows = [(1, ("a", "Urtpolia hexyarinum", ["Silver  Eyemantle", None, " ", "Quarry Ramsquill"]), "v"), (1, ("a", "Urtpolia hexyarinum", ["Silver  Eyemantle", None, " ", "Quarry Ramsquill"]), "w"), (2, ("b", None, None), "v"), (3, ("c", "Zelcora", []), "v")]
    df = spark.createDataFrame(rows, "rec_id long, names struct<primary:string, latin:string, common:array<string>>, value string")
    ref = spark.createDataFrame(LISTED, REF).withColumn("value", F.lit(1))
    assert sorted(tuple(r) for r in canonical_names.mapped_names(df, ref).collect()) == [(1, "common", 0, 2), (3, "latin", 0, 4)]
    assert canonical_names.mapped_names(df.limit(0), ref).count() == 0
    assert {r.ref_id for r in canonical_names.mapped_names(df, ref.limit(0)).collect()} == {-1}


GOOD = "Médiath — “so” they say at Brühl, Straße ½ § 14; œdema’s end."


CLEAN = ["Médiath — “so” they say at Brühl, Straße ½ § 14, ¶ 2; œdema’s end.", "She “coughs” often – and weeps. At 38° the pulse fell by ½. So it is.", "Copyright © 2001 Médiath. ¼ grain, ¾ at noon; Bibliothèque “le”, café.", "A mark ¬ stands here, ± 3 parts."]


@pytest.fixture(scope="module")
def places():
    """How often characters stand in which places of clean texts."""
    return {k: 100 * n for k, n in Counter(garbled_text._place(t, i) for t in CLEAN for i, c in enumerate(t) if c > "\x7f").items()}


@pytest.mark.parametrize("written", ["cp1252", "mac_roman"])
@pytest.mark.parametrize("read", garbled_text.READ_AS)
def test_garbled_swaps_round_trip(places, written, read):
    """A clean text written in one single-byte encoding and read in another is found; between the usual ones it comes back for the most part."""
    g = garbled_text.Garbled(places)
    rate = []
    for t in CLEAN:
        try:
            bad = garbled_text._read(t.encode(written), read)
        except UnicodeEncodeError:
            continue
        if sum(a != b for a, b in zip(t, bad)) >= 3:
            case, fixed, _ = g.restore(bad)
            assert case, bad
            rate.append(sum(a == b for a, b, c in zip(t, fixed, bad) if a != c) / sum(a != c for a, c in zip(t, bad)))
    assert not rate or read not in ("cp437", "cp850", "mac_roman", "cp1252") or min(rate) >= 0.5, rate


@pytest.mark.parametrize("encoding", garbled_text.READ_AS)
def test_garbled_round_trip(encoding):
    g = garbled_text.Garbled()
    bad = garbled_text._read(GOOD.encode(), encoding)
    case, fixed, _ = g.restore(bad)
    assert case
    if encoding in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850"):
        assert fixed == GOOD
    twice = garbled_text._read(garbled_text._read("café “x”".encode(), "cp1252").encode(), "cp1252")
    assert g.restore(twice)[:2] == (True, "café “x”")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GOOD, False),
        ("The parish of SÃO BRAVELO; ÂGE TENDRE; È vero; Ãrvali; Częstov and Łęka", False),
        ("Greek θ and φ; трава; √2 by weight, ± 3; ¬ stands; ¿Dónde duele? €5, ™ and †", False),
        ("caf&eacute; &copy; 2001 &amp; more", False),
        ("Café is loose; why?so", False),
        ("", False),
        ("x" * 50000, False),
        ("mixed café and MÃ©diath", True),
        ("&Acirc;&copy; 2001", True),
        ("lost Br�hl", True),
        ("Copyright © MÈdiath", True),
        ("Br³hl", True),
        ("at 38░ the pulse", True),
        ("ôcoughö jaws", True),
        ("BibliothΦque", True),
        ("ôshe coughs" + " and coughs" * 30 + "ö at night", True),
        ("ôshe coughs\nand wakesö at night", True),
        ("ôshe coughs" * 20000, False),
    ],
)
def test_garbled_cases(places, text, want):
    assert garbled_text.Garbled(places).restore(text)[0] is want


def test_garbled_mixed_text_is_left_alone():
    assert garbled_text.Garbled().restore("café, naïve — MÃ©diath &amp; &eacute;")[1] == "café, naïve — Médiath &amp; &eacute;"


def test_garbled_table(spark):
    df = spark.createDataFrame([(1, "MÃ©diath", "x"), (1, "MÃ©diath", "y"), (2, None, "x"), (3, "", "x"), (None, "MÃ©", "x"), (4, "fine", "x")], "entry_id long, text string, id string")
    assert [tuple(r) for r in garbled_text.restored(df).collect()] == [(1, "Médiath", True)]
    assert garbled_text.restored(df.limit(0)).count() == 0


ENTITY = "row_id long, id string, names struct<primary:string>, traditional string, provenance struct<sources:array<string>>, merged_at timestamp, field string, v string"


def entity(spark, rows):
    import datetime as dt
    import json

    out = [(i, key, (primary,), None if note is None else json.dumps({"keynotes": [{"text": note}]}), (sources,), dt.datetime(2024, 1, day) if day else None, "x", "y") for i, key, primary, note, sources, day in rows]
    return spark.createDataFrame(out, ENTITY)


def test_survivors(spark):
    book = spark.createDataFrame([("good", 1), ("fair", 2), ("poor", 3)], "source_id string, trust_rank int")
    rows = [
        (1, "A", "Alpha be…", "Long text here", ["poor"], 1),
        (2, " a ", "Alpha beta", "Long text here and on.", ["fair", None, "?"], 2),
        (3, "a", "n/a", "Long text (cont.)", ["GOOD "], 3),
        (4, "a", "Alpha beta", "[illegible]", None, 9),
        (5, "b", "Alone", "x", ["good"], 1),
        (6, "c", None, None, None, None),
        (7, "c", " ", "-", [], None),
        (8, "d", "Same", "t", ["fair"], None),
        (9, "d", "Same", "t", ["fair"], None),
        (10, "d", "Same", "t", ["fair"], 1),
        (11, None, "Null", "t", ["good"], 1),
        (12, None, "Null", "t", ["good"], 1),
        (13, "e", "ab", "t", [], 1),
        (14, "e", "ab cd", "t", [], 1),
    ]
    got = {(r.id, r.field): r.row_id for r in survivors.survivors(entity(spark, rows), book).collect()}
    assert got == {("a", "primary"): 2, ("a", "keynotes"): 2, ("a", "sources"): 3, ("d", "primary"): 10, ("d", "keynotes"): 10, ("d", "sources"): 10, ("e", "primary"): 14, ("e", "keynotes"): 13}
    assert survivors.survivors(entity(spark, rows).limit(0), book).count() == 0


def test_cut_off_over_many_parts(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) + rng.choice(["", "", "...", " (cont.)"]) for _ in range(300)]
    rows = [("hot" if i % 3 else f"k{i % 7}", "f", w) for i, w in enumerate(words)]
    want = set()
    for i, f, v in rows:
        core = v.removesuffix("...").removesuffix(" (cont.)")
        if any(j == i and w != v and len(w) > len(core) and w.startswith(core) for j, _, w in rows):
            want.add((i, f, v))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {tuple(r) for r in survivors.cut_off(spark.createDataFrame(rows, "id string, field string, v string")).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == want


@pytest.mark.parametrize(("right", "copies", "trusted"), [(0.4, 1.0, False), (0.4, 1.0, True), (0.5, 0.8, True)])
def test_fusion_discounts_copies(spark, right, copies, trusted):
    """Four careful sources against a careless one with two copiers, who copy all or most of it and may be the most trusted."""
    ranks = {f"s{i}": (8 - i if trusted else i) for i in range(1, 8)}
    book = spark.createDataFrame(list(ranks.items()), "source_id string, trust_rank int")
    rng = random.Random(2)
    rows, n, plain = [], itertools.count(1), 0
    for item in range(120):
        truth = f"Truth {item}"
        false = [f"False {item} {k}" for k in range(8)]
        copied = truth if rng.random() < right else false[0]
        values = [truth if rng.random() < 0.8 else rng.choice(false) for _ in range(4)] + [copied]
        values += [copied if rng.random() < copies else truth if rng.random() < right else rng.choice(false) for _ in range(2)]
        rows += [(next(n), f"k{item}", v, "x", [f"s{i}"], 1) for i, v in enumerate(values, 1)]
        plain += max(sorted(set(values)), key=values.count) == truth
    df = entity(spark, rows)
    fitted = survivors.fit(df, book)
    got = {r.id: r for r in survivors.fused(df, book, fitted).where("field = 'primary'").collect()}
    correct = sum(r.v == f"Truth {k[1:]}" for k, r in got.items())
    assert len(got) == 120 and correct >= 108 and correct > plain
    assert all(0 <= r.posterior <= 1 for r in got.values())
    report = {r.source: r for r in survivors.sources(df, book, fitted).collect()}
    assert all(report[s].accuracy > 0.7 for s in ("s1", "s2", "s3", "s4")) and all(report[s].accuracy < 0.65 for s in ("s5", "s6", "s7"))
    assert {report[s].copies_of for s in ("s5", "s6", "s7")} <= {"s5", "s6", "s7"} and report["s1"].copies_of is None
    assert 1 < report["s1"].rounds <= survivors.MOST_ROUNDS
    counted = {r.field: (r.groups, r.same) for r in survivors.agreement(df, book).collect()}
    assert counted["primary"][0] == 120 and counted["keynotes"] == (120, 120)


def test_fusion_of_nothing(spark):
    book = spark.createDataFrame([("good", 1)], "source_id string, trust_rank int")
    rows = [(1, "a", "Alpha", "x", None, 1), (2, "a", "Alpha", "x", ["?"], 1)]
    assert {(r.field, r.v) for r in survivors.fused(entity(spark, rows), book).collect()} == {("primary", "Alpha"), ("keynotes", "x")}
    assert survivors.fused(entity(spark, rows).limit(0), book).count() == 0
    with pytest.raises(ValueError):
        survivors.survivors(entity(spark, rows), spark.createDataFrame([(str(i), i) for i in range(survivors.MOST_SOURCES + 1)], "source_id string, trust_rank int"))


@pytest.fixture
def small_index(monkeypatch):
    """Fewer turns and slots, for speed; neither changes the pairs."""
    monkeypatch.setattr(near_duplicates, "TURNS", 2)
    monkeypatch.setattr(near_duplicates, "SLOTS", 1 << 12)


def brute_pairs(rows, least, share):
    sets = {i: set(near_duplicates.WORD.findall(t.lower())) for i, t in rows if t}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}x" for i in range(3000)]
    phrases = [f"common{i}" for i in range(30)]
    rows, n = [], itertools.count(1)
    for _ in range(60):
        base = rng.sample(vocabulary, 70) + rng.sample(phrases, 20)
        for k in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.randint(0, 22) if k else 0):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(text)
            rows.append((next(n), " ".join(text).upper() if rng.random() < 0.2 else ", ".join(text)))
    rows += [(next(n), None), (next(n), ""), (next(n), "few words"), rows[0], (next(n), rows[0][1])]
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], "entry_id long, text string, id string, doc int")
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()}
    want = brute_pairs(rows, 50, 0.6)
    assert got == want and len(want) > 60
    assert near_duplicates.near_duplicate_pairs(df.limit(0)).count() == 0


def test_near_duplicates_of_a_hot_group(spark, small_index):
    """A third of all rows are edited copies of one text; the rest come from one template."""
    rng = random.Random(6)
    template = [f"common{i}" for i in range(300)]
    base = [f"base{i}" for i in range(40)] + rng.sample(template, 60)
    rows = []
    for i in range(300):
        text = list(base) if i % 3 == 0 else [f"own{i}x{k}" for k in range(25)] + rng.sample(template, 75)
        if i % 3 == 0:
            for _ in range(rng.randint(0, 12)):
                text[rng.randrange(len(text))] = f"typo{rng.getrandbits(30)}"
        rows.append((i, " ".join(text)))
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "entry_id long, text string")).collect()}
    want = brute_pairs(rows, 50, 0.6)
    assert got == want and len(want) > 4000


def test_near_duplicates_edited_with_frequent_words(spark, small_index):
    """No word is rare: copies of one text differ by words that a third of all rows hold."""
    rng = random.Random(7)
    vocabulary = [f"common{i}" for i in range(300)]
    base = rng.sample(vocabulary, 100)
    rows = []
    for i in range(300):
        text = list(base) if i % 3 == 0 else rng.sample(vocabulary, 100)
        for k in rng.sample(range(100), rng.randint(0, 25) if i % 3 == 0 else 0):
            text[k] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "entry_id long, text string")).collect()}
    want = brute_pairs(rows, 50, 0.6)
    assert got == want and len(want) > 2000


def test_near_duplicates_of_a_hot_group_with_many_edits(spark, small_index):
    """Copies with 0 to 25 misspellings in 100 words: the much edited ones have many rare words, but none in common with the others."""
    rng = random.Random(8)
    template = [f"common{i}" for i in range(300)]
    base = rng.sample(template, 100)
    rows = []
    for i in range(300):
        text = list(base) if i % 3 == 0 else [f"own{i}x{k}" for k in range(25)] + rng.sample(template, 75)
        for k in rng.sample(range(100), rng.randint(0, 25) if i % 3 == 0 else 0):
            text[k] = f"typo{rng.getrandbits(30)}"
        rows.append((i, " ".join(text)))
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "entry_id long, text string")).collect()}
    want = brute_pairs(rows, 50, 0.6)
    assert got == want and len(want) > 2000


@pytest.mark.parametrize(("hot", "levels"), [(5, 1), (5, 2), (20_000, 2)])
def test_near_duplicates_with_refined_lists(spark, small_index, hot, levels):
    """However lists are refined and cut into blocks, no pair is lost; sizes span three classes."""
    rng = random.Random(9)
    vocabulary = [f"common{i}" for i in range(900)]
    rows = []
    for size in (20, 60, 150, 200, 310, 420):
        base = rng.sample(vocabulary, size)
        for i in range(14):
            text = list(base) if i % 3 else rng.sample(vocabulary, size)
            for k in rng.sample(range(size), rng.randint(0, size // 4)):
                text[k] = rng.choice(vocabulary) if rng.random() < 0.5 else f"typo{rng.getrandbits(30)}"
            rows.append((len(rows), " ".join(text[rng.randint(0, size // 5) :])))
    sets = near_duplicates.word_sets(spark.createDataFrame(rows, "entry_id long, text string"), "entry_id", "text", 10)
    ids = {r.doc: r.id for r in sets.collect()}
    got = {tuple(sorted((ids[r.da], ids[r.db]))) for r in near_duplicates.similar_sets(sets, 0.6, 10, hot, levels).collect()}
    want = brute_pairs(rows, 10, 0.6)
    assert got == want and len(want) > 100


def test_near_duplicate_candidates_of_unrelated_texts(monkeypatch):
    """Texts of some words of their own and many of a small vocabulary hardly meet, though the lists of its words hold most of them; edited copies do."""
    monkeypatch.setattr(near_duplicates, "FEW", 20)
    rng = np.random.default_rng(2)
    texts, own, common = 1_000, 16, 64
    words = np.concatenate([np.concatenate([1_000 + own * i + np.arange(own), np.sort(rng.choice(120, common, replace=False))]) for i in range(texts)]).astype(np.uint32)
    words = words.reshape(texts, -1)
    words[1, own:] = words[0, own:]
    words[1, own : own + 6] = np.setdiff1d(np.arange(120), words[0])[:6]
    words[1, own:].sort()
    words[1, :8] = words[0, :8]  # 16 - 8 and 6 differ on either side: 66 of 94
    n, rare = np.full(texts, own + common), np.full(texts, own)
    groups = [float(np.ceil(near_duplicates.Postings(0.6, 50).slack(n, rare, n * 0)[0]))]
    batch = pa.record_batch([pa.array(range(texts)), pa.array([w.tobytes() for w in words]), pa.array(rare), pa.array(rare)], names=["doc", "words", "rare", "known"])
    table = np.bincount(near_duplicates._slot(near_duplicates.Postings(0.6, 50, groups=groups).counted(batch, 1), 1 << 20), minlength=1 << 20)
    key, doc, _ = near_duplicates.Postings(0.6, 50, tables=[table], groups=groups).keys(words.ravel(), n, rare, rare, 2)
    met = set()
    for k in np.unique(key[np.argsort(key)][1:][np.diff(np.sort(key)) == 0]):
        same = np.unique(doc[key == k])
        met |= set(itertools.combinations(same.tolist(), 2))
    assert (0, 1) in met and len(met) < 0.05 * texts * texts / 2


@pytest.mark.parametrize("hot", [20_000, 15])
def test_near_duplicate_postings_of_a_turn(monkeypatch, hot):
    """Each posting comes in one turn, though lists are cut into blocks, and a turn doesn't work out the postings of all others."""
    monkeypatch.setattr(near_duplicates, "FEW", 20)
    monkeypatch.setattr(near_duplicates, "TEXTS", 70)
    rng, turns, slots = np.random.default_rng(4), 6, 1 << 16
    sets = [np.unique(np.concatenate([rng.choice(90, size // 2, False), 100 + rng.choice(400, size // 3, False), rng.choice(1 << 30, size // 6)])).astype(np.uint32) for size in rng.integers(60, 170, 200)]
    counts = np.maximum(1, np.bincount(near_duplicates._slot(np.concatenate(sets), slots), minlength=slots)).astype(np.uint32)
    batch = pa.record_batch([pa.array(range(len(sets))), pa.array([w.tobytes() for w in sets])], names=["doc", "words"])
    (batch,) = near_duplicates._ordered(counts, min(20, hot), 60)(iter([batch]))
    tables, groups = [], [2.0, 5.0, 9.0]
    for level in (1, 2):
        keys = near_duplicates.Postings(0.6, 50, hot, 2, tables, groups).counted(batch, level)
        tables = [*tables, np.bincount(near_duplicates._slot(keys, slots), minlength=slots)]
    postings, worked = near_duplicates.Postings(0.6, 50, hot, 2, tables, groups), []
    reach = postings._reach
    monkeypatch.setattr(postings, "_reach", lambda rest, n: worked.append(len(n)) or reach(rest, n))

    def posted(turn, turns):
        found = []
        for row in near_duplicates._posted(postings, turn, turns, 3)(iter([batch])):
            for _, cls, *raw, rows in zip(*(c.to_pylist() for c in row.columns)):
                key, cell, doc, n, reach = (np.frombuffer(v, t) for v, t in zip(raw, (np.uint64, np.int64, np.int64, np.int32, np.int32)))
                found += zip([cls] * len(key), *(x.tolist() for x in (key, cell, doc, n, reach)), np.frombuffer(rows, np.uint8).reshape(len(key), -1).sum(1).tolist())
        return found

    whole = posted(0, 1)
    worked.clear()
    by_turn = [posted(turn, turns) for turn in range(turns)]
    assert all(by_turn) and sorted(itertools.chain(*by_turn)) == sorted(whole)
    assert any(cell for _, _, cell, *_ in whole) == (hot == 15)
    assert sum(worked) < 1.5 * turns * sum(map(len, sets))


def test_near_duplicate_bytes_of_long_texts():
    """The same bytes are counted whole, however many positions there are."""
    rows = np.random.default_rng(5).integers(0, 256, (9_000, 768), dtype=np.uint8)
    rows[1::2, :700] = rows[::2, :700]
    eights = [np.ascontiguousarray(c) for c in rows.view(np.uint64).T]
    a, b = np.arange(0, 9_000, 2).repeat(3), np.arange(1, 9_000, 2).repeat(3)
    assert near_duplicates.tally(a, b, eights).tolist() == (rows[a] == rows[b]).sum(1).tolist()
    assert near_duplicates.tally(a, a, eights).tolist() == [768] * len(a)
    assert len(near_duplicates.tally(a[:0], b[:0], eights)) == 0


def test_near_duplicate_bytes_keep_the_guaranteed_minimum():
    rng = np.random.default_rng(1)
    for positions, most in ((96, 160), (192, 320)):
        for _ in range(200):
            n = int(rng.integers(20, most))
            a = rng.choice(1 << 30, n, replace=False).astype(np.uint32)
            b = a.copy()
            b[: rng.integers(0, n // 3)] += np.uint32(1 << 30)
            share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            both = near_duplicates.digest(np.concatenate([a, b]), np.array([n, n]), positions)
            eights = [np.ascontiguousarray(c) for c in both.view(np.uint64).T]
            shared = near_duplicates.tally(np.array([0]), np.array([1]), eights)[0]
            assert shared == (both[0] == both[1]).sum()
            assert share < 0.6 or shared >= near_duplicates.least_shared(positions, n, n, 0.6) > 0


def test_near_duplicate_copies_in_blocks(spark, small_index, monkeypatch):
    monkeypatch.setattr(near_duplicates, "COPIES", 3)
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(i, base + (f" extra{i % 2}" if i % 5 else "")) for i in range(40)] + [(100, None), (101, "short")]
    df = spark.createDataFrame([*rows, rows[0]], "entry_id long, text string")
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2 and all(a < b for a, b in got)
    classes = {r.entry_id: (r.class_id, r.links) for r in near_duplicates.near_duplicate_classes(df).collect()}
    assert classes == {i: ({0: 0, 1: 2, 2: 1}[0 if i % 5 == 0 else 2 if i % 2 else 1], 2) for i in range(40)}


def test_near_duplicate_words():
    assert near_duplicates.words_of("A_b ¾c x² é1 γ-д") == {"a", "b", "c", "x", "é1", "γ", "д"}
    assert near_duplicates.words_of("It's x_1\x1fy") == {b"it", b"s", b"x", b"1", b"y"}
    assert set(near_duplicates.WORD.findall("a_b ¾c x² é1 Γ-д")) == {"a", "b", "c", "x", "é1", "Γ", "д"}


def first_fit(tokens, loss, most):
    """First-fit decreasing under the same limits, for comparison."""
    boxes = []
    for k in np.argsort(-tokens, kind="stable"):
        item = np.array([tokens[k], 1, loss[k]])
        for used in boxes:
            if (used + item <= most).all():
                used += item
                break
        else:
            boxes.append(item)
    return len(boxes)


@pytest.mark.parametrize("seed", range(3))
def test_pack(seed):
    rng = np.random.default_rng(seed)
    t = np.minimum(512, rng.gamma(2, 90, 700).astype(int) + 1)
    q = (t * np.where(rng.random(700) < 0.5, 1, rng.random(700))).astype(int)
    most = bin_packing.limits(512)
    bins, slots = bin_packing.pack(t, q, most)
    loss, count = np.bincount(bins, q), np.bincount(bins)
    assert (np.bincount(bins, t) <= most[0]).all() and (count <= most[1]).all() and ((loss <= most[2]) | (count == 1)).all()
    assert len({(b, s) for b, s in zip(bins, slots)}) == 700
    assert (loss >= 0.995 * most[2]).mean() > 0.05  # not only the tokens bind
    assert bins.max() + 1 <= first_fit(t, q, most) * 1.01 + 1


@pytest.mark.parametrize("seed", range(6))
def test_pack_against_brute_force(seed):
    """At most one container more than the best of all packings, under limits that all bind."""
    rng = np.random.default_rng(seed)
    t = rng.integers(5, 60, 8)
    q = (t * rng.random(8)).astype(int)
    most = (100, 3, 45)
    q = np.minimum(q, most[2])

    def best(k, boxes):
        if k == len(t):
            return len(boxes)
        item = (t[k], 1, q[k])
        options = [best(k + 1, [*boxes, item])] if len(boxes) < 8 else []
        for i, b in enumerate(boxes):
            more = tuple(x + y for x, y in zip(b, item))
            if all(x <= y for x, y in zip(more, most)):
                options.append(best(k + 1, [*boxes[:i], more, *boxes[i + 1 :]]))
        return min(options)

    bins, _ = bin_packing.pack(t, q, most)
    assert (np.bincount(bins, t) <= 100).all() and (np.bincount(bins) <= 3).all() and (np.bincount(bins, q) <= 45).all()
    assert bins.max() + 1 <= best(0, []) + 1


def test_kinds_of_container_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(bin_packing, "MOST_KINDS", 2)
    with pytest.raises(ValueError):
        bin_packing._capacities(spark.createDataFrame([(str(i), 9) for i in range(3)], "bin_kind string, capacity_tokens int"))


needs_vocabulary = pytest.mark.skipif(not Path(token_counts.VOCABULARY).exists(), reason="no vocabulary")
DOC = "doc_id long, text string, source string, lang string, tokens int, bin_kind string"


@needs_vocabulary
def test_containers(spark):
    bins = spark.createDataFrame([("s", 64), ("m", 256), ("none", None), ("zero", 0)], "bin_kind string, capacity_tokens int")
    texts = ["word " * n for n in (1, 5, 40, 63, 64, 65, 200, 1000)] + ["prompt\n" + "x " * 20, None, ""]
    df = spark.createDataFrame([(i, t, "a", None, 1, "z") for i, t in enumerate(texts)] + [(0, texts[0], "a", None, 1, "z")], DOC)
    out = bin_packing.containers(df, bins).toPandas()
    size = {i: len(token_counts.encoding().encode_ordinary(t)) for i, t in enumerate(texts) if t}
    for kind, capacity in (("s", 64), ("m", 256)):
        part = out[out.bin_kind == kind]
        assert (part.groupby("bin_id").tokens.sum() <= capacity).all() and part.groupby("bin_id").unused.nunique().eq(1).all()
        for i, n in size.items():
            pieces = part[part.doc_id == i].sort_values("token_start")
            assert pieces.tokens.sum() == n * (2 if i == 0 else 1)
            assert n <= capacity or (pieces.tokens.iloc[:-1] == capacity).all()
            assert n > capacity or (pieces.piece == 0).all()
    prompt = out[(out.doc_id == 8) & (out.bin_kind == "m")].iloc[0]
    assert 0 < prompt.loss_tokens < prompt.tokens
    assert set(out.bin_kind) == {"s", "m"}
    packed = bin_packing.containers(df.dropDuplicates(["doc_id"]), bins)
    checked = bin_packing.check(packed, bins).toPandas()
    assert set(checked.documents) == {9} and (checked[["over_tokens", "over_segments", "over_loss", "torn", "cut"]] == 0).all().all()
    assert (bin_packing.fill(packed, bins).toPandas().full_tokens >= 1).all()
    assert bin_packing.containers(df.limit(0), bins).count() == 0 and bin_packing.containers(df, bins.limit(0)).count() == 0


@needs_vocabulary
def test_mix(spark):
    rows = [(i, f"text number {i} " * 5, s, None, 1, "z") for i, s in enumerate(["big"] * 300 + [" Mid "] * 200 + ["small"] * 5 + ["other"] * 50)] + [(9001, None, "big", None, 1, "z"), (9002, "x", None, None, 1, "z")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("gone", 0.1, 4)], "source string, target_share double, max_repeat int")
    df = spark.createDataFrame(rows, DOC)
    out = mixing.mix(df, targets, budget=2500).toPandas()
    assert 2400 < out.tokens.sum() <= 2500 and out.finish.is_monotonic_increasing
    assert not out.duplicated(["source", "doc_id", "use"]).any() and set(out.source) == {"big", "mid", "small"}
    assert out[out.source == "small"].use.max() <= 2 and (out[out.source == "big"].use == 0).all()
    again = mixing.mix(df, targets, budget=2500).toPandas()
    assert again.equals(out)
    s = {r.source: r for r in mixing.shares(mixing.mix(df, targets, budget=1000), targets, df).collect()}
    assert abs(s["big"].share / s["mid"].share - 5 / 3) < 0.15 and s["gone"].tokens == 0 and abs(sum(r.share for r in s.values()) - 1) < 1e-9
    # brute force: each source's documents in turn, cut at the budget
    every = mixing.draws(token_counts.count_tokens(df, keep=[F.col("doc_id"), F.lower(F.trim("source")).alias("source")]), targets).toPandas()
    order = every.sort_values(["finish", "source", "use", "doc_id"], ignore_index=True)
    kept = order[order.tokens.cumsum() <= 2500]
    assert set(zip(kept.doc_id, kept.use)) == set(zip(out.doc_id, out.use))
    for name, group in every.groupby("source"):
        weight = {"big": 0.5, "mid": 0.3, "small": 0.1}[name]
        ranked = group.sort_values("finish")
        assert np.allclose(ranked.tokens.cumsum() / weight, ranked.finish) and ranked.use.is_monotonic_increasing
    assert {n: r.state for n, r in s.items()} == {"big": "lasted", "mid": "lasted", "small": "used up" if s["small"].draws == 15 else "lasted", "gone": "absent"}
    checked = mixing.check(mixing.mix(df, targets, budget=2500), targets, df).toPandas()
    assert (checked[["repeated", "too_often", "off_share"]] == 0).all().all()
    assert mixing.mix(df.limit(0), targets).count() == 0


def test_mix_end_time():
    weights = [("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 1), ("gone", 0.2, 3)]
    totals = {"a": 100, "b": 400, "c": 1}
    assert mixing.end_time(totals, weights, 5) == pytest.approx(5 / 1.0)
    assert mixing.end_time(totals, weights, 451) == pytest.approx(350 / 0.4)  # a and c are used up
    assert mixing.end_time(totals, weights, 5_000) == float("inf")


PROSE = "The discharge is slimy and bloody, with hoarseness in the forenoon. Limbs tremble every third day; the knees seem weak after wine. Old ulcers about the ears reopen, with milky edges and a boring base. What she called the dreamy state is joined to fainting at night. "
TERMS = ["cheap", "discount", "near me", "best price", "for sale", "free shipping", "order now"]


def pages():
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(4))
    keyword = " ".join(f"{rng.choice(['fever', 'catarrh', 'Zintelora'])} {rng.choice(TERMS)}" for _ in range(90))
    stops = " ".join(" ".join(rng.choice(TERMS + ["fever", "drops"]) for _ in range(6)).capitalize() + "." for _ in range(40))
    link = "\n".join(f"[fever {rng.choice(['drops', 'balm', 'tea'])}](https://www.{rng.getrandbits(40):x}-notes.test/{rng.getrandbits(30):x})" for _ in range(40))
    tags = " ".join(f"#{rng.choice(['Fever', 'Cough'])}{rng.choice(['Drops', 'Balm'])}{rng.choice(['NearMe', 'Discount', 'Online'])}" for _ in range(80))
    doses = "\n".join(f"{name()}ia {name()}alis | {rng.choice(['tincture', 'powder', 'third dilution', 'lotion', 'ointment', 'vapour', 'fluid extract', 'poultice', 'syrup', 'lozenge'])} | {rng.randint(1, 99)} drops | {rng.choice(['at noon', 'in autumn', 'before midnight', 'each spring', 'at dusk', 'every third day', 'towards morning', 'for several weeks', 'after a fortnight', 'during harvest'])}" for _ in range(12))
    prose = "".join(PROSE.replace("wine", f"w{rng.getrandbits(30):x}").replace("ears", f"e{rng.getrandbits(30):x}").replace("night", f"n{rng.getrandbits(30):x}") for _ in range(3))
    return [(1, keyword, True), (2, stops, True), (3, link, True), (4, tags, True), (5, doses, False), (6, prose[:700], False), (7, prose[:700] + keyword[:300], False), (8, PROSE[:300] + keyword, True), (9, "", None), (10, None, None), (11, "  \n", None), (12, keyword * 300, True)]


def test_stuffed_pages(spark):
    rng = random.Random(5)
    filler = [(100 + i, "".join(" ".join(rng.sample(PROSE.split(), 14)) + ". " for _ in range(8)), None) for i in range(30)]
    df = spark.createDataFrame([(i, t, "EN ", 1) for i, t, _ in pages() + filler], "doc_id long, text string, lang string, chars int")
    got = {r.id: r.junk_share for r in stuffed_pages.junk_shares(df).collect()}
    for i, _, want in pages():
        assert (i in got) == (want is not None)
        if want is not None:
            assert (got[i] > 0.5) is want, (i, got[i])
    assert stuffed_pages.junk_pages(df.limit(0)).count() == 0


def test_stuffed_language(spark):
    df = spark.createDataFrame([(" EN",), ("deutsch",), ("xx",), (None,)], "x string")
    assert [r.y for r in df.select(stuffed_pages.language(F.col("x")).alias("y")).collect()] == ["en", "de", None, None]

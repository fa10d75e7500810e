from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (T.squeeze, "  a  b\n", "a b"),
        (T.words, "Ab abc DEF-xéyz", ["abc", "def"]),
        (lambda c: T.kept_words(c, ["the"]), "the head the head", ["head", "head"]),
        (lambda c: T.windows(T.words(c), 2), "one two three", ["one two", "two three"]),
        (lambda c: T.windows(T.words(c), 3), "one two", []),
        (T.fold_marks, "Œnanthé", "Œnanthe"),
        (T.decode_entities, "a &amp;amp; &eacute; b", "a &amp; é b"),
        (T.title_case, "JOHN'S RHUS-TOX", "John'S Rhus-Tox"),
        (lambda c: T.slug(c, "plain"), "Œnanthe – Æsculus é", "nanthe-sculus"),
        (lambda c: T.slug(c, "marks"), "Æsculus é", "sculus-e"),
        (lambda c: T.slug(c, "ae"), "Æsculus Œ", "aesculus"),
        (T.slug, "Œnanthe Æsculus é", "oenanthe-aesculus-e"),
        (T.slug, None, None),
        (T.point_key, "Lamium ALBUM-2", "lamiumalbum-2"),
        (T.clean_escaped, "a<br>b &lt;b&gt;c", "ab c"),
        (T.clean_markup, "<script>x</p></script>a<br>b &lt;b&gt;", "a b <b>"),
        (T.links, "<A class=q HREF='x.htm'>a</a><a href=\"y\">b</a><a href=y>", ["x.htm", "y", "y"]),
        (lambda c: T.markup_title(c, cut=" - "), "<title>Kava - A &amp; B</title>", "Kava"),
        (T.paragraphs, "<p>One <b>x</b></p><p>no</p><p>* * *</p><script>'</p>'</script><p class=a>Two two</p>", ["One x", "Two two"]),
        (lambda c: F.to_json(T.last_wins(T.headed_sections(c))), "<h2>A</h2>one<h2>B</h2>two<h2>A</h2>three</body>", '[{"head":"A","body":"three"},{"head":"B","body":"two"}]'),
        (lambda c: F.to_json(T.labelled_sections(c)), "Intro. Head.--Pain. Eyes, left.--Red", '[{"label":"","text":"Intro."},{"label":"head","text":"Pain."},{"label":"eyes","text":"Red"}]'),
        (lambda c: F.to_json(T.labelled_sections(c)), "no labels", '[{"label":"","text":"no labels"}]'),
        (lambda c: F.to_json(T.ruled_sections(c)), "x\n---Dose---\none\n---Use---\ntwo", '[{"head":"Dose","body":"one"},{"head":"Use","body":"two"}]'),
        (T.numbered_items, "1. First item\n2) Second\nmore\n3. x", ["First item", "Second more"]),
        (T.bullets, "a; ─ b. ─── ", ["a", "b"]),
        (lambda c: T.between(c, ["A:", "B:"], ["X", "Y"]), "q B: text Y z X", "text"),
        (lambda c: T.between(c, ["A:"], ["X"]), "nothing", ""),
        (lambda c: F.to_json(T.modalities(c)), "Rest. Better, from heat. Worse, at night; better cold.", '[{"side":"better","text":"from heat"},{"side":"worse","text":"at night"},{"side":"better","text":"cold"}]'),
        (T.relations, "Complementary: Bry.; Sil. Antidotes: Camph, Nux. Follows well: .", {"complementary": ["Bry"], "antidoted_by": ["Camph", "Nux"]}),
        (T.evidence_rating, "There is no good evidence; may help", "no_evidence"),
        (T.evidence_rating, "It may help some", "weak_support"),
        (T.evidence_rating, "", "insufficient_data"),
        (lambda c: T.routed(c, [("dose", "dosing"), ("use", "uses")], "summary"), "Medicinal USES", "uses"),
        (lambda c: T.looked_up(c, {"mind": "m", "left eye": "e"}), "Left  Eye and lid", "e"),
        (T.heading_line, "\n\nTHE HEART\nbody", "THE HEART"),
        (T.heading_line, "The heart is\nbody", ""),
        (lambda c: T.scanned_paragraphs(c, 5), "12\nbro-\nken word\n\nab\n\nsecond one", ["broken word", "second one"]),
        (T.fence_stripped, '```json\n{"a": 1}\n```', '{"a": 1}'),
        (T.label, "mental_emotional", "Mental Emotional"),
    ],
)
def test_text(spark, column, value, want):
    assert one(spark, column, value) == want


def test_rounding_is_half_up_and_exact(spark):
    df = spark.sql("select cast(v as decimal(18,4)) x from values ('0.45'), ('0.25'), ('0.35') t(v)")
    assert [r.y for r in df.select(T.round_half_up(F.col("x")).alias("y")).collect()] == [0.5, 0.3, 0.4]


def test_bytes_fall_through_charsets(spark):
    df = spark.createDataFrame([(b"caf\xe9",), ("é".encode(),), (None,)], "b binary")
    assert [r.y for r in df.select(T.decode_bytes("utf-8", "cp1252")("b").alias("y")).collect()] == ["café", "é", None]


def test_slug_twice_is_slug(spark):
    df = spark.createDataFrame([("Ænea -- X!",), ("",), ("ß",)], "x string").select(T.slug(F.col("x")).alias("y"))
    assert df.select("y", T.slug(F.col("y")).alias("z")).where("not y <=> z").count() == 0

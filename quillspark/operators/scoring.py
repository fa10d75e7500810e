"""Weighted evidence scoring of structured forms and of search plans.

Both compile to one long table of plan rows and then to awards ``(case, seq,
key, points, label)`` that are summed as decimals.  Which rules apply, with how
many points, is data.  Nearly every form scores nearly every document, so the
best documents of forms are found without a row for each award (``blocks``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed_values as fixed
from quillspark.functions.text import kept_words, round_half_up, windows, words
from quillspark.operators import blocks
from quillspark.operators.search import first_match, term_hits
from quillspark.plans.scratch import materialize

POINTS = "decimal(18,4)"
LABELS = 20
#: Salts over which the hits of a term are spread.
SPREAD = 8


CONSTITUTION = ("thermal", "thirst", "build", "appetite")
HABITS = ("sleep_position", "sleep_quality", "sweat_pattern", "sweat_location")
FREE = ("past_medical", "family_history", "medications", "additional")


@dataclass(frozen=True)
class Profile:
    """Points of each rule; a rule without points is left out.  ``fields`` are searched in this order."""

    top: int = 50
    points: dict[str, float] = field(
        default_factory=lambda: {
            "both": 5.0,
            "location_rest": 1.0,
            "sensation_rest": 1.0,
            "location_only": 2.0,
            "sensation_only": 2.0,
            "side": 1.5,
            "modality_in": 2.5,
            "modality_out": 0.5,
            "modality_alone": 1.5,
            "window": 3.0,
            "word": 0.5,
            "ailments_all": 4.0,
            "ailments_one": 3.0,
            "constitution_all": 2.0,
            "constitution_one": 1.5,
            "habit": 1.5,
            "checked_all": 2.0,
            "checked_one": 1.5,
            "free": 0.3,
        }
    )
    fields: tuple[str, ...] = ("ailments_from", *CONSTITUTION, *HABITS, "_checked", *FREE)
    #: Fields whose choices are looked up in ``sensations``; others go by their words.
    looked_up: tuple[str, ...] = (*CONSTITUTION, *HABITS)
    windows: tuple[int, ...] = (3, 2)
    locations: tuple[str, ...] = tuple(fixed.LOCATION_TERMS)
    sensations: str = "KEYWORD_EXPANSIONS"

    @property
    def location_terms(self) -> dict[str, list[str]]:
        return {k: fixed.LOCATION_TERMS[k] for k in self.locations}

    @property
    def sensation_terms(self) -> dict[str, list[str]]:
        return getattr(fixed, self.sensations)


SERVER = Profile()
_NOT_IN_BROWSER = ("side", "modality_in", "modality_out", "modality_alone", "word", "habit", "free", "constitution_all", "constitution_one")
BROWSER = Profile(
    top=10,
    points={k: v for k, v in SERVER.points.items() if k not in _NOT_IN_BROWSER} | {"constitution_any": 1.5},
    fields=("_checked", "ailments_from", "thermal", "thirst", "appetite"),
    looked_up=(),
    windows=(2, 3),
    locations=tuple(fixed.BROWSER_LOCATIONS),
    sensations="BROWSER_SENSATIONS",
)


def _dictionary(c: Column, table: dict[str, list[str]]) -> Column:
    """The terms of a choice, or its words without stop words."""
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    return F.coalesce(F.try_element_at(known, c), kept_words(F.coalesce(c, F.lit("")), fixed.STOP_WORDS))


def symptom_plan(symptoms: DataFrame, case: str = "case_id", profile: Profile = SERVER) -> DataFrame:
    """``case, seq, at, both, placed, felt, rule, label, terms``: what is searched for each symptom.

    ``loc`` and ``sens`` rows hold OR lists; ``placed`` and ``felt`` say whether the symptom has them.
    """
    s = symptoms.dropDuplicates([case, "n"]).select(
        F.col(case).alias("case"),
        F.col("n").alias("seq"),
        F.coalesce(F.trim("sx_location"), F.lit("")).alias("location"),
        F.coalesce(F.trim("sx_sensation"), F.lit("")).alias("sensation"),
        F.coalesce("sx_side", F.lit("")).alias("side"),
        "sx_better",
        "sx_worse",
        kept_words(F.coalesce("sx_desc", F.lit("")), fixed.STOP_WORDS).alias("desc"),
    )
    s = s.withColumn("loc", _dictionary(F.col("location"), profile.location_terms)).withColumn("sens", _dictionary(F.col("sensation"), profile.sensation_terms))
    none = F.array().cast("array<string>")
    row = lambda rule, label, terms: F.struct(F.lit(rule).alias("rule"), label.alias("label"), terms.alias("terms"))
    empty = F.array().cast("array<struct<rule:string,label:string,terms:array<string>>>")
    parts = [F.filter(F.array(row("loc", F.col("location"), F.col("loc")), row("sens", F.col("sensation"), F.col("sens"))), lambda r: F.size(r["terms"]) > 0)]
    if "side" in profile.points:
        side_words = kept_words(F.col("side"), fixed.STOP_WORDS)
        parts.append(F.when(~F.col("side").isin("", "N/A", "Both sides") & (F.size("loc") > 0), F.transform(side_words, lambda w: row("side", F.concat_ws(" ", F.col("side"), F.col("location")), F.array(w)))))
    if "modality_in" in profile.points:
        modality = lambda name: lambda m: row("modality", F.concat(F.lit(f"{name}: "), m), kept_words(F.coalesce(m, F.lit("")), fixed.STOP_WORDS))
        parts += [F.transform(F.coalesce(F.col(f"sx_{name}"), none), modality(name)) for name in ("better", "worse")]
    for k in profile.windows:
        parts.append(F.when(F.size("desc") >= 2, F.transform(windows(F.col("desc"), k), lambda w: row("window", w, F.split(w, " ")))))
    if "word" in profile.points:
        parts.append(F.transform("desc", lambda w: row("word", w, F.array(w))))
    both = F.concat_ws(" + ", "location", "sensation")
    every = F.concat(*[F.coalesce(x, empty) for x in parts])
    return s.select("case", "seq", both.alias("both"), (F.size("loc") > 0).alias("placed"), (F.size("sens") > 0).alias("felt"), F.posexplode(every).alias("at", "r")).select("case", "seq", "at", "both", "placed", "felt", "r.*").where("size(terms) > 0")


def form_plan(fields: DataFrame, case: str = "case_id", profile: Profile = SERVER) -> DataFrame:
    """The other fields of a form as plan rows; repeated deliveries of a field count once.

    Rows without terms hit nothing; they stay, as their label may count as searched for.
    """
    f = fields.dropDuplicates([case, "field", "seq"]).select(F.col(case).alias("case"), "field", F.col("seq").alias("at"), F.col("field_value").alias("value")).where("value is not null and value <> ''")
    name = F.col("field")
    rule = F.when(name == "ailments_from", "ailments").when(name.isin(*CONSTITUTION), "constitution").when(name.isin(*HABITS), "habit").when(name == "_checked", "checked").when(name.isin(*FREE), "free")
    tokens = kept_words(F.col("value"), fixed.STOP_WORDS)
    terms = F.when(name.isin(*profile.looked_up), _dictionary(F.col("value"), profile.sensation_terms)).otherwise(tokens) if profile.looked_up else tokens
    label = F.when(name == "ailments_from", F.concat(F.lit("Ailments from: "), "value")).otherwise(F.col("value"))
    seq = F.array_position(F.array(*[F.lit(x) for x in profile.fields]), name).cast("int") + 1_000_000
    return f.where(name.isin(*profile.fields)).select("case", seq.alias("seq"), "at", rule.alias("rule"), label.alias("label"), terms.alias("terms"))


def _points(profile: Profile, rule: str) -> Column:
    return F.lit(profile.points[rule]).cast(POINTS) if rule in profile.points else F.lit(None).cast(POINTS)


def _plan_rows(symptoms: DataFrame, fields: DataFrame, profile: Profile) -> DataFrame:
    """The numbered plan rows of all cases."""
    form = form_plan(fields, profile=profile).select("case", "seq", "at", F.lit("").alias("both"), F.lit(False).alias("placed"), F.lit(False).alias("felt"), "rule", "label", "terms")
    one_by_one = F.posexplode_outer(F.when(F.col("rule") == "free", F.transform("terms", lambda t: F.array(t))).otherwise(F.array("terms")))
    plan = symptom_plan(symptoms, profile=profile).unionByName(form).select("case", "seq", "at", "both", "placed", "felt", "rule", "label", one_by_one.alias("part", "terms"))
    plan = plan.withColumn("label", F.when(F.col("rule") == "free", F.col("terms")[0]).otherwise(F.col("label")))
    return materialize(plan.withColumn("row", F.monotonically_increasing_id()), "plan")


def _plan_terms(plan: DataFrame) -> DataFrame:
    """A row for each distinct term of a plan row: ``size`` and ``need`` count the row's terms with and without repeats, ``m`` the term's."""
    rows = plan.select("case", "seq", "row", "rule", "placed", "felt", F.size("terms").alias("size"), F.size(F.array_distinct("terms")).alias("need"), "terms")
    each = rows.withColumn("term", F.explode(F.array_distinct("terms")))
    return each.withColumn("m", F.size(F.filter("terms", lambda t: t == F.col("term")))).drop("terms")


def _hit_rows(plan: DataFrame, hits: DataFrame) -> DataFrame:
    """All plan rows with the documents that they hit, ``got`` terms of each (``got_all`` with repeats).

    A broad term meets nearly all documents, so hits are spread over ``SPREAD``
    salts and the few plan rows repeated for each.
    """
    rows = _plan_terms(plan).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    met = rows.join(hits.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SPREAD)).cast("int")), ["term", "salt"])
    return _got(met)


def _got(met: DataFrame) -> DataFrame:
    keys = ["case", "seq", "key"]
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, *keys).groupBy(*keys, "row", "rule", "placed", "felt", "size", "need").agg(F.count(F.lit(1)).alias("got"), F.sum("m").alias("got_all"))


def _free_points(profile: Profile) -> Column:
    """Points of the rules that don't depend on what else of the symptom a document has."""
    p = lambda rule: _points(profile, rule)
    rule, full, several = F.col("rule"), F.col("got") == F.col("need"), F.col("size") >= 2
    any_word = "constitution_any" in profile.points
    return (
        F.when(rule == "window", F.when(full, p("window")))
        .when(rule == "word", p("word"))
        .when(rule == "ailments", F.when(full, F.when(several, p("ailments_all")).otherwise(p("ailments_one"))))
        .when(rule == "constitution", p("constitution_any") * F.col("got_all") if any_word else F.when(full, F.when(several, p("constitution_all")).otherwise(p("constitution_one"))))
        .when(rule == "habit", p("habit") * F.col("got_all"))
        .when(rule == "checked", F.when(full, F.when(several, p("checked_all")).otherwise(p("checked_one"))))
        .when(rule == "free", p("free"))
    )


def _form_points(got: DataFrame, profile: Profile) -> DataFrame:
    """``case, seq, key, row, points, paired``: the award of each plan row to each document that it hits."""
    here = Window.partitionBy("case", "seq", "key")
    seen = got.withColumn("in_loc", F.max(F.col("rule") == "loc").over(here)).withColumn("in_sens", F.max(F.col("rule") == "sens").over(here))
    p = lambda rule: _points(profile, rule)
    rule = F.col("rule")
    points = (
        F.when(rule == "loc", F.when(~F.col("felt"), p("location_only") * F.col("got_all")).when(F.col("in_sens"), p("both")).otherwise(p("location_rest")))
        .when(rule == "sens", F.when(~F.col("placed"), p("sensation_only") * F.col("got_all")).when(~F.col("in_loc"), p("sensation_rest")))
        .when(rule == "side", F.when(F.col("in_loc"), p("side")))
        .when(rule == "modality", F.when(~F.col("placed"), p("modality_alone")).when(F.col("in_loc"), p("modality_in")).otherwise(p("modality_out")))
        .otherwise(_free_points(profile))
    )
    paired = (rule == "loc") & F.col("felt") & F.col("in_sens")
    return seen.select("case", "seq", "key", "row", points.cast(POINTS).alias("points"), paired.alias("paired")).where("points is not null")


def _labelled(points: DataFrame, plan: DataFrame) -> DataFrame:
    label = F.when(F.col("paired"), F.col("both")).otherwise(F.col("label"))
    return points.join(plan.select("row", "at", "both", "label"), "row").select("case", "seq", "at", "key", "points", label.alias("label"))


def form_awards(symptoms: DataFrame, fields: DataFrame, posted: DataFrame, key: str, profile: Profile = SERVER) -> DataFrame:
    """``case, seq, at, key, points, label``: the awards of all rules.

    "All" means that the terms occur anywhere in the document, not side by
    side.  An award given for each term comes as one row of their sum.
    """
    plan = _plan_rows(symptoms, fields, profile)
    hits = materialize(term_hits(posted, plan.select(F.explode("terms").alias("term")).distinct(), key).withColumnRenamed(key, "key"), "hits")
    return _labelled(_form_points(_hit_rows(plan, hits), profile), plan)


def ranked_forms(symptoms: DataFrame, fields: DataFrame, posted: DataFrame, key: str, profile: Profile = SERVER) -> DataFrame:
    """The same as ``ranked(form_awards(...))``, with no row for an award.

    ``posted`` has a row for each token, or one row a document with its ``tokens``.
    """
    if min(profile.points.values()) <= 0:  # then a sum of zero may have awards
        return ranked(form_awards(symptoms, fields, posted, key, profile), profile.top)
    docs, found = blocks.token_sets(posted, key), None
    for turn in blocks.turns(_plan_rows(symptoms, fields, profile)):
        scored, sent = blocks.top_documents(turn, docs, profile.points, profile.top)
        sums = scored.withColumn("sum", (F.col("units").cast("decimal(19,0)") * F.lit(Decimal("0.0001"))).cast("decimal(28,4)")).drop("units")
        best = materialize(_with_pct(_top(sums, profile.top)), "best")
        matched = materialize(blocks.labels(best, sent, profile.points, LABELS), "matched")
        sent.destroy()
        found = matched if found is None else found.unionByName(matched)
    return _shown(found)


def ranked(awards: DataFrame, top: int = 50) -> DataFrame:
    """``case, key, rank, score, pct, matched``: the best documents of each case.

    ``score`` is the exact sum rounded half up to one place, ``pct`` its share
    of the case's best, ``matched`` up to 20 labels in the order first awarded.
    Ties go to the smaller key.  Sums are taken before ranking, so a hot case
    brings one row a document to its window; Spark's group limit keeps the
    first ``top`` of each task before the exchange.
    """
    best = _top(awards.groupBy("case", "key").agg(F.sum("points").alias("sum")), top)
    return _described(best, awards.join(best.select("case", "key"), ["case", "key"], "left_semi"))


def _top(scored: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("case").orderBy(F.desc("sum"), "key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _described(best: DataFrame, awards: DataFrame) -> DataFrame:
    by_label = awards.groupBy("case", "key", "label").agg(F.min(F.struct("seq", "at")).alias("first"))
    labels = by_label.groupBy("case", "key").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("first", "label"))), lambda x: x["label"]), 1, LABELS).alias("matched"))
    return _shown(_with_pct(best).join(labels, ["case", "key"]))


def _with_pct(best: DataFrame) -> DataFrame:
    most = F.max("sum").over(Window.partitionBy("case"))
    return best.withColumn("pct", F.coalesce(F.round(100 * F.try_divide("sum", most)), F.lit(0)).cast("int"))


def _shown(full: DataFrame) -> DataFrame:
    return full.select("case", "key", "rank", round_half_up(F.col("sum")).alias("score"), "pct", "matched")


def keywords_used(symptoms: DataFrame, fields: DataFrame, posted: DataFrame, key: str, profile: Profile = SERVER) -> DataFrame:
    """``case, keywords_used``: the distinct labels that a case searched for, whether or not they hit.

    Windows of a description count only if a document has all their words;
    single words and free text never count; a case that scores no document
    counts 0.  ``posted`` as for ``ranked_forms``.
    """
    plan, docs, met = _plan_rows(symptoms, fields, profile), blocks.token_sets(posted, key), None
    any_word = "constitution_any" in profile.points
    # rows that need all their terms: those of which some document has all
    whole = ("window", "ailments", "checked", *([] if any_word else ["constitution"]))
    for turn in blocks.turns(plan):
        rows = materialize(blocks.rows_met(turn, docs, whole), "met")
        met = rows if met is None else met.union(rows)
    hit = plan.join(met, "row", "left_semi")
    scored = hit.where("rule <> 'side'").select("case").distinct()
    label = F.when(F.col("rule").isin("loc", "sens") & F.col("placed") & F.col("felt"), F.col("both")).otherwise(F.col("label"))
    always = ["ailments", *(["constitution"] if any_word else [])]
    named = plan.where(~F.col("rule").isin("word", "window", "free") & (F.col("rule").isin(*always) | (F.size("terms") > 0)))
    used = named.select("case", label.alias("label")).union(hit.where("rule = 'window'").select("case", "label"))
    counted = used.join(scored, "case", "left_semi").groupBy("case").agg(F.count_distinct("label").alias("keywords_used"))
    cases = symptoms.select(F.col("case_id").alias("case")).union(fields.select("case_id")).distinct()
    return cases.join(counted, "case", "left").select("case", F.coalesce("keywords_used", F.lit(0)).cast("long").alias("keywords_used"))


PLAN_SCHEMA = "analysis string, search_groups array<struct<label: string, required_terms: array<string>, bonus_terms: array<string>, weight: double, repertory_section: string>>, suggested_remedies array<string>, reasoning string"
DEFAULT_WEIGHT, BONUS, SUGGESTED = 2.0, 0.3, 8.0


def parsed_plans(plans: DataFrame, text: str = "plan") -> DataFrame:
    """Plan rows of JSON plans (fenced or not): ``case, seq, label, required, bonus, weight`` and, apart, suggestions.

    A plan that is no JSON object has no rows.  A missing weight is the default.
    """
    from quillspark.functions.text import fence_stripped

    return plans.select(F.col("case"), F.from_json(fence_stripped(F.col(text)), PLAN_SCHEMA).alias("p")).where("p is not null")


def _clean_terms(c: Column) -> Column:
    """Terms of three or more characters in lower case, as given otherwise."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower), lambda t: F.length(t) >= 3)


def _groups(plans: DataFrame) -> DataFrame:
    p = parsed_plans(plans).select("case", F.posexplode("p.search_groups").alias("seq", "g"))
    weight = F.coalesce("g.weight", F.lit(DEFAULT_WEIGHT)).cast(POINTS)
    return p.select("case", "seq", F.coalesce("g.label", F.lit("")).alias("label"), F.coalesce(F.size("g.required_terms"), F.lit(0)).alias("asked"), _clean_terms(F.col("g.required_terms")).alias("required"), _clean_terms(F.col("g.bonus_terms")).alias("bonus"), weight.alias("weight"))


def plan_awards(plans: DataFrame, posted: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Awards of search plans: ``case, seq, at, key, points, label``.

    A group's documents are those that all its terms (lower case, three or more
    characters) hit, for its weight; a group without such terms is left out as
    a whole.  A bonus term gives 0.3 of the weight to documents that the same
    or an earlier group has scored; a suggested name gives 8 to the first entry
    it fits.  ``posted`` as for ``ranked_forms``.
    """
    g = _groups(plans).where("size(required) > 0").withColumn("bonus_points", (F.col("weight") * F.lit(BONUS).cast("decimal(4,2)")).cast(POINTS))
    docs, awards = blocks.token_sets(posted, key), None
    for turn in blocks.turns(materialize(g, "groups")):
        found = materialize(blocks.plan_awards(turn, docs), "awards")
        awards = found if awards is None else awards.unionByName(found)
    asked = parsed_plans(plans).select("case", F.posexplode("p.suggested_remedies").alias("at", "_s")).withColumn("name", F.coalesce(F.get_json_object("_s", "$.name"), F.col("_s")))
    found = first_match(asked, names).join(asked, "name")
    suggested = found.select("case", F.lit(1_000_000).alias("seq"), "at", F.col("idx").alias("key"), F.lit(SUGGESTED).cast(POINTS).alias("points"), F.concat(F.lit("AI suggested: "), "name").alias("label"))
    return awards.unionByName(suggested)


def plan_keywords(plans: DataFrame) -> DataFrame:
    """``case, keywords_used``: the distinct labels of groups that name required terms, long enough or not."""
    labels = _groups(plans).where("asked > 0").groupBy("case").agg(F.count_distinct("label").alias("n"))
    return plans.select("case").distinct().join(labels, "case", "left").select("case", F.coalesce("n", F.lit(0)).alias("keywords_used"))


def ranked_plans(plans: DataFrame, symptoms: DataFrame, fields: DataFrame, posted: DataFrame, names: DataFrame, key: str, profile: Profile = SERVER) -> DataFrame:
    """``ranked`` results of the plans, with ``by``; cases whose plan is missing, no JSON object or scores nothing go by their form."""
    planned = materialize(ranked(plan_awards(plans, posted, names, key), profile.top).withColumn("by", F.lit("plan")), "planned")
    done = planned.select(F.col("case").alias("case_id")).distinct()
    rest = [t.join(done, "case_id", "left_anti") for t in (symptoms, fields)]
    return planned.unionByName(ranked_forms(*rest, posted, key, profile).withColumn("by", F.lit("form")))


def checked_classes(c: Column) -> Column:
    """``struct<emotion, fear, desire, aversion, system>``: flags of a checked item; an item can be emotion and fear at once."""
    low = F.lower(c)
    emotion, fear = F.lit(False), F.lit(False)
    for part in fixed.EMOTION_PARTS:
        emotion = emotion | low.contains(part)
    for start in fixed.FEAR_STARTS:
        fear = fear | c.startswith(start)
    desire = c.isin(fixed.FOOD_DESIRES)
    aversion = c.isin(fixed.FOOD_AVERSIONS) & ~desire
    return F.struct(emotion.alias("emotion"), fear.alias("fear"), desire.alias("desire"), aversion.alias("aversion"), (~(emotion | fear | desire | aversion)).alias("system"))


def first_class(c: Column) -> Column:
    """The browser's class of a checked item, the first that fits: emotion, desire or system."""
    low, emotion = F.lower(c), F.lit(False)
    for part in fixed.EMOTION_PARTS:
        emotion = emotion | low.contains(part)
    return F.when(emotion, "emotion").when(c.isin(fixed.FOOD_DESIRES), "desire").otherwise("system")


#: Labels of the fields of a case summary, in order.
SUMMARY_LABELS = (
    ("thermal", "Temperature"),
    ("thirst", "Thirst"),
    ("build", "Body Build"),
    ("appetite", "Appetite"),
    ("ailments_from", "Ailments From / Causation"),
    ("emotion", "Emotional State"),
    ("fear", "Fears"),
    ("desire", "Food Desires"),
    ("aversion", "Food Aversions"),
    ("system", "Systems Review"),
    ("sleep_position", "Sleep Position"),
    ("sleep_quality", "Sleep Quality"),
    ("sweat_pattern", "Perspiration"),
    ("sweat_location", "Perspiration Location"),
    ("past_medical", "Past Medical History"),
    ("family_history", "Family History"),
    ("medications", "Current Medications"),
    ("additional", "Additional Notes"),
)


def case_summaries(symptoms: DataFrame, fields: DataFrame, case: str = "case_id") -> DataFrame:
    """``case, summary``: the labelled lines of a case, symptoms first, checked items by their classes; repeated deliveries count once.

    Empty values have no line; of a field that holds one value the first row
    counts; texts of blanks alone are left out of free fields only.
    """
    some = lambda c: c.isNotNull() & (c != "")
    line = lambda label, c, ok=None: F.when(some(c) if ok is None else ok, F.concat(F.lit(f"  {label}: "), c))
    listed = lambda c: F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), some), ", ")
    s = symptoms.dropDuplicates([case, "n"])
    parts = [line("Description", F.col("sx_desc")), line("Location", F.col("sx_location")), line("Sensation", F.col("sx_sensation")), line("Side", F.col("sx_side"), some(F.col("sx_side")) & (F.col("sx_side") != "N/A")), line("Better from", listed(F.col("sx_better"))), line("Worse from", listed(F.col("sx_worse")))]
    first = s.select(F.col(case).alias("case"), F.lit(0).alias("a"), F.col("n").alias("b"), F.concat_ws("\n", F.concat(F.lit("SYMPTOM "), (F.col("n") + 1).cast("string"), F.lit(":")), *parts).alias("line"))
    f = fields.dropDuplicates([case, "field", "seq"]).where(some(F.col("field_value"))).select(F.col(case).alias("case"), "field", "seq", F.col("field_value").alias("value"))
    c = checked_classes(F.col("value"))
    classes = F.filter(F.array(*[F.when(c[k], F.lit(k)) for k in ("emotion", "fear", "desire", "aversion", "system")]), lambda x: x.isNotNull())
    checked = f.where("field = '_checked'").select("case", F.explode(classes).alias("field"), "seq", "value").groupBy("case", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), ", ").alias("value"))
    lone = f.where("field <> '_checked'").groupBy("case", "field").agg(F.min_by("value", "seq").alias("value")).where(~F.col("field").isin(*FREE) | (F.regexp_replace("value", r"(?U)\s", "") != ""))
    names = F.array(*[F.lit(k) for k, _ in SUMMARY_LABELS])
    label = F.try_element_at(F.create_map(*[F.lit(x) for pair in SUMMARY_LABELS for x in pair]), "field")
    second = lone.unionByName(checked).select("case", F.lit(1).alias("a"), F.array_position(names, F.col("field")).cast("int").alias("b"), F.concat(label, F.lit(": "), "value").alias("line")).where("line is not null")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "line"))), lambda x: x["line"])
    return first.union(second).groupBy("case").agg(F.array_join(lines, "\n").alias("summary"))

"""Section labels to fields, routes of headings, and lists of pages that hold no record.

They must hold exactly these values for the same results; each is plain text,
``key: value`` a line, or a route ``part, part: field, length`` a line.
"""

from __future__ import annotations

from quillspark.functions.fixed_values import _pairs

#: Labels of the anchored encyclopedia.
ANCHORS = _pairs("""
mind: mentals
head: head
scalp: head
eyes: eyes
ears: ears
nose: nose
face: face
mouth: mouth
teeth: teeth
tongue: mouth
throat: throat
stomach: stomach
abdomen: abdomen
stool: rectum
rectum: rectum
anus: rectum
urinary: urinary
kidneys: urinary
bladder: urinary
urethra: urinary
urine: urinary
genitalia: genitalia
male: male
female: female
pregnancy: female
respiratory: respiratory
larynx: respiratory
trachea: respiratory
voice: respiratory
cough: cough
expectoration: cough
chest: chest
lungs: chest
heart: heart
pulse: heart
back: back
neck: back
extremities: extremities
supextrem: upper_extremities
infextrem: lower_extremities
limbs: extremities
arms: upper_extremities
legs: lower_extremities
generalities: generalities
skin: skin
sleep: sleep
fever: fever
supplement: generalities
modalities: modalities
""")

#: Labels of the pocket manual.
LABELS = _pairs("""
mind: mental_emotional
head: head
eyes: eyes
ears: ears
nose: nose
face: face
mouth: mouth_throat
throat: mouth_throat
teeth: mouth_throat
tongue: mouth_throat
stomach: stomach_abdomen
abdomen: stomach_abdomen
rectum: stool_rectum
stool: stool_rectum
urine: urinary
urinary: urinary
kidneys: urinary
bladder: urinary
male: male
female: female
respiratory: respiratory
larynx: respiratory
cough: respiratory
chest: chest_heart
heart: chest_heart
back: back
neck: back
extremities: extremities
limbs: extremities
sleep: sleep
skin: skin
fever: fever_chill
chill: fever_chill
generalities: generalities
""")

#: Labels of the numbered dictionary.
NUMBERED = _pairs("""
mind: mental_emotional
head: head
eyes: eyes
ears: ears
nose: nose
face: face
teeth: mouth_throat
mouth: mouth_throat
throat: mouth_throat
appetite: stomach_abdomen
stomach: stomach_abdomen
abdomen: stomach_abdomen
stool and anus: stool_rectum
stool: stool_rectum
anus: stool_rectum
urinary organs: urinary
urinary: urinary
male sexual organs: male
male: male
female sexual organs: female
female: female
pregnancy: female
pregnancy, parturition, lactation: female
voice and larynx, trachea and bronchia: respiratory
voice: respiratory
larynx: respiratory
respiration: respiratory
cough: respiratory
inner chest and lungs: chest_heart
lungs: chest_heart
chest: chest_heart
heart, pulse and circulation: chest_heart
heart: chest_heart
outer chest: chest_heart
neck and back: back
back: back
neck: back
upper limb: extremities
lower limb: extremities
limbs in general: extremities
extremities: extremities
nerves: generalities
sleep and dreams: sleep
sleep: sleep
time: modalities
temperature and weather: modalities
fever: fever_chill
locality and direction: generalities
sensations: generalities
tissues: generalities
touch, passive motion, injuries: generalities
touch: generalities
skin: skin
stages of life and constitution: generalities
stages of life: generalities
""")

#: Fields of the numbered chapters, as ranges of numbers.
CHAPTERS = _pairs("""
1-2: mental_emotional
3-4: head
5-5: eyes
6-6: ears
7-7: nose
8-9: face
10-13: mouth_throat
14-19: stomach_abdomen
20-20: stool_rectum
21-21: urinary
22-22: male
23-24: female
25-27: respiratory
28-30: chest_heart
31-31: back
32-34: extremities
35-35: modalities
36-36: generalities
37-37: sleep
38-39: modalities
40-40: fever_chill
41-45: generalities
46-46: skin
47-47: generalities
48-48: relationships
""")

#: Headings of the fact sheets; a sheet without one of the first two is no record.
FACTS = _pairs("""
Background: summary
What Have We Learned?: findings
How Much Do We Know?: research_extent
What Do We Know About Safety?: safety
Bottom Line: bottom_line
What Have Studies Shown?: findings
""")


def _routes(text: str) -> list[tuple[tuple[str, ...], str, int]]:
    """``parts, field, length``: the first line of which the heading holds a part decides; no parts is the rest."""
    found = []
    for line in text.strip().splitlines():
        parts, target = line.split(": ", 1)
        field, length = target.rsplit(", ", 1)
        found.append((tuple(p for p in parts.split(", ") if p != "*"), field, int(length)))
    return found


#: Routes of the herbal's ruled headings.
HERBAL_ROUTES = _routes("""
habitat: habitat, 3000
description: keynotes, 6000
medicinal, uses, action: indications, 8000
dosage, dose: dosing, 4000
constituents, chemical: constituents, 4000
cultivation, preparation, part used: preparation, 4000
caution, danger, poison: documented_adverse_effects, 4000
*: generalities, 4000
""")
#: Routes of the lactation pages; a summary is also a finding on lactation.
LACTATION_ROUTES = _routes("""
summary, use during lactation: lactation_safety, 8000
drug level, effects in breastfed, effect: lactation_safety, 8000
adverse, safety, risk: documented_adverse_effects, 8000
*: studies, 6000
""")
LACTATION_SUMMARY = (("summary", "use during lactation"), 6000)
#: Routes of the liver pages.
LIVER_ROUTES = _routes("""
hepatotoxicity, liver, injury: hepatotoxicity, 8000
mechanism: hepatotoxicity, 6000
case: case_reports, 8000
*: documented_adverse_effects, 6000
""")
LIVER_SUMMARY = (("overview", "introduction", "background"), 6000)
#: Routes of the supplement pages, and headings that are left out.
SUPPLEMENT_ROUTES = _routes("""
health risk, adverse, toxicity: documented_adverse_effects, 8000
interaction: documented_interactions, 8000
recommended intake, intake, sources of: dosing, 6000
*: studies, 8000
""")
SUPPLEMENT_SKIPPED = ["introduction", "table of contents", "disclaimer", "references"]

#: Titles that name plants, and those that name no plant.
BOTANICALS = "ashwagandha, black cohosh, echinacea, garlic, ephedra, saw palmetto, valerian, ginger, turmeric, ginseng, ginkgo, milk thistle, feverfew, kava, st johns wort, ginkgo biloba, wormwood, yohimbe".split(", ")
VITAMINS = "vitamin, iron, zinc, iodine, selenium".split(", ")

#: Names, beginnings and parts of names of pages that hold no record.
NAVIGATION = "index, intro, preface, acknowl, solvents, index-other, tidbits, abbrev, pics, copyright".split(", ")
NAVIGATION_STARTS = ["illustration-"]
NAVIGATION_PARTS = """
WeightLoss, ExerciseAndAthletic, WYNTK, Background, DietarySupplements, DietarySupplementsForOlder, MyDS, RecommendedIntakes,
FrequencyandReferences, MVMS, Cancer-, BotanicalBackground, List-All, ImmuneFunction, Memory, Bone, DSLD, BMD, ClinicalTrial,
DietarySupplementsInTheTimeOfCOVID19, COVID19
""".strip().replace("\n", " ").split(", ")

#: How findings are worded, strongest cue first.
EVIDENCE_CUES = [
    ("no_evidence", r"\bno (good|reliable|conclusive|convincing) evidence\b"),
    ("no_evidence", r"hasn'?t been (shown|found) to (work|help|be effective)"),
    ("no_evidence", r"isn'?t effective"),
    ("insufficient_data", r"\binsufficient evidence\b|\btoo few studies\b|\bnot enough (research|studies)\b"),
    ("weak_support", r"\bmay (help|reduce|improve|be helpful)\b|some studies suggest|preliminary evidence"),
    ("moderate_support", r"effective for|moderate evidence|consistently show"),
    ("strong_support", r"strong evidence|well established|proven"),
]

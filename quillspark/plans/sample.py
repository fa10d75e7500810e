"""Inputs of the registered queries that no table holds."""

from __future__ import annotations

#: A search plan as an external planner would hand it in.
PLAN = """```json
{"analysis": "", "search_groups": [
 {"label": "throbbing head", "required_terms": ["throbbing", "temple"], "bonus_terms": ["night", "wine"], "weight": 3.0},
 {"label": "tremor", "required_terms": ["tremble"], "bonus_terms": ["fever", "of"], "weight": 1.5},
 {"label": "nothing", "required_terms": [], "bonus_terms": ["sleep"]},
 {"label": "too short", "required_terms": ["of"], "bonus_terms": ["sleep"]}],
 "suggested_remedies": ["Casnortorora", {"name": "Drowelgymopsis hexpedina", "reason": ""}], "reasoning": ""}
```"""
#: Findings as fact sheets word them; each cue, and none.
FINDINGS = ["There is no good evidence.", "It hasn't been shown to work.", "It isn't effective.", "There are too few studies.", "It may help.", "Some studies suggest so.", "It is effective for colds.", "There is strong evidence.", "It is proven; there is insufficient evidence.", "Nothing is said."]
#: Headings that reach every route.
HEADINGS = ["Synonyms", "Habitat", "Description", "Medicinal Action and Uses", "Dosage", "Constituents", "Part Used", "Poison", "Other", "Summary of Use during Lactation", "Drug Levels", "Effects in Breastfed Infants", "Safety", "Introduction", "Hepatotoxicity", "Mechanism of Injury", "Case 1", "Mechanism", "Health Risks", "Interactions with Drugs", "Recommended Intakes", "References"]

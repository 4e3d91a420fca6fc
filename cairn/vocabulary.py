"""Closed vocabularies, as small tables."""

from __future__ import annotations

# Object types with directory, catalogue section, whether a model may assign them, default volatility.
OBJECT_TYPES = (
    ("Concept", "concepts", "Concepts", True, "slow"),
    ("Entity", "entities", "Entities", True, "slow"),
    ("Place", "places", "Places", True, "static"),
    ("Event", "events", "Events", True, "static"),
    ("Procedure", "procedures", "Procedures", True, "volatile"),
    ("Decision", "decisions", "Decisions", True, "static"),
    ("Project", "projects", "Projects", True, "volatile"),
    ("Person", "people", "People", True, "slow"),
    ("Organization", "organizations", "Organizations", True, "slow"),
    ("Insight", "insights", "Insights", False, "volatile"),
    ("Source", "sources", "Sources", False, "static"),
)
# Seeded relation types, those only the engine writes, and those whose direction matters.
RELATION_TYPES = ("references", "depends_on", "derived_from", "related_to", "caused_by", "part_of", "member_of", "produced_by")
ENGINE_RELATIONS = ("derived_from",)
DIRECTED_RELATIONS = ("caused_by", "depends_on", "member_of", "part_of", "produced_by")
# Function words that carry no subject.
SPANISH = (
    "al como con cuando de del desde donde el ella ellos entre es esa ese esta este hacia hasta la las les lo los más muy para "
    "pero por porque que qué se según sobre son su sus también todo un una unas unos y"
).split()
ENGLISH = (
    "about after an and are as at be because been before between but by can could during for from had has have how into is it its "
    "not of off on or our out over that the their these this those to under was were when where which while will with would"
).split()
# Words that end a title's head phrase.
CONNECTIVES = "in of for on with to from vs versus and en de del para con sobre y".split()
SENSITIVITIES = ("public", "private", "confidential")
TIERS = {"static": None, "slow": 90, "volatile": 7}


def suggestable() -> list[str]:
    return [r for r in RELATION_TYPES if r not in ENGINE_RELATIONS]

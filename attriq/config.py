"""Thresholds and tables that define the decisions."""

from __future__ import annotations

from dataclasses import dataclass

NIL, ERROR = "none", "error"


@dataclass(frozen=True)
class Recall:
    title: float = 0.55


@dataclass(frozen=True)
class Subtype:
    """Cuts of the position-and-evidence classes: first matching coauthor (P1) or none at all (P0)."""

    org_verified: float = 0.7
    p1_strong_title: float = 0.9
    p1_strong_coauthors: int = 3
    p1_high_title: float = 0.85
    p1_high_coauthors: int = 2
    p1_medium_title: float = 0.75
    p0_high_title: float = 0.85
    p0_high_org: float = 0.80
    p0_high_venue: float = 0.85
    p0_medium_title: float = 0.75
    p0_medium_top5: float = 0.70


@dataclass(frozen=True)
class RuleFirst:
    none_org: float = 0.85
    none_title: float = 0.65
    none_venue: float = 0.70
    none_strong_org: float = 0.95
    auto_coauthors: int = 2
    auto_matches: int = 1
    auto_org: float = 0.95
    auto_org_title: float = 0.70
    auto_match_title: float = 0.90
    auto_mixed_title: float = 0.85
    auto_mixed_venue: float = 0.85


@dataclass(frozen=True)
class Sampling:
    many_base: int = 1000
    one_base: int = 500
    title: int = 100
    venue: int = 10
    org: int = 10
    year: int = 5


@dataclass(frozen=True)
class Gate:
    withdraw: float = 0.14
    fill: float = 0.20


# Subtype -> strategy, and its default.
STRATEGIES = {
    "NONE": "none",
    "AUTO": "auto",
    "LLM-Co": "simplified",
    "LLM-NoCo": "p0_high",
    "P1-Strong": "auto",
    "P1-High": "p1_high",
    "P1-Medium": "p1_medium",
    "P1-Strong-Comp": "p1_comp",
    "P1-High-Comp": "p1_comp",
    "P1-Medium-Comp": "p1_comp",
    "P1-Weak": "p1_weak",
    "P1-Weak-Comp": "p1_weak",
    "P2": "p2_p3",
    "P2-Comp": "p2_p3",
    "P3": "p2_p3",
    "P3-Comp": "p2_p3",
    "P0-High": "p0_high",
    "P0-Medium": "p0_medium",
    "P0-Low": "p0_low",
}
DEFAULT_STRATEGY = "simplified"

# Strategy -> type of its system prompt, and the type of others.
PROMPT_TYPES = {
    "simplified": "simplified",
    "p0_high": "llm_noco",
    "p0_medium": "p0_medium",
    "p0_low": "p0_low",
    "p2_p3": "p2_p3",
    "p1_weak": "p1_weak",
    "p1_comp": "p1_comp",
    "p1_high": "p1_high",
    "p1_medium": "p1_medium",
}
DEFAULT_PROMPT = "standard"

# Subtype of the first chain, or of an older one -> class of the rule-first chain, else LLM-Co.
RULE_FIRST_OF = {
    "NONE": "NONE",
    "P1-Strong": "AUTO",
    "A1-Strong": "AUTO",
    "P0-High": "LLM-NoCo",
    "P0-Medium": "LLM-NoCo",
    "P0-Low": "LLM-NoCo",
    "C0-Org-Strong": "LLM-NoCo",
    "C0-Org-Medium": "LLM-NoCo",
    "C0-NoOrg": "LLM-NoCo",
    "C1-DefaultNone": "LLM-NoCo",
}

# Subtypes whose records go to the judgement by coauthors.
CO_SUBTYPES = ["LLM-Co", "P1-High", "P1-Strong-Comp", "P1-High-Comp", "P1-Medium", "P1-Medium-Comp", "P1-Weak", "P1-Weak-Comp", "P2", "P2-Comp", "P3"]

# Fallback inverse document frequencies by field.
IDF_DEFAULT = {"org": 14.37, "venue": 10.42, "title": 4.0, "keyword": 1.0}
NAME_RARITY_DEFAULT = 10.0
EPSILON = 1e-8

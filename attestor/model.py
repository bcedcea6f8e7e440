"""The scoring model's constants, with per-entity overrides."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

# They must equal the published model's for equal scores.
GROUPS: dict[str, dict[str, Any]] = {
    "entity_confidence": {"accept": 0.7, "review": 0.4},
    "proximity": {"token_decay": 50.0, "blend": 0.5},
    "boundary": {"same_clause": 1.0, "same_sentence": 0.9, "adjacent_sentence": 0.7, "same_paragraph": 0.5, "different_paragraph": 0.2},
    "identity_boundary": {"same_clause": 1.0, "same_sentence": 0.95, "adjacent_sentence": 0.8, "same_paragraph": 0.6, "different_paragraph": 0.35},
    "independence": {"first": 1.0, "additional": 0.35, "syndicated": 0.2, "near_same_domain": 0.05, "exact": 0.0},
    "duplicates": {"exact": 3, "near": 12, "title": 0.9, "minhash": 0.6},
    "reliability_weights": {"domain_rank": 0.4, "url_rank": 0.2, "prominence": 0.2, "classification": 0.2},
    "classification": {"major": 1.0, "specialist": 0.8, "ordinary": 0.6, "blog": 0.35, "unknown": 0.2, "spam": 0.0},
    "recency": {"half_life_days": 365.0, "undated": 0.35},
    "pias": {"corroboration": 0.30, "authority": 0.25, "recency": 0.20, "relationship": 0.15, "corpus_share": 0.10},
    "bands": {"dominant": 75.0, "strong": 50.0, "present": 25.0},
    "momentum": {"period_days": 90, "rapid_up": 1.0, "up": 0.2, "down": -0.2, "rapid_down": -0.5, "min_documents": 5},
}
SPAM_CUTOFF = 60
MENTION_CAP = (1.0, 0.2, 0.1)
RANK_WEIGHTS = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)
CURRENT_WINDOW_DAYS = 365
HALF_LIVES = (180, 365, 730)
MARKER_WEIGHTS = {"organization": 1.0, "url": 1.0, "registration": 1.0, "person": 0.8, "education": 0.7, "occupation": 0.5, "location": 0.45, "other": 0.4}


@dataclass(frozen=True)
class Model:
    """The constants by group; model["pias"]["recency"] reads one."""

    groups: Mapping[str, Mapping[str, Any]] = field(default_factory=lambda: GROUPS)
    current_window_days: int = CURRENT_WINDOW_DAYS
    log_corroboration: bool = True

    def __getitem__(self, group: str) -> Mapping[str, Any]:
        return self.groups[group]

    def override(self, groups: Mapping[str, Mapping[str, Any]] | None = None, **values: Any) -> Model:
        """A model in which the given values of the given groups replace the defaults."""
        merged = {k: {**v, **(groups or {}).get(k, {})} for k, v in self.groups.items()}
        return replace(self, groups=merged, **values)


DEFAULT = Model()

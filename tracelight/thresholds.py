"""Every number an operator depends on, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, field

# Evidence levels with their rank, strongest first.
LEVEL_RANK = {"VERIFIED": 4, "STRONG": 3, "PROBABLE": 2, "POSSIBLE": 1, "UNKNOWN": 0}
LEVELS = list(LEVEL_RANK)


@dataclass(frozen=True)
class Thresholds:
    ai_high: float = 0.85
    ai_medium: float = 0.6
    percept_near: int = 10
    text_near: float = 0.5
    language_probable: float = 0.9
    families_for_strong: int = 2
    conf_verified: float = 1.0
    conf_strong: float = 0.8
    conf_probable: float = 0.65
    conf_possible: float = 0.4
    conflict_penalty: float = 0.25
    time_tolerance_s: int = 60
    # rule id -> level; applied after the rules, never above the rule's ceiling
    overrides: dict[str, str] = field(default_factory=dict)

    def confidence(self, level: str) -> float | None:
        return {
            "VERIFIED": self.conf_verified,
            "STRONG": self.conf_strong,
            "PROBABLE": self.conf_probable,
            "POSSIBLE": self.conf_possible,
        }.get(level)

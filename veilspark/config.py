"""Options of a detection run, fixed when the plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field

LEVELS = ("minimal", "standard", "aggressive")


@dataclass(frozen=True)
class CustomRule:
    """A user's rule, which holds at every level. If the regex has a group, its first one is the span: a group at the top of
    the regex may stand anywhere in the match, one that is nested or among alternatives must end it."""

    name: str
    regex: str
    type: str | None = None


@dataclass(frozen=True)
class Config:
    level: str = "standard"
    custom_rules: tuple[CustomRule, ...] = ()
    known_names: tuple[str, ...] = ()
    domain_parsers: bool = True
    name_scorer: bool = False
    context: bool = True
    checksums: bool = True
    allowlist: bool = True
    custom_allowed: tuple[str, ...] = ()
    second_pass: bool = True
    min_confidence: float = 0.0
    placeholder: str = "[{type}_{id}]"
    legacy_hetu: bool = False
    suspicious_below: float = 0.5
    min_uncovered: int = 5
    skip_coverage: float = 0.8
    skip_confidence: float = 0.85
    safe_rules: tuple[tuple[str, str, float], ...] = field(default=())
    keep_originals: bool = False

    def __post_init__(self) -> None:
        if self.level not in LEVELS:
            raise ValueError(f"level must be one of {LEVELS}, not {self.level!r}")
        if "{type}" not in self.placeholder or "{id}" not in self.placeholder:
            raise ValueError("a placeholder needs {type} and {id}")

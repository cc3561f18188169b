"""Parameters of the engine with their defaults, read from YAML and checked."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from datetime import date
from typing import Any


def names(value: Any, where: str, allow_empty: bool = True) -> tuple[str, ...]:
    """A list of texts without blanks at their ends. A bare text, numbers, null and the booleans that YAML makes of ON and NO are
    errors, as is an empty list where one is needed."""
    if isinstance(value, str) or not isinstance(value, (list, tuple)):
        raise ValueError(f"{where} must be a list of texts, not {type(value).__name__}")
    bad = [x for x in value if not isinstance(x, str)]
    if bad:
        raise ValueError(f"{where} holds {bad}: quote words that YAML reads as something else")
    out = tuple(x.strip() for x in value if x.strip())
    if not out and not allow_empty:
        raise ValueError(f"{where} is empty")
    return out


@dataclass(frozen=True)
class Sample:
    first: date = date(2005, 1, 1)
    last: date = date(2025, 12, 31)
    prices_from: date = date(2004, 6, 1)
    zone: str = "US/Eastern"
    seed: int = 42


@dataclass(frozen=True)
class Quality:
    min_chars_call: int = 500
    min_chars_utterance: int = 20
    min_utterances_call: int = 5


@dataclass(frozen=True)
class Roles:
    operator: str = "Operator"
    strong: tuple[str, ...] = ("first question comes from", "our first question")
    weak: tuple[str, ...] = ("question-and-answer session",)
    veto: tuple[str, ...] = ("later, we will conduct",)
    intro: str = r"from (?:the line of )?([A-Z][\w.'-]+(?: [A-Z][\w.'-]+)+)"
    sample_calls: int = 20
    sample_chars: int = 200


@dataclass(frozen=True)
class Scoring:
    max_tokens: int = 512
    batch: int = 16


@dataclass(frozen=True)
class Features:
    peer_days: int = 90
    peer_least: int = 3
    min_managers: int = 2
    min_tokens: int = 25
    min_history: int = 250
    confounders: tuple[str, ...] = ()


@dataclass(frozen=True)
class Clock:
    opens: str = "09:30"
    closes: str = "16:00"
    call_minutes: int = 75


@dataclass(frozen=True)
class Returns:
    horizons: tuple[int, ...] = (3, 5, 10, 21, 63)


@dataclass(frozen=True)
class EventStudy:
    estimation: tuple[int, int] = (-120, -21)
    event: tuple[int, int] = (-1, 10)
    least: int = 60
    groups: int = 3
    bootstrap: int = 2000
    placebo: int = 1000
    max_shift: int = 250


@dataclass(frozen=True)
class Strategy:
    hold: int = 63
    top: float = 0.2
    direction: int = 1
    rank_days: int = 90
    history: int = 20
    cap: float = 0.1
    placebo_turns: int = 20
    adv_rows: int = 60
    adv_least: float = 5e6


@dataclass(frozen=True)
class Metrics:
    bps: float = 5.0
    periods: int = 252
    lags: int = 5


@dataclass(frozen=True)
class Validation:
    folds: int = 5
    embargo_days: int = 15
    holdout_months: int = 18
    turns: int = 1000
    blocks: int = 16
    noise_floor: float = 0.2
    min_cell: int = 50
    split_year: int = 2015


@dataclass(frozen=True)
class Config:
    sample: Sample = field(default_factory=Sample)
    quality: Quality = field(default_factory=Quality)
    roles: Roles = field(default_factory=Roles)
    scoring: Scoring = field(default_factory=Scoring)
    features: Features = field(default_factory=Features)
    clock: Clock = field(default_factory=Clock)
    returns: Returns = field(default_factory=Returns)
    event_study: EventStudy = field(default_factory=EventStudy)
    strategy: Strategy = field(default_factory=Strategy)
    metrics: Metrics = field(default_factory=Metrics)
    validation: Validation = field(default_factory=Validation)
    aliases: dict[str, str] = field(default_factory=dict)


def _value(default: Any, raw: Any, where: str) -> Any:
    if isinstance(default, tuple) and default and isinstance(default[0], int):
        if not isinstance(raw, (list, tuple)) or not all(type(x) is int for x in raw):
            raise ValueError(f"{where} must be a list of whole numbers")
        return tuple(raw)
    if isinstance(default, tuple):
        return names(raw, where, allow_empty=where != "roles.strong")
    if isinstance(default, date):
        return raw if isinstance(raw, date) else date.fromisoformat(str(raw))
    if isinstance(default, bool) != isinstance(raw, bool) or not isinstance(raw, (type(default), int) if isinstance(default, float) else type(default)):
        raise ValueError(f"{where} must be of type {type(default).__name__}, not {raw!r}")
    return type(default)(raw)


def build(raw: dict[str, Any] | None) -> Config:
    """A configuration from nested values over the defaults. Unknown names, wrong types and values out of bounds are errors."""
    base, parts = Config(), {}
    for name, values in (raw or {}).items():
        if not hasattr(base, name):
            raise ValueError(f"unknown section {name}")
        if name == "aliases":
            bad = [k for k, v in (values or {}).items() if not isinstance(k, str) or not isinstance(v, str)]
            if bad:
                raise ValueError(f"aliases holds {bad}")
            parts[name] = dict(values or {})
            continue
        section = getattr(base, name)
        known = {f.name for f in dataclasses.fields(section)}
        if set(values or {}) - known:
            raise ValueError(f"unknown names in {name}: {sorted(set(values) - known)}")
        parts[name] = dataclasses.replace(section, **{k: _value(getattr(section, k), v, f"{name}.{k}") for k, v in (values or {}).items()})
    out = dataclasses.replace(base, **parts)
    checks = {
        "strategy.top must lie between 0 and 0.5": 0 < out.strategy.top < 0.5,
        "strategy.direction must be 1 or -1": out.strategy.direction in (1, -1),
        "event_study windows must run from first to last": all(len(w) == 2 and w[0] <= w[1] for w in (out.event_study.estimation, out.event_study.event)),
        "returns.horizons must be positive": bool(out.returns.horizons) and min(out.returns.horizons) > 0,
        "sample must run from first to last": out.sample.first <= out.sample.last,
    }
    for message, good in checks.items():
        if not good:
            raise ValueError(message)
    return out


def load(path: str) -> Config:
    """build() of a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return build(yaml.safe_load(f))

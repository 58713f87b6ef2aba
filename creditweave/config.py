"""Settings of matching, scoring and evaluation, checked strictly when they are made."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

SCORERS = ("wratio", "ratio", "token_sort_ratio", "token_set_ratio", "levenshtein")


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Weights:
    reference_match: float = 0.34
    amount_match: float = 0.26
    customer_identity: float = 0.18
    remittance_agreement: float = 0.14
    date_proximity: float = 0.08

    def __post_init__(self) -> None:
        values = dataclasses.astuple(self)
        _require(all(w >= 0 for w in values), "a weight is below 0")
        _require(abs(sum(values) - 1.0) <= 1e-6, "the weights must sum to 1")

    def without(self, name: str) -> Weights:
        """One weight at zero, the others scaled up to keep the sum."""
        kept = 1.0 - getattr(self, name)
        return Weights(**{k: 0.0 if k == name else v / kept for k, v in dataclasses.asdict(self).items()})


@dataclass(frozen=True)
class Scoring:
    weights: Weights = field(default_factory=Weights)
    auto_apply: float = 0.90
    review_floor: float = 0.45
    ambiguous: float = 0.55
    unreconciled_advice: float = 0.92
    residual_cash: float = 0.85
    guessed_claim_bearer: float = 0.60
    ideal_days: int = 35
    zero_days: int = 200

    def __post_init__(self) -> None:
        _require(0 <= self.review_floor < self.auto_apply <= 1, "review_floor must be below auto_apply, both in 0..1")
        for k in ("ambiguous", "unreconciled_advice", "residual_cash", "guessed_claim_bearer"):
            _require(0 <= getattr(self, k) <= 1, f"{k} must be in 0..1")
        _require(0 <= self.ideal_days < self.zero_days, "ideal_days must be below zero_days")


@dataclass(frozen=True)
class Identification:
    fuzzy_min_score: float = 86.0
    fuzzy_margin: float = 5.0
    fuzzy_scorer: str = "wratio"

    def __post_init__(self) -> None:
        _require(self.fuzzy_scorer in SCORERS, f"fuzzy_scorer must be one of {', '.join(SCORERS)}")
        _require(0 <= self.fuzzy_min_score <= 100 and 0 <= self.fuzzy_margin <= 100, "scores must be in 0..100")


@dataclass(frozen=True)
class Reference:
    enabled: bool = True
    min_digits: int = 2
    max_digits: int = 8
    allow_bare_numeric: bool = True

    def __post_init__(self) -> None:
        _require(1 <= self.min_digits <= self.max_digits, "min_digits must not exceed max_digits")


@dataclass(frozen=True)
class Search:
    """Bounds of a search for sets of invoices; budget counts visited nodes."""

    enabled: bool = True
    min_size: int = 2
    max_size: int = 5
    max_solutions: int = 5
    budget: int = 400_000

    def __post_init__(self) -> None:
        _require(1 <= self.min_size <= self.max_size, "min_size must not exceed max_size")
        _require(self.max_solutions > 0 and self.budget > 0, "max_solutions and budget must be above 0")


@dataclass(frozen=True)
class ShortPay:
    search: Search = field(default_factory=lambda: Search(True, 1, 3, 3, 200_000))
    min_deduction_pct: float = 0.5
    max_deduction_pct: float = 15.0
    max_deduction_paise: int = 15_000_000

    def __post_init__(self) -> None:
        _require(0 <= self.min_deduction_pct < self.max_deduction_pct < 100, "min_deduction_pct must be below max_deduction_pct")


@dataclass(frozen=True)
class Matching:
    scoring: Scoring = field(default_factory=Scoring)
    identification: Identification = field(default_factory=Identification)
    reference: Reference = field(default_factory=Reference)
    subset_sum: Search = field(default_factory=Search)
    short_pay: ShortPay = field(default_factory=ShortPay)
    remittance_enabled: bool = True
    require_reconciled: bool = False
    tolerance_paise: int = 100
    days_before_payment: int = 210
    days_after_payment: int = 20
    max_pool: int = 45

    def __post_init__(self) -> None:
        _require(self.tolerance_paise >= 0, "tolerance_paise is below 0")
        _require(self.max_pool > 0, "max_pool must be above 0")


def load(kind: type, values: dict[str, Any]) -> Any:
    """A settings object from nested plain values; an unknown key is an error."""
    known = {f.name: f for f in dataclasses.fields(kind)}
    if extra := sorted(set(values) - set(known)):
        raise ValueError(f"unknown settings of {kind.__name__}: {', '.join(extra)}")
    nested = {"scoring": Scoring, "weights": Weights, "identification": Identification, "reference": Reference, "subset_sum": Search, "short_pay": ShortPay, "search": Search}
    return kind(**{k: load(nested[k], v) if k in nested and isinstance(v, dict) else v for k, v in values.items()})


def load_file(kind: type, path: str | Path) -> Any:
    """Settings from a JSON file on the driver; an unreadable file, no object and unknown keys are errors."""
    values = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(values, dict):
        raise ValueError(f"{path} must hold an object")
    return load(kind, values)


def digest(settings: Any) -> str:
    """A short fingerprint of settings, whatever the order of their keys."""
    canonical = json.dumps(dataclasses.asdict(settings), sort_keys=True)
    return "sha256:" + hashlib.sha256(canonical.encode()).hexdigest()[:16]


DEFAULT = Matching()

"""What is known about a table beyond its schema."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml


@dataclass(frozen=True)
class Profile:
    """Column roles and rules of one table.

    ``missing_codes`` are numbers that stand for a missing answer; ``missing_of`` overrides them for single
    columns. ``categorical`` columns are levels whatever their type; they aren't recoded.
    """

    name: str = "table"
    missing_codes: tuple[float, ...] = ()
    missing_of: dict[str, tuple[float, ...]] = field(default_factory=dict)
    categorical: frozenset[str] = frozenset()
    weights: frozenset[str] = frozenset()
    ids: frozenset[str] = frozenset()
    texts: frozenset[str] = frozenset()
    control_only: frozenset[str] = frozenset()
    dropped: frozenset[str] = frozenset()
    not_grouping: frozenset[str] = frozenset()
    derived_pairs: frozenset[frozenset[str]] = frozenset()
    labels: dict[str, str] = field(default_factory=dict)
    modules: dict[str, str] = field(default_factory=dict)
    binary: dict[str, bool] = field(default_factory=dict)
    high_means: dict[str, str] = field(default_factory=dict)

    def codes(self, column: str) -> tuple[float, ...]:
        return self.missing_of.get(column, self.missing_codes)

    def role(self, column: str) -> str:
        for role in ("weights", "ids", "texts", "control_only", "dropped"):
            if column in getattr(self, role):
                return role
        return "measure"

    @classmethod
    def from_yaml(cls, text: str) -> Profile:
        raw = yaml.safe_load(text) or {}
        kinds = {"missing_codes": tuple, "categorical": frozenset, "weights": frozenset, "ids": frozenset, "texts": frozenset, "control_only": frozenset, "dropped": frozenset, "not_grouping": frozenset}
        args = {k: kinds[k](v) if k in kinds else v for k, v in raw.items() if k in cls.__dataclass_fields__}
        if "derived_pairs" in args:
            args["derived_pairs"] = frozenset(frozenset(p) for p in args["derived_pairs"])
        if "missing_of" in args:
            args["missing_of"] = {c: tuple(v) for c, v in args["missing_of"].items()}
        return cls(**args)

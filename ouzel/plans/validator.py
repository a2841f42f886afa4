"""Rules that a proposed query must meet before it is run."""

from __future__ import annotations

import re

from .grammar import FAMILIES, GrammarError, Resolver, is_query
from .planner import Engine

MAX_GROUPING_LEVELS, MAX_LEVELS = 100, 80


def _battery(c: str) -> int | None:
    m = re.fullmatch(r"q(\d+)\w*", c.lower())
    return int(m[1]) if m else None


def validate(engine: Engine, text: str, least_columns: int = 2, battery_gap: int = 3, places: frozenset[str] = frozenset(), demographics: frozenset[str] = frozenset()) -> list[str]:
    """Reason codes of what is wrong with a query; none if it may run.

    ``places`` are columns that name where a row is from: a bare comparison by one says nothing unless a
    control that is no demographic is given.
    """
    if not (text or "").strip():
        return ["EMPTY_SENTENCE"]
    if ":" in text or not is_query(text):
        return ["INVALID_DSL_FORMAT"]
    p, found = engine.profile, Resolver(engine.df.columns)
    if re.search(r"weights?\s*=\s*(?:$|[,)])", text):
        return ["INVALID_WEIGHT_SLOT"]
    if (m := re.search(r"weights?\s*=\s*\[?([\w.]+)", text)) and (w := found.find(m[1])) not in p.weights:
        return ["INVALID_WEIGHT_SLOT_COLUMN" if w is None else "INVALID_WEIGHT_ROLE"]
    family = text.strip().split("(")[0].strip().lower()
    inner = text[text.index("(") + 1 :].split(")")[0]
    if family == "assoc" and "|" in inner:
        return ["INVALID_ASSOC_COMPLEX_EXPR"]
    if family == "assoc" and len([t for t in inner.split(",") if t.strip()]) != 2:
        return ["INVALID_ASSOC_ARITY"]
    try:
        spec = engine.parse(text)
    except GrammarError as e:
        message = str(e)
        if "weight can't be a control" in message:
            return ["INVALID_WEIGHT_CONTROL"]
        if "weight or an id" in message:
            return ["INVALID_ID_ROLE"]
        return ["INVALID_ASSOC_COLUMN" if family == "assoc" else "INVALID_OUTCOME_COLUMN"]
    out: list[str] = []
    main = [c for c in (spec.x, spec.y, spec.group, spec.moderator) if c]
    if any(c in p.texts for c in spec.columns):
        out.append("TEXT_COLUMN_IN_DSL")
    if any(c in p.dropped for c in spec.columns):
        out.append("DROPPED_COLUMN")
    if any(c in p.control_only for c in main):
        out.append("CONTROL_ONLY_AS_MAIN")
    if any(c in p.weights for c in main):
        out.append("INVALID_WEIGHT_ROLE")
    if any(c in p.ids for c in spec.controls):
        out.append("INVALID_ID_CONTROL")
    if len(set(main)) < len(main):
        out.append("SELF_CORRELATION")
    if len(set(spec.columns)) < least_columns:
        out.append("TOO_FEW_SCHEMA_COLUMNS")
    if spec.group:
        n = engine.distinct(spec.group)
        if spec.group in p.not_grouping:
            out.append("GROUPING_EXCLUDED")
        elif n < 2:
            out.append("GROUPING_TOO_FEW_LEVELS")
        elif n > MAX_GROUPING_LEVELS:
            out.append("GROUPING_TOO_MANY_LEVELS")
        elif n > MAX_LEVELS:
            out.append("HIGH_CARDINALITY_CATEGORICAL")
    if spec.family == "interact":
        for role, c in (("PREDICTOR", spec.x), ("MODERATOR", spec.moderator)):
            if c in p.not_grouping:
                out.append(f"INTERACT_{role}_EXCLUDED")
            elif c in p.categorical and engine.distinct(c) > MAX_LEVELS:
                out.append(f"INTERACT_{role}_TOO_MANY_LEVELS")
    if spec.family == "assoc":
        a, b = _battery(spec.x), _battery(spec.y)
        if a is not None and b is not None and abs(a - b) <= battery_gap and p.modules.get(spec.x) == p.modules.get(spec.y):
            out.append("SAME_BATTERY_ASSOC")
        if {spec.x, spec.y} & places:
            out.append("INVALID_ASSOC_WITH_COUNTRY_ID")
    if spec.group in places and not [c for c in spec.controls if c not in demographics]:
        out.append("BARE_COUNTRY_DIFF" if spec.family == "diff" else "BARE_COUNTRY_HETEROGENEITY")
    if frozenset((spec.x, spec.y)) in p.derived_pairs:
        out.append("TAUTOLOGICAL_DERIVED_PAIR")
    return out


__all__ = ["FAMILIES", "validate"]

"""Findings as sentences, and what models write as data. Small strings, on the driver or in a UDF."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import TYPE_CHECKING, Any

if TYPE_CHECKING:
    from ..plans.grammar import Spec


def number(x: float) -> str:
    return f"{x:.4g}"


def p_text(p: float) -> str:
    return "p<1e-300" if p == 0 else f"p={number(p)}"


def label(column: str, labels: Mapping[str, str]) -> str:
    return labels.get(column, column.replace("_", " "))


def with_labels(text: str, labels: Mapping[str, str]) -> str:
    """Column names in a text as labels, longest name first, whole names only."""
    if not labels:
        return text
    names = sorted(labels, key=lambda c: (-len(c), c))
    return re.sub(r"(?<!\w)(?:" + "|".join(map(re.escape, names)) + r")(?!\w)", lambda m: labels[m[0]], text)


def sentence(spec: Spec, labels: Mapping[str, str], effect: float | None = None, p: float | None = None, n: int | None = None, signed: bool = True) -> str:
    """A finding in words. ``signed`` False leaves the direction out (for scales that need a codebook)."""
    say = lambda c: label(c, labels) if c else ""
    if spec.family == "assoc":
        way = "" if effect is None or not signed or effect == 0 else (" upward" if effect > 0 else " downward")
        text = f"{say(spec.y)} moves{way} with {say(spec.x)}"
    elif spec.family == "diff":
        text = f"Levels of {say(spec.group)} are unlike in {say(spec.y)}"
    elif spec.family == "interact":
        text = f"How {say(spec.y)} moves with {say(spec.x)} depends on {say(spec.moderator)}"
    else:
        text = f"How {say(spec.y)} moves with {say(spec.x)} is unlike between levels of {say(spec.group)}"
    if spec.controls:
        names = [say(c) for c in spec.controls]
        text += ", given " + (", ".join(names[:-1]) + " and " if len(names) > 1 else "") + names[-1]
    if spec.weight:
        text += f", with {say(spec.weight)} as weight"
    facts = [*([p_text(p)] if p is not None else []), *([f"effect={number(effect)}"] if effect is not None else []), *([f"n={n}"] if n is not None else [])]
    text += f" ({', '.join(facts)})" if facts else ""
    return text[:1].upper() + text[1:] + "."


def _balanced(text: str, start: int) -> str:
    """From a bracket to its partner; what is left open is closed."""
    pairs, stack, quoted, skip = {"{": "}", "[": "]"}, [], False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in pairs:
            stack.append(pairs[c])
        elif not quoted and stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return text[start : i + 1]
    return text[start:].rstrip().rstrip(",") + ('"' if quoted else "") + "".join(reversed(stack))


def find_json(text: str) -> Any | None:
    """The first JSON value in a model's answer: fenced or bare, with trailing commas, comments, single
    quotes or missing ends mended. None if there is none."""
    fenced = re.findall(r"```(?:json)?\s*(.*?)(?:```|$)", text or "", re.S)
    for part in [*fenced, text or ""]:
        for m in re.finditer(r"[{\[]", part):
            raw = _balanced(part, m.start())
            plain = re.sub(r",\s*([}\]])", r"\1", re.sub(r"(?<![:\"\w])//[^\n]*", "", raw))
            swapped = re.sub(r"(?<!\w)'([^'\n]*)'(?!\w)", r'"\1"', plain)
            worded = re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", re.sub(r"\bNone\b", "null", swapped)))
            for candidate in (raw, plain, swapped, worded):
                try:
                    return json.loads(candidate)
                except ValueError:
                    continue
    return None


def find_list(text: str) -> list[str]:
    """Items of a list in a model's answer: a JSON array, or numbered and bulleted lines."""
    value = find_json(text)
    if isinstance(value, list):
        return [v if isinstance(v, str) else json.dumps(v) for v in value]
    return [m[1].strip() for line in (text or "").splitlines() if (m := re.match(r"\s*(?:[-*•]|\d+[.)])\s+(.+)", line))]


def find_code(text: str) -> str | None:
    m = re.search(r"```\w*\n(.*?)(?:```|$)", text or "", re.S)
    return m[1] if m else None


def citations(text: str, ids: set[str], around: int = 100, most: int = 200) -> list[tuple[str, str]]:
    """Known ids cited in square brackets, each with the text around it."""
    out = []
    for m in re.finditer(r"\[([^\[\]]+)\]", text or ""):
        context = text[max(0, m.start() - around) : m.end() + around].strip()[:most]
        out += [(i, context) for i in (t.strip() for t in m[1].split(",")) if i in ids]
    return out


def question_number(name: str) -> int | None:
    m = re.match(r"[A-Za-z]?[Qq](\d+)", name)
    return int(m[1]) if m else None


def question_ranges(text: str) -> list[tuple[int, int]]:
    """Ranges such as "Q1-Q45, Q50"."""
    return [(int(a), int(b or a)) for a, b in re.findall(r"[Qq]?(\d+)(?:\s*[-–]\s*[Qq]?(\d+))?", text)]

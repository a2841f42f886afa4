"""The statistical query language: tokens, parser, column resolution.

    query := body [ "controlling for" term ("," term)* ] [ "weights=" name ]
    body  := assoc(X, Y) | diff(Y, by=G) | interact(X * Z -> Y) | heterogeneity(Y ~ X | G)
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FAMILIES = ("assoc", "diff", "interact", "heterogeneity")
_MARK = {"assoc": ",", "diff": "by=", "interact": "->", "heterogeneity": "~"}
_TOKEN = re.compile(r"\s*(?:(?P<op>->|[(),*~|\[\]=])|(?P<word>[^\s(),*~|\[\]=]+?(?=->|[\s(),*~|\[\]=]|$)))")


class GrammarError(ValueError):
    pass


@dataclass(frozen=True)
class Spec:
    family: str
    x: str | None = None
    y: str | None = None
    group: str | None = None
    moderator: str | None = None
    controls: tuple[str, ...] = ()
    weight: str | None = None
    unresolved: tuple[str, ...] = field(default=(), compare=False)
    text: str = field(default="", compare=False)

    @property
    def columns(self) -> list[str]:
        every = [self.x, self.y, self.group, self.moderator, self.weight, *self.controls]
        return list(dict.fromkeys(c for c in every if c))

    def canonical(self) -> str:
        """One spelling for equal questions: an association is symmetric, controls have no order."""
        x, y = sorted([self.x or "", self.y or ""]) if self.family == "assoc" else (self.x or "", self.y or "")
        tail = (" controlling for " + ", ".join(sorted(self.controls)) if self.controls else "") + (f" weights={self.weight}" if self.weight else "")
        return {"assoc": f"assoc({x}, {y})", "diff": f"diff({y}, by={self.group})", "interact": f"interact({x} * {self.moderator} -> {y})", "heterogeneity": f"heterogeneity({y} ~ {x} | {self.group})"}[self.family] + tail


def is_query(text: str) -> bool:
    """Whether a line is meant as a query: a family's name, a parenthesis and the family's mark."""
    m = re.match(r"\s*(\w+)\s*\(", text or "")
    if not m or m[1].lower() not in FAMILIES:
        return False
    return _MARK[m[1].lower()] in re.sub(r"by\s*=", "by=", text.lower())


class _Tokens:
    def __init__(self, text: str) -> None:
        self.items: list[str] = []
        at = 0
        while at < len(text) and (m := _TOKEN.match(text, at)):
            self.items.append(m["op"] or m["word"])
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def take(self, wanted: str | None = None) -> str:
        t = self.peek()
        if t is None or (wanted is not None and t.lower() != wanted):
            raise GrammarError(f"expected {wanted or 'a name'}, found {t or 'the end'}")
        self.at += 1
        return t

    def name(self, *stops: str) -> str:
        """A column's name up to a stop: words, and a label in parentheses that is left out."""
        words: list[str] = []
        while (t := self.peek()) is not None and t.lower() not in stops:
            if t == "(":
                depth = 0
                while True:
                    t = self.take()
                    depth += (t == "(") - (t == ")")
                    if not depth:
                        break
                continue
            if t in ("[", "]"):
                self.take()
                continue
            words.append(self.take())
        if not words:
            raise GrammarError("a column is missing")
        return " ".join(words)


class Resolver:
    """Finds the column that a term means: exactly, ignoring case, then by alias."""

    def __init__(self, columns: list[str], aliases: dict[str, str] | None = None) -> None:
        self.columns = list(columns)
        self.lower = {c.lower(): c for c in reversed(self.columns)}
        self.aliases = {a.lower().strip(): c for a, c in (aliases or {}).items() if c in set(columns)}

    def find(self, term: str) -> str | None:
        t = term.strip().strip("[]\"'`")
        if t in self.columns:
            return t
        low = t.lower()
        if low in self.lower:
            return self.lower[low]
        short = re.sub(r"\s*\(.*\)\s*$", "", low).strip()
        for key in (low, short):
            if key in self.lower:
                return self.lower[key]
            if key in self.aliases:
                return self.aliases[key]
        if len(short) >= 3:
            for alias, column in self.aliases.items():
                if short in alias or (len(alias) >= 3 and alias in short):
                    return column
        return None

    def suggest(self, term: str, most: int = 5) -> list[str]:
        """Columns that share the most different characters with the term."""
        own = set(term.lower())
        return sorted(self.columns, key=lambda c: (-len(own & set(c.lower())), c))[:most]


def label_aliases(labels: dict[str, str]) -> dict[str, str]:
    """Aliases from labels: the whole label and its first two and three words; the first column wins."""
    out: dict[str, str] = {}
    for column, label in labels.items():
        words = label.lower().split()
        for a in (" ".join(words), " ".join(words[:3]), " ".join(words[:2])):
            if a and len(a) >= 3:
                out.setdefault(a, column)
    return out


def parse(text: str, columns: list[str], aliases: dict[str, str] | None = None, weights: frozenset[str] = frozenset(), ids: frozenset[str] = frozenset()) -> Spec:
    """Parse and resolve a query. Raises ``GrammarError`` for bad forms, unknown columns and bad roles."""
    if not is_query(text):
        raise GrammarError("not a query of a known family")
    weight = None
    if m := re.search(r"\bweights?\s*=\s*\[?([\w.]+)\]?", text):
        weight, text = m[1], text[: m.start()] + text[m.end() :]
    head, _, tail = re.sub(r"\s+", " ", text).partition("controlling for")
    if head.count("(") > head.count(")"):  # controls inside the parentheses
        tail, head = tail.replace(")", "", 1), head.rstrip(" ,") + ")"
    tokens = _Tokens(head)
    family = tokens.take().lower()
    tokens.take("(")
    raw: dict[str, str] = {}
    if family == "assoc":
        raw["x"] = tokens.name(",")
        tokens.take(",")
        raw["y"] = tokens.name(")", "|", ",")
    elif family == "diff":
        raw["y"] = tokens.name(",")
        tokens.take(",")
        tokens.take("by")
        tokens.take("=")
        raw["group"] = tokens.name(")")
    elif family == "interact":
        raw["x"] = tokens.name("*")
        tokens.take("*")
        raw["moderator"] = tokens.name("->")
        tokens.take("->")
        raw["y"] = tokens.name(")")
    else:
        raw["y"] = tokens.name("~")
        tokens.take("~")
        raw["x"] = tokens.name("|")
        tokens.take("|")
        raw["group"] = tokens.name(")")
    tokens.take(")")
    terms = [t for t in (s.strip(" |[]()") for s in tail.split(",")) if t]
    find = Resolver(columns, aliases)
    missing: list[str] = []

    def column(term: str | None) -> str | None:
        if term is None:
            return None
        c = find.find(term)
        if c is None:
            missing.append(term)
        return c

    got = {k: column(v) for k, v in raw.items()}
    main = set(got.values())
    controls = tuple(c for c in dict.fromkeys(column(t) for t in terms) if c and c not in main)
    weight_column = column(weight)
    if missing:
        raise GrammarError("; ".join(f"unknown column {t!r}, perhaps {', '.join(find.suggest(t, 3))}" for t in missing))
    if weight_column in controls:
        raise GrammarError("the weight can't be a control as well")
    for role in ("x", "y"):
        if got.get(role) in weights | ids:
            raise GrammarError(f"{got[role]} is a weight or an id and can't be {role}")
    return Spec(family, controls=controls, weight=weight_column, text=text, **got)

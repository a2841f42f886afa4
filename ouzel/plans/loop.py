"""A session of discovery: propose, check, run, score, decide, store.

Proposals and judgements come from callables, so a language model is one way to make them and never
required. Scores are columns; one batch is written per round.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions import scoring as S
from .grammar import GrammarError, Spec
from .planner import Engine
from .validator import validate

Proposer = Callable[["Session"], list[str]]
Judge = Callable[[Spec], float]

_ROW = "round int, query string, family string, core array<string>, effect double, p double, n long, validity double, novelty double, overall double, decision string"


# How likely each way of choosing a focus is before anything is known of the graph.
FOCUS = {"explore": 0.3, "refine": 0.4, "conflict": 0.3, "global": 0.15}
# Findings from which a look at the whole is taken.
GLOBAL_FROM = 12
_ALL = float("inf")
# Circumstances, as half-open ranges of what is measured, and by how much each then changes the weights.
# Of the rows of one heading the first that fits counts.
CHANGES = (
    ("graph", {"graph": (0, 1), "insights": (0, 10)}, {"explore": 2.0, "global": 0.2}),
    ("graph", {"graph": (0, 1)}, {}),
    ("graph", {"insights": (0, 10), "clusters": (0, 4)}, {"explore": 2.0, "global": 0.2}),
    ("graph", {"chains per finding": (0, 0.15)}, {"refine": 1.5}),
    ("graph", {"chains per finding": (math.nextafter(0.3, 1), _ALL), "clusters": (0, 5)}, {"explore": 1.2, "global": 1.5}),
    ("conflicts", {"conflicts": (1, _ALL)}, {"conflict": 1.5, "global": 0.5}),
    ("conflicts", {}, {"conflict": 0.3}),
)


def mode_weights(insights: int, clusters: int, chains: int, conflicts: int, graph: bool = True) -> dict[str, float]:
    """How likely each way of choosing a focus is, by ``FOCUS`` and ``CHANGES``; without ``graph``, its measures say nothing."""
    if insights <= 0:
        return {way: float(way == "explore") for way in FOCUS}
    measured = {"graph": int(graph), "insights": insights, "clusters": clusters, "chains per finding": chains / insights, "conflicts": conflicts}
    fitting: dict[str, dict[str, float]] = {}
    for heading, ranges, factors in CHANGES:
        if all(low <= measured[m] < high for m, (low, high) in ranges.items()):
            fitting.setdefault(heading, factors)
    start = FOCUS | ({} if insights >= GLOBAL_FROM else {"global": 0.0})
    weights = {way: math.prod([w, *(f.get(way, 1.0) for f in fitting.values())]) for way, w in start.items()}
    return {way: w / sum(weights.values()) for way, w in weights.items()}


def refinement_anchors(found: DataFrame) -> DataFrame:
    """``query, score``: findings worth deepening, whose score is at least 0.7 of the best one's."""
    bonus = F.when(F.col("family") == "assoc", 0.25).when(F.col("family") == "interact", 0.15).otherwise(0.0)
    x = found.where("decision = 'accept'").withColumn("score", 0.6 * F.col("overall") + 0.4 * F.col("validity") + bonus)
    top = x.agg(F.max("score").alias("top"))
    return x.join(F.broadcast(top)).where("score >= 0.7 * top").select("query", "score")  # one row


def propose_pairs(columns: list[str], seed: int = 0, batch: int = 10) -> Proposer:
    """Associations of random pairs of columns, for sessions without a model."""

    def run(session: Session) -> list[str]:
        rng = random.Random(f"{seed}-{session.round}")
        return [f"assoc({a}, {b})" for a, b in (rng.sample(columns, 2) for _ in range(batch))]

    return run


@dataclass
class Session:
    engine: Engine
    propose: Proposer
    judge: Judge | None = None
    gates: S.Gates = field(default_factory=S.Gates)
    round: int = 0
    rows: list[tuple] = field(default_factory=list)
    rejected: list[tuple[str, str]] = field(default_factory=list)
    most_rejected: int = 500

    def _reject(self, query: str, reason: str) -> None:
        self.rejected = [*self.rejected, (query, reason)][-self.most_rejected :]

    def _novelty(self, spec: Spec, columns: frozenset[str]) -> float:
        """1 minus the greatest overlap of columns with a finding; 0.1 for the same columns, blended with the judge."""
        overlaps = [len(columns & set(r[3])) / len(columns | set(r[3])) for r in self.rows]
        structural = 1.0 - max(overlaps, default=0.0)
        structural = 0.1 if structural == 0 else structural
        surprise = 0.5 if self.judge is None else self.judge(spec)
        return 0.5 * structural + 0.5 * surprise

    def step(self) -> list[tuple]:
        """One round; what it stores. Proposals are checked cheapest rule first; one that fails is noted and doesn't stop the others."""
        self.round += 1
        seen = {r[1] for r in self.rows}
        new: list[tuple] = []
        for text in dict.fromkeys(self.propose(self)):
            if reasons := validate(self.engine, text):
                self._reject(text, reasons[0])
                continue
            try:
                spec = self.engine.parse(text)
            except GrammarError:
                self._reject(text, "INVALID_DSL_FORMAT")
                continue
            if spec.canonical() in seen:
                self._reject(text, "CROSS_ROUND_DUPLICATE")
                continue
            seen.add(spec.canonical())
            columns = frozenset(c for c in (spec.x, spec.y, spec.group, spec.moderator) if c)
            nov = self._novelty(spec, columns)
            if nov < 0.25:
                self._reject(text, "LOW_NOVELTY_PRECRITIC")
                continue
            out = self.engine.run(spec)
            r = self._score(out, nov, spec).first()
            if r.decision is None:
                self._reject(text, "EXECUTION_ERROR")
                continue
            row = (self.round, spec.canonical(), spec.family, sorted(columns), r.effect_size, r.p_value, r.n_observations, r.v, nov, r.total, r.decision)
            if r.decision == "reject":
                self._reject(text, "REJECTED_BY_CRITIC")
            else:
                new.append(row)
        self.rows += new
        return new

    def _score(self, out: DataFrame, nov: float, spec: Spec) -> DataFrame:
        v = S.validity(F.col("p_value"), F.col("effect_size"), F.col("n_observations").cast("double"), F.col("family"), F.col("warning_severity"))
        x = out.withColumn("v", v).withColumn("total", S.overall(F.col("v"), F.lit(nov), S.interpretability(F.lit(False), F.lit(bool(spec.controls)), F.lit(spec.family in ("interact", "heterogeneity"))), self.gates))
        return x.withColumn("decision", F.when(F.col("status") != "execution_error", S.decide(F.col("v"), F.lit(nov), F.col("total"), F.col("effect_size"), self.gates)))

    def run(self, rounds: int, stall: int = 30, place: str | None = None) -> DataFrame:
        """Rounds until there were ``stall`` without anything new; each round's findings are one batch under ``place``."""
        spark: SparkSession = self.engine.df.sparkSession
        idle = 0
        for _ in range(rounds):
            new = self.step()
            if new and place:
                spark.createDataFrame(new, _ROW).coalesce(1).write.mode("overwrite").parquet(f"{place}/round={self.round}")
            idle = 0 if new else idle + 1
            if idle >= stall:
                break
        return spark.createDataFrame(self.rows, _ROW)

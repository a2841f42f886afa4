"""Statistical recipes: distributed sums, then a small solve on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions import special as sp
from ..operators.gram import gram
from ..operators.ranks import rank_sums

MIN_ROWS, MIN_REGRESSION, MIN_GROUP = 10, 20, 5


class RecipeError(ValueError):
    pass


@dataclass
class Result:
    test_method: str
    effect_size: float
    effect_size_kind: str
    p_value: float
    n_observations: int
    ci: tuple[float, float] | None = None
    r_squared: float | None = None
    formula: str | None = None
    term: str | None = None
    estimand: str | None = None
    omnibus: dict | None = None
    details: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)


def _fisher(r: float, n: float, z: float) -> tuple[float, float]:
    se = 1 / math.sqrt(max(n - 3, 1))
    return math.tanh(math.atanh(r) - z * se), math.tanh(math.atanh(r) + z * se)


def pearson(df: DataFrame, x: str, y: str) -> Result:
    s = df.agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).first()
    if s.n < MIN_ROWS:
        raise RecipeError(f"{s.n} rows are too few")
    if s.r is None or math.isnan(s.r):
        raise RecipeError("a column is constant")
    r = max(-1.0, min(1.0, s.r))
    t = r * math.sqrt((s.n - 2) / max(1 - r * r, 1e-300))
    ci = _fisher(max(-0.999999999, min(0.999999999, r)), s.n, 1.96)
    return Result("pearson", r, "r", sp.t_two_sided(t, s.n - 2), s.n, ci)


def _levels(df: DataFrame, y: str, g: str) -> list:
    rows = df.groupBy(F.col(g).cast("string").alias("level")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.var_samp(y).alias("var")).collect()  # levels are guarded
    return sorted(rows, key=lambda r: r.level)


def welch(df: DataFrame, y: str, g: str) -> Result:
    a, b = _levels(df, y, g)
    if min(a.n, b.n) < MIN_GROUP:
        raise RecipeError("a group has fewer than 5 rows")
    n = a.n + b.n
    diff, va, vb = b.mean - a.mean, a["var"] / a.n, b["var"] / b.n
    pooled = math.sqrt(((a.n - 1) * a["var"] + (b.n - 1) * b["var"]) / (n - 2))
    if not va + vb or not pooled:
        raise RecipeError("the outcome is constant")
    t, df_ = diff / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
    d = diff / pooled
    se = math.sqrt(n / (a.n * b.n) + d * d / (2 * n))
    q, q2 = sp.t_quantile(0.975, n - 2), sp.t_quantile(0.975, df_)
    raw = (diff - q2 * math.sqrt(va + vb), diff + q2 * math.sqrt(va + vb))
    return Result("welch_t", d, "cohen_d", sp.t_two_sided(t, df_), n, (d - q * se, d + q * se), term=f"{b.level} - {a.level}", details={"t": t, "df": df_, "mean_difference": diff, "difference_lo": raw[0], "difference_hi": raw[1]})


def mann_whitney(df: DataFrame, y: str, g: str, levels: tuple[str, str] | None = None) -> Result:
    """The effect is 2 U / (n1 n2) - 1, with U of the second level in order of text."""
    if levels:
        df = df.where(F.col(g).cast("string").isin(*levels))
    per, ties = rank_sums(df, y, g)
    a, b = sorted(per.collect(), key=lambda r: r.level)
    tie = ties.first()
    if min(a.n, b.n) < MIN_GROUP:
        raise RecipeError("a group has fewer than 5 rows")
    n = a.n + b.n
    u = b.rank_sum - b.n * (b.n + 1) / 2
    effect = 2 * u / (a.n * b.n) - 1
    var = a.n * b.n / 12 * (n + 1 - tie.tie_sum / (n * (n - 1)))
    if var <= 0:
        raise RecipeError("the outcome is constant")
    if min(a.n, b.n) <= 8 and not tie.tie_sum:
        p = sp.mann_whitney_exact(u, a.n, b.n)
    else:
        p = sp.normal_two_sided(max(0.0, abs(u - a.n * b.n / 2) - 0.5) / math.sqrt(var))
    ci = _fisher(max(-0.999999, min(0.999999, effect)), n, 1.96)
    return Result("mann_whitney", effect, "rank_biserial", min(1.0, p), n, ci, term=f"{b.level} - {a.level}", details={"u": u, "n_first": a.n, "n_second": b.n})


def kruskal(df: DataFrame, y: str, g: str) -> Result:
    """Levels with one row are left out. The first two levels must have five rows each, for their contrast."""
    small = df.groupBy(g).agg(F.count("*").alias("_n")).where("_n < 2").select(F.col(g).alias("_small"))
    df = df.join(F.broadcast(small), F.col(g) == F.col("_small"), "left_anti")  # levels are guarded
    per, ties = rank_sums(df, y, g)
    levels, tie = sorted(per.collect(), key=lambda r: r.level), ties.first()
    n, k = int(tie.n or 0), len(levels)
    if k < 3:
        raise RecipeError("fewer than three levels with two rows")
    if min(levels[0].n, levels[1].n) < MIN_GROUP:
        raise RecipeError("one of the first two groups has fewer than 5 rows")
    correction = 1 - tie.tie_sum / (float(n) ** 3 - n)
    if correction <= 0:
        raise RecipeError("the outcome is constant")
    h = (12 / (n * (n + 1)) * sum(r.rank_sum**2 / r.n for r in levels) - 3 * (n + 1)) / correction
    e = h * (n + 1) / (float(n) ** 2 - 1)
    se = math.sqrt(4 * max(e, 0) * (1 - e) ** 2 / (n - 1))
    p = sp.chi2_sf(h, k - 1)
    first = mann_whitney(df, y, g, (levels[0].level, levels[1].level))
    return Result("kruskal_wallis", e, "epsilon_squared", p, n, (max(0.0, e - 1.96 * se), min(1.0, e + 1.96 * se)), omnibus={"test": "kruskal_wallis", "term": g, "statistic": h, "df_num": k - 1, "df_den": None, "p_value": p}, details={"h": h, "levels": k, "first_contrast": first.effect_size, "first_contrast_p": first.p_value})


@dataclass
class Term:
    name: str
    columns: list[Column]
    names: list[str]
    categorical: bool = False


def numeric_term(name: str, centre: float = 0.0) -> Term:
    return Term(name, [F.col(name).cast("double") - F.lit(float(centre))], [name])


def categorical_term(name: str, levels: list) -> Term:
    """Treatment coding: the first of the sorted levels is the reference."""
    text = F.col(name).cast("string")
    return Term(name, [F.when(text == str(v), 1.0).otherwise(0.0) for v in levels[1:]], [f"{name}[{v}]" for v in levels[1:]], True)


def product_term(a: Term, b: Term) -> Term:
    return Term(f"{a.name}:{b.name}", [x * y for y in b.columns for x in a.columns], [f"{x}:{y}" for y in b.names for x in a.names], a.categorical or b.categorical)


class LinearModel:
    """Least squares from one Gram matrix; models without some terms need no further pass."""

    def __init__(self, df: DataFrame, y: Column, terms: list[Term], weight: Column | None = None) -> None:
        columns = [F.lit(1.0), *(c for t in terms for c in t.columns), y]
        self.names = ["intercept", *(n for t in terms for n in t.names)]
        if weight is None:
            self.g = gram(df, columns)
            self.n = int(round(self.g[0, 0]))
        else:
            self.g = gram(df, columns, weight)
            self.n = df.count()
        self.k = len(columns) - 1
        self.blocks, at = {}, 1
        for t in terms:
            self.blocks[t.name] = list(range(at, at + len(t.columns)))
            at += len(t.columns)
        self.beta, self.inverse, self.ssr, self.rank = self._fit(list(range(self.k)))
        self.df = self.n - self.rank
        total = self.g[-1, -1] - self.g[0, -1] ** 2 / self.g[0, 0]
        self.r_squared = 1 - self.ssr / total if total > 0 else float("nan")

    def _fit(self, keep: list[int]) -> tuple[np.ndarray, np.ndarray, float, int]:
        x = self.g[np.ix_(keep, keep)]
        xy = self.g[keep, -1]
        scale = np.sqrt(np.maximum(np.diag(x), 1e-300))
        u, s, _ = np.linalg.svd(x / np.outer(scale, scale), hermitian=True)
        good = s > s[0] * 1e-11
        self.condition = float(math.sqrt(s[0] / max(s[-1], 1e-300)))
        inverse = (u[:, good] / s[good]) @ u[:, good].T / np.outer(scale, scale)
        beta = inverse @ xy
        return beta, inverse, max(0.0, float(self.g[-1, -1] - beta @ xy)), int(good.sum())

    def t_test(self, column: str) -> tuple[float, float, float]:
        """Coefficient, t and p."""
        i = self.names.index(column)
        se = math.sqrt(self.ssr / self.df * self.inverse[i, i])
        if not se:
            raise RecipeError(f"{column} can't be estimated")
        t = float(self.beta[i] / se)
        return float(self.beta[i]), t, sp.t_two_sided(t, self.df)

    def f_test(self, term: str) -> dict:
        """F of leaving out a term, other terms staying (type II if nothing contains the term)."""
        keep = [i for i in range(self.k) if i not in self.blocks[term]]
        _, _, ssr, rank = self._fit(keep)
        d1 = self.rank - rank
        if d1 < 1 or not self.ssr:
            raise RecipeError(f"{term} can't be estimated")
        f = (ssr - self.ssr) / d1 / (self.ssr / self.df)
        return {"test": "type_2_anova", "term": term, "statistic": f, "df_num": d1, "df_den": self.df, "p_value": sp.f_sf(f, d1, self.df), "eta2": max(0.0, (ssr - self.ssr) / ssr) if ssr else 0.0, "ssr_reduced": ssr, "ssr_full": self.ssr}


def linear(df: DataFrame, y: str, terms: list[Term], target: Term, weight: str | None = None) -> Result:
    """Partial r of a target with one column, partial eta squared of one with several."""
    p = 1 + sum(len(t.columns) for t in terms)
    model = LinearModel(df, F.col(y).cast("double"), terms, None if weight is None else F.col(weight))
    if model.n < max(MIN_REGRESSION, 5 * (p - 1)):
        raise RecipeError(f"{model.n} rows are too few for {p - 1} predictors")
    formula = f"{y} ~ " + " + ".join(t.name for t in terms)
    method = "ols" if weight is None else "wls"
    warnings = ["rank_deficient"] if model.rank < model.k else []
    warnings += ["ill_conditioned"] if model.condition > 1000 else []
    if len(target.columns) == 1:
        b, t, pv = model.t_test(target.names[0])
        r = t / math.sqrt(t * t + model.df)
        z = sp.normal_quantile(0.975)
        rc = max(-0.9999, min(0.9999, r))
        return Result(method, r, "partial_r", pv, model.n, _fisher(rc, model.df, z), model.r_squared, formula, target.names[0], "coefficient", details={"t": t, "df": model.df, "coefficient": b}, warnings=warnings)
    test = model.f_test(target.name)
    e = test["eta2"]
    se = math.sqrt(4 * e * (1 - e) ** 2 / (model.n - 1))
    return Result(method + "_anova", e, "partial_eta_squared", test["p_value"], model.n, (max(0.0, e - 1.96 * se), min(1.0, e + 1.96 * se)), model.r_squared, formula, target.name, "omnibus", omnibus=test, details={"ssr_reduced": test["ssr_reduced"], "ssr_full": test["ssr_full"]}, warnings=warnings)


def logit(df: DataFrame, y: str, terms: list[Term], target: Term, rounds: int = 30) -> Result:
    """Logistic regression by reweighted least squares, a Gram pass to each round."""
    if len(target.columns) != 1:
        raise RecipeError("a binary outcome needs a target with one parameter")
    columns = [F.lit(1.0), *(c for t in terms for c in t.columns)]
    names = ["intercept", *(n for t in terms for n in t.names)]
    n = df.count()
    if n < max(MIN_REGRESSION, 10 * (len(columns) - 1)):
        raise RecipeError(f"{n} rows are too few for {len(columns) - 1} predictors")
    beta, last = np.zeros(len(columns)), math.inf
    for _ in range(rounds):
        eta = F.lit(0.0)
        for b, c in zip(beta, columns):
            eta = eta + F.lit(float(b)) * c
        eta = F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0))
        x = df.select(*(c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)), F.col(y).cast("double").alias("y"), eta.alias("eta"))
        x = x.withColumn("p", 1 / (1 + F.exp(-F.col("eta")))).withColumn("w", F.col("p") * (1 - F.col("p"))).withColumn("z", F.col("eta") + (F.col("y") - F.col("p")) / F.col("w"))
        g = gram(x, [*(F.col(f"x{i}") for i in range(len(columns))), F.col("z")], F.col("w"))
        inverse = np.linalg.pinv(g[:-1, :-1], hermitian=True)
        new = inverse @ g[:-1, -1]
        step, beta = float(np.max(np.abs(new - beta))), new
        if g[0, 0] < 1e-3 * n or not np.all(np.isfinite(beta)):  # hardly any row is in doubt
            raise RecipeError("the outcome is separated by a predictor")
        if step < 1e-9 * (1 + float(np.max(np.abs(beta)))):
            break
        last = step
    else:
        if last > 1e-4:
            raise RecipeError("no convergence; a predictor may separate the outcome")
    i = names.index(target.names[0])
    se = math.sqrt(max(inverse[i, i], 1e-300))
    z = float(beta[i]) / se
    to_d = math.sqrt(3) / math.pi
    odds = math.exp(beta[i]) if abs(beta[i]) < 500 else None
    lo, hi = (beta[i] + s * 1.959963984540054 * se for s in (-1, 1))
    return Result("logit", float(beta[i]) * to_d, "log_odds_d", sp.normal_two_sided(z), n, (lo * to_d, hi * to_d), None, f"{y} ~ " + " + ".join(t.name for t in terms), target.names[0], "log_odds", details={"coefficient": float(beta[i]), "se": se, "odds_ratio": odds})


def chi_square(df: DataFrame, a: str, b: str) -> Result:
    """Independence of two columns from their contingency table; Cramer's V."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("ra")), cells.groupBy(b).agg(F.sum("n").alias("cb"))
    s = cells.join(rows, a).join(cols, b).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("q"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c")).first()
    if not s.n or min(s.r, s.c) < 2:
        raise RecipeError("fewer than two levels")
    x, d = s.n * (s.q - 1), (s.r - 1) * (s.c - 1)
    return Result("chi_square", math.sqrt(max(0.0, x) / (s.n * (min(s.r, s.c) - 1))), "cramers_v", sp.chi2_sf(x, d), s.n, details={"chi2": x, "df": d})


def one_way_f(df: DataFrame, y: str, g: str) -> Result:
    per = df.where(F.col(y).isNotNull() & F.col(g).isNotNull()).groupBy(g).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    s = per.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m")).alias("sm"), F.sum(F.col("n") * F.col("m") ** 2).alias("smm")).first()
    between, d1, d2 = s.smm - s.sm**2 / s.n, s.k - 1, s.n - s.k
    f = between / d1 / (s.within / d2)
    return Result("one_way_f", between / (between + s.within), "eta_squared", sp.f_sf(f, d1, d2), s.n, details={"f": f, "df_num": d1, "df_den": d2})


def paired_t(df: DataFrame, a: str, b: str, against: float = 0.0) -> Result:
    """Of the differences a - b; with a literal zero column, the one-sample test."""
    s = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.col(a) - F.col(b)).alias("m"), F.stddev_samp(F.col(a) - F.col(b)).alias("s")).first()
    t = (s.m - against) / (s.s / math.sqrt(s.n))
    return Result("paired_t", (s.m - against) / s.s, "cohen_d", sp.t_two_sided(t, s.n - 1), s.n, details={"t": t, "df": s.n - 1})


def proportion_z(df: DataFrame, y: str, g: str) -> Result:
    """Two proportions of a 0/1 column, pooled standard error; levels in order of text."""
    a, b = _levels(df.where(F.col(y).isNotNull() & F.col(g).isNotNull()), y, g)
    pooled = (a.n * a.mean + b.n * b.mean) / (a.n + b.n)
    z = (b.mean - a.mean) / math.sqrt(pooled * (1 - pooled) * (1 / a.n + 1 / b.n))
    return Result("proportion_z", b.mean - a.mean, "difference", sp.normal_two_sided(z), a.n + b.n, details={"z": z})


def kendall(df: DataFrame, a: str, b: str, most: int = 3000) -> Result:
    """Kendall's tau-b from the contingency table of two coded columns with at most ``most`` values each."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    d = known.agg(F.approx_count_distinct("a").alias("a"), F.approx_count_distinct("b").alias("b")).first()
    if max(d.a, d.b) > most:
        raise RecipeError(f"more than {most} different values; use Spearman's correlation")
    cells = known.groupBy("a", "b").agg(F.count("*").alias("n")).collect()  # at most most ** 2 cells
    ia, ib = ({v: i for i, v in enumerate(sorted({c[k] for c in cells}))} for k in "ab")
    t = np.zeros((len(ia), len(ib)))
    for c in cells:
        t[ia[c.a], ib[c.b]] = c.n
    below = np.zeros((t.shape[0] + 1, t.shape[1] + 1))
    below[1:, 1:] = t.cumsum(0).cumsum(1)
    total = t.sum()
    row_upto = below[:-1, -1][:, None]
    concordant = float((t * below[:-1, :-1]).sum())
    discordant = float((t * (row_upto - below[:-1, 1:])).sum())
    pairs = total * (total - 1) / 2
    ra, rb = t.sum(1), t.sum(0)
    ta, tb = float((ra * (ra - 1) / 2).sum()), float((rb * (rb - 1) / 2).sum())
    if pairs in (ta, tb):
        raise RecipeError("a column is constant")
    s = concordant - discordant
    tau = s / math.sqrt((pairs - ta) * (pairs - tb))
    v0 = total * (total - 1) * (2 * total + 5)
    va, vb = (float((r * (r - 1) * (2 * r + 5)).sum()) for r in (ra, rb))
    v1 = 2 * ta * 2 * tb / (2 * total * (total - 1))
    v2 = float((ra * (ra - 1) * (ra - 2)).sum()) * float((rb * (rb - 1) * (rb - 2)).sum()) / (9 * total * (total - 1) * (total - 2))
    z = s / math.sqrt((v0 - va - vb) / 18 + v1 + v2)
    return Result("kendall", tau, "tau_b", sp.normal_two_sided(z), int(total), details={"concordant": concordant, "discordant": discordant})


def jarque_bera(df: DataFrame, y: str) -> Result:
    """Normality from skewness and kurtosis; the effect is the skewness."""
    s = df.where(F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.skewness(y).alias("s"), F.kurtosis(y).alias("k")).first()
    if s.s is None or math.isnan(s.s):
        raise RecipeError("the column is constant")
    jb = s.n / 6 * (s.s**2 + s.k**2 / 4)
    return Result("jarque_bera", s.s, "skewness", sp.chi2_sf(jb, 2), s.n, details={"jb": jb, "kurtosis": s.k})

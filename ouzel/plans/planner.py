"""From a parsed query to a recipe and its result row."""

from __future__ import annotations

import math

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.levels import MAX_LEVELS, collapse_rare, split
from . import recipes as R
from .grammar import Spec, label_aliases, parse
from .profile import Profile

RESULT = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("family", T.StringType()), T.StructField("test_method", T.StringType()),
    T.StructField("effect_size", T.DoubleType()), T.StructField("effect_size_kind", T.StringType()), T.StructField("p_value", T.DoubleType()),
    T.StructField("n_observations", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("ci_lo", T.DoubleType()), T.StructField("ci_hi", T.DoubleType()),
    T.StructField("formula", T.StringType()), T.StructField("summary_estimand", T.StringType()), T.StructField("summary_term", T.StringType()), T.StructField("r_squared", T.DoubleType()),
    T.StructField("omnibus", T.StructType([
        T.StructField("test", T.StringType()), T.StructField("term", T.StringType()), T.StructField("statistic", T.DoubleType()),
        T.StructField("df_num", T.DoubleType()), T.StructField("df_den", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
    ])),
    T.StructField("warning_severity", T.StringType()), T.StructField("review_flags", T.ArrayType(T.StringType())), T.StructField("collapsed_levels", T.ArrayType(T.StringType())),
    T.StructField("details", T.MapType(T.StringType(), T.DoubleType())), T.StructField("status", T.StringType()), T.StructField("error", T.StringType()),
])

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
MATERIAL = {"rank_deficient", "separation", "no_convergence"}


def clean_infinite(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Infinite and NaN values of floating columns as null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (columns is None or f.name in columns)]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in floats}) if floats else df


def prepare(df: DataFrame, spec: Spec, profile: Profile) -> tuple[DataFrame, set[str], int]:
    """Rows with all of the query's columns known, the columns that are levels, and the rows there were.

    Columns of numbers, and text of which at least half of all rows reads as numbers, become numbers and lose
    the profile's missing codes; declared levels stay as they are; other text is levels.
    """
    x = clean_infinite(df.select(*spec.columns))
    fields = {f.name: f.dataType for f in x.schema}
    texts = [c for c in spec.columns if not isinstance(fields[c], (*_NUMERIC, T.BooleanType)) and c not in profile.categorical]
    seen = x.agg(F.count("*").alias("_rows"), *(F.count(F.expr(f"try_cast(cast(`{c}` as string) as double)")).alias(c) for c in texts)).first()
    levels = {c for c in spec.columns if c != spec.weight and (c in profile.categorical or isinstance(fields[c], T.BooleanType))}
    for c in spec.columns:
        if c in levels:
            continue
        if c in texts:
            if c != spec.weight and 2 * seen[c] < seen["_rows"]:
                levels.add(c)
                continue
            x = x.withColumn(c, F.expr(f"try_cast(cast(`{c}` as string) as double)"))
        if codes := profile.codes(c):
            x = x.withColumn(c, F.when(~F.col(c).isin([float(v) for v in codes]), F.col(c)))
    return x.dropna(), levels, seen["_rows"]


class Engine:
    """A table with its profile, against which queries are run."""

    def __init__(self, df: DataFrame, profile: Profile | None = None, key: str | None = None) -> None:
        self.df, self.profile, self.key = df, profile or Profile(), key
        self._distinct: dict[str, int] = {}

    def parse(self, text: str) -> Spec:
        p = self.profile
        return parse(text, self.df.columns, label_aliases(p.labels), p.weights, p.ids)

    def distinct(self, column: str) -> int:
        """Number of different values, computed once; for guards only, hence approximate."""
        if column not in self._distinct:
            self._distinct[column] = self.df.agg(F.approx_count_distinct(column)).first()[0]
        return self._distinct[column]

    def execute(self, spec: Spec, df: DataFrame | None = None) -> tuple[R.Result, list[str], float]:
        """The result, the levels pooled on the way and the share of rows that could be used."""
        x, levels, rows = prepare(self.df if df is None else df, spec, self.profile)
        pooled: list[str] = []
        y = F.col(spec.y)
        seen = x.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(y.cast("double").isin(0.0, 1.0)), F.lit(False)).alias("binary"), F.approx_count_distinct(y).alias("values")).first()
        n, binary = seen.n, self.profile.binary.get(spec.y, bool(seen.binary))
        if n < R.MIN_ROWS:
            raise R.RecipeError(f"{n} rows are too few")
        g = spec.group
        sizes = {}
        for c in {c for c in (g, spec.x, spec.moderator, *spec.controls) if c and (c in levels or c == g)}:
            levels.add(c)
            if spec.family == "diff" and not spec.controls and not spec.weight and c == g:
                sizes[c] = self._level_list(x, c, levels_numeric=False)
                continue
            x, gone = collapse_rare(x, c)
            x = x.where(F.col(c).isNotNull())
            pooled += gone
            sizes[c] = self._level_list(x, c, levels_numeric=not gone)
        for c, values in sizes.items():
            if len(values) > MAX_LEVELS:
                raise R.RecipeError(f"{c} has more than {MAX_LEVELS} levels")
        if g and len(sizes[g]) < 2:
            raise R.RecipeError(f"{g} has fewer than two levels")
        plain = not spec.controls and not spec.weight
        if spec.y in levels and not binary:
            raise R.RecipeError(f"{spec.y} is no number")
        if spec.family == "assoc" and plain and spec.x not in levels:
            result = R.pearson(x, spec.x, spec.y)
        elif spec.family == "diff" and plain:
            result = self._groups(x, spec, len(sizes[g]), seen["values"])
        else:
            result = self._regression(x, spec, levels, sizes, binary)
        return result, pooled, n / rows if rows else 0.0

    def _level_list(self, x: DataFrame, c: str, levels_numeric: bool) -> list[str]:
        values = [r[0] for r in x.select(F.col(c).cast("string")).distinct().limit(MAX_LEVELS + 2).collect()]
        if levels_numeric:
            try:
                return sorted(values, key=float)
            except (TypeError, ValueError):
                pass
        return sorted(values)

    def _groups(self, x: DataFrame, spec: Spec, k: int, about: int) -> R.Result:
        if k > 2:
            return R.kruskal(x, spec.y, spec.group)
        few = about < 20 and x.select(spec.y).distinct().limit(7).count() < 7
        return R.mann_whitney(x, spec.y, spec.group) if few else R.welch(x, spec.y, spec.group)

    def _regression(self, x: DataFrame, spec: Spec, levels: set[str], sizes: dict[str, list[str]], binary: bool) -> R.Result:
        numbers = [c for c in spec.columns if c not in levels and c not in (spec.y, spec.weight)]
        means = x.agg(F.count("*").alias("_n"), *(F.avg(c).alias(c) for c in numbers)).first()

        def term(c: str) -> R.Term:
            return R.categorical_term(c, sizes[c]) if c in levels else R.numeric_term(c, means[c])

        controls = [term(c) for c in spec.controls]
        if spec.family == "assoc":
            main = [term(spec.x)]
            target = main[0]
        elif spec.family == "diff":
            main = [term(spec.group)]
            target = main[0]
        else:
            a, b = term(spec.x), term(spec.moderator if spec.family == "interact" else spec.group)
            target = R.product_term(a, b)
            main = [a, b, target]
        terms = [*main, *controls]
        if binary:
            result = R.logit(x, spec.y, terms, target)
            if spec.weight:
                result.flags.append("weight_not_used_in_fit")
            return result
        return R.linear(x, spec.y, terms, target, spec.weight)

    def run(self, query: str | Spec) -> DataFrame:
        """One row of ``RESULT``; failures come back as a row with ``status`` "execution_error"."""
        spec = query if isinstance(query, Spec) else self.parse(query)
        spark = self.df.sparkSession
        try:
            r, pooled, coverage = self.execute(spec)
            check(r, coverage)
        except R.RecipeError as e:
            row = dict.fromkeys(RESULT.names) | {"query": spec.canonical(), "family": spec.family, "status": "execution_error", "error": str(e)}
            return spark.createDataFrame([tuple(row[k] for k in RESULT.names)], RESULT)
        severity = "material" if MATERIAL & set(r.warnings) else "review" if r.warnings or r.flags or pooled else "none"
        flags = r.flags + (["direction_requires_codebook_interpretation"] if self.cautious(spec) else []) + r.warnings + (["levels_collapsed"] if pooled else [])
        omnibus = tuple(None if (v := (r.omnibus or {}).get(k)) is None else (v if isinstance(v, str) else float(v)) for k in ("test", "term", "statistic", "df_num", "df_den", "p_value")) if r.omnibus else None
        details = {k: float(v) for k, v in r.details.items() if isinstance(v, (int, float)) and v is not None}
        ci = tuple(map(float, r.ci)) if r.ci else (None, None)
        row = (spec.canonical(), spec.family, r.test_method, float(r.effect_size), r.effect_size_kind, float(r.p_value), r.n_observations, float(coverage), ci[0], ci[1],
               r.formula, r.estimand, r.term, None if r.r_squared is None else float(r.r_squared), omnibus, severity, flags, pooled, details, "valid" if severity == "none" else "valid_with_warning", None)
        return spark.createDataFrame([row], RESULT)

    def feasible(self, query: str | Spec) -> str | None:
        """Why a query can't be run, or None: too few levels or too many, or too few usable rows."""
        spec = query if isinstance(query, Spec) else self.parse(query)
        for c in (c for c in (spec.group, spec.moderator if spec.moderator in self.profile.categorical else None) if c):
            n = self.distinct(c)
            if n < 2:
                return f"{c} has fewer than two levels"
            if n > MAX_LEVELS * 1.1:  # counted approximately; rare levels may still be pooled
                x = self.df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where("n >= 30").limit(2).count()
                if x < 2:
                    return f"{c} has more than {MAX_LEVELS} levels and no two of 30 rows"
        rows = prepare(self.df, spec, self.profile)[0].limit(R.MIN_ROWS).count()
        return None if rows >= R.MIN_ROWS else f"{rows} rows are too few"

    def cautious(self, spec: Spec) -> bool:
        """Whether the direction needs a codebook: a column's high values are said to mean the reverse, or are unclear."""
        return any(self.profile.high_means.get(c) in ("less", "unclear") for c in (spec.x, spec.y) if c)

    def audit(self, query: str | Spec) -> str:
        """Spark SQL that selects the rows a query uses, for the record."""
        spec = query if isinstance(query, Spec) else self.parse(query)
        parts = []
        for c in spec.columns:
            x = f"`{c}`"
            if codes := self.profile.codes(c):
                if c not in self.profile.categorical:
                    x = f"CASE WHEN {x} NOT IN ({', '.join(map(str, codes))}) THEN {x} END AS `{c}`"
            parts.append(x)
        known = " AND ".join(f"`{c}` IS NOT NULL" for c in spec.columns)
        return f"-- {spec.canonical()}\nSELECT * FROM (SELECT {', '.join(parts)} FROM data) WHERE {known}"

    def replicate(self, query: str | Spec, level: float = 0.10, least: int = 40) -> str:
        """Whether both parts of a 70/30 split show the effect: the same sign and p below ``level``."""
        spec = query if isinstance(query, Spec) else self.parse(query)
        key = self.key or spec.columns[0]
        cols = list(dict.fromkeys([*spec.columns, key]))
        try:
            parts = split(self.df.select(*cols), key, 0.7, spec.group)
            found = [self.execute(spec, p)[0] for p in parts]
        except R.RecipeError:
            return "replication_error"
        if min(f.n_observations for f in found) < least:
            return "not_replicated"
        same = math.copysign(1, found[0].effect_size) == math.copysign(1, found[1].effect_size)
        return "replicated" if same and all(f.p_value < level for f in found) else "not_replicated"


def check(r: R.Result, coverage: float) -> None:
    """Reject results that aren't finite, or whose p, coverage or interval can't be."""
    values = [r.effect_size, r.p_value, coverage, *(r.ci or ())]
    if not all(isinstance(v, (int, float)) and math.isfinite(v) for v in values):
        raise R.RecipeError("the result isn't finite")
    if not (0 <= r.p_value <= 1 and 0 <= coverage <= 1):
        raise R.RecipeError("p or coverage lies outside 0..1")
    if r.ci and r.ci[0] > r.ci[1]:
        raise R.RecipeError("the interval's ends are reversed")

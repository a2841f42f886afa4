"""The query language over whole tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..operators import ranks
from ..operators.gram import correlations
from ..operators.prescan import module_rollup, prescan
from ..plans import recipes
from ..plans.planner import Engine
from ..plans.profile import Profile
from ..session import table
from .pipeline import MODULES

R = "amazon_books_autokd"
NUMBERS = ["rating", "helpful_votes", "has_image", "product_price", "product_sales_rank", "review_word_count", "review_avg_word_length", "review_unique_word_ratio", "review_uppercase_ratio", "product_review_count", "reviewer_review_count"]


def _run(s: SparkSession, d: str, name: str, query: str, **profile) -> DataFrame:
    return Engine(table(s, d, name), Profile(**profile)).run(query)


def _show(x: DataFrame, *details: str, places: int = 5) -> DataFrame:
    return x.select("test_method", "n_observations", F.round("effect_size", places).alias("effect"), *(F.round(F.col("details")[k], places).alias(k) for k in details))


def dsl_assoc(s, d):
    return _show(_run(s, d, R, "assoc(review_word_count, review_unique_word_ratio)"), places=6)


def dsl_diff_welch(s, d):
    return _show(_run(s, d, "lineitem", "diff(l_extendedprice, by=l_linestatus)"), "t", "df", "mean_difference")


def dsl_diff_mwu(s, d):
    return _show(_run(s, d, R, "diff(rating, by=verified_purchase)"), "u", "n_first", "n_second")


def dsl_diff_kruskal(s, d):
    return _show(_run(s, d, "orders", "diff(o_totalprice, by=o_orderpriority)"), "h", "levels")


def dsl_ols_control(s, d):
    return _show(_run(s, d, R, "assoc(review_word_count, helpful_votes) controlling for product_price"))


def dsl_ols_interact(s, d):
    return _show(_run(s, d, "lineitem", "interact(l_quantity * l_discount -> l_extendedprice)"), places=6)


def dsl_heterogeneity(s, d):
    x = _run(s, d, "lineitem", "heterogeneity(l_extendedprice ~ l_quantity | l_returnflag)")
    return x.select("test_method", "n_observations", F.round(F.col("details")["ssr_reduced"] / 1e6, 3).alias("reduced"), F.round((F.col("details")["ssr_reduced"] - F.col("details")["ssr_full"]) / 1e3, 1).alias("gain"))


def dsl_anova(s, d):
    x = _run(s, d, "lineitem", "diff(l_extendedprice, by=l_returnflag) controlling for l_quantity")
    return x.select("test_method", "n_observations", F.round(F.col("details")["ssr_reduced"] / 1e6, 3).alias("reduced"), F.round((F.col("details")["ssr_reduced"] - F.col("details")["ssr_full"]) / 1e3, 1).alias("gain"), F.col("omnibus.df_num").alias("df"))


def dsl_wls(s, d):
    return _show(_run(s, d, "lineitem", "assoc(l_discount, l_extendedprice) weights=l_quantity"), places=6)


def dsl_ols_category_control(s, d):
    return _show(_run(s, d, "lineitem", "assoc(l_quantity, l_extendedprice) controlling for l_returnflag"))


def dsl_logit(s, d):
    return _show(_run(s, d, R, "assoc(review_word_count, has_image) controlling for rating"), "coefficient", "se")


def dsl_result(s, d):
    """A whole result row with its interval, p and flags."""
    return _run(s, d, R, "diff(helpful_votes, by=product_format)").drop("details")


def replicate(s, d):
    e = Engine(table(s, d, R), key="review_id")
    query = "assoc(review_word_count, review_unique_word_ratio)"
    return s.createDataFrame([(query, e.replicate(query))], "query string, status string")


def avg_rank(s, d):
    return ranks.mid_ranks(table(s, d, R), "helpful_votes").select("value", "ties", "mid_rank")


def spearman(s, d):
    return ranks.spearman(table(s, d, R), "review_word_count", "helpful_votes").select("n", F.round("rho", 6).alias("rho"))


def chi_square(s, d):
    r = recipes.chi_square(table(s, d, R), "product_format", "verified_purchase")
    return s.createDataFrame([(r.n_observations, round(r.details["chi2"], 4), int(r.details["df"]))], "n long, chi2 double, df int")


def oneway_f(s, d):
    r = recipes.one_way_f(table(s, d, R), "review_word_count", "product_format")
    return s.createDataFrame([(r.n_observations, round(r.details["f"], 5), int(r.details["df_num"]))], "n long, f double, df int")


def prop_z(s, d):
    r = recipes.proportion_z(table(s, d, R), "has_image", "verified_purchase")
    return s.createDataFrame([(r.n_observations, round(r.details["z"], 5), round(r.effect_size, 6))], "n long, z double, difference double")


def paired_t(s, d):
    r = recipes.paired_t(table(s, d, R), "rating", "product_avg_rating")
    return s.createDataFrame([(r.n_observations, round(r.details["t"], 4))], "n long, t double")


def kendall(s, d):
    r = recipes.kendall(table(s, d, R), "rating", "review_question_count")
    return s.createDataFrame([(r.n_observations, int(r.details["concordant"]), int(r.details["discordant"]), round(r.effect_size, 6))], "n long, concordant long, discordant long, tau double")


def jarque_bera(s, d):
    r = recipes.jarque_bera(table(s, d, "orders"), "o_totalprice")
    return s.createDataFrame([(r.n_observations, round(r.effect_size, 6), round(r.details["kurtosis"], 5))], "n long, skewness double, kurtosis double")


def prescan_corr(s, d):
    x = correlations(table(s, d, R), NUMBERS).where("n >= 30 and abs(r) >= 0.03")
    return x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", F.round("r", 5).alias("r"))


def prescan_cap(s, d):
    x = prescan(table(s, d, R), NUMBERS, MODULES)
    return x.select("a", "b", "n", F.round("r", 6).alias("r"), "module_a", "module_b", "cross")


def module_pair_rollup(s, d):
    x = prescan(table(s, d, R), NUMBERS, MODULES, p=1.0, least_r=0.0, cap=None)
    return module_rollup(x).select("module_1", "module_2", "n", F.round("mean_abs_r", 4).alias("mean_abs_r"), F.array_join("top_pairs", ",").alias("top_pairs"))


def corr_ci(s, d):
    """Fisher's interval of correlations by group."""
    x = table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.corr("l_quantity", "l_extendedprice").alias("r"))
    z = [F.tanh(F.atanh("r") + sign * 1.96 / F.sqrt(F.col("n") - 3)) for sign in (-1, 1)]
    return x.select("l_returnflag", "n", F.round("r", 6).alias("r"), F.round(z[0], 6).alias("lo"), F.round(z[1], 6).alias("hi"))


def _pair(a: str, b: str) -> str:
    x, y = (f"CASE WHEN isfinite({c}::double) THEN {c}::double END" for c in (a, b))
    a, b = sorted((a, b))
    return f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(x, y), 5) AS r FROM (SELECT {x} AS x, {y} AS y FROM {R}) WHERE x IS NOT NULL AND y IS NOT NULL HAVING count(*) >= 30 AND abs(corr(x, y)) >= 0.03"


def _rollup_sql() -> str:
    pairs = []
    for i, a in enumerate(NUMBERS):
        for b in NUMBERS[i + 1 :]:
            m = sorted((MODULES.get(a, "Unknown"), MODULES.get(b, "Unknown")))
            pairs.append(f"SELECT '{m[0]}' AS module_1, '{m[1]}' AS module_2, '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM {R} WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return f"SELECT module_1, module_2, count(*) AS n, round(avg(r), 4) AS mean_abs_r, array_to_string(list(a || '~' || b ORDER BY round(r, 9) DESC, a, b)[:5], ',') AS top_pairs FROM ({' UNION ALL '.join(pairs)}) WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY 1, 2"


_GROUPS = "WITH g AS (SELECT l_returnflag AS g, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy, count(*) AS n FROM lineitem GROUP BY 1)"

SQL = {
    "dsl_assoc": f"SELECT 'pearson' AS test_method, count(*) AS n_observations, round(corr(review_word_count, review_unique_word_ratio), 6) AS effect FROM {R} WHERE review_word_count IS NOT NULL AND review_unique_word_ratio IS NOT NULL",
    "dsl_diff_welch": """WITH g AS (SELECT l_linestatus AS g, count(*)::double AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), x AS (SELECT a.n AS n1, b.n AS n2, a.v AS v1, b.v AS v2, b.m - a.m AS d FROM g a JOIN g b ON a.g < b.g)
        SELECT 'welch_t' AS test_method, (n1 + n2)::bigint AS n_observations, round(d / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 5) AS effect, round(d / sqrt(v1 / n1 + v2 / n2), 5) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 5) AS df, round(d, 5) AS mean_difference FROM x""",
    "dsl_diff_mwu": f"""WITH r AS (SELECT rating AS v, verified_purchase::varchar AS g FROM {R} WHERE rating IS NOT NULL AND verified_purchase IS NOT NULL), k AS (SELECT v, count(*) AS t, sum(count(*)) OVER (ORDER BY v) - count(*) + (count(*) + 1) / 2.0 AS rk FROM r GROUP BY v),
        s AS (SELECT g, count(*)::double AS n, sum(rk)::double AS rs FROM r JOIN k USING (v) GROUP BY g) SELECT 'mann_whitney' AS test_method, (a.n + b.n)::bigint AS n_observations, round(2 * (b.rs - b.n * (b.n + 1) / 2) / (a.n * b.n) - 1, 5) AS effect, b.rs - b.n * (b.n + 1) / 2 AS u, a.n AS n_first, b.n AS n_second FROM s a JOIN s b ON a.g < b.g""",
    "dsl_diff_kruskal": """WITH k AS (SELECT o_totalprice AS v, count(*) AS t, (sum(count(*)) OVER (ORDER BY o_totalprice) - count(*))::double + (count(*) + 1)::double / 2 AS rk FROM orders GROUP BY 1), s AS (SELECT o_orderpriority AS g, count(*)::double AS n, sum(rk) AS rs FROM orders JOIN k ON o_totalprice = v GROUP BY 1),
        t AS (SELECT sum(t::double ** 3 - t) AS ties, sum(t)::double AS n FROM k), h AS (SELECT (12 / (t.n * (t.n + 1)) * sum(rs * rs / s.n) - 3 * (t.n + 1)) / (1 - ties / (t.n ** 3 - t.n)) AS h, t.n, count(*) AS k FROM s, t GROUP BY t.n, ties)
        SELECT 'kruskal_wallis' AS test_method, n::bigint AS n_observations, round(h * (n + 1) / (n * n - 1), 5) AS effect, round(h, 5) AS h, k::double AS levels FROM h""",
    "dsl_ols_control": f"WITH x AS (SELECT corr(review_word_count, helpful_votes) AS xy, corr(review_word_count, product_price) AS xc, corr(helpful_votes, product_price) AS yc, count(*) AS n FROM {R} WHERE review_word_count IS NOT NULL AND helpful_votes IS NOT NULL AND product_price IS NOT NULL) SELECT 'ols' AS test_method, n AS n_observations, round((xy - xc * yc) / sqrt((1 - xc * xc) * (1 - yc * yc)), 5) AS effect FROM x",
    "dsl_ols_interact": """WITH c AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b, l_quantity * l_discount AS p FROM lineitem), r AS (SELECT corr(p, y) AS py, corr(p, a) AS pa, corr(p, b) AS pb, corr(y, a) AS ya, corr(y, b) AS yb, corr(a, b) AS ab, count(*) AS n FROM c),
        f AS (SELECT n, (py - pa * ya) / sqrt((1 - pa * pa) * (1 - ya * ya)) AS py_a, (pb - pa * ab) / sqrt((1 - pa * pa) * (1 - ab * ab)) AS pb_a, (yb - ya * ab) / sqrt((1 - ya * ya) * (1 - ab * ab)) AS yb_a FROM r)
        SELECT 'ols' AS test_method, n AS n_observations, round((py_a - pb_a * yb_a) / sqrt((1 - pb_a * pb_a) * (1 - yb_a * yb_a)), 6) AS effect FROM f""",
    "dsl_heterogeneity": f"{_GROUPS} SELECT 'ols_anova' AS test_method, sum(n)::bigint AS n_observations, round((sum(syy) - sum(sxy) ** 2 / sum(sxx)) / 1e6, 3) AS reduced, round((sum(syy) - sum(sxy) ** 2 / sum(sxx) - sum(syy - sxy * sxy / sxx)) / 1e3, 1) AS gain FROM g",
    "dsl_anova": f"{_GROUPS}, t AS (SELECT regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem) SELECT 'ols_anova' AS test_method, sum(n)::bigint AS n_observations, round((t.syy - t.sxy ** 2 / t.sxx) / 1e6, 3) AS reduced, round((t.syy - t.sxy ** 2 / t.sxx - (sum(g.syy) - sum(g.sxy) ** 2 / sum(g.sxx))) / 1e3, 1) AS gain, (count(*) - 1)::double AS df FROM g, t GROUP BY t.syy, t.sxy, t.sxx",
    "dsl_wls": "WITH m AS (SELECT sum(l_quantity * l_discount) / sum(l_quantity) AS mx, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS my FROM lineitem) SELECT 'wls' AS test_method, count(*) AS n_observations, round(sum(l_quantity * (l_discount - mx) * (l_extendedprice - my)) / sqrt(sum(l_quantity * (l_discount - mx) ** 2) * sum(l_quantity * (l_extendedprice - my) ** 2)), 6) AS effect FROM lineitem, m",
    "dsl_ols_category_control": f"{_GROUPS} SELECT 'ols' AS test_method, sum(n)::bigint AS n_observations, round(sum(sxy) / sqrt(sum(sxx) * sum(syy)), 5) AS effect FROM g",
    "avg_rank": f"SELECT helpful_votes AS value, count(*) AS ties, (sum(count(*)) OVER (ORDER BY helpful_votes) - count(*))::double + (count(*) + 1)::double / 2 AS mid_rank FROM {R} WHERE helpful_votes IS NOT NULL GROUP BY 1",
    "spearman": f"""WITH r AS (SELECT review_word_count AS a, helpful_votes AS b FROM {R} WHERE review_word_count IS NOT NULL AND helpful_votes IS NOT NULL), x AS (SELECT a, (sum(count(*)) OVER (ORDER BY a) - count(*))::double + (count(*) + 1)::double / 2 AS x FROM r GROUP BY a), y AS (SELECT b, (sum(count(*)) OVER (ORDER BY b) - count(*))::double + (count(*) + 1)::double / 2 AS y FROM r GROUP BY b)
        SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r JOIN x USING (a) JOIN y USING (b)""",
    "chi_square": f"WITH c AS (SELECT product_format AS a, verified_purchase AS b, count(*)::double AS n FROM {R} WHERE product_format IS NOT NULL AND verified_purchase IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb, sum(n) OVER () AS t FROM c) SELECT max(t)::bigint AS n, round(max(t) * (sum(n * n / (ra * cb)) - 1), 4) AS chi2, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::int AS df FROM m",
    "oneway_f": f"WITH g AS (SELECT product_format, count(*)::double AS n, avg(review_word_count) AS m, var_pop(review_word_count) AS v FROM {R} WHERE product_format IS NOT NULL AND review_word_count IS NOT NULL GROUP BY 1), s AS (SELECT sum(n) AS n, count(*) AS k, sum(n * v) AS w, sum(n * m) AS sm, sum(n * m * m) AS smm FROM g) SELECT n::bigint AS n, round(((smm - sm * sm / n) / (k - 1)) / (w / (n - k)), 5) AS f, (k - 1)::int AS df FROM s",
    "prop_z": f"WITH g AS (SELECT verified_purchase AS g, count(*)::double AS n, avg(has_image) AS m FROM {R} WHERE verified_purchase IS NOT NULL AND has_image IS NOT NULL GROUP BY 1), x AS (SELECT a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, (a.n * a.m + b.n * b.m) / (a.n + b.n) AS p FROM g a JOIN g b ON a.g < b.g) SELECT (n1 + n2)::bigint AS n, round((m2 - m1) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), 5) AS z, round(m2 - m1, 6) AS difference FROM x",
    "paired_t": f"SELECT count(*) AS n, round(avg(rating - product_avg_rating) / (stddev_samp(rating - product_avg_rating) / sqrt(count(*))), 4) AS t FROM {R} WHERE rating IS NOT NULL AND product_avg_rating IS NOT NULL",
    "kendall": f"""WITH c AS (SELECT rating::double AS a, review_question_count::double AS b, count(*)::double AS n FROM {R} WHERE rating IS NOT NULL AND review_question_count IS NOT NULL GROUP BY 1, 2), p AS (SELECT sum(CASE WHEN (x.a - y.a) * (x.b - y.b) > 0 THEN x.n * y.n END) / 2 AS con, sum(CASE WHEN (x.a - y.a) * (x.b - y.b) < 0 THEN x.n * y.n END) / 2 AS dis FROM c x, c y),
        t AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS ta, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS tb)
        SELECT n::bigint AS n, con::bigint AS concordant, dis::bigint AS discordant, round((con - dis) / sqrt((n * (n - 1) / 2 - ta) * (n * (n - 1) / 2 - tb)), 6) AS tau FROM p, t""",
    "jarque_bera": "SELECT count(*) AS n, round(sum((o_totalprice - m) ** 3) / count(*) / v ** 1.5, 6) AS skewness, round(sum((o_totalprice - m) ** 4) / count(*) / v ** 2 - 3, 5) AS kurtosis FROM orders, (SELECT avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders) GROUP BY m, v",
    "prescan_corr": " UNION ALL ".join(_pair(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]),
    "module_pair_rollup": _rollup_sql(),
    "corr_ci": "SELECT l_returnflag, n, round(r, 6) AS r, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) AS lo, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) AS hi FROM (SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1)",
}

QUERIES = {f.__name__: f for f in (dsl_assoc, dsl_diff_welch, dsl_diff_mwu, dsl_diff_kruskal, dsl_ols_control, dsl_ols_interact, dsl_heterogeneity, dsl_anova, dsl_wls, dsl_ols_category_control, dsl_logit, dsl_result, replicate, avg_rank, spearman, chi_square, oneway_f, prop_z, paired_t, kendall, jarque_bera, prescan_corr, prescan_cap, module_pair_rollup, corr_ci)}

"""The graph of findings, scores and retrieval over whole tables."""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..functions import scoring as S
from ..functions import text as T
from ..operators import graph as G
from ..operators import metrics
from ..operators import retrieval as V
from ..operators.components import connected_components
from ..session import stage, table

SEEDS = "is_seed is not true and coalesce(lower(trim(source)), '') not in ('seed_prescan', 'statistical_profiling')"


def _insights(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "insight")


def _edges(s: SparkSession, d: str) -> DataFrame:
    return G.load_relations(table(s, d, "insight_relation"), _insights(s, d))


def graph_load(s, d):
    return _edges(s, d)


def discovered(s, d):
    return _insights(s, d).where(SEEDS).select("insight_id", "source", "round_id")


def core_cols(s, d):
    return G.described(_insights(s, d)).select("insight_id", "rank", F.concat_ws(",", "core").alias("core"))


def estimand(s, d):
    return G.described(_insights(s, d)).select("insight_id", "estimand")


def conflict_pairs(s, d):
    return G.conflicts(_insights(s, d)).select("a", "b")


def classify_pairs(s, d):
    return G.classify(_edges(s, d).select("source_id", "target_id"), _insights(s, d))


def deepening_parents(s, d):
    return G.deepening_parents(_insights(s, d))


def jaccard_cols(s, d):
    """Overlap of the core columns of linked findings."""
    c = G.described(_insights(s, d)).select("insight_id", "core")
    a, b = c.select(F.col("insight_id").alias("source_id"), F.col("core").alias("ca")), c.select(F.col("insight_id").alias("target_id"), F.col("core").alias("cb"))
    return _edges(s, d).join(a, "source_id").join(b, "target_id").select("source_id", "target_id", F.round(G.jaccard(F.col("ca"), F.col("cb")), 6).alias("overlap"))


def khop(s, d):
    """What every finding builds on: along deepening, narrowing and contradicting edges, up to two of them."""
    anchors = _insights(s, d).select(F.col("insight_id").alias("node"))
    return G.k_hop(_edges(s, d), anchors, 2, "out", ["deepens", "narrows", "contradicts"])


def tiered_context(s, d):
    """Context of the three best findings."""
    anchors = _insights(s, d).where("overall_score is not null and not isnan(overall_score)").orderBy(F.desc("overall_score"), "insight_id").limit(3).select(F.col("insight_id").alias("node"))
    return G.tiered_context(_edges(s, d), anchors, _insights(s, d))


def chain(s, d):
    return G.ancestors(_edges(s, d), _insights(s, d).select(F.col("insight_id").alias("node")), "deepens", 3)


def components(s, d):
    parts = G.components_with_singles(_insights(s, d), _edges(s, d))
    return parts.groupBy("component").agg(F.count("*").alias("n"))


def component_members(s, d):
    return connected_components(_edges(s, d), "source_id", "target_id")


def graph_stats(s, d):
    return G.graph_stats(_insights(s, d), _edges(s, d))


def graph_frontiers(s, d):
    return G.frontiers(_insights(s, d))


def struct_similar(s, d):
    """For every 20th finding by number: findings about at least half the same columns."""
    i = _insights(s, d)
    return G.structurally_similar(i, i.where("cast(substr(insight_id, 5) as bigint) % 20 = 0"), 0.5).withColumn("similarity", F.round("similarity", 6))


def struct_novelty(s, d):
    i = _insights(s, d)
    return G.structural_novelty(i, i.where("is_seed is not true"))


def seed_edges(s, d):
    """Seeds of one test type, linked to the next two by effect."""
    seeds = _insights(s, d).where("is_seed").select("insight_id", "test_type", F.abs(F.nanvl("effect_size", F.lit(0.0))).alias("e"))
    return G.seed_edges(seeds.withColumn("e", F.coalesce("e", F.lit(0.0))), "test_type", ["e", "insight_id"], 2)


def merge_repeats(s, d):
    """Repeated findings, one row per normalised query, with the greatest scores."""
    i = _insights(s, d).where("dsl_sentence is not null").withColumn("dsl", T.dsl_normal(F.col("dsl_sentence")))
    return G.merge_duplicates(i, ["dsl"], ["validity_score", "novelty_score"])


def dsl_normalize(s, d):
    return _insights(s, d).select("insight_id", T.dsl_normal(F.col("dsl_sentence")).alias("dsl"), T.dsl_head(F.col("dsl_sentence")).alias("head"), T.dsl_rank(T.dsl_head(F.col("dsl_sentence"))).alias("depth"))


def reject_anti(s, d):
    """Later findings whose normalised query no earlier round has."""
    i = _insights(s, d).where("dsl_sentence is not null").select("insight_id", "created_at", T.dsl_normal(F.col("dsl_sentence")).alias("dsl"))
    old = i.where("created_at < timestamp '2024-06-01'").select("dsl").distinct()
    return i.where("created_at >= timestamp '2024-06-01'").join(old, "dsl", "left_anti").select("insight_id", "dsl")


def rediscovery(s, d):
    """How often each normalised query was found, the rounds between, and distinct pairs of columns."""
    i = _insights(s, d).where("dsl_sentence is not null and round_id is not null").select(T.dsl_normal(F.col("dsl_sentence")).alias("dsl"), "round_id")
    return i.groupBy("dsl").agg(F.count("*").alias("n"), (F.max("round_id") - F.min("round_id")).alias("span")).where("n > 1")


def bounded_log(s, d):
    """The 200 newest findings."""
    return metrics.bounded_log(_insights(s, d).where("created_at is not null").select("insight_id", "created_at").withColumn("seq", F.struct("created_at", "insight_id")), "seq", 200).select("insight_id", "created_at")


def graduate(s, d):
    log = _insights(s, d).select(F.col("insight_id").alias("id"), F.col("overall_score").alias("score"), F.lit(0).alias("tries"), F.col("dsl_sentence").alias("dsl"))
    return metrics.graduate(log.where("not isnan(score)"), "score", "tries")[0].select("id", "score")


def reject_stats(s, d):
    return _insights(s, d).groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg("overall_score"), 6).alias("mean_overall"))


def ablation_metrics(s, d):
    x = G.described(_insights(s, d)).where("round_id is not null").withColumn("arm", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")))
    return metrics.ablation(x, "arm", "estimand", 1000, "autokd")


def coverage(s, d):
    """How far each column is used more or less than the average column."""
    c = _insights(s, d).select(F.explode("column_names").alias("column")).groupBy("column").agg(F.count("*").alias("n"))
    mean = c.agg(F.avg("n").alias("mean"))
    x = c.join(F.broadcast(mean))  # one row
    return x.select("column", "n", F.when(F.col("n") > 1.5 * F.col("mean"), "over").when(F.col("n") < 0.5 * F.col("mean"), "under").otherwise("even").alias("use"))


def cooldown(s, d):
    """Columns used at least three times within the last ten rounds before each round."""
    u = _insights(s, d).where("round_id is not null").select("round_id", F.explode("column_names").alias("column")).groupBy("round_id", "column").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("column").orderBy("round_id").rangeBetween(-10, -1)
    return u.withColumn("recent", F.coalesce(F.sum("n").over(w), F.lit(0))).where("recent >= 3").select("round_id", "column", "recent")


def _evidence(s, d):
    return table(s, d, "insight").where("p_value is not null and effect_size is not null and not isnan(effect_size) and n_observations is not null")


def validity_score(s, d):
    i = _evidence(s, d)
    v = S.validity(F.col("p_value"), F.col("effect_size"), F.col("n_observations").cast("double"), F.lower("test_type"))
    return i.select("insight_id", F.round(v, 6).alias("validity"), F.round(S.p_score(F.col("p_value")), 6).alias("p_score"))


def flags(s, d):
    v = S.validity(F.col("p_value"), F.col("effect_size"), F.col("n_observations").cast("double"))
    f = S.flags(F.col("p_value"), F.col("effect_size"), F.col("n_observations"), F.lit(0.5), v)
    return _evidence(s, d).select("insight_id", F.concat_ws(",", F.array_sort(f)).alias("flags"))


def decide(s, d):
    i = _evidence(s, d).where("novelty_score is not null and not isnan(novelty_score)")
    v = S.validity(F.col("p_value"), F.col("effect_size"), F.col("n_observations").cast("double"))
    x = i.withColumn("v", v).withColumn("inter", S.interpretability(F.size("card_modules") > 1, F.contains("dsl_sentence", F.lit("controlling")), F.lower("test_type").isin("interact", "heterogeneity")))
    x = x.withColumn("total", S.overall(F.col("v"), F.col("novelty_score"), F.col("inter")))
    return x.select("insight_id", F.round("total", 5).alias("overall"), S.decide(F.col("v"), F.col("novelty_score"), F.col("total"), F.col("effect_size")).alias("decision"))


def novelty(s, d):
    n = F.col("novelty_score")
    x = _insights(s, d).where("novelty_score is not null and not isnan(novelty_score)")
    blend = S.novelty(n, S.novelty_step(n), F.col("overall_score"), F.size("column_names") < 2, F.col("is_seed"))
    return x.where("overall_score is not null and is_seed is not null").select("insight_id", F.round(blend, 6).alias("novelty"))


def rank_score(s, d):
    return _insights(s, d).select("insight_id", F.round(S.ranking(F.col("novelty_score"), F.col("validity_score")), 6).alias("score"))


def quality_topk(s, d):
    x = _insights(s, d).where(SEEDS).where("overall_score >= 0.5 and validity_score >= 0.5")
    return x.orderBy(F.desc("overall_score"), "insight_id").limit(20).select("insight_id", "overall_score")


def quality_reorder(s, d):
    q = S.quality(F.col("overall_score"), F.col("validity_score"), F.col("is_seed").eqNullSafe(F.lit(True)))
    return _insights(s, d).select("insight_id", F.round(q, 6).alias("quality")).orderBy(F.desc("quality"), "insight_id").limit(50)


def cosine_topk(s, d):
    """Every vector whose id is divisible by 20 against all others."""
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return V.cosine_topk(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), 5).select("query_id", "item_id", F.round("similarity", 5).alias("similarity"), "rank")


STOP = ["the", "of", "and", "in", "to", "is", "for", "by", "with", "that", "when", "than", "does", "or", "as", "any", "how", "at"]


def tfidf_topk(s, d):
    """The three nearest evaluation items of each finding by tf-idf."""
    cards = table(s, d, "eval_query").select(F.col("query_id").alias("doc_id"), F.col("gold_claim").alias("text"))
    q = _insights(s, d).where("sentence is not null").select(F.col("insight_id").alias("query_id"), F.col("sentence").alias("text"))
    return V.tfidf_topk(cards, q, 3, STOP).select("query_id", "doc_id", F.round("score", 5).alias("score"))


def grounding(s, d):
    """Whether the column names of each finding occur among the evaluation items."""
    cards = table(s, d, "eval_query").select(F.col("query_id").alias("doc_id"), F.col("query_text").alias("text"))
    p = _insights(s, d).select(F.col("insight_id").alias("query_id"), F.posexplode("column_names").alias("phrase_id", "text"))
    return V.grounding(p.withColumn("text", F.replace("text", F.lit("_"), F.lit(" "))), cards)


def _vectors(s, d):
    """Vectors stand for findings by their order, as the tables hold no vectors of findings."""
    return table(s, d, "embeddings").select(F.concat(F.lit("ins_"), (F.col("vec_id") + 1000000000).cast("string")).alias("node"), F.col("embedding").alias("v"))


def seed_expand(s, d):
    v = _vectors(s, d).join(_insights(s, d).select(F.col("insight_id").alias("node"), F.col("validity_score").alias("validity")), "node")
    q = table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return V.seed_expand(q, v.select("node", "v", "validity"), _edges(s, d))


def diverse_topk(s, d):
    """Twenty good findings no two of which are alike."""
    x = _insights(s, d).where(SEEDS).select(F.col("insight_id").alias("node"), F.round(S.ranking(F.col("novelty_score"), F.col("validity_score")), 6).alias("score"))
    chosen = V.diverse_greedy(stage(x.join(_vectors(s, d), "node"), "scored"), 20, 0.4)
    return s.createDataFrame([(i, *c) for i, c in enumerate(chosen, 1)], "rank int, node string, score double")


def pairing(s, d, most: int = 4000):
    """The vectors of two labels paired one to one with the greatest total similarity; the solve is bounded."""
    e = table(s, d, "embeddings").where("label in (0, 1)").orderBy("vec_id").limit(most + 1).collect()
    if len(e) > most:
        raise ValueError(f"more than {most} vectors to pair")
    a, b = ([r for r in e if r.label == k] for k in (0, 1))
    unit = lambda rows: np.array([np.array(r.embedding) / (np.linalg.norm(r.embedding) or 1) for r in rows])
    sim = unit(a) @ unit(b).T
    return s.createDataFrame([(a[i].vec_id, b[j].vec_id, round(float(sim[i, j]), 6)) for i, j in V.assign(-sim)], "a long, b long, similarity double")


def embedding_dedup(s, d):
    """A search for near vectors: each whose id is divisible by 20 with the five nearest at a similarity of 0.65 or more.

    All links are in ``embedding_links``.
    """
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return V.cosine_topk(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), 5, least=0.65).select("query_id", "item_id", F.round("similarity", 5).alias("similarity"))


def embedding_links(s, d):
    """All pairs of vectors at a similarity of 0.65 or more."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))
    return V.near_pairs(e, 0.65).select("item_a", "item_b", F.round("similarity", 5).alias("similarity"))


def citations(s, d):
    """Numbers of references in documents, such as "Q12."."""
    t = table(s, d, "documents").where("text is not null")
    return t.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\bQ(\d+)\."), F.lit(1))).alias("item")).groupBy("item").agg(F.count_distinct("doc_id").alias("docs"))


def theme_infer(s, d):
    """Themes of documents by keywords: the theme with most hits, ties by name."""
    t = table(s, d, "documents").where("text is not null").select("doc_id", F.lower("text").alias("t"))
    hits = t.select("doc_id", F.inline(F.array(*(F.struct(F.lit(k).alias("theme"), sum((F.regexp_count("t", F.lit(w)) for w in ws[1:]), F.regexp_count("t", F.lit(ws[0]))).alias("hits")) for k, ws in THEMES.items())))).where("hits > 0")
    best = hits.groupBy("doc_id").agg(F.max(F.struct("hits", "theme")).alias("x"))
    return best.groupBy(F.col("x.theme").alias("theme")).agg(F.count("*").alias("docs"), F.sum("x.hits").alias("hits"))


def dup_filter(s, d):
    """Findings that earlier ones already say, by query or by structure."""
    i = _insights(s, d)
    return G.duplicates(i, i)


def anchor_sets(s, d):
    return G.anchor_sets(_insights(s, d), _edges(s, d))


def composite_related(s, d):
    """For every 20th vector: findings that are alike, share columns and aren't hubs."""
    v = _vectors(s, d).join(_insights(s, d).select(F.col("insight_id").alias("node")), "node")
    q = v.where("cast(substr(node, 5) as bigint) % 20 = 0").select(F.col("node").alias("query_id"), F.col("v").alias("qv"))
    sim = v.join(F.broadcast(q), F.col("node") != F.col("query_id")).select("query_id", F.col("node").alias("insight_id"), F.round(V.scaled(V.cosine(F.col("qv"), F.col("v"))), 6).alias("similarity"))
    return G.composite_related(_insights(s, d), _edges(s, d), sim, low=0.55)


def findings_text(s, d):
    """Sentences of findings with their numbers, made from the queries."""
    from ..functions.render import sentence
    from ..plans.grammar import GrammarError, parse

    @F.udf("string")
    def say(dsl, columns, effect, p, n):
        try:
            spec = parse(dsl or "", list(columns or []) + _names(dsl))
        except GrammarError:
            return None
        ok = effect is not None and effect == effect
        return sentence(spec, {}, effect if ok else None, p, n)

    return _insights(s, d).select("insight_id", say("dsl_sentence", "column_names", "effect_size", "p_value", "n_observations").alias("text"))


def _names(dsl: str | None) -> list[str]:
    import re

    return re.findall(r"[A-Za-z_][A-Za-z0-9_]*", dsl or "")


THEMES = {"books": ["novel", "chapter", "plot"], "survey": ["trust", "religio", "voting"], "science": ["citation", "author", "paper"]}

_CORE = """list_sort(CASE WHEN len(list_filter(list_distinct(list_filter([lower(parsed.x), lower(parsed.y), lower(parsed.grp), lower(parsed.moderator)], lambda c: c IS NOT NULL)), lambda c: NOT list_contains(st, c))) > 0
 THEN list_filter(list_distinct(list_filter([lower(parsed.x), lower(parsed.y), lower(parsed.grp), lower(parsed.moderator)], lambda c: c IS NOT NULL)), lambda c: NOT list_contains(st, c))
 ELSE list_filter(list_distinct(list_transform(coalesce(column_names, []), lambda c: lower(c))), lambda c: NOT list_contains(st, c)) END)"""
_RANK = "CASE WHEN lower({0}) IN ('assoc', 'diff', 'correlation') THEN 1 WHEN lower({0}) IN ('interact', 'interaction') THEN 2 WHEN lower({0}) = 'heterogeneity' THEN 3 ELSE 0 END"
_EST = """CASE WHEN parsed.x IS NOT NULL AND parsed.y IS NOT NULL AND lower(test_type) <> 'diff' THEN lower(test_type) || '|' || least(lower(parsed.x), lower(parsed.y)) || '|' || greatest(lower(parsed.x), lower(parsed.y)) || '|' || coalesce(lower(parsed.moderator), '-') || '|' || coalesce(lower(parsed.grp), '-') END"""
_D = f"""d AS (SELECT *, {_RANK.format('test_type')} AS rk, {_CORE} AS core, {_EST} AS est, list_sort(list_distinct(map_values(card_modules))) AS mods,
 CASE WHEN p_value < 0.05 AND isfinite(effect_size) AND effect_size <> 0 THEN effect_size END AS eff FROM insight, (SELECT [{', '.join(f"'{c}'" for c in G.STRUCTURAL)}] AS st))"""
_E = """e AS (SELECT source_id, target_id, arg_max(t, (linked_at, t)) AS relation_type, max(linked_at) AS linked_at FROM (SELECT *, CASE lower(trim(relation_type)) WHEN 'supports' THEN 'extends' WHEN 'refines' THEN 'narrows' ELSE lower(trim(relation_type)) END AS t FROM insight_relation)
 WHERE t IN ('deepens', 'extends', 'narrows', 'contradicts') AND source_id <> target_id AND source_id IN (SELECT insight_id FROM insight) AND target_id IN (SELECT insight_id FROM insight) GROUP BY 1, 2)"""
_NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '[\[\]]', '', 'g'), '\s+', ' ', 'g'))"
_ASSOC = r"'^assoc\s*\(\s*([^,()]+?)\s*,\s*([^,()]+?)\s*\)(.*)$'"
_DSL = f"""CASE WHEN regexp_matches({_NORMAL}, {_ASSOC}) THEN 'assoc(' || least(regexp_extract({_NORMAL}, {_ASSOC}, 1), regexp_extract({_NORMAL}, {_ASSOC}, 2)) || ', ' || greatest(regexp_extract({_NORMAL}, {_ASSOC}, 1), regexp_extract({_NORMAL}, {_ASSOC}, 2)) || ')' || regexp_extract({_NORMAL}, {_ASSOC}, 3) ELSE {_NORMAL} END""".format("dsl_sentence")
_P = "CASE WHEN p_value < 0.001 THEN 1.0 WHEN p_value < 0.01 THEN 1.0 - (p_value - 0.001) / 0.009 * 0.05 WHEN p_value < 0.05 THEN 0.95 - (p_value - 0.01) / 0.04 * 0.10 WHEN p_value < 0.1 THEN 0.75 - (p_value - 0.05) / 0.05 * 0.10 ELSE 0.75 * exp(-3 * (p_value - 0.1)) END"
_W = "(0.3 + 0.5 / (1 + (n_observations / 1000.0) ** 1.5))"
_V0 = f"({_W} * ({_P}) + (1 - {_W}) / (1 + exp(-8 * (abs(effect_size) - 0.12))))"
_FLOOR = f"(CASE WHEN lower(test_type) IN ('interact', 'heterogeneity') AND n_observations > 1000 AND abs(effect_size) < 0.03 THEN least({_V0}, 0.5) ELSE {_V0} END)"
_V = "greatest(0, least(1, CASE WHEN p_value >= 0.05 THEN least({0}, 0.3) ELSE {0} END))"
_EVIDENCE = "p_value IS NOT NULL AND isfinite(effect_size) AND n_observations IS NOT NULL"
_NOTSEED = "is_seed IS NOT TRUE AND coalesce(lower(trim(source)), '') NOT IN ('seed_prescan', 'statistical_profiling')"
_RULES = [("very_high_p_value", "p_value > 0.1"), ("high_p_value", "p_value > 0.05 AND p_value <= 0.1"), ("very_low_p_value", "p_value < 0.001"), ("very_small_effect_size", "e < 0.05"), ("small_effect_size", "e >= 0.05 AND e < 0.1"), ("very_large_effect_size", "e > 1"), ("extremely_small_sample_size", "n < 10"), ("very_small_sample_size", "n >= 10 AND n < 30"), ("small_sample_for_small_effect", "e < 0.1 AND n < 100"), ("moderate_sample_size", "n >= 30 AND n < 100"), ("very_low_validity", "v < 0.3"), ("low_validity", "v >= 0.3 AND v < 0.5"), ("possible_low_power", "p_value > 0.05 AND p_value <= 0.1 AND n < 100")]
_SIM = "(list_cosine_similarity({0}::double[], {1}::double[]) + 1) / 2"
_STOPS = ", ".join(f"'{w}'" for w in STOP)
_TERMS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{_STOPS}], w))"
_TFIDF = f"""WITH cards AS (SELECT query_id AS id, {_TERMS} AS w FROM (SELECT query_id, gold_claim AS text FROM eval_query)), qs AS (SELECT insight_id AS id, {_TERMS} AS w FROM (SELECT insight_id, sentence AS text FROM insight WHERE sentence IS NOT NULL)),
 ct AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM cards) GROUP BY 1, 2), qt AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM qs) GROUP BY 1, 2),
 idf AS (SELECT t, ln((1 + (SELECT count(*) FROM cards)) / (1 + count(*))) + 1 AS idf FROM ct GROUP BY 1), cw AS (SELECT id, t, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id)) AS w FROM ct JOIN idf USING (t)), qw AS (SELECT id, t, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id)) AS w FROM qt JOIN idf USING (t)),
 sc AS (SELECT qw.id AS query_id, cw.id AS doc_id, round(sum(qw.w * cw.w), 9) AS s FROM cw JOIN qw USING (t) GROUP BY 1, 2) SELECT query_id, doc_id, round(s, 5) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) <= 3"""

SQL = {
    "graph_load": f"WITH {_E} SELECT * FROM e",
    "discovered": f"SELECT insight_id, source, round_id FROM insight WHERE {_NOTSEED}",
    "core_cols": f"WITH {_D} SELECT insight_id, rk AS rank, array_to_string(core, ',') AS core FROM d",
    "estimand": f"WITH {_D} SELECT insight_id, est AS estimand FROM d",
    "conflict_pairs": f"WITH {_D} SELECT a.insight_id AS a, b.insight_id AS b FROM d a JOIN d b ON a.est = b.est AND a.insight_id < b.insight_id WHERE sign(a.eff) <> sign(b.eff)",
    "classify_pairs": f"WITH {_D}, {_E} SELECT source_id, target_id, CASE WHEN a.est = b.est AND sign(a.eff) <> sign(b.eff) THEN 'contradicts' WHEN a.rk > b.rk AND b.rk > 0 AND len(b.core) > 0 AND len(list_filter(b.core, lambda c: NOT list_contains(a.core, c))) = 0 THEN 'deepens' WHEN len(a.mods) > 0 AND len(b.mods) > 0 AND NOT list_has_any(a.mods, b.mods) THEN 'extends' ELSE 'narrows' END AS relation FROM e JOIN d a ON source_id = a.insight_id JOIN d b ON target_id = b.insight_id",
    "deepening_parents": f"WITH {_D}, p AS (SELECT a.insight_id AS child, b.insight_id AS parent, row_number() OVER (PARTITION BY a.insight_id ORDER BY b.rk DESC, len(b.core) DESC, b.insight_id) AS n FROM d a JOIN d b ON b.rk > 0 AND b.rk < a.rk AND len(b.core) > 0 AND len(b.core) < len(a.core) AND list_has_all(a.core, b.core)) SELECT * FROM p WHERE n <= 3",
    "jaccard_cols": f"WITH {_D}, {_E} SELECT source_id, target_id, round(CASE WHEN len(list_distinct(a.core || b.core)) = 0 THEN 0 ELSE len(list_intersect(a.core, b.core))::double / len(list_distinct(a.core || b.core)) END, 6) AS overlap FROM e JOIN d a ON source_id = a.insight_id JOIN d b ON target_id = b.insight_id",
    "khop": f"""WITH {_E}, u AS (SELECT source_id AS a, target_id AS b FROM e WHERE relation_type <> 'extends'), h AS (SELECT a AS anchor, b AS node, 1 AS hop FROM u UNION ALL SELECT x.a, y.b, 2 FROM u x JOIN u y ON x.b = y.a) SELECT anchor, node, min(hop)::int AS hop FROM h WHERE node <> anchor GROUP BY 1, 2""",
    "chain": f"WITH {_E}, f AS (SELECT source_id AS a, min(target_id) AS b FROM e WHERE relation_type = 'deepens' GROUP BY 1), c1 AS (SELECT a AS start, 1 AS depth, b AS node FROM f), c2 AS (SELECT start, 2 AS depth, b AS node FROM c1 JOIN f ON node = a WHERE b <> start), c3 AS (SELECT start, 3 AS depth, b AS node FROM c2 JOIN f ON node = a WHERE b <> start) SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3",
    "graph_frontiers": f"WITH {_D}, m AS (SELECT DISTINCT unnest(mods) AS m FROM d), p AS (SELECT a.m AS module_a, b.m AS module_b FROM m a JOIN m b ON a.m < b.m) SELECT module_a, module_b, count(insight_id) AS n FROM p LEFT JOIN d ON list_contains(mods, module_a) AND list_contains(mods, module_b) GROUP BY 1, 2",
    "struct_similar": f"WITH {_D}, q AS (SELECT insight_id AS query_id, core AS qc FROM d WHERE substr(insight_id, 5)::bigint % 20 = 0), x AS (SELECT query_id, insight_id, len(list_intersect(core, qc))::double / len(list_distinct(core || qc)) AS s FROM q JOIN d ON query_id <> insight_id WHERE len(core) > 0 AND len(qc) > 0) SELECT query_id, insight_id, round(s, 6) AS similarity FROM x WHERE s >= 0.5",
    "struct_novelty": f"WITH {_D}, x AS (SELECT a.insight_id, len(a.core) AS k, len(a.mods) AS m, list_sort(list_distinct(list_transform(list_filter(any_value(a.core), lambda c: regexp_matches(c, '^Q[0-9]+')), lambda c: regexp_extract(c, '^Q([0-9]+)', 1)::bigint))) AS q, coalesce(max(len(list_intersect(a.core, b.core))::double / len(list_distinct(a.core || b.core))), 0) AS best FROM d a LEFT JOIN d b ON b.created_at < a.created_at AND len(b.core) > 0 AND list_has_any(a.core, b.core) WHERE a.is_seed IS NOT TRUE GROUP BY 1, 2, 3) SELECT insight_id, round(CASE WHEN k = 0 THEN 0.5 WHEN len(q) >= 2 AND list_min(list_transform(range(1, len(q)), lambda i: q[i + 1] - q[i])) <= 3 THEN 0.1 WHEN m = 1 AND k >= 2 THEN 0.15 WHEN best = 1 THEN 0.1 ELSE 1 - best END, 6) AS novelty FROM x",
    "seed_edges": "WITH s AS (SELECT insight_id, test_type, CASE WHEN isfinite(effect_size) THEN abs(effect_size) ELSE 0 END AS e FROM insight WHERE is_seed), r AS (SELECT insight_id, test_type, row_number() OVER (PARTITION BY test_type ORDER BY e, insight_id) AS k FROM s) SELECT a.insight_id AS source_id, b.insight_id AS target_id FROM r a JOIN r b ON a.test_type IS NOT DISTINCT FROM b.test_type AND b.k - a.k BETWEEN 1 AND 2",
    "merge_repeats": f"SELECT {_DSL} AS dsl, arg_min(insight_id, (created_at, insight_id)) AS insight_id, count(*) AS n, max(CASE WHEN isfinite(validity_score) THEN validity_score END) AS validity_score, max(CASE WHEN isfinite(novelty_score) THEN novelty_score END) AS novelty_score FROM insight WHERE dsl_sentence IS NOT NULL GROUP BY 1",
    "dsl_normalize": f"SELECT insight_id, {_DSL} AS dsl, lower(regexp_extract(trim(dsl_sentence), '^(\\w+)\\s*\\(', 1)) AS head, {_RANK.format(chr(114) + 'egexp_extract(trim(dsl_sentence), ' + repr('^(' + chr(92) + 'w+)' + chr(92) + 's*' + chr(92) + '(').replace(chr(92) * 2, chr(92)) + ', 1)')} AS depth FROM insight",
    "reject_anti": f"WITH i AS (SELECT insight_id, created_at, {_DSL} AS dsl FROM insight WHERE dsl_sentence IS NOT NULL) SELECT insight_id, dsl FROM i WHERE created_at >= TIMESTAMP '2024-06-01' AND dsl NOT IN (SELECT dsl FROM i WHERE created_at < TIMESTAMP '2024-06-01')",
    "rediscovery": f"SELECT {_DSL} AS dsl, count(*) AS n, max(round_id) - min(round_id) AS span FROM insight WHERE dsl_sentence IS NOT NULL AND round_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "bounded_log": "SELECT insight_id, created_at FROM insight WHERE created_at IS NOT NULL ORDER BY created_at DESC, insight_id DESC LIMIT 200",
    "graduate": "SELECT insight_id AS id, overall_score AS score FROM insight WHERE overall_score >= 0.5 AND isfinite(overall_score) AND length(trim(dsl_sentence)) > 0 ORDER BY 2 DESC, 1 LIMIT 3",
    "reject_stats": "SELECT coalesce(lower(trim(source)), 'unknown') AS reason, count(*) AS n, round(avg(overall_score), 6) AS mean_overall FROM insight GROUP BY 1",
    "ablation_metrics": f"WITH {_D}, a AS (SELECT coalesce(lower(trim(source)), 'unknown') AS arm, count(*) AS n, count(DISTINCT est) AS different, count(est) - count(DISTINCT est) AS repeated, avg(CASE WHEN rk >= 2 THEN 1.0 ELSE 0.0 END) AS deep FROM d WHERE round_id <= 1000 GROUP BY 1) SELECT arm, n, different, repeated, round(deep, 6) AS deep_share, round(different::double / n, 6) AS different_share, round(different::double / n - (SELECT different::double / n FROM a WHERE arm = 'autokd'), 6) AS delta FROM a",
    "coverage": "WITH c AS (SELECT c AS \"column\", count(*) AS n FROM (SELECT unnest(column_names) AS c FROM insight) GROUP BY 1) SELECT \"column\", n, CASE WHEN n > 1.5 * (SELECT avg(n) FROM c) THEN 'over' WHEN n < 0.5 * (SELECT avg(n) FROM c) THEN 'under' ELSE 'even' END AS use FROM c",
    "cooldown": "WITH u AS (SELECT round_id, c AS \"column\", count(*) AS n FROM (SELECT round_id, unnest(column_names) AS c FROM insight WHERE round_id IS NOT NULL) GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY \"column\" ORDER BY round_id RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), 0)::bigint AS recent FROM u) SELECT round_id, \"column\", recent FROM w WHERE recent >= 3",
    "validity_score": f"SELECT insight_id, round({_V.format(_FLOOR)}, 6) AS validity, round({_P}, 6) AS p_score FROM insight WHERE {_EVIDENCE}",
    "flags": f"WITH x AS (SELECT *, abs(effect_size) AS e, n_observations AS n, {_V.format(_V0)} AS v FROM insight WHERE {_EVIDENCE}) SELECT insight_id, array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{k}{chr(39)} END' for k, c in _RULES)}], lambda f: f IS NOT NULL)), ',') AS flags FROM x",
    "decide": f"""WITH x AS (SELECT *, {_V.format(_V0)} AS v, 0.5 + CASE WHEN cardinality(card_modules) > 1 THEN 0.2 ELSE 0 END + CASE WHEN contains(dsl_sentence, 'controlling') THEN 0.15 ELSE 0 END + CASE WHEN lower(test_type) IN ('interact', 'heterogeneity') THEN 0.15 ELSE 0 END AS i FROM insight WHERE {_EVIDENCE} AND novelty_score IS NOT NULL AND isfinite(novelty_score)), t AS (SELECT *, 0.5 * v + 0.4 * novelty_score + 0.1 * i AS o FROM x)
        SELECT insight_id, round(o, 5) AS overall, CASE WHEN v < 0.4 THEN CASE WHEN o >= 0.45 THEN 'refine' ELSE 'reject' END WHEN novelty_score < 0.30 THEN CASE WHEN v >= 0.70 AND o >= 0.45 THEN 'refine' ELSE 'reject' END WHEN o >= 0.55 THEN CASE WHEN abs(effect_size) >= 0.03 THEN 'accept' ELSE 'refine' END WHEN o >= 0.45 THEN 'refine' ELSE 'reject' END AS decision FROM t""",
    "novelty": "WITH x AS (SELECT *, 0.25 * novelty_score + 0.25 * CASE WHEN novelty_score >= 0.85 THEN 0.2 WHEN novelty_score >= 0.7 THEN 0.6 ELSE 0.75 END + 0.5 * overall_score AS b FROM insight WHERE novelty_score IS NOT NULL AND isfinite(novelty_score) AND overall_score IS NOT NULL AND is_seed IS NOT NULL) SELECT insight_id, round(CASE WHEN len(column_names) < 2 THEN 0 WHEN is_seed THEN least(b, 0.4) ELSE b END, 6) AS novelty FROM x",
    "rank_score": "SELECT insight_id, round(novelty_score * least(1, validity_score / 0.6), 6) AS score FROM insight",
    "quality_topk": f"SELECT insight_id, overall_score FROM insight WHERE {_NOTSEED} AND overall_score >= 0.5 AND validity_score >= 0.5 ORDER BY 2 DESC, 1 LIMIT 20",
    "quality_reorder": "SELECT insight_id, round(0.7 * CASE WHEN is_seed IS TRUE THEN 1.0 ELSE 0.5 END + 0.3 * (0.6 * coalesce(overall_score, 0) + 0.4 * coalesce(validity_score, 0)), 6) AS quality FROM insight ORDER BY 2 DESC, 1 LIMIT 50",
    "cosine_topk": f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_SIM.format('a.embedding', 'b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM s) SELECT query_id, item_id, round(s, 5) AS similarity, rank FROM r WHERE rank <= 5",
    "embedding_dedup": f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_SIM.format('a.embedding', 'b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT query_id, item_id, round(s, 5) AS similarity FROM s WHERE s >= 0.65 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) <= 5",
    "embedding_links": f"WITH s AS (SELECT a.vec_id AS item_a, b.vec_id AS item_b, {_SIM.format('a.embedding', 'b.embedding')} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) SELECT item_a, item_b, round(s, 5) AS similarity FROM s WHERE s >= 0.65",
    "tfidf_topk": _TFIDF,
    "citations": "SELECT item, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\bQ(\\d+)\\.', 1)) AS item FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "theme_infer": "WITH h AS (SELECT doc_id, theme, hits FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS theme, " + " + ".join(f"len(regexp_extract_all(lower(text), '{w}'))" for w in ws) + " AS hits FROM documents WHERE text IS NOT NULL" for k, ws in THEMES.items()) + ") WHERE hits > 0), b AS (SELECT doc_id, theme, hits FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, theme DESC) = 1) SELECT theme, count(*) AS docs, sum(hits)::bigint AS hits FROM b GROUP BY 1",
    "component_members": f"WITH RECURSIVE {_E}, u AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e), r AS (SELECT a AS n, a AS m FROM u UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a) SELECT n AS node, min(m) AS component FROM r GROUP BY 1",
    "graph_stats": f"""WITH RECURSIVE {_E}, u AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e), r AS (SELECT insight_id AS n, insight_id AS m FROM insight UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a), c AS (SELECT k, count(*) AS n FROM (SELECT n, min(m) AS k FROM r GROUP BY 1) GROUP BY 1)
        SELECT (SELECT count(*) FROM c) AS clusters, (SELECT max(n) FROM c) AS largest_cluster, (SELECT count(DISTINCT insight_id) FROM insight) AS nodes, count(*) AS edges, {', '.join(f"count(*) FILTER (relation_type = '{t}') AS n_{t}" for t in G.RELATIONS)},
        (SELECT max(k) FROM (SELECT count(*) AS k FROM e GROUP BY target_id)) AS max_in_degree, round(2.0 * count(*) / (SELECT count(DISTINCT insight_id) FROM insight), 6)::double AS mean_degree FROM e""",
    "tiered_context": f"""WITH {_E}, s AS (SELECT insight_id AS n FROM insight WHERE isfinite(overall_score) ORDER BY overall_score DESC, insight_id LIMIT 3), u AS (SELECT source_id AS a, target_id AS b, relation_type AS k FROM e UNION SELECT target_id, source_id, relation_type FROM e),
        h AS (SELECT b AS node, 0 AS tier, 1 AS hop FROM s JOIN u ON n = a AND k = 'deepens' UNION ALL SELECT y.b, 0, 2 FROM s JOIN u x ON n = x.a AND x.k = 'deepens' JOIN u y ON x.b = y.a AND y.k = 'deepens' UNION ALL SELECT b, CASE k WHEN 'narrows' THEN 1 WHEN 'extends' THEN 2 ELSE 3 END, 1 FROM s JOIN u ON n = a AND k <> 'deepens'),
        f AS (SELECT node, min((tier, hop)) AS x FROM h WHERE node NOT IN (SELECT n FROM s) GROUP BY 1) SELECT node, x[1] AS tier, x[2] AS hop, row_number() OVER (ORDER BY x, created_at, node) AS rank FROM f JOIN insight ON node = insight_id QUALIFY row_number() OVER (ORDER BY x, created_at, node) <= 10""",
    "seed_expand": f"""WITH {_E}, v AS (SELECT 'ins_' || (vec_id + 1000000000)::varchar AS node, embedding AS v FROM embeddings), s AS (SELECT vec_id AS query_id, node, round({_SIM.format('embedding', 'v')}, 6) AS sim, validity_score AS val FROM v JOIN insight ON node = insight_id, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0)),
        f AS (SELECT query_id, node FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, node) <= 5), u AS (SELECT source_id AS a, target_id AS b FROM e UNION ALL SELECT target_id, source_id FROM e), p AS (SELECT query_id, node FROM f UNION SELECT query_id, b FROM f JOIN u ON node = a),
        x AS (SELECT query_id, node, round(0.6 * sim + 0.4 * coalesce(val, 0), 6) AS score FROM p JOIN s USING (query_id, node)) SELECT query_id, node, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) <= 10""",
    "composite_related": f"""WITH {_D}, {_E}, v AS (SELECT 'ins_' || (vec_id + 1000000000)::varchar AS node, embedding AS v FROM embeddings), g AS (SELECT target_id, count(*) AS k FROM e GROUP BY 1),
        m AS (SELECT a.node AS query_id, b.node AS insight_id, round({_SIM.format('a.v', 'b.v')}, 6) AS s FROM v a JOIN v b ON a.node <> b.node WHERE substr(a.node, 5)::bigint % 20 = 0),
        x AS (SELECT query_id, m.insight_id, round(0.4 * (s - 0.55) / (0.92 - 0.55) + 0.3 * CASE WHEN len(list_distinct(y.core || z.core)) = 0 THEN 0 ELSE len(list_intersect(y.core, z.core))::double / len(list_distinct(y.core || z.core)) END + 0.3 / (1 + ln(1 + coalesce(k, 0))), 6) AS score FROM m JOIN d y ON query_id = y.insight_id JOIN d z ON m.insight_id = z.insight_id LEFT JOIN g ON target_id = m.insight_id WHERE s >= 0.55 AND s < 0.92 AND coalesce(k, 0) < 15)
        SELECT query_id, insight_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, insight_id) AS n FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, insight_id) <= 3""",
    "dup_filter": f"""WITH {_D}, x AS (SELECT *, {_DSL} AS dsl FROM d), a AS (SELECT DISTINCT a.insight_id, 0 AS r FROM x a JOIN x b ON a.dsl = b.dsl AND b.created_at < a.created_at), b AS (SELECT DISTINCT a.insight_id, 2 AS r FROM x a JOIN x b ON b.created_at < a.created_at AND a.rk <= b.rk AND len(a.core) > 0 AND len(b.core) > 0 AND list_has_any(a.core, b.core)
        WHERE len(list_intersect(a.core, b.core))::double / len(list_distinct(a.core || b.core)) >= 0.8) SELECT insight_id, CASE min(r) WHEN 0 THEN 'CROSS_ROUND_DUPLICATE' ELSE 'STRUCTURAL_DUPLICATE' END AS reason FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""",
    "anchor_sets": f"""WITH {_D}, {_E}, n AS (SELECT source_id AS i, target_id AS o FROM e UNION ALL SELECT target_id, source_id FROM e), m AS (SELECT m, count(*) > 0.25 * (SELECT count(*) FROM d) AS f FROM (SELECT unnest(mods) AS m FROM d) GROUP BY 1)
        SELECT insight_id, EXISTS (SELECT 1 FROM n JOIN d y ON n.o = y.insight_id WHERE n.i = d.insight_id AND len(d.mods) > 0 AND len(list_filter(y.mods, lambda z: NOT list_contains(d.mods, z))) > 0) AS boundary, lower(test_type) = 'assoc' AND NOT EXISTS (SELECT 1 FROM e WHERE target_id = d.insight_id AND relation_type = 'deepens') AS depth,
        NOT EXISTS (SELECT 1 FROM n WHERE n.i = d.insight_id) AS isolated, coalesce((SELECT max(k) FROM (SELECT i, count(*) AS k FROM n GROUP BY 1) c WHERE c.i = d.insight_id), 0) < 3 AS underexplored, len(mods) > 0 AND coalesce(list_has_all((SELECT list(m.m) FROM m WHERE m.f), mods), false) AS saturated FROM d""",
    "components": f"WITH RECURSIVE {_E}, u AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e), r AS (SELECT insight_id AS n, insight_id AS m FROM insight UNION SELECT r.n, u.b FROM r JOIN u ON r.m = u.a), c AS (SELECT n, min(m) AS component FROM r GROUP BY 1) SELECT component, count(*) AS n FROM c GROUP BY 1",
}

QUERIES = {f.__name__: f for f in (graph_load, discovered, core_cols, estimand, conflict_pairs, classify_pairs, deepening_parents, jaccard_cols, khop, tiered_context, chain, components, component_members, graph_stats, graph_frontiers, struct_similar, struct_novelty, seed_edges, merge_repeats, dsl_normalize, reject_anti, rediscovery, bounded_log, graduate, reject_stats, ablation_metrics, coverage, cooldown, validity_score, flags, decide, novelty, rank_score, quality_topk, quality_reorder, cosine_topk, tfidf_topk, grounding, seed_expand, diverse_topk, pairing, embedding_dedup, embedding_links, citations, theme_infer, dup_filter, anchor_sets, composite_related, findings_text)}

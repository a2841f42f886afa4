"""The typed graph of findings: ``insights`` and ``relations`` as tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.text import dsl_rank
from ..session import stage
from .components import connected_components

RELATIONS = ("deepens", "extends", "narrows", "contradicts")
# Relations of earlier versions and what they are now.
LEGACY = {"supports": "extends", "refines": "narrows"}
# Columns about weights, places, dates and persons, which no finding is about.
STRUCTURAL = (
    "w_weight", "pwght", "sampling_weight", "b_country", "b_country_alpha", "h_urbrural", "fw_start", "fw_end", "a_year",
    "age", "sex", "gender", "income", "income_status", "education_level", "employment_status", "survey_year", "urban vs rural residence",
)


def load_relations(raw: DataFrame, insights: DataFrame | None = None) -> DataFrame:
    """``source_id, target_id, relation_type, linked_at``: one edge per ordered pair, the last written.

    Types are put in lower case, old ones renamed, unknown and null ones dropped; edges to unknown insights
    and self-loops are dropped. Edges written at the same time go by the type's name.
    """
    kind = F.lower(F.trim("relation_type"))
    for old, new in LEGACY.items():
        kind = F.when(kind == old, new).otherwise(kind)
    e = raw.withColumn("relation_type", kind).where(F.col("relation_type").isin(*RELATIONS) & (F.col("source_id") != F.col("target_id")))
    if insights is not None:
        ids = insights.select("insight_id")
        e = e.join(ids.withColumnRenamed("insight_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("insight_id", "target_id"), "target_id", "left_semi")
    last = F.max(F.struct("linked_at", "relation_type")).alias("x")
    return e.groupBy("source_id", "target_id").agg(last).select("source_id", "target_id", "x.relation_type", "x.linked_at")


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` with those of ``new`` in place of any between the same two insights."""
    rest = edges.join(new.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    return rest.unionByName(new.select(*edges.columns))


def _directed(edges: DataFrame, direction: str, types: list[str] | None) -> DataFrame:
    e = edges if types is None else edges.where(F.col("relation_type").isin(*types))
    out = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    back = e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction].distinct()


def k_hop(edges: DataFrame, anchors: DataFrame, hops: int, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """``anchor, node, hop``: every node within ``hops`` edges of an anchor, with its least distance.

    ``anchors`` has ``node``. The frontier is joined to the edges once per hop and stripped of nodes seen.
    Anchors themselves aren't listed.
    """
    e = stage(_directed(edges, direction, types), "edges")
    seen = stage(anchors.select(F.col("node").alias("anchor"), F.col("node").alias("node"), F.lit(0).alias("hop")).distinct(), "seen")
    frontier = seen
    for h in range(1, hops + 1):
        step = frontier.join(e, frontier.node == e.a).select("anchor", F.col("b").alias("node")).distinct()
        frontier = stage(step.join(seen, ["anchor", "node"], "left_anti").withColumn("hop", F.lit(h)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def tiered_context(edges: DataFrame, anchors: DataFrame, insights: DataFrame, budget: int = 10) -> DataFrame:
    """``node, tier, hop, rank``: context of anchors by kind of relation, at most ``budget``.

    Tiers: deepens over two hops, then narrows, extends and contradicts over one. Within a tier by hop,
    creation and id; a node counts in its first tier.
    """
    tiers = None
    for tier, (kind, hops) in enumerate((("deepens", 2), ("narrows", 1), ("extends", 1), ("contradicts", 1))):
        t = k_hop(edges, anchors, hops, "both", [kind]).groupBy("node").agg(F.min("hop").alias("hop")).withColumn("tier", F.lit(tier))
        tiers = t if tiers is None else tiers.unionByName(t)
    first = tiers.groupBy("node").agg(F.min(F.struct("tier", "hop")).alias("x")).select("node", "x.*")
    first = first.join(anchors.select("node").distinct(), "node", "left_anti").join(insights.select(F.col("insight_id").alias("node"), "created_at"), "node")
    top = first.orderBy("tier", "hop", "created_at", "node").limit(budget)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tier", "hop", "created_at", "node"))).select("node", "tier", "hop", "rank")


def ancestors(edges: DataFrame, starts: DataFrame, relation: str = "deepens", depth: int = 3) -> DataFrame:
    """``start, depth, node``: the chain of first (least) targets of one relation, up to ``depth`` steps."""
    first = edges.where(F.col("relation_type") == relation).groupBy(F.col("source_id").alias("a")).agg(F.min("target_id").alias("b"))
    at = starts.select(F.col("node").alias("start"), "node")
    out = None
    for d in range(1, depth + 1):
        at = at.join(first, at.node == first.a).select("start", F.col("b").alias("node")).where("node <> start")
        step = at.select("start", F.lit(d).alias("depth"), "node")
        out = step if out is None else out.unionByName(step)
    return out


def graph_stats(insights: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree, greatest in-degree, clusters, the largest, edges of each type."""
    parts = components_with_singles(insights, edges)
    sizes = parts.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("clusters"), F.max("n").alias("largest_cluster"))
    nodes = insights.agg(F.count_distinct("insight_id").alias("nodes"))
    per = edges.agg(F.count("*").alias("edges"), *(F.count_if(F.col("relation_type") == t).alias(f"n_{t}") for t in RELATIONS))
    most = edges.groupBy("target_id").agg(F.count("*").alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).alias("max_in_degree"))
    x = sizes
    for one in (nodes, per, most):  # a row each
        x = x.withColumns({k: F.lit(v) for k, v in one.first().asDict().items()})
    return x.withColumn("mean_degree", F.round(F.try_divide(2.0 * F.col("edges"), F.col("nodes")), 6))


def components_with_singles(insights: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``; insights without edges are components of their own."""
    found = connected_components(edges, "source_id", "target_id")
    alone = insights.select(F.col("insight_id").alias("node")).distinct().join(found, "node", "left_anti").withColumn("component", F.col("node"))
    return found.unionByName(alone)


def core_columns(columns: Column, x: Column, y: Column, group: Column, moderator: Column) -> Column:
    """What a finding is about: the parsed roles, else all columns, without structural ones."""
    structural = F.array(*map(F.lit, STRUCTURAL))
    roles = F.array_distinct(F.array_compact(F.array(x, y, group, moderator)))
    low = lambda a: F.transform(a, lambda c: F.lower(c))
    own = F.array_except(low(roles), structural)
    return F.array_sort(F.when(F.size(own) > 0, own).otherwise(F.array_except(low(F.coalesce(columns, F.array().cast("array<string>"))), structural)))


def estimand(test_type: Column, x: Column, y: Column, group: Column, moderator: Column) -> Column:
    """What a finding estimates, as one text; null for differences and where x or y is missing."""
    pair = F.array_sort(F.array(F.lower(x), F.lower(y)))
    key = F.concat_ws("|", F.lower(test_type), pair[0], pair[1], F.coalesce(F.lower(moderator), F.lit("-")), F.coalesce(F.lower(group), F.lit("-")))
    return F.when(x.isNotNull() & y.isNotNull() & (F.lower(test_type) != "diff"), key)


def described(insights: DataFrame) -> DataFrame:
    """``insights`` with rank, core columns, estimand, modules and a credible effect (null otherwise)."""
    p = {k: F.col(f"parsed.{k}") for k in ("x", "y", "grp", "moderator")}
    credible = (F.col("p_value") < 0.05) & ~F.isnan("effect_size") & (F.col("effect_size") != 0)
    return insights.select(
        "*", dsl_rank(F.lower("test_type")).alias("rank"),
        core_columns(F.col("column_names"), p["x"], p["y"], p["grp"], p["moderator"]).alias("core"),
        estimand(F.col("test_type"), p["x"], p["y"], p["grp"], p["moderator"]).alias("estimand"),
        F.array_sort(F.array_distinct(F.coalesce(F.map_values("card_modules"), F.array().cast("array<string>")))).alias("modules"),
        F.when(credible, F.col("effect_size")).alias("credible_effect"),
    )


def conflicts(insights: DataFrame) -> DataFrame:
    """``a, b`` (a < b): findings with one estimand and credible effects of opposite sign.

    Only the two signs meet: each positive finding is joined with the negative ones of its estimand.
    """
    d = described(insights).where("estimand is not null and credible_effect is not null").select("insight_id", "estimand", "credible_effect")
    up = d.where("credible_effect > 0").select("estimand", F.col("insight_id").alias("u"))
    down = d.where("credible_effect < 0").select("estimand", F.col("insight_id").alias("v"))
    return up.join(down, "estimand").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "estimand")


def classify(pairs: DataFrame, insights: DataFrame) -> DataFrame:
    """``source_id, target_id, relation``: contradicts before deepens before extends before narrows."""
    d = described(insights).select("insight_id", "rank", "core", "estimand", "modules", "credible_effect")
    s, t = (d.select(*(F.col(c).alias(f"{c}_{k}") for c in d.columns)) for k in "st")
    x = pairs.join(s, F.col("source_id") == F.col("insight_id_s")).join(t, F.col("target_id") == F.col("insight_id_t"))
    relation = (
        F.when((F.col("estimand_s") == F.col("estimand_t")) & (F.signum("credible_effect_s") != F.signum("credible_effect_t")), "contradicts")
        .when((F.col("rank_s") > F.col("rank_t")) & (F.col("rank_t") > 0) & (F.size("core_t") > 0) & (F.size(F.array_except("core_t", "core_s")) == 0), "deepens")
        .when((F.size("modules_s") > 0) & (F.size("modules_t") > 0) & ~F.arrays_overlap("modules_s", "modules_t"), "extends")
        .otherwise("narrows")
    )
    return x.select("source_id", "target_id", relation.alias("relation"))


def deepening_parents(insights: DataFrame, most: int = 3) -> DataFrame:
    """``child, parent, n``: findings of less depth about some but not all of the child's core columns.

    Candidates share a core column; those whose columns all lie within the child's are kept, the deeper and
    wider ones first, up to ``most``.
    """
    d = described(insights).where("rank > 0 and size(core) > 0").select("insight_id", "rank", "core")
    sets = stage(d.groupBy("rank", "core").agg(F.sort_array(F.collect_set("insight_id")).alias("ids")), "cores")  # many findings share a set
    child, parent = (sets.select(F.col("rank").alias(f"r{k}"), F.col("core").alias(f"c{k}"), F.explode("core").alias("col"), F.xxhash64("rank", "core").alias(f"h{k}")) for k in "xy")
    pairs = child.join(parent, "col").where((F.col("ry") < F.col("rx")) & (F.size("cy") < F.size("cx"))).groupBy("rx", "cx", "ry", "cy").agg(F.count("*").alias("common")).where(F.col("common") == F.size("cy"))
    x = d.join(pairs, (d["rank"] == F.col("rx")) & (d["core"] == F.col("cx"))).select(F.col("insight_id").alias("child"), "ry", "cy")
    best = sets.select("rank", "core", F.slice("ids", 1, most + 1).alias("ids"))  # no more are needed of any set
    y = x.join(best, (F.col("ry") == best["rank"]) & (F.col("cy") == best["core"])).select("child", "ry", F.size("cy").alias("size"), F.explode("ids").alias("parent"))
    order = Window.partitionBy("child").orderBy(F.desc("ry"), F.desc("size"), "parent")
    return y.where("child <> parent").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("child", "parent", "n")


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays taken as sets; ``empty`` if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def structurally_similar(insights: DataFrame, queries: DataFrame, least: float = 0.5) -> DataFrame:
    """``query_id, insight_id, similarity``: findings whose core columns overlap with a query's by at least
    ``least`` (Jaccard). Pairs are found by shared columns of different core sets, then spread to findings."""
    d = described(insights).where("size(core) > 0").select("insight_id", "core")
    q = described(queries).where("size(core) > 0").select(F.col("insight_id").alias("query_id"), F.col("core").alias("qcore"))
    sets, qsets = d.select("core").distinct(), q.select("qcore").distinct()
    pairs = sets.withColumn("col", F.explode("core")).join(qsets.withColumn("col", F.explode("qcore")), "col").select("core", "qcore").distinct()
    pairs = pairs.withColumn("similarity", jaccard(F.col("core"), F.col("qcore"))).where(F.col("similarity") >= least)
    return q.join(pairs, "qcore").join(d, "core").where("query_id <> insight_id").select("query_id", "insight_id", "similarity")


def structural_novelty(insights: DataFrame, candidates: DataFrame) -> DataFrame:
    """``insight_id, novelty`` of candidates against earlier insights.

    The first rule that fits counts: 0.5 without columns; 0.1 if two numbered columns (Q12 and the like) are at most 3
    apart, as items of one battery are; 0.15 for two or more columns of one module; 0.1 for the very same columns as an
    earlier one; else one minus the greatest overlap.
    """
    cand = described(candidates).select("insight_id", "core", "modules", "created_at")
    old = described(insights).where("size(core) > 0").select(F.col("core").alias("ocore"), F.col("created_at").alias("seen")).groupBy("ocore").agg(F.min("seen").alias("seen"))
    near = cand.withColumn("col", F.explode("core")).join(old.withColumn("col", F.explode("ocore")), "col").where("seen < created_at")
    best = near.groupBy("insight_id").agg(F.max(jaccard(F.col("core"), F.col("ocore"))).alias("best"))
    x = cand.join(best, "insight_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    numbers = F.transform(F.filter("core", lambda c: c.rlike(r"^Q\d+")), lambda c: F.regexp_extract(c, r"^Q(\d+)", 1).cast("long"))
    x = x.withColumn("numbers", F.array_sort(F.array_distinct(numbers)))
    gaps = F.transform(F.sequence(F.lit(1), F.size("numbers") - 1), lambda i: F.get("numbers", i) - F.get("numbers", i - 1))
    battery = F.when(F.size("numbers") >= 2, F.array_min(gaps) <= 3)
    score = F.when(F.size("core") == 0, 0.5).when(battery, 0.1).when((F.size("modules") == 1) & (F.size("core") >= 2), 0.15).when(F.col("best") == 1, 0.1).otherwise(1 - F.col("best"))
    return x.select("insight_id", F.round(score, 6).alias("novelty"))


def seed_edges(seeds: DataFrame, module: str, order: list[str], reach: int = 2) -> DataFrame:
    """``source_id, target_id``: each seed to the next ``reach`` seeds of its module in the given order."""
    w = Window.partitionBy(module).orderBy(*order)
    nxt = F.array(*(F.lead("insight_id", i).over(w) for i in range(1, reach + 1)))
    return seeds.select("insight_id", nxt.alias("next")).select("insight_id", F.explode("next").alias("target_id")).where("target_id is not null").select(F.col("insight_id").alias("source_id"), "target_id")


def frontiers(insights: DataFrame) -> DataFrame:
    """``module_a, module_b, n``: how many findings join two modules, 0 included for pairs never joined."""
    d = described(insights).select("insight_id", "modules")
    m = d.select(F.explode("modules").alias("m")).distinct()
    every = m.select(F.col("m").alias("module_a")).join(m.select(F.col("m").alias("module_b")), F.col("module_a") < F.col("module_b"))  # modules are few
    one = d.select("insight_id", F.explode("modules").alias("module_a"), "modules").select("insight_id", "module_a", F.explode("modules").alias("module_b")).where("module_a < module_b")
    seen = one.groupBy("module_a", "module_b").agg(F.count("*").alias("n"))
    return every.join(seen, ["module_a", "module_b"], "left").select("module_a", "module_b", F.coalesce("n", F.lit(0)).alias("n"))


def merge_duplicates(insights: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """One row per key: the first by creation and id, with the greatest of each score among all."""
    first = F.min(F.struct("created_at", "insight_id")).alias("f")
    return insights.groupBy(*keys).agg(first, F.count("*").alias("n"), *(F.max(F.nanvl(F.col(s), F.lit(None))).alias(s) for s in scores)).select(*keys, "f.insight_id", "n", *scores)


def composite_related(insights: DataFrame, edges: DataFrame, similar: DataFrame, most: int = 3, low: float = 0.72, high: float = 0.92, most_in: int = 15) -> DataFrame:
    """``query_id, insight_id, score, n`` from ``similar(query_id, insight_id, similarity)`` of 0..1.

    Similarities outside ``low``..``high`` (less: unrelated, more: the same) and hubs with ``most_in`` incoming
    edges are left out. The score weighs similarity 0.4, overlap of core columns 0.3 and rarity 0.3.
    """
    d = described(insights).select("insight_id", "core")
    degree = edges.groupBy(F.col("target_id").alias("insight_id")).agg(F.count("*").alias("d"))
    x = similar.where((F.col("similarity") >= low) & (F.col("similarity") < high)).join(degree, "insight_id", "left").withColumn("d", F.coalesce("d", F.lit(0))).where(F.col("d") < most_in)
    x = x.join(d, "insight_id").join(d.select(F.col("insight_id").alias("query_id"), F.col("core").alias("qcore")), "query_id")
    score = 0.4 * (F.col("similarity") - low) / (high - low) + 0.3 * jaccard(F.col("core"), F.col("qcore")) + 0.3 / (1 + F.log1p(F.col("d").cast("double")))
    x = x.withColumn("score", F.round(score, 6))
    return x.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "insight_id"))).where(F.col("n") <= most).select("query_id", "insight_id", "score", "n")


def duplicates(candidates: DataFrame, insights: DataFrame, similar: DataFrame | None = None, overlap: float = 0.8, near: float = 0.88) -> DataFrame:
    """``insight_id, reason`` of candidates that earlier insights already say, the cheapest rule first.

    CROSS_ROUND_DUPLICATE: the same normalised query. PRE-EXISTING: a similarity of ``near`` or more in
    ``similar(insight_id, other_id, similarity)`` and two thirds of the core columns shared.
    STRUCTURAL_DUPLICATE: the same test type and an overlap of core columns of at least ``overlap``, unless the
    candidate's test is deeper.
    """
    from ..functions.text import dsl_normal

    c = described(candidates).withColumn("dsl", dsl_normal(F.col("dsl_sentence"))).select("insight_id", "dsl", "core", "rank", "test_type", "created_at")
    o = described(insights).withColumn("dsl", dsl_normal(F.col("dsl_sentence"))).select(F.col("insight_id").alias("other_id"), F.col("dsl").alias("odsl"), F.col("core").alias("ocore"), F.col("rank").alias("orank"), F.col("created_at").alias("ocreated"))
    same = c.join(o.where("odsl is not null").groupBy(F.col("odsl").alias("dsl")).agg(F.min("ocreated").alias("seen")), "dsl").where("seen < created_at").select("insight_id", F.lit(0).alias("r"))
    sets = o.where("size(ocore) > 0").groupBy("ocore", "orank").agg(F.min("ocreated").alias("seen"))
    near_sets = c.withColumn("col", F.explode("core")).join(sets.withColumn("col", F.explode("ocore")), "col").where((F.col("seen") < F.col("created_at")) & (F.col("rank") <= F.col("orank")))
    struct = near_sets.where(jaccard(F.col("core"), F.col("ocore")) >= overlap).select("insight_id", F.lit(2).alias("r"))
    every = same.unionAll(struct)
    if similar is not None:
        s = similar.where(F.col("similarity") >= near).join(c.select("insight_id", "core"), "insight_id").join(o.select("other_id", "ocore"), "other_id")
        every = every.unionAll(s.where(jaccard(F.col("core"), F.col("ocore")) >= 2 / 3).select("insight_id", F.lit(1).alias("r")))
    reasons = F.array(*map(F.lit, ("CROSS_ROUND_DUPLICATE", "PRE-EXISTING", "STRUCTURAL_DUPLICATE")))
    return every.groupBy("insight_id").agg(F.min("r").alias("r")).select("insight_id", reasons[F.col("r")].alias("reason"))


def anchor_sets(insights: DataFrame, edges: DataFrame, saturation: float = 0.25) -> DataFrame:
    """``insight_id, boundary, depth, isolated, underexplored, saturated``: where exploration may start.

    boundary: a neighbour has a module of its own; depth: an association that nothing deepens; isolated: no
    edges; underexplored: fewer than three; saturated: all its modules hold more than ``saturation`` of all.
    """
    d = described(insights).select("insight_id", "modules", "rank", F.lower("test_type").alias("t"))
    ends = edges.select(F.col("source_id").alias("insight_id"), F.col("target_id").alias("o")).unionAll(edges.select(F.col("target_id"), F.col("source_id")))
    degree = ends.groupBy("insight_id").agg(F.count("*").alias("degree"))
    other = d.select(F.col("insight_id").alias("o"), F.col("modules").alias("om"))
    boundary = ends.join(other, "o").join(d.select("insight_id", "modules"), "insight_id").where((F.size("modules") > 0) & (F.size("om") > 0) & (F.size(F.array_except("om", "modules")) > 0)).select("insight_id").distinct().withColumn("b", F.lit(True))
    deepened = edges.where("relation_type = 'deepens'").select(F.col("target_id").alias("insight_id")).distinct().withColumn("dd", F.lit(True))
    n = d.agg(F.count("*").alias("all")).first()[0] or 1
    full = d.select(F.explode("modules").alias("m")).groupBy("m").agg((F.count("*") > saturation * n).alias("f")).where("f").agg(F.collect_set("m").alias("full")).first()[0]  # modules are few
    crowded = F.array(*map(F.lit, sorted(full))) if full else F.array().cast("array<string>")
    x = d.join(degree, "insight_id", "left").join(boundary, "insight_id", "left").join(deepened, "insight_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    no = F.lit(False)
    return x.select(
        "insight_id", F.coalesce("b", no).alias("boundary"), ((F.col("t") == "assoc") & ~F.coalesce("dd", no)).alias("depth"), (F.col("degree") == 0).alias("isolated"), (F.col("degree") < 3).alias("underexplored"),
        ((F.size("modules") > 0) & (F.size(F.array_except("modules", crowded)) == 0)).alias("saturated"),
    )


def choose_anchor(sets: DataFrame, seed: int) -> str | None:
    """One anchor: boundary 0.4, depth 0.3, isolated 0.2, else underexplored; unsaturated ones first.

    The pick is the least hash among the candidates, so nothing is collected but the anchor.
    """
    import random

    roll = random.Random(seed).random()
    order = [b for b, limit in (("boundary", 0.4), ("depth", 0.7), ("isolated", 0.9), ("underexplored", 1.0)) if roll < limit]
    for kind in [*order, "underexplored"]:
        row = sets.where(F.col(kind)).orderBy("saturated", F.xxhash64(F.lit(seed), "insight_id")).select("insight_id").first()
        if row:
            return row[0]
    return None

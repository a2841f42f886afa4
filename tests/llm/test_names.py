import itertools

import pytest

from ouzel.llm import names as N

GROUPS = [
    ["Abigail Bipagates", "A. Bipagates", "Bipagates, Abigail", "ABIGAIL BIPAGATES", "Abigail Bipagates (Illustrator)", "by Abigail Bipagates", "Abby Bipagates", "Abigial Bipagates", "Abigail  Bipagates "],
    ["Harold Bipagates", "Harry Bipagates", "Bipagates H."],
    ["Bipagates Press", "Bipagates Pr.", "The Bipagates Press", "Press, Bipagates", "BipagatesPress", "Bipagates-Press", "Bipagates Press, Inc.", "Bpiagates Press"],
    ["House of Senikevir", "Hse of Senikevir", "HouseofSenikevir", "of Senikevir, House", "House of Snikevir"],
    ["Éditions Gapirales", "Editions Gapirales", "Ed. Gapirales", "ÉditionsGapirales", "éditions gapirales"],
    ["Fahatidon & Sons", "Fahatidon + Sons", "Fahatidon and Sons", "& Sons, Fahatidon"],
    ["Robert M. Didevozox", "Bob Didevozox", "Didevozox, Bob"],
    ["Katherine Nolabimax"],
]
NOBODY = [None, "", "  ", "-", "N/A", "Unknown", "Various", "none"]


def test_groups(spark):
    rows = [(b, i) for i, b in enumerate(itertools.chain(*GROUPS, NOBODY, ["Bipagates Press", "Abigail Bipagates"]))]
    df = spark.createDataFrame(rows, "brand string, entity int").withColumnRenamed("entity", "name")
    got = {(r.name_a, r.name_b) for r in N.same_name_pairs(df, "brand").collect()}
    want = {tuple(sorted(p)) for g in GROUPS for p in itertools.combinations(g, 2)}
    assert got == want


def test_initial_of_several_stays_alone(spark):
    df = spark.createDataFrame([("Harold Zozipotal",), ("Henry Zozipotal",), ("H. Zozipotal",)], "brand string")
    assert N.same_name_pairs(df, "brand").count() == 0


def _lev(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_radius_join_is_complete(spark):
    import random

    rng = random.Random(0)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 9))) for _ in range(150)]
    names = set(base)
    for b in base[:80]:
        s = list(b)
        for _ in range(rng.randint(1, 2)):
            s[rng.randrange(len(s))] = rng.choice("abcdefgh")
        names.add("".join(s))
    rows = [(f"b{len(n) % 2}" if n in base else "b0", n) for n in names]

    want = {(b, min(x, y), max(x, y)) for (b, x), (c, y) in itertools.combinations(rows, 2) if b == c and x != y and _lev(x, y) <= 2}
    df = spark.createDataFrame(rows, "block string, core string")
    for small in (0, 100, N.SMALL):  # cut into cells, in part and not at all
        got = [(r.block, r.x, r.y) for r in N.radius_pairs(df, small=small).collect()]
        assert set(got) == want and len(got) == len(want)


def test_a_large_block_is_cut_into_cells(spark, monkeypatch):
    import random

    rng = random.Random(1)
    parts = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    rows = [("person", "".join(rng.choices(parts, k=rng.randint(2, 5)))) for _ in range(8000)]
    seen = {}
    stage = N.stage
    monkeypatch.setattr(N, "stage", lambda df, label="stage": seen.setdefault(label, stage(df, label)))
    got = {(r.x, r.y) for r in N.radius_pairs(spark.createDataFrame(rows, "block string, core string")).collect()}
    cells = [r["count"] for r in seen["cells"].groupBy("cell").count().collect()]
    names = seen["points"].count()
    assert names > N.SMALL and sum(cells) <= 3 * names and len(cells) > 3
    some = sorted({c for _, c in rows})[:: names // 40]
    every = sorted({c for _, c in rows})
    for a in some:
        assert {b for b in every if b != a and abs(len(a) - len(b)) <= 2 and _lev(a, b) <= 2} == {y if x == a else x for x, y in got if a in (x, y)}


@pytest.mark.parametrize("a,b,d", [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "abd", 1), ("abc", "", 3), ("publishers", "pubaishers", 1)])
def test_distance(a, b, d):
    assert N.edit_distance(a, b, 3) == d == N.edit_distance(b, a, 3)


def test_empty(spark):
    assert N.same_name_pairs(spark.createDataFrame([], "brand string"), "brand").count() == 0

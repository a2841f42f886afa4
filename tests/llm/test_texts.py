import random
import re

import numpy as np
import pyspark.sql.functions as F
import pytest

from ouzel.llm import leak, lookalike, mixing, quality

SAME = [
    "Der Müller sah 12 Files, ok.", "Der Müller sah 12 Files, ok.", "Der Müller sah 12 Files, ok.", "Der Müller sah 12 ﬁles, ok.".replace("ﬁles", "ﬁles"),
    "Ｄer Müller sah １２ Files, ok．", "Der Müller sаh 12 Filеs, ok.", "Der Mül​ler sah 12 Files, ok.", "﻿Der Müller sah 12 Files, o­k.", "Der Μüller sah 12 Files, ok.",
]
OTHER = ["der Müller sah 12 Files, ok.", "Der Muller sah 12 Files, ok.", "Der Müller sah 13 Files, ok.", "Der Müller sah 12 Files, ok", "Der Müller sah  12 Files, ok.", "Der Müller\nsah 12 Files, ok."]


def test_forms(spark):
    rows = [(i, t, 1) for i, t in enumerate([*SAME[:3], *SAME[4:], *OTHER, None, ""])]
    df = spark.createDataFrame(rows, "id long, text string, form int")
    f = [r.look for r in lookalike.consistent_form(df, "text", ["id"], "look").orderBy("id").collect()]
    k = len(SAME) - 1
    assert len(set(f[:k])) == 1 and f[0] == SAME[0]
    assert f[0] not in f[k:] and len(set(f[k : k + len(OTHER)])) == len(OTHER) and f[-2] is None and f[-1] == ""


def test_form_is_stable(spark):
    once = [r.form for r in lookalike.consistent_form(spark.createDataFrame([(i, t) for i, t in enumerate(SAME + OTHER)], "id long, text string"), "text", ["id"]).orderBy("id").collect()]
    twice = [r.form for r in lookalike.consistent_form(spark.createDataFrame(list(enumerate(once)), "id long, text string"), "text", ["id"]).orderBy("id").collect()]
    assert once == twice


def test_alike_pairs(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a b"), (4, "A b"), (5, None), (6, None), (7, "а b")], "doc long, t string").withColumn("look", F.lit(0))
    assert {(r.doc_a, r.doc_b) for r in lookalike.alike_pairs(df, "doc", "t").collect()} == {(1, 2), (2, 3), (1, 7), (2, 7), (3, 7)}
    assert lookalike.alike_pairs(df.where("doc < 0"), "doc", "t").count() == 0


def _random_docs(seed=0):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=30)), " ".join(rng.choices(vocab, k=8)) if i % 3 else None) for i in range(20)]
    docs = []
    for d in range(150):
        w = rng.choices(vocab, k=rng.randint(0, 120))
        if d % 4 == 0:
            _, q, _ = rng.choice(items)
            q = q.split()
            k = rng.choice([5, 11, 12, 13, 30])
            s = rng.randint(0, len(q) - k)
            at = rng.randint(0, len(w))
            w[at:at] = q[s : s + k]
        docs.append((d, " ".join(w)))
    # one that is hard to read by machine
    docs.append((900, "x " + "; ".join(t.upper() for t in items[3][1].split()[4:17]).replace("O", "О").replace("W", "W​") + "\n end"))
    docs += [(901, None), (902, ""), (903, items[5][1] * 2), (0, docs[0][1])]
    return items, docs


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_leaks_against_brute_force(spark, block):
    items, docs = _random_docs()
    it = spark.createDataFrame(items, "item_id long, q string, g string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("form", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in leak.leaked(df, "doc_id", "text", it, "item_id", ["q", "g"], 12, block).collect()}
    form = lambda t: re.findall(r"[^\W_]+", t.replace("О", "O").replace("​", "").lower())
    want = set()
    for i, q, g in items:
        grams = {tuple(w[k : k + 12]) for p in (q, g) if p for w in [form(p)] for k in range(len(w) - 11)}
        for d, t in docs:
            w = form(t or "")
            if any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11)):
                want.add((d, i))
    assert got == want and (900, 3) in got


def test_leak_without_items(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, q string")
    assert leak.leaked(docs, "doc_id", "text", items, "item_id", ["q"]).count() == 0


def test_water_fill():
    take = mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 100, "b": 1000, "c": 1000}, {"a": 2, "b": 1, "c": 1}, 1000)
    assert take["a"] == 200 and take["b"] == pytest.approx(480) and take["c"] == pytest.approx(320)
    all_full = mixing.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 0}, {"a": 1, "b": 3}, 1000)
    assert all_full == {"a": 10, "b": 0}


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["token"] * rng.randint(1, 40)), ["Big One", "big-one", "small", None, "", "lost"][min(i % 9, 5)]) for i in range(900)] + [(9999, None, "small"), (9998, "", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big_one", 0.4, 1), ("small", 0.6, 3), ("absent", 0.1, 5)], "source string, target_share double, max_repeat int")
    chosen, report = mixing.mix_sources(docs, "doc_id", "text", "source", targets, total_tokens=6000)
    c, r = chosen.collect(), {x.source: x for x in report.collect()}
    assert {x.source for x in c} <= {"big_one", "small"} and len({x.doc_id for x in c}) == len(c)
    assert all(1 <= x.repeats <= {"big_one": 1, "small": 3}[x.source] for x in c)
    for s in ("big_one", "small"):
        got = sum(x.tokens * x.repeats for x in c if x.source == s)
        assert got == r[s].chosen_tokens <= r[s].wanted_tokens and r[s].wanted_tokens - got < 45
    assert r["absent"].chosen_tokens == 0 and sum(x.actual_share for x in r.values()) == pytest.approx(1)
    again = {(x.doc_id, x.repeats) for x in mixing.mix_sources(docs.repartition(7), "doc_id", "text", "source", targets, total_tokens=6000)[0].collect()}
    assert again == {(x.doc_id, x.repeats) for x in c}
    empty = mixing.mix_sources(docs.where("doc_id < 0"), "doc_id", "text", "source", targets)
    assert empty[0].count() == 0 and empty[1].count() == 3


PROSE = "I read the book in one night and the story was better than I thought. My sister liked it too, but the end is not what we had hoped for."
JUNK = ["| a | 12 | 3.50 |\n|---|---|---|\n| b | 7 | 9.10 |", "1. red lamp\n2) old map x14\n3 - tin box\n4. lost dog", "7z97H4BHW/F5sMv5fcS8uh+EAZzbMyFY3=qRvM", "<td id=\"x\"><b/>&nbsp;12</td><td id=\"y\"><i/>&nbsp;9</td>", "8344 | 6945 | 5626 | 170 | 2680", "#?_#*_-☆*?*~~=★-★☆=", "alpha_12=44;\nbeta_7=null;\ngamma_3=true;", "xkqzw vprtl qqwzx jkdfh zzxcv bnmqw"]


def _prose(rng):
    w = PROSE.split()
    rng.shuffle(w)
    t = " ".join(w[: rng.randint(6, len(w))])
    return rng.choice([t + ".", t.upper(), t.replace(" ", "\n", 2), t + "!!!", t])


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(0)
    rows = [("f", i, _prose(rng)) for i in range(600)] + [("f", 1000 + i, j) for i, j in enumerate(JUNK)] + [("f", 2000, None), ("f", 2001, "  \n "), ("f", 2002, PROSE * 300), ("f", 2003, PROSE.replace("e", "é").encode().decode("cp1252"))]
    df = spark.createDataFrame(rows, "field string, id long, text string").withColumn("lang", F.lit(3))
    return {r.id: r for r in quality.distances(quality.statistics(df, "text", ["field", "id"]), "field").collect()}


def test_quality(judged):
    far = {i for i, r in judged.items() if r.distance2 >= quality.CUTOFF}
    assert far >= {1000 + i for i in range(len(JUNK))} and len(far - {1000 + i for i in range(len(JUNK))}) <= 3
    assert 2000 not in judged and 2001 not in judged and 2002 not in far and 2003 not in far


def test_parts_add_up(judged):
    for r in judged.values():
        assert sum(r[f"part_{s}"] for s in quality.STATS) == pytest.approx(r.distance2, abs=1e-6)


def test_statistics_of_a_text():
    x, words, lines, lang = quality.text_statistics(["The cat, it is a cat.\nThe end"], np.zeros((27, 27, 27)))
    s = dict(zip(quality.STATS, x[0]))
    assert words[0] == 8 and lines[0] == 2 and lang == ["en"] and s["unclosed_share"] == 0.5 and s["common_share"] == pytest.approx(5 / 8) and s["separator_share"] == pytest.approx(1 / 8)


def test_quality_of_nothing(spark):
    df = spark.createDataFrame([], "field string, id long, text string")
    assert quality.not_prose(df, "field", "text", ["id"]).count() == 0


def test_pieces_bound_batches():
    import pandas as pd

    from ouzel.llm.words import pieces

    b = pd.DataFrame({"t": ["a" * n for n in (3, 9, 1, 30, 2, 2)], "k": range(6)})
    got = list(pieces(iter([b, b.iloc[:0]]), "t", 10))
    assert [list(p.k) for p in got] == [[0], [1, 2], [3], [4, 5]]


def test_leaks_in_a_long_text(monkeypatch):
    from ouzel.llm.words import word_hashes

    rng = random.Random(3)
    words = [f"w{rng.randrange(30)}" for _ in range(5000)]
    items = [" ".join(words[k : k + 12]) for k in (0, 2043, 2048, 2050, 4988)] + ["a b c d e f g h i j k l"]
    p = leak.Patterns.build(list(range(6)), items, 12)
    for lane in (7, 2048, 10**6):
        monkeypatch.setattr(leak, "LANE", lane)
        text, item = p.search(*word_hashes([" ".join(words), "short", " ".join(words[:12])]))
        assert {(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (2, 0)} == set(zip(text.tolist(), item.tolist()))


def test_clashing_names_are_refused(spark):
    from ouzel.llm import mojibake

    df = spark.createDataFrame([(1, "a")], "tokens long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("y"), "form": F.lit("z")})
    for call in (lambda: mixing.token_counts(df, "text", ["tokens"]), lambda: quality.statistics(df, "text", ["lang"]), lambda: mojibake.garbled(df, "text", ["source"]), lambda: lookalike.consistent_form(df, "text", ["form"])):
        with pytest.raises(ValueError):
            call()


def test_leaks_with_ids_of_any_type_in_several_blocks(spark):
    run = [f"word{i}" for i in range(14)]
    docs = spark.createDataFrame([("a", " ".join(run)), ("a", "x " + " ".join(run[:12])), ("b", " ".join(run[1:13])), ("c", " ".join(run[:11])), ("d", None)], "doc string, t string")
    items = spark.createDataFrame([("i", " ".join(run)), ("j", " ".join(run[1:13])), ("k", None)], "item string, p string")
    want = {("a", "i", 4), ("a", "j", 1), ("b", "i", 1), ("b", "j", 1)}
    for block in (1, 1 << 20):
        assert {tuple(r) for r in leak.leaked(docs, "doc", "t", items, "item", ["p"], 12, block).collect()} == want


# What a reader takes for the same, written out here and not taken from the operator.
LOOKS = {
    "ρaper": "paper", "νiew": "view", "αlpha": "alpha", "𝐇𝐞𝐥𝐥𝐨": "Hello", "Ⅷ": "VIII", "ⅼ": "l", "ｶﾞｷﾞ": "ガギ", "wait…": "wait...",
    "ﬁne ﬅyle": "fine style", "Ａ１！": "A1!", "µm": "μm", "ﻙ": "ك", "e\u0301": "é", "օne": "one", "ѵiew": "view", "а\u0301": "á", "со\u00adde": "code", "a\u3000b": "a b",
}
DIFFER = ["①", "1", "²", "2", "½", "ſ", "s", "é", "e", "A", "a", "end", "end.", "a b", "ab", "m³", "m3"]


def test_looks_against_a_list(spark):
    pairs = list(LOOKS.items())
    df = spark.createDataFrame([(i, x) for i, (a, b) in enumerate(pairs) for x in (a, b)], "id long, text string")
    forms = {}
    for r in lookalike.consistent_form(df, "text", ["id"]).collect():
        forms.setdefault(r.id, set()).add(r.form)
    assert [pairs[i] for i, f in forms.items() if len(f) > 1] == []
    others = spark.createDataFrame(list(enumerate(DIFFER)), "id long, text string")
    assert lookalike.consistent_form(others, "text", ["id"]).select("form").distinct().count() == len(DIFFER)

import random

import pytest

from ouzel.llm import mojibake as M

EN = "The café owner read the naïve résumé about jalapeño and smörgåsbord while Zoë’s friend paid 5 € – it’s true that she liked the book and the story was long"
DE = "Über die Brücke kam der Müller und fand das Märchen schön, aber die Übersetzung für die Gräfin war süß und die Straße führte weiter"
RU = "первая глава и любовная линия повести очень хороша потому что герой живёт в старом городе и пишет письмо матери о зимней дороге и мельнике"


def texts(n=400, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = rng.choice((EN, EN, DE, RU)).split()
        rng.shuffle(w)
        out.append(" ".join(w[: rng.randint(8, len(w))]))
    return out


def garble(t, page, twice=False):
    for _ in range(1 + twice):
        t = "".join(M._shown(page, b) for b in t.encode())
    return t


@pytest.fixture(scope="module")
def found(spark):
    rows, truth = [], {}
    for i, t in enumerate(texts(3000)):
        bad = t
        if i % 12 == 0 and any(ord(c) > 127 for c in t):
            kind = (i // 12) % 6
            if kind < 4:
                bad = garble(t, ("cp1252", "mac_roman", "cp437", "cp1250")[kind])
            elif kind == 4:
                bad = garble(t, "cp1252", True)
            elif any("а" <= c <= "я" for c in t):
                bad = t.encode("koi8_r", "ignore").decode("cp1251", "ignore")
        if bad != t:
            truth[i] = t
        rows.append((i, bad))
    rows += [(9001, None), (9002, ""), (9003, "plain ascii text"), (9004, "Ang�lique"), (9005, "Ça va où? GRÃO, São, Ångström, Dvořák, ½ kg, 5 °C, №, 😀 ❤ ★"), (9006, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "'x' as gain", "'y' as kind", "1 as restored")
    got = {r.id: r for r in M.garbled(df, "text", ["id"]).collect()}
    return got, truth


def test_affected_rows(found):
    got, truth = found
    wrong = set(got) - set(truth) - {9004, 9006}
    assert len(set(truth) & set(got)) >= 0.97 * len(truth)
    assert len(wrong) <= 0.01 * len(truth)
    assert 9004 in got and got[9004].lost and not {9001, 9002, 9003, 9005} & set(got)


def test_round_trip(found):
    got, truth = found
    same = sum(got[i].restored == t for i, t in truth.items() if i in got)
    assert same >= 0.8 * len(truth)


def test_empty(spark):
    assert M.garbled(spark.createDataFrame([], "id long, text string"), "text", ["id"]).count() == 0


def test_units_are_alike_in_all_processes():
    import subprocess
    import sys

    code = "from ouzel.llm import mojibake as M; import hashlib; print(hashlib.md5('|'.join(u for s in M.sources() for u in s.units).encode('utf-8', 'surrogatepass')).hexdigest())"
    out = {subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={"PYTHONHASHSEED": str(k), "PYTHONPATH": ":".join(sys.path)}).stdout for k in (1, 2)}
    assert len(out) == 1 and out != {""}


def test_part_of_a_text_is_enough(spark):
    """A garbled sentence in a long clean Russian text, and a garbled Russian title in an English one."""
    rng = random.Random(5)
    long_ = lambda t, n: " ".join(rng.choices(t.split(), k=n))
    rows, truth = [], {}
    for i, t in enumerate(texts(4000, 7)):
        if i % 80 == 0:
            bit = long_(RU, 6)
            bad = bit.encode("cp1251").decode("cp1252") if i % 160 else bit.encode("koi8_r").decode("cp1251")
            around = (EN if i % 160 else RU)
            before, after = long_(around, 60), long_(around, 60)
            truth[i] = f"{before} {bit} {after}"
            t = f"{before} {bad} {after}"
        rows.append((i, t))
    got = {r.id: r for r in M.garbled(spark.createDataFrame(rows, "id long, text string"), "text", ["id"]).collect()}
    assert len(set(truth) & set(got)) >= 0.9 * len(truth)
    assert len(set(got) - set(truth)) <= 0.02 * len(truth)
    assert sum(got[i].restored == t for i, t in truth.items() if i in got) >= 0.5 * len(truth)


def test_any_letter_or_sign_in_utf8(spark):
    signs = ["º", "ª", "´", "·", "±", "×", "αβγ", "日本語", "😡", "🎉", "λόγος"]
    clean = [(i, t) for i, t in enumerate(texts(1500, 3))]
    rows = [(5000 + 10 * i + k, f"the story {garble(c, p)} was long") for i, c in enumerate(signs) for k, p in enumerate(("cp1252", "mac_roman"))]
    right = [(7000 + i, f"the story {c} was long") for i, c in enumerate(signs)] + [(7100, "ein GRÜ» und CAFÉ® “DÉJÀ” auf 5 °C ±2"), (7101, "герой живёт в старом городе».")]
    got = {r.id: r for r in M.garbled(spark.createDataFrame(clean + rows + right, "id long, text string"), "text", ["id"]).collect()}
    want = {r: f"the story {c} was long" for i, c in enumerate(signs) for r in (5000 + 10 * i, 5001 + 10 * i)}
    assert {r: got[r].restored for r in want if r in got} == want
    assert [got[i].restored for i, _ in right if i in got] == []
    assert len({i for i, _ in clean} & set(got)) <= 0.01 * len(clean)

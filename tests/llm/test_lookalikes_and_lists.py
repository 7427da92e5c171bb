"""Look-alike forms and mapping to a list."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from watchbill.llm.canonical import SymmetricDelete, deletes, map_to_list, weighted
from watchbill.llm.lookalikes import Rewriter, learn, lookalike_classes, one_form, representatives, same_look


def rewriter(*texts):
    whole = unicodedata.normalize("NFD", "".join(texts))
    letters = sorted(set(whole))
    return Rewriter(representatives(lookalike_classes(letters), {c: whole.count(c) for c in letters}))


@pytest.mark.parametrize("a,b", [
    ("Dr. Alpha", "Ｄｒ. Ａｌｐｈａ"), ("Dr. Alpha", "Dr. Al​pha"), ("Dr. Alpha", "Dr. Аlрhа"), ("café", "café"), ("café", "cafｅ‍́"), ("flute", "ﬂute"),
    ("El-Bravo", "El‑Bravo"), ("йо", "йο"), ("a b", "a b"), ("د", "ﺩ")])
def test_equal_looks(a, b):
    form = rewriter(a, b)
    assert form(a) == form(b)


@pytest.mark.parametrize("a,b", [("Alpha", "alpha"), ("café", "cafe"), ("a b", "a  b"), ("Alpha", "Alfa"), ("a-b", "ab")])
def test_visible_differences(a, b):
    form = rewriter(a, b)
    assert form(a) != form(b)


@pytest.mark.parametrize("a,b", [
    ("\u0643\u0631\u064a\u0645", "\u06a9\u0631\u06cc\u0645"), ("\u064a\u200c\u0645", "\u06cc\u0645"), ("\u0639\u0644\u0649", "\u0639\u0644\u06cc"), ("\u0631\u064a\u064e\u0645", "\u0631\u06cc\u064e\u0645"),
    ("\u0631\u0626", "\u0631\u06cc\u0654"), ("\u0631\u064a\u0645", "\u0631\ufbff\u0645"), ("\u0661\u0662", "\u06f1\u06f2"), ("Son", "\u054f\u0585\u0578"), ("TOM", "\u13a2O\u13b7")])
def test_equal_looks_of_arabic_and_rarer_scripts(a, b):
    form = rewriter(a, b, "\ufbff" * 9)
    assert form(a) == form(b)


@pytest.mark.parametrize("a,b", [("\u0639\u0644\u064a", "\u0639\u0644\u06cc"), ("\u0645\u0644\u0643", "\u0645\u0644\u06a9"), ("\u0645\u06af", "\u0645\u0643"), ("\u0664", "\u06f4")])
def test_arabic_letters_that_differ_at_the_end_of_a_word(a, b):
    form = rewriter(a, b)
    assert form(a) != form(b)


def test_classes_are_transitive_and_follow_frequency():
    table = representatives(lookalike_classes(["Ａ", "А", "A", "Α"]), {"А": 5, "A": 1})
    assert {table.get(c, c) for c in "ＡАAΑ"} == {"А"}
    assert rewriter("")("") == "" and rewriter("a")(None) is None


def test_same_look(spark):
    a = spark.createDataFrame([(1, "S", "Аlpha"), (2, "S", "Alpha"), (3, "T", "Аlpha"), (4, "S", None), (5, "S", ""), (6, "S", "​"), (1, "S", "Аlpha")], "id int, site string, name string")
    b = spark.createDataFrame([(7, "S", "Alpha", "x"), (8, "S", "alpha", "x"), (9, "S", None, "x"), (10, None, "Alpha", "x")], "cid int, site string, name string, _l string")
    assert sorted(map(tuple, same_look(a, b, ["site"], "name", "name", "id", "cid").collect())) == [(1, 7), (1, 7)]
    assert same_look(a.limit(0), b, ["site"], "name", "name", "id", "cid").count() == 0
    long = spark.createDataFrame([("Ａ" * 100_000,), (None,)], "t string")
    assert [r[0] for r in long.select(F.length(one_form(F.col("t"), learn([(long, "t")])))).collect()] == [100_000, None]


LIST = [(1, "Dr. Alpha Bravo", "0501111111", 0), (2, "Dr. Alpho Bravo", "0502222222", 3), (3, "Dr. Charlie Al-Delta", "0503333333", 0), (4, "Echo Foxtrot", None, 0)]


@pytest.mark.parametrize("name,phone,want", [
    ("Alpha Bravo", None, 1), ("Dr Bravo Alpha", "0501111111", 1), ("Alpha Bravo", "0502222222", 2), ("Alpha Bravo", "xxx2222", 2), ("Delta, Charly", None, 3), ("C. Delta", None, 3), ("Dr Charlie Dleta", "0503333334", 3),
    ("duty phone", "0503333333", 3), (None, "+966503333333", 3), ("Golf Hotel", None, 0), ("Golf Hotel", "0509999999", 0), ("Alpha Bravo", "0508765432", 0), (None, None, 0), ("", "", 0), ("?", "05", 0), ("Eco Foxtrot", None, 4), ("Charlie", None, 0)])
def test_meant(name, phone, want):
    assert SymmetricDelete(LIST).best(name, phone)[0] == want


def test_deletes_find_all_within_two():
    import random

    from watchbill.llm.names import distance

    r = random.Random(2)
    words = list({"".join(r.choices("abcde", k=r.randint(5, 8))) for _ in range(300)})
    d = SymmetricDelete([(i, f"{w} x", None, 0) for i, w in enumerate(words)])
    from watchbill.llm.names import tokens

    held = {i: ws[0][1] for i, (ws, _, _) in d.rows.items() if ws}
    for q in words[:40]:
        f = tokens(q)[0][1]
        if len(f) >= 5:
            assert d.near(f) >= {i for i, w in held.items() if len(w) >= 5 and distance(f, w, 2) <= 2}
    assert deletes("ab", 1) == {"ab", "a", "b"} and weighted("abc", "acb") < 1 < weighted("abc", "xyc")


def test_map_to_list(spark):
    import watchbill.llm.canonical as C

    ref = spark.createDataFrame([r[:3] for r in LIST], "id int, name string, phone string")
    df = spark.createDataFrame([(1, "Alpha Bravo", None, "x"), (1, "Alpha Bravo", None, "x"), (2, None, None, "y"), (3, "Charlie Delta", "0503333333", None)], "k int, name string, phone string, best_id string")
    got = sorted((r["k"], r["best_id"]) for r in map_to_list(df, "name", "phone", ref).collect())
    assert got == [(1, 1), (1, 1), (2, 0), (3, 3)]
    keep, C.BLOCK = C.BLOCK, 1
    try:
        assert sorted((r["k"], r["best_id"]) for r in map_to_list(df, "name", "phone", ref).collect()) == got
    finally:
        C.BLOCK = keep
    assert {r["best_id"] for r in map_to_list(df, "name", "phone", ref.limit(0)).collect()} == {0}
    assert map_to_list(df.limit(0), "name", "phone", ref).count() == 0


def test_all_words_of_a_cell_are_compared():
    import itertools
    import random

    from watchbill.llm.canonical import least_assignment, name_cost
    from watchbill.llm.names import tokens

    assert name_cost(tokens("kilo lima mike november oscar alpha bravo"), tokens("Alpha Bravo")) == pytest.approx(1.5)
    six = "Alpha Bravo Charlie Foxtrot Golf Hotel"
    assert name_cost(tokens(six), tokens(six)) == 0 and name_cost(tokens(six), tokens(six.replace("Hotel", "Zulu"))) is None
    r = random.Random(5)
    for _ in range(300):
        n, m = sorted((r.randint(1, 4), r.randint(1, 6)))
        costs = [[r.choice([0, 0.3, 1.1, 2.2, float("inf"), float("inf")]) for _ in range(m)] for _ in range(n)]
        want = min(sum(costs[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert least_assignment(costs) == (pytest.approx(want) if want < float("inf") else None)

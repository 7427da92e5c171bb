"""Small cases of the roster operators: nulls, ties, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from watchbill.functions import timeops as T
from watchbill.functions.distance import name_rule, osa, token_rule
from watchbill.functions.rules import first_rule, keyword_score, lane, last_rule, rule_join
from watchbill.functions.text import canonical_name, clean_phone, contains_word, date_key, empty_to_null, phones_in, slug
from watchbill.operators import analytics as A
from watchbill.operators import matching as M
from watchbill.operators import resolve as R
from watchbill.operators import rows as W
from watchbill.operators import search as S
from watchbill.operators import store as K
from watchbill.operators import windows as G
from watchbill.operators.components import components
from watchbill.operators.grouped import stream_groups


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("name,key", [("Dr. Alfa Al-Bravo (R3)", "fa bravo"), ("drake alia", "ake ia"), ("El Sample ali", "sample ali"), ("Dr", ""), ("", ""), (None, None), ("مثال Test", "مثال test")])
def test_canonical_name(spark, name, key):
    assert one(spark, name, canonical_name) == key


@pytest.mark.parametrize("typed,clean", [("+966 50 123 4567", "0501234567"), ("501234567", "0501234567"), ("050-123-4567", "0501234567"), ("٠٥٠١٢٣٤٥٦٧", "0501234567"), ("12345", None), ("", None), (None, None)])
def test_clean_phone(spark, typed, clean):
    assert one(spark, typed, clean_phone) == clean


def test_text(spark):
    assert one(spark, "a 050 123 4567, +966501234568.", phones_in) == ["0501234567", "0501234568"]
    assert [one(spark, t, date_key) for t in ("on 3/4 late", "12 March 2026", "7-Apr-26", "none", None)] == ["03/04", "12/03", "07/04", None, None]
    assert one(spark, " New: Ward 4! ", slug) == "custom_new_ward_4"
    assert one(spark, "  ", empty_to_null) is None
    assert one(spark, "the ER today", lambda c: contains_word(c, "er")) and not one(spark, "other", lambda c: contains_word(c, "er"))


def brute_osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_osa_and_rules(spark):
    import random

    r = random.Random(4)
    words = [("".join(r.choices("abc", k=r.randint(0, 8))), "".join(r.choices("abc", k=r.randint(0, 8)))) for _ in range(300)]
    df = spark.createDataFrame(words, "a string, b string")
    got = df.select("a", "b", osa(F.col("a"), F.col("b")).alias("d"), token_rule(F.col("a"), F.col("b")).alias("r")).collect()
    for x in got:
        assert x["d"] == brute_osa(x["a"], x["b"])
        short = min(len(x["a"]), len(x["b"]))
        rule = 1 if x["a"] == x["b"] else 2 if short >= 3 and (x["a"].startswith(x["b"]) or x["b"].startswith(x["a"])) else 3 if short >= 4 and x["d"] <= 1 else 4 if short >= 6 and x["d"] <= 2 else None
        assert x["r"] == rule, x
    names = spark.createDataFrame([(["alpha", "x"], ["alhpa", "bravo"]), (["zulu"], ["bravo"]), (["ab"], ["ab"])], "a array<string>, b array<string>")
    assert [n[0] for n in names.select(name_rule(F.col("a"), F.col("b"))).collect()] == [3, None, None]


def test_ladder_finds_what_all_pairs_find(spark):
    import random

    r = random.Random(7)
    people = ["".join(r.choices("bcdfgklmnrst", k=1)) + "".join(r.choices("abcdefgiklmnorstu", k=r.randint(2, 7))) for _ in range(60)]

    def slip(w):
        i = r.randrange(len(w))
        return r.choice([w, w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[: max(1, i)] + w[i : i + 2][::-1] + w[i + 2 :] if i else w, w[:4]])

    contacts = spark.createDataFrame([(1, f"{a} {b}", f"05000000{i:02d}") for i, (a, b) in enumerate(zip(people[::2], people[1::2]))] + [(1, None, "0500000099"), (1, "no phone", None)], "site int, name string, phone string")
    rows = spark.createDataFrame([(i, 1, slip(slip(a)) + " " + slip(b)) for i, (a, b) in enumerate(zip(people[::2], people[1::2]))] + [(90, 1, None), (91, 2, people[0])], "id int, site int, name string")
    got = {tuple(x) for x in M.ladder(rows, "id", "name", ["site"], contacts, "name", "phone").collect()}
    t = lambda c: F.split(canonical_name(F.col(c)), " ")
    pairs = rows.where("name is not null").select("id", t("name").alias("t"), "site").join(contacts.where("phone is not null").select("site", t("name").alias("c"), "phone"), "site")
    ruled = pairs.withColumn("rule", name_rule(F.col("t"), F.col("c"))).where("rule is not null").groupBy("id", "rule").agg(F.collect_set("phone").alias("p")).where("size(p) = 1")
    want = {(i, m[0], m[1], m[0] == 4) for i, m in ruled.groupBy("id").agg(F.min_by(F.struct("rule", F.col("p")[0].alias("p")), "rule").alias("m")).collect()}
    assert got == want and len(want) > 15


def test_ladder_uses_initials(spark):
    contacts = spark.createDataFrame([(1, "Ahmed Al-Harbi", "051"), (1, "Badr Harbi", "052"), (1, "Sara Khan", "053"), (1, "Sara Malik", "054"), (1, "Omar Zahrani", "055"), (1, "Omar Q Zahrani", "055"), (2, "Nora Harbi", "056")], "site int, name string, phone string")
    rows = spark.createDataFrame([(1, 1, "A. Harbi"), (2, 1, "B Harby"), (3, 1, "Sara.K"), (4, 1, "Dr. Sara M"), (5, 1, "C. Harbi"), (6, 1, "X. Zahrany"), (7, 2, "A. Harbi"), (8, 1, "Sara"), (9, 1, "Z. Unknown"), (10, 1, "O. Zaharni")], "id int, site int, name string")
    got = sorted(tuple(x) for x in M.ladder(rows, "id", "name", ["site"], contacts, "name", "phone").collect())
    assert got == [(1, 5, "051", False), (2, 5, "052", False), (3, 1, "053", False), (4, 1, "054", False), (6, 3, "055", False), (7, 1, "056", False), (10, 3, "055", False)]
    one = spark.createDataFrame([(1, "Nora Saadi", "057")], "site int, name string, phone string")
    rows = spark.createDataFrame([(1, 1, "N. Soodi"), (2, 1, "M. Soodi"), (3, 1, "N. Soodo")], "id int, site int, name string")
    assert sorted(tuple(x) for x in M.ladder(rows, "id", "name", ["site"], one, "name", "phone").collect()) == [(1, 5, "057", False), (2, 5, "057", True)]


def test_rules(spark):
    df = spark.createDataFrame([("a er day",), ("1st",), (None,)], "role string")
    assert [r[0] for r in df.select(lane(F.col("role"), [("er", "\\ber\\b", "night"), ("first", "1st", None)])).collect()] == ["er", "first", None]
    assert df.select(first_rule([(F.lit(None).cast("boolean"), 1), (F.lit(True), 2), (F.lit(True), 3)]), last_rule([(F.lit(True), 2), (F.lit(True), 3)])).first()[:] == (2, 3)
    score = spark.createDataFrame([("the ER and heart clinic", ["er", "heart", "clin", ""]), ("other", ["er"]), (None, ["er"])], "t string, k array<string>").select(keyword_score(F.col("t"), F.col("k")))
    assert [r[0] for r in score.collect()][:2] == [11, 0]
    rules = spark.createDataFrame([("day", 2, "x"), ("er", 1, "y")], "p string, o int, v string")
    assert {tuple(r) for r in rule_join(df, "role", rules, "p", "o", "v", ["role"]).collect()} == {("a er day", "y"), ("1st", None), (None, None)}


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, 5), ("b", 1, None), (None, 7, 1)], "k string, ord int, v int")
    assert {tuple(r) for r in G.best_by(df, ["k"], F.desc_nulls_last("v"), F.asc("ord")).collect()} == {("a", 2, 5), ("b", 1, None), (None, 7, 1)}
    assert {tuple(r)[:2] for r in G.keep_if_any(df, ["k"], F.col("v") > 4).collect()} == {("a", 2), ("a", 3), ("b", 1), (None, 7)}
    assert [r["v"] for r in G.carry_forward(df, ["k"], [F.asc("ord")], ["v"]).where("k = 'a'").orderBy("ord").collect()] == [None, 5, 5]
    assert G.page(df, [F.asc("ord"), F.asc("k")], 2, 3).count() == 2
    assert G.best_by(df.limit(0), ["k"], F.asc("ord")).count() == 0
    assert "WindowGroupLimit" in G.cap_per_key(df, ["k"], 2, F.asc("ord"))._jdf.queryExecution().toString()


def test_time(spark):
    df = spark.sql("select timestamp_ntz'2026-03-06 07:29:59' a, timestamp_ntz'2026-03-05 07:30:00' b")
    assert [str(x) for x in df.select(T.schedule_date(F.col("a")), T.schedule_date(F.col("b"))).first()] == ["2026-03-05", "2026-03-05"]
    assert df.select(T.is_weekend(F.to_date("a")), T.is_work_hours(F.col("a")), T.is_work_hours(F.col("b"))).first()[:] == (True, False, True)
    hold = lambda m, s, e: spark.range(1).select(T.range_active(F.lit(m), F.lit(s), F.lit(e))).first()[0]
    assert hold(60, 1200, 480) and not hold(480, 1200, 480) and hold(5, 300, 300) and hold(300, 300, 301)
    act = lambda k: df.select(T.window_active(F.col("a"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(k))).first()[0]
    assert act("24h") and not act("day") and act("night") and act("?") is None
    assert spark.range(1).select(T.half_up(F.lit(-2.5))).first()[0] == -2


def test_rows(spark):
    words = spark.createDataFrame([(1, 1, "Al", 0.0, 10.0, 10.0), (1, 2, "Bo", 14.0, 11.0, 10.0), (1, 3, "Ce", 60.0, 10.0, 10.0), (1, 4, "De", 300.0, 10.0, 10.0), (1, 5, "Ed", 0.0, 30.0, 10.0)], "page int, ord int, text string, x double, y double, width double")
    assert [r["text"] for r in W.lines_of_words(words, ["page"]).orderBy("line").collect()] == ["Al Bo  Ce\nDe", "Ed"]
    heads = spark.createDataFrame([(1, "a", 0.0), (1, "a", 10.0), (1, "a", 20.0), (1, "b", 100.0)], "page int, col string, x double")
    assert {tuple(r) for r in W.column_bounds(heads, ["page"]).collect()} == {(1, "a", None, 55.0), (1, "b", 55.0, None)}
    assert {(r["ord"], r["col"]) for r in W.words_to_columns(words, W.column_bounds(heads, ["page"]), ["page"]).collect()} == {(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "a")}
    cells = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 2, 2), (1, 3, 1), (1, 3, 2)], "page int, `table` int, row int")
    assert {r["table"] for r in W.largest_table(cells, ["page"]).collect()} == {2}
    half = spark.createDataFrame([("d1", "AM", "x"), ("d1", "PM", "x"), ("d2", "AM", "x"), ("d2", "PM", "y"), ("d3", "PM", "z"), ("d4", "AM", "w"), ("d5", "AM", " ")], "d string, h string, n string")
    assert {tuple(r) for r in W.merge_halves(half, ["d"], "h", "n").collect()} == {("d1", "x", "24h"), ("d2", "x", "day"), ("d2", "y", "night"), ("d3", "z", "night"), ("d4", "w", "24h")}
    lines = spark.createDataFrame([(1, 1, "head"), (1, 2, "01/02 a"), (1, 3, "b"), (1, 4, "02/02 c")], "doc int, ord int, t string")
    assert [r["text"] for r in W.continuation(lines, ["doc"], "ord", F.col("t").rlike("^\\d"), "t").orderBy("block").collect()] == ["01/02 a / b", "02/02 c"]
    two = spark.createDataFrame([("1/2 Ann 3/2 Bob Cee",), ("1/2 Ann",), (None,)], "t string")
    assert [(r["pos"], r["date_key"], r["segment"]) for r in W.split_at_dates(two, "t").orderBy("pos").collect()] == [(0, "1/2", "Ann"), (1, "3/2", "Bob Cee")]
    near = W.around_phones(spark.createDataFrame([("Ann 0501234567 Bob 0507654321 end",)], "t string"), "t", 4, 4).orderBy("pos").collect()
    assert [(r["phone"], r["context"]) for r in near] == [("0501234567", "Ann 0501234567 Bob"), ("0507654321", "Bob 0507654321 end")]
    assert spark.createDataFrame([("x START one two END y",)], "t string").select(W.between_markers(F.col("t"), "start", ["end", "stop"])).first()[0].strip() == "one two"
    modes = W.month_mode(spark.createDataFrame([("1/4/26 2/4/2026 1/5/26",), ("1/4/2019",)], "t string"), "t").collect()
    assert [tuple(r) for r in modes] == [(4, 2026, 2)]
    days = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 1)], "doc int, ord int, dow int")
    assert [str(r["date"]) for r in W.nth_weekdays(days, F.to_date(F.lit("2026-03-15")), ["doc"]).orderBy("ord").collect()] == ["2026-03-01", "2026-03-02", "2026-03-08"]
    words = spark.createDataFrame([("a b c d e f g".split(),), ("a b".split(),), (None,)], "w array<string>")
    assert [r["parts"] for r in W.partition_tokens(words, "w", ["b c"]).collect()] == [["a", "b c", "d", "e", "f", "g"], None, None]


def test_matching_and_resolve(spark):
    c = spark.createDataFrame([("Dr Ann Bee", "1", 1), ("ann bee", "2", 2), ("Ann Cee", "3", 3), ("Dr Annabel Cee", "3", 4)], "name string, phone string, ord int")
    assert {tuple(r) for r in M.bare_names(c, "name", "phone").collect()} == {("ann", 3, True), ("annabel", 1, False)}
    assert dict(M.name_of_phone(c, "name", "phone", "ord").collect())["3"] == "Dr Annabel Cee"
    got = M.canonical_join(spark.createDataFrame([("DR. ANN BEE",), ("x",)], "n string"), "n", c, "name", "phone", "ord").collect()
    assert {tuple(r) for r in got} == {("DR. ANN BEE", "2"), ("x", None)}
    zipped = M.positional_zip(spark.createDataFrame([(1, ["a", "b"])], "k int, x array<string>"), spark.createDataFrame([(1, ["p"])], "k int, y array<string>"), ["k"], "x", "y")
    assert {tuple(r) for r in zipped.collect()} == {(1, 0, "a", "p"), (1, 1, "b", None)}
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z"), (2, "z")], "k int, v string")
    assert {tuple(r)[:2] for r in R.by_priority([a, b], ["k"]).collect()} == {(1, "x"), (1, "y"), (2, "z")}
    assert {tuple(r) for r in R.merge_schedules(a, b, ["k"], F.asc("v")).collect()} == {(1, "x"), (1, "y"), (2, "z")}
    assert R.changed_groups(a, a.orderBy(F.desc("v")), ["k"], F.col("v")).count() == 0
    assert {tuple(r) for r in R.changed_groups(a, b, ["k"], F.col("v")).collect()} == {(1, "changed"), (2, "added")}
    shifts = spark.createDataFrame([(1, 0, 4000, 2, "late"), (1, 100, 200, 1, "early"), (1, 5, 5, 0, "empty")], "k int, s int, e int, o int, v string")
    at = M.interval_join(spark.createDataFrame([(1, 150), (1, 3999), (1, 4000), (2, 1)], "k int, t int"), "t", ["k"], shifts, "s", "e", "o", "v")
    assert {(r["k"], r["t"], r["v"]) for r in at.collect()} == {(1, 150, "early"), (1, 3999, "late"), (1, 4000, None), (2, 1, None)}


def test_search_and_analytics(spark):
    s = spark.createDataFrame([("Heart Clinic", ["ecg"], None), ("Other", ["heart"], False), ("Hidden Heart", [], True), ("Sheart", None, False)], "label string, k array<string>, h boolean")
    assert [r["label"] for r in S.search(s, "heart", "label", "k", "h").collect()] == ["Other", "Heart Clinic", "Sheart"]
    assert [r["label"] for r in S.search(s, "ecg", "label", "k", "h").collect()] == ["Heart Clinic"]
    assert spark.createDataFrame([("X11; Linux",), ("iPhone Mobile",), (None,)], "a string").select(A.device(F.col("a"))).collect()[1][0] == "phone"
    t = spark.createDataFrame([("a", 2, 50), ("a", 1, 100), ("b", 1, 5), ("c", 2, 0), ("c", 1, 9), ("d", 2, 82), ("d", 1, 100)], "k string, at int, v int")
    assert dict((r["k"], r["health"]) for r in A.trend(t, ["k"], [F.desc("at")], "v").collect()) == {"a": "red", "b": "yellow", "c": "yellow", "d": "yellow"}
    assert A.status_rates(t.limit(0), ["k"], "v", ["1"]).count() == 0


def test_store(spark):
    old = spark.createDataFrame([(1, 5, "a", 1), (2, 5, "b", 1)], "k int, v int, x string, t int")
    new = spark.createDataFrame([(1, 5, "c", 1), (2, 4, "d", 1), (3, 1, None, 1)], "k int, v int, x string, t int")
    assert {(r["k"], r["x"]) for r in K.upsert(old, new, ["k"], "v", "t").collect()} == {(1, "c"), (2, "b"), (3, None)}
    assert {(r["k"], r["x"]) for r in K.patch(old, new, ["k"], ["x"]).collect()} == {(1, "c"), (2, "d")}
    assert {r["k"] for r in K.newer_only(old, new, ["k"], "v").collect()} == {3}
    h = K.history(spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "k int, at int, v string"), ["k"], "at", [F.asc("at")], ["v"])
    assert {(r["at"], r["valid_to"], r["is_current"]) for r in h.collect()} == {(1, 3, False), (3, None, True)}
    assert K.delete(old, new.where("k = 1"), ["k"]).count() == 1


def test_components_and_groups(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (60, 60), (None, 3)], "a int, b int")
    got = dict(components(edges).collect())
    assert {got[i] for i in range(1, 41)} == {1} and got[51] == 50 and got[60] == 60 and len(got) == 43
    assert components(edges.limit(0)).count() == 0
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").unionByName(spark.sql("select cast(null as bigint) k, 5000L id"))
    sums = stream_groups(df, ["k"], lambda key, rows: [{"k": key[0], "n": len(rows)}], "k bigint, n int").collect()
    assert len(sums) == 8 and sum(r["n"] for r in sums) == 1001


@pytest.mark.parametrize("most", [2, 1000])
def test_components_within_groups_of_any_size(spark, most):
    import random

    from watchbill.operators.components import components_within

    r, rows = random.Random(3), []
    for group in range(12):
        nodes = range(100 * group, 100 * group + 30)
        rows += [(f"g{group}", *r.sample(nodes, 2)) for _ in range(group * 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, x, y in rows:
        low, high = sorted((find(x), find(y)))
        parent[high] = low
    edges = spark.createDataFrame([*rows, ("g1", None, 5)], "g string, a bigint, b bigint")
    got = dict(components_within(edges, "g", most=most).collect())
    assert {x: got.get(x, x) for x in parent} == {x: find(x) for x in parent}
    assert components_within(edges.limit(0), "g").count() == 0


def test_more_rows(spark):
    t = spark.createDataFrame([("7:30 - 16:30 ER",), ("from 8 to 20",), ("99-100",), ("none",), (None,)], "t string").select(W.time_range(F.col("t"))).collect()
    assert [tuple(r[0]) if r[0] else None for r in t] == [(450, 990), (480, 1200), None, None, None]
    cells = spark.createDataFrame([(1, 1, 1, "Ann Bee"), (1, 1, 2, ""), (1, 1, 3, "050-123 4567"), (1, 2, 1, "0501234568"), (1, 3, 1, "x"), (1, 3, 2, "0501234569")], "page int, row int, col int, text string")
    assert {tuple(r) for r in W.contacts_of_cells(cells, ["page"]).collect()} == {(1, 1, "Ann Bee", "0501234567")}
    lines = spark.createDataFrame([(1, 1, "Ann Bee 0501234567 Cy Dee 0501234568"), (1, 2, "Ed Fox"), (1, 3, "0501234569"), (1, 4, "0501234560")], "doc int, ord int, t string")
    assert {tuple(r)[1:] for r in W.contacts_of_lines(lines, ["doc"], "ord", "t").collect()} == {("Ann Bee", "0501234567"), ("Cy Dee", "0501234568"), ("Ed Fox", "0501234569")}
    assert [one(spark, x, W.position_of) for x in ("the resident 2 on call", "FELLOW", "none", None)] == ["Resident 2", "Fellow", None, None]
    legend = spark.createDataFrame([(1, "AB(12) Dr. Ann Bee 0501234567 CD(1) Dr Cy 0501234568 AB(9) Dr. Other 0501234569")], "doc int, t string")
    assert {tuple(r)[1:] for r in W.expand_legend(legend, ["doc"], "t").collect()} == {("AB", "Dr. Ann Bee", "0501234567"), ("CD", "Dr Cy", "0501234568")}
    assert one(spark, "Ann Bee, bee ann; annex", lambda c: W.dictionary_words(c, ["ann", "ann bee", "bee"])) == ["Ann Bee", "bee", "ann"]
    assert [one(spark, x, lambda c: W.valid_name(c, ["On Leave"])) for x in ("Ann Bee", "on leave", "12:30", "al", "", None, "مثال")] == [True, False, False, False, False, False, True]


def test_running_start(spark):
    from watchbill.operators import prefix

    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, null, cast(id % 2 as string)) as k", "if(id = 7, null, id % 11) as v")
    old = prefix.ROWS_PER_BUCKET, prefix.FAN
    prefix.ROWS_PER_BUCKET, prefix.FAN = 40, 8
    try:
        got = prefix.running_start(rows.where("k is not null"), ["k"], ["id"], "v", "at", 5000).toPandas()
    finally:
        prefix.ROWS_PER_BUCKET, prefix.FAN = old
    for _, g in got.groupby("k"):
        g = g.sort_values(["at"], kind="stable")
        g["v"] = g.v.fillna(0)
        ends = (g["at"] + g.v).to_numpy()
        assert g["at"].min() == 0 and ends.max() == g.v.sum()
        full = g[g.v > 0]
        assert (full["at"].to_numpy()[1:] == (full["at"] + full.v).to_numpy()[:-1]).all()

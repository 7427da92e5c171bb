"""Small cases of shifts, people, cells, records and audits: nulls, ties, empty tables, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from watchbill.functions.distance import edits, name_rule, name_rules
from watchbill.operators import people as P
from watchbill.operators import quality as Q
from watchbill.operators import records as X
from watchbill.operators import rows as W
from watchbill.operators import shifts as S


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_windows_are_inferred(spark):
    rows = [
        ("07:30", "16:30", None, "x", (450, 990, "day")), ("16:30", "07:30", None, "x", (990, 450, "night")), ("08:00", "08:00", None, "x", (480, 480, "24h")),
        ("08:00", "20:00", "on-call", "x", (480, 1200, "on-call")), (None, None, "day", "x", (450, 990, "day")), ("noon", None, " ", "24h cover", (450, 450, "24h")), (None, None, None, "ward duty", (450, 990, "day")),
        (None, None, None, "duty after hours", (990, 450, "night")), (None, None, None, "x", None), (None, "08:00", None, None, None)]
    df = spark.createDataFrame([r[:4] + (i,) for i, r in enumerate(rows)], "s string, e string, k string, r string, i int")
    got = df.select("i", S.infer_window(F.col("s"), F.col("e"), F.col("k"), F.coalesce("r", F.lit(""))).alias("w")).orderBy("i").collect()
    assert [tuple(x["w"]) if x["w"] else None for x in got] == [r[4] for r in rows]


def test_in_force_by_steps(spark):
    rows = [
        ("a", 1, "note: holiday", "x", 450, 990), ("a", 2, "consultant", "no coverage", None, None), ("a", 3, "consultant", "x", 450, 990),
        ("b", 4, "consultant", "x", 450, 990), ("b", 5, "fellow", "x", 990, 450), ("c", 6, "fellow", "x", 990, 450), ("d", 7, "ward duty", "x", None, None), ("d", 8, "fellow", "x", 990, 450),
        ("e", 9, "fellow", "x", None, None), ("e", 10, "x", "x", None, None), (None, 11, "consultant", None, 450, 990)]
    df = spark.createDataFrame(rows, "g string, id int, r string, n string, a int, b int").withColumn("w", F.expr("if(a is null, null, struct(a as start, b as end, 'x' as kind))"))
    got = {r["id"] for r in S.in_force(df, ["g"], 600, F.lit(False), "w", "r", "n").collect()}
    assert got == {2, 4, 7, 9, 11}
    assert S.in_force(df.limit(0), ["g"], 600, F.lit(False), "w", "r", "n").count() == 0


def test_calendar_lookahead_and_labels(spark):
    one = spark.range(1)
    rules = spark.createDataFrame([("a", False, 450, 990)], "key string, weekend boolean, start int, end int")
    df = spark.createDataFrame([("a", 500, False), ("a", 500, True), ("b", 500, False), (None, 500, False)], "k string, m int, we boolean")
    assert [r["active"] for r in S.calendar_active(df, "k", F.col("m"), F.col("we"), rules).collect()].count(True) == 1
    look = lambda m: [tuple(x) for x in one.select(S.upcoming(F.lit(m), [("d", 450, 990), ("n", 990, 450)]).alias("x")).first()["x"]]
    assert look(940) == [("d", "current"), ("n", "upcoming")] and look(400) == [("n", "current"), ("d", "upcoming")] and look(600) == [("d", "current")]
    assert [one.select(S.slot_start(F.lit(m))).first()[0] for m in (0, 450, 989, 990, 1259, 1260)] == [1260, 450, 450, 990, 990, 1260]
    times = spark.sql("select timestamp '2026-01-02 00:00:00' as now, explode(array(timestamp '2026-01-02 00:00:01', timestamp '2026-01-01 23:58:00', timestamp '2026-01-01 20:00:00', timestamp '2025-12-30 00:00:00', null)) as t")
    assert [r[0] for r in times.select(S.ago(F.col("now"), F.col("t"))).collect()] == ["just now", "2 min ago", "4 h ago", "3 d ago", None]


def test_undated_rows_stand_in(spark):
    df = spark.createDataFrame([("a", "01/02", 1), ("a", None, 2), ("b", " ", 3), ("b", "03/02", 4), ("c", "05/02", 5), (None, None, 6)], "g string, d string, id int")
    assert {r["id"] for r in S.dated_or_undated(df, ["g"], "d", F.lit("01/02")).collect()} == {1, 3, 6}


def test_people_are_normalized(spark):
    rows = [(1, "Dr.Alpha Dr.Bravo", "05", "r", "d"), (2, "Batool, Ghady", None, "r", "d"), (3, "AW", None, "r", "d"), (4, "Consultant", "05", "r", "d"), (5, None, "05", "r", "d"), (6, "", "05", "r", "d"),
            (7, "wed Faisal", None, "r", "d"), (8, "SARA OWIDAH", None, "r", "d"), (9, "ABC DEF", None, "r", "d"), (10, "Dr Dr. Sara", None, "r", "d"), *[(20 + i, "Same Name", None, "r", None) for i in range(5)], (30, "x" * 90, "05", "r", "d")]
    df = spark.createDataFrame(rows, "id int, name string, phone string, role string, date string")
    got = [(r["id"], r["name"]) for r in P.normalize_people(df, "id", "name", "phone", "role", "date").orderBy("id", "part").collect()]
    assert got == [(1, "Dr. Alpha"), (1, "Dr. Bravo"), (2, "Batool"), (2, "Ghady"), (7, "Faisal"), (8, "SARA OWIDAH"), (10, "Dr. Sara"), (20, "Same Name"), (21, "Same Name"), (22, "Same Name")]


def test_contact_keys(spark):
    rows = [(1, "Dr. AnwrAldhakhel", "051"), (2, "Sara Al Harbi", "052"), (3, "Dr Omar Harbi", "053"), (4, None, "054"), (5, "No Phone", None), (6, "Consultant", "055")]
    got = {r["key"]: r["phone"] for r in P.contact_keys(spark.createDataFrame(rows, "id int, name string, phone string"), [], "name", "phone", "id").collect()}
    assert got["Anwr Aldhakhel"] == got["Aldhakhel"[:0] + "AnwrAldhakhel"] == "051" and got["Al Harbi"] == got["Harbi"] == "052" and got["Dr Omar Harbi"] == "053" and "No Phone" not in got and "Consultant" not in got


def test_name_scores(spark):
    pairs = [("Dr. Sara Khan", "Sara Khan", (100, False)), ("S Khan", "Sara Khan", (16 + 10 + 8 - 3, True)), ("Sara Khan", "Omar Malik", None), ("Ahmad Harbi", "Ahmed Harbi", (16 + 8 + 4 - 1, True)), ("Khan", "Khan Sara", (16 + 5 - 5, True)), ("", "x", None), (None, "x", None)]
    df = spark.createDataFrame([p[:2] + (i,) for i, p in enumerate(pairs)], "a string, b string, i int")
    got = [r["s"] for r in df.select("i", P.name_score(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert [(x["score"], x["uncertain"]) if x["score"] is not None else None for x in got] == [p[2] for p in pairs]


def test_scored_match_finds_what_all_pairs_find(spark):
    r = random.Random(9)
    part = lambda: "".join(r.choice("bdfgklmnrst") + r.choice("aiu") for _ in range(r.randint(2, 4)))
    people = [f"{part()} {part()}" for _ in range(40)]
    typed = [p for p in people[:20]] + [f"{p[0]} {p.split()[1]}" for p in people[:20]] + [f"{p.split()[0]}x {p.split()[1][:-1]}" for p in people] + ["a/b", None, ""]
    left = spark.createDataFrame([(i, "S", n) for i, n in enumerate(typed)], "id int, site string, name string")
    right = spark.createDataFrame([(i, "S", n, None if i % 2 else "R1") for i, n in enumerate(people)] + [(99, "T", people[0], None), (98, "S", None, None)], "cid int, site string, cname string, rank string")
    got = {r["id"]: (r["cid"], r["score"]) for r in P.scored_match(left, "id", "name", ["site"], right, "cid", "cname", 2, [(F.col("rank").isNotNull(), 2)]).collect()}
    want = {}
    for i, n in enumerate(typed):
        if not n or "/" in n:
            continue
        near = lambda x, y: any(t == c or len(t) >= 4 and len(c) >= 4 and edits(t, c, 1) <= 1 for t in x.split() for c in y.split())
        rated = [(s[0] + (0 if k % 2 else 2), -k) for k, p in enumerate(people) if (s := P.score_of(n, p)) and (near(n, p) or len(n.split()[0]) == 1)]
        if rated and max(rated)[0] >= 2:
            want[i] = (-max(rated)[1], max(rated)[0])
    assert {k: (got.get(k), want.get(k), typed[k]) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {} and len(want) > 50


def test_rules_in_batches_equal_the_expression(spark):
    r = random.Random(6)
    words = lambda: ["".join(r.choices("abc", k=r.randint(1, 8))) for _ in range(r.randint(0, 3))]
    df = spark.createDataFrame([(words(), words()) for _ in range(300)] + [(None, ["a"])], "a array<string>, b array<string>").repartition(2).cache()
    got = [tuple(x) for x in df.select(name_rule(F.col("a"), F.col("b")), name_rules(F.col("a"), F.col("b"))).collect()]
    assert [g for g in got if g[0] != g[1]] == [] and len({x for x, _ in got}) >= 3


def test_cells_to_rows(spark):
    cells = [("t", 0, 0, "x"), ("t", 1, 1, "2026-01-01 PM"), ("t", 1, 2, "Ward"), ("t", 1, 3, "Alpha\nBravo"), ("t", 2, 1, "2026-01-02"), ("t", 2, 2, "Section"), ("t", 2, 3, " "), ("u", 5, 0, "Consultant"), ("u", 5, 1, "Section"), ("u", 6, 0, "Zulu"), ("u", 6, 1, "2026-02-02"), ("u", 6, 2, "later")]
    df = spark.createDataFrame(cells, "k string, row int, col int, text string")
    date = "^[0-9]{4}-"
    columns = W.columns_or_fallback(df, ["k"], {"person": "consultant", "place": "section"}, 2, {"place": 1, "person": 2}, date, 0)
    assert values(columns) == [("t", "person", 3), ("t", "place", 2), ("u", "person", 0), ("u", "place", 1)]
    assert values(W.cells_to_rows(df, ["k"], columns, ["place", "person"], date)) == [("t", 1, "2026-01-01 PM", "Ward", "Alpha Bravo"), ("u", 6, "2026-02-02", "2026-02-02", "Zulu")]
    filled = W.filled_columns(df, ["k"], ["a", "b", "c"])
    assert values(filled) == [("t", "a", 1), ("t", "b", 2), ("t", "c", 3), ("u", "a", 0), ("u", "b", 1), ("u", "c", 2)]
    assert values(W.first_map(columns.where("k = 't'"), filled, keys=["k"])) == values(columns.where("k = 't'").unionByName(filled.where("k = 'u'")))
    assert W.cells_to_rows(df.limit(0), ["k"], columns, ["place", "person"], date).count() == 0


def test_missing_columns_lie_on_a_line(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 10.0), ("a", 2, None), ("a", 3, 30.0), ("a", 4, None), ("b", 0, 5.0), ("b", 1, None), ("c", 0, None)], "k string, c int, x double")
    assert [(r["k"], r["c"], r["x"]) for r in W.interpolated(df, ["k"], "c", "x").orderBy("k", "c").collect()] == [("a", 0, 0.0), ("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 30.0), ("a", 4, 40.0), ("b", 0, 5.0), ("b", 1, None), ("c", 0, None)]


def test_lines(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(W.name_near_phone(F.lit("12/03 1st On-Call Dr. Alpha Bravo  0501234567  ext"))) == "Dr. Alpha Bravo"
    assert one(W.name_near_phone(F.lit("0501234567"))) is None and one(W.half_of_day(F.lit("Sun 1/2 pm"))) == "PM" and one(W.half_of_day(F.lit("spam"))) is None
    assert [one(W.day_name(F.lit(x))) for x in ("monday", "TUE", "Sunset", "", "satday")] == ["Mon", "Tue", None, None, "Sat"]
    assert one(W.compacted(F.lit("aB 12/03/26 x0501234567y"))) == "a B\n12/03/26 x 0501234567 y"
    assert tuple(one(W.from_right(F.split(F.lit("a b c d"), " "), ["x", "y"]))) == ("c", "b") and tuple(one(W.from_right(F.split(F.lit("a"), " "), ["x"]))) == (None,)
    assert one(W.template_hits(F.lit("rota ward"), ["rota", "ward", "zz"])) == 2 and one(W.template_hits(F.lit(None).cast("string"), ["a"])) == 0
    df = spark.createDataFrame([(1, 3), (2, None), (3, 0)], "id int, h int")
    out = W.parse_by(df, {"x": (F.col("h") > 1, lambda d: d)}, lambda d: d)
    assert values(out.select("id", "parser_mode")) == [(1, "x"), (2, "generic"), (3, "generic")]


def test_records(spark):
    j = spark.createDataFrame([(1, '{"entries": [{"a": "x", "b": 1}, {"a": null}]}'), (2, '{"a": "y"}'), (3, None), (4, "no json"), (5, '{"entries": []}')], "id int, t string")
    flat = X.flattened(j, ["id"], F.col("t"), "entries", "a string, b int")
    assert values(flat) == [(1, 1, "x", 1), (1, 2, None, None), (2, 1, "y", None)]
    assert {r["id"]: r["data"] for r in X.rebuilt(flat, ["id"], ["a", "b"], "entries").collect()} == {1: '{"entries":[{"a":"x","b":1},{}]}', 2: '{"entries":[{"a":"y"}]}'}
    v = spark.createDataFrame([("k", 1, False), ("k", 2, None), ("k", 3, True), (None, 4, False)], "k string, at int, bad boolean")
    assert values(X.accepted_history(v, ["k"], "at", [F.desc("at")], F.col("bad")).select("at", "state")) == [(1, "past"), (2, "active"), (3, "rejected"), (4, "active")]
    cur = spark.createDataFrame([("a", "1"), ("b", "1"), (None, "1")], "k string, d string")
    new = spark.createDataFrame([("a", "8"), ("a", "9"), ("b", "9"), ("c", "1")], "k string, d string")
    assert values(X.replaced_if(cur, new, ["k"], "d", 2)) == [("a", "8"), ("a", "9"), ("b", "1")]
    people = spark.createDataFrame([(1, "s", "P", "resident"), (2, "s", "P", "consultant"), (3, "s", "Q", "other"), (4, "s", None, "resident"), (5, "s", None, "resident")], "id int, s string, p string, r string")
    assert {r["id"] for r in X.exclusive(people, ["s"], "p", "r", ["consultant", "resident"], F.asc("id")).collect()} == {2, 3, 4, 5}
    words = spark.createDataFrame([("a", ["X ", "y", ""]), ("b", None), (None, ["z"])], "k string, w array<string>")
    assert values(X.united_keywords(words, spark.createDataFrame([("a", ["x", "w"]), ("c", [])], "k string, w array<string>"), "k", "w")) == [("a", ["w", "x", "y"]), ("b", []), ("c", [])]
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, None, 0)], "id int, s string, v int")
    out, log = X.moved(table, spark.createDataFrame([(1, "z", 5), (2, "b", 5), (9, "q", 5)], "id int, s string, at int"), "id", "s", "at", "v")
    assert values(out) == [(1, "z", 5), (2, "b", 0), (3, None, 0)] and values(log) == [(1, "a", "z", 5)]


def test_suffix_and_alias_joins(spark):
    a = spark.createDataFrame([(1, "Dr. Sara Khan"), (2, "Khan"), (3, "Mohan"), (4, None), (5, "--")], "id int, name string")
    b = spark.createDataFrame([("Sara Khan", "p", 2), ("khan", "q", 1), (None, "r", 0)], "n string, v string, o int")
    assert {r["id"]: r["v"] for r in X.by_suffix(a, "name", b, "n", "v", "o").collect()} == {1: "q", 2: "q", 3: None, 4: None, 5: None}
    c = spark.createDataFrame([(1, "s", "Sara", "05"), (2, "s", "Dr. Sara Khan", "05"), (3, "s", "Omar", "06"), (4, "s", "Dr Sara", "05")], "id int, s string, name string, phone string")
    assert values(X.aliases(c, ["s"], "name", "phone", "id")) == [("s", "Dr Sara", "Dr. Sara Khan"), ("s", "Sara", "Dr. Sara Khan")]
    cat = spark.createDataFrame([("heart_clinic", "Heart Clinic", ["cardio"]), ("brain_surgery", "Brain Surgery", ["neuro surgery"]), ("brain_medicine", "Brain", None)], "k string, l string, w array<string>")
    t = spark.createDataFrame([(1, "heart clinic"), (2, "CARDIO"), (3, "surgery"), (4, "bra"), (5, "zzz"), (6, " "), (7, None)], "id int, t string")
    assert values(X.match_alias(t, "id", "t", cat, "k", "l", "w")) == [(1, "heart_clinic", "exact"), (2, "heart_clinic", "alias"), (3, "brain_surgery", "fuzzy"), (4, "brain_medicine", "ambiguous"), (5, None, "new")]


def test_audits(spark):
    rows = [("a", "x", 90), ("a", "y", 90), ("a", "A / B", 40), ("b", None, 90), ("c", "no coverage", 0), ("d", "x", 10)]
    df = spark.createDataFrame(rows, "k string, n string, s int")
    quiet = F.contains(F.coalesce("n", F.lit("")), F.lit("no coverage"))
    out = {r["k"]: (r["usable"], r["overall"], r["issues"]) for r in Q.record_audit(df, ["k"], F.col("n").isNotNull() & ~quiet, F.col("s"), quiet, [(Q.merged_names(F.col("n")), "merged")]).collect()}
    assert out == {"a": (3, "medium", ["merged"]), "b": (0, "low", ["no-usable-rows"]), "c": (0, "high", []), "d": (1, "low", [])}
    assert values(Q.lost_names(*[spark.createDataFrame(x, "k string, n string") for x in ([("s", "Dr. Sara Khan"), ("s", "Omar"), ("s", "abc"), ("t", "Sara Khan")], [("s", "SaraKhan")])], ["k"], "n")) == [("s", "Omar"), ("t", "Sara Khan")]
    score, reasons = Q.trust(F.col("b"), [(F.col("x"), 20), (F.col("y"), 90)], (F.col("f"), 72))
    t = spark.createDataFrame([(90, True, False, False), (90, True, True, False), (90, True, None, True), (150, None, None, None)], "b int, x boolean, y boolean, f boolean")
    assert [tuple(r) for r in t.select(score, reasons).collect()] == [(70, [1]), (0, [1, 2]), (72, [1]), (100, [])]
    assert Q.upper_only(df.limit(0), ["k"], F.col("s") > 1, F.col("s") < 1).count() == 0


def test_interval_join_keeps_repeated_rows(spark):
    from watchbill.operators.matching import interval_join

    shifts = spark.createDataFrame([(1, 0, 10, 1, "a"), (1, 5, 20, 2, "b"), (1, 9, 9, 0, "z")], "k int, s int, e int, o int, v string")
    rows = spark.createDataFrame([(1, 7, "x"), (1, 7, "x"), (1, 15, "y"), (1, 99, "z"), (None, 7, "w"), (1, None, "u")], "k int, t int, tag string")
    assert values(interval_join(rows, "t", ["k"], shifts, "s", "e", "o", "v", cell=8)) == sorted([(1, 7, "x", "a"), (1, 7, "x", "a"), (1, 15, "y", "b"), (1, 99, "z", None), (None, 7, "w", None), (1, None, "u", None)], key=str)


def test_appended_accepted_and_raised(spark):
    c = spark.createDataFrame([("s", "a", "1"), (None, "b", "2")], "s string, k string, p string")
    r = spark.createDataFrame([("s", "a", "9"), ("s", "c", "4"), ("s", "c", "3"), (None, "d", "5")], "s string, k string, p string")
    assert values(X.appended(c, r, ["s", "k"])) == sorted([("s", "a", "1"), (None, "b", "2"), ("s", "c", "3")], key=str)
    names = spark.createDataFrame([(1, "A. Khan"), (2, "Sara Malik"), (3, None), (4, "x")], "id int, n string")
    new = spark.createDataFrame([(1, "Dr. Ali KHAN"), (2, "Sara Khan"), (3, "y"), (4, " ")], "id int, n string")
    assert values(X.accepted_names(names, new, ["id"], "n")) == [(1, "Dr. Ali KHAN"), (2, "Sara Malik"), (3, None), (4, "x")]
    ranks = spark.createDataFrame([("R2", "R4"), ("R4", "R2"), (None, "R1"), ("R2", None), ("x", "R1")], "l string, r string")
    assert [x[0] for x in ranks.select(X.raised(F.col("l"), F.col("r"), ["R1", "R2", "R4"])).collect()] == ["R4", "R4", "R1", "R2", "R1"]

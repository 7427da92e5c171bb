"""Packed fields: stated cases, and a character-by-character splitter on the whole small table."""

import re

import pytest
from pyspark.sql import functions as F

from watchbill.operators.multivalue import explode_values, values_of

CASES = [
    (None, None),
    ("", []),
    ("  / ; ", []),
    ("Dr. Alpha Bravo", ["Dr. Alpha Bravo"]),
    ("Dr. Alpha Bravo / Dr Charlie Delta", ["Dr. Alpha Bravo", "Dr Charlie Delta"]),
    ("Dr. Alpha Bravo  Dr. Charlie Delta", ["Dr. Alpha Bravo", "Dr. Charlie Delta"]),
    ("Dr. Alpha Bravo Dr. Charlie Delta", ["Dr. Alpha Bravo", "Dr. Charlie Delta"]),
    ("Prof. Dr. Alpha Bravo", ["Prof. Dr. Alpha Bravo"]),
    ("Alpha Bravo, and Charlie Delta", ["Alpha Bravo", "Charlie Delta"]),
    ("Alpha Bravo AND Charlie Delta & Echo", ["Alpha Bravo", "Charlie Delta", "Echo"]),
    ('"Bravo, Alpha"', ["Bravo, Alpha"]),
    ('"Bravo, Alpha" / "Delta ""Dee"" Charlie"', ["Bravo, Alpha", 'Delta "Dee" Charlie']),
    ("'Bravo, Alpha','Delta, Charlie'", ["Bravo, Alpha", "Delta, Charlie"]),
    ("O'Hara, Dee / D'Arc Joan", ["O'Hara", "Dee", "D'Arc Joan"]),
    ('["Dr Alpha Bravo", "Charlie, Delta"]', ["Dr Alpha Bravo", "Charlie, Delta"]),
    ("1. Alpha Bravo 2. Charlie Delta", ["Alpha Bravo", "Charlie Delta"]),
    ("(1) Alpha Bravo\n(2) Charlie Delta", ["Alpha Bravo", "Charlie Delta"]),
    ("• Alpha Bravo • Charlie Delta", ["Alpha Bravo", "Charlie Delta"]),
    ("Dr Alpha (ICU/ER) / Dr Bravo (ext 4, 5)", ["Dr Alpha (ICU/ER)", "Dr Bravo (ext 4, 5)"]),
    ("Alpha Al-Bravo - Charlie Delta", ["Alpha Al-Bravo", "Charlie Delta"]),
    ("/ Alpha / / Bravo /", ["Alpha", "Bravo"]),
    ("Bravo, Alpha", ["Bravo, Alpha"]),
    ("Resident 2", ["Resident 2"]),
]


@pytest.mark.parametrize("text,values", CASES)
def test_values(spark, text, values):
    got = spark.createDataFrame([(text,)], "t string").select(values_of(F.col("t"))).first()[0]
    assert got == values


def test_positions_and_single_values(spark):
    df = spark.createDataFrame([(1, "a b / c d", "x"), (1, "a b / c d", "x"), (2, "one", None), (3, None, "p q;r s;t u")], "id int, field string, val string")
    rows = explode_values(df, ["id"], ["field", "val"]).collect()
    assert sorted((r["id"], r["field"], r["pos"], r["val"]) for r in rows) == [
        (1, "field", 1, "a b"), (1, "field", 1, "a b"), (1, "field", 2, "c d"), (1, "field", 2, "c d"), (3, "val", 1, "p q"), (3, "val", 2, "r s"), (3, "val", 3, "t u")]


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([], "id int, name string")
    assert explode_values(df, ["id"], ["name"]).count() == 0
    long = " / ".join(f"Alpha{i} Bravo (x, y)" for i in range(20_000))
    rows = explode_values(spark.createDataFrame([(1, long)], "id int, name string"), ["id"], ["name"])
    assert rows.count() == 20_000


def brute(text):
    """A second reading of a field without quotes, numbers and titles inside: letter by letter."""
    out, depth, now, i = [], 0, "", 0
    while i < len(text):
        word = next((w for w in (" and ", " AND ", " - ") if depth == 0 and text.startswith(w, i)), None)
        if word or (depth == 0 and text[i] in "/,;|\\&+\n\t\u2022\u00b7\u060c"):
            out.append(now)
            now = ""
            i += len(word) - 1 if word else 1
            continue
        depth += (text[i] == "(") - (text[i] == ")")
        now += text[i]
        i += 1
    return [v.strip() for v in [*out, now] if any(x.isalnum() for x in v)]


def test_against_brute_force(spark, small):
    """All fields of the small table but those whose reading needs quotes, numbering, runs of blanks or inner titles."""
    rows = spark.read.parquet(f"{small}/entry.parquet").where("name is not null").select("name", values_of(F.col("name")).alias("v")).collect()
    checked = 0
    for r in rows:
        n = r["name"]
        if re.search(r"[\"'\[\]]|^\(?\d|  |[^/,;|\\&+\n\t\u2022\u00b7\u060c] (?:Dr|DR|dr|Prof)\b", n.replace(" and ", " / ").replace(" AND ", " / ").replace(" - ", " / ")) or re.fullmatch(r"[^ ]+, [^ ]+", n):
            continue
        checked += 1
        assert r["v"] == brute(n), n
    assert checked > 300

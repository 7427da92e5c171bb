"""Snapshot differences against dictionaries, and the notations that do not count."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchbill.operators.snapshots import instant, json_text, snapshot_changes, with_values


@pytest.mark.parametrize("a,b", [
    ("2026-02-09T03:29:54+01:00", "2026-02-09T02:29:54Z"), ("2026-02-09 05:29:54+03", "2026-02-09T02:29:54.000+00:00"),
    ("2026-02-09 02:29:54", "2026-02-09T02:29:54Z"), ("2026-02-09 02:29:54.5+0000", "2026-02-09T02:29:54.500Z")])
def test_one_instant(spark, a, b):
    x, y = spark.createDataFrame([(a, b)], "a string, b string").select(instant(F.col("a")), instant(F.col("b"))).first()
    assert x == y is not None


def test_json(spark):
    rows = [('{"a": 1, "b": [1, null]}', '{ "b":[1,null],\n"a":1}', True), ('"\\u00e9"', '"é"', True), ('{"a":null}', "{}", False), ("[1,2]", "[2,1]", False), ("no json", "no json", True)]
    df = spark.createDataFrame(rows, "a string, b string, same boolean")
    assert df.where((json_text(F.col("a")) == json_text(F.col("b"))) != F.col("same")).count() == 0


def test_changes(spark):
    rows = [(1, 1, "a", 1), (1, 2, "b", 1), (1, 2, "b", 2), (1, 3, None, 1), (2, 1, "a", 1), (2, 3, "", 1), (2, 4, "d", 5), (2, 4, "e", 1), (4, 4, "d", 1), (4, None, "x", 1), (None, 9, "x", 1)]
    df = spark.createDataFrame(rows, "snap int, id int, v string, at int")
    got = snapshot_changes(df, "snap", ["id"], [F.col("v")], "at", buckets=3)
    want = {(2, 2, "removed"), (2, 3, "changed"), (2, 4, "added"), (4, 1, "removed"), (4, 3, "removed")}
    assert {tuple(r) for r in got.collect()} == want
    text = df.withColumn("id", F.concat(F.lit("k"), "id"))
    assert {(a, int(b[1:]), c) for a, b, c in snapshot_changes(text, "snap", ["id"], [F.col("v")], "at").collect()} == want
    values = {(r["snap"], r["id"]): (r["old_v"], r["new_v"]) for r in with_values(got, df, "snap", ["id"], ["v"], "at").collect()}
    assert values[2, 2] == ("b", None) and values[2, 3] == (None, "") and values[2, 4] == (None, "d")


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "snap int, id bigint, change string")
    assert snapshot_changes(none, "snap", ["id"], [F.col("change")]).count() == 0
    assert snapshot_changes(spark.createDataFrame([(1, 5, "x")], "snap int, id bigint, change string"), "snap", ["id"], [F.col("change")]).count() == 0


def test_whole_small_table(spark, small):
    from watchbill.plans.problems import p2_found

    state = {}
    for r in spark.read.parquet(f"{small}/rota_snapshot.parquet").collect():
        at = datetime.fromisoformat(r["created_at"].replace("Z", "+00:00")).timestamp() if r["created_at"] else None
        data = None if r["data"] is None else json.dumps(json.loads(r["data"]), sort_keys=True)
        state.setdefault(r["snap_no"], {})[r["record_id"]] = (r["specialty"] and r["specialty"].strip().lower(), at, data)
    want = set()
    for n in range(2, 7):
        a, b = state[n - 1], state[n]
        want |= {(n, k, "added") for k in b.keys() - a.keys()} | {(n, k, "removed") for k in a.keys() - b.keys()} | {(n, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert {tuple(r) for r in p2_found(spark, small).collect()} == want


def test_every_consecutive_pair(spark):
    from watchbill.operators.analytics import changes_log
    from watchbill.operators.quality import version_loss
    from watchbill.operators.resolve import changed_groups
    from watchbill.operators.snapshots import consecutive

    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (3, "a", 1), (7, "a", 1), (7, "b", 5), (None, "a", 9)], "snap int, k string, v int")
    old, new = consecutive(df, "snap")
    assert {tuple(r) for r in changed_groups(old, new, ["snap", "k"], F.col("v")).collect()} == {(3, "a", "changed"), (7, "b", "added")}
    assert {tuple(r) for r in version_loss(old, new, ["snap", "k"]).collect()} == {(3, "a", 2, 1, True), (7, "a", 1, 1, False)}
    assert {tuple(r)[:3] for r in changes_log(old, new, ["snap", "v"], ["k"]).collect()} == {(3, 2, "delete"), (7, 5, "add")}
    assert consecutive(df.where("snap = 1"), "snap")[0].count() == 0

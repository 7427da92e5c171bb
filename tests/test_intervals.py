"""Periods and gaps against a sweep, over cells, batches and hot keys."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from watchbill.functions.clock import clock_minute, minute_text, shift_bounds
from watchbill.operators.intervals import CELL, cover, merge_sorted


def sweep(rows):
    out = []
    for k in {r[0] for r in rows}:
        now = None
        for a, b in sorted((a, b) for x, a, b in rows if x == k and a is not None and b is not None and a < b):
            if now is None or a > now[1]:
                if now:
                    out += [(k, "period", *now), (k, "gap", now[1], a)]
                now = [a, b]
            else:
                now[1] = max(now[1], b)
        if now:
            out.append((k, "period", *now))
    return sorted(out, key=repr)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50), st.integers(1, 20)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_merge_sorted(rows):
    rows = sorted(rows)
    g, s, e = merge_sorted(*(np.array([r[i] for r in rows], np.int64) for i in (0, 1)), np.array([r[1] + r[2] for r in rows], np.int64))
    want = sorted((k, a, b) for k, what, a, b in sweep([(k, a, a + n) for k, a, n in rows]) if what == "period")
    assert list(zip(g.tolist(), s.tolist(), e.tolist())) == want


@pytest.mark.parametrize("batch", [7, 10_000])
def test_hot_key_over_cells(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), (F.hash("id") % 900_000).cast("bigint").alias("a"))
        df = df.withColumn("b", F.col("a") + 1 + F.pmod(F.xxhash64("a"), F.lit(400))).repartition(5)
        got = sorted(map(tuple, cover(df, ["k"], F.col("a"), F.col("b"), fan=3).collect()), key=repr)
        assert got == sweep([tuple(r) for r in df.collect()])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark):
    rows = [("a", 0, 5), ("a", 5, 9), ("a", 5, 9), ("a", 20, 20), ("a", None, 3), ("a", 30, 29), (None, 1, 2), (None, 4, 5), ("b", CELL - 1, CELL + 1), ("b", 0, 3 * CELL)]
    df = spark.createDataFrame(rows, "k string, from_at int, kind int")
    got = sorted(map(tuple, cover(df, ["k"], F.col("from_at"), F.col("kind")).collect()), key=repr)
    assert got == sweep(rows)
    assert cover(df.limit(0), ["k"], F.col("from_at"), F.col("kind")).count() == 0


@pytest.mark.parametrize("text,minute", [
    ("07:30", 450), ("7:30", 450), ("0730", 450), ("07.30", 450), ("07h30", 450), ("07:30:00", 450), ("7:30 PM", 1170), ("12:00am", 0), ("12:15 PM", 735), (" ٠٧:٣٠ ", 450), ("24:00", 1440), ("7pm", 1140),
    ("25:00", None), ("16:75", None), ("24:01", None), ("13:00 pm", None), ("noon?", None), ("TBA", None), ("-", None), ("", None), (None, None), ("7", None), ("730", None)])
def test_clock(spark, text, minute):
    assert spark.createDataFrame([(text,)], "t string").select(clock_minute(F.col("t"))).first()[0] == minute


def test_shift_over_midnight(spark):
    df = spark.sql("select date'2026-03-01' d, '20:00' s, '08:00' e union all select date'2026-03-01', '08:00', '8:00' union all select date'2026-03-01', '12:00', '24:00'")
    a, b = shift_bounds(F.col("d"), F.col("s"), F.col("e"))
    assert [tuple(r) for r in df.select(minute_text(a), minute_text(b)).collect()] == [
        ("2026-03-01 20:00", "2026-03-02 08:00"), ("2026-03-01 08:00", "2026-03-02 08:00"), ("2026-03-01 12:00", "2026-03-02 00:00")]

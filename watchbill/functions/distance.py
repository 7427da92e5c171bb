"""Edit distances as column expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def within(a: Column, b: Column, most: int) -> Column:
    """Whether the plain edit distance is at most `most`; the bounded form stops early and gives -1 beyond."""
    return F.coalesce(F.levenshtein(a, b, most) >= 0, F.lit(False))


def osa(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: edits and swaps of neighbours at cost 1, no letter edited twice.

    One fold over the letters of a that carries the last two rows, each an inner fold over the letters of b: JVM only.
    """
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    y = letters(b)
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda i: i.cast("int"))
    state = F.struct(F.lit(0).alias("i"), F.lit("").alias("p"), zero.alias("last"), zero.alias("before"))

    def row(acc: Column, c: Column) -> Column:
        first = F.array((acc["i"] + 1).cast("int"))
        numbered = F.transform(y, lambda d, j: F.struct(d.alias("d"), j.alias("j")))

        def cell(line: Column, x: Column) -> Column:
            j = x["j"] + 1
            best = F.least(
                F.element_at(acc["last"], j + 1) + 1, F.element_at(line, -1) + 1,
                F.element_at(acc["last"], j) + F.when(c == x["d"], 0).otherwise(1),
            )
            swap = (acc["i"] > 0) & (j > 1) & (acc["p"] == x["d"]) & (F.try_element_at(y, F.greatest(j - 1, F.lit(1))) == c)
            swapped = F.when(swap, F.element_at(acc["before"], F.greatest(j - 1, F.lit(1))) + 1).otherwise(best)
            return F.concat(line, F.array(F.least(best, swapped).cast("int")))

        line = F.aggregate(numbered, first, cell)
        return F.struct((acc["i"] + 1).alias("i"), c.alias("p"), line.alias("last"), acc["last"].alias("before"))

    folded = F.aggregate(letters(a), state, row)
    return F.when(a == b, 0).when(F.length(b) == 0, F.length(a)).otherwise(F.element_at(folded["last"], -1))


def token_rule(target: Column, candidate: Column) -> Column:
    """How a word of a candidate fits a word looked for: 1 exact, 2 prefix (3 letters or more), 3 one edit (4 letters or
    more), 4 two edits (6 letters or more); null if it does not."""
    short = F.least(F.length(target), F.length(candidate))
    # the native distance counts a swap as two edits; a distance of 2 with other letters, or of 4 unless it is two swaps
    # of the same letters, needs no alignment, which leaves few pairs for the slow one
    plain = F.levenshtein(target, candidate, 4)
    letters = lambda w: F.array_sort(F.split(w, ""))
    same = (F.length(target) == F.length(candidate)) & (letters(target) == letters(candidate))
    mixed = (plain == 3) & (F.abs(F.length(target) - F.length(candidate)) <= 1) & (F.size(F.array_except(letters(target), letters(candidate))) <= 1)
    close = F.when(plain < 2, plain).when(same | mixed, osa(target, candidate)).when(plain == 2, 2).otherwise(9)
    edits = F.when((short >= 4) & (plain >= 0), F.when(close <= 1, 3).when((short >= 6) & (close <= 2), 4))
    return F.when(target == candidate, 1).when((short >= 3) & (F.startswith(candidate, target) | F.startswith(target, candidate)), 2).otherwise(edits)


def name_rule(target: Column, candidate: Column, least: int = 3) -> Column:
    """Rule of two names given as arrays of words: the worst, over the significant words looked for (`least` letters or
    more), of the best rule any word of the candidate gives; null if a word fits none or none is significant."""
    words = F.filter(target, lambda w: F.length(w) >= least)
    best = F.transform(words, lambda t: F.array_min(F.transform(candidate, lambda c: F.coalesce(token_rule(t, c), F.lit(9)))))
    worst = F.array_max(best)
    return F.when((F.size(words) > 0) & (worst < 9), worst)


def edits(a: str, b: str, limit: int) -> int:
    """The same distance of two strings in Python, limit + 1 if larger: for Arrow batches of many pairs."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    low, most = 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    high = 0
    while high < most - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    far = limit + 1
    above, line = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [far] * len(b)
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            d = min(line[j - 1] + (x != b[j - 1]), line[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, above[j - 2] + 1)
            new[j] = d
        if min(new) > limit:
            return far
        above, line = line, new
    return min(line[-1], far)


def _word_rule(t: str, c: str) -> int:
    if t == c:
        return 1
    short = min(len(t), len(c))
    if short >= 3 and (t.startswith(c) or c.startswith(t)):
        return 2
    d = edits(t, c, 2) if short >= 4 else 9
    return 3 if d <= 1 else 4 if d == 2 and short >= 6 else 9


def _rule(target: Sequence[str], candidate: Sequence[str], least: int, known: dict) -> int | None:
    worst = 0
    for t in target:
        if len(t) < least:
            continue
        best = 9
        for c in candidate:
            pair = t, c
            if pair not in known:
                if len(known) > 1_000_000:
                    known.clear()
                known[pair] = _word_rule(t, c)
            best = min(best, known[pair])
        if best == 9:
            return None
        worst = max(worst, best)
    return worst or None


def name_rules(target: Column, candidate: Column, least: int = 3) -> Column:
    """name_rule in Arrow batches: each two words are compared once a task, which many pairs of names gain from."""

    @F.pandas_udf("int")
    def rule(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict = {}
        for a, b in parts:
            yield pd.Series([None if x is None or y is None else _rule(x, y, least, known) for x, y in zip(a, b)], dtype="Int32")

    return rule(target, candidate)

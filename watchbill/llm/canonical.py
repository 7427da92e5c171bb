"""Freely typed values mapped to the closest entry of a reference list, unmatched values reported.

The list's words go into a symmetric-delete dictionary: a word is found through the strings that remain when up to two
letters are taken out of it and of the dictionary's words. Candidates are ranked by weighted Damerau-Levenshtein
distance of their words, by what is typed of the phone, and by how often each entry of the list is used.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchbill.llm.names import distance, least_assignment, memo, nickname, phone_digits, tokens
from watchbill.sources.tables import busy_parts, written

BLOCK = 20_000  # entries of the list in one dictionary; a longer list is looked up block by block

# Letters that stand for each other when a name is spelled by ear.
_ALIKE = frozenset((x, y) for k in ("kqc", "wv", "vf", "sz", "ou", "ei", "iy", "ey", "bp", "gj", "dt", "uw", "ae") for x in k for y in k)


@memo
def weighted(a: str, b: str) -> float:
    """Weighted Damerau-Levenshtein distance: letters that sound alike 0.4, repeated letters 0.3, swaps 0.7, else 1."""
    if a == b:
        return 0.0
    before, last = None, [0.0]
    for j, y in enumerate(b):
        last.append(last[j] + (0.3 if j and b[j - 1] == y else 1))
    for i, x in enumerate(a):
        drop = 0.3 if i and a[i - 1] == x else 1
        row = [last[0] + drop]
        for j, y in enumerate(b):
            d = last[j] + (0 if x == y else 0.4 if (x, y) in _ALIKE else 1)
            d = min(d, last[j + 1] + drop, row[j] + (0.3 if j and b[j - 1] == y else 1))
            if before is not None and i and j and x == b[j - 1] and a[i - 1] == y:
                d = min(d, before[j - 1] + 0.7)
            row.append(d)
        before, last = last, row
    return last[-1]


def deletes(word: str, most: int) -> set[str]:
    """word and what remains of it without up to `most` letters."""
    out, layer = {word}, {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out |= layer
    return out


def _reach(word: str) -> int:
    return 0 if len(word) < 3 else 1 if len(word) < 5 else 2


@memo
def word_cost(q: tuple[str, str, bool], r: tuple[str, str, bool]) -> float:
    """Cost of reading the typed word q as the list's word r; infinite if too far."""
    if q[0] == r[0]:
        return 0.0
    if q[2] and len(q[0]) == 1:
        return 0.8 if r[0][0] == q[0] or r[1][0] == q[1][0] else float("inf")
    if q[2] and len(q[0]) > 1 and r[0].startswith(q[0]):
        return 0.5
    pet = 0.9 if nickname(q[0], r[0]) else float("inf")
    if distance(q[1], r[1], 3) > 3 and distance(q[0], r[0], 3) > 3:
        return pet
    cost = min(weighted(q[0], r[0]), 0.15 + weighted(q[1], r[1]), pet)
    return cost if cost <= min(2.4, 0.5 * len(r[0])) else float("inf")


def name_cost(typed: list, known: list) -> float | None:
    """Least cost over the orders in which the typed words can be read as the known ones; None if they do not fit.

    A typed word too many (a middle name) costs 0.3, a known word that was not typed 2.2.
    """
    if not typed or not known:
        return None
    costs = [[word_cost(q, r) for r in known] for q in typed]
    if len(typed) == len(known) == 2:  # the usual case
        best = min(costs[0][0] + costs[1][1], costs[0][1] + costs[1][0])
        return best if best < float("inf") else None
    best = None
    small, large = (len(typed), len(known)) if len(typed) <= len(known) else (len(known), len(typed))
    if large > 4:
        best = least_assignment(costs if len(typed) <= len(known) else [list(c) for c in zip(*costs)])
    for places in () if large > 4 else itertools.permutations(range(large), small):
        pairs = zip(range(small), places) if len(typed) <= len(known) else zip(places, range(small))
        cost = sum(costs[i][j] for i, j in pairs)
        if cost < float("inf") and (best is None or cost < best):
            best = cost
    if best is None:
        return None
    return best + (0.3 * (len(typed) - len(known)) if len(typed) > len(known) else 2.2 * (len(known) - len(typed)))


def phone_level(typed: tuple[str, str], known: str, slips: frozenset[str] = frozenset()) -> int:
    """3 the number, 2 one slip away from it (one of `slips`), 1 its end or beginning, 0 nothing known, -1 another number."""
    whole, part = typed
    if whole:
        return 3 if whole == known else 2 if known in slips else -1
    if part.endswith("-"):
        return 1 if known.startswith(part[:-1]) else -1
    return 0 if not part else 1 if known.endswith(part) else -1


class SymmetricDelete:
    """Dictionary of a list's names and phones, for look-ups within a bounded distance."""

    def __init__(self, rows: list[tuple[int, str, str, int]]):
        self.rows = {i: (tokens(name), phone_digits(phone)[0], uses) for i, name, phone, uses in rows}
        self.words, self.phones, self.ends, self.numbers = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
        self.holders = defaultdict(set)
        self.near = memo(self.near)
        for i, (words, phone, _) in self.rows.items():
            for w in words:
                self.holders[w[1]].add(i)
            if phone:
                for d in deletes(phone, 1):
                    self.phones[d].add(i)
                self.ends[phone[-4:]].add(i)
                self.numbers[phone].add(i)
        for word in self.holders:
            for d in deletes(word, _reach(word)):
                self.words[d].add(word)

    def near(self, word: str) -> frozenset[int]:
        """Entries of the list that hold a word within the reach of word."""
        sure, open_ = set(), set()
        for d in deletes(word, _reach(word)):
            mine = len(word) - len(d)
            for w in self.words.get(d, ()):
                # letters taken out of both words together are at least as many as the edits between them
                (sure if mine + len(w) - len(d) <= 2 else open_).add(w)
        sure.update(w for w in open_ - sure if distance(word, w, 2) <= 2)
        return frozenset(i for w in sure for i in self.holders[w])

    def slips(self, whole: str) -> frozenset[str]:
        """Numbers of the list that are one edit away from a whole number."""
        if not whole:
            return frozenset()
        found = {self.rows[i][1] for d in deletes(whole, 1) for i in self.phones.get(d, ())}
        return frozenset(n for n in found if distance(whole, n, 1) == 1)

    def candidates(self, words: list, phone: tuple[str, str], slips: frozenset[str] = frozenset()) -> set[int]:
        out = {i for w in words if len(w[0]) > 1 for i in self.near(w[1])}
        if phone[0]:
            out |= {i for n in (*slips, phone[0]) for i in self.numbers.get(n, ())}
        elif len(phone[1]) == 4:
            out |= self.ends.get(phone[1], set())
        return out

    def best(self, name: str | None, phone: str | None) -> tuple[int, float]:
        """(entry meant, its score), or (0, 0.0) if nobody in the list is meant."""
        words, digits = [w for w in tokens(name) if w[0] not in NO_NAME], phone_digits(phone)
        person = sum(len(w[0]) > 1 and not w[2] for w in words) >= 2
        scored = []
        slips = self.slips(digits[0])
        for i in self.candidates(words, digits, slips):
            known, number, uses = self.rows[i]
            level = phone_level(digits, number, slips) if number else 0
            if level < 0 and 6 + LEVELS[level] < ACCEPT:
                continue
            cost = name_cost(words, known)
            score = (0 if cost is None else max(0.0, 6 - 2 * cost)) + LEVELS[level]
            if cost is None and (level < 3 or person):
                continue
            scored.append((score, uses, -i))
        if not scored:
            return 0, 0.0
        score, _, i = max(scored)
        return (-i, score) if score >= ACCEPT else (0, 0.0)


# Least score: two words that both fit at a cost of two letters, or a known number.
ACCEPT = 1.95
# Points of what is typed of a phone, by phone_level.
LEVELS = {3: 5, 2: 4, 1: 3, 0: 0, -1: -5}
# Words typed in place of a name.
NO_NAME = frozenset("duty phone consultant resident on leave cover coverage call no note vacant tba team holiday".split())


def _lookup(dictionary, name: str, phone: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # kept with the broadcast, which a worker holds for all its tasks
        table = vars(dictionary).get("_wb_table")
        if table is None:
            table = dictionary._wb_table = SymmetricDelete(dictionary.value)
        for f in frames:
            found = [table.best(n, p) for n, p in zip(f[name], f[phone])]
            yield f[[name, phone]].assign(best_id=[i for i, _ in found], score=[float(s) for _, s in found])

    return run


def map_to_list(df: DataFrame, name: str, phone: str, reference: DataFrame, uses: Column | None = None) -> DataFrame:
    """df with best_id, the id of the entry of `reference` (id, name, phone) that name and phone together mean, or 0.

    Each distinct (name, phone) is looked up once. The list travels to the executors in blocks of BLOCK entries, so
    that no broadcast grows with it; the best of all blocks counts, on equal scores the entry used more often, then
    the smaller id. uses is a column of reference; without it all entries count alike. Null, empty or unreadable names
    and phones say nothing; if both do, or nothing is near enough, best_id is 0, so every row of df is reported once.
    An empty list gives 0 everywhere. A column best_id of df is replaced.
    """
    spark = df.sparkSession
    pairs = df.select(F.col(name).alias("_wb_name"), F.col(phone).alias("_wb_phone")).distinct()
    # looking up costs far more than moving the pairs, which are small: keep all cores busy
    pairs = pairs.repartition(busy_parts(spark))
    known = reference.select(F.col("id").cast("bigint"), F.col("name"), F.col("phone"), (uses if uses is not None else F.lit(0)).cast("bigint").alias("uses"))
    known = written(known.withColumn("_wb_hash", F.xxhash64("id")))
    blocks = -(-known.count() // BLOCK)
    looked = None
    for b in range(blocks):
        rows = known.where(F.pmod("_wb_hash", F.lit(blocks)) == b).drop("_wb_hash")
        held = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])
        one = pairs.mapInPandas(_lookup(held, "_wb_name", "_wb_phone"), "_wb_name string, _wb_phone string, best_id bigint, score double")
        looked = one if looked is None else looked.unionByName(one)
    if looked is None:
        return df.drop("best_id").withColumn("best_id", F.lit(0).cast("bigint"))
    if blocks > 1:
        looked = looked.groupBy("_wb_name", "_wb_phone").agg(F.max_by("best_id", F.struct("score", -F.col("best_id"))).alias("best_id"))
    looked = looked.select("_wb_name", "_wb_phone", F.col("best_id").alias("_wb_best"))
    out = df.join(looked, F.col(name).eqNullSafe(F.col("_wb_name")) & F.col(phone).eqNullSafe(F.col("_wb_phone")), "left")
    return out.select(*[F.col(c) for c in df.columns if c != "best_id"], F.col("_wb_best").alias("best_id"))

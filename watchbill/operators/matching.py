"""Joins of typed names to contacts: equal, canonical, laddered and keyed.

A rule of a ladder counts only if all contacts it finds for a row have one and the same phone; else the next rule is
tried. Candidates are found by shared keys (a block such as the specialty, and short forms of words), never by a cross
join: an inner equi join on them is what Catalyst plans, with skew handled by AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchbill.functions.distance import name_rules, osa
from watchbill.functions.text import canonical_name
from watchbill.sources.tables import busy_parts


def later_wins(contacts: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """(key, value): of several contacts with one key the last in order counts, as where a map is overwritten."""
    return contacts.where(key.isNotNull() & (key != "")).groupBy(key.alias("key")).agg(F.max_by(value, order).alias(value))


def canonical_join(df: DataFrame, name: str, contacts: DataFrame, contact_name: str, phone: str, order: str) -> DataFrame:
    """df with the phone of the contact of equal canonical name (left join; no phone if none)."""
    known = later_wins(contacts, canonical_name(F.col(contact_name)), phone, order)
    return df.withColumn("_key", canonical_name(F.col(name))).join(known.withColumnsRenamed({"key": "_key", phone: f"matched_{phone}"}), "_key", "left").drop("_key")


def _less(words: Column) -> Column:
    """Each word of an array without one letter, for every letter."""
    return F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.left(w, i - 1), w.substr(i + 1, F.length(w))))))


def _keys(words: Column) -> Column:
    """Keys of which two words that a rule of the ladder can join share one: the word, its first three letters, and what
    remains of it without one letter (words of four or more) or two (words of six or more)."""
    four, six = F.filter(words, lambda w: F.length(w) >= 4), F.filter(words, lambda w: F.length(w) >= 6)
    heads = F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.concat(F.lit("^"), F.left(w, F.lit(3))))
    return F.array_distinct(F.concat(words, heads, _less(four), _less(F.array_distinct(_less(six)))))


def ladder(df: DataFrame, id: str, name: str, block: Sequence[str], contacts: DataFrame, contact_name: str, phone: str) -> DataFrame:
    """(id, rule, phone, uncertain) of each row of df that a rule resolves.

    Rules in order: 1 all words equal, 2 prefixes, 3 one edit, 4 two edits (uncertain); the rule of a pair is the worst
    over its words. A rule that finds more than one phone is passed over. df and contacts are compared within equal
    `block` columns. Rows without name or with a null in block, contacts without phone take no part. Contacts are reduced to distinct (block,
    name, phone) first. Candidates come from an equi join on keys of the longest word looked for, which a rule's first
    condition is that it fits; the keys are complete for every rule.

    Rows that no rule resolves are narrowed by an initial. 4.5: of the first rule that finds several phones those stay
    that a contact has whose last word starts with the name's single letter; one left counts under that rule. 5: names
    of an initial and one word go to the contacts whose last word it is, give or take two letters (`initial_last`).
    """
    block = list(block)
    left = df.where(F.col(name).isNotNull()).select(F.col(id).alias("_id"), *block, F.split(canonical_name(F.col(name)), " ").alias("_t"))
    names = left.select(*block, "_t").distinct()
    right = contacts.where(F.col(phone).isNotNull()).select(*block, F.split(canonical_name(F.col(contact_name)), " ").alias("_c"), F.col(phone).alias("_phone")).distinct()
    longest = F.array_max(F.transform("_t", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    a = names.where(F.exists("_t", lambda w: F.length(w) >= 3)).withColumn("_g", F.explode(_keys(F.array(longest))))
    b = right.withColumn("_g", F.explode(_keys(F.col("_c"))))
    spark = df.sparkSession
    cores = busy_parts(spark)
    # comparing words costs more than the few bytes of a pair suggest: keep AQE from putting all pairs in one task
    pairs = a.join(b, [*block, "_g"]).select(*block, "_t", "_c", "_phone").distinct().repartition(cores)
    ruled = pairs.withColumn("rule", name_rules(F.col("_t"), F.col("_c"))).where("rule is not null")
    # rungs in order: the rules, the rules narrowed by an initial, initial and last word
    letter = F.try_element_at(F.filter("_t", lambda w: F.length(w) == 1), F.lit(1))
    lasts = right.where(F.size("_c") >= 2).select(*block, "_phone", F.element_at("_c", -1).alias("_last")).distinct()
    of_letter = ruled.where(letter.isNotNull()).select(*block, "_t", "rule", "_phone").distinct().join(lasts, [*block, "_phone"])
    narrowed = _one_phone(of_letter.where(F.startswith("_last", letter)), [*block, "_t"])
    rungs = _one_phone(ruled, [*block, "_t"]).withColumn("_rung", F.lit(0)).unionByName(narrowed.withColumn("_rung", F.lit(1)))
    first = rungs.groupBy(*block, "_t").agg(F.min_by(F.struct("rule", "phone"), F.struct("_rung", "rule")).alias("_m"))
    typed = df.where(F.col(name).isNotNull()).select(F.col(id).alias("_id"), *block, F.col(name).alias("_n"))
    ruled_rows = left.join(first, [*block, "_t"]).select("_id", "_m.rule", "_m.phone", (F.col("_m.rule") == 4).alias("uncertain"), F.lit(0).alias("_rung"))
    both = ruled_rows.unionByName(initial_last(typed, block, right, cores).withColumn("_rung", F.lit(1)))
    best = both.groupBy("_id").agg(F.min("_rung").alias("_rung"))
    return both.join(best, ["_id", "_rung"]).select(F.col("_id").alias(id), "rule", "phone", "uncertain")


def _one_phone(ruled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., rule, phone) where a rule finds one phone only."""
    out = ruled.groupBy(*keys, "rule").agg(F.min("_phone").alias("phone"), F.max("_phone").alias("_other"))
    return out.where("phone = _other").drop("_other")


def initial_last(typed: DataFrame, block: list[str], contacts: DataFrame, parts: int) -> DataFrame:
    """(_id, rule, phone, uncertain) of names typed as an initial and a last word (D3, rung 5).

    The last word of a contact (two words or more) fits if it is equal, longer or shorter by two letters at its end, or,
    from four letters, within two edits. One phone: it counts, uncertain unless a contact's first word starts with the
    initial. Several: those whose first word does, if they have one phone.
    """
    bare = F.trim(F.regexp_replace("_n", "^[Dd][Rr]\\.?\\s*", ""))
    shape = "^([A-Za-z])[.\\s]+([A-Za-z]{3,})$"
    rows = typed.select("_id", *block, F.lower(F.regexp_extract(bare, shape, 1)).alias("_i"), canonical_name(F.regexp_extract(bare, shape, 2)).alias("_w")).where("_i <> '' and _w <> ''")
    near = lambda w: F.array_distinct(F.concat(F.array(w), _less(F.array(w)), _less(F.array_distinct(_less(F.array(w))))))
    people = contacts.where(F.size("_c") >= 2).select(*block, "_phone", F.element_at("_c", 1).alias("_first"), F.element_at("_c", -1).alias("_last"))
    a = rows.select(*block, "_w").distinct().withColumn("_g", F.explode(near(F.col("_w"))))
    b = people.select(*block, "_last").distinct().withColumn("_g", F.explode(near(F.col("_last"))))
    pairs = a.join(b, [*block, "_g"]).select(*block, "_w", "_last").distinct().repartition(parts)
    w, last = F.col("_w"), F.col("_last")
    start = (F.startswith(last, w) | F.startswith(w, last)) & (F.abs(F.length(last) - F.length(w)) <= 2)
    edits = F.when((F.length(w) >= 4) & (F.length(last) >= 4) & (F.levenshtein(w, last, 4) >= 0), osa(w, last) <= 2)
    fits = pairs.where((w == last) | start | F.coalesce(edits, F.lit(False)))
    initial = F.startswith("_first", F.col("_i"))
    hits = rows.join(fits, [*block, "_w"]).join(people, [*block, "_last"]).groupBy("_id", *block).agg(
        F.min("_phone").alias("_a"), F.max("_phone").alias("_b"), F.min(F.when(initial, F.col("_phone"))).alias("_ia"), F.max(F.when(initial, F.col("_phone"))).alias("_ib"))
    phone = F.when(F.col("_a") == F.col("_b"), F.col("_a")).when(F.col("_ia") == F.col("_ib"), F.col("_ia"))
    return hits.select("_id", F.lit(5).alias("rule"), phone.alias("phone"), F.col("_ia").isNull().alias("uncertain")).where("phone is not null")


def by_keys(df: DataFrame, id: str, keys: Column, contacts: DataFrame, contact_keys: Column, value: str) -> DataFrame:
    """(id, value, hits, certain): the contact found by the first of a row's keys that any contact has.

    keys and contact_keys are arrays in order of trust (whole name, first word, last word ...). A key held by contacts
    of one value is certain; one held by several gives the smallest value, uncertain.
    """
    held = contacts.select(F.explode(contact_keys).alias("_k"), F.col(value)).where("_k <> ''").groupBy("_k").agg(F.min(value).alias(value), F.countDistinct(value).alias("hits"))
    asked = df.select(F.col(id), F.posexplode(keys).alias("_pos", "_k"))
    found = asked.join(held, "_k").groupBy(id).agg(F.min_by(F.struct(value, "hits"), "_pos").alias("_m"))
    return found.select(id, f"_m.{value}", "_m.hits", (F.col("_m.hits") == 1).alias("certain"))


def bare_names(contacts: DataFrame, name: str, phone: str) -> DataFrame:
    """(word, phones, uncertain): first words of names and whether they lead to more than one phone."""
    word = F.element_at(F.split(canonical_name(F.col(name)), " "), 1)
    return contacts.where(F.col(phone).isNotNull()).groupBy(word.alias("word")).agg(F.countDistinct(phone).alias("phones")).where("word <> ''").withColumn("uncertain", F.col("phones") > 1)


def name_of_phone(contacts: DataFrame, name: str, phone: str, order: str) -> DataFrame:
    """(phone, full_name): of the names known for a phone the longest that starts with a title, the first on ties."""
    titled = F.lower(F.col(name)).startswith("dr")
    return contacts.where(F.col(phone).isNotNull() & F.col(name).isNotNull()).groupBy(phone).agg(
        F.max_by(name, F.struct(titled.cast("int"), F.length(name), -F.col(order))).alias("full_name"))


def positional_zip(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """The i-th element of array a beside the i-th of array b of the same key; what is left over on either side stays."""
    x = left.select(*keys, F.posexplode(a).alias("pos", a))
    y = right.select(*keys, F.posexplode(b).alias("pos", b))
    return x.join(y, [*keys, "pos"], "full")


def interval_join(df: DataFrame, at: str, keys: Sequence[str], shifts: DataFrame, start: str, end: str, order: str, value: str, cell: int = 1440) -> DataFrame:
    """df with the value of the first shift of equal keys whose [start, end) holds `at` (null if none).

    A range join as an equi join: shifts are laid out over cells of time, so each row meets only the shifts of its own
    cell. All three are whole numbers of one unit.
    """
    keys = list(keys)
    spread = shifts.where(F.col(start) < F.col(end)).select(
        *keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(order).alias("_o"), F.col(value).alias("_v"),
        F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell))).alias("_cell"))
    # the distinct instants of a key are looked up, not rows: nothing has to tell rows apart, and hot instants meet once
    asked = df.select(*keys, F.col(at).alias("_at")).distinct().withColumn("_cell", F.floor(F.col("_at") / cell))
    hits = asked.join(spread, [*keys, "_cell"]).where((F.col("_at") >= F.col("_s")) & (F.col("_at") < F.col("_e")))
    best = hits.groupBy(*keys, "_at").agg(F.min_by("_v", "_o").alias(value))
    renamed = best.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.col(at) == F.col("_at")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    return df.join(renamed, same, "left").select(*df.columns, value)


def missing(required: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Required rows that are not present (anti join)."""
    return required.join(present, list(on), "left_anti")


def found(required: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Required rows that are present (semi join)."""
    return required.join(present, list(on), "left_semi")

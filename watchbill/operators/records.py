"""Whole records: grouping and rebuilding, exclusive roles, guarded replacement, memberships, aliases, links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchbill.functions.text import normalized_text
from watchbill.operators.windows import best_by


def grouped(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], out: str = "rows") -> DataFrame:
    """(keys..., out): the rows of each group as a sorted array of (order..., values...). A group becomes one value: for
    groups of a record's size. Null keys are groups of their own."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *values))).alias(out))


def flattened(df: DataFrame, ids: Sequence[str], text: str, nested: str, schema: str) -> DataFrame:
    """(ids..., pos, fields of schema): the objects in array `nested` of a JSON text; an object without that array is one
    row itself. Null text, text that is no JSON and empty arrays give no row."""
    whole = F.from_json(text, f"struct<{nested}: array<struct<{schema}>>>")[nested]
    flat = F.from_json(text, f"struct<{schema}>")
    valid = F.try_parse_json(text).isNotNull()
    items = F.when(valid, F.coalesce(whole, F.array(flat)))
    return df.select(*ids, F.posexplode(items).alias("_p", "_e")).select(*ids, (F.col("_p") + 1).alias("pos"), "_e.*")


def rebuilt(rows: DataFrame, ids: Sequence[str], fields: Sequence[str], nested: str, out: str = "data") -> DataFrame:
    """(ids..., out): rows (ids, pos, fields) as a JSON text with their objects in array `nested`, in order of pos; nulls
    are left out."""
    items = F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("o"))))
    return rows.groupBy(*ids).agg(F.to_json(F.struct(F.transform(items, lambda x: x["o"]).alias(nested))).alias(out))


def exclusive(df: DataFrame, group: Sequence[str], person: str, role: str, ranks: Sequence[str], *order: Column) -> DataFrame:
    """Of the rows of one person in a group the one of the most important role (ranks in order; other roles last), the
    first in order on ties; rows without a person stay."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(role)), F.lit(0))
    named = df.where(F.col(person).isNotNull()).withColumn("_rank", F.when(rank == 0, len(ranks) + 1).otherwise(rank))
    return best_by(named, [*group, person], F.asc("_rank"), *order).drop("_rank").unionByName(df.where(F.col(person).isNull()))


def first_per_slot(df: DataFrame, slot: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each slot; slots with a null are slots too."""
    return best_by(df, slot, *order)


def replaced_if(current: DataFrame, parsed: DataFrame, keys: Sequence[str], part: str, least: int) -> DataFrame:
    """Rows of `parsed` for the keys at which they have at least `least` different values of part, rows of `current` for
    the others: a poor reading never replaces what is known. Rows with a null key are left out."""
    rich = parsed.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.countDistinct(part).alias("_n")).where(F.col("_n") >= least).select(*keys)
    known = current.where(" and ".join(f"`{k}` is not null" for k in keys))
    return parsed.join(rich, list(keys), "left_semi").unionByName(known.join(rich, list(keys), "left_anti"))


def accepted_history(versions: DataFrame, keys: Sequence[str], at: str, order: Sequence[Column], rejected: Column) -> DataFrame:
    """Versions with `state`: rejected ones never replace what holds, so the newest of the others is active, those before
    it are past. One shuffle; a key's versions are sorted in one task."""
    bad = F.coalesce(rejected, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*keys, bad).orderBy(*order))
    return versions.withColumn("state", F.when(bad, "rejected").when(rank == 1, "active").otherwise("past"))


def renamed_keys(df: DataFrame, key: str, names: DataFrame, old: str, new: str) -> DataFrame:
    """df with keys that `names` (old, new; one row per old) renames; others stay."""
    known = names.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return df.join(known, F.col(key) == F.col("_old"), "left").withColumn(key, F.coalesce("_new", key)).drop("_old", "_new")


def moved(current: DataFrame, moves: DataFrame, key: str, target: str, at: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(table, log) after rows move to another target (moves: key, target, at): a moved row takes its new target and
    version; the log has (key, old, new, at) of rows that really moved. moves has one row per key."""
    new = moves.select(F.col(key), F.col(target).alias("_target"), F.col(at).alias("_at"))
    both = current.join(new, key, "left")
    changed = F.col("_target").isNotNull() & ~F.col("_target").eqNullSafe(F.col(target))
    log = both.where(changed).select(key, F.col(target).alias("old"), F.col("_target").alias("new"), F.col("_at").alias("at"))
    out = both.withColumns({target: F.coalesce("_target", target), version: F.when(changed, F.col("_at")).otherwise(F.col(version))})
    return out.select(*current.columns), log


def united_keywords(current: DataFrame, added: DataFrame, key: str, words: str) -> DataFrame:
    """(key, words): the keywords of both tables per key as one sorted set, lower case and trimmed; new keys are added,
    blank words are no words."""
    clean = F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.lower(F.trim(w))), lambda w: F.coalesce(w != "", F.lit(False)))
    both = current.select(key, clean.alias("_w")).unionByName(added.select(key, clean.alias("_w"))).where(F.col(key).isNotNull())
    return both.select(key, F.explode_outer("_w").alias("_w")).groupBy(key).agg(F.sort_array(F.collect_set("_w")).alias(words))


def membership(df: DataFrame, key: str, members: DataFrame, whole: str, part: str) -> DataFrame:
    """Rows of the parts of a larger whole under the whole's name, beside their own: members (whole, part)."""
    known = members.select(F.col(part).alias("_part"), F.col(whole).alias(whole))
    return df.join(known, F.col(key) == F.col("_part")).drop("_part")


def by_suffix(df: DataFrame, name: str, listed: DataFrame, listed_name: str, value: str, order: str) -> DataFrame:
    """df with the value of the first listed name that equals a row's name or is a tail of it, or the other way round, in
    whole words; null if none.

    Tails of names are keys of an equi join: a name of n words has n of them.
    """
    def tails(c: str) -> Column:
        w = F.split(normalized_text(F.col(c)), " ")
        return F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, i, F.size(w)), " "))

    known = listed.where(normalized_text(F.col(listed_name)) != "").select(normalized_text(F.col(listed_name)).alias("_b"), tails(listed_name).alias("_t"), F.col(value).alias("_v"), F.col(order).alias("_o"))
    names = df.where(normalized_text(F.col(name)) != "").select(F.col(name).alias("_name"), normalized_text(F.col(name)).alias("_a"), tails(name).alias("_t")).distinct()
    longer = names.select("_name", F.explode("_t").alias("_k")).join(known.select(F.col("_b").alias("_k"), "_v", "_o"), "_k")
    shorter = names.select("_name", F.col("_a").alias("_k")).join(known.select(F.explode("_t").alias("_k"), "_v", "_o"), "_k")
    first = longer.unionByName(shorter).groupBy("_name").agg(F.min_by("_v", "_o").alias(value))
    return df.join(first, F.col(name) == F.col("_name"), "left").drop("_name")


def aliases(contacts: DataFrame, block: Sequence[str], name: str, phone: str, order: str) -> DataFrame:
    """(block..., alias, full_name): names of one phone lead to its longest titled name, the first on ties; the later
    contact's name counts where an alias has several. A phone without a titled name gives none."""
    rows = contacts.where(F.col(phone).isNotNull() & F.col(name).isNotNull())
    titled = rows.where(F.lower(name).startswith("dr")).groupBy(*block, phone).agg(F.max_by(name, F.struct(F.length(name), -F.col(order))).alias("full_name"))
    return rows.join(titled, [*block, phone]).where(F.col(name) != F.col("full_name")).groupBy(*block, F.col(name).alias("alias")).agg(F.max_by("full_name", order).alias("full_name"))


def match_alias(df: DataFrame, id: str, text: str, catalogue: DataFrame, key: str, label: str, words: str) -> DataFrame:
    """(id, key, how): the catalogue's entry that a typed text names.

    how: `exact` (its key with blanks, or its label), `alias` (one of its words), `fuzzy` (every typed word is part of
    some word of one alias or the other way round; the alias of most words wins), `ambiguous` (several entries equally;
    the smallest key is given) or `new` (no key). Blank texts give no row. The catalogue is small and broadcast, up to
    2,000 entries; more raise an error. Distinct texts are matched once.
    """
    n = catalogue.limit(2001).count()
    if n > 2000:
        raise ValueError("catalogue over 2,000 entries: join it by words instead")
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9؀-ۿ\\s-]", ""), "\\s+", " "))
    spaced = F.replace(F.lower(key), F.lit("_"), F.lit(" "))
    listed = catalogue.select(F.col(key).alias("_key"), spaced.alias("_spaced"), F.lower(label).alias("_label"), F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.lower(w)).alias("_aliases"))
    texts = df.select(clean(F.col(text)).alias("_t")).where("_t <> ''").distinct()
    typed = F.split("_t", " ")
    fits = lambda alias: F.forall(typed, lambda t: F.exists(F.split(alias, "\\s+"), lambda w: F.contains(w, t) | F.contains(t, w)))
    first = F.try_element_at(F.filter(F.concat(F.array("_spaced"), F.col("_aliases")), fits), F.lit(1))
    level = F.when((F.col("_t") == F.col("_spaced")) | (F.col("_t") == F.col("_label")), 3).when(F.array_contains("_aliases", F.col("_t")), 2).when(first.isNotNull(), 1)
    hits = texts.join(F.broadcast(listed), F.lit(True)).select("_t", "_key", level.alias("_level"), F.size(F.split(first, "\\s+")).alias("_n")).where("_level is not null")  # a stated catalogue
    score = F.struct("_level", F.when(F.col("_level") == 1, F.col("_n")).otherwise(0).alias("n"))
    best = hits.withColumn("_score", score).groupBy("_t", "_score").agg(F.min("_key").alias("_key"), F.count("*").alias("_hits"))
    top = best.groupBy("_t").agg(F.max_by(F.struct("_score", "_key", "_hits"), "_score").alias("_m"))
    how = F.when(F.col("_m").isNull(), "new").when(F.col("_m._score._level") == 3, "exact").when(F.col("_m._score._level") == 2, "alias").when(F.col("_m._hits") > 1, "ambiguous").otherwise("fuzzy")
    rows = df.select(F.col(id).alias(id), clean(F.col(text)).alias("_t")).where("_t <> ''")
    return rows.join(top, "_t", "left").select(id, F.col("_m._key").alias(key), how.alias("how"))


def link_choice(*links: Column) -> Column:
    """The first link that is not blank: newer places before older ones."""
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in links])


def month_stale(df: DataFrame, keys: Sequence[str], month: Column, now: Column) -> DataFrame:
    """(keys..., months, stale): whether the months named in a group lack the current one; groups that name none are not
    stale."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(month)).alias("months")).withColumn("stale", (F.size("months") > 0) & ~F.array_contains("months", now))


def appended(contacts: DataFrame, resolved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """contacts and those resolved rows (equal columns) whose keys they lack, each once; a null key is never appended."""
    new = resolved.where(" and ".join(f"`{k}` is not null" for k in keys)).join(contacts.select(*keys).distinct(), list(keys), "left_anti")
    return contacts.unionByName(best_by(new, keys, *[F.asc_nulls_last(c) for c in new.columns]).select(*contacts.columns))


def accepted_names(df: DataFrame, proposals: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """df with proposed names (keys, name; one row per keys) where the last word stays the same, else the name it has.

    Words are compared without case and marks; an empty or missing proposal changes nothing.
    """
    last = lambda c: F.element_at(F.split(normalized_text(c), " "), -1)
    known = proposals.select(*keys, F.col(name).alias("_new"))
    fine = (last(F.col("_new")) == last(F.col(name))) & (F.trim("_new") != "")
    out = df.join(known, list(keys), "left").withColumn(name, F.when(F.coalesce(fine, F.lit(False)), F.col("_new")).otherwise(F.col(name)))
    return out.select(*df.columns)


def raised(label: Column, rank: Column, ranks: Sequence[str]) -> Column:
    """A label, or the rank of the person under it where that is higher; ranks in rising order, others are no ranks."""
    at = lambda c: F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ranks]), c), F.lit(0))
    return F.when(at(rank) > at(label), rank).otherwise(label)

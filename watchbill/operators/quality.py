"""Checks of extracted rows: confidence, duplicates, slots, required parts, differences between versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def penalty_score(penalties: Sequence[tuple[Column, int]], start: int = 100) -> Column:
    """start less the penalties whose conditions hold, 0 at least; a null condition does not hold."""
    score = F.lit(start)
    for condition, points in penalties:
        score = score - F.when(condition, points).otherwise(0)
    return F.greatest(score, F.lit(0))


def confidence(score: Column, high: int = 75, medium: int = 45) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def issues(checks: Sequence[tuple[Column, str]]) -> Column:
    """Names of the checks that fail, as an array in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))


def duplicates(df: DataFrame, keys: Sequence[Column], id: str) -> DataFrame:
    """(first, later) for each row that repeats an earlier one on keys: to the first of its group, so rows and not pairs
    are emitted however often a row is repeated. Null keys equal each other and nothing else."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(F.col(id).alias("later"), *[F.coalesce(k.cast("string"), F.lit("\ue0f0")).alias(n) for k, n in zip(keys, names)])
    firsts = rows.groupBy(*names).agg(F.min("later").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(firsts, names).where("later > first").select("first", "later")


def crowded_slots(df: DataFrame, slot: Sequence[str], most: int = 1) -> DataFrame:
    """Slots that hold more than `most` rows."""
    return df.groupBy(*slot).agg(F.count("*").alias("n")).where(F.col("n") > most)


def coverage(df: DataFrame, group: Sequence[str], part: str, required: Sequence[str]) -> DataFrame:
    """(group..., found, missing): which required parts each group has and lacks, as sorted arrays."""
    seen = df.groupBy(*group).agg(F.collect_set(F.when(F.col(part).isin(list(required)), F.col(part))).alias("_have"))
    want = F.array(*[F.lit(r) for r in sorted(required)])
    return seen.select(*group, F.array_sort("_have").alias("found"), F.array_except(want, "_have").alias("missing"))


def version_loss(old: DataFrame, new: DataFrame, keys: Sequence[str], least: float = 0.6) -> DataFrame:
    """(keys..., before, after, loss): groups of a version and whether they kept less than `least` of their rows."""
    a, b = old.groupBy(*keys).agg(F.count("*").alias("before")), new.groupBy(*keys).agg(F.count("*").alias("after"))
    both = a.join(b, list(keys), "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return both.withColumn("loss", F.col("after") < least * F.col("before"))


def against_baseline(df: DataFrame, keys: Sequence[str], baseline: DataFrame, expected: str, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """(keys..., rows, expected, state): counts against a baseline; below low fails, above high warns."""
    n = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    both = baseline.join(n, list(keys), "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    state = F.when(F.col("rows") < low * F.col(expected), "fail").when(F.col("rows") > high * F.col(expected), "warn").otherwise("ok")
    return both.select(*keys, "rows", expected, state.alias("state"))


def merged_names(name: Column) -> Column:
    """Whether a field seems to hold two people: a slash between words, or two titles."""
    return name.rlike("\\S\\s*/\\s*\\S") | (F.size(F.regexp_extract_all(name, F.lit("\\b((?i:dr))\\b"), F.lit(1))) >= 2)


def record_audit(rows: DataFrame, keys: Sequence[str], usable: Column, score: Column, no_coverage: Column, problems: Sequence[tuple[Column, str]]) -> DataFrame:
    """(keys..., rows, usable, high, overall, issues): the audit of each record from its rows, in one aggregate.

    Usable rows of high confidence at 70 % or more make a record high, those not low at 60 % or more medium, else low;
    no usable row is low, nothing but no-coverage rows high. issues are, in order, `no-usable-rows` and the names of the
    problems that some usable row has.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    level = confidence(score)
    flags = {"_u": no(usable), "_n": no(no_coverage), "_c": level} | {f"_p{i}": no(c) & no(usable) for i, (c, _) in enumerate(problems)}
    one = rows.withColumns(flags).groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(F.col("_u")).alias("usable"), F.count_if(F.col("_u") & (F.col("_c") == "high")).alias("high"),
        F.count_if(F.col("_u") & (F.col("_c") != "low")).alias("_fair"), F.min("_n").alias("_quiet"), *[F.max(f"_p{i}").alias(f"_p{i}") for i in range(len(problems))])
    overall = F.when(F.col("_quiet"), "high").when(F.col("usable") == 0, "low").when(F.col("high") >= 0.7 * F.col("usable"), "high").when(F.col("_fair") >= 0.6 * F.col("usable"), "medium").otherwise("low")
    found = issues([((F.col("usable") == 0) & ~F.col("_quiet"), "no-usable-rows"), *[(F.col(f"_p{i}"), name) for i, (_, name) in enumerate(problems)]])
    return one.select(*keys, "rows", "usable", "high", overall.alias("overall"), found.alias("issues"))


def upper_only(rows: DataFrame, keys: Sequence[str], upper: Column, lower: Column) -> DataFrame:
    """Groups with a row of an upper tier and none of a lower one."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.groupBy(*keys).agg(F.max(no(upper)).alias("_u"), F.max(no(lower)).alias("_l")).where("_u and not _l").select(*keys)


def lost_names(old: DataFrame, new: DataFrame, keys: Sequence[str], name: str, least: int = 4) -> DataFrame:
    """(keys..., name): names of the old version of which the new one has nothing: no name that, without blanks and marks,
    holds the other or is held by it; names under `least` letters are not looked for.

    Names meet by their first letters against all runs of as many letters, so that no two versions are compared pair by
    pair.
    """
    compact = F.regexp_replace(F.lower(F.col(name)), "[^\\p{L}\\p{N}]", "")
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(c, i, F.lit(least))))
    a = old.select(*keys, F.col(name), compact.alias("_a")).where(F.length("_a") >= least).distinct()
    b = new.select(*keys, compact.alias("_b")).where(F.length("_b") >= least).distinct()
    heads = lambda c: F.left(c, F.lit(least))
    held = a.select(*keys, name, "_a", F.explode(runs(F.col("_a"))).alias("_k")).join(b.select(*keys, "_b", heads(F.col("_b")).alias("_k")), [*keys, "_k"]).where(F.contains("_a", F.col("_b")))
    holds = a.select(*keys, name, "_a", heads(F.col("_a")).alias("_k")).join(b.select(*keys, "_b", F.explode(runs(F.col("_b"))).alias("_k")), [*keys, "_k"]).where(F.contains("_b", F.col("_a")))
    kept = held.select(*keys, name).unionByName(holds.select(*keys, name)).distinct()
    return a.select(*keys, name).distinct().join(kept, [*keys, name], "left_anti")


def label_noise(label: Column) -> Column:
    """Whether a label looks messy: capitals only, digits, signs, or two blanks in a row."""
    return label.rlike("^[A-Z0-9 ]{12,}$|[0-9]{3,}|[_*#|<>{}]|\\s{2,}")


def clean_label(label: Column) -> Column:
    """A label with signs as blanks, single blanks, and each word's first letter capital."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(label, "[_*#|<>{}]+", " "), "\\s+", " ")))


def outside_bounds(df: DataFrame, keys: Sequence[str], part: str, bounds: DataFrame, low: str, high: str) -> DataFrame:
    """(keys..., n, low, high, state): distinct values of part per group against the group's bounds: `few`, `many`, `ok`,
    `unknown` without bounds."""
    n = df.groupBy(*keys).agg(F.countDistinct(part).alias("n")).join(bounds.select(*keys, low, high), list(keys), "left")
    state = F.when(F.col(low).isNull() | F.col(high).isNull(), "unknown").when(F.col("n") < F.col(low), "few").when(F.col("n") > F.col(high), "many").otherwise("ok")
    return n.withColumn("state", state)


def allowed_only(df: DataFrame, keys: Sequence[str], allowed: DataFrame) -> DataFrame:
    """df with `locked`: whether its keys are among the allowed combinations; a null key never is."""
    known = allowed.select(*keys).distinct().withColumn("_ok", F.lit(True))
    return df.join(known, list(keys), "left").withColumn("locked", F.coalesce("_ok", F.lit(False))).drop("_ok")


def trust(base: Column, penalties: Sequence[tuple[Column, int]], floor: tuple[Column, int] | None = None) -> tuple[Column, Column]:
    """(score 0 to 100, names of penalties by number): base less the penalties that apply, not under a floor where its
    condition holds."""
    score = base
    for condition, points in penalties:
        score = score - F.when(condition, points).otherwise(0)
    if floor:
        score = F.when(F.coalesce(floor[0], F.lit(False)), F.greatest(score, F.lit(floor[1]))).otherwise(score)
    return F.least(F.greatest(score, F.lit(0)), F.lit(100)), F.array_compact(F.array(*[F.when(c, F.lit(i + 1)) for i, (c, _) in enumerate(penalties)]))

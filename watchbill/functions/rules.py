"""Ordered rules as data: the first that applies wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rule(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """Value of the first rule whose condition holds; a null condition does not hold."""
    out = None
    for condition, value in rules:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def last_rule(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """Value of the last rule whose condition holds: later rules override."""
    return first_rule(list(rules)[::-1], otherwise)


def match_rule(text: Column, match: str, exclude: str | None = None) -> Column:
    """Whether a regular expression is found in a text and the excluding one is not."""
    hit = text.rlike(match)
    return hit & ~text.rlike(exclude) if exclude else hit


def lane(text: Column, lanes: Sequence[tuple[str, str, str | None]]) -> Column:
    """First lane (id, match, exclude) that a lower-cased text falls in."""
    t = F.lower(text)
    return first_rule([(match_rule(t, m, x), name) for name, m, x in lanes])


def rule_join(df: DataFrame, text: str, rules: DataFrame, pattern: str, order: str, value: str, keys: Sequence[str]) -> DataFrame:
    """First rule of a table by row: rules (pattern, order, value) are broadcast, which `limit` bounds to 10,000 rows;
    more rules than that raise an error. Rows that no rule fits keep a null value."""
    n = rules.limit(10_001).count()
    if n > 10_000:
        raise ValueError("rules over 10,000 rows: split them by a key that the rows share")
    small = F.broadcast(rules.select(F.col(pattern).alias("_p"), F.col(order).alias("_o"), F.col(value).alias("_v")))
    hits = df.join(small, F.contains(F.lower(F.col(text)), F.col("_p")), "left")
    return hits.groupBy(*keys).agg(F.min_by("_v", "_o").alias(value))


def keyword_score(text: Column, keywords: Column) -> Column:
    """Sum of the lengths of the keywords found in a text; Latin ones of up to three letters only as whole words."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " ")), F.lit(" "))
    found = lambda k: F.when((F.length(k) <= 3) & k.rlike("^[a-z0-9]+$"), F.contains(padded, F.concat(F.lit(" "), k, F.lit(" ")))).otherwise(F.contains(padded, k))
    return F.aggregate(F.filter(keywords, lambda k: (F.length(k) > 0) & found(k)), F.lit(0), lambda s, k: s + F.length(k))

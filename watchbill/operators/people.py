"""Names of rows made comparable: splitting and filters of extracted rows, keys of contacts, scores of two names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchbill.functions.clock import let
from watchbill.functions.distance import edits
from watchbill.functions.text import canonical_name
from watchbill.operators.windows import best_by, cap_per_key
from watchbill.sources.tables import busy_parts

# Labels that are no names, and patterns of texts that are none.
NEVER = tuple("""name|name id ext|see general pediatric rota|see general|header|footer|date|doctor|specialty|phone|number|mobile|day|time|shift|role|position|department|on-call|on call|consultant|resident|fellow|associate|ext|id|pager|office|bleep|leave|annual""".split("|"))
NO_NAMES = (
    "^[A-Z\\s]{20,}$", "^[\\d\\s/-]+$", "^(?i:sun|mon|tue|wed|thu|fri|sat)(?i:day)?$", "^(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)$", "^(?i:1st|2nd|3rd|4th|5th)\\s*(?i:on|call|duty)")
JUNK = "(?i)\\b(?:pdf|obj|endobj|stream|endstream|xref|trailer|startxref|eof)\\b"


def is_person(name: Column, never: Sequence[str] = NEVER) -> Column:
    """Whether a text can be a person's name: 3 to 80 letters, no label, weekday, month or ordinal of a shift, some Latin or
    Arabic letter; null is none."""
    t = F.trim(name)
    fine = F.length(t).between(3, 80) & ~F.lower(t).isin(list(never)) & t.rlike("[a-zA-Z\u0600-\u06ff]")
    for p in NO_NAMES:
        fine = fine & ~t.rlike(p)
    return F.coalesce(fine, F.lit(False))


def clean_person(name: Column) -> Column:
    """A typed name with single blanks, one title written `Dr. `, without a weekday before it."""
    t = F.trim(F.regexp_replace(name, "\\s+", " "))
    t = F.regexp_replace(t, "\\b(?i:dr)\\.(?=[A-Za-z])", "Dr. ")
    t = F.regexp_replace(t, "^(?i:dr)\\.?\\s+(?i:dr)\\.?\\s*", "Dr. ")
    return F.trim(F.regexp_replace(t, "^(?i:mon|tue|wed|thu|fri|sat|sun)\\w*\\s+", ""))


def split_people(name: Column) -> Column:
    """The names in a field: cut before each `Dr.` that a letter follows at once, then at commas; pieces of one letter are
    dropped where two or more are left."""
    by_title = F.filter(F.transform(F.split(F.trim(name), "(?=\\bDr\\.\\w)"), lambda p: F.trim(p)), lambda p: p != "")

    def by_comma(p: Column) -> Column:
        parts = F.filter(F.transform(F.split(p, ","), lambda x: F.trim(x)), lambda x: F.length(x) >= 2)
        return F.when(F.contains(p, F.lit(",")) & (F.size(parts) > 1), parts).otherwise(F.array(p))

    return F.flatten(F.transform(by_title, by_comma))


def normalize_people(df: DataFrame, id: str, name: str, phone: str, role: str, date: str, most: int = 3) -> DataFrame:
    """(id, part, name, phone, role, date) of extracted rows made clean: names split and cleaned, rows that hold no
    person left out, at most `most` rows of a name, role and date, in the order of id and part.

    Left out are names of fewer than two letters, remains of document code, texts of two titles, capital initials alone,
    capital words without a phone unless each has four letters or more and one five, and whatever is_person rejects.
    Null names give no rows.
    """
    rows = df.select(F.col(id).alias("id"), F.posexplode(split_people(F.col(name))).alias("part", "name"), F.col(phone).alias("phone"), F.col(role).alias("role"), F.col(date).alias("date"))
    rows = rows.withColumn("name", clean_person(F.col("name")))
    n, words = F.col("name"), F.split("name", " ")
    capitals = F.forall(words, lambda w: (w == F.upper(w)) & (F.length(w) <= 3)) & (F.length(n) <= 4)
    long = F.forall(words, lambda w: F.length(w) >= 4) & F.exists(words, lambda w: F.length(w) >= 5)
    titles = F.size(F.regexp_extract_all(n, F.lit("\\b((?i:dr))\\b"), F.lit(1)))
    kept = rows.where((F.length(n) >= 2) & ~n.rlike(JUNK) & (titles <= 1) & ~capitals & ((F.coalesce("phone", F.lit("")) != "") | n.rlike("[a-z]") | long) & is_person(n))
    key = {"_n": F.lower(F.trim("name")), "_r": F.coalesce("role", F.lit("")), "_d": F.coalesce("date", F.lit(""))}
    out = cap_per_key(kept.withColumns(key), list(key), most, F.asc("id"), F.asc("part"))
    return out.select(F.col("id").alias(id), F.col("part"), F.col("name").alias(name), F.col("phone").alias(phone), F.col("role").alias(role), F.col("date").alias(date))


def name_variants(name: Column) -> Column:
    """Keys under which a contact can be looked up, as array of (key, kind): the name, with glued words split, both without
    title, its last word of five letters or more, and `Al X`; each key once, in this order of trust."""
    t = clean_person(name)

    def of(x: Column) -> Column:
        apart = F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2")
        bare = lambda y: F.trim(F.regexp_replace(y, "^(?i:dr)\\.?\\s*", ""))
        words = F.split(bare(x), " ")
        last = F.element_at(words, -1)
        two = F.concat_ws(" ", F.try_element_at(words, F.lit(-2)), last)
        keys = F.array(
            F.struct(x.alias("key"), F.lit("full").alias("kind")), F.struct(F.when(apart != x, apart).alias("key"), F.lit("split").alias("kind")),
            F.struct(F.when(apart != x, bare(apart)).alias("key"), F.lit("split").alias("kind")), F.struct(bare(x).alias("key"), F.lit("bare").alias("kind")),
            F.struct(F.when((F.size(words) >= 2) & (F.length(last) >= 5), last).alias("key"), F.lit("last").alias("kind")),
            F.struct(F.when((F.size(words) >= 3) & (F.lower(F.try_element_at(words, F.lit(-2))) == "al"), two).alias("key"), F.lit("al").alias("kind")))
        return F.filter(keys, lambda k: F.coalesce(k["key"] != "", F.lit(False)))

    return let(t, of)


def contact_keys(contacts: DataFrame, block: Sequence[str], name: str, phone: str, order: str) -> DataFrame:
    """(block..., key, kind, phone): the first contact in order of each key; contacts without phone or without a person's
    name give none."""
    rows = contacts.where(F.col(phone).isNotNull() & is_person(F.col(name)))
    rows = rows.select(*block, F.col(order).alias("_o"), F.col(phone).alias("phone"), F.posexplode(name_variants(F.col(name))).alias("_p", "_k")).select(*block, "_o", "_p", "phone", "_k.key", "_k.kind")
    return best_by(rows, [*block, "key"], F.asc("_o"), F.asc("_p"), F.asc("phone")).select(*block, "key", "kind", "phone")


def name_score(target: Column, candidate: Column) -> Column:
    """(score, uncertain) of two typed names, both null if they are not accepted as one.

    Equal canonical names give 100. Else 16 a shared word, 10 an initial that the word at its place starts with, 5 for
    an equal first and 8 for an equal last word, 4 for two words of five letters one edit apart, less the distance of
    the whole names. Accepted are two shared words, an initial, one shared word that is first or last of both or comes
    with a near miss, or whole names of six letters or more at most 18 % apart.
    """
    return _scores(canonical_name(target), canonical_name(candidate))


def score_of(a: str, b: str) -> tuple[int, bool] | None:
    """(score, uncertain) of two canonical names."""
    if not a or not b:
        return None
    if a == b:
        return 100, False
    x, y = a.split(" "), b.split(" ")
    shared = sum(t in y for t in x)
    initials = sum(len(t) == 1 and i < len(y) and y[i].startswith(t) for i, t in enumerate(x))
    first, last = x[0] == y[0], x[-1] == y[-1]
    longest = max(len(a), len(b))
    d = edits(a, b, longest)
    near = shared > 0 and any(max(len(t), len(c)) >= 5 and edits(t, c, 1) <= 1 for t in x for c in y)
    if not (shared >= 2 or initials >= 1 or shared >= 1 and (first or last or near) or longest >= 6 and d <= max(1, int(longest * 0.18))):
        return None
    near = near or shared == 0 and any(max(len(t), len(c)) >= 5 and edits(t, c, 1) <= 1 for t in x for c in y)
    sure = shared >= 2 and d <= 2 or first and last and d <= 3 or initials >= 2
    return 16 * shared + 10 * initials + 5 * first + 8 * last + 4 * near - d, not sure


def _scores(a: Column, b: Column) -> Column:
    """score_of in Arrow batches: distances of whole names are too slow as folds of expressions."""

    @F.pandas_udf("score int, uncertain boolean")
    def rate(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in parts:
            rows = [score_of(p, q) or (None, None) for p, q in zip(x, y)]
            yield pd.DataFrame({"score": pd.array([r[0] for r in rows], "Int32"), "uncertain": pd.array([r[1] for r in rows], "boolean")})

    return rate(a, b)


def _less(word: Column) -> Column:
    """A word without one letter, for every letter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.lit("-"), F.left(word, i - 1), F.substring(word, i + 1, F.length(word))))


def _keys(words: Column, looked_for: bool) -> Column:
    """Keys that two names share if they have a word in common, two words of four letters or more one edit apart, or if
    the name looked for has an initial where the other's word starts with it."""
    place = lambda w, i: F.concat(F.lit("^"), i.cast("string"), F.left(w, F.lit(1)))
    firsts = F.transform(words, lambda w, i: F.when(F.length(w) == 1, place(w, i)) if looked_for else place(w, i))
    long = F.filter(words, lambda w: F.length(w) >= 4)
    near = F.flatten(F.transform(long, lambda w: F.array_append(_less(w), F.concat(F.lit("-"), w))))
    return F.array_distinct(F.concat(words, F.array_compact(firsts), near))


def scored_match(
    df: DataFrame, id: str, name: str, block: Sequence[str], contacts: DataFrame, contact: str, contact_name: str, least: int = 2, boosts: Sequence[tuple[Column, int]] = (),
) -> DataFrame:
    """(id, contact, score, uncertain): the contact of equal `block` that each row's name scores highest with.

    boosts add points where a condition over the contact's columns holds. Of equal scores the smaller contact counts;
    scores below `least` and names with a slash (several people) give no row, nor do null names and blocks. Candidates
    share a word, an initial's place, or have two words one edit apart, by an equi join on complete keys; names that are
    alike only as wholes, without two such words, are not looked for. Names are compared once however often typed.
    """
    block = list(block)
    canon = lambda c: canonical_name(F.col(c))
    left = df.where(F.col(name).isNotNull() & ~F.contains(F.col(name), F.lit("/"))).select(F.col(id).alias("_id"), *block, canon(name).alias("_a")).where("_a <> ''")
    points = F.lit(0)
    for condition, n in boosts:
        points = points + F.when(condition, n).otherwise(0)
    right = contacts.where(F.col(contact_name).isNotNull()).select(F.col(contact).alias("_c"), *block, canon(contact_name).alias("_b"), points.alias("_plus")).where("_b <> ''")
    names, known = left.select(*block, "_a").distinct(), right.select(*block, "_b").distinct()
    a = names.withColumn("_k", F.explode(_keys(F.split("_a", " "), True)))
    b = known.withColumn("_k", F.explode(_keys(F.split("_b", " "), False)))
    pairs = a.join(b, [*block, "_k"]).select(*block, "_a", "_b").distinct().repartition(busy_parts(df.sparkSession))
    rated = pairs.withColumn("_s", _scores(F.col("_a"), F.col("_b"))).where("_s.score is not null")
    best = rated.join(right, [*block, "_b"]).withColumn("_score", F.col("_s.score") + F.col("_plus"))
    best = best.groupBy(*block, "_a").agg(F.max_by(F.struct("_c", "_score", "_s.uncertain"), F.struct("_score", -F.col("_c"))).alias("_m")).where(F.col("_m._score") >= least)
    return left.join(best, [*block, "_a"]).select(F.col("_id").alias(id), F.col("_m._c").alias(contact), F.col("_m._score").alias("score"), F.col("_m.uncertain").alias("uncertain"))

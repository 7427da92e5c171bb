"""Search: intents, loose matching, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchbill.functions.rules import first_rule
from watchbill.functions.text import normalized_text


def has_token(query: Column, words: Sequence[str]) -> Column:
    return F.arrays_overlap(F.split(normalized_text(query), " "), F.array(*[F.lit(w) for w in words]))


def has_phrase(query: Column, phrases: Sequence[str]) -> Column:
    t = F.concat(F.lit(" "), normalized_text(query), F.lit(" "))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(t, F.lit(f" {p} "))
    return out


def intent(query: Column, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> Column:
    """First intent (name, words, phrases) one of whose words or phrases stands in the query."""
    return first_rule([(has_token(query, w) | has_phrase(query, p), name) for name, w, p in rules])


def loose_match(query: str, label: Column, keywords: Column) -> Column:
    """Whether a query finds an entry: equal to its label or a keyword; one word of up to three letters only as a whole
    word; else as a part of label and keywords, or all its words anywhere in them."""
    q = " ".join(query.lower().split())
    words = q.split(" ")
    names = F.transform(F.concat(F.array(label), F.coalesce(keywords, F.array().cast("array<string>"))), lambda x: F.lower(F.trim(x)))
    pool = F.array_join(names, " ")
    exact = F.array_contains(names, q)
    if len(words) == 1 and len(q) <= 3:
        return exact | F.array_contains(F.split(pool, "[^\\p{L}\\p{N}]+"), q)
    every = F.lit(True)
    for w in words:
        every = every & F.contains(pool, F.lit(w))
    return exact | F.contains(pool, F.lit(q)) | every


def rank(query: str, label: Column, keywords: Column) -> Column:
    """0 label equal, 1 a keyword equal, 2 label starts so, 3 label holds it, 4 a keyword holds it, 5 else."""
    q, low = query.lower(), F.lower(label)
    keys = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(k))
    return first_rule([(low == q, 0), (F.array_contains(keys, q), 1), (low.startswith(q), 2), (F.contains(low, F.lit(q)), 3), (F.exists(keys, lambda k: F.contains(k, F.lit(q))), 4)], 5)


def search(df: DataFrame, query: str, label: str, keywords: str, hidden: str) -> DataFrame:
    """Entries that a query finds, best first: (columns of df, rank), by rank and label; hidden ones are left out, a null
    flag hides nothing."""
    hits = df.where(~F.coalesce(F.col(hidden), F.lit(False))).where(loose_match(query, F.col(label), F.col(keywords)))
    return hits.withColumn("rank", rank(query, F.col(label), F.col(keywords))).orderBy("rank", label)


def detect(df: DataFrame, id: str, text: str, entries: DataFrame, key: str, keywords: str, certain: int = 6) -> DataFrame:
    """(id, key, score, uncertain): the entry whose keywords found in a text are longest in sum, the first on ties.

    entries are a catalogue and are broadcast, up to 2,000 of them; more raise an error. Texts without any keyword give
    no row.
    """
    n = entries.limit(2001).count()
    if n > 2000:
        raise ValueError("catalogue over 2,000 entries: join it by words instead")
    rows = sorted(entries.select(F.col(key), F.transform(F.col(keywords), lambda k: F.lower(k))).collect(), key=lambda r: r[0])
    padded = F.concat(F.lit(" "), normalized_text(F.col(text)), F.lit(" "))
    found = lambda t, k: F.contains(t, F.lit(f" {k} " if len(k) <= 3 and k.isascii() and k.isalnum() else k))

    def scores(t: Column) -> Column:
        out = []
        for i, r in enumerate(rows):
            total = F.lit(0)
            for k in [k for k in r[1] or [] if k]:
                total = total + F.when(found(t, k), len(k)).otherwise(0)
            out.append(F.struct(total.alias("score"), F.lit(-i).alias("i"), F.lit(r[0]).alias("key")))
        return F.array_max(F.array(*out))

    if not rows:
        return df.select(id, F.lit("").alias(key), F.lit(0).alias("score"), F.lit(True).alias("uncertain")).limit(0)
    # generated rows, so that a text is normalised once and scored once, whatever is filtered later
    out = df.select(id, F.explode(F.array(padded)).alias("_t")).select(id, F.explode(F.array(scores(F.col("_t")))).alias("_b")).where("_b.score > 0")
    return out.select(id, F.col("_b.key").alias(key), F.col("_b.score").alias("score"), (F.col("_b.score") < certain).alias("uncertain"))

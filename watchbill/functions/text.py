"""Names, phones, dates and keys as column expressions (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchbill.functions.clock import let

# Month names by number.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def empty_to_null(text: Column) -> Column:
    """Blank text as null: empty means missing."""
    return F.nullif(F.trim(text), F.lit(""))


def normalized_text(text: Column) -> Column:
    """Lower case, everything but letters and digits as one blank, none outside; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def canonical_name(name: Column) -> Column:
    """The join key of names: lower case Latin letters, digits and Arabic letters only, without titles and articles.

    A leading `dr` goes even where a name starts so; remarks in parentheses go; hyphens join; `al` and `el` go as words
    and as prefixes of Latin words that keep two letters or more.
    """
    t = F.regexp_replace(F.lower(F.trim(name)), "^dr\\.?\\s*", " ")
    t = F.regexp_replace(t, "\\([^)]*\\)", " ")
    t = F.regexp_replace(F.regexp_replace(t, "(?<![a-z0-9_])dr(?![a-z0-9_])\\.?", " "), "-", "")
    t = F.trim(F.regexp_replace(t, "[^a-z0-9\u0600-ۿ]+", " "))
    words = F.filter(F.split(t, " "), lambda w: ~w.isin("al", "el", ""))
    return F.array_join(F.transform(words, lambda w: F.regexp_replace(w, "^(?:al|el)(?=[a-z]{2,}$)", "")), " ")


def name_tokens(name: Column, least: int = 1) -> Column:
    """Words of the canonical name of at least `least` letters."""
    return F.filter(F.split(canonical_name(name), " "), lambda w: F.length(w) >= least)


def clean_phone(phone: Column) -> Column:
    """A mobile number as ten digits 05..., from +966, 966 or a missing zero; null if it is none."""
    digits = F.regexp_replace(F.translate(phone, "٠١٢٣٤٥٦٧٨٩", "0123456789"), "[^0-9]", "")
    local = F.regexp_replace(F.regexp_replace(digits, "^(?:00)?966", ""), "^(?=5[0-9]{8}$)", "0")
    return F.when(local.rlike("^05[0-9]{8}$"), local)


def phones_in(text: Column) -> Column:
    """All mobile numbers in a text, in order, as ten digits."""
    found = F.regexp_extract_all(text, F.lit("(?<![0-9])(?:\\+?966[ -]?|0)?(5[0-9][ -]?[0-9]{3}[ -]?[0-9]{4})(?![0-9])"), F.lit(1))
    return F.transform(found, lambda p: F.concat(F.lit("0"), F.regexp_replace(p, "[ -]", "")))


def date_key(text: Column) -> Column:
    """DD/MM of the first date in a text: d/m, d.m, d-m, d MONTH, d-MON-yy; null if there is none."""
    numeric = let(F.struct(*[F.regexp_extract(text, "(?<![0-9])([0-9]{1,2})[/.-]([0-9]{1,2})(?![0-9])", k).alias(f"g{k}") for k in (1, 2)]),
                  lambda g: F.when(g["g1"] != "", F.concat(F.lpad(g["g1"], 2, "0"), F.lit("/"), F.lpad(g["g2"], 2, "0"))))
    pattern = f"(?<![0-9])([0-9]{{1,2}})[ -]({'|'.join(MONTHS)})[a-z]*"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(F.lower(text), pattern, 2))
    named = F.when(month > 0, F.concat(F.lpad(F.regexp_extract(F.lower(text), pattern, 1), 2, "0"), F.lit("/"), F.lpad(month.cast("string"), 2, "0")))
    return F.coalesce(numeric, named)


def slug(text: Column, prefix: str = "custom_", most: int = 50) -> Column:
    """A key made of a title: prefix, lower case letters and digits joined by _, cut to `most` characters."""
    body = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", "")
    return F.substring(F.concat(F.lit(prefix), body), 1, most)


def contains_word(text: Column, word: Column | str) -> Column:
    """Whether a word stands in a text as a whole word."""
    w = F.lit(word) if isinstance(word, str) else word
    return F.contains(F.concat(F.lit(" "), normalized_text(text), F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" ")))

"""Several values typed into one field, as one row per value.

The field is split on its quote characters: odd pieces are literals, even pieces are searched for delimiters, and
array functions put the pieces together again and number the values. Parenthesised remarks are protected in the
same way one level deeper. Everything is a JVM expression over one row, so no row moves between partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchbill.functions.clock import let

# Marks used while a field is taken apart; they are removed from the input first.
_QUOTE, _REMARK, _CUT = "\ue0f1", "\ue0f2", "\ue0f3"

# Characters that separate values wherever they stand outside quotes and remarks.
DELIMITERS = "/,;|\\\\&+\u2022\u00b7\u25cf\u25aa\u2219\n\r\t\u060c\u061b"
# Titles: a blank before one starts a new value, unless the word before is a title too.
TITLES = "(?:(?i:dr|prof)(?:\\.|(?= ))|\u062f\\.)"

_BEFORE = f"(^|\\G|[{DELIMITERS}\\[{{]|(?<= )(?i:and) | - )(\\s*)"
_AFTER = f"(?=\\s*(?:$|[{DELIMITERS}\\]}}(\"'{_QUOTE}]|(?i:and) |- ))"
_QUOTED = (
    ('"', f'{_BEFORE}"([^"]*+(?:""[^"]*+)*+)"{_AFTER}', '""', '"'),
    ("'", f"{_BEFORE}'([^']*+(?:''[^']*+)*+)'{_AFTER}", "''", "'"),
    ("\u201c", f"{_BEFORE}\u201c([^\u201c\u201d]*+)\u201d{_AFTER}", None, None),
    ("\u00ab", f"{_BEFORE}\u00ab([^\u00ab\u00bb]*+)\u00bb{_AFTER}", None, None),
)
# Numbering, not within an open parenthesis: the look-behind is as long as any text and comes last, where it seldom runs.
_NUMBERED = "(^|[\\s,;/|])(?=(?:\\([0-9]{1,2}\\)|[0-9]{1,2}[.)\\-])\\s+\\S)(?<!\\([^()]{0,2000000000})(?:\\([0-9]{1,2}\\)|[0-9]{1,2}[.)\\-])\\s+"
_SEPARATOR = (
    f"[{DELIMITERS}]|(?<=\\s)[-\u2013\u2014](?=\\s)|(?<=\\s)(?:(?i:and)|\u0648)(?=\\s)| {{2,}}"
    f"|(?<!\\b(?i:dr|prof)|\\b(?i:dr|prof)\\.|^|\u062f\\.)\\s+(?={TITLES})"
)
# What a field of two values or more has at least one of: a delimiter, a quote, a dash or word that separates, two
# blanks, a title behind a blank, or numbering.
_MAY_CUT = (
    f"[{DELIMITERS}\"'\u201c\u00ab]|\\s(?:[-\u2013\u2014]|(?i:and)|\u0648)\\s|  |\\s{TITLES}|[0-9][.)-]\\s"
)
_EDGE = "^(?:[\\s\\[{\\]}\u2022\u00b7*\u2013\u2014-])+|[\\s\\[{\\]}\u2022\u00b7*\u2013\u2014-]+$"


def values_of(field: Column) -> Column:
    """The values typed in a field, in order, as array<string>.

    Null gives null, a field of blanks and separators an empty array. Quotes doubled inside quotes come out single;
    outer blanks, list marks, numbering, enclosing quotes and square or curly brackets are removed; a piece without
    any letter or digit is no value. Text in parentheses is never split. A one-comma field of two single words
    without title ("Last, First") is one value.
    """
    return let(field, _values)


def _values(field: Column) -> Column:
    text = F.translate(field, _QUOTE + _REMARK + _CUT, "")
    one = F.regexp_replace(text, _EDGE, "")
    single = F.filter(F.array(one), lambda v: v.rlike("[\\p{L}\\p{N}]"))
    swapped = F.trim(field).rlike(f"^(?!{TITLES})[^\\s{DELIMITERS}\"'()]+, (?!{TITLES})[^\\s{DELIMITERS}\"'()]+$")
    return F.when(field.isNull(), None).when(~text.rlike(_MAY_CUT), single).when(swapped, F.array(F.trim(field))).otherwise(_split(text))


def _split(text: Column) -> Column:
    def unquoted(piece: Column) -> Column:
        numbered = F.regexp_replace(piece, _NUMBERED, f"$1{_CUT}")
        parts = F.split(F.regexp_replace(numbered, "(\\([^()]*\\))", f"{_REMARK}$1{_REMARK}"), _REMARK)
        cut = F.transform(parts, lambda p, i: F.when(i % 2 == 1, p).otherwise(F.regexp_replace(p, _SEPARATOR, _CUT)))
        return F.array_join(cut, "")

    def literal(piece: Column) -> Column:
        out = piece
        for _, _, doubled, single in _QUOTED[:2]:
            out = F.replace(out, F.lit(doubled), F.lit(single))
        return F.concat(F.lit(_CUT), out)

    def quotes(text: Column, kinds: Sequence[tuple]) -> Column:
        if not kinds:
            return pieces(text)
        mark, pattern, _, _ = kinds[0]
        marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"$1$2{_QUOTE}$3{_QUOTE}"))
        return let(F.when(F.contains(text, F.lit(mark)), marked).otherwise(text), lambda t: quotes(t, kinds[1:]))

    def pieces(text: Column) -> Column:
        parts = F.transform(F.split(text, _QUOTE), lambda p, i: F.when(i % 2 == 1, literal(p)).otherwise(unquoted(p)))
        values = F.transform(F.split(F.array_join(parts, ""), _CUT), lambda v: F.regexp_replace(v, _EDGE, ""))
        return F.filter(values, lambda v: v.rlike("[\\p{L}\\p{N}]"))

    return quotes(text, _QUOTED)


def explode_values(df: DataFrame, ids: Sequence[str], fields: Sequence[str], least: int = 2) -> DataFrame:
    """One row (ids, field, pos, val) for each value of each field that holds at least `least` values.

    Null, empty and single-valued fields give no row for least = 2; repeated rows stay repeated. Columns named
    field, pos or val in df do not clash, as only ids and fields are read.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), values_of(F.col(f)).alias("values")) for f in fields])
    rows = df.select(*ids, F.explode(cells).alias("_cell")).where(F.size("_cell.values") >= least)
    return rows.select(*ids, F.col("_cell.field").alias("field"), F.posexplode("_cell.values").alias("_pos", "val")).select(
        *ids, "field", (F.col("_pos") + 1).alias("pos"), "val"
    )

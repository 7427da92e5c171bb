"""Text that looks the same brought to one form.

Strings that look alike (a ligature and its letters, a letter with an accent of its own and one with a combining accent,
letters of other scripts, full-width letters, kinds of blank and hyphen, format characters and nothing) are joined by
union-find into transitive classes. Each class is represented by its member that is most frequent in the texts
themselves, and texts are rewritten greedily, longest match first, by an Aho-Corasick automaton over all members.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts drawn like a Latin letter: Cyrillic, Greek and other letters; Cyrillic like Greek,
# Armenian and Georgian, Cherokee, Lisu, Coptic; digits of Persian like Arabic ones (4, 5 and 6 are drawn differently).
LOOKALIKES = """
А A, В B, С C, Е E, Н H, І I, Ј J, К K, М M, О O, Р P, Ѕ S, Т T, Х X, У Y, Ԛ Q, Ԝ W, Һ h,
а a, с c, е e, һ h, і i, ј j, о o, р p, ѕ s, х x, у y, ԁ d, ԛ q, ԝ w, ӏ l, Ӏ I, ѵ v,
Α A, Β B, Ε E, Ζ Z, Η H, Ι I, Κ K, Μ M, Ν N, Ο O, Ρ P, Τ T, Υ Y, Χ X, ϲ c, Ϲ C, ϳ j, Ϳ J,
ο o, ν v, ι i, ρ p, α a, υ u, ɡ g, ɑ a, ı i, ʟ L,
Г Γ, П Π, Ф Φ, к κ, Ү Y, Ӕ Æ, ӕ æ,
օ o, Օ O, Տ S, Ս U, Լ L, հ h, յ j, ո n, ս u, ց g, զ q, ყ y, ჿ o,
Ꭰ D, Ꭲ T, Ꭺ A, Ꭻ J, Ꭼ E, Ꮃ W, Ꮇ M, Ꮋ H, Ꮐ G, Ꮓ Z, Ꮪ S, Ꮩ V, Ꮮ L, Ꮯ C, Ꮲ P, Ꮶ K, Ᏼ B, Ꮢ R,
ꓐ B, ꓑ P, ꓓ D, ꓔ T, ꓖ G, ꓗ K, ꓙ J, ꓚ C, ꓜ Z, ꓝ F, ꓟ M, ꓠ N, ꓡ L, ꓢ S, ꓣ R, ꓦ V, ꓧ H, ꓪ W, ꓫ X, ꓬ Y, ꓮ A, ꓰ E, ꓲ I, ꓳ O, ꓴ U,
Ⲟ O, ⲟ o, Ⲣ P, ⲣ p, Ⲥ C, ⲥ c, Ⲕ K, Ⲙ M, Ⲛ N, Ⲏ H, Ⲓ I, Ⲧ T, Ⲩ Y, Ⲭ X, Ⲃ B,
۰ ٠, ۱ ١, ۲ ٢, ۳ ٣, ۷ ٧, ۸ ٨, ۹ ٩
"""
# Hyphens drawn like the ASCII one, apostrophes like the straight one, blanks that Unicode lists as format characters.
HYPHENS = "‐‑⁃﹣－‒−"
APOSTROPHES = "‘’ʼʹ′＇"
# Letters of Persian and Urdu drawn like an Arabic one before a letter they join, or only elsewhere.
JOINED = {"\u06cc": "\u064a", "\u06a9": "\u0643", "\u06be": "\u0647"}
UNJOINED = {"\u06cc": "\u0649", "\u06c1": "\u0647", "\u06d5": "\u0647"}
# Kinds of compatible characters that look different from the plain ones: x² is not x2, nor ① 1.
UNLIKE = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<vertical>")
INVISIBLE = "\u180e\u200b\ufeff\u2060\u00ad\u034f\u115f\u1160\u3164"

_ARABIC = "\u0620\u0622-\u064a\u066e-\u0673\u0675-\u06d3\u06d5\u06ee\u06ef\u06fa-\u06ff\ufb50-\ufdff\ufe70-\ufefc"
_MARKS = "\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc"
# with a hamza above Farsi yeh has no dots anywhere, like the Arabic yeh with one
_JOINED = re.compile(f"\u06cc(?=\u0654)|[{''.join(JOINED)}](?=[{_MARKS}]*[{_ARABIC}])")
_UNJOINED = re.compile(f"[{''.join(UNJOINED)}](?!\u0654|[{_MARKS}]*[{_ARABIC}])")


def by_position(text: str) -> str:
    """Decomposed text with letters that look like an Arabic one at their place in the word replaced by it."""
    return _UNJOINED.sub(lambda m: UNJOINED[m[0]], _JOINED.sub(lambda m: JOINED[m[0]], text))


class Classes:
    """Union-find over strings, the empty string among them."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def members(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in out.values() if len(v) > 1]


def invisible(c: str) -> bool:
    return c in INVISIBLE or unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F


def lookalike_classes(alphabet: Sequence[str]) -> list[list[str]]:
    """Transitive classes of the strings that look alike, over the code points that occur in the decomposed texts.

    Case, spelling, accents and the number of blanks stay visible: nothing joins `a` with `A` or `é`, or one blank with
    two. Tabs and line ends are no blanks here.
    """
    classes = Classes()
    for pair in LOOKALIKES.replace("\n", " ").split(","):
        classes.join(*pair.split())
    for c in alphabet:
        if invisible(c):
            classes.join(c, "")
        elif unicodedata.category(c) == "Zs":
            classes.join(c, " ")
        elif c in HYPHENS:
            classes.join(c, "-")
        elif c in APOSTROPHES:
            classes.join(c, "'")
        else:
            other = c if unicodedata.decomposition(c).startswith(UNLIKE) else unicodedata.normalize("NFKD", c)
            # spacing accents decompose into a blank and an accent: no letter looks like that
            if other != c and not other.startswith(" "):
                classes.join(c, other)
    return classes.members()


def representatives(classes: list[list[str]], counts: dict[str, int]) -> dict[str, str]:
    """Member to representative: the member most frequent in the texts, the ASCII and then the smaller one on ties.

    The class of the empty string is represented by it, one with a letter that looks different by its place by that.
    A representative holds no member of another class (a ligature of full-width letters is written with plain ones), so
    that rewriting does not make texts longer and longer; one that cannot be settled so raises an error.
    """
    out = {}
    for members in classes:
        best = "" if "" in members else min(members, key=lambda m: (m not in JOINED and m not in UNJOINED, -counts.get(m, 0), not m.isascii(), len(m), m))
        out |= {m: best for m in members if m != best}
    for m, best in out.items():
        for _ in range(len(out) + 1):
            settled = "".join(out.get(c, c) for c in best)
            if settled == best:
                break
            best = settled
            if len(best) > 64:
                raise ValueError(f"the look-alike class of {m!r} is written with itself")
        out[m] = best
    return out


class Rewriter:
    """Greedy rewriting by an Aho-Corasick automaton until nothing changes.

    Letters are taken apart from their accents first and put together last, so that a letter of any script meets its
    class with and without accents.
    """

    def __init__(self, table: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        for member, best in table.items():
            if member:
                self.automaton.add_word(member, (len(member), best))
        self.any = len(self.automaton) > 0
        # most texts are plain and hold nothing that is rewritten
        self.plain = not any(m.isascii() for m in table if m)
        if self.any:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        if not text or self.plain and text.isascii():
            return text
        text = unicodedata.normalize("NFD", text)
        # ends: no step makes a text longer than its letters' longest forms, so at last one comes again; of texts that
        # come in turns the smallest is the form, whichever of them was typed
        seen: dict[str, int] = {}
        while text not in seen:
            seen[text] = len(seen)
            text = self.step(text)
        text = min(t for t, n in seen.items() if n >= seen[text])
        return unicodedata.normalize("NFC", text)

    def step(self, text: str) -> str:
        out, at = [], 0
        for end, (length, best) in self.automaton.iter_long(text) if self.any else ():
            out += (text[at : end + 1 - length], best)
            at = end + 1
        return by_position(unicodedata.normalize("NFD", "".join(out) + text[at:]) if out else text)


def learn(columns: Sequence[tuple[DataFrame, str]]) -> dict[str, str]:
    """The rewriting table of all texts in the given columns.

    All code points of all rows are counted; what reaches the driver is one count per code point and per longer class
    member, which the alphabet bounds.
    """
    texts = None
    for df, c in columns:
        one = df.select(F.col(c).alias("t")).where("t is not null")
        texts = one if texts is None else texts.unionByName(one)
    letters = texts.select(F.explode(F.split("t", "")).alias("c")).where("c <> ''").groupBy("c").count()
    # split cuts at UTF-16 units in no case: Java's empty pattern keeps surrogate pairs together
    counts: dict[str, int] = {}
    for r in letters.collect():
        for c in unicodedata.normalize("NFD", r[0]):
            counts[c] = counts.get(c, 0) + r[1]
    classes = lookalike_classes(sorted(counts))
    long = sorted({m for k in classes for m in k if len(m) > 1})
    if long:
        sums = [F.sum((F.length("t") - F.length(F.replace("t", F.lit(m), F.lit("")))) / len(m)).cast("bigint") for m in long]
        counts |= {m: int(n or 0) for m, n in zip(long, texts.agg(*sums).first())}
    return representatives(classes, counts)


def one_form(text: Column, table: dict[str, str]) -> Column:
    """text in the form in which equal looks are equal strings; null stays null."""

    @F.pandas_udf("string")
    def rewrite(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        change = Rewriter(table)
        known: dict[str, str] = {}
        for s in parts:
            if len(known) > 200_000:
                known.clear()
            known |= {t: change(t) for t in s.dropna().unique() if t not in known}
            yield s.map(known).astype("object").where(s.notna(), None)

    return rewrite(text)


def same_look(left: DataFrame, right: DataFrame, on: Sequence[str], left_text: str, right_text: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of rows with equal `on` whose texts look the same but are not the same characters.

    Null and empty texts match nothing. The forms are learned from both columns. Repeated rows give repeated pairs of
    their ids; an empty side gives no rows. Only `on`, texts and ids are read.
    """
    table = learn([(left, left_text), (right, right_text)])
    a = left.where(F.col(left_text) != "").select(*on, F.col(left_id).alias("_l"), F.col(left_text).alias("_lt"))
    b = right.where(F.col(right_text) != "").select(*on, F.col(right_id).alias("_r"), F.col(right_text).alias("_rt"))
    a, b = a.withColumn("_look", one_form(F.col("_lt"), table)), b.withColumn("_look", one_form(F.col("_rt"), table))
    out = a.where("_look <> ''").join(b, [*on, "_look"]).where("_lt <> _rt")
    return out.select(F.col("_l").alias(left_id), F.col("_r").alias(right_id))

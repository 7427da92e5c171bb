"""Typed names and phones in comparable form: tokens without titles, a fold over scripts and transliterations."""

from __future__ import annotations

import re
import unicodedata

# Titles and degrees, particles, and words that name no person.
TITLES = frozenset("dr prof md mr mrs ms mbbs phd د دكتور др".split())
PARTICLES = frozenset("al el bin ibn bint the and of".split())

# Arabic and Cyrillic letters in Latin.
ARABIC = dict(zip(
    "ا أ إ آ ب ت ث ج ح خ د ذ ر ز س ش ص ض ط ظ ع غ ف ق ك ل م ن ه ة و ؤ ي ى ئ پ چ ڤ گ".split(),
    "a a a a b t th j h kh d d r z s sh s d t z a g f k k l m n h a u u i i i b sh f g".split(),
)) | {"ء": "", "\u06cc": "i", "\u06a9": "k"}
CYRILLIC = dict(zip(
    "а б в г д е ё ж з и й к л м н о п р с т у ф х ц ч ш щ ы э ю я і ј ѕ һ ԁ".split(),
    "a b v g d e e j z i i k l m n o p r s t u f kh ts sh sh sh i e u a i j s h d".split(),
)) | {"ь": "", "ъ": ""}
# Cyrillic and Greek letters that look like Latin ones, for words that mix scripts.
MIXED = dict(zip("аеорсухіјѕһԁвкмнтοανρτικ", "aeopcyxijshdbkmhtoavptik"))

_WORD = re.compile(r"[^\W\d_]+\.?")
_CAMEL = re.compile(r"(?<=[a-zа-яё])(?=[A-ZА-ЯЁ])")
_REMARK = re.compile(r"\([^()]*\)")


def plain(text: str) -> str:
    """text without accents, format characters and letter width."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf"))


def latin(word: str) -> str:
    """A lower-case word in Latin letters; words that mix scripts are read by look, others by sound."""
    if word.isascii():
        return word
    if any(c.isascii() and c.isalpha() for c in word):
        return "".join(MIXED.get(c, CYRILLIC.get(c, c)) for c in word)
    return "".join(ARABIC.get(c, CYRILLIC.get(c, MIXED.get(c, c))) for c in word)


# Letters and letter pairs that one sound is written with, longest first.
_SOUNDS = (("kh", "x"), ("th", "8"), ("sh", "5"), ("ch", "5"), ("gh", "g"), ("dh", "d"), ("ph", "f"), ("q", "k"), ("c", "k"), ("v", "f"), ("p", "b"), ("w", "u"), ("o", "u"), ("y", "i"), ("e", "i"))


def memo(f):
    """f with its results kept; unlike functools' caches it can travel to workers by value."""
    known: dict = {}

    def g(*args):
        try:
            return known[args]
        except KeyError:
            if len(known) > 500_000:
                known.clear()
            out = known[args] = f(*args)
            return out

    return g


@memo
def fold(word: str) -> str:
    """The sounds of a Latin word: spellings of one sound alike, repeated letters once."""
    for a, b in _SOUNDS:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def tokens(text: str | None) -> list[tuple[str, str, bool]]:
    """(Latin word, folded word, shortened) of each word of a typed name, without titles, particles and remarks.

    shortened: an initial, or a word that ends in a full stop. Glued words are split where a capital follows a small
    letter; Al- and El- are dropped, also where glued to a longer word.
    """
    out = []
    for typed in _WORD.findall(_CAMEL.sub(" ", plain(_REMARK.sub(" ", text or "")))):
        word = typed.rstrip(".").lower()
        if word in TITLES or word in PARTICLES:
            continue
        if word.startswith("ال") and len(word) > 4:
            word = word[2:]
        word = latin(word)
        if word[:2] in ("al", "el") and len(word) > 5:
            word = word[2:]
        if word and word not in PARTICLES and word not in TITLES:
            out.append((word, fold(word), typed.endswith(".") or len(word) == 1))
    return out


_EXTENSION = re.compile(r"(?i)\b(?:ext|x)\.?\s*\d+")
_NUMBER = re.compile(r"(?<![\d:/.+-])\d{1,3}(?![\d:/-]|\.\d)")


def numbers(text: str | None) -> str:
    """The numbers of up to three digits in a typed name, sorted: they tell units apart (ward 3, ward 7).

    Extensions, phones, dates, clock times and remarks in parentheses are no part of a name.
    """
    t = plain(_REMARK.sub(" ", text or "").translate(_DIGITS))
    return " ".join(sorted((str(int(n)) for n in _NUMBER.findall(_EXTENSION.sub(" ", t))), key=lambda n: (len(n), n)))


_DIGITS = {ord(c): str(i % 10) for i, c in enumerate("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹")}


def phone_digits(phone: str | None) -> tuple[str, str]:
    """(whole number as ten digits starting with 05, or ''; digits known of its end, or '').

    +966, 966 and a missing zero are understood. A number with one digit too few or too many counts as whole; one cut
    short at its end gives its digits with a `-` after them.
    """
    if not phone:
        return "", ""
    text = plain(phone.translate(_DIGITS)).lower()
    if "ext" in text:
        return "", ""
    groups = re.findall(r"\d+", text)
    digits = "".join(groups)
    if re.search(r"[x.*…_?]", text) and len(groups) > 0 and not re.fullmatch(r"[\d .()+-]*\d", text.replace("..", "x")):
        return "", groups[-1] if len(groups[-1]) >= 3 else ""
    if digits.startswith("00966"):
        digits = digits[5:]
    elif digits.startswith("966") and len(digits) >= 12:
        digits = digits[3:]
    if digits.startswith("5") and len(digits) == 9:
        digits = "0" + digits
    if len(digits) == 10 and digits.startswith("05"):
        return digits, digits[-4:]
    if digits.startswith("05") and len(digits) in (9, 11):
        return digits, ""
    if digits.startswith("05") and 5 <= len(digits) < 9:
        return "", digits + "-"
    return "", digits if 3 <= len(digits) <= 7 else ""


def distance(a: str, b: str, limit: int) -> int:
    """Damerau-Levenshtein distance (optimal string alignment), limit + 1 if larger."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    # letters alike at both ends cost nothing
    low, most = 0, min(n, m)
    while low < most and a[low] == b[low]:
        low += 1
    high = 0
    while high < most - low and a[n - 1 - high] == b[m - 1 - high]:
        high += 1
    a, b = a[low : n - high], b[low : m - high]
    n, m = len(a), len(b)
    if not n or not m:
        return n or m
    if limit == 1:
        return 1 if n == m == 1 or n == m == 2 and a[0] == b[1] and a[1] == b[0] else 2
    far = limit + 1
    before, last = None, list(range(m + 1))
    for i in range(1, n + 1):
        row = [far] * (m + 1)
        row[0] = least = i
        x = a[i - 1]
        for j in range(max(1, i - limit), min(m, i + limit) + 1):
            y = b[j - 1]
            d = last[j - 1] + (x != y)
            if last[j] + 1 < d:
                d = last[j] + 1
            if row[j - 1] + 1 < d:
                d = row[j - 1] + 1
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            row[j] = d
            if d < least:
                least = d
        if least > limit:
            return far
        before, last = last, row
    return min(last[m], far)


def nickname(short: str, long: str) -> bool:
    """Whether one Latin first name is a pet form of the other: a common beginning, then only a short vowel ending."""
    if len(short) > len(long):
        short, long = long, short
    n = 0
    while n < len(short) and short[n] == long[n]:
        n += 1
    return n >= 3 and len(short) - n <= 2 and all(c in "aeiouy" for c in short[n:])


def assignment(costs: list[list[float]]) -> tuple[float, list[int]] | None:
    """(least sum of one place in each row, all of different columns; the column of each row); None if every sum is
    infinite. There are at least as many columns as rows.

    Shortest augmenting paths with potentials, rows x rows x columns steps.
    """
    n, m, far = len(costs), len(costs[0]), 1e6
    u, v, row_of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, came, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while row_of[at]:
            done[at] = True
            r, delta, following = row_of[at], float("inf"), 0
            for j in range(1, m + 1):
                if done[j]:
                    continue
                c = min(costs[r - 1][j - 1], far) - u[r] - v[j]
                if c < least[j]:
                    least[j], came[j] = c, at
                if least[j] < delta:
                    delta, following = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = following
        while at:
            row_of[at] = row_of[came[at]]
            at = came[at]
    places = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            places[row_of[j] - 1] = j - 1
    total = sum(costs[i][j] for i, j in enumerate(places))
    return (total, places) if total < float("inf") else None


def least_assignment(costs: list[list[float]]) -> float | None:
    """The sum alone."""
    out = assignment(costs)
    return out[0] if out else None

"""Rows of one site whose typed names mean the same person or unit.

Trie join: the distinct words of a site's names go into tries; a bit-parallel Levenshtein automaton with swaps walks
them for every word and lists the words within a bounded distance, to which pet forms, shortened and squeezed words are
added. A name then meets, in an equi join, the names that hold a word near its rarest and one near its second rarest
word, which every name it fits does; their words are compared in all orders. Links between full names give components;
within one, phones and specialties separate namesakes; short forms (initials, single words) join the one person they fit.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchbill.llm.names import assignment, distance, memo, nickname, numbers, tokens
from watchbill.operators.components import components_within, joined
from watchbill.operators.grouped import stream_groups
from watchbill.sources.tables import busy_parts, written

NO_SITE = "\ue0f0"  # rows without a site form one of their own
FAR = 4.0  # largest cost at which two full names are one
SHARD = 10_000  # names of a site whose words are walked, and whose candidates compared, in one task
PEOPLE = 10_000  # rows of a person that are paired with the others in one task

Word = tuple[str, str, bool]  # Latin letters, sounds, whether it is shortened


def insert(root: dict, word: str) -> None:
    node = root
    for c in word:
        node = node.setdefault(c, {})
    node[""] = word


def trie_of(words: list[str]) -> dict:
    """Nested dicts letter by letter; the key '' holds the word that ends there."""
    root: dict = {}
    for w in words:
        insert(root, w)
    return root


def close_pairs(words: list[str], asked: list[str], most) -> Iterator[tuple[str, str]]:
    """Pairs of an asked word with each word within most(asked word) edits, either way round.

    Where all words are asked each walks the trie of those before it only, short ones first, as the pair is then known.
    """
    if len(asked) < len(words):
        root = trie_of(words)
        for w in asked:
            yield from ((w, x) for x, _ in neighbours(root, w, most(w)))
        return
    root = {}
    for w in sorted(words, key=len):
        for x, _ in neighbours(root, w, most(w)):
            yield w, x
            yield x, w
        yield w, w
        insert(root, w)


def neighbours(root: dict, word: str, most: int) -> list[tuple[str, int]]:
    """(word of the trie, distance) within `most` edits (insert, drop, replace, swap) of word.

    The automaton's state is one bit set per number of edits: bit i says that i letters of word are read. A branch is
    left as soon as the state of `most` edits is empty.
    """
    if most > 2:
        raise ValueError("at most two edits")
    full = (1 << (len(word) + 1)) - 1
    end = len(word)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(word):
        masks[c] |= 1 << i
    letter = masks.get
    # of a node: the states of 0, 1 and 2 edits, those of its parent but the last, and the mask of its letter
    out, stack = [], [(root, 1, 3 & full if most else 0, 7 & full if most > 1 else 0, 0, 0, 0)]
    while stack:
        node, s0, s1, s2, p0, p1, last = stack.pop()
        for c, child in node.items():
            if not c:
                if (s0 | s1 | s2) >> end & 1:
                    out.append((child, 0 if s0 >> end & 1 else 1 if s1 >> end & 1 else 2))
                continue
            m = letter(c, 0)
            swap = m & last >> 1
            n0 = (s0 & m) << 1
            n1 = n2 = 0
            if most:
                n1 = ((s1 & m | s0 | n0) << 1 | s0 | (p0 & swap) << 2) & full
                if most > 1:
                    n2 = ((s2 & m | s1 | n1) << 1 | s1 | (p1 & swap) << 2) & full
            if n0 or n1 or n2:
                stack.append((child, n0, n1, n2, s0, s1, m))
    return out


def reach(word: str) -> int:
    """Edits allowed in a folded word."""
    return 0 if len(word) < 3 else 1 if len(word) < 5 else 2


def squeezed(short: str, long: str) -> bool:
    """Whether a word of three or four letters is a longer one with letters left out (ctr, dept)."""
    if not (3 <= len(short) <= 4 and len(long) >= len(short) + 3 and short[0] == long[0]):
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def fits(a: Word, b: Word) -> float | None:
    """Cost of two words meaning the same, whichever comes first; None if they do not."""
    if a[1] == b[1]:
        return 0.0
    if a[2] or b[2]:
        short, long = (a, b) if (a[2], -len(a[0])) > (b[2], -len(b[0])) else (b, a)
        if len(short[0]) == 1:
            return 0.6 if long[0][0] == short[0] or long[1][0] == short[1] else None
        return 0.4 if long[0].startswith(short[0]) else 0.6 if squeezed(short[0], long[0]) else None
    if squeezed(a[0], b[0]) or squeezed(b[0], a[0]):
        return 0.6
    most = min(reach(a[1]), reach(b[1]))
    d = distance(a[1], b[1], most)
    if d <= most:
        return float(d)
    d = distance(a[0], b[0], 2)
    if d <= 2 and min(len(a[0]), len(b[0])) >= 5:
        return float(d)
    return 1.0 if nickname(a[0], b[0]) else None


cost_of = memo(fits)


def same_name(a: list[Word], b: list[Word]) -> float | None:
    """Least cost over the orders in which the words of the shorter name can be found in the longer one.

    Words too many cost 0.5 each; two names must share at least two words, one of them not shortened and one more
    than an initial. Glued words are compared as a whole. None if the names do not fit.
    """
    if len(a) > len(b):
        a, b = b, a
    best = None
    if len(a) >= 2:
        costs = [[cost_of(x, y) for y in b] for x in a]
        best = _in_order(a, b, costs) if len(b) <= 4 else _assigned(a, b, costs)
        if best is not None:
            best += 0.5 * (len(b) - len(a))
    if best is None and a and len(a) < len(b) and (len(a) == 1 or len(b) <= 3):
        one = "".join(w[1] for w in a)
        if len(one) >= 7 and abs(sum(len(w[1]) for w in b) - len(one)) <= 1 and not any(w[2] for w in a + b):
            return 0.5 if glued(one, [w[1] for w in b]) else None
    return best


def _in_order(a: list[Word], b: list[Word], costs: list) -> float | None:
    best = None
    for places in itertools.permutations(range(len(b)), len(a)):
        cost, long = 0.0, 0
        for i, j in enumerate(places):
            c = costs[i][j]
            if c is None:
                break
            cost += c
            long += not a[i][2] and not b[j][2]
        else:
            if long and (best is None or cost < best):
                best = cost
    return best


def _assigned(a: list[Word], b: list[Word], costs: list) -> float | None:
    """The same for names of many words: a least assignment; where it pairs shortened words only, the least of those
    that are made to pair two whole words."""
    known = [[float("inf") if c is None else c for c in row] for row in costs]
    found = assignment(known)
    if found is None:
        return None
    whole = [(i, j) for i in range(len(a)) for j in range(len(b)) if costs[i][j] is not None and not a[i][2] and not b[j][2]]
    if any(found[1][i] == j for i, j in whole):
        return found[0]
    best = None
    for i, j in whole:
        rest = [[c for k, c in enumerate(row) if k != j] for n, row in enumerate(known) if n != i]
        one = assignment(rest) if rest else (0.0, [])
        if one and (best is None or one[0] + costs[i][j] < best):
            best = one[0] + costs[i][j]
    return best


def glued(one: str, words: list[str], edits: int = 1) -> bool:
    """Whether a word is all the others in some order, within `edits` edits inside one of them."""
    if not words:
        return len(one) <= edits
    for i, w in enumerate(words):
        rest = words[:i] + words[i + 1 :]
        if one.startswith(w) and glued(one[len(w) :], rest, edits):
            return True
        for n in (len(w) - 1, len(w), len(w) + 1) if edits else ():
            if 0 < n <= len(one) and distance(one[:n], w, 1) == 1 and glued(one[n:], rest, 0):
                return True
    return False


def kind(words: list) -> str:
    """`full`: two words or more that are no initials; `short`: one such word; `none`: no such word."""
    long = sum(len(w[0]) > 1 for w in words)
    return "full" if long >= 2 else "short" if long else "none"


def text_of(w: Word) -> str:
    """A word as one string, by which words are joined."""
    return f"{w[0]}|{w[1]}|{'.' if w[2] else ''}"


def word_of(text: str) -> Word:
    raw, sounds, short = text.split("|")
    return raw, sounds, short == "."


def near_words(words: list[Word], asked: list[Word]) -> dict[Word, set[Word]]:
    """Of each asked word the words, initials apart, that it fits, or that a short form of one word may mean: complete,
    and little more."""
    by_sound, by_letters = defaultdict(list), defaultdict(list)
    stems, shorts, heads = defaultdict(list), defaultdict(list), defaultdict(list)
    words = [w for w in words if len(w[0]) > 1]
    for w in words:
        raw = w[0]
        by_sound[w[1]].append(w)
        if len(raw) >= 5:
            by_letters[raw].append(w)
        if w[2]:
            heads[raw].append(w)
        if 3 <= len(raw) <= 4:
            shorts[raw[0]].append(w)
        for n in range(max(3, len(raw) - 2), len(raw) + 1):  # what a pet form keeps of its name
            stems[raw[:n]].append(w)
    out: dict[Word, set[Word]] = {w: set() for w in asked if len(w[0]) > 1}
    of_sound, of_letters = defaultdict(list), defaultdict(list)
    for w in out:
        of_sound[w[1]].append(w)
        if len(w[0]) >= 5:
            of_letters[w[0]].append(w)
    for sound, other in close_pairs(list(by_sound), list(of_sound), lambda x: max(1, reach(x)) if len(x) > 3 else reach(x)):
        for w in of_sound[sound]:
            out[w].update(by_sound[other])
    for raw, other in close_pairs(list(by_letters), list(of_letters), lambda x: 2):
        for w in of_letters[raw]:
            out[w].update(by_letters[other])
    for w in words:  # words that are heads, stems or squeezed forms of w, seen from both
        raw = w[0]
        found = {x for n in range(2, len(raw) + 1) for k in (heads, stems) for x in k.get(raw[:n], ())}
        if len(raw) >= 6:
            found.update(x for x in shorts.get(raw[0], ()) if squeezed(x[0], raw))
        if w in out:
            out[w] |= found
        for x in found & out.keys():
            out[x].add(w)
    return {w: {x for x in found if cost_of(w, x) is not None or distance(w[1], x[1], 1) <= 1} for w, found in out.items()}


def short_cost(short: list, full: list) -> float | None:
    """Cost of a short form meaning a full name: initials must fit other words than the written one does."""
    best = None
    for k, w in enumerate(full):
        for one in short:
            if len(one[0]) == 1:
                continue
            d = distance(one[1], w[1], 1) if len(one[1]) > 3 else 0 if one[1] == w[1] else 2
            if d > 1:
                continue
            rest = full[:k] + full[k + 1 :]
            cost, initials = float(d), [s for s in short if len(s[0]) == 1]
            for s in initials:
                if not any(r[0][0] == s[0] or r[1][0] == s[1] for r in rest):
                    cost = None
                    break
            if cost is None:
                continue
            cost += 0.2 * k if not initials else 0
            cost += 0 if initials else 1
            best = cost if best is None else min(best, cost)
    return best


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, blocks, name_id, name) with the words of each name; names without a letter or number are left out."""
    for batch in batches:
        rows = []
        for name in batch.column("name").to_pylist():
            ws = tokens(name)
            whole = sorted({text_of(w) for w in ws if len(w[0]) > 1})
            letters = "" if any(w[2] for w in ws) else "".join(sorted("".join(w[1] for w in ws)))
            n = numbers(name)
            rows.append((len(ws), sum(len(w[0]) > 1 for w in ws), kind(ws), " ".join([*sorted(w[1] for w in ws), *n.split()]), whole, letters, n))
        at = [i for i, r in enumerate(rows) if r[3]]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
        columns = [pa.array([rows[i][k] for i in at], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int64())).columns, *columns], [*batch.schema.names, "n", "whole", "kind", "key", "words", "letters", "numbers"])


def _vocabulary(key, rows):
    """The words of a site to those near each of the block's own, and how many names hold one of them."""
    held = {word_of(r["w"]): r["n"] for r in rows}
    found = near_words(list(held), [word_of(r["w"]) for r in rows if r["own"]])
    for w, near in found.items():
        yield {"site": key[0], "w": text_of(w), "near": [text_of(x) for x in near], "weight": sum(held[x] for x in near)}


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (site, blocks, block, a, name_a, kind_a, b, name_b), sorted, to links (strong, a, b, cost, whole).

    A weak link leads from a short form to a full name. Strong links are given as the edges of a forest, each node's to
    the root of its tree, its smallest node, which keeps what is connected; a forest ends with its block or when it has
    grown large. whole: the site is one block, so that the forest's trees are its components.
    """
    read = memo(tokens)
    parent: dict[int, int] = {}
    weak: list[tuple[int, int, float]] = []
    shared: set[int] = set()  # nodes of sites of several blocks
    at = last = None

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def flush(strong: bool) -> pa.RecordBatch:
        edges = [(False, *x, False) for x in weak]
        weak.clear()
        if strong:
            edges += [(True, x, find(x), 0.0, x not in shared) for x in list(parent) if find(x) != x]
            parent.clear()
            shared.clear()
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], t) for k, t in enumerate(kinds)], ["strong", "a", "b", "cost", "whole"])

    for batch in batches:
        for r in batch.to_pylist():
            block = r["site"], r["block"]
            # the forest of a site of one block, which has at most SHARD names, is never cut
            if block != at and len(parent) + len(weak) > 5_000 or r["blocks"] > 1 and len(parent) > 200_000:
                yield flush(True)
            elif len(weak) > 50_000:
                yield flush(False)
            at = block
            pair = r["a"], r["b"]
            if pair == last:
                continue
            last, (x, y) = pair, (read(r["name_a"]), read(r["name_b"]))
            if r["kind_a"] == "full":
                # links already implied by others need no comparison
                if (r["a"] not in parent or r["b"] not in parent or find(r["a"]) != find(r["b"])) and (c := same_name(x, y)) is not None and c <= FAR:
                    low, high = sorted((find(r["a"]), find(r["b"])))
                    parent[high] = low
                    if r["blocks"] > 1:
                        shared.update((r["a"], r["b"]))
            else:
                c = short_cost(x, y)
                if c is None and len(x) == 1:
                    c = same_name(x, y)
                if c is not None:
                    weak.append((*pair, c))
    yield flush(True)


def candidates(named: DataFrame) -> DataFrame:
    """(site, blocks, block, a, name_a, kind_a, b, name_b): every full name or short form a with the full names b it can mean.

    named has one row per distinct name of a site. All words of the shorter of two names that fit, initials apart, are
    near a word of the longer one, so looking up the rarest word and filtering by the second rarest finds them all; in a
    longer name with k initials those may stand for k of the words, so the k + 1 rarest are looked up. Of two full names
    of one length the one of smaller id is a. Glued words are found by their letters, all or all but one.
    Names of different numbers never meet. Pairs may come twice.
    """
    parts = busy_parts(named.sparkSession)
    held = named.where("kind <> 'none'").select("site", "blocks", "numbers", "name_id", "name", "n", "kind", F.explode("words").alias("w"))
    vocabulary = held.groupBy("site", "w").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks"))
    vocabulary = vocabulary.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    vocabulary = vocabulary.select("site", "block", "w", "n", (F.pmod(F.xxhash64("w"), "blocks") == F.col("block")).alias("own"))
    near = stream_groups(vocabulary, ["site", "block"], _vocabulary, "site string, w string, near array<string>, weight bigint", parts=parts)
    of_name = ["site", "blocks", "numbers", "name_id", "name", "n", "kind"]
    rarest = held.join(written(near), ["site", "w"]).groupBy(*of_name).agg(F.array_sort(F.collect_list(F.struct("weight", "w", "near"))).alias("p"))
    second = F.coalesce(F.try_element_at("p", F.lit(2)), F.element_at("p", 1))["near"]
    probe = rarest.select(*of_name, second.alias("second"), F.posexplode("p").alias("i", "_p")).select(*of_name, "second", "i", F.explode("_p.near").alias("x"))
    initials = F.col("n") - F.col("whole")
    full = named.where("kind = 'full'").select(
        "site", "numbers", F.col("name_id").alias("b"), F.col("name").alias("name_b"), F.col("n").alias("n_b"), initials.alias("initials"), "words", F.explode("words").alias("x"))
    met = probe.join(full, ["site", "numbers", "x"]).where("i <= initials")
    longer = (F.col("n") < F.col("n_b")) | (F.col("n") == F.col("n_b")) & (F.col("name_id") < F.col("b"))
    both = longer & ((F.col("initials") > 0) | F.arrays_overlap("words", "second"))
    met = met.where(F.when(F.col("kind") == "full", both).otherwise((F.col("i") == 0) & (F.col("name_id") != F.col("b"))))
    block = F.pmod(F.xxhash64("name_id"), "blocks").alias("block")
    met = met.select("site", "blocks", block, F.col("name_id").alias("a"), F.col("name").alias("name_a"), F.col("kind").alias("kind_a"), "b", "name_b")
    return met.unionByName(_glued_candidates(named))


def _glued_candidates(named: DataFrame) -> DataFrame:
    spread = F.concat(F.array("letters"), F.transform(F.sequence(F.lit(1), F.length("letters")), lambda i: F.concat(F.left("letters", i - 1), F.substring(F.col("letters"), i + 1, F.length("letters")))))
    keys = named.where("length(letters) >= 6").select("site", "numbers", "name_id", "n", F.length("letters").alias("l"), F.explode(F.array_distinct(spread)).alias("k"))
    keys = keys.select(F.xxhash64("site", "numbers", "k").alias("k"), "name_id", "n", "l")
    a = keys.where("n <= 2 and l >= 7").select("k", F.col("name_id").alias("a"), F.col("n").alias("n_a"))
    b = keys.where("n >= 2").select("k", F.col("name_id").alias("b"), F.col("n").alias("n_b"))
    met = a.join(b, "k").where("n_a < n_b and (n_a = 1 or n_b <= 3)").select("a", "b").distinct()
    block = F.pmod(F.xxhash64("name_id"), "blocks").alias("block")
    left = named.select("site", "blocks", block, F.col("name_id").alias("a"), F.col("name").alias("name_a"), F.col("kind").alias("kind_a"))
    right = named.where("kind = 'full'").select(F.col("site").alias("_site"), F.col("name_id").alias("b"), F.col("name").alias("name_b"))
    return met.join(left, "a").join(right, "b").where("site = _site").drop("_site").select("site", "blocks", "block", "a", "name_a", "kind_a", "b", "name_b")


def name_links(named: DataFrame) -> DataFrame:
    """(strong, a, b, cost, whole) of candidates that fit, strong ones as the edges of a forest."""
    placed = candidates(named).repartition(busy_parts(named.sparkSession), "site", "block").sortWithinPartitions("site", "block", "a", "b")
    return placed.mapInArrow(_verified, "strong boolean, a bigint, b bigint, cost double, whole boolean")


def names_of(names: DataFrame) -> DataFrame:
    """Distinct names (site, name, name_id) with their words; blocks: number of tasks that share a site."""
    sites = names.groupBy("site").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("blocks"))
    rows = names.join(sites, "site").select("site", "blocks", "name_id", "name")
    schema = "site string, blocks int, name_id bigint, name string, n int, whole int, kind string, key string, words array<string>, letters string, numbers string"
    return rows.mapInArrow(_named, schema)


def _people(key, rows):
    """Forms (name, phone, specialty) of one component to persons: form -> person, the smallest form id of it.

    Each phone is a person, whose main specialty is the one of two rows or more. Forms without phone that agree, in two
    rows or more, in a specialty that is nobody's main one are a person too, unless a person without main specialty is
    there to take them: single rows are often filed under a wrong specialty, several under one wrong one are not. Other
    forms without phone go to the person of their specialty, else to the one of the nearest name; where two are equally
    near they stay apart.
    """
    forms = [(r["form_id"], tokens(r["name"]), r["phone"], r["specialty"], r["n"]) for r in rows]
    names, fields, bare = defaultdict(list), defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for _, words, phone, specialty, n in forms:
        if phone:
            if words not in names[phone]:
                names[phone].append(words)
            fields[phone][specialty] += n
        elif specialty is not None:
            bare[specialty] += n
    main = {p: {s for s, n in f.items() if n >= 2 and s is not None} for p, f in fields.items()}
    for s in sorted((s for s, n in bare.items() if n >= 2), key=lambda s: (-bare[s], s)):
        if any(s in m for m in main.values()):
            continue
        free = [p for p, m in main.items() if not m]
        known = [p for p in free if fields[p].get(s)]
        if len(known) == 1 or len(free) == 1:
            main[(known or free)[0]].add(s)
        else:
            main[f"specialty {s}"] = {s}
            names[f"specialty {s}"] = [words for _, words, phone, f, _ in forms if not phone and f == s]
    member: dict[int, str] = {}
    for form, words, phone, specialty, _ in forms:
        if phone or len(main) <= 1:
            member[form] = phone or next(iter(main), "")
            continue
        scored = []
        for p in main:
            cost = min((c for c in (0.0 if w == words else same_name(w, words) for w in names[p]) if c is not None), default=3.0)
            mine = specialty is not None and (specialty in main[p] or not main[p] and fields[p].get(specialty))
            scored.append((cost - (1.5 if mine else 0), p))
        scored.sort()
        member[form] = scored[0][1] if scored[1][0] - scored[0][0] > 0.2 else f"?{words}{specialty}"
    low: dict[str, int] = {}
    for form, who in member.items():
        low[who] = min(low.get(who, form), form)
    for form, who in member.items():
        yield {"form_id": form, "person": low[who]}


def _people_forms(key, rows):
    """_people with the fields of the forms that are asked for afterwards."""
    of = {r["form_id"]: r for r in rows}
    for m in _people(key, rows):
        yield m | {k: of[m["form_id"]][k] for k in ("name_id", "phone", "specialty")}


def phone_key(phone: Column) -> Column:
    """A typed phone as ten digits, null if it has fewer than nine."""
    digits = F.regexp_replace(F.translate(phone, "٠١٢٣٤٥٦٧٨٩", "0123456789"), "[^0-9]", "")
    return F.when(F.length(digits) >= 9, F.concat(F.lit("0"), F.right(digits, F.lit(9))))


def same_person(df: DataFrame, id: str, site: str, name: str, phone: str, specialty: str) -> DataFrame:
    """(id, site, person) of each row whose name can be read; rows with equal person mean the same person or unit.

    person is the smallest id among forms (name, phone, specialty) of the person. Rows without name, or whose name has
    neither a letter nor a number besides titles, take no part; phone and specialty may be null. Equal names of one site
    are one person unless their phones differ; a phone typed with several unlike names of a site is a shared desk and
    says nothing. Names of different numbers (ward 3, ward 7) are different units. Forms are aggregated before anything
    is compared, so rows repeated under new ids cost one comparison; the work of a large site is shared by several tasks.
    An empty table gives no rows.
    """
    rows = df.select(
        F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(site).cast("string"), F.lit(NO_SITE)).alias("site"), F.trim(name).alias("name"), phone_key(F.col(phone)).alias("phone"),
        F.lower(F.trim(specialty)).alias("specialty"),
    ).where("name <> ''")
    forms = rows.groupBy("site", "name", "phone", "specialty").agg(F.min("id").alias("form_id"), F.count("*").alias("n"))
    of_name = Window.partitionBy("site", "name").orderBy("form_id", "phone", "specialty")
    forms = written(forms.withColumns({"name_id": F.first("form_id").over(of_name), "rank": F.row_number().over(of_name)}))
    words = written(names_of(forms.where("rank = 1")))
    forms = forms.drop("rank")
    found = written(name_links(words))
    trees = joined(found.where("strong").select("a", "b", "whole")).withColumnRenamed("node", "name_id")
    known = words.select("name_id", "kind", "key").join(trees, "name_id", "left").withColumn("component", F.coalesce("component", F.when(F.col("kind") == "full", F.col("name_id"))))
    named = written(forms.join(known, "name_id"))
    # a phone of several unlike full names is a desk; of two alike ones, a link the words' distance missed
    full = named.where("kind = 'full'")
    shared = full.where("phone is not null").groupBy("site", "phone").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.min_by("key", F.struct("component", F.length("key"), "key")).alias("ka"),
        F.max_by("key", F.struct("component", -F.length("key"), "key")).alias("kb"),
        F.countDistinct("component").alias("people"),
    ).where("people > 1")
    alike = (F.col("people") == 2) & (F.levenshtein("ka", "kb") <= 0.4 * F.greatest(F.length("ka"), F.length("kb")))
    shared = written(shared.withColumn("alike", alike))
    bridges = components_within(shared.where("alike").select("site", "a", "b"), "site").select(F.col("node").alias("component"), F.col("component").alias("_top"))
    desks = shared.where("not alike").select("site", "phone", F.lit(True).alias("_desk"))
    clean = named.join(desks, ["site", "phone"], "left").withColumn("phone", F.when(F.col("_desk").isNull(), F.col("phone"))).drop("_desk")
    clean = clean.join(bridges, "component", "left").withColumn("component", F.coalesce("_top", "component")).drop("_top")
    clean = written(clean)
    full = clean.where("kind = 'full'").select("component", "form_id", "name_id", "name", "phone", "specialty", "n")
    people = written(stream_groups(full, ["component"], _people_forms, "form_id bigint, person bigint, name_id bigint, phone string, specialty string"))
    # plans end where their results are read again: the driver holds each plan with all its stages
    short = written(_short_forms(clean.where("kind <> 'full'"), found.where("not strong").select("a", "b", "cost"), people))
    member = people.select("form_id", "person").unionByName(short)
    traits = [F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("phone", "specialty")]
    out = forms.join(member, "form_id").select("site", "name", *traits, "person")
    return rows.select("id", "site", "name", *traits).join(out, ["site", "name", "_phone", "_specialty"]).select("id", "site", "person")


def _short_forms(short: DataFrame, weak: DataFrame, people: DataFrame) -> DataFrame:
    """(form_id, person) of short forms: the one person they fit best, else a person of their own.

    An equal phone decides, another phone excludes, an equal specialty speaks for a person; a form that fits two
    persons equally well stays apart. Forms that stay apart and agree in words and phone, or without phone in
    specialty, are one person.
    """
    traits = people.groupBy("person").agg(F.max("phone").alias("_phone"), F.collect_set("specialty").alias("_fields"))
    fits_ = short.join(weak, F.col("name_id") == F.col("a")).select("form_id", "phone", "specialty", F.col("b").alias("_b"), "cost")
    by_name = people.select(F.col("name_id").alias("_b"), "person").distinct()
    scored = fits_.join(by_name, "_b").groupBy("form_id", "phone", "specialty", "person").agg(F.min("cost").alias("cost")).join(traits, "person")
    equal, other = F.col("phone") == F.col("_phone"), F.col("phone") != F.col("_phone")
    score = F.when(equal, 4.0).otherwise(0.0) + F.when(F.array_contains("_fields", F.col("specialty")), 1.5).otherwise(0.0) - F.col("cost")
    scored = scored.where(~F.coalesce(other, F.lit(False))).withColumn("score", score)
    best = scored.groupBy("form_id").agg(
        F.max(F.struct("score", (-F.col("person")).alias("p"))).alias("top"), F.slice(F.sort_array(F.collect_list("score"), False), 1, 2).alias("two"))
    clear = (F.size("two") < 2) | (F.element_at("two", 1) - F.try_element_at("two", F.lit(2)) > 0.15)
    chosen = best.where(clear & (F.col("top.score") >= -1.3)).select("form_id", (-F.col("top.p")).alias("person"))
    left = short.join(chosen, "form_id", "left_anti")
    mine = left.select("form_id", "site", "key", F.coalesce("phone", "specialty", F.lit("")).alias("_by"))
    own = mine.groupBy("site", "key", "_by").agg(F.min("form_id").alias("person"))
    return chosen.unionByName(mine.join(own, ["site", "key", "_by"]).select("form_id", "person"))


def person_pairs(members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of rows that mean the same person: every pair is a row of the result asked for.

    A person of more than PEOPLE rows is paired by several tasks. members are read three times and stored once.
    """
    members = written(members)
    large = members.groupBy("person").agg(F.ceil(F.count("*") / PEOPLE).cast("int").alias("tasks")).where("tasks > 1")
    shared = members.join(large, "person", "left").withColumn("tasks", F.coalesce("tasks", F.lit(1)))
    a = shared.select(F.col("id").alias("id_a"), "person", F.pmod(F.xxhash64("id"), "tasks").cast("int").alias("task"))
    b = shared.select(F.col("id").alias("id_b"), "person", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
    return a.join(b, ["person", "task"]).where("id_a < id_b").select("id_a", "id_b")

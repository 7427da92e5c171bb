"""Subject areas of documents by subject-specific language models.

One interpolated trigram model per subject, one for sentences on no subject, and a background model over all documents.
The models are fitted to the sentences of labelled documents by expectation maximisation, as labels name subjects of
whole documents; the weights of their orders are fitted to held-out documents in the same way. A sentence speaks for the
models whose cross-entropy per token is below the background's, in proportion to how far; a document is accepted for
each subject whose share of its sentences reaches a threshold calibrated on held-out folds.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchbill.sources.tables import written

MAX_LABELLED = 3_000  # labelled documents that the models are fitted to; statistics of the background use all documents
NONE = "none"
WEIGHTS = (0.10, 0.30, 0.55, 0.05)  # trigram, bigram, unigram, background: where the fit to held-out documents starts
TRUST = 10.0  # occurrences of a context at which it counts as much as the lower order
ROUNDS = 12
FOLDS = 3
MENTION = 0.05  # odds of a subject that is not among a document's labels
BACKGROUND = 1e-6  # odds, while models are fitted, of a sentence that the background explains best
FIRST_NONE = 0.001  # weight at which sentences of labelled documents start as being on no subject
SHRINK = 2.0  # tokens of no evidence added to each sentence, so that few tokens say little
MARGIN = 2.0  # nats per token by which the background may beat a model that still holds a sentence: it knows common subjects too
SHARPNESS = (4.0, 8.0, 16.0, 32.0)  # how a difference of cross-entropies weighs: tried on held-out folds
CHUNK = 40_000  # tokens scored at a time
LONGEST = 500  # words of a sentence

_END = re.compile(r"(?<=[.!?؟])(?<!\bDr\.)(?<!\bDR\.)(?<!\bdr\.)(?<!\bno\.)(?<!\bProf\.)(?<!\bext\.)(?<!د\.)[\"')\]]*\s+")
_TAG = re.compile(r"<[^<>]{1,200}>")
_NUMBER = re.compile(r"\d+")
_STOP = "\x01"  # put where a sentence ends
_WORD = re.compile(rf"[^\W\d_]+|0|{_STOP}")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, numbers as 0, and a mark where a sentence ends; a heading without a full stop
    goes with what follows."""
    text = unicodedata.normalize("NFKC", _TAG.sub(" ", text)).replace("-\n", " ")
    return _WORD.findall(_NUMBER.sub("0", _END.sub(f" {_STOP} ", text)).lower())


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence; a run of more than LONGEST words without an end counts as several sentences."""
    out, at = [], []
    for w in [*words_of(text), _STOP]:
        if w != _STOP:
            at.append(w)
        elif at:
            out += [at[i : i + LONGEST] for i in range(0, len(at), LONGEST)]
            at = []
    return out


class _Numbers(dict):
    """Numbers of words, `unknown` for any other."""

    def __missing__(self, word):
        return self.unknown


class Models:
    """Counts per class of known words, bigrams and trigrams, and the background's."""

    def __init__(self, classes: list[str]):
        self.classes = classes
        self.words: dict[str, int] = {}
        self.known: list[np.ndarray] = []  # sorted codes of the bigrams and of the trigrams
        self.orders = np.array(WEIGHTS)
        self.counts: list[np.ndarray] = []
        self.background: tuple[np.ndarray, ...] = ()

    def index(self, docs: list[list[list[str]]], least: int = 2) -> None:
        """Number the n-grams of docs; bigrams and trigrams seen fewer than `least` times are left to lower orders."""
        seen = Counter(w for doc in docs for s in doc for w in s)
        self.words = {w: i for i, w in enumerate(sorted(seen))}
        once = sum(n == 1 for n in seen.values())
        # of a word that no labelled document has: as probable as all words together that one occurrence was seen of
        self.unseen = max(once, 1) / max(seen.total() + 1, 2)
        ids, starts = self.numbers([s for d in docs for s in d])
        self.known = []
        for k in range(2):
            code, there = self._codes(ids, starts)[k]
            found, n = np.unique(code[there], return_counts=True)
            self.known.append(found[n >= least])

    def numbers(self, doc_sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, that of unknown ones beyond all others; start of each sentence)."""
        get, unknown = self.words.get, len(self.words) + 1
        lengths = np.fromiter(map(len, doc_sentences), np.int64, len(doc_sentences))
        ids = np.fromiter((get(w, unknown) for s in doc_sentences for w in s), np.int32, int(lengths.sum()))
        return ids, np.cumsum(lengths) - lengths

    def numbered(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """numbers(sentences(text)), without a list per sentence."""
        known = vars(self).get("_known")
        if known is None:
            known = self._known = _Numbers(self.words)
            known.unknown = len(self.words) + 1
            known[_STOP] = -1
        ids = np.array(list(map(known.__getitem__, words_of(text))), np.int32)
        word = ids >= 0
        sentence = np.cumsum(~word)[word]
        ids = ids[word]
        if not len(ids):
            return ids, np.zeros(0, np.int64)
        first = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
        place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        return ids, np.flatnonzero(place % LONGEST == 0)

    def _codes(self, ids: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(code, whether there is one) of the bigram and of the trigram that ends at each word."""
        size = len(self.words) + 2
        before = np.roll(ids, 1).astype(np.int64)
        before[starts] = len(self.words)
        out = [(before * size + ids, ids <= len(self.words))]
        if self.known:
            context = np.roll(self._find(0, *out[0]), 1)
            context[starts] = -1
            out.append((context * size + ids, (context >= 0) & (ids <= len(self.words))))
        return out if len(out) > 1 else [*out, out[0]]

    def _find(self, k: int, code: np.ndarray, there: np.ndarray) -> np.ndarray:
        known = self.known[k]
        at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
        return np.where(there & (known[at] == code), at, -1) if len(known) else np.full(len(code), -1)

    def occurrences(self, docs: Corpus) -> list[np.ndarray]:
        """How often each word, the start of a sentence (never) and any unknown word, and each known bigram occurs."""
        two = self._find(0, *self._codes(docs.ids, docs.starts)[0])
        return [np.bincount(docs.ids, minlength=len(self.words) + 2), np.bincount(two[two >= 0], minlength=len(self.known[0]))]

    def set_background(self, words: np.ndarray, bigrams: np.ndarray) -> None:
        two = bigrams.astype(float)[:, None]
        self.background = np.delete(words, len(self.words)).astype(float), two, self._by_context(0, two)

    def encode(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Token rows: word, bigram, trigram, context bigram, context word; -1 if unknown."""
        (two, has2), (three, has3) = self._codes(ids, starts)
        b = self._find(0, two, has2)
        t = self._find(1, three, has3)
        before = np.roll(ids, 1)
        before[starts] = len(self.words)
        context = np.roll(b, 1)
        context[starts] = -1
        return np.stack([np.where(ids < len(self.words), ids, -1), b, t, context, np.where(before <= len(self.words), before, -1)], 1).astype(np.int32)

    def fit(self, tokens: np.ndarray, weight: np.ndarray) -> None:
        """Counts from tokens weighted per class."""
        self.counts = []
        for k, size in enumerate((len(self.words) + 1, *map(len, self.known))):
            known = tokens[:, k] >= 0
            at = tokens[known, k]
            self.counts.append(np.stack([np.bincount(at, weight[known, c], size) for c in range(weight.shape[1])], 1).astype(np.float32))
        self.totals = (np.maximum(self.counts[0].sum(0, dtype=np.float64), 1e-3) / (1 - self.unseen)).astype(np.float32)
        self.contexts = [self._by_context(k, self.counts[k + 1]) for k in range(2)]

    def _by_context(self, k: int, counts: np.ndarray) -> np.ndarray:
        """Counts of the known n-grams summed by what comes before their last word."""
        size = len(self.words) + 1 if k == 0 else len(self.known[0])
        at = self.known[k] // (len(self.words) + 2)
        return np.stack([np.bincount(at, c, size) for c in counts.T], 1).astype(counts.dtype)

    def parts(self, tokens: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(P of each token under each class by trigram, bigram, unigram and background; P under the background alone)."""
        c1, c2, c3 = self.counts

        def pick(table, ids):
            return np.where((ids >= 0)[:, None], table[np.maximum(ids, 0)], table.dtype.type(0)) if len(table) else np.zeros((len(ids), table.shape[1]), table.dtype)

        w, two, three, ctx2, ctx1 = tokens.T
        p1 = np.where((w >= 0)[:, None], pick(c1, w) / self.totals, np.float32(self.unseen))
        # contexts that a class has seldom seen lean on the lower order
        p2 = (pick(c2, two) + TRUST * p1) / (pick(self.contexts[0], ctx1) + TRUST)
        p3 = (pick(c3, three) + TRUST * p2) / (pick(self.contexts[1], ctx2) + TRUST)
        b1, b2, by_word = self.background
        q1 = (b1[np.where(w >= 0, w, len(b1) - 1)] + 1 / len(b1)) / (b1.sum() + 1)
        q2 = (pick(b2, two)[:, 0] + TRUST * q1) / (pick(by_word, ctx1)[:, 0] + TRUST)
        l3, l2, l1, l0 = self.orders
        return [p3, p2, p1, np.broadcast_to(q1.astype(np.float32)[:, None], p1.shape)], (l3 + l2) * q2 + (l1 + l0) * q1

    def gains(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each sentence the bits, in nats, by which each class codes it shorter than the background."""
        out = []
        bounds = np.append(starts, len(tokens))
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, side="right")) - 1)
            parts, back = self.parts(tokens[bounds[i] : bounds[j]])
            mixed = self._mixed(parts)
            out.append(np.add.reduceat(np.log(mixed) - np.log(back).astype(np.float32)[:, None], starts[i:j] - starts[i], axis=0))
            i = j
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)))

    def _mixed(self, parts: list[np.ndarray]) -> np.ndarray:
        out = parts[0] * float(self.orders[0])
        for weight, p in zip(self.orders[1:].tolist(), parts[1:]):
            out += weight * p
        return out

    def posterior(self, tokens: np.ndarray, starts: np.ndarray, prior: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """P(class) of each sentence, the background last; odds: of each class in the sentence's document."""
        gain = self.gains(tokens, starts)
        score = np.concatenate([gain.astype(np.float64), np.zeros((len(gain), 1))], 1) + np.log(prior) + np.log(odds)
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def fit_orders(self, tokens: np.ndarray, starts: np.ndarray, weight: np.ndarray, rounds: int = 8) -> None:
        """Weights of the orders by expectation maximisation over held-out tokens weighted per class."""
        total = np.zeros(4)
        bounds = np.append(starts, len(tokens))
        of_token = np.repeat(np.arange(len(starts)), np.diff(bounds))
        parts, _ = self.parts(tokens)
        for _ in range(rounds):
            of_word = weight[of_token] / self._mixed(parts)
            total = np.array([l * np.einsum("ij,ij->", of_word, p) for l, p in zip(self.orders.tolist(), parts)])
            self.orders = np.maximum(total / total.sum(), 1e-3)
            self.orders /= self.orders.sum()

    def shares(self, docs: Corpus, sharpness: float) -> np.ndarray:
        """Share of the sentences of each document that each class holds.

        A sentence's cross-entropies per token are compared with the background's, which MARGIN is added to: each model
        and the background weigh by e to the power of sharpness times the difference.
        """
        gain = self.gains(self.encode(docs.ids, docs.starts), docs.starts) / (docs.lengths() + SHRINK)[:, None]
        p = np.exp(sharpness * np.clip(gain + MARGIN, -8, 8))
        p /= 1 + p.sum(1, keepdims=True)
        total = np.stack([np.bincount(docs.who, p[:, c], docs.n) for c in range(len(self.classes))], 1)
        return total / np.maximum(np.bincount(docs.who, minlength=docs.n), 1)[:, None]


class Corpus:
    """Documents as numbers: the words, the start of each sentence, the document of each sentence, how many documents."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, who: np.ndarray, n: int):
        self.ids, self.starts, self.who, self.n = ids, starts, who, n

    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.ids)))

    def of(self, docs: np.ndarray) -> Corpus:
        """The documents where docs, a mask, is true."""
        keep, lengths = docs[self.who], self.lengths()
        left = lengths[keep]
        return Corpus(self.ids[np.repeat(keep, lengths)], np.cumsum(left) - left, (np.cumsum(docs) - 1)[self.who[keep]], int(docs.sum()))


def corpus(models: Models, docs: list[list[list[str]]]) -> Corpus:
    return Corpus(*models.numbers([s for d in docs for s in d]), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), len(docs))


def odds_of(labels: np.ndarray, none: int) -> np.ndarray:
    """Odds of each class, and the background, in each labelled document: subjects a document only mentions are not among
    its labels, yet their sentences are theirs and not of no subject."""
    odds = np.where(np.append(labels, np.zeros((len(labels), 1), bool), 1), 1.0, MENTION)
    odds[:, none] = 1.0
    return odds


def train(models: Models, docs: Corpus, labels: np.ndarray) -> Models:
    """Fit the classes of indexed models by expectation maximisation over the sentences of documents; labels: whether
    each document has each class, NONE the last."""
    m, none = models, models.classes.index(NONE)
    tokens = m.encode(docs.ids, docs.starts)
    first = labels.astype(float)
    mixed = first[:, :none].sum(1) > 0
    first[:, none] = np.where(mixed, FIRST_NONE, 1.0)
    weight = (first / first.sum(1, keepdims=True))[docs.who]
    lengths, odds = docs.lengths(), odds_of(labels, none)
    for _ in range(ROUNDS):
        m.fit(tokens, np.repeat(weight, lengths, axis=0))
        share = np.maximum(weight.sum(0), 1)
        new = m.posterior(tokens, docs.starts, np.append(share / share.sum(), BACKGROUND), odds[docs.who])[:, :-1]
        settled = np.abs(new - weight).sum() < 1e-3 * len(weight)
        weight = new
        if settled:
            break
    m.fit(tokens, np.repeat(weight, lengths, axis=0))
    return m


def held_out(fold: int, models: Models, docs: Corpus, labels: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(weights of the orders, shares by each sharpness) of the documents of a fold under models fitted to the others."""
    out = np.arange(docs.n) % FOLDS == fold
    m = train(models, docs.of(~out), labels[~out])
    mine = docs.of(out)
    tokens = m.encode(mine.ids, mine.starts)
    even = np.append(np.full(len(m.classes), 1 / len(m.classes)), BACKGROUND)
    weight = m.posterior(tokens, mine.starts, even, odds_of(labels[out], m.classes.index(NONE))[mine.who])[:, :-1]
    m.fit_orders(tokens, mine.starts, weight)
    return m.orders, [m.shares(mine, k) for k in SHARPNESS]


def calibrate(shares: list[np.ndarray], labels: np.ndarray, classes: list[str]) -> tuple[float, np.ndarray]:
    """(sharpness, threshold of each class on the share of sentences) of best F1 over held-out documents; thresholds are
    drawn towards the one best for all classes together where a class has few labels."""
    truth = labels
    grid = np.arange(0.08, 0.40, 0.005)
    subjects = [i for i, c in enumerate(classes) if c != NONE]

    def f1(held, cols):
        hits = np.array([((held[:, cols] >= t) & truth[:, cols]).sum() for t in grid])
        return 2 * hits / np.array([(held[:, cols] >= t).sum() + truth[:, cols].sum() for t in grid]).clip(1)

    whole = [f1(held, subjects) for held in shares]
    k = int(np.argmax([x.max() for x in whole]))
    out = []
    for c in range(len(classes)):
        n = truth[:, c].sum()
        score = (n * f1(shares[k], [c]) + 200 * whole[k]) / (n + 200)
        best = np.flatnonzero(score >= score.max() - 1e-9)
        out.append(grid[best[len(best) // 2]])
    return SHARPNESS[k], np.array(out)


def _numbered(held, id_: str):
    """(id, text) to (id, words, starts): the numbers of a text's words and where its sentences start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(held.value)
        for batch in batches:
            words, starts = [], []
            for text in batch.column("text").to_pylist():
                w, s = models.numbered(text)
                words.append(w)
                starts.append(s.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(id_), pa.array(words, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32()))], [id_, "words", "starts"])

    return run


def _models(state: dict) -> Models:
    m = Models([])  # plain values travel: workers need not know the class
    vars(m).update(state)
    return m


def _corpora(batch: pa.RecordBatch, most: int = 5 * CHUNK) -> Iterator[tuple[int, Corpus]]:
    """(first row, corpus) of runs of rows with about `most` words together."""
    words, starts = batch.column("words"), batch.column("starts")
    w_at, s_at = words.offsets.to_numpy(), starts.offsets.to_numpy()
    w_all, s_all = words.values.to_numpy(), starts.values.to_numpy()
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(w_at, w_at[i] + most, side="right")) - 1)
        n_s = np.diff(s_at[i : j + 1])
        first = np.repeat(w_at[i:j] - w_at[i], n_s)
        yield i, Corpus(w_all[w_at[i] : w_at[j]], s_all[s_at[i] : s_at[j]] + first, np.repeat(np.arange(j - i), n_s), j - i)
        i = j


def _counted(held):
    """Numbered texts to (k, i, n): how often word i (k = 0; the last: any unknown one) and bigram i (k = 1) occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(held.value)
        total = [np.zeros(len(models.words) + 2, np.int64), np.zeros(len(models.known[0]), np.int64)]
        for batch in batches:
            for _, part in _corpora(batch):
                for k, n in enumerate(models.occurrences(part)):
                    total[k] += n
        for k, n in enumerate(total):
            i = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k), pa.int32()), pa.array(i, pa.int64()), pa.array(n[i], pa.int64())], ["k", "i", "n"])

    return run


def _fitted(held):
    """Fold numbers to pickled results: held_out of each fold, the models of all documents for FOLDS itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, arrays, labels = held.value
        for batch in batches:
            for fold in batch.column("id").to_pylist():
                models, docs = _models(state), Corpus(*arrays)
                out = held_out(fold, models, docs, labels) if fold < FOLDS else vars(train(models, docs, labels))
                yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int64()), pa.array([pickle.dumps(out)], pa.binary())], ["fold", "result"])

    return run


def _accepted(held, id_: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, sharpness, limits = held.value
        models = _models(state)
        subjects = np.array([i for i, c in enumerate(models.classes) if c != NONE], int)
        for batch in batches:
            for first, part in _corpora(batch):
                share = models.shares(part, sharpness)[:, subjects]
                d, c = np.nonzero(share >= limits[subjects])
                names = np.array(models.classes, object)[subjects[c]]
                yield pa.RecordBatch.from_arrays([batch.column(id_).take(pa.array(first + d)), pa.array(names, pa.string()), pa.array(share[d, c])], [id_, "subject", "share"])

    return run


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, id: str = "doc_id", text: str = "text", sample: int = MAX_LABELLED) -> DataFrame:
    """(id, subject, share) for each subject that a document deals with; share is its part of the sentences.

    labels (id, subject) has one row per subject of a labelled document, `none` for no subject; labels of documents
    that are missing or empty, null labels and names that `subjects` lacks are left out. At most `sample` labelled
    documents, chosen by a hash of their ids, are fitted; the background counts all documents. Null and empty texts
    give no rows, repeated texts under new ids the same rows again. Without any usable label there are no rows. Very
    long texts are scored whole, in pieces of bounded memory. Texts are taken apart once and kept as numbers; models of
    the folds and of all labelled documents are fitted by tasks.
    """
    spark = documents.sparkSession
    names = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().collect())
    classes = [*names, NONE]
    rows = documents.select(id, F.col(text).alias("text")).where("text <> ''")
    marked = labels.where(F.col("subject").isin(classes)).groupBy(id).agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    chosen = marked.join(rows, id).orderBy(F.xxhash64(id), id).limit(sample).collect()
    docs, marks = [], []
    for r in chosen:
        if s := sentences(r["text"]):
            docs.append(s)
            marks.append([c in r["subjects"] for c in classes])
    if not docs:
        return rows.limit(0).select(id, F.lit("").alias("subject"), F.lit(0.0).alias("share"))
    models = Models(classes)
    models.index(docs)
    held = spark.sparkContext.broadcast(vars(models))
    kind = documents.select(id).schema[0].dataType.simpleString()
    numbered = written(rows.mapInArrow(_numbered(held, id), f"{id} {kind}, words array<int>, starts array<int>"))
    total = models.occurrences(corpus(models, docs[:0]))
    for r in numbered.select("words", "starts").mapInArrow(_counted(held), "k int, i bigint, n bigint").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():
        total[r["k"]][r["i"]] = r["n"]
    models.set_background(*total)
    sampled, truth = corpus(models, docs), np.array(marks)
    held = spark.sparkContext.broadcast((vars(models), (sampled.ids, sampled.starts, sampled.who, sampled.n), truth))
    folds = range(FOLDS + 1) if len(docs) >= 2 * FOLDS else [FOLDS]
    tasks = spark.range(folds[0], FOLDS + 1, 1, len(folds)).mapInArrow(_fitted(held), "fold bigint, result binary")
    fitted = {r["fold"]: pickle.loads(r["result"]) for r in tasks.collect()}
    models = _models(fitted[FOLDS])
    sharpness, limits = SHARPNESS[0], np.full(len(classes), 0.2)
    if len(folds) > 1:
        models.orders = np.mean([fitted[f][0] for f in range(FOLDS)], 0)
        shares = [np.zeros(truth.shape) for _ in SHARPNESS]
        for f in range(FOLDS):
            for all_, one in zip(shares, fitted[f][1]):
                all_[f::FOLDS] = one
        sharpness, limits = calibrate(shares, truth, classes)
    held = spark.sparkContext.broadcast((vars(models), sharpness, limits))
    return numbered.mapInArrow(_accepted(held, id), f"{id} {kind}, subject string, share double")

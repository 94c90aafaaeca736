"""Toxicity: a support vector machine on a subsequence string kernel, with Nystroem landmarks.

*Kernel.* Two words are alike by the subsequences of three letters they share, within ``SPAN`` letters,
each weighted by ``DECAY`` to the power of the stretch it spans in both words, so a gap or an inserted
character only lowers the value: ``i-d-i-o-t`` and ``idxiot`` are near ``idiot``. A word starts with a mark,
which anchors stems. Letters spelled out with spaces are read as one word as well.

*Landmarks.* The kernel to the landmarks, times the inverse root of the kernel among them, is a feature
vector whose inner products approximate the kernel; the machine is linear on it. Landmarks are added, the most frequent
words first, until every witness word has one with a kernel of ``COVER`` or more; clean words near a toxic landmark
are covered likewise. Their number follows the labelled sample, not a constant.

*Learning.* A sentence is a bag of words: every word of a clean one is clean, and a toxic one has a word that
makes it toxic, its witness. At first that is the word with the letter run most often seen in toxic and not
in clean texts. Clean words are ``CLEAN`` drawn by a hash, and in further rounds as many of those that look most toxic to
the machine so far. The fit reads a bounded sample: ``sample`` labelled texts a class, the first by a hash of their key.

*Scoring.* The machine is linear in a word's subsequences too, so its landmarks and weights become one table with a
number for each triple of letters: a word's value is the sum of its entries over its length in the kernel's space,
for any number of landmarks. A text is as toxic as its most toxic word; a logistic curve fitted to the sample's
texts turns that into a probability. Words are scored in batches in numpy, each distinct word of a stretch of texts
once. The length is only computed for words whose value might exceed ``floor``, the value with a chance of ``SETTLED``, by
the least length that a word of so many letters can have: the others cannot change the score, as no text scores less.

Defined results: a null or empty text, or one without words, has the score of no evidence, the least there is.
Without labelled texts of both classes every score is 0. Null keys are never learned from; repeated rows are scored
alike; null labels are left out. Very long texts and words are read whole. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common
from leadloom.llm.common import cut, drop_cut

SPAN = 7          # letters that a subsequence of three may spread over
DECAY = 0.6
COVER = 0.7       # kernel to a landmark from which on a word needs none of its own
NEAR = 0.4        # kernel to a toxic landmark from which on a clean word may need one
CLEAN = 2000      # clean words drawn for the fit, and as many again that look most toxic
SETTLED = 0.05    # least score of a text; words that cannot reach more are not looked at further
WIDTH = 24        # letters of a piece of a word; longer words are read in pieces that overlap by half
RUN = 5           # letters of the runs that point to first witnesses, with the start mark
BLOCK = 256       # words whose kernel is computed at a time
STEP = 64         # words that landmarks are chosen from at a time
HELD = 300_000    # words whose scores a task remembers
MARK = "^"
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_][^\w\s]?\s){2,}[^\W_](?![^\W_])")
_PUNCTUATION = string.punctuation + "«»“”„’‘…–—¡¿"


# ------------------------------------------------------------------ words
def words_of(text: str) -> set[str]:
    """Distinct words of a text: lower case, without outer punctuation; spelled-out words too."""
    low = text.lower()
    found = set(low.split())
    if spelled := _SPELLED.findall(low):
        found.update("".join(ch for ch in x if ch.isalnum()) for x in spelled)
    return found


def _pieces(word: str) -> list[str]:
    """A word as it is scored: with the mark, in pieces if it is long, and without characters between its letters."""
    word = word.strip(_PUNCTUATION)
    out = []
    for form in (word,) if word.isalnum() else (word, "".join(ch for ch in word if ch.isalnum())):
        if len(form) < WIDTH:
            out.append(MARK + form)
        else:
            step = WIDTH // 2
            out += [(MARK if not i else "") + form[i:i + WIDTH - 1] for i in range(0, len(form) - step + 1, step)]
    return out


def _letters(pieces: list[str]) -> np.ndarray:
    """Letters in 64 classes (a to z, the mark, others by remainder), one row a piece, 0 after its end."""
    if not pieces:
        return np.zeros((0, WIDTH), np.int32)
    codes = np.array(pieces, f"U{WIDTH}").view(np.uint32).reshape(len(pieces), WIDTH).astype(np.int32)
    return _CLASS[np.minimum(codes, len(_CLASS) - 1)] if codes.max() < len(_CLASS) else np.where(codes < len(_CLASS), _CLASS[np.minimum(codes, len(_CLASS) - 1)], 28 + codes % 36)


_CLASS = np.array([0] + [28 + c % 36 for c in range(1, 1 << 12)], np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[ord(MARK)] = 27


# ------------------------------------------------------------------ kernel
def _triples(letters: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each way to pick three letters within ``SPAN``: the triple of every word (0 in its last place: none) and its weight."""
    columns = np.ascontiguousarray(letters.T)
    width = int((letters > 0).any(axis=0).sum())
    for one in range(1, SPAN - 1):
        for two in range(1, SPAN - one):
            weight = DECAY ** (one + two + 1)
            for i in range(width - one - two):
                yield (columns[i] << 12) | (columns[i + one] << 6) | columns[i + one + two], weight


def _features(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, triples and weights of all three-letter subsequences, sorted and added up."""
    cells, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    rows = np.arange(len(letters), dtype=np.int64) << 18
    for triple, weight in _triples(letters):
        real = (triple & 63) > 0
        cells.append((rows | triple)[real])
        weights.append(np.full(len(cells[-1]), weight))
    cells, at = np.unique(np.concatenate(cells), return_inverse=True)
    return cells >> 18, cells & ((1 << 18) - 1), np.bincount(at, np.concatenate(weights), len(cells))


class Landmarks:
    """Words that others are compared with: their subsequences by triple."""

    def __init__(self, letters: np.ndarray):
        words, triples, weights = _features(letters)
        self.triples, at = np.unique(triples, return_inverse=True)
        self.table = np.zeros((len(self.triples) + 1, len(letters)))  # the last row: a triple of no landmark
        self.table[at, words] = weights
        self.own = (self.table ** 2).sum(axis=0)
        self.place = np.full(1 << 18, len(self.triples), np.int32)
        self.place[self.triples] = np.arange(len(self.triples))

    def kernel(self, letters: np.ndarray, features: tuple | None = None) -> np.ndarray:
        """Kernel of every word (rows) with every landmark (columns), 1 for equal words. ``features``: of the words, if known."""
        words, triples, weights = _features(letters) if features is None else features
        own = np.bincount(words, weights ** 2, len(letters))
        out = np.zeros((len(letters), len(self.own)))
        hit = self.place[triples] < len(self.triples)
        words, at, weights = words[hit], self.place[triples[hit]], weights[hit]
        cuts = np.searchsorted(words, np.arange(0, len(letters) + BLOCK, BLOCK))
        for a, b in zip(cuts[:-1], cuts[1:]):  # a block of words at a time, for memory
            if b > a:
                first = np.flatnonzero(np.concatenate(([True], words[a + 1:b] != words[a:b - 1])))
                out[words[a:b][first]] = np.add.reduceat(self.table[at[a:b]] * weights[a:b, None], first, axis=0)
        return out / np.sqrt(np.maximum(own[:, None] * self.own[None, :], 1e-30))


def cover(letters: np.ndarray, counts: np.ndarray, features: tuple, near: np.ndarray | None = None) -> tuple[list[int], np.ndarray]:
    """Words that every other one (of those ``near``) has a kernel of ``COVER`` or more with, the most frequent first, and
    the kernel of all words with them."""
    order = np.argsort(-counts, kind="stable")
    order = order if near is None else order[near[order]]
    covered, chosen, columns = np.zeros(len(letters)), [], [np.zeros((len(letters), 0))]
    for at in range(0, len(order), STEP):
        open_ = order[at:at + STEP]
        open_ = open_[covered[open_] < COVER]
        if not len(open_):
            continue
        among, best, new = Landmarks(letters[open_]).kernel(letters[open_]), np.zeros(len(open_)), []
        for i in range(len(open_)):
            if best[i] < COVER:
                new.append(int(open_[i]))
                best = np.maximum(best, among[:, i])
        kernel = Landmarks(letters[new]).kernel(letters, features)
        chosen += new
        columns.append(kernel)
        covered = np.maximum(covered, kernel.max(axis=1))
        covered[new] = 1.0  # words too short for a subsequence have no kernel even with themselves
    return chosen, np.concatenate(columns, axis=1)


# ------------------------------------------------------------------ model
class Model:
    """A number for each triple of letters: scores words, and texts by their most toxic word."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, offset: float):
        self.names, self.weights, self.offset = landmarks, weights, offset
        self.floor, self.curve = offset, (4.0, 0.0)
        words, triples, values = _features(_letters(landmarks))
        own = np.sqrt(np.maximum(np.bincount(words, values ** 2, len(landmarks)), 1e-30))
        self.table = np.bincount(triples, values * (weights / own)[words], 1 << 18)
        self.least = np.ones(WIDTH + 1)  # of a number of letters: the least length, squared, of a word in the kernel's space
        for n in range(3, WIDTH + 1):
            self.least[n] = sum(w * w for _, w in _triples(np.ones((1, n), np.int32)))

    def settle(self) -> None:
        """The floor, once the curve is known."""
        a, b = self.curve
        self.floor = max(self.offset, (np.log(SETTLED / (1 - SETTLED)) - b) / a)

    def values(self, letters: np.ndarray, floor: float) -> np.ndarray:
        """Signed distance from the margin's middle, exact where it exceeds ``floor``, else ``floor`` or a bound below it."""
        sums = np.zeros(len(letters))
        for triple, weight in _triples(letters):
            sums += weight * self.table[triple]
        out = self.offset + sums / np.sqrt(self.least[(letters > 0).sum(axis=1)])
        exact = np.flatnonzero((out > floor) & (sums > 0) | (floor == -np.inf))
        for at in range(0, len(exact), 4096):
            part = exact[at:at + 4096]
            words, _, weights = _features(letters[part])
            own = np.bincount(words, weights ** 2, len(part))
            out[part] = self.offset + sums[part] / np.sqrt(np.maximum(own, 1e-30))
        return out if floor == -np.inf else np.maximum(out, floor)

    def words(self, words: list[str], floor: float | None = None) -> np.ndarray:
        """Value by word, no less than ``floor`` (the model's own by default)."""
        floor = self.floor if floor is None else floor
        pieces, owner = [], []
        for i, w in enumerate(words):
            for piece in _pieces(w):
                pieces.append(piece)
                owner.append(i)
        letters = _letters(pieces)
        order = np.argsort((letters > 0).sum(axis=1), kind="stable")   # words of one length together: no places for nothing
        value = np.empty(len(pieces))
        for at in range(0, len(pieces), 16_384):
            part = order[at:at + 16_384]
            value[part] = self.values(letters[part], floor)
        out = np.full(len(words), floor)
        np.maximum.at(out, np.array(owner, int), value)
        return out

    def chance(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * value + self.curve[1], -30, 30)))


def texts_values(model: Model, texts: list[str | None], held: dict[str, float]) -> np.ndarray:
    """Value of the most toxic word of each text; ``held``: scores of words met before."""
    bags = [words_of(t) if t else set() for t in texts]
    fresh = [w for w in set().union(*bags) if w not in held] if bags else []
    if len(held) + len(fresh) > HELD:
        held.clear()
        fresh = list(set().union(*bags))
    held.update(zip(fresh, model.words(fresh).tolist()))
    get = held.__getitem__
    return np.array([max(map(get, bag), default=model.floor) for bag in bags])


# ------------------------------------------------------------------ learning
def _fit_machine(features: np.ndarray, signs: np.ndarray, costs: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps over the words inside the margin."""
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    costs = costs / costs.sum()
    for _ in range(30):
        inside = signs * (x @ w) < 1
        part = x[inside]
        new = np.linalg.solve(ridge + (part * costs[inside][:, None]).T @ part, (part * (costs * signs)[inside][:, None]).sum(axis=0))
        if np.abs(new - w).max() < 1e-9:
            break
        w = 0.5 * (w + new) if _ > 15 else new
    return w[:-1], float(w[-1])


def fit(toxic: dict[str, int], clean: dict[str, int]) -> Model:
    """Machine from witness words and clean words with their counts."""
    sides = [(sorted(d), d) for d in (toxic, clean)]
    pieces = [[_pieces(w)[0] for w in names] for names, _ in sides]
    letters = _letters(pieces[0] + pieces[1])
    counts = [np.array([d[w] for w in names], float) for names, d in sides]
    features, bad = _features(letters), np.arange(len(letters)) < len(pieces[0])
    every = np.concatenate(counts)
    marks, kernel = cover(letters, every, features, bad)
    more, further = cover(letters, every, features, ~bad & (kernel.max(axis=1, initial=0) >= NEAR))
    marks, kernel = marks + more, np.concatenate([kernel, further], axis=1)
    among = kernel[marks]
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    keep = values > 1e-4
    root = vectors[:, keep] / np.sqrt(values[keep])
    weight = np.concatenate([np.sqrt(n) / np.sqrt(n).sum() for n in counts])
    # the margin is as dear as a tenth of the rarest witness: however many there are, each of them can be learned
    penalty = min(1e-3, 0.05 * float(weight[bad].min()))
    w, offset = _fit_machine(kernel @ root, np.where(bad, 1.0, -1.0), weight, penalty)
    names = pieces[0] + pieces[1]
    return Model([names[i] for i in marks], root @ w, offset)


def _fit_curve(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the values, classes weighing the same."""
    if not 0 < labels.sum() < len(labels):
        return 4.0, 0.0
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    x = np.stack([values, np.ones(len(values))], axis=1)
    w = np.array([4.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), (x * (weight * (labels - p))[:, None]).sum(axis=0) - 1e-4 * (w - [4.0, 0.0]))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.5)), float(w[1])


def _runs(word: str) -> set[str]:
    """Letter runs of a word that may point to a witness; short words as a whole."""
    out = set()
    for piece in _pieces(word):
        if len(piece) >= 4:
            out.update(piece[i:i + RUN] for i in range(max(1, len(piece) - RUN + 1)))
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = 2000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Machine from ``docs`` and ``labels`` (``key``, ``label`` 0 or 1). None when a class has no text."""
    spark = docs.sparkSession
    rows = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("toxic")).where(F.col("_key").isNotNull())
    first = [rows.where(F.col("toxic") == k).orderBy(F.xxhash64(F.col("_key").cast("string"), F.lit(5)), "_key").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]).groupBy("_key").agg(F.max("toxic").alias("toxic")))  # 2 * sample rows at most
    texts = cut(docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(chosen, "_key").select("text", "toxic"))
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        drop_cut(texts)
        return None

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            out = [(run, t) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for run in set().union(*map(_runs, words_of(x)))]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.string()), pa.array([t for _, t in out], pa.int32())], ["run", "toxic"])

    seen = texts.mapInArrow(runs, "run string, toxic int").groupBy("run").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    least = 2 + sizes[1] // 2000
    pointing = seen.where((F.col("bad") >= least) & (F.col("good") * sizes[1] * 20 <= F.col("bad") * sizes[0]))
    points = {r["run"]: r["bad"] / (1 + 20 * r["good"]) for r in pointing.collect()}  # runs of at most ``sample`` texts

    def witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            out = []
            for x in batch.column(0).to_pylist():
                scored = [(max((points.get(r, 0.0) for r in _runs(w)), default=0.0), w.strip(_PUNCTUATION)) for w in words_of(x)]
                best = max(scored, default=(0.0, ""))[0]
                out += [w for s, w in scored if s > 0 and s >= 0.99 * best]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["word"])

    def most(words: DataFrame) -> dict[str, int]:
        return {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # witnesses of at most ``sample`` texts

    toxic = most(texts.where("toxic = 1").select("text").mapInArrow(witnesses, "word string"))
    clean = texts.where("toxic = 0").select("text")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([w for x in batch.column(0).to_pylist() for w in {w.strip(_PUNCTUATION) for w in words_of(x)}], pa.string())], ["word"])

    clean_words = cut(clean.mapInArrow(plain, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    drawn = {r["word"]: r["n"] for r in clean_words.orderBy(F.xxhash64("word"), "word").limit(CLEAN).collect()}
    toxic = {w: n for w, n in toxic.items() if w and w not in drawn}
    if not toxic or not drawn:
        drop_cut(texts, clean_words)
        return None
    model = fit(toxic, drawn)
    for _ in range(2):
        sent = common.send(spark, model)

        def hard(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column(0).to_pylist()
                for at in range(0, len(words), 20_000):
                    part = words[at:at + 20_000]
                    value = sent.value.words(part, -np.inf)
                    up = np.flatnonzero(value > -1)
                    yield pa.RecordBatch.from_arrays([pa.array([part[i] for i in up], pa.string()), batch.column(1).slice(at, len(part)).take(pa.array(up)), pa.array(value[up])], ["word", "n", "value"])

        worst = clean_words.select("word", "n").mapInArrow(hard, "word string, n long, value double").orderBy(F.col("value").desc(), "word").limit(CLEAN).collect()
        drawn |= {r["word"]: r["n"] for r in worst}
        toxic = {w: n for w, n in toxic.items() if w not in drawn or n > 20 * drawn[w]}
        model = fit(toxic, {w: n for w, n in drawn.items() if w not in toxic})
    sent = common.send(spark, model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, float] = {}
        for batch in common.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(texts_values(sent.value, batch.column(0).to_pylist(), held)), batch.column(1)], ["value", "toxic"])

    table = texts.mapInArrow(judged, "value double, toxic int").toPandas()  # 2 * sample rows at most
    model.curve = _fit_curve(table["value"].to_numpy(float), table["toxic"].to_numpy(float))
    model.settle()
    drop_cut(texts, clean_words)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``score`` (0 to 1) beside the columns ``keep`` (default ``doc_id``) of every row."""
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*dict.fromkeys([*keep, text]))
    if model is None:
        return rows.select(*keep, F.lit(0.0).alias("score"))
    sent = common.send(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, float] = {}
        for batch in common.chunks(batches, text):
            values = texts_values(sent.value, batch.column(batch.schema.get_field_index(text)).to_pylist(), held)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(sent.value.chance(values))], [*keep, "score"])

    return rows.mapInArrow(run, ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["score double"]))

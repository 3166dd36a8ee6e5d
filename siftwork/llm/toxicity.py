"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other texts, labelled or not, are unlabelled: a
mixture that holds toxic ones too. With the class prior p the risk of a classifier is

    p * R(positives as toxic) + max(0, R(unlabelled as clean) - p * R(positives as clean))

and where the second part falls below zero, a step goes the other way, so that the classifier
cannot drive the risk down by learning the positives by heart. The classifier is linear, in numpy,
over which words and word beginnings a text has (some
insults are inflected), and how many words share a beginning; p comes from the labels of the fitting folds.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.labelled import all_fitting_labels, held_out
from siftwork.llm.shared import stored
from siftwork.llm.worker import slices, texts

POSITIVES = 4_000  # confirmed toxic documents in the fit, at most
UNLABELLED = 12_000  # other documents that the gradient is taken on, at most; features are counted over all
FEATURES = 4_000  # words and beginnings that the classifier weighs, at most
LEAST = 3  # positives that have a feature, at least
STANDS_OUT = 4.0  # standard errors between a feature's shares
BEGINNINGS = (4, 5, 6, 7)
SEVERAL = (2, 3, 5)  # words with one beginning that are a feature of their own
ROUNDS = 300
RATE = 0.05
DECAY = 1e-4
THRESHOLD = 0.5
HELD = 800_000  # words and beginnings that a task keeps, about
CHARACTERS = 16  # of a kept word, on average

WORD = r"[^\W\d_]+"
# Of an ASCII text: letters in lower case, all else as white space.
LETTERS = bytes(ord(chr(c).lower()) if chr(c).isalpha() and c < 128 else 32 for c in range(256))


def beginnings(word: str) -> list[str]:
    """The beginnings of a word, told from words by a dash."""
    return [word[:n] + "-" for n in BEGINNINGS if len(word) > n]


def features(text: str, known: dict[str, list[str]] | None = None) -> set:
    """The words of a whole text, their beginnings, and of each beginning whether several words share it.

    ``known`` keeps the beginnings of words between calls."""
    found = set(re.findall(WORD, text.lower()))
    known = {} if known is None else known
    known.update((w, beginnings(w)) for w in found if w not in known)
    shared = Counter(chain.from_iterable(map(known.__getitem__, found)))
    found.update(shared)
    found.update(f"{b}{n}" for b, count in shared.items() if count > 1 for n in SEVERAL if count >= n)
    return found


class Lexicon:
    """Which words texts have, and how many words of each beginning; found in array operations over many texts.

    Words and beginnings are numbered when first met, and kept until ``full``."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words, self.beginnings = numbers(), numbers()
        # Of each word its longest beginning, of each beginning the next shorter one; -1: none.
        self.longest, self.shorter = array("q"), array("q")
        self.characters = 0

    def full(self) -> bool:
        return len(self.words) + len(self.beginnings) > HELD or self.characters > CHARACTERS * HELD

    def learn(self) -> None:
        """Numbers the beginnings of the words that have come since the last call."""
        number, least, most = self.beginnings, BEGINNINGS[0], BEGINNINGS[-1]
        for w in islice(self.words, len(self.longest), None):
            self.characters += len(w)
            self.longest.append(number[w[: min(len(w) - 1, most)]] if len(w) > least else -1)
        while len(self.shorter) < len(number):
            for b in list(islice(number, len(self.shorter), None)):
                self.shorter.append(number[b[:-1]] if len(b) > least else -1)

    def found(self, many: list[str], wanted: Callable[[], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """Each text's distinct words (places of text and word), and its beginnings (text, beginning, how many words).

        Of the beginnings only those that ``wanted``, called when all are numbered, is true for."""
        cut = [set(words_of(text)) for text in many]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        rows = np.repeat(np.arange(len(cut)), sizes)
        words = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), np.int64, len(rows))
        self.learn()
        count = max(1, len(self.beginnings))
        shorter = np.array(self.shorter, np.int64)
        right = None if wanted is None else wanted()
        owners, starts, keys = rows, np.array(self.longest, np.int64)[words], [np.zeros(0, np.int64)]
        while len(starts):
            owners, starts = owners[starts >= 0], starts[starts >= 0]
            keys.append((owners * count + starts)[... if right is None else right[starts]])
            starts = shorter[starts]
        pairs, shared = np.unique(np.concatenate(keys), return_counts=True)
        return rows, words, *np.divmod(pairs, count), shared


def words_of(text: str) -> list[str]:
    """All words of a text, in lower case."""
    # Of ASCII only letters make words; bytes are cut several times faster than by the expression.
    return text.encode().translate(LETTERS).decode().split() if text.isascii() else re.findall(WORD, text.lower())


def numbers() -> defaultdict[str, int]:
    """Numbers strings by when they are first asked for."""
    found: defaultdict[str, int] = defaultdict()
    found.default_factory = found.__len__
    return found


@dataclass
class Linear:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    lexicon: Lexicon = field(default_factory=Lexicon)
    of_word: array = field(default_factory=lambda: array("d"))
    of_start: list[array] = field(default_factory=lambda: [array("d") for _ in ("", *SEVERAL)])

    def score(self, text: str) -> float:
        return self.scores([text])[0]

    def learn(self) -> np.ndarray:
        """Looks up the weights of new words and beginnings; 0 where there is none."""
        weight = self.weights.get
        self.of_word.extend([weight(w, 0.0) for w in islice(self.lexicon.words, len(self.of_word), None)])
        for own, n in zip(self.of_start, ("", *SEVERAL)):
            own.extend([weight(f"{b}-{n}", 0.0) for b in islice(self.lexicon.beginnings, len(own), None)])
        return np.any(np.array(self.of_start) != 0, axis=0)

    def scores(self, many: list[str]) -> list[float]:
        """The probability that each text is toxic. Each feature counts once, wherever it stands."""
        if self.lexicon.full():
            self.lexicon.clear()
            del self.of_word[:]
            for own in self.of_start:
                del own[:]
        rows, words, owners, starts, shared = self.lexicon.found(many, self.learn)
        several = [np.where(shared >= n, np.array(own)[starts], 0.0) for own, n in zip(self.of_start, (1, *SEVERAL))]
        rows, values = np.concatenate([rows, *[owners] * len(several)]), np.concatenate([np.array(self.of_word)[words], *several])
        rows, values = rows[values != 0], values[values != 0]
        order = np.argsort(rows)
        ends = np.searchsorted(rows[order], np.arange(len(many) + 1)).tolist()
        values = values[order].tolist()
        # An exact sum: the order that features are found in doesn't matter.
        totals = [self.bias + math.fsum(values[a:b]) for a, b in zip(ends, ends[1:])]
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, total)))) for total in totals]


def fit(positive: list[list[int]], unlabelled: list[list[int]], chosen: list[str], prior: float) -> Linear:
    """A linear classifier by full-batch Adam on the non-negative risk; texts are lists of places in ``chosen``."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    n_p, n_u = len(positive), len(unlabelled)
    if not chosen or not n_p or not n_u:
        return Linear({}, math.log(prior / (1 - prior)))

    def matrix(rows: list[list[int]]):
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.repeat(np.arange(len(rows)), sizes), np.fromiter((c for r in rows for c in r), np.int64, int(sizes.sum()))

    data = [matrix(positive), matrix(unlabelled)]
    sizes = [n_p, n_u]
    w = np.zeros(len(chosen) + 1)  # the last is the bias
    w[-1] = math.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)

    def logits(k: int) -> np.ndarray:
        rows, columns = data[k]
        return np.bincount(rows, w[columns], sizes[k]) + w[-1]

    def gradient(k: int, slope: np.ndarray) -> np.ndarray:
        rows, columns = data[k]
        return np.append(np.bincount(columns, slope[rows], len(chosen)), slope.sum()) / sizes[k]

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, ROUNDS + 1):
        zp, zu = logits(0), logits(1)
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_clean = gradient(1, sigmoid(zu)) - prior * gradient(0, sigmoid(zp))
        if clean >= 0:
            g = as_clean - prior * gradient(0, sigmoid(-zp))
        else:
            g = -as_clean
        g[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Linear(dict(zip(chosen, w[:-1].tolist())), float(w[-1]))


def sampled(docs: DataFrame, known: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """``kind, features`` of the texts to fit on: confirmed toxic ones (1), and any that are not held out (0)."""
    ids = docs.select(F.col("doc_id").cast("long")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = ids.orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(unlabelled).distinct().select("doc_id", F.lit(0).alias("kind"))
    toxic = known.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id", F.lit(1).alias("kind"))
    # At most positives + unlabelled ids of eight bytes: small enough to send to every task.
    wanted = F.broadcast(drawn.union(toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("kind"), pa.array([sorted(features(x)) for x in texts(part)], pa.list_(pa.string()))], names=["kind", "features"])

    texts_of = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id").select("kind", "text")
    return stored(texts_of.mapInArrow(run, "kind int, features array<string>"), "toxicity-sample")


def summed(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Counts of the features so far, fewer maybe than ``new`` has, and of a new slice."""
    new[: len(old)] += old
    return new


def counted(docs: DataFrame) -> DataFrame:
    """``feature, u``: in how many of all documents that are not held out a feature is; the empty one is in every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon()
        n_texts, of_word, of_start = 0, np.zeros(0, np.int64), np.zeros((1 + len(SEVERAL), 0), np.int64)

        def rows() -> pa.RecordBatch:
            named = chain([""], own.words, *([f"{b}-{n}" for b in own.beginnings] for n in ("", *SEVERAL)))
            counts = np.concatenate([[n_texts], of_word, *of_start])
            met = counts > 0
            return pa.RecordBatch.from_arrays([pa.array(list(compress(named, met.tolist())), pa.string()), pa.array(counts[met], pa.int64())], names=["feature", "u"])

        for batch in batches:
            for part in slices(batch, "text"):
                _, words, _, starts, shared = own.found(texts(part))
                n_texts += part.num_rows
                of_word = summed(of_word, np.bincount(words, minlength=len(own.words)))
                of_start = np.stack([summed(old, np.bincount(starts[shared >= n], minlength=len(own.beginnings))) for old, n in zip(of_start, (1, *SEVERAL))])
                # Counts leave before they take more memory than a slice of the table.
                if own.full():
                    yield rows()
                    own.clear()
                    n_texts, of_word, of_start = 0, of_word[:0], of_start[:, :0]
        yield rows()

    may = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("text")
    return may.mapInArrow(run, "feature string, u long").groupBy("feature").agg(F.sum("u").alias("u"))


def telling(sample: DataFrame, totals: DataFrame, most: int = FEATURES) -> list[str]:
    """The features whose shares among sampled positives exceed those among all documents most, in standard errors."""
    positive = sample.where("kind = 1")
    n_p = max(1, positive.count())
    own = positive.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("p")).where(F.col("p") >= LEAST)
    # The empty feature comes along with the number of documents.
    met = stored(own.unionByName(own.sparkSession.createDataFrame([("", 0)], "feature string, p long")).join(totals, "feature"), "toxicity-counts")
    n_u = max(1, met.where("feature = ''").agg(F.coalesce(F.sum("u"), F.lit(0)).alias("n")).first()["n"])
    both = (F.col("p") + F.col("u")) / F.lit(n_p + n_u)
    error = F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * F.lit(1 / n_p + 1 / n_u))
    scored = met.where("feature <> ''").select("feature", ((F.col("p") / F.lit(n_p) - F.col("u") / F.lit(n_u)) / error).alias("z")).where(F.col("z") >= STANDS_OUT)
    return [r["feature"] for r in scored.orderBy(F.desc("z"), "feature").limit(most).collect()]


def fit_on(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Linear:
    """The classifier of bounded samples, drawn by a hash of the id.

    Unlabelled texts of the gradient are drawn from all documents that are not held out, whatever their labels
    say; which features tell is decided by their counts over all of those documents.
    To the driver come at most ``FEATURES`` features and, of each sampled text, which of them it has.
    """
    known = all_fitting_labels(labels, "toxic")
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    prior = counts["toxic"] / counts["n"] if counts["n"] else 0.5
    if not counts["toxic"]:
        return fit([], [], [], prior)
    sample = sampled(docs, known, positives, unlabelled)
    chosen = telling(sample, counted(docs))
    place = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[place[f] for f in x if f in place] for x in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(rows, pa.list_(pa.int32()))], names=["kind", "places"])

    found: tuple[list, list] = [], []
    for row in sample.mapInArrow(run, "kind int, places array<int>").sort("kind", "places").toLocalIterator():
        found[row["kind"]].append(list(row["places"]))
    return fit(found[1], found[0], chosen, prior)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    A null or empty text has no features and gets the score of the bias alone. A null ``doc_id`` is
    not held out; repeated rows are scored each; an empty table gives an empty one; without
    positives every score is the prior (0.5 without labels). Other columns are not read.
    """
    fitted = fit_on(docs, labels, positives, unlabelled)
    # Sent as plain values: workers need not be able to import this package.
    model = docs.sparkSession.sparkContext.broadcast((fitted.weights, fitted.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Linear(*model.value)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.scores(texts(part)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Document quality by regularised quadratic discriminant analysis of text statistics.

Each class (label 1 and 0) gets a mean and a covariance of the transformed statistics; the
covariance is drawn towards the pooled one and towards its own diagonal. A document's score is the
logistic of the difference of the two Gaussian log densities plus the log prior odds; the densities
take their Mahalanobis distances from Cholesky factors, which are computed once and sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.labelled import SAMPLE, fitting_labels, held_out
from siftwork.llm.shared import stored
from siftwork.llm.worker import slices, texts

TO_POOLED = 0.1  # share of the pooled covariance in each class's
TO_DIAGONAL = 0.1  # share of its own diagonal
TEMPERATURE = 0.25  # log density differences of correlated statistics are too sure of themselves
THRESHOLD = 0.3

NAMES = ["words", "word_length", "upper", "digits", "symbols", "stops", "bars", "bangs", "distinct", "echoes", "top_word", "lines", "marked_words", "caps_words"]

# Fixed byte classes.
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
SYMBOLS = b"#$%&*@^~_=+<>{}[]\\/`"


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, each transformed to be near to a normal distribution."""
    raw = text.encode()
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(seen[65:91].sum() + seen[97:123].sum() + seen[0xC0:].sum()))
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    symbols = int(seen[list(SYMBOLS)].sum())
    share = [
        int(seen[65:91].sum()) / letters,
        int(seen[48:58].sum()) / size,
        symbols / size,
        int(seen[46]) / n,
        int(seen[124]) / n,
        int(seen[33]) / n,
        len(kinds) / n,
        sum(map(eq, words, words[1:])) / n,
        max(kinds.values(), default=0) / n,
        int(seen[10]) / n,
        sum(w[-1] in SYMBOLS for w in kinds) / max(1, len(kinds)),
        sum(w.isupper() for w in kinds) / max(1, len(kinds)),
    ]
    return [np.log1p(len(words)), np.log(sum(map(len, words)) / n + 1), *np.sqrt(share).tolist()]


@dataclass
class Discriminant:
    """What scoring needs: scaling, and per class the mean, inverse Cholesky factor and log normaliser."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    norms: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -20, 20)
        density = [-0.5 * np.square((z - m) @ w.T).sum(axis=1) + c for m, w, c in zip(self.means, self.whiten, self.norms)]
        odds = np.clip(TEMPERATURE * (density[1] - density[0]) + self.prior, -30, 30)
        return 1 / (1 + np.exp(-odds))


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant | float:
    """A discriminant of statistics ``x`` and labels ``y``; the mean label where a class is missing."""
    if len(y) == 0:
        return 0.5
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return float(y.mean())
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - center) / scale, -20, 20)
    size = z.shape[1]
    means = np.array([z[y == k].mean(axis=0) for k in (0, 1)])
    own = [np.cov(z[y == k].T) for k in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(own))
    whiten, norms = [], []
    for c in own:
        c = (1 - TO_POOLED) * c + TO_POOLED * pooled
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(size)
        factor = np.linalg.cholesky(c)
        whiten.append(np.linalg.solve(factor, np.eye(size)))
        norms.append(-np.log(np.diag(factor)).sum())
    return Discriminant(center, scale, means, np.array(whiten), np.array(norms), float(np.log(y.mean() / (1 - y.mean()))))


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, stats`` of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = texts(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([bool(x.strip(" \t\n\r\x0b\x0c")) for x in found], pa.bool_()), pa.array([statistics(x) for x in found], pa.list_(pa.float64()))],
                    names=["doc_id", "worded", "stats"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, worded boolean, stats array<double>")


def fit_on(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant | float:
    """The discriminant of the labelled rows of ``stats``; ``sample`` bounds what comes to the driver."""
    rows = stats.join(fitting_labels(labels, "quality", sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    return fit(np.array(rows["stats"].tolist()).reshape(-1, len(NAMES)), rows["label"].to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    A text without words (null, empty, blank) scores 0. A null ``doc_id`` is not held out; repeated
    rows are scored each; an empty table gives an empty one; without labels every text with words
    scores 0.5, with labels of one class only their mean. Other columns are not read.
    """
    stats = stored(document_statistics(docs), "statistics")
    fitted = fit_on(stats, labels, sample)
    # Sent as plain arrays: workers need not be able to import this package.
    model = stats.sparkSession.sparkContext.broadcast(vars(fitted) if isinstance(fitted, Discriminant) else fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Discriminant(**model.value) if isinstance(model.value, dict) else model.value
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy().reshape(-1, len(NAMES))
            score = own.scores(x) if isinstance(own, Discriminant) else np.full(len(x), own)
            score = np.where(batch.column("worded").to_numpy(zero_copy_only=False), score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more; see ``quality_scores``. All columns stay."""
    # At most ``sample`` ids come out of the labels, so they may be sent to every task.
    own = F.broadcast(fitting_labels(labels, "quality", sample))
    learned = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(own.select("doc_id"), "doc_id", "left_semi")
    fitted = fit_on(document_statistics(learned), labels, sample)
    model = docs.sparkSession.sparkContext.broadcast(vars(fitted) if isinstance(fitted, Discriminant) else fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Discriminant(**model.value) if isinstance(model.value, dict) else model.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = texts(part)
                worded = np.array([bool(x.strip(" \t\n\r\x0b\x0c")) for x in found])
                x = np.array([statistics(x) for x in found])
                score = np.where(worded, own.scores(x) if isinstance(own, Discriminant) else own, 0.0)
                yield part.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)

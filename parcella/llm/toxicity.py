"""Toxicity by a chain of linear classifiers.

The categories stand in a fixed order; the last one is toxicity as labelled.
A category of words holds for a text that is labelled toxic and uses one of
its words. Each link is a logistic regression on word indicators and on the
probabilities of all earlier links. While training, a link sees probabilities
that models without the row have given (five folds), so it learns to trust earlier links as far as
they deserve; the final links are fitted on all labelled rows.

Which words are features is decided on all labelled rows: those whose share among toxic
texts differs most from the rest, in standard errors. So are the weights: every Newton step adds
up slopes and curvature over the rows where they are, for the final link and its folds at once,
and only these sums reach the driver.

Defined cases: an empty or null text has no features and gets each link's free
term. A category without examples of both kinds has its smoothed share
everywhere. Repeated labels of a document count once, the smallest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcella.llm.common import ALNUM, POWERS, Scratch, arrow_map, importable, lists, mix, release, row_groups, utf8
from parcella.llm.learn import corpus_counts, distinct_pairs, feature_rows, labelled, sigmoid

SIZE = 1 << 18
#: Labelled rows of a task at least, tasks at most (each sends 1 MB of sums a step), rows made dense at once.
TASK_ROWS, TASKS, DENSE = 2_000, 16, 4_096
#: Weight of the penalty; Newton steps end where no weight moves further than this, or after so many.
PENALTY, MOVED, STEPS = 1.0, 1e-3, 30
SELECTED = 512
#: Bytes of a word's beginning.
STEMS = (4, 5)
FOLDS = 5
THRESHOLD = 0.5

#: Words of the categories before the last.
CATEGORIES = {
    "insult": ["idiot", "moron", "loser", "clown", "fool", "imbecile", "stupid", "dumb"],
    "contempt": ["worthless", "pathetic", "disgusting", "trash", "scum", "garbage", "vermin", "filth"],
}
LAST = "toxic"


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) of the words and of the beginnings of longer ones, which endings do not change."""
    hashes, bounds, starts, ends = ALNUM.words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    rows, keys = [row], [hashes]
    for size in STEMS:
        longer = np.flatnonzero(ends - starts > size)
        stem = np.full(len(longer), size, np.uint64)
        for j in range(size):
            stem += ALNUM.values[data[starts[longer] + j]] * POWERS[j]
        rows.append(row[longer])
        keys.append(mix(stem))
    return distinct_pairs(np.concatenate(rows), (np.concatenate(keys) >> np.uint64(46)).astype(np.int64), SIZE)


def category_columns(rows: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """A 0/1 column for every category of (doc_id, text, label)."""
    toxic = F.col("label") == 1
    lowered = F.lower(F.coalesce("text", F.lit("")))
    for name, words in categories.items():
        found = toxic & lowered.rlike(r"(?<![a-z0-9])(?:" + "|".join(words) + r")(?![a-z0-9])")
        rows = rows.withColumn(name, found.cast("int"))
    return rows.withColumn(LAST, toxic.cast("int"))


@dataclass
class Chain:
    names: list[str]
    #: Feature number of every bucket, -1 for those not selected.
    place: np.ndarray
    links: list[np.ndarray] = field(default_factory=list)

    def dense(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        x = np.zeros((n, int(self.place.max(initial=-1)) + 1), np.float32)
        own = self.place[bucket]
        x[row[own >= 0], own[own >= 0]] = 1
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column per link, each fed with the ones before."""
        found = np.zeros((len(x), 0))
        for w in self.links:
            z = np.hstack([x, found]) @ w[:-1] + w[-1]
            found = np.hstack([found, sigmoid(z)[:, None]])
        return found

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.probabilities(self.dense(*features(data, offsets), len(offsets) - 1))


def _folded(x: np.ndarray, fold: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    """Features, the earlier links' probabilities by models that have not seen the row, and a one for the free term."""
    for links in earlier:
        z = x @ links[:FOLDS, :-1].T.astype(np.float32) + links[:FOLDS, -1]
        x = np.concatenate([x, sigmoid(z[np.arange(len(x)), fold])[:, None]], axis=1, dtype=np.float32)
    return np.concatenate([x, np.ones((len(x), 1))], axis=1, dtype=np.float32)


def _sums(stored: DataFrame, name: str, chain: Chain, earlier: list[np.ndarray], weights: np.ndarray):
    """Curvature of the last model, slopes of all (one to a row), and each one's loss, rows and positive rows."""
    models, width = weights.shape

    def run(batches):
        curve, slopes, rest = np.zeros((width, width)), np.zeros((models, width)), np.zeros((3, models))
        for batch in batches:
            for i in range(0, batch.num_rows, DENSE):
                part = batch.slice(i, DENSE)
                y, fold = part.column(0).to_numpy().astype(float)[:, None], part.column(1).to_numpy()
                sizes = part.column(2).value_lengths().to_numpy()
                x = chain.dense(np.repeat(np.arange(len(y)), sizes), part.column(2).flatten().to_numpy(), len(y))
                x = _folded(x, fold, earlier)
                z = (x @ weights.T.astype(np.float32)).astype(float)
                p, seen = sigmoid(z), fold[:, None] != np.arange(models)
                slopes += ((p - y) * seen).T.astype(np.float32) @ x
                rest += [((np.logaddexp(0, z) - y * z) * seen).sum(0), seen.sum(0), (y * seen).sum(0)]
                x *= np.sqrt(p[:, -1:] * (1 - p[:, -1:])).astype(np.float32)
                curve += x.T @ x
        columns = {"curve": [curve.astype(np.float32).tobytes()], "slopes": [slopes.tobytes()], "rest": [rest.tobytes()]}
        yield pa.RecordBatch.from_pydict(columns)

    curve, slopes, rest = np.zeros((width, width)), np.zeros((models, width)), np.zeros((3, models))
    found = stored.select(name, "fold", "features").mapInArrow(run, "curve binary, slopes binary, rest binary").toArrow()
    for one, two, three in zip(*(found.column(c) for c in ("curve", "slopes", "rest"))):
        curve += np.frombuffer(one.as_buffer(), np.float32).reshape(width, width)
        slopes += np.frombuffer(two.as_buffer()).reshape(models, width)
        rest += np.frombuffer(three.as_buffer()).reshape(3, models)
    return curve, slopes, rest


def _link(stored: DataFrame, name: str, chain: Chain, earlier: list[np.ndarray]) -> np.ndarray:
    """Weights of one link: for each fold those without its rows, last those of all rows.

    The smoothed share alone when there is one class only. A step that does not lessen a model's loss is halved.
    """
    width = int(chain.place.max(initial=-1)) + 1 + len(earlier) + 1
    pull = np.append(np.full(width - 1, PENALTY), 0)
    best = ahead = np.zeros((FOLDS + 1, width))
    lowest, slope, step = np.full(FOLDS + 1, np.inf), np.zeros_like(best), np.ones((FOLDS + 1, 1))
    for _ in range(STEPS):
        curve, slopes, (loss, n, positive) = _sums(stored, name, chain, earlier, ahead)
        loss = loss + (pull * ahead**2).sum(1) / 2
        less = loss <= lowest + 1e-6 * (1 + np.abs(loss))
        if less[-1]:
            bend = curve + np.diag(pull + 1e-6)
        best, slope = np.where(less[:, None], ahead, best), np.where(less[:, None], slopes + pull * ahead, slope)
        lowest, step = np.where(less, loss, lowest), np.where(less[:, None], 1.0, step / 2)
        both = ((positive > 0) & (positive < n))[:, None]
        move = np.where(both, step * np.linalg.solve(bend, slope.T).T, 0)
        if np.abs(move).max() < MOVED:
            break
        ahead = best - move
    share = (positive + 1) / (n + 2)
    alone = np.append(np.zeros((FOLDS + 1, width - 1)), np.log(share / (1 - share))[:, None], axis=1)
    return np.where(both, best, alone)


def fit(rows: DataFrame, categories: dict[str, list[str]]) -> Chain:
    """A chain from (doc_id, text, label)."""
    names = [*categories, LAST]
    rows = category_columns(rows, categories)
    counts, totals = corpus_counts(rows, [LAST], features, SIZE)
    (toxic, total), (own, every) = totals, counts
    p, q = own / max(1, toxic), (every - own) / max(1, total - toxic)
    mean = every / max(1, total)
    error = np.sqrt(mean * (1 - mean) * (1 / max(1, toxic) + 1 / max(1, total - toxic))) + 1e-9
    gap = np.abs(p - q) / error
    best = np.argsort(-gap, kind="stable")[:SELECTED]
    place = np.full(SIZE, -1, np.int64)
    place[np.sort(best[gap[best] > 0])] = np.arange((gap[best] > 0).sum())
    chain = Chain(names, place)

    selected = place >= 0

    def own_features(data, offsets):
        row, bucket = features(data, offsets)
        return row[selected[bucket]], bucket[selected[bucket]]

    release(rows.sparkSession)
    scratch = Scratch(rows.sparkSession, "toxicity")
    found = feature_rows(rows, names, own_features)
    stored = scratch.write(found.withColumn("fold", F.expr(f"cast(pmod(xxhash64(doc_id), {FOLDS}) AS int)")), "features")
    few = stored.coalesce(max(1, min(TASKS, math.ceil(total / TASK_ROWS))))
    earlier: list[np.ndarray] = []
    for name in names:
        release(rows.sparkSession)
        earlier.append(_link(few, name, chain, earlier))
    chain.links = [links[-1] for links in earlier]
    scratch.drop(stored)
    return chain


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    categories: dict[str, list[str]] = CATEGORIES,
    output: str = "p_toxicity",
) -> DataFrame:
    """All columns of ``documents`` and the links' probabilities, the last for toxicity itself.

    A column that is already called like ``output`` is replaced.
    """
    spark = importable(documents.sparkSession)
    chain = spark.sparkContext.broadcast(fit(labelled(documents, labels, "toxic"), categories))
    own = documents.select([c for c in documents.columns if c.lower() != output.lower()])
    text = own.columns.index("text")

    def run(batch):
        data, offsets = utf8(batch.column(text))
        for i, j in row_groups(offsets):
            p = chain.value.score(data, offsets[i : j + 1])
            chances = lists(p.ravel(), np.arange(len(p) + 1) * p.shape[1], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, chances], [*batch.schema.names, output])

    return arrow_map(own, T.StructType([*own.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))]), run)

"""Quality classifier: a support vector machine over naive Bayes features.

Indicators of n-grams are scaled by the log-count ratio of the two classes, rows are brought to unit length, and a
linear hinge-loss model is fitted by dual coordinate descent. Margins become probabilities by a logistic curve that is
fitted to margins of folds left out.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonority.llm.common import table, text_or_empty

#: Labelled rows that the model is fitted on at most, and n-grams that it keeps at most.
MAX_TRAIN, MAX_FEATURES = 4000, 50_000
#: Labelled rows that an n-gram must be in.
LEAST = 2
THRESHOLD = 0.7

_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _streams(text: str) -> tuple[list[str], list[str]]:
    """Words in lower case, and their shapes: letters are x, digits 9, and a repeated word is an equals sign."""
    words = text.lower().split()
    shapes = _DIGITS.sub("9", _LETTERS.sub("x", text)).split()
    return words, shapes[:1] + ["=" if a == b else s for a, b, s in zip(words[1:], words, shapes[1:])]


def ngrams(text: str) -> set:
    """Words, pairs of words, shapes (as 1-tuples) and triples of shapes."""
    words, shapes = _streams(text)
    out: set = set(words)
    out.update(zip(words, words[1:]))
    out.update(zip(set(shapes)))
    out.update(zip(shapes, shapes[1:], shapes[2:]))
    return out


def descend(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, dims: int, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Weights of the hinge-loss model, the last for the constant, by dual coordinate descent.

    :param rows: feature numbers of each row; a feature's value is ``values`` of it over the row's length.
    :param y: 1 or -1 for each row; ``cost``: the upper bound of each row's multiplier.
    """
    w, rng = np.zeros(dims + 1), np.random.default_rng(seed)
    parts = []
    for ids in rows:
        v = values[ids]
        parts.append(v / max(float(np.sqrt(v @ v)), 1e-9))
    multiplier, own = np.zeros(len(rows)), [float(v @ v) + 1 for v in parts]
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            ids, v = rows[i], parts[i]
            slope = y[i] * (w[ids] @ v + w[dims]) - 1
            new = min(max(multiplier[i] - slope / own[i], 0.0), cost[i])
            step = (new - multiplier[i]) * y[i]
            if step:
                multiplier[i] = new
                w[ids] += step * v
                w[dims] += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; a column of ones is added last. Targets are drawn in from 0 and 1."""
    x = np.column_stack([x, np.ones(len(y))])
    weight = np.ones(len(y)) if weight is None else weight
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    b, pull = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - goal)) + pull @ b
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + pull, grad)
        size = np.abs(step).max()
        b -= step * min(1.0, 5 / max(size, 1e-9))
        if size < 1e-6:
            break
    return b


class Model:
    """Scores texts. Without two classes to learn from, it scores all texts with the share of label 1."""

    def __init__(self, texts: list[str], labels: np.ndarray, max_features: int = MAX_FEATURES) -> None:
        y = np.asarray(labels, np.int64)
        self.base = (y.sum() + 1) / (len(y) + 2)
        self.ids: dict = {}
        if len(set(y.tolist())) < 2:
            return
        single: Counter = Counter()
        for t in texts:
            words, shapes = _streams(t)
            single.update(set(words))
            single.update(zip(set(shapes)))
            single.update(set(zip(shapes, shapes[1:], shapes[2:])))
        single = Counter({g: n for g, n in single.items() if n >= LEAST})
        pairs: Counter = Counter()
        for t in texts:
            words = t.lower().split()
            pairs.update({p for p in zip(words, words[1:]) if p[0] in single and p[1] in single})
        single.update({p: n for p, n in pairs.items() if n >= LEAST})
        chosen = sorted(single.items(), key=lambda x: (-x[1], str(x[0])))[:max_features]
        self.ids = {g: i for i, (g, _) in enumerate(chosen)}
        rows = [self._ids(t) for t in texts]
        self.ratio, w = self._fit(rows, y)
        margins = np.zeros(len(y))
        fold = np.arange(len(y)) % 3
        for k in range(3):
            rest = np.flatnonzero(fold != k)
            if len(set(y[rest].tolist())) < 2:
                margins[fold == k] = [self._margin(rows[i], self.ratio, w) for i in np.flatnonzero(fold == k)]
                continue
            r, v = self._fit([rows[i] for i in rest], y[rest])
            margins[fold == k] = [self._margin(rows[i], r, v) for i in np.flatnonzero(fold == k)]
        self.w, self.curve = w, logistic(margins[:, None], y)

    def _ids(self, text: str) -> np.ndarray:
        found = [i for i in map(self.ids.get, ngrams(text)) if i is not None]
        return np.array(found, np.int64)

    def _fit(self, rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dims = len(self.ids)
        one = 1 + np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(y == 1)]), minlength=dims)
        none = 1 + np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(y == 0)]), minlength=dims)
        ratio = np.log((one / one.sum()) / (none / none.sum()))
        share = np.where(y == 1, (y == 1).mean(), (y == 0).mean())
        return ratio, descend(rows, ratio, np.where(y == 1, 1.0, -1.0), 0.5 / share, dims)

    @staticmethod
    def _margin(ids: np.ndarray, ratio: np.ndarray, w: np.ndarray) -> float:
        v = ratio[ids]
        return float(v @ w[ids] / max(np.sqrt(v @ v), 1e-9) + w[-1])

    def score(self, text: str) -> float:
        if not self.ids:
            return float(self.base)
        z = self._margin(self._ids(text), self.ratio, self.w) * self.curve[0] + self.curve[1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out, max_train: int) -> DataFrame:
    """``doc_id, text, y`` of a bounded sample of labelled rows that are not held out, the same for the same ids.

    Rows without an id or label don't count; several labels of one id count as their rounded mean. The sample takes
    the least hashes of ids; its number of rows is bounded by ``max_train``, so its ids are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out).groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(max_train)
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")


def fit(train: DataFrame, max_features: int = MAX_FEATURES) -> Model:
    """Fit in one task, over the bounded sample."""

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (held := list(parts)):
            return
        pdf = pd.concat(held).sort_values(["doc_id", "text"]).drop_duplicates("text")
        yield pd.DataFrame({"model": [pickle.dumps(Model(pdf["text"].tolist(), pdf["y"].to_numpy(), max_features))]})

    got = train.repartition(1).mapInPandas(one, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else Model([], np.zeros(0))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every whole text; a null text is an empty one, and repeated rows are all scored."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([score(t) for t in b.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(each, f"doc_id {kind}, score double")


def _held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """Score each document for quality.

    :param docs: ``doc_id, text`` and any other columns, which are never inputs. Null ``doc_id`` rows are scored and
        count as not held out. An empty table gives no rows; without labels every score is a half.
    :return: ``doc_id, held_out, score, predicted``.
    """
    model = fit(training_rows(docs, labels, "quality", _held_out(), max_train))
    return scored(docs, model).select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with all their columns: scored where they lie, nothing is shuffled."""
    model = fit(training_rows(docs, table(spark, sf_dir, "labels"), "quality", _held_out(), MAX_TRAIN))
    shared = spark.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for b in batches:
            yield b.filter(pa.array([score(t or "") >= THRESHOLD for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)

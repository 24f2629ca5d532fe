"""Toxicity: a linear-chain conditional random field tags toxic spans.

Words are tagged 0 or 1. Emissions come from a word's identity, beginnings and endings; the chain has a weight for each
pair of neighbouring tags. Forward-backward gives each word's chance to be toxic; these are gathered to a document's
score and to the offsets of offending spans.

Labels are given for documents only, so the tokens to learn from are labelled first: in a toxic document, the words
whose identity or beginning is far more usual in toxic documents than in others.
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

from sonority.llm.common import portions, table, text_or_empty
from sonority.llm.quality import logistic

#: Labelled documents of each class that the model is fitted on at most.
MAX_TOXIC, MAX_CLEAN = 900, 1800
THRESHOLD = 0.5
#: A beginning or word marks toxic tokens from this share of toxic documents, and this ratio to the share of others.
LEAST_SHARE, LEAST_RATIO = 0.01, 5.0
#: Bytes of text whose words go through the chain at once, about: some 300,000 words.
CHARS = 2_000_000
#: Words whose emission a worker remembers.
MEMORY = 400_000

_WORD = re.compile(r"\w+")


def _marks(word: str) -> list[str]:
    """Identity and beginnings."""
    w = word.lower()
    return [f"={w}", *(f"^{w[:k]}" for k in range(3, 9) if len(w) > k)]


def features(word: str) -> list[str]:
    w = word.lower()
    return [*_marks(word), *(f"${w[-k:]}" for k in (2, 3, 4) if len(w) > k)]


def marginals(e: np.ndarray, first: np.ndarray, turn: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of tag 1 at each token, and the expected number of each turn of tags within documents.

    Documents stand one after another in a single stream; ``first`` marks where each begins. The stream is cut into
    equal pieces that are worked on side by side: the product of each piece's 2x2 matrices gives what enters the next.

    :param e: log-odds of tag 1 from the emissions; ``turn``: log weights of pairs of tags; ``start``: of first tags.
    """
    n = len(e)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    length = max(1, int(np.sqrt(n)))
    pieces = -(-n // length)
    pad = pieces * length - n
    e = np.concatenate([np.clip(e, -30, 30), np.zeros(pad)])
    first = np.concatenate([first, np.ones(pad, bool)])
    one = 1 / (1 + np.exp(-e))
    t, s = np.exp(turn - turn.max()), np.exp(start - start.max())

    def lay(x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x.reshape(pieces, length).T)

    # m[i][j]: weight to go from tag i to tag j and emit, the same for both i at a document's first token
    m = [[lay(np.where(first, s[j], t[i, j]) * (one if j else 1 - one)) for j in (0, 1)] for i in (0, 1)]

    p = [[np.ones(pieces), np.zeros(pieces)], [np.zeros(pieces), np.ones(pieces)]]
    for k in range(length):
        q = [[p[i][0] * m[0][j][k] + p[i][1] * m[1][j][k] for j in (0, 1)] for i in (0, 1)]
        scale = q[0][0] + q[0][1] + q[1][0] + q[1][1]
        p = [[q[i][j] / scale for j in (0, 1)] for i in (0, 1)]
    into, out = np.empty((2, pieces)), np.empty((2, pieces))
    a, b = np.array([0.5, 0.5]), np.array([0.5, 0.5])
    whole = np.array(p).transpose(2, 0, 1)
    for c in range(pieces):
        into[:, c] = a
        a = a @ whole[c]
        a /= a.sum()
        out[:, pieces - 1 - c] = b
        b = whole[pieces - 1 - c] @ b
        b /= b.sum()
    fore, back = np.empty((2, length, pieces)), np.empty((2, length, pieces))
    f0, f1 = into
    b0, b1 = out
    for k in range(length):
        g0, g1 = f0 * m[0][0][k] + f1 * m[1][0][k], f0 * m[0][1][k] + f1 * m[1][1][k]
        f0, f1 = g0 / (g0 + g1), g1 / (g0 + g1)
        fore[0, k], fore[1, k] = f0, f1
        k = length - 1 - k
        back[0, k], back[1, k] = b0, b1
        h0, h1 = m[0][0][k] * b0 + m[0][1][k] * b1, m[1][0][k] * b0 + m[1][1][k] * b1
        b0, b1 = h0 / (h0 + h1), h1 / (h0 + h1)

    fore, back = fore.transpose(0, 2, 1).reshape(2, -1)[:, :n], back.transpose(0, 2, 1).reshape(2, -1)[:, :n]
    up = fore[1] * back[1]
    chance = up / (up + fore[0] * back[0])
    turns = np.zeros((2, 2))
    inner = np.flatnonzero(~first[1:n]) + 1
    if len(inner):
        joint = np.array([[fore[i, inner - 1] * t[i, j] * (one[inner] if j else 1 - one[inner]) * back[j, inner] for j in (0, 1)] for i in (0, 1)])
        turns = (joint / joint.sum((0, 1))).sum(2)
    return chance, turns


class Tagger:
    """The fitted field and the curve from its tags to a document's score."""

    def __init__(self, texts: list[str], labels: np.ndarray, weights: np.ndarray, rounds: int = 60) -> None:
        """:param weights: what each document counts for in the curve, to make up for how it was sampled."""
        y = np.asarray(labels, np.int64)
        self.base = float((weights[y == 1].sum() + 1) / (weights.sum() + 2)) if len(y) else 0.5
        self.weight: dict[str, float] = {}
        self.turn, self.start, self.bias = np.zeros((2, 2)), np.zeros(2), -4.0
        self._memory: dict[str, float] = {}
        if len(set(y.tolist())) < 2:
            return
        docs = [_WORD.findall(t) for t in texts]
        # a third of each class is left for the curve, if both classes have three documents to be dealt out
        place = np.zeros(len(y), np.int64)
        for k in (0, 1):
            place[y == k] = np.arange((y == k).sum())
        learn = place % 3 != 0 if min((y == 0).sum(), (y == 1).sum()) >= 3 else np.ones(len(y), bool)
        self.marks = self._find([docs[i] for i in np.flatnonzero(learn)], y[learn])
        self._fit([docs[i] for i in np.flatnonzero(learn)], y[learn], rounds)
        kept = np.ones(len(y), bool) if learn.all() else ~learn
        sums = np.array([self._sums(p) for p in self._chances([docs[i] for i in np.flatnonzero(kept)])])
        self.curve = logistic(sums, y[kept], weights[kept], ridge=0.05)

    @staticmethod
    def _find(docs: list[list[str]], y: np.ndarray) -> set[str]:
        counts = (Counter(), Counter())
        for words, toxic in zip(docs, y):
            counts[toxic].update({m for w in set(words) for m in _marks(w)})
        toxic, clean = int((y == 1).sum()), int((y == 0).sum())
        least = max(3, LEAST_SHARE * toxic)
        return {m for m, a in counts[1].items() if a >= least and (a + 0.5) / (toxic + 1) >= LEAST_RATIO * (counts[0][m] + 0.5) / (clean + 1)}

    def _fit(self, docs: list[list[str]], y: np.ndarray, rounds: int) -> None:
        words: dict[str, int] = {}
        stream = np.array([words.setdefault(w, len(words)) for d in docs for w in d], np.int64)
        first = np.zeros(len(stream), bool)
        starts = np.cumsum([0, *map(len, docs)])[:-1]
        first[starts[[len(d) > 0 for d in docs]]] = True
        marked = np.array([any(m in self.marks for m in _marks(w)) for w in words], bool)
        tags = marked[stream] & np.repeat(y == 1, [len(d) for d in docs])
        seen = np.bincount(stream, minlength=len(words))
        count: Counter = Counter()
        for w, n in zip(words, seen.tolist()):
            count.update(dict.fromkeys(features(w), n))
        own = {f: i for i, f in enumerate(f for f, n in count.items() if n >= 3)}
        of_word, of_feature = [], []
        for i, w in enumerate(words):
            known = [own[f] for f in features(w) if f in own]
            of_word += [i] * len(known)
            of_feature += known
        of_word, of_feature = np.array(of_word, np.int64), np.array(of_feature, np.int64)
        theta = np.zeros(len(own) + 1 + 4 + 2)
        theta[len(own)] = self.bias
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        goal_words = np.bincount(stream, tags, len(words))
        goal_turns = np.zeros((2, 2))
        inner = np.flatnonzero(~first[1:]) + 1
        np.add.at(goal_turns, (tags[inner - 1].astype(int), tags[inner].astype(int)), 1)
        goal_first = np.array([(~tags[first]).sum(), tags[first].sum()], float)
        for k in range(1, rounds + 1):
            w, bias, turn, start = theta[: len(own)], theta[len(own)], theta[-6:-2].reshape(2, 2), theta[-2:]
            e = np.bincount(of_word, w[of_feature], len(words)) + bias
            p, turns = marginals(e[stream], first, turn, start)
            per_word = np.bincount(stream, p, len(words)) - goal_words
            at_first = np.array([(1 - p[first]).sum(), p[first].sum()]) - goal_first
            grad = np.concatenate([np.bincount(of_feature, per_word[of_word], len(own)) + 0.05 * w, [per_word.sum()], (turns - goal_turns).ravel() + 0.05 * turn.ravel(), at_first + 0.05 * start])
            mean = 0.9 * mean + 0.1 * grad
            square = 0.99 * square + 0.01 * grad * grad
            theta = theta - 0.15 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        self.weight = {f: float(theta[i]) for f, i in own.items()}
        self.bias, self.turn, self.start = float(theta[len(own)]), theta[-6:-2].reshape(2, 2), theta[-2:]

    def _emission(self, word: str) -> float:
        get = self.weight.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def _chances(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Chances of tag 1 for each document's words; all documents go through the chain as one stream."""
        memory, sizes = self._memory, [len(d) for d in docs]
        e: list[float] = []
        for d in docs:
            try:
                e += list(map(memory.__getitem__, d))
            except KeyError:
                new = {w for w in d if w not in memory}
                if len(memory) + len(new) > MEMORY:
                    memory.clear()
                    new = set(d)
                memory.update((w, self._emission(w)) for w in new)
                e += list(map(memory.__getitem__, d))
        first = np.zeros(len(e), bool)
        starts = np.cumsum([0, *sizes])
        first[starts[:-1][np.array(sizes, int) > 0]] = True
        p, _ = marginals(np.array(e), first, self.turn, self.start)
        return np.split(p, starts[1:-1]) if docs else []

    @staticmethod
    def _sums(p: np.ndarray) -> list[float]:
        """What a document's score depends on: the expected toxic words, the surest of them, and the length."""
        top = min(max(float(p.max()) if len(p) else 0.0, 1e-4), 1 - 1e-4)
        return [float(np.log(p.sum() + 1e-3)), float(np.log(top / (1 - top))), float(np.log(len(p) + 1))]

    def scores(self, texts: list[str]) -> tuple[list[float], list[list[tuple[int, int]]]]:
        """Score and offending spans (code points, end exclusive) of each text; neighbouring toxic words are one span."""
        if not self.weight:
            return [self.base] * len(texts), [[] for _ in texts]
        out, spans = [], []
        for text, p in zip(texts, self._chances([_WORD.findall(t) for t in texts])):
            z = float(np.dot(self.curve[:-1], self._sums(p)) + self.curve[-1])
            out.append(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
            found: list[tuple[int, int]] = []
            hit = p > 0.5
            if hit.any():
                at = [m.span() for m in _WORD.finditer(text)]
                for i in np.flatnonzero(hit).tolist():
                    if i and hit[i - 1]:
                        found[-1] = (found[-1][0], at[i][1])
                    else:
                        found.append(at[i])
            spans.append(found)
        return out, spans


def _held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Tagger:
    """Fit in one task on a bounded sample: of each class, the labelled rows with the least hashes of ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~_held_out()).groupBy("doc_id").agg(F.round(F.avg("toxic")).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = [F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id")]
    sample = known.where("y = 1").orderBy(*order).limit(max_toxic).union(known.where("y = 0").orderBy(*order).limit(max_clean))
    train = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    weight = {1: sizes.get(1, 0) / max(1, min(sizes.get(1, 0), max_toxic)), 0: sizes.get(0, 0) / max(1, min(sizes.get(0, 0), max_clean))}

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (held := list(parts)):
            return
        pdf = pd.concat(held).sort_values(["doc_id", "text"]).drop_duplicates("text")
        y = pdf["y"].to_numpy()
        model = Tagger(pdf["text"].tolist(), y, np.where(y == 1, weight[1], weight[0]))
        model._memory = {}
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    got = train.repartition(1).mapInPandas(one, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else Tagger([], np.zeros(0), np.zeros(0))


def tagged(docs: DataFrame, model: Tagger) -> DataFrame:
    """``doc_id, score, spans`` of every whole text; ``spans`` holds ``start, end`` of each toxic span."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for part in portions(b, "text", CHARS):
                scores, spans = model.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([[{"start": s, "end": t} for s, t in x] for x in spans], span)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(each, f"doc_id {kind}, score double, spans array<struct<start:int,end:int>>")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Score each document for toxicity.

    :param docs: ``doc_id, text`` and any other columns, which are never inputs. A null text is an empty one. Null
        ``doc_id`` rows are scored and count as not held out; repeated rows are all scored. An empty table gives no
        rows; without two classes of labels every score is the share of toxic labels, or a half.
    :return: ``doc_id, held_out, score, predicted, spans``; ``spans`` is start:end of each toxic span, comma-joined.
    """
    found = tagged(docs, fit(docs, labels))
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])))
    return found.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), spans.alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

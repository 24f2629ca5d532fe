"""Grammars: their text form, fitting their weights, and sampling words from them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonority.functions.automata import Automaton, counter, expectations, nothing, product
from sonority.functions.features import FeatureTable
from sonority.functions.globs import Glob, parse_glob
from sonority.functions.stats import strata


@dataclass
class Grammar:
    """Lengths of words with their numbers, and rules with weights, oldest first."""

    lengths: dict[int, int]
    rules: list[Glob] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def text(self) -> str:
        pairs = ",".join(f"({k},{n})" for k, n in sorted(self.lengths.items()))
        return f"# Length Distribution:\n[{pairs}]\n\n# Constraints:\n" + "".join(f"{w:.3f}  {r}\n" for w, r in zip(self.weights, self.rules))

    @classmethod
    def parse(cls, text: str) -> Grammar:
        """Read a grammar; empty lines and comments don't count. Any line that can't be read refuses the whole, with its number."""
        lengths: dict[int, int] | None = None
        rules, weights = [], []
        for k, line in enumerate(text.split("\n"), 1):
            if not line or line.startswith("#"):
                continue
            try:
                if lengths is None:
                    if not re.fullmatch(r"\s*\[\s*(\(\s*-?\d+\s*,\s*-?\d+\s*\)\s*(,\s*\(\s*-?\d+\s*,\s*-?\d+\s*\)\s*)*)?\]\s*", line):
                        raise ValueError("no list of lengths")
                    lengths = {}
                    for a, b in re.findall(r"\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)", line):
                        if int(a) > 0:
                            lengths[int(a)] = lengths.get(int(a), 0) + int(b)
                    if not lengths:
                        raise ValueError("no length above zero")
                    continue
                number, _, rest = line.partition(" ")
                weights.append(float(number))
                rules.append(parse_glob(rest))
            except ValueError as e:
                raise ValueError(f"line {k}: {e}") from None
        if lengths is None:
            raise ValueError("no list of lengths")
        return cls(lengths, rules, weights)

    def automaton(self, table: FeatureTable) -> Automaton:
        """All rules' counts side by side."""
        m = nothing(len(table.segments))
        for r in self.rules:
            m = product(m, counter(r.initial, r.final, r.sets(table), len(table.segments)))
        return m

    def unknown_features(self, table: FeatureTable) -> list[str]:
        """Features that rules name and the table lacks; such features are ignored, so their classes widen."""
        named = {f for r in self.rules for p in r.parts for _, f in p.literals}
        return sorted(named - set(table.features))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(w), str(r)) for i, (w, r) in enumerate(zip(self.weights, self.rules))]
        return spark.createDataFrame(rows, "ordinal int, weight double, glob string")


def unknown_frame(spark: SparkSession, rules: dict[str, Glob], features: DataFrame) -> DataFrame:
    """``name, unknown``: rules that name features which ``features(feat)`` lacks, with those in order."""
    rows = [(k, f) for k, r in rules.items() for p in r.parts for _, f in p.literals]
    named = spark.createDataFrame(rows, "name string, feat string").coalesce(1)
    return named.join(F.broadcast(features), "feat", "left_anti").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("feat")), " ").alias("unknown"))


def objective(m: Automaton, lengths: np.ndarray, observed: np.ndarray) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Value and gradient of the negative log-likelihood with its linear prior.

    :param lengths: number of words of each length from 0; ``observed``: counts in the corpus.
    """
    used = lengths > 0

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        z, e = expectations(m, w, len(lengths) - 1)
        value = float(observed @ w + (lengths[used] * np.log(z[used])).sum() + np.abs(w).sum())
        return value, prior_slope(w, observed - (lengths[used, None] * e[used] / z[used, None]).sum(0))

    return at


def prior_slope(w: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The gradient with the prior; a weight at zero is not pushed below it."""
    return np.where(w < 0.01, np.minimum(d + 1, 0), d + 1)


def directional(m: Automaton, lengths: np.ndarray, observed: np.ndarray, w: np.ndarray, direction: np.ndarray) -> float:
    """Slope along a direction; the prior counts by the sign of each weight."""
    used = lengths > 0
    z, e = expectations(m, w, len(lengths) - 1)
    return float(direction @ (observed - (lengths[used, None] * e[used] / z[used, None]).sum(0)) + direction @ np.sign(w))


def project(w: np.ndarray) -> tuple[np.ndarray, bool]:
    """Weights under 0.01 become zero; whether any was clearly negative."""
    return np.where(w < 0.01, 0.0, w), bool((w < -0.01).any())


def line_search(slope: Callable[[float], float], tolerance: float = 0.005, first: float = 0.05) -> float:
    """A place where the slope along a line changes sign: doubling steps to bracket it, then damped false position."""
    low, s_low = 0.0, slope(0.0)
    if s_low > 0:
        return 0.0
    high = first
    for _ in range(60):
        s_high = slope(high)
        if s_high >= 0:
            break
        low, s_low, high = high, s_high, high * 2
    else:
        return low
    side = 0
    for _ in range(60):
        if high - low < tolerance or s_high == s_low:
            break
        at = (low * s_high - high * s_low) / (s_high - s_low)
        s = slope(at)
        if s == 0:
            return at
        if s < 0:
            low, s_low = at, s
            s_high *= 0.707 if side < 0 else 1
            side = -1
        else:
            high, s_high = at, s
            s_low *= 0.707 if side > 0 else 1
            side = 1
    return (low + high) / 2


def descended(at: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, onto: Callable[[np.ndarray], tuple[np.ndarray, bool]] = project, step: float = 0.01, most: int = 200, tolerance: float = 0.005) -> np.ndarray:
    """Where a function is least, by conjugate gradients with restarts; stops when a step is shorter than ``step``.

    :param at: value and gradient at a place; ``onto``: the allowed place next to one, and whether it was clearly outside.
    """
    w = np.asarray(start, float)
    if not len(w):
        return w
    _, grad = at(w)
    direction, since = -grad, 0
    for _ in range(most):
        norm = np.linalg.norm(direction)
        if norm < 1e-9:
            break
        unit = direction / norm
        length = line_search(lambda t: float(at(w + t * unit)[1] @ unit), tolerance)
        new, corrected = onto(w + length * unit)
        moved = np.linalg.norm(new - w)
        _, fresh = at(new)
        since += 1
        beta = float(fresh @ (fresh - grad)) / max(float(grad @ grad), 1e-12)
        restart = since >= len(w) or beta <= 0 or corrected
        direction = -fresh if restart else -fresh + beta * direction
        since = 0 if restart else since
        w, grad = new, fresh
        if moved < step:
            break
    return w


def fit_weights(m: Automaton, lengths: np.ndarray, observed: np.ndarray, start: np.ndarray, step: float = 0.01, most: int = 200, tolerance: float = 0.005) -> np.ndarray:
    """Weights of the greatest likelihood."""
    return descended(objective(m, lengths, observed), start, project, step, most, tolerance)


def certificate(masses: DataFrame, lengths: DataFrame, observed: DataFrame, weights: dict[str, float], within: float = 0.01) -> DataFrame:
    """Whether weights are the best ones: ``name, weight, observed, expected, slope, optimal``.

    The slope of the objective is the observed count less the expected one, and one for the prior. It must be zero where a weight is
    positive, and not below zero where it is zero: there, less weight isn't allowed and more makes it worse.

    :param masses: ``len, z, v0, v1, ..`` under the weights, in their order; ``lengths``: ``len, n``; ``observed``: ``name, violations``.
    :param within: how far a slope may be off, as a share of the observed count and one.
    """
    sums = masses.join(lengths.where("n > 0"), "len").agg(*[F.sum(F.col("n") * F.col(f"v{i}") / F.col("z")).alias(k) for i, k in enumerate(weights)])
    held = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    full = sums.unpivot([], list(weights), "name", "expected").join(observed, "name").withColumn("weight", held[F.col("name")])
    slope, off = F.col("violations") - F.col("expected") + 1, F.lit(within) * (F.col("violations") + 1)
    optimal = F.when(F.col("weight") > 0, F.abs(slope) <= off).otherwise(slope >= -off)
    return full.select("name", "weight", F.col("violations").alias("observed"), "expected", slope.alias("slope"), optimal.alias("optimal"))


def unit_floats(spark_seed: int, row: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) for each row and step, the same however rows are dealt out."""
    with np.errstate(over="ignore"):
        h = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step + 1) * 0xBF58476D1CE4E5B9 % 2**64) + np.uint64(spark_seed * 0x94D049BB133111EB % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).astype(np.float64) / 2.0**64


def sample(m: Automaton, weights: np.ndarray, length: int, rows: np.ndarray, seed: int) -> np.ndarray:
    """Words of one length, drawn exactly: a word's chance is in proportion to exp(-weights . counts).

    Backward weights of each state are found once; all words then walk forwards together.
    """
    p, stop = np.exp(-(m.out @ weights)), np.exp(-(m.end @ weights))
    back = [stop]
    for _ in range(length):
        b = (p * back[-1][m.to]).sum(1)
        back.append(b / max(b.max(), 1e-300))
    state, out = np.zeros(len(rows), np.int64), np.zeros((len(rows), length), np.int64)
    for k in range(length):
        chance = p[state] * back[length - 1 - k][m.to[state]]
        run = chance.cumsum(1)
        out[:, k] = (run <= (unit_floats(seed, rows, k) * run[:, -1])[:, None]).sum(1).clip(0, m.to.shape[1] - 1)
        state = m.to[state, out[:, k]]
    return out


def word_salad(m: Automaton, weights: np.ndarray, lengths: dict[int, int], n: int, seed: int = 1) -> list[np.ndarray]:
    """``n`` words; lengths are spread evenly over their distribution, words of each length are drawn."""
    out, first = [], 0
    for length, draws in strata({k: v for k, v in lengths.items() if k > 0}, n).items():
        out.extend(sample(m, weights, length, np.arange(first, first + draws), seed))
        first += draws
    return out


def sampled_frame(spark: SparkSession, grammar: Grammar, table: FeatureTable, n: int, seed: int = 1) -> DataFrame:
    """``row_id, word``: ``n`` sampled words as segment ids, drawn where the rows lie.

    The automaton goes to the tasks once; it depends on the grammar alone. A row's word depends on its number and the
    seed, not on how rows are dealt out.
    """
    shared = spark.sparkContext.broadcast((grammar.automaton(table), np.array(grammar.weights, float)))
    edges, run = [], 0
    for length, draws in strata({k: v for k, v in grammar.lengths.items() if k > 0}, n).items():
        edges.append((run, run + draws, length))
        run += draws
    length = F.lit(None).cast("int")
    for a, b, k in edges:
        length = F.when((F.col("id") >= a) & (F.col("id") < b), F.lit(k)).otherwise(length)

    def draw(parts):
        import pandas as pd

        m, w = shared.value
        for pdf in parts:
            for k, own in pdf.groupby("len"):
                words = sample(m, w, int(k), own["row_id"].to_numpy(), seed)
                yield pd.DataFrame({"row_id": own["row_id"].to_numpy(), "word": (words + 1).tolist()})

    return spark.range(n).select(F.col("id").alias("row_id"), length.alias("len")).mapInPandas(draw, "row_id long, word array<int>")


"""Automata that count violations.

The automata of a grammar are small, for they grow with its rules and not with the corpus: they are numpy arrays on the
driver. Their relational forms (product, reachability, one step of a state distribution) are DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonority.functions.segments import dot
from sonority.sources.tables import written


@dataclass(frozen=True)
class Automaton:
    """``to[q, s]`` is where state q goes with segment s; ``out[q, s]`` and ``end[q]`` are vectors of counts. Starts in 0."""

    to: np.ndarray
    out: np.ndarray
    end: np.ndarray

    @property
    def states(self) -> int:
        return len(self.to)

    def count(self, word: list[int]) -> np.ndarray:
        """Counts of a word of segment indices from 0."""
        q, total = 0, np.zeros(self.end.shape[1], np.int64)
        for s in word:
            total += self.out[q, s]
            q = self.to[q, s]
        return total + self.end[q]

    def fold(self, word: list[int], zero, plus: Callable, weight: Callable, stop: Callable):
        """A word's weight in any monoid: ``weight(q, s)`` of each step and ``stop(q)``, joined by ``plus`` in order."""
        q, total = 0, zero
        for s in word:
            total, q = plus(total, weight(q, s)), int(self.to[q, s])
        return plus(total, stop(q))


def nothing(segments: int) -> Automaton:
    """One state and no counts."""
    return Automaton(np.zeros((1, segments), np.int64), np.zeros((1, segments, 0), np.int64), np.zeros((1, 0), np.int64))


def counter(initial: bool, final: bool, sets: list[tuple[str, int]], segments: int) -> Automaton:
    """Counts the places of a word where some match of the glob ends, once each; with ``final``, one if the word's end is.

    A state is the set of parts that may come next. A part that must occur and may repeat is that part once and then
    any number of times. A glob of parts that may all be absent ends everywhere.
    """
    parts = [p for rep, mask in sets for p in ([(False, mask), (True, mask)] if rep == "+" else [(rep == "*", mask)])]
    n = len(parts)

    def skip(at: frozenset[int]) -> frozenset[int]:
        held = set(at)
        for i in range(n):
            if i in held and parts[i][0]:
                held.add(i + 1)
        return frozenset(held)

    start = skip(frozenset([0]))
    again = frozenset() if initial else start
    ids, todo, to, out = {start: 0}, [start], [], []
    for state in todo:
        row, hits = [], []
        for s in range(segments):
            moved = frozenset(i if parts[i][0] else i + 1 for i in state if i < n and parts[i][1] >> s & 1)
            new = skip(moved) | again
            if new not in ids:
                ids[new] = len(ids)
                todo.append(new)
            row.append(ids[new])
            hits.append(int(n in new and not final))
        to.append(row)
        out.append(hits)
    end = np.array([[int(final and n in state)] for state in todo], np.int64)
    return Automaton(np.array(to, np.int64), np.array(out, np.int64)[:, :, None], end)


def product(a: Automaton, b: Automaton, most: int = 200_000) -> Automaton:
    """Runs both at once, counts of ``a`` before those of ``b``; only states that the start reaches are kept.

    :param most: more states than these are refused.
    """
    if a.to.shape[1] != b.to.shape[1]:
        raise ValueError("the automata are over different segments")
    ids, todo = {(0, 0): 0}, [(0, 0)]
    to, out, end = [], [], []
    for p, q in todo:
        row = []
        for x, y in zip(a.to[p].tolist(), b.to[q].tolist()):
            if (x, y) not in ids:
                if len(ids) >= most:
                    raise ValueError(f"the product has more than {most} states")
                ids[x, y] = len(ids)
                todo.append((x, y))
            row.append(ids[x, y])
        to.append(row)
        out.append(np.concatenate([a.out[p], b.out[q]], 1))
        end.append(np.concatenate([a.end[p], b.end[q]]))
    return Automaton(np.array(to, np.int64), np.array(out), np.array(end))


def together(a: Automaton, b: Automaton, how: Callable[[bool, bool], bool]) -> Automaton:
    """One count that tells, at a word's end, ``how`` of whether ``a`` and ``b`` count anything in it (and, or, ...)."""

    def told(m: Automaton) -> Automaton:
        # a state also remembers whether anything has been counted so far
        n, hit = m.states, (m.out.sum(2) > 0).astype(np.int64)
        to = np.concatenate([m.to + n * hit, m.to + n])
        end = np.concatenate([m.end.sum(1) > 0, np.ones(n, bool)]).astype(np.int64)[:, None]
        return Automaton(to, np.zeros((*to.shape, 1), np.int64), end)

    both = product(told(a), told(b))
    end = np.array([[int(how(bool(x), bool(y)))] for x, y in both.end], np.int64).reshape(-1, 1)
    return Automaton(both.to, np.zeros((*both.to.shape, 1), np.int64), end)


def expectations(m: Automaton, weights: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length from 0: the sum of exp(-weights . counts) over all words, and the same with counts.

    A forward pass over lengths carries a weight and a weighted sum of counts for each state.
    """
    weights = np.asarray(weights, float)
    if len(weights) != m.end.shape[1]:
        raise ValueError("there must be a weight for each count")
    p, stop = np.exp(-(m.out @ weights)), np.exp(-(m.end @ weights))
    v, vstop = p[..., None] * m.out, stop[:, None] * m.end
    mass, sums = np.zeros(m.states), np.zeros((m.states, len(weights)))
    mass[0] = 1
    z, e = np.zeros(longest + 1), np.zeros((longest + 1, len(weights)))
    for k in range(longest + 1):
        z[k], e[k] = mass @ stop, sums.T @ stop + mass @ vstop
        step = mass[:, None] * p
        moved = sums[:, None, :] * p[..., None] + mass[:, None, None] * v
        mass = np.bincount(m.to.ravel(), step.ravel(), m.states)
        new = np.zeros_like(sums)
        np.add.at(new, m.to.ravel(), moved.reshape(-1, len(weights)))
        sums = new
    return z, e


def transduced(word: Column, zero: Column, weight: Callable[[Column], Column], plus: Callable[[Column, Column], Column]) -> Column:
    """A word's weight in any monoid, as a column: the weights of its segments, joined by ``plus`` in order."""
    return F.aggregate(word, zero, lambda held, s: plus(held, weight(s)))


def mapped(edges: DataFrame, change: Callable[[Column], Column], name: str = "w") -> DataFrame:
    """The same edges with every weight changed."""
    return edges.withColumn(name, change(F.col(name)))


def weighted(edges: DataFrame, weights: Sequence[float], direction: Sequence[float]) -> DataFrame:
    """Edges with counts ``c`` (an array) as edges with ``p``, exp(-weights . c), and ``v``, p times direction . c."""

    def of(v: Sequence[float]) -> Column:
        return dot(F.array(*map(F.lit, v)), F.col("c"))

    out = mapped(edges.withColumn("p", of(weights)), lambda x: F.exp(-x), "p")
    return out.withColumn("v", F.col("p") * of(direction))


def product_frame(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of edge tables ``q, seg_id, q2, w``: edges meet on the segment; weights are kept side by side."""
    left = a.select("seg_id", F.col("q").alias("qa"), F.col("q2").alias("qa2"), F.col("w").alias("wa"))
    right = b.select("seg_id", F.col("q").alias("qb"), F.col("q2").alias("qb2"), F.col("w").alias("wb"))
    return left.join(right, "seg_id").select("seg_id", "qa", "qb", "qa2", "qb2", "wa", "wb")


def reversed_frame(edges: DataFrame) -> DataFrame:
    """``q2, seg_id, sources``: the states that an edge comes from, in order."""
    return edges.groupBy("q2", "seg_id").agg(F.array_sort(F.collect_set("q")).alias("sources"))


def reachable(edges: DataFrame, start: DataFrame, rounds: int | None = None) -> DataFrame:
    """States ``q`` that ``start(q)`` reaches over edges ``q, q2``, with the least number of steps.

    Each round joins the newest states to the edges and keeps what is new, until there is nothing new.

    :param rounds: stop after so many steps; None: at the closure.
    """
    hops = edges.select("q", "q2").distinct()
    seen, k = start.select("q", F.lit(0).alias("steps")), 0
    while rounds is None or k < rounds:
        k += 1
        found = seen.where(F.col("steps") == k - 1).join(hops, "q").select(F.col("q2").alias("q")).distinct()
        new = found.join(seen.select("q"), "q", "left_anti").select("q", F.lit(k).alias("steps"))
        if rounds is None:
            # the states are the automaton's, not the corpus's: each round's are cut from the plan before them
            held = new.collect()
            if not held:
                break
            new = edges.sparkSession.createDataFrame(held, new.schema).coalesce(1)
        seen = seen.union(new)
    return seen


def advanced(mass: DataFrame, edges: DataFrame) -> DataFrame:
    """One step of a distribution ``q, p, v`` over weighted edges ``q, q2, p, c``: chance and expected count."""
    moved = mass.select("q", F.col("p").alias("p0"), F.col("v").alias("v0")).join(edges, "q")
    return moved.groupBy(F.col("q2").alias("q")).agg(F.sum(F.col("p0") * F.col("p")).alias("p"), F.sum(F.col("v0") * F.col("p") + F.col("p0") * F.col("p") * F.col("c")).alias("v"))


def edge_frame(spark: SparkSession, m: Automaton) -> DataFrame:
    """``q, seg_id, q2, c``: an automaton's edges with their counts. It is as large as a grammar makes it, not the corpus."""
    rows = [(q, s + 1, int(m.to[q, s]), m.out[q, s].tolist()) for q in range(m.states) for s in range(m.to.shape[1])]
    return spark.createDataFrame(rows, "q int, seg_id int, q2 int, c array<long>").coalesce(1)


def end_frame(spark: SparkSession, m: Automaton) -> DataFrame:
    """``q, c``: the counts at a word's end in each state."""
    return spark.createDataFrame([(q, m.end[q].tolist()) for q in range(m.states)], "q int, c array<long>").coalesce(1)


def masses(edges: DataFrame, ends: DataFrame, weights: Sequence[float], longest: int, scale: float = 1.0) -> DataFrame:
    """``len, z, v0, v1, ..``: for each length up to ``longest``, the sum of exp(-weights . counts) over all words from state 0, and the
    same with each count.

    States of all lengths below a power of two are moved on by that many segments at once, and the matrix that moves them is
    squared: as many rounds as the greatest length has bits, each a join and a sum, written before the next.

    :param scale: each segment's weight is divided by it, so that long words' sums stay in range.
    """
    names = range(len(weights))
    vs = [f"v{i}" for i in names]
    weight = F.exp(-dot(F.array(*map(F.lit, weights)).cast("array<double>"), F.col("c")))
    sums = [F.sum("p").alias("p"), *[F.sum(v).alias(v) for v in vs]]

    def counted(df: DataFrame, *keys: str, by: float = 1.0) -> DataFrame:
        held = df.withColumn("p", weight / F.lit(by))
        return held.withColumns({v: F.col("p") * F.get("c", F.lit(i)) for i, v in enumerate(vs)}).groupBy(*keys).agg(*sums)

    def times(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        """Products of chances with their sums of counts: what ends in a state goes on from it."""
        a = left.select(*keys, F.col("q2").alias("_at"), F.col("p").alias("_p"), *[F.col(v).alias(f"_{v}") for v in vs])
        moved = a.join(right.withColumnRenamed("q", "_q"), F.col("_at") == F.col("_q")).select(*keys, "q2", (F.col("_p") * F.col("p")).alias("p"), *[(F.col("_p") * F.col(v) + F.col(f"_{v}") * F.col("p")).alias(v) for v in vs])
        return moved.groupBy(*keys, "q2").agg(*sums)

    spark = edges.sparkSession
    power, step = written(counted(edges, "q", "q2", by=scale), "power", 1), 1
    zero = [F.lit(0.0).alias(v) for v in vs]
    held = written(spark.range(1).select(F.lit(0).alias("len"), F.lit(0).alias("q2"), F.lit(1.0).alias("p"), *zero), "masses", 1)
    while step <= longest:
        more = times(held, power, "len").withColumn("len", F.col("len") + step)
        held = written(held.unionByName(more).where(F.col("len") <= longest), "masses", 1)
        step *= 2
        if step <= longest:
            power = written(times(power, power, "q"), "power", 1)
    stop = counted(ends, "q").select(F.col("q").alias("q2"), F.col("p").alias("_p"), *[F.col(v).alias(f"_{v}") for v in vs])
    full = held.join(F.broadcast(stop), "q2").select("len", (F.col("p") * F.col("_p")).alias("z"), *[(F.col(v) * F.col("_p") + F.col("p") * F.col(f"_{v}")).alias(v) for v in vs])
    return full.groupBy("len").agg(F.sum("z").alias("z"), *[F.sum(v).alias(v) for v in vs])


def renumbered(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``old, new``: the states that ``start(q)`` reaches, numbered from 0 by the least number of steps and then by the old number."""
    by = Window.orderBy("steps", "q")  # an automaton's states, which the grammar bounds
    return reachable(edges, start).select(F.col("q").alias("old"), (F.row_number().over(by) - 1).alias("new"))


def piecewise(words: DataFrame, m: Automaton, piece: int = 1024, fan: int = 64) -> DataFrame:
    """``id, count`` of the first count of an automaton over words ``id, word`` of any length, each word dealt over tasks.

    What a piece does is a function from the state before it to the state after it and the count in between. Such functions are
    composed, ``fan`` neighbours at a time, until one is left for each word; no row holds more than a piece or so many functions.
    """
    n, states = m.to.shape[1], m.states
    to, out, end = (F.array(*[F.lit(int(x)) for x in t.ravel()]) for t in (m.to, m.out[:, :, 0], m.end[:, 0]))
    every = F.sequence(F.lit(0), F.lit(states - 1))

    def step(held: Column, s: Column) -> Column:
        at = held["q"] * n + s - 1
        return F.struct(F.get(to, at).alias("q"), (held["k"] + F.get(out, at)).alias("k"))

    start = lambda q: F.struct(q.cast("int").alias("q"), F.lit(0).alias("k"))
    top = words.agg(F.max(F.size("word"))).first()[0] or 0
    cut = words.where(F.size("word") > 0).select("id", "word", F.posexplode(F.sequence(F.lit(1), F.size("word"), F.lit(piece))).alias("at", "i"))
    parts = cut.select("id", "at", F.slice("word", F.col("i"), F.lit(piece)).alias("part"))
    # pieces are dealt anew, so that those of one word are not worked out where the word lies
    dealt = parts.repartition("id", "at") if top > piece else parts
    held = dealt.select("id", "at", F.transform(every, lambda q: F.aggregate("part", start(q), step)).alias("f"))
    left = -(-top // piece)
    while left > 1:
        grouped = held.groupBy("id", F.floor(F.col("at") / fan).cast("int").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("run"))
        after = lambda h, x: F.transform(h, lambda y: F.struct(F.get(x["f"], y["q"])["q"].alias("q"), (y["k"] + F.get(x["f"], y["q"])["k"]).alias("k")))
        held = grouped.select("id", "at", F.aggregate("run", F.transform(every, start), after).alias("f"))
        left = -(-left // fan)
    of = F.get("f", F.lit(0))
    return held.select("id", (of["k"] + F.get(end, of["q"])).alias("count"))

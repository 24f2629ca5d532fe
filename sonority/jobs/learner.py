"""Learning a grammar from a corpus.

The corpus is read once, into a written lexicon, and that once, into n-gram totals, which the feature table bounds. Candidates
are a table; so are their counts in the corpus, and in each round those in a sample that is drawn and counted in tasks. Between
two acceptances the sample doesn't change, so the next accepted candidate is the first in order whose score is under the
threshold: one row reaches the driver. Only the weights are fitted there.

Each accepted rule is appended to a table, from which others may read while learning goes on, and from which a learner that was
stopped goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonority.functions.automata import counter, nothing, product
from sonority.functions.classes import Settings, candidates, class_frame, class_list, core, membership
from sonority.functions.features import FeatureTable
from sonority.functions.globs import Glob, Part, parse_class, parse_glob
from sonority.functions.grammar import Grammar, fit_weights, sampled_frame
from sonority.functions.segments import length_frequencies
from sonority.functions.stats import upper_ratio
from sonority.functions.violations import class_sums, family_totals, of_globs
from sonority.sources.tables import forget, stored, written

THRESHOLDS, SAMPLES = (0.01, 0.1, 0.2, 0.3), 3000
#: A row of the table of rules: its number, the threshold and the candidate's place when it was accepted, its count in the corpus, all
#: weights so far, and a mark of what is learnt from and how.
RULE = "round int, threshold double, ordinal long, glob string, observed double, weights array<double>, setup string"


class Families:
    """All candidates of ``settings``, numbered from 1 in the order in which they are tried."""

    def __init__(self, spark: SparkSession, table: FeatureTable, settings: Settings) -> None:
        self.table, self.settings, self.classes = table, settings, class_list(table)
        self.far = core(table, list(settings.broken)) if settings.broken is not None else []
        self.member = membership(class_frame(spark, table), len(table.segments))
        place = {name: i for i, (name, _) in enumerate(self.far)}
        between = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])[F.col("l2")] if place else F.lit(None).cast("int")
        edge = F.when(F.col("final"), "f").otherwise("i")
        kind = F.create_map(*map(F.lit, ("single", "1", "edge", "1", "bigram", "2", "edge_bigram", "2", "trigram", "3", "long_distance", "far")))[F.col("family")]
        key = F.when(F.col("final").isNotNull(), F.concat(kind, edge)).otherwise(kind)
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
        far = F.col("family") == "long_distance"
        found = candidates(spark, table, settings).select(F.col("ordinal").cast("long").alias("ordinal"), key.alias("kind"), "c1", zero(F.when(far, between).otherwise(F.col("c2"))).alias("c2"), zero(F.col("c3")).alias("c3"))
        self.rows = written(found, "candidates")
        self.count = self.rows.count()

    def counts(self, words: DataFrame) -> DataFrame:
        """``ordinal, n`` of all candidates in a lexicon ``word, freq``."""
        totals = family_totals(words, self.settings.edges, self.settings.trigrams is not None, [m for _, m in self.far])
        sums = class_sums(totals, self.member, class_frame(words.sparkSession, self.table) if self.far else None)
        return self.rows.join(sums, ["kind", "c1", "c2", "c3"], "left").select("ordinal", F.coalesce("n", F.lit(0)).cast("double").alias("n"))

    def glob(self, ordinal: int) -> Glob:
        r = self.rows.where(F.col("ordinal") == ordinal).first()
        name = lambda c: self.classes[c - 1][2]
        if r["kind"] == "far":
            parts, repeat = [name(r["c1"]), self.far[r["c2"]][0], name(r["c3"])], ["", "+", ""]
        else:
            parts = [name(c) for c in (r["c1"], r["c2"], r["c3"]) if c]
            repeat = [""] * len(parts)
        return Glob(r["kind"].endswith("i"), r["kind"].endswith("f"), tuple(Part(x, *parse_class(p)) for x, p in zip(repeat, parts)))


class Listed:
    """Any list of globs as candidates, numbered from 1 and tried in its order; of equal ones the first."""

    def __init__(self, table: FeatureTable, globs: Iterable[Glob]) -> None:
        self.table, self.globs = table, list(globs)
        self.count = len(self.globs)

    def counts(self, words: DataFrame) -> DataFrame:
        """All in one pass over the lexicon."""
        first = {}
        for i, g in enumerate(self.globs, 1):
            first.setdefault(str(g), (f"g{i}", g))
        if not first:
            return words.sparkSession.createDataFrame([], "ordinal long, n double")
        found = of_globs(words, dict(first.values()), self.table)
        return found.select(F.substring("name", 2, 9).cast("long").alias("ordinal"), F.col("violations").cast("double").alias("n"))

    def glob(self, ordinal: int) -> Glob:
        return self.globs[ordinal - 1]


def check_thresholds(thresholds: Iterable[float]) -> list[float]:
    out = [float(t) for t in thresholds]
    if any(b <= a for a, b in zip(out, out[1:])) or any(t >= 1 for t in out):
        raise ValueError("thresholds must ascend and be under one")
    return out


def salad_lexicon(words: DataFrame) -> DataFrame:
    """Sampled words as a lexicon."""
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def published(spark: SparkSession, state: str) -> DataFrame:
    """The rules that a learner has appended to ``state`` so far, each with its newest weight: ``round, threshold, glob, observed, weight``."""
    rows = stored(spark, state, RULE)
    newest = rows.agg(F.max_by("weights", "round").alias("newest"))
    return rows.crossJoin(F.broadcast(newest)).select("round", "threshold", "glob", "observed", F.get("newest", F.col("round") - 1).alias("weight"))


def learn(
    words: DataFrame, table: FeatureTable, settings: Settings = Settings(), thresholds: Iterable[float] = THRESHOLDS, samples: int = SAMPLES, most_rules: int | None = None, seed: int = 1,
    on_rule: Callable[[Grammar], None] | None = None, candidates: Iterable[Glob] | None = None, on_progress: Callable[[float, int, int], None] | None = None, state: str | None = None,
) -> Grammar:
    """Learn a grammar from a lexicon ``word, freq``.

    Each accepted rule is given to ``on_rule``; an interrupt returns the grammar so far.

    :param candidates: the globs to try, in order; None: the families of ``settings``.
    :param on_progress: told the threshold, how many candidates have been passed under it, and how many there are: after each
        rule and at the end of each pass.
    :param state: a folder to which each accepted rule is appended. Rules that are there already are taken up and learning goes on
        after the last one; those of another corpus, table, sample or list of candidates are refused.
    """
    limits, spark = check_thresholds(thresholds), words.sparkSession
    held = written(words.select("word", "freq"), "lexicon")
    lengths = {r["len"]: r["n"] for r in length_frequencies(held).collect()}
    total = sum(lengths.values())
    if not total:
        raise ValueError("the lexicon is empty")
    tried = None if candidates is None else list(candidates)
    found = Families(spark, table, settings) if tried is None else Listed(table, tried)
    size, tell = len(table.segments), on_progress or (lambda *_: None)
    number = np.array([lengths.get(k, 0) for k in range(max(lengths) + 1)], float)
    number[0] = 0
    told = repr((table.csv(), settings, limits, samples, seed, sorted(lengths.items()), None if tried is None else list(map(str, tried))))
    setup = hashlib.sha256(told.encode()).hexdigest()
    observed = written(found.counts(held).withColumnRenamed("n", "observed"), "observed")
    machine, weights, counts = nothing(size), np.zeros(0), np.zeros(0)
    grammar, chosen, limit, cursor = Grammar({k: n for k, n in lengths.items() if k > 0}), [], limits[0] if limits else 0.0, 0

    def take(rule: Glob, ordinal: int, n: float) -> None:
        nonlocal machine, counts
        machine = product(machine, counter(rule.initial, rule.final, rule.sets(table), size))
        counts = np.append(counts, n)
        grammar.rules.append(rule)
        chosen.append(ordinal)

    for r in stored(spark, state, RULE).orderBy("round").collect() if state else []:
        if r["setup"] != setup:
            raise ValueError("the rules in the state's folder were learnt from something else, or in another way")
        take(parse_glob(r["glob"]), r["ordinal"], r["observed"])
        weights, limit, cursor = np.array(r["weights"]), r["threshold"], r["ordinal"]
        grammar.weights = weights.tolist()

    scores, of = None, -1
    try:
        for limit in [x for x in limits if x >= limit]:
            while most_rules is None or len(grammar.rules) < most_rules:
                if of != len(grammar.rules):
                    # a sample belongs to a number of rules, so a learner that goes on draws the same one
                    drawn = salad_lexicon(sampled_frame(spark, grammar, table, samples, seed + len(grammar.rules)))
                    expected = found.counts(drawn).select("ordinal", (F.col("n") * total / samples).alias("expected"))
                    if scores is not None:
                        forget(scores)
                    scored = observed.join(expected, "ordinal").select("ordinal", "observed", upper_ratio(F.col("observed"), F.col("expected")).alias("score"))
                    scores, of = written(scored, "scores"), len(grammar.rules)
                ahead = scores.where((F.col("score") < limit) & (F.col("ordinal") > cursor) & ~F.col("ordinal").isin(chosen))
                best = ahead.agg(F.min("ordinal").alias("ordinal"), F.min_by("observed", "ordinal").alias("observed")).first()
                if best["ordinal"] is None:
                    tell(limit, found.count, found.count)
                    break
                cursor = best["ordinal"]
                tell(limit, cursor - 1, found.count)
                take(found.glob(cursor), cursor, best["observed"])
                weights = fit_weights(machine, number, counts, np.append(weights, 0.0))
                grammar.weights = weights.tolist()
                if state:
                    row = (len(chosen), limit, cursor, str(grammar.rules[-1]), float(best["observed"]), grammar.weights, setup)
                    spark.createDataFrame([row], RULE).coalesce(1).write.mode("append").parquet(state)
                if on_rule:
                    on_rule(grammar)
            cursor = 0
    except KeyboardInterrupt:
        # a rule whose weight was not fitted yet doesn't count
        grammar.rules = grammar.rules[: len(grammar.weights)]
    return grammar

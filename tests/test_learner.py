"""The learner against a brute-force one: candidates listed and counted one by one."""

import random
from itertools import product as words_of

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonority.functions import automata, classes, grammar, stats
from sonority.functions.features import FeatureTable
from sonority.functions.globs import Glob, Part, parse_class, parse_glob
from sonority.jobs import learner
from sonority.sources import tables

SMALL = FeatureTable.parse(",a,n,t\nvowel,+,-,-\nnasal,0,+,-\n")
EVERY = classes.Settings(True, ("vowel",), ("vowel",))


def listed(table, settings):
    """All candidates in their order, as globs."""
    held = classes.class_list(table)
    size = {name: mask.bit_count() for mask, _, name in held}
    inv = {name: i for _, i, name in held}
    names = [name for _, _, name in held]
    glob = lambda parts, repeat=("", "", ""), initial=False, final=False: Glob(initial, final, tuple(Part(r, *parse_class(p)) for p, r in zip(parts, repeat)))
    out = []

    def put(rows):
        out.extend(g for _, g in sorted(rows, key=lambda x: x[0]))

    single = [n for n in names if not inv[n]]
    pairs = [(a, b) for a, b in words_of(names, repeat=2) if not (inv[a] and inv[b])]
    put([(-size[n], glob([n])) for n in single])
    if settings.edges:
        put([(-size[n], glob([n], initial=not f, final=f)) for n in single for f in (True, False)])
    put([(-size[a] - size[b], glob([a, b])) for a, b in pairs])
    if settings.edges:
        put([(-size[a] - size[b], glob([a, b], initial=not f, final=f)) for a, b in pairs for f in (True, False)])
    if settings.trigrams is not None:
        core = {n for n, _ in classes.core(table, list(settings.trigrams))}
        rows = []
        for a, b, c in words_of(names, repeat=3):
            if inv[a] + inv[b] + inv[c] <= 1 and {a, b, c} & core:
                weight = size[b] + size[c] if a in core else size[a] + size[c] if b in core else size[a] + size[b]
                rows.append((-weight, glob([a, b, c])))
        put(rows)
    if settings.broken is not None:
        core = [n for n, _ in classes.core(table, list(settings.broken))]
        put([(-size[a] - size[c], glob([a, b, c], ("", "+", ""))) for a in names for b in core for c in names])
    return out


def counted(globs, table, words):
    """Globs of plain parts by looking at each different run of segments once, others by running their automata over each word."""
    runs, out = {}, []
    for w, n in words:
        for size in (1, 2, 3):
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                runs[key] = runs.get(key, 0) + n
    for g in globs:
        sets = g.sets(table)
        if g.initial or g.final or any(rep for rep, _ in sets) or len(sets) > 3:
            m = automata.counter(g.initial, g.final, sets, len(table.segments))
            out.append(sum(int(m.count([s - 1 for s in w])[0]) * n for w, n in words))
        else:
            out.append(sum(n for key, n in runs.items() if len(key) == len(sets) and all(mask >> s - 1 & 1 for s, (_, mask) in zip(key, sets))))
    return np.array(out, float)


def brute(words, table, settings, thresholds, samples, seed, most_rules=None, candidates=None):
    """One candidate after another, as the method is told: below the threshold it is taken, the weights fitted, a sample drawn."""
    globs = listed(table, settings) if candidates is None else candidates
    observed, total = counted(globs, table, words), sum(n for _, n in words)
    lengths = {}
    for w, n in words:
        lengths[len(w)] = lengths.get(len(w), 0) + n
    number = np.array([lengths.get(k, 0) for k in range(max(lengths) + 1)], float)
    number[0] = 0
    g, weights, taken = grammar.Grammar(lengths), np.zeros(0), []

    def scores():
        salad = grammar.word_salad(g.automaton(table), weights, lengths, samples, seed + len(g.rules))
        return stats.upper_ratio_of(observed, counted(globs, table, [([int(s) + 1 for s in w], 1) for w in salad]) * total / samples)

    now = scores()
    for limit in thresholds:
        for i in range(len(globs)):
            if now[i] < limit and str(globs[i]) not in {str(r) for r in g.rules} and (most_rules is None or len(g.rules) < most_rules):
                g.rules.append(globs[i])
                taken.append(i)
                weights = grammar.fit_weights(g.automaton(table), number, observed[taken], np.append(weights, 0.0))
                g.weights = weights.tolist()
                now = scores()
    return g


def lexicon(spark, words):
    return spark.createDataFrame(words, "word array<int>, freq int")


def corpus(seed, n=60):
    chance, held = random.Random(seed), {}
    for _ in range(n):
        w = tuple(chance.choice([2, 3]) if i % 2 else 1 for i in range(chance.randint(1, 6)))
        held[w] = held.get(w, 0) + chance.randint(1, 30)
    return [(list(w), n) for w, n in sorted(held.items())]


def test_candidates_and_their_counts(spark):
    words = [(w, n) for (w, n) in corpus(3)] + [([2, 2, 3], 5), ([3, 1, 1, 1, 2], 2)]
    found, globs = learner.Families(spark, SMALL, EVERY), listed(SMALL, EVERY)
    assert found.count == len(globs)
    got = {r["ordinal"]: r["n"] for r in found.counts(lexicon(spark, words)).collect()}
    assert sorted(got) == list(range(1, len(globs) + 1)) and [got[i + 1] for i in range(len(globs))] == counted(globs, SMALL, words).tolist()
    for i in random.Random(1).sample(range(len(globs)), 25):
        assert str(found.glob(i + 1)) == str(globs[i])


@pytest.mark.parametrize(("seed", "settings"), [(1, classes.Settings()), (2, EVERY)])
def test_learner_to_its_end_equals_brute_force(spark, seed, settings):
    words, limits = corpus(seed), (0.05, 0.2)
    want = brute(words, SMALL, settings, limits, 400, 7)
    got = learner.learn(lexicon(spark, words), SMALL, settings, limits, 400, seed=7)
    assert [str(r) for r in got.rules] == [str(r) for r in want.rules] and len(got.rules) > 1
    assert np.allclose(got.weights, want.weights) and got.lengths == want.lengths


def test_listed_candidates_equal_brute_force(spark):
    words = corpus(5)
    tried = [parse_glob(x) for x in ("[+vowel]", "[−vowel][−vowel]", "[−vowel][−vowel]", "[+vowel]₁[+nasal]", "#[−vowel]", "[+vowel][]₁[+nasal]#")]
    want = brute(words, SMALL, None, (0.1, 0.3), 300, 1, candidates=tried)
    got = learner.learn(lexicon(spark, words), SMALL, thresholds=(0.1, 0.3), samples=300, candidates=tried)
    assert [str(r) for r in got.rules] == [str(r) for r in want.rules] and np.allclose(got.weights, want.weights)


class Stopped(Exception):
    pass


def test_a_learner_that_was_stopped_goes_on(spark, tmp_path):
    words, state = lexicon(spark, corpus(2)), str(tmp_path / "rules")
    how = dict(settings=classes.Settings(edges=True), thresholds=(0.05, 0.2), samples=300, seed=3)
    whole = learner.learn(words, SMALL, **how)
    assert len(whole.rules) > 2
    assert learner.published(spark, state).count() == 0

    def stop(g):
        if len(g.rules) == 2:
            raise Stopped

    with pytest.raises(Stopped):
        learner.learn(words, SMALL, **how, state=state, on_rule=stop)
    told = learner.published(spark, state).orderBy("round").collect()
    assert [r["glob"] for r in told] == [str(r) for r in whole.rules[:2]] and all(r["weight"] is not None for r in told)
    again = learner.learn(words, SMALL, **how, state=state)
    assert again.text() == whole.text() and again.weights == whole.weights
    assert [r["round"] for r in learner.published(spark, state).orderBy("round").collect()] == list(range(1, len(whole.rules) + 1))
    # all is there: nothing is learnt again
    assert learner.learn(words, SMALL, **how, state=state).weights == whole.weights
    assert tables.stored(spark, state, learner.RULE).count() == len(whole.rules)
    with pytest.raises(ValueError):
        learner.learn(words, SMALL, **{**how, "seed": 4}, state=state)


def test_an_interrupt_returns_the_rules_so_far(spark):
    def interrupt(g):
        if len(g.rules) == 1:
            raise KeyboardInterrupt

    got = learner.learn(lexicon(spark, corpus(2)), SMALL, samples=200, on_rule=interrupt)
    assert len(got.rules) == len(got.weights) == 1


def test_the_corpus_is_read_once(spark, tmp_path):
    """Learning reads the written lexicon; the words' own source may go away."""
    path = str(tmp_path / "words")
    lexicon(spark, corpus(2)).write.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    words = spark.read.parquet(path).mapInArrow(count, "word array<int>, freq int").withColumn("freq", F.col("freq").cast("long"))
    learner.learn(words, SMALL, samples=100, most_rules=1)
    assert seen.value == len(corpus(2))


def test_query_learns_to_the_end_as_brute_force(spark, sf_dir):
    from sonority.jobs import grammars
    from sonority.jobs.corpus import words

    held = [(list(r["word"]), r["freq"]) for r in words(spark, sf_dir).collect()]
    want = brute(held, grammars.BROAD, classes.Settings(), learner.THRESHOLDS, learner.SAMPLES, 1)
    got = grammars.QUERIES["learn_small"](spark, sf_dir).orderBy("ordinal").collect()
    assert [r["glob"] for r in got] == [str(r) for r in want.rules] and np.allclose([r["weight"] for r in got], want.weights)

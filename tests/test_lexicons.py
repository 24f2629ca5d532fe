"""Kept, edited and ordered lexicons, masses of long words, words in pieces."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonority.functions import automata, lexicons, segments, stats
from sonority.functions.features import FeatureTable
from sonority.functions.globs import parse_glob
from sonority.functions.grammar import Grammar

SMALL = FeatureTable.parse(",a,n,t\nvowel,+,-,-\nnasal,0,+,-\n")
CHANGE = "k long, v string, seq long, op string"


def replayed(base, log):
    """One change after another."""
    rank = {"delete": 0, "insert": 1, "update": 1}
    known = [c for c in log if c[0] is not None and c[2] is not None and c[3] in rank]
    held = dict(base)
    for k, v, _, op in sorted(known, key=lambda c: (c[2], rank[c[3]], c[1] is not None, c[1] or "")):
        if op == "delete":
            held.pop(k, None)
        else:
            held[k] = v
    return sorted(held.items())


def test_changes_one_after_another(spark):
    chance = random.Random(4)
    base = [(k, f"b{k}") for k in range(20)]
    log = [(chance.choice([*range(30), None]), chance.choice(["x", "y", None]), chance.choice([*range(40), None]), chance.choice(["insert", "update", "delete", "other", None])) for _ in range(300)]
    log += [(7, f"hot{i}", 1000 + i, "update") for i in range(2000)] + [(8, None, 5000, "delete"), (8, "tie", 5000, "insert")]
    b, c = spark.createDataFrame(base, "k long, v string"), spark.createDataFrame(log, CHANGE)
    got = lexicons.merged(b, c.repartition(7), ["k"])
    assert sorted((r["k"], r["v"]) for r in got.collect()) == replayed(base, log)
    assert lexicons.merged(b, c.where("false"), ["k"]).count() == 20 and lexicons.merged(b.where("false"), c.where("op = 'delete'"), ["k"]).count() == 0
    once = lexicons.merged(lexicons.merged(b, c, ["k"]), c, ["k"])
    assert sorted((r["k"], r["v"]) for r in once.collect()) == replayed(base, log)


def test_a_kept_source_is_read_without_the_text(spark, tmp_path):
    spark.createDataFrame([("Tanna an",), ("an ta'n xx",), (None,)], "text string").write.parquet(str(tmp_path / "texts"))
    docs = spark.read.parquet(str(tmp_path / "texts"))
    digraph = FeatureTable.parse(",a,n,t,an\nvowel,+,-,-,+\n")
    lines = spark.createDataFrame([("an\t3",), ("an\t3",), ("ta",), ("zz\t9",)], "value string")
    own = spark.createDataFrame([([1, 2], 5), ([4], 2)], "word array<int>, freq int")
    source = lexicons.kept(lexicons.of_text(docs), lexicons.of_list(lines), lexicons.of_edits(own, digraph))

    def read(table):
        found = lexicons.resegmented(source, table)
        assert "texts" not in found._jdf.queryExecution().toString()
        return {(r["kind"], "".join(table.segments[i - 1] + "." for i in r["word"])): r["freq"] for r in found.collect()}

    # the hand-made words keep the parts they had: a and n apart, and the digraph as one
    assert read(digraph) == {("text", "t.an.n.a."): 1, ("text", "an."): 2, ("text", "t.a.n."): 1, ("list", "an."): 6, ("list", "t.a."): 1, ("custom", "a.n."): 5, ("custom", "an."): 2}
    assert read(SMALL) == {("text", "t.a.n.n.a."): 1, ("text", "a.n."): 2, ("text", "t.a.n."): 1, ("list", "a.n."): 6, ("list", "t.a."): 1, ("custom", "a.n."): 7}


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_places(spark, rows):
    chance = random.Random(rows)
    keys = chance.sample(range(10_000), rows)
    df = spark.createDataFrame([([k // 100, k % 100], k) for k in keys], "word array<int>, k long").repartition(5)
    got = {r["k"]: r["place"] for r in lexicons.placed(df, "word").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), 1)}


def test_masses_of_all_lengths(spark):
    rules = ["[−vowel][−vowel]", "#[+nasal]", "[+vowel][]₁[+vowel]", "[+nasal]#"]
    g = Grammar({1: 1}, [parse_glob(r) for r in rules], [0.7, 1.1, 0.2, 0.4])
    m = g.automaton(SMALL)
    for longest in (0, 1, 2, 7, 13):
        z, e = automata.expectations(m, np.array(g.weights), longest)
        rows = automata.masses(automata.edge_frame(spark, m), automata.end_frame(spark, m), g.weights, longest, 3.0).orderBy("len").collect()
        assert [r["len"] for r in rows] == list(range(longest + 1))
        assert np.allclose([r["z"] * 3.0 ** r["len"] for r in rows], z) and np.allclose([[r[f"v{i}"] * 3.0 ** r["len"] for i in range(4)] for r in rows], e)


def test_renumbered_states(spark):
    edges = spark.createDataFrame([(5, 9), (5, 2), (2, 7), (9, 7), (7, 5), (1, 5), (2, 2)], "q int, q2 int")
    got = automata.renumbered(edges, spark.createDataFrame([(5,)], "q int"))
    assert {r["old"]: r["new"] for r in got.collect()} == {5: 0, 2: 1, 9: 2, 7: 3}


@pytest.mark.parametrize(("piece", "fan"), [(1, 2), (7, 3), (1000, 64)])
def test_words_in_pieces(spark, piece, fan):
    chance = random.Random(piece)
    words = [[chance.randint(1, 3) for _ in range(chance.choice([1, 2, 7, 8, 30, 400]))] for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(words)), "id long, word array<int>")
    for text in ("[+vowel][−vowel]₁[+vowel]", "#[+nasal]…[−vowel]#"):
        g = parse_glob(text)
        m = automata.counter(g.initial, g.final, g.sets(SMALL), 3)
        got = {r["id"]: r["count"] for r in automata.piecewise(df, m, piece, fan).collect()}
        assert got == {i: int(m.count([s - 1 for s in w])[0]) for i, w in enumerate(words)}


def test_triples_are_all_choices(spark):
    words = [([1, 2, 1, 3, 2], 2), ([1], 5), ([3, 3, 3], 1)]
    got = {(r["s1"], r["s2"], r["s3"]): r["n"] for r in segments.triples(spark.createDataFrame(words, "word array<int>, freq int").withColumn("freq", F.col("freq").cast("long"))).collect()}
    want = {}
    for w, n in words:
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, len(w)):
                    want[w[i], w[j], w[k]] = want.get((w[i], w[j], w[k]), 0) + n
    assert got == want


def test_certificate_tells_best_weights_from_others(spark):
    from sonority.functions import grammar

    rules = {"a": parse_glob("[−vowel][−vowel]"), "b": parse_glob("[+nasal]#"), "c": parse_glob("[+vowel]")}
    words = [([1, 2, 1], 30), ([2, 1], 25), ([3, 1, 2], 8), ([2, 3], 2), ([1, 1, 3, 1], 12)]
    m = Grammar({1: 1}, list(rules.values()), [0.0] * 3).automaton(SMALL)
    number = np.zeros(5)
    for w, n in words:
        number[len(w)] += n
    counts = sum(m.count([s - 1 for s in w]) * n for w, n in words).astype(float)
    lengths = spark.createDataFrame([(k, int(n)) for k, n in enumerate(number)], "len int, n long")
    observed = spark.createDataFrame([(k, int(c)) for k, c in zip(rules, counts)], "name string, violations long")

    def told(weights):
        masses = automata.masses(automata.edge_frame(spark, m), automata.end_frame(spark, m), weights, 4, 3.0)
        return {r["name"]: r["optimal"] for r in grammar.certificate(masses, lengths, observed, dict(zip(rules, weights))).collect()}

    best = grammar.fit_weights(m, number, counts, np.zeros(3), 1e-6, 400, 1e-7).tolist()
    assert all(told(best).values()) and min(best) == 0.0 < max(best)
    assert not all(told([w + 0.5 for w in best]).values()) and not all(told([0.0, 0.0, 0.0]).values())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64])
def test_values_are_looked_up_by_halving(spark, n):
    chance = random.Random(n)
    bounds = sorted({round(chance.random(), 2) for _ in range(n)})
    cdf = spark.createDataFrame([(x, i) for i, x in enumerate(bounds)], "lo double, len int")
    values = [round(chance.random(), 2) for _ in range(40)] + bounds + [-1.0, 0.0, 2.0, None]
    got = stats.looked_up(spark.createDataFrame(list(enumerate(values)), "i int, u double"), "u", cdf, "len")
    want = {i: None if u is None else max((k for k, x in enumerate(bounds) if x <= u), default=None) for i, u in enumerate(values)}
    assert {r["i"]: r["len"] for r in got.collect()} == want

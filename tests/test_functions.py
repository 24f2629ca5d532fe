"""The functions on small fixtures, against definitions."""

import math
import random
import re
from collections import Counter
from itertools import combinations
from itertools import product as words_of

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonority.functions import automata, classes, grammar, segments, stats, violations
from sonority.functions.globs import Glob, Part, body, parse_class, parse_glob
from sonority.functions.features import LATIN, FeatureTable
from sonority.jobs import learner
from sonority.jobs.cli import run
from sonority.sources import files

SMALL = FeatureTable.parse(",a,n,t\nvowel,+,-,-\nnasal,0,+,-\n")


def test_feature_table_reads_cells_and_refuses_bad_tables():
    t = FeatureTable.parse(",a,ch\nx, +,+ \ny,✓,−\nragged,+\nx,-,0\n")
    assert t.states == (("+", "0"), ("+", "-"), ("-", "0")) and t.known()["x"] == 2
    assert FeatureTable.parse(t.csv()) == t
    for bad in ("", ",\n", ",a\n", ",a,a\nx,+,-\n"):
        with pytest.raises(ValueError):
            FeatureTable.parse(bad)
    assert SMALL.resegmented(["t", "q", "t"]).states == (("-", "0"), ("-", "0"))
    assert len(LATIN.segments) == 43 and all(len(r) == 43 for r in LATIN.states)


def test_classes_of_the_small_table(spark):
    expected = [(3, 0b111, "[]"), (2, 0b011, "[¬ −nasal]"), (2, 0b101, "[¬ +nasal]"), (2, 0b110, "[−vowel]"), (1, 0b001, "[+vowel]"), (1, 0b010, "[+nasal]"), (1, 0b100, "[−nasal]")]
    found = classes.by_generality(spark, SMALL).orderBy("class_id").collect()
    assert [(r["size"], r["mask"], r["label"]) for r in found] == expected
    assert [(m.bit_count(), m, l) for m, _, l in classes.class_list(SMALL)] == expected
    held = classes.by_generality(spark, SMALL)
    assert [f(held).count() for f in (classes.singles, classes.edge_singles, classes.bigrams, classes.edge_bigrams)] == [5, 10, 45, 90]
    every = classes.candidates(spark, SMALL, classes.Settings(True, ("vowel",), ("vowel",)))
    kinds = {r["family"]: r["count"] for r in every.groupBy("family").count().collect()}
    cores = classes.core(SMALL, ["vowel"])
    assert [c[0] for c in cores] == ["[]", "[+vowel]", "[−vowel]"] and kinds["long_distance"] == 7 * 7 * 3
    names, inv = [c[2] for c in classes.class_list(SMALL)], [c[1] for c in classes.class_list(SMALL)]
    core = {c[0] for c in cores}
    assert kinds["trigram"] == sum(inv[a] + inv[b] + inv[c] <= 1 and bool({names[a], names[b], names[c]} & core) for a, b, c in words_of(range(7), repeat=3))


def greedy(text, segs):
    usable, out, i = sorted((s for s in segs if s and s[0] != "'"), key=len, reverse=True), [], 0
    while i < len(text):
        if text[i] == "'":
            i += 1
            continue
        hit = next((s for s in usable if text.startswith(s, i)), None)
        out, i = (out + [hit], i + len(hit)) if hit else (out, i + 1)
    return out


def test_segments_are_the_longest_and_join_back(spark):
    segs, rng = ("a", "n", "t", "ch", "c", "h", "tch"), random.Random(5)
    texts = ["".join(rng.choice("anthc'x") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", segments.segmented(F.col("t"), segs)).withColumn("j", segments.joined(F.col("s"), segs))
    back = df.withColumn("b", segments.segmented(F.col("j"), segs)).collect()
    assert [r["s"] for r in back] == [greedy(t, segs) for t in texts]
    assert all(r["b"] == r["s"] for r in back)


def test_word_list(spark):
    segs = ("a", "n", "t", "ch")
    lines = ["an\t3", "tan", "ta\tx", "ta\t4 5", "ta\t-2", "zz", "c'h", "t'a", "cha", "", "an\t+5"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [(r["segs"], r["freq"]) for r in segments.word_list(df, segs).collect()]
    assert got == [(["a", "n"], 3), (["t", "a", "n"], 1), (["t", "a"], 1), (["t", "a"], 1), (["t", "a"], -2), (["t", "a"], 1), (["ch", "a"], 1), (["a", "n"], 1)]
    assert segments.word_list(df, segs, strict=True).count() == 5
    assert [r["value"] for r in segments.serialised(segments.word_list(df, segs), segs).collect()][:2] == ["an\t3", "tan"]


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "text string")
    words = segments.lexicon(empty, LATIN.segments)
    assert words.count() == 0 and segments.length_frequencies(words).count() == 0 and segments.ngrams(words, 2).count() == 0
    with pytest.raises(ValueError):
        learner.learn(words, LATIN)


def test_globs_read_and_show():
    for text in ("#CC", "V#", "[+a −b]₁", "[¬ +a]₀", "…[+nasal]", "#[]#"):
        assert str(parse_glob(text)) == text
    assert str(parse_glob("[^+a]+[b]*C")) == "[¬ +a]₁[+b]₀C"
    assert parse_class("[+a+b]") == (False, (("+", "a+b"),))
    for bad in ("", "#", "[a", "[1a]", "x"):
        with pytest.raises(ValueError):
            parse_glob(bad)


CASES = [("abbc", "a b+ c", 1), ("abcbc", "a b+ c", 1), ("aabbcc", "a b+ c", 1), ("abab", "a b+ c", 0), ("abab", "ab ab", 3), ("abbc", "ab ab", 2), ("aabbcc", "# a", 1), ("abab", "b #", 1), ("", "a", 0)]


def sets_of(text):
    parts = text.split()
    initial, final = parts[0] == "#", parts[-1] == "#"
    return initial, final, [(p[-1] if p[-1] in "+*" else "", sum(1 << "abc".index(x) for x in p.rstrip("+*"))) for p in parts if p != "#"]


@pytest.mark.parametrize(("word", "glob", "n"), CASES)
def test_counter_on_fixtures(word, glob, n):
    assert automata.counter(*sets_of(glob), 3).count(["abc".index(x) for x in word])[0] == n


parts = st.lists(st.tuples(st.sampled_from(["", "+", "*"]), st.integers(1, 7)), min_size=1, max_size=4)


@settings(max_examples=150, deadline=None)
@given(st.booleans(), st.booleans(), parts, st.lists(st.integers(0, 2), max_size=8))
def test_counter_counts_places_where_a_match_ends(initial, final, glob, word):
    text = "".join(chr(0xE001 + x) for x in word)
    pattern = re.compile(("^" if initial else "") + body(glob) + r"\Z")
    ends = [len(text)] if final else range(1, len(text) + 1)
    assert automata.counter(initial, final, glob, 3).count(word)[0] == sum(bool(pattern.search(text[:i])) for i in ends)


def a_glob(rng):
    part = lambda: Part(rng.choice(["", "+", "*"]), rng.random() < 0.2, tuple((rng.choice("+-"), f) for f in ("vowel", "nasal") if rng.random() < 0.5))
    return Glob(rng.random() < 0.3, rng.random() < 0.3, tuple(part() for _ in range(rng.randint(1, 3))))


def test_globs_count_as_the_automaton(spark):
    rng = random.Random(3)
    globs = {f"g{i}": a_glob(rng) for i in range(30)}
    words = [[rng.randint(1, 3) for _ in range(n)] for n in (1, 2, 3, 4, 5, 7, 9, 150, 400)]
    df = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word array<int>, freq int")
    got = {r["name"]: r["violations"] for r in violations.of_globs(df, globs, SMALL).collect()}
    for name, g in globs.items():
        if all(p.repeat == "*" for p in g.parts):
            continue
        m = automata.counter(g.initial, g.final, g.sets(SMALL), 3)
        assert got[name] == sum((k + 1) * int(m.count([s - 1 for s in w])[0]) for k, w in enumerate(words)), str(g)


def test_automata_together_and_folds():
    a, b = automata.counter(False, False, [("", 1), ("", 2)], 3), automata.counter(True, False, [("+", 4)], 3)
    for how in (lambda x, y: x and y, lambda x, y: x or y, lambda x, y: x != y):
        m = automata.together(a, b, how)
        for word in words_of(range(3), repeat=4):
            assert m.count(list(word))[0] == how(a.count(list(word))[0] > 0, b.count(list(word))[0] > 0)
    word = [0, 1, 0, 1, 2]
    assert a.fold(word, 0, lambda x, y: x + y, lambda q, s: int(a.out[q, s, 0]), lambda q: int(a.end[q, 0])) == a.count(word)[0]
    assert a.fold(word, "", lambda x, y: x + y, lambda q, s: "ant"[s], lambda q: "#") == "anant#"


def test_reachable_closes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (5, 6)], "q int, q2 int")
    start = spark.createDataFrame([(1,)], "q int")
    assert sorted(map(tuple, automata.reachable(edges, start).collect())) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert sorted(map(tuple, automata.reachable(edges, start, 1).collect())) == [(1, 0), (2, 1)]


def test_segmentation_stays_above_the_counts(spark):
    """Distinct words are segmented, not tokens: the stage that reads the text has no segmentation."""
    docs = spark.createDataFrame([("ana tan ana",)], "text string").repartition(2)
    plan = segments.lexicon(docs, SMALL.segments)._jdf.queryExecution().optimizedPlan().toString()
    inner = plan[plan.index("explode") :]
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in inner


def test_triples_of_long_words(spark):
    rng = random.Random(6)
    words = [[rng.randint(1, 4) for _ in range(n)] for n in (1, 2, 3, 5, 40)]
    df = spark.createDataFrame([(w, 2) for w in words], "word array<int>, freq int")
    expected = Counter()
    for w in words:
        expected.update({t: 2 * n for t, n in Counter(combinations(w, 3)).items()})
    assert {(r.s1, r.s2, r.s3): r.n for r in segments.triples(df).collect()} == dict(expected)


def test_expectations_of_the_small_table():
    m = automata.counter(False, False, [("", 0b110), ("", 0b110)], 3)
    for w, z, e in ((0, (3, 9, 27), (0, 0.444444, 0.888889)), (1, (3, 6.471518, 15.025718), (0, 0.227384, 0.339977)), (2, (3, 5.541341, 12.229207), (0, 0.097691, 0.112496))):
        got, sums = automata.expectations(m, np.array([w]), 3)
        assert np.allclose(got[1:], z, atol=1e-5) and np.allclose(sums[1:, 0] / got[1:], e, atol=1e-5)
    with pytest.raises(ValueError):
        automata.expectations(m, np.zeros(2), 3)


def test_product_counts_both():
    a, b = automata.counter(False, False, [("", 1), ("+", 2)], 3), automata.counter(False, True, [("", 4)], 3)
    both = automata.product(a, b)
    for word in words_of(range(3), repeat=4):
        assert both.count(list(word)).tolist() == [a.count(list(word))[0], b.count(list(word))[0]]
    with pytest.raises(ValueError):
        automata.product(a, automata.nothing(2))


def test_scores_and_strata(spark):
    for o, e, v in ((0, 10, 0.233868), (0, 100, 0.025902), (1, 100, 0.050959), (5, 50, 0.238146), (10, 5, 1), (0, 2000, 0.001310)):
        assert math.isclose(stats.upper_ratio_of([o], [e])[0], v, abs_tol=1e-6)
        assert math.isclose(spark.range(1).select(stats.upper_ratio(F.lit(o), F.lit(e))).first()[0], v, abs_tol=1e-6)
    assert stats.strata({1: 1, 2: 2, 3: 1}, 10) == {1: 2, 2: 6, 3: 2} and stats.strata({1: 1, 2: 1}, 5) == {1: 2, 2: 3}
    cdf = stats.cumulative(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 1.0), (4, 0.0)], "x int, m double"), "x", "m")
    assert {r["x"]: r["draws"] for r in stats.stratified(cdf, "x", 10).collect()} == {1: 2, 2: 6, 3: 2}


def test_gradient_is_the_slope_of_the_objective():
    m = automata.product(automata.counter(False, False, [("", 6), ("", 6)], 3), automata.counter(True, False, [("", 1)], 3))
    lengths, seen, w = np.array([0, 3, 5, 2.0]), np.array([2.0, 4.0]), np.array([0.7, 0.4])
    at, step = grammar.objective(m, lengths, seen), 1e-5
    for i in range(2):
        d = np.eye(2)[i]
        slope = (at(w + step * d)[0] - at(w - step * d)[0]) / (2 * step)
        assert math.isclose(slope, at(w)[1][i], abs_tol=1e-4) and math.isclose(slope, grammar.directional(m, lengths, seen, w, d), abs_tol=1e-4)
    best = grammar.fit_weights(m, lengths, seen, np.zeros(2))
    assert at(best)[0] <= min(at(w)[0], at(np.zeros(2))[0]) + 1e-6 and (best >= 0).all()


def test_samples_follow_the_weights():
    m = automata.counter(False, False, [("", 6), ("", 6)], 3)
    drawn = grammar.sample(m, np.array([1.0]), 2, np.arange(20000), 1)
    hits = ((drawn > 0).all(1)).mean()
    assert abs(hits - 4 * math.exp(-1) / (5 + 4 * math.exp(-1))) < 0.02
    assert (grammar.sample(m, np.array([1.0]), 2, np.arange(50, 60), 1) == drawn[50:60]).all()


def test_grammar_text():
    text = "# Length Distribution:\n[(1,2),(2,5),(2,1),(0,9)]\n\n# Constraints:\n1.500  [−vowel][−vowel]\n0.250  #[+nasal]\n2.000  [+vowel][]₁[+vowel]\n"
    g = grammar.Grammar.parse(text)
    assert g.lengths == {1: 2, 2: 6} and g.weights == [1.5, 0.25, 2.0] and grammar.Grammar.parse(g.text()) == g
    assert g.unknown_features(SMALL) == [] and grammar.Grammar({1: 1}, [parse_glob("[+x][+nasal]")], [1.0]).unknown_features(SMALL) == ["x"]
    for bad in ("[(1,2", "", "[]\n", "[(1,1)]\n[+a]", "[(1,1)]\n1.0  [a", "[(1,1)]\n1.0  ?"):
        with pytest.raises(ValueError):
            grammar.Grammar.parse(bad)


def test_learner_finds_what_the_corpus_avoids(spark):
    rng = random.Random(1)
    words = [[rng.choice([2, 3]) if i % 2 else 1 for i in range(rng.randint(2, 6))] for _ in range(400)]
    df = spark.createDataFrame([(w, 1) for w in words], "word array<int>, freq int").groupBy("word").agg(F.sum("freq").alias("freq"))
    seen = []
    g = learner.learn(df, SMALL, classes.Settings(edges=True), samples=500, most_rules=4, on_rule=lambda g: seen.append(len(g.rules)))
    assert seen == list(range(1, len(g.rules) + 1)) and "[−vowel][−vowel]" in {str(r) for r in g.rules} and all(w > 0 for w in g.weights[:1])
    with pytest.raises(ValueError):
        learner.check_thresholds([0.2, 0.1])
    # any candidates, in their order, with progress
    told, tried = [], [parse_glob(x) for x in ("[+vowel]", "[−vowel][−vowel]", "[+vowel]₁[+nasal]")]
    h = learner.learn(df, SMALL, samples=300, candidates=tried, on_progress=lambda *x: told.append(x))
    assert [str(r) for r in h.rules][:1] == ["[−vowel][−vowel]"] and told[-1] == (0.3, 3, 3)


def test_command_line(spark, tmp_path):
    (tmp_path / "words.txt").write_text("ana\t5\ntan\t7\nnat\t3\nata\t9\n", encoding="utf-8")
    (tmp_path / "table.csv").write_text(SMALL.csv(), encoding="utf-8")
    text = run(spark, ["-f", str(tmp_path / "table.csv"), "-n", "200", "-o", str(tmp_path / "g.txt"), "learn", str(tmp_path / "words.txt"), "--rules", "2"])
    assert text.startswith("# Length Distribution:") and (tmp_path / "g.txt").read_text(encoding="utf-8") == text
    out = run(spark, ["-f", str(tmp_path / "table.csv"), "-n", "50", "gibber", str(tmp_path / "g.txt"), "-s"])
    assert len(out.splitlines()) == 50
    files.write_word_list(spark.createDataFrame([(["a", "n"], 2)], "segs array<string>, freq int"), str(tmp_path / "out"), SMALL)
    assert files.read_word_list(spark, str(tmp_path / "out"), SMALL).first()["freq"] == 2


def test_padded_arrays_and_subsequences(spark):
    row = spark.range(1).select(segments.padded_sum(F.array(F.lit(1), F.lit(2)), F.array(F.lit(5))).alias("s"), segments.subsequences(F.array(*map(F.lit, (3, 1, 2))), 2).alias("p")).first()
    assert row["s"] == [6, 2] and sorted(map(tuple, row["p"])) == [(1, 2), (3, 1), (3, 2)]


def test_own_readers_and_writers(spark):
    table = FeatureTable.parse(",1,2\nhigh,+,-\n", read=lambda cell: {"1": "a", "2": "b"}[cell])
    assert table.segments == ("a", "b")
    docs = spark.createDataFrame([("a_b b_a",), ("a_b",)], "text string")
    held = segments.lexicon(docs, table.segments, read=lambda word: F.split(word, "_"))
    assert {(tuple(r["word"]), r["freq"]) for r in held.collect()} == {((1, 2), 2), ((2, 1), 1)}
    rows = held.select(segments.named(F.col("word"), table.segments).alias("segs"), "freq")
    assert {r["value"] for r in segments.serialised(rows, table.segments, write=lambda segs: F.array_join(segs, "_")).collect()} == {"a_b\t2", "b_a"}


def test_descent_with_another_objective_and_another_bound():
    goal, most = np.array([2.0, -1.0]), np.array([1.5, 5.0])

    def at(w):
        return float(((w - goal) ** 2 * [1, 4]).sum()), 2 * (w - goal) * [1, 4]

    free = grammar.descended(at, np.zeros(2), lambda w: (w, False), 1e-4)
    held = grammar.descended(at, np.zeros(2), lambda w: (np.minimum(w, most), bool((w > most).any())), 1e-4)
    assert np.allclose(free, goal, atol=0.02) and np.allclose(held, [1.5, -1.0], atol=0.02)
    assert len(grammar.descended(at, np.zeros(0))) == 0

"""The grouped prefix join against all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest

from sonority.llm import common, jaccard_join
from tests.llm.helpers import ODD, documents


def brute(rows, words=5, at_least=Fraction(4, 5)):
    held = []
    for doc, text, *_ in rows:
        w = (text or "").encode()
        w = [x.decode() for x in bytes(b + 32 if 65 <= b <= 90 else b for b in w).split()]
        held.append((doc, frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()))
    root = list(range(len(held)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(held)):
        for j in range(i):
            a, b = held[i][1], held[j][1]
            if a and b and len(a & b) >= at_least * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(held):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(((doc, len(s), least.get(top(i)) if s else doc) for i, (doc, s) in enumerate(held)), key=str)


def got(spark, rows, words=5, at_least=Fraction(4, 5)):
    return sorted((tuple(r) for r in jaccard_join.jaccard_classes(documents(spark, rows), words, at_least).collect()), key=str)


def mutated(seed, n, size, vocabulary, changes):
    """Families of texts: each of a base of its own with some words changed, and now and then a long shared passage."""
    chance, rows = random.Random(seed), []
    word = lambda: f"w{chance.randrange(vocabulary)}"
    shared = [word() for _ in range(size)]
    base = None
    for i in range(n):
        if i % 9 == 0:
            base = [word() for _ in range(chance.randint(size // 2, size))] + (shared if i % 2 else [])
        text = list(base)
        for _ in range(chance.randint(0, changes)):
            text[chance.randrange(len(text))] = word()
        rows.append((chance.randrange(10 * n), " ".join(text)))
    return rows


@pytest.mark.parametrize(("seed", "words", "at_least", "vocabulary", "changes"), [(1, 5, Fraction(4, 5), 5000, 3), (2, 1, Fraction(3, 5), 40, 14), (3, 2, Fraction(1, 2), 12, 8)])
def test_matches_all_pairs(spark, monkeypatch, seed, words, at_least, vocabulary, changes):
    # small blocks and few neighbours: the second round has most of the work
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "NEIGHBOURS", 1)
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 20)
    rows = mutated(seed, 150, 40, vocabulary, changes)
    assert got(spark, rows, words, at_least) == brute(rows, words, at_least)


def test_same_prefix_and_size_but_not_linked(spark, monkeypatch):
    """Members of one group that only the second round tells apart."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "prefix_length", lambda size, at_least: 3)
    monkeypatch.setattr(jaccard_join, "compatible", lambda n, m, at, other, at_least: np.ones(np.broadcast(n, m).shape, bool))
    rows = [(i, " ".join(["same"] + [f"{'abc'[i % 3]}{k}" for k in range(12)] + [f"x{i}"])) for i in range(30)]
    assert got(spark, rows, 1) == brute(rows, 1)


def test_copies_and_near_copies_in_thousands(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(700)] + [(1000 + i, " ".join([*base[: i % 119], f"y{i}", *base[i % 119 + 1 :]])) for i in range(700)] + [(5000, "quite another text of seven words here")]
    found = {doc: root for doc, _, root in got(spark, rows)}
    assert set(found.values()) == {0, 5000} and found[5000] == 5000


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n, m, common in [(1, 1, 1), (1, 1, 0), (5, 4, 4), (64, 65, 60), (100, 100, 89), (100, 101, 10), (1000, 900, 850), (3000, 1, 1), (2500, 2000, 0)]:
        all_of_them = rng.permutation(np.unique(rng.integers(0, 2**64, 9000, np.uint64, endpoint=False)))[: n + m - common]
        a, b = np.sort(all_of_them[:n]), np.sort(all_of_them[n - common :])
        assert len(np.intersect1d(a, b)) == common
        least = jaccard_join.apart(jaccard_join.sketch(a), jaccard_join.sketch(b))
        assert least <= n + m - 2 * common and least % 2 == (n + m) % 2
        assert least > (n + m) / 9 if n == 2500 or common == 10 else True
    assert jaccard_join.apart(jaccard_join.sketch(a), jaccard_join.sketch(a)) == 0


def test_whole_sets_are_made_only_where_a_link_is_possible(spark, monkeypatch):
    """Texts of one size that share a third of their words meet under many shingles; only the two that link are read again."""
    made, whole = [], jaccard_join.held_sets
    monkeypatch.setattr(jaccard_join, "held_sets", lambda wanted, *rest: made.append(wanted.count()) or whole(wanted, *rest))
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)
    shared = [f"s{k}" for k in range(70)]
    rows = [(i, " ".join([*shared, *(f"x{i}_{k}" for k in range(130))])) for i in range(40)]
    rows.append((50, rows[7][1] + " end"))
    assert got(spark, rows) == brute(rows)
    assert sum(made) == 2


def test_small_tables_are_not_shuffled(spark, monkeypatch):
    """Rounds over few rows have few stages of as many tasks as there are shuffle partitions."""
    conf = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    monkeypatch.setattr(jaccard_join, "NEIGHBOURS", 1)
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    rows = mutated(5, 150, 40, 40, 14)
    sc = spark.sparkContext
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("op13-stages", "")
        assert got(spark, rows, 1, Fraction(3, 5)) == brute(rows, 1, Fraction(3, 5))
        tracker = sc.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("op13-stages") for s in tracker.getJobInfo(j).stageIds]
        wide = sum(s is not None and s.numTasks == 23 and s.numCompletedTasks > 0 for s in stages)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert 0 < wide < 60


def test_tables_that_are_not_small(spark, monkeypatch):
    """All is shuffled and nothing is broadcast, as with many rows."""
    monkeypatch.setattr(common, "TASK_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard_join, "NEIGHBOURS", 1)
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    rows = mutated(6, 120, 40, 40, 14)
    assert got(spark, rows, 1, Fraction(3, 5)) == brute(rows, 1, Fraction(3, 5))


def test_odd_rows(spark):
    rows = ODD + [(20, "One TWO three four five six"), (21, "ÉÈ other words in the text now"), (22, "éè other words in the text now"), (23, "a b"), (23, "A  b"), (None, "a b"), (24, "a\x1cb")]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, " ")]) == [(1, 0, 1), (2, 0, 2)]


def test_query_matches_its_sql(spark, duck, sf_dir):
    found = sorted(map(tuple, jaccard_join.query(spark, sf_dir).select("component_id", "doc_id", "n_shingles").collect()))
    want = duck.execute(f"select component_id, doc_id, n_shingles from ({jaccard_join.SQL})").fetchall()
    assert found == sorted(want)

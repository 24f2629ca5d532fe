"""The trie of conversation prefixes against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sonority.llm import prefix_trie


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, role, tie, text))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        ends = ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(node))
        out.append((
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(n) == len(node) + 1 for n in below), sum(map(leaf, below)),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "'x' as node", "'x' as depth", "'x' as ups", "'x' as n_convs", "'x' as digest", "'x' as place")


@pytest.mark.parametrize("height", [2, 3, 8])
def test_matches_brute_force(spark, height):
    chance = random.Random(height)
    rows = [(c, t, chance.choice("ua"), chance.choice(["ja", "né", "o"])) for c in range(30) for t in range(chance.choice([1, 2, 5, 9, 30 if c % 7 == 0 else 3]))]
    got = prefix_trie.prefix_trie(frame(spark, rows), height)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_copies_of_a_long_conversation(spark):
    rows = [(5 * c, t, "u", f"turn {t}") for c in range(40) for t in range(70)]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows), 4).collect()), key=str)
    assert got == brute(rows) and len(got) == 71


def test_odd_rows(spark):
    rows = [
        (None, 1, "u", "no conversation"), (0, None, None, None), (0, 1, "u", ""), (0, 1, "u", ""), (0, 1, "a", "tie"), (1, 0, "u", "\x00 日本 \U0001f600"), (2, 0, "u", "w " * 20000),
        (7, 3, "u", "base is missing"), (8, 3, "u", "base is missing"), (-3, 1, "u", "below zero"),
    ]
    rows = [r for r in rows if r[0] != -3]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_pieces_of_a_hash(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, 0, "u", "same") for c in range(200)]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "u", "t")])).count() == 0


def test_query_matches_its_sql(spark, duck, sf_dir):
    got = prefix_trie.query(spark, sf_dir).toPandas()
    want = duck.execute(prefix_trie.SQL).df()
    told = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f.notna(), None).values.tolist()))
    assert [x.replace(".0", "") for x in told(got)] == [x.replace(".0", "") for x in told(want)]

"""Documents linked by the Jaccard similarity of their word n-grams: a grouped prefix join.

All shingles are put in one order, frequent ones last. Two sets that link share a shingle among the first few of each, so
documents meet under the shingles of these prefixes. Documents with the same prefix and size are collapsed into one group,
groups are paired and filtered, and then expanded to their members. Two members' sketches, a bit or two for each shingle, tell
how many shingles at least only one of them has; where that leaves a link possible, the whole sets are compared.

Only connected classes are wanted, so not every pair is compared: a first round compares neighbours under each shingle, a few more
compare neighbours in other orders that are in different classes still, and a last one all pairs that the rounds have left in
different classes. So a group of near copies is never expanded to all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonority.llm.common import few, finished, met, portions, small, table, text_or_empty, together, written
from sonority.llm.components import contracted_components

WORDS, SIMILARITY = 5, Fraction(4, 5)
#: Shingles that are put last in the order: the most frequent ones of those that are twice or more in some run of ``COUNTED`` shingles, this
#: many at most. They decide how long the work takes, never its result.
FREQUENT = 1 << 20
#: Shingles counted at once; text bytes handled at once; members of a key compared at once; neighbours compared in the first round.
COUNTED, PORTION, BLOCK, NEIGHBOURS = 1 << 22, 1 << 22, 1024, 2
#: Rounds, at most, that compare neighbours of different classes; they end when one finds no link. Each looks so many times as far.
ROUNDS, WIDER = 5, 4
#: Rounds go on while one finds more than one link for so many groups.
FEW_LINKS = 400
#: Items of a tile's side, as a power of two.
TILE_BITS = 8
#: Up to so many members of a key are all compared in the first round.
SMALL = NEIGHBOURS + 2
NONE = np.zeros(0, np.uint64)
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


#: Odd multipliers of the words of a shingle, and of its last mixing.
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(64)], np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the runs of ``words`` words, ascending; of fewer words, the hash of all; of none, nothing.

    Words are hashed to 64 bits each, and a run's hash takes in one after another, multiplied and mixed.
    """
    parts = (text or "").encode("utf-8", "replace").translate(_UPPER).split()
    if not parts:
        return NONE
    digest = xxhash.xxh3_64_intdigest
    if len(parts) < words:
        return np.array([digest(b" ".join(parts), 1)], np.uint64)
    of = np.fromiter(map(digest, parts), np.uint64, len(parts))
    n = len(parts) - words + 1
    out = of[:n] * _ODD[0]
    for k in range(1, words):
        # multipliers of another place, so that the order of words counts
        out ^= out >> np.uint64(29)
        out += of[k : n + k] * _ODD[k % len(_ODD)]
        out *= _ODD[-1]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays without repeats."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())


def linked(a: np.ndarray, b: np.ndarray, at_least: Fraction = SIMILARITY) -> bool:
    both = overlap(a, b)
    return both * at_least.denominator >= at_least.numerator * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> bytes:
    """Bits of at least as many places as the set has shingles, a power of two: each tells whether an odd number of them falls there."""
    places = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """So many shingles at least are in only one of two sets with these sketches: each of them turns one bit."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    while len(x) != len(y):
        # the halves put together are the sketch of half as many places
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from portions(b, "text", PORTION)


def frequent(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``shingle, n``: shingles of several documents, counted over all of them.

    A task counts runs of ``COUNTED`` shingles and tells of those that are in two documents of a run or more; what is rarer than that is not
    worth a place in the order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["shingle", "n"])

        for b in _texts(batches):
            for t in b.column("text").to_pylist():
                held.append(shingles(t, words))
                size += len(held[-1])
            if size >= COUNTED:
                yield told()
                held, size = [], 0
        if size:
            yield told()

    found = docs.select(text_or_empty().alias("text")).mapInArrow(count, "shingle long, n long")
    return found.groupBy("shingle").agg(F.sum("n").alias("n"))


def prefix_length(size: int, at_least: Fraction = SIMILARITY) -> int:
    """So many first shingles of a set that any set which links with it has one of them among its own first ones."""
    return size - -(-at_least.numerator * size // at_least.denominator) + 1


SETS = "n int, digest binary, grp long, prefix binary, sketch binary"


def ordering(docs: DataFrame, words: int = WORDS):
    """The order of shingles, broadcast: the most frequent ones, ascending, and their counts. Ascending count comes first, then the hash."""
    found = written(frequent(docs, words), "frequent")
    # the least power of two that so many counts reach at most
    by = {r["e"]: r["n"] for r in found.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count("*").alias("n")).collect()}
    run, least = 0, max(by, default=0) + 1
    while least and run + by.get(least - 1, 0) <= FREQUENT:
        least -= 1
        run += by.get(least, 0)
    rows = found.where(F.col("n") >= 1 << least).toArrow()
    keys, often = (rows.column(c).to_numpy() for c in ("shingle", "n"))
    order = np.argsort(keys.view(np.uint64))
    return docs.sparkSession.sparkContext.broadcast((keys.view(np.uint64)[order], often[order]))


def counted(known: np.ndarray, often: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The counts of shingles; none for those that aren't frequent."""
    if not len(known) or not len(s):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return np.where(known[at] == s, often[at], 0)


def sets(docs: DataFrame, shared, words: int = WORDS, at_least: Fraction = SIMILARITY) -> DataFrame:
    """``doc_id`` and for each document its set's size ``n``, a digest of the set, its group: a hash of size and ``prefix``, and its sketch.

    :param shared: the order of :func:`ordering`.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for b in _texts(batches):
            out = []
            for t in b.column("text").to_pylist():
                s = shingles(t, words)
                first = s[np.argsort(counted(known, often, s), kind="stable")[: prefix_length(len(s), at_least)]] if len(s) else s
                raw = first.astype("<u8").tobytes()
                out.append((len(s), hashlib.sha256(s.astype("<u8").tobytes()).digest()[:16], xxhash.xxh64_intdigest(raw, len(s)) - (1 << 63), raw, sketch(s)))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary())))], ["doc_id", "n", "digest", "grp", "prefix", "sketch"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(each, f"doc_id {kind}, {SETS}")


def compatible(n: np.ndarray, m: np.ndarray, at: np.ndarray, other: np.ndarray, at_least: Fraction) -> np.ndarray:
    """Whether sets of sizes ``n``, ``m`` that share the shingles in places ``at``, ``other`` as their first common ones may link."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    most = np.minimum(n - at, m - other)
    return (low * at_least.denominator >= high * at_least.numerator) & (most * (at_least.numerator + at_least.denominator) >= at_least.numerator * (n + m))


_MET = "a long, b long, key long, id long, n int, at int"
_NAMES = ["a", "b", "key", "id", "n", "at"]


def _met_rows(a=None, b=None, key=None, id_=None, n=None, at=None) -> pa.RecordBatch:
    full = [a, b, key, id_, n, at]
    size = max(len(x) for x in full if x is not None)
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
    return pa.RecordBatch.from_arrays([pa.nulls(size, t) if x is None else pa.array(x, t) for x, t in zip(full, kinds)], _NAMES)


def _ranges(rows: DataFrame, *by: str, one: bool = False) -> DataFrame:
    """Rows sorted by key and more over ranges of all of them, so that a key of very many rows lies in several tasks.

    :param one: the rows are few and make one range.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.coalesce(1) if one else rows.repartitionByRange(tasks, "key", *by)).sortWithinPartitions("key", *by)


def ends(pairs: DataFrame, name: str) -> DataFrame:
    """``name``: what the written ``pairs`` ``a, b`` name, each once."""
    return written(together(pairs.select("a", "b")).select(F.explode(F.array("a", "b")).alias(name)).distinct(), "ends")


def neighbours(filed: DataFrame, at_least: Fraction = SIMILARITY) -> DataFrame:
    """Pairs of members that stand next to each other under a key, in the order of size; members of larger keys also leave as rows.

    :param filed: ``key, n, id, at``: a set's size, its number, and the key's place in its prefix.
    :return: pairs ``a, b`` that sizes and places allow, other columns null; and the rows of ``filed``, with null ``a`` and ``b``,
        of keys with more than ``SMALL`` members or that may go on in the next or the last range.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n", "id", "at"]
        back, keep, opened = [np.zeros(0, np.int64) for _ in names], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            # before the batch's rows are those of its first key that may be their neighbours
            fresh = len(back[0])
            key, n, id_, at = (np.concatenate([x, b.column(c).to_numpy().astype(np.int64)]) for x, c in zip(back, names))
            opened = key[0] if opened is None else opened
            new = np.concatenate([[True], key[1:] != key[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            rank = np.arange(len(key)) - start + np.where(key == key[0], keep, 0)
            for gap in range(1, SMALL):
                i = np.arange(max(gap, fresh), len(key))
                i = i[key[i] == key[i - gap]]
                if gap > NEIGHBOURS:
                    i = i[rank[i] < SMALL]
                i = i[compatible(n[i], n[i - gap], at[i], at[i - gap], at_least) & (id_[i] != id_[i - gap])]
                if len(i):
                    yield _met_rows(np.minimum(id_[i], id_[i - gap]), np.maximum(id_[i], id_[i - gap]))
            # a key's first rows leave when one more comes than is small; those of the range's first key leave at once
            i = np.arange(fresh, len(key))
            i = i[(rank[i] >= SMALL) | (key[i] == opened)]
            full = i[(rank[i] == SMALL) & (key[i] != opened)]
            if len(i):
                i = np.sort(np.concatenate([i, *(full - k for k in range(1, SMALL + 1))]))
                yield _met_rows(None, None, key[i], id_[i], n[i], at[i])
            tail = max(0, len(key) - SMALL, int(start[-1]))
            keep = int(rank[tail])
            back = [x[tail:] for x in (key, n, id_, at)]
        # the range's last key may go on in the next one
        key, n, id_, at = back
        if len(key) and key[0] != opened and keep + len(key) <= SMALL:
            yield _met_rows(None, None, key, id_, n, at)

    return _ranges(filed, "n", "id").mapInArrow(meet, _MET)


def strangers(rows: DataFrame, turn: int, at_least: Fraction = SIMILARITY) -> DataFrame:
    """Pairs ``a, b`` of members of different classes that stand near each other under a key, in an order of the turn's own,
    ``WIDER`` times as far as in the turn before. Pairs that meet under several keys come as often.

    :param rows: a written table, ``key, n, id, at, low, high``: the least and the greatest class of a member's own members.
    """

    near = NEIGHBOURS * WIDER ** (turn - 1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n", "id", "at", "low", "high"]
        back = [np.zeros(0, np.int64) for _ in names]
        for b in batches:
            fresh = len(back[0])
            key, n, id_, at, low, high = full = [np.concatenate([x, b.column(c).to_numpy().astype(np.int64)]) for x, c in zip(back, names)]
            for gap in range(1, near + 1):
                i = np.arange(max(gap, fresh), len(key))
                j = i - gap
                may = (key[i] == key[j]) & ((low[i] != low[j]) | (high[i] != high[j]) | (low[i] != high[i])) & (id_[i] != id_[j]) & compatible(n[i], n[j], at[i], at[j], at_least)
                i, j = i[may], j[may]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(id_[i], id_[j])), pa.array(np.maximum(id_[i], id_[j]))], ["a", "b"])
            back = [x[-near:] for x in full]

    mixed_up = rows.select("key", "n", "id", "at", "low", "high", F.xxhash64("id", F.lit(turn)).alias("mix"))
    return _ranges(mixed_up, "mix", one=small(rows)).drop("mix").mapInArrow(meet, "a long, b long")


def across(rows: DataFrame, at_least: Fraction = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Pairs ``a, b`` under a key whose classes differ, as far as sizes and places allow. Pairs that meet under several keys come as often.

    :param rows: a written table, ``key, n, id, at, low, high``: the least and the greatest class of a member's own members. A key's sorted members are
        dealt into blocks; pairs of blocks that may differ in class and agree in size are compared, each in a task of its own.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, part = None, 0, TaskContext.get().partitionId() << 32
        for b in batches:
            if b.num_rows:
                key = b.column("key").to_numpy()
                new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
                start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
                rank = np.arange(len(key)) - start + np.where((start == 0) & (not new[0]), run, 0)
                last, run = key[-1], int(rank[-1]) + 1
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part | rank // block)], [*b.schema.names, "blk"])

    kinds = "key long, n int, id long, at int, low long, high long"
    blocks = written(_ranges(rows.select("key", "n", "id", "at", "low", "high"), "n", "id", one=small(rows)).mapInArrow(number, f"{kinds}, blk long"), "blocks")
    sums = together(blocks).groupBy("key", "blk").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    sums = written(sums, "block-sums")
    left = sums.select("key", F.col("blk").alias("i"), *[F.col(c).alias(f"{c}_i") for c in ("low", "high", "most")])
    right = sums.select("key", F.col("blk").alias("j"), *[F.col(c).alias(f"{c}_j") for c in ("low", "high", "least")])
    # blocks are in the order of size; what differs in class lies in two blocks or in a mixed one
    wanted = left.join(few(right), "key").where((F.col("i") <= F.col("j")) & (F.col("most_i") * at_least.denominator >= F.col("least_j") * at_least.numerator))
    wanted = wanted.where((F.col("low_i") != F.col("low_j")) | (F.col("high_i") != F.col("high_j")) | (F.col("low_i") != F.col("high_i")))
    wanted = written(wanted.select("key", "i", "j"), "block-pairs")
    sides = wanted.select("key", "i", "j", F.col("i").alias("blk")).union(wanted.where("i < j").select("key", "i", "j", F.col("j").alias("blk")))
    dealt = blocks.join(few(sides), ["key", "blk"])

    def compare(of: pa.Table) -> pa.Table:
        n, id_, at, low, high, blk = (of.column(c).to_numpy().astype(np.int64) for c in ("n", "id", "at", "low", "high", "blk"))
        i, j = of.column("i")[0].as_py(), of.column("j")[0].as_py()
        x, q = np.flatnonzero(blk == i), np.flatnonzero(blk == j)[None, :]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(x), 256):
            p = x[k : k + 256, None]
            may = compatible(n[p], n[q], at[p], at[q], at_least) & ((low[p] != low[q]) | (high[p] != high[q]) | (low[p] != high[p]))
            may &= id_[p] < id_[q] if i == j else id_[p] != id_[q]
            r, s = np.nonzero(may)
            a.append(id_[p[r, 0]])
            b.append(id_[q[0, s]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def once(pairs: DataFrame, name: str) -> DataFrame:
    """``pairs`` ``a, b``, each once, written."""
    return written(together(written(pairs.select("a", "b"), name)).distinct(), name)


def most_common(p: np.ndarray, q: np.ndarray, n: int, m: int, known: np.ndarray, often: np.ndarray) -> int:
    """How many shingles two sets of sizes ``n``, ``m`` with the prefixes ``p``, ``q`` have in common at most.

    Up to where the shorter-reaching prefix ends, both sets are known; behind it, no more are common than either has there.
    """
    common = len(np.intersect1d(p, q, assume_unique=True))
    c, d = counted(known, often, p), counted(known, often, q)
    if (c[-1], p[-1]) <= (d[-1], q[-1]):
        n_known, m_known = len(p), int(((d < c[-1]) | (d == c[-1]) & (q <= p[-1])).sum())
    else:
        n_known, m_known = int(((c < d[-1]) | (c == d[-1]) & (p <= q[-1])).sum()), len(q)
    return common + min(n - n_known, m - m_known)


def tiled(pairs: DataFrame, items: DataFrame, payload: str, alike: Callable[[tuple, tuple], bool]) -> DataFrame:
    """The ``pairs`` ``a, b`` of which ``alike`` holds, given each item's ``payload`` and ``n``.

    Items are put in the order of their payload's beginning, which similar ones mostly share, and cut into runs of two to the ``TILE_BITS``. Pairs of
    the same two runs are compared in one task, to which each of their items comes once, however many pairs it is in.

    :param pairs: a written table.
    :param items: ``id, n`` and ``payload``, bytes.
    """
    spark = pairs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = ends(pairs, "id")
    near = items.select("id", F.substring(payload, 1, 8).alias("near")).join(few(ids), "id", "left_semi")
    near = written(near, "tile-beginnings").coalesce(1) if small(ids) else near.repartitionByRange(tasks, "near", "id")
    runs = near.sortWithinPartitions("near", "id").select("id", F.shiftright(F.monotonically_increasing_id(), TILE_BITS).alias("run"))
    runs = written(runs, "tile-runs")
    of = lambda c: runs.select(F.col("id").alias(c), F.col("run").alias(f"run_{c}"))
    placed = pairs.join(few(of("a")), "a").join(few(of("b")), "b").select("a", "b", F.least("run_a", "run_b").alias("i"), F.greatest("run_a", "run_b").alias("j"))
    placed = written(placed, "tiles")
    needed = written(together(placed).select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.explode(F.array("a", "b")).alias("id")).distinct(), "tile-needs")
    needed = items.select("id", "n", payload).join(few(needed), "id")

    def compare(of_tile: pa.Table, with_items: pa.Table) -> pa.Table:
        known = {}
        for id_, n, raw in zip(*(with_items.column(c).to_pylist() for c in ("id", "n", payload))):
            known[id_] = (n, np.frombuffer(raw, "<u8"))
        a, b = of_tile.column("a").to_pylist(), of_tile.column("b").to_pylist()
        hit = [alike(known[x], known[y]) for x, y in zip(a, b)]
        return of_tile.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return placed.groupBy("i", "j").cogroup(needed.groupBy("_i", "_j")).applyInArrow(compare, "a long, b long")


def likely(pairs: DataFrame, groups: DataFrame, shared, at_least: Fraction = SIMILARITY) -> DataFrame:
    """Pairs ``a, b`` of groups that may link by what their prefixes tell.

    :param groups: ``g, n, prefix``.
    """

    def alike(x: tuple, y: tuple) -> bool:
        most = most_common(x[1], y[1], x[0], y[0], *shared.value)
        return most * (at_least.numerator + at_least.denominator) >= at_least.numerator * (x[0] + y[0])

    return tiled(pairs, groups.select(F.col("g").alias("id"), "n", "prefix"), "prefix", alike)


def similar(pairs: DataFrame, sketches: DataFrame, at_least: Fraction = SIMILARITY) -> DataFrame:
    """Pairs ``a, b`` of sets that may link by what their sketches tell.

    :param sketches: ``u, n, sketch`` of all sets.
    """
    ids = ends(pairs, "u")
    known = written(sketches.select("u", "n", "sketch").join(few(ids), "u", "left_semi"), "sketches")
    of = lambda c: known.select(F.col("u").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
            least = np.fromiter(map(apart, b.column("s_a").to_pylist(), b.column("s_b").to_pylist()), np.int64, b.num_rows)
            may = least * (at_least.denominator + at_least.numerator) <= size * (at_least.denominator - at_least.numerator)
            yield b.select(["a", "b"]).filter(pa.array(may))

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(each, "a long, b long")


def held_sets(wanted: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``u, held``: the whole sets that ``wanted(u, digest, first_id)`` names, made anew from the texts of the documents that have them."""
    ids = wanted.select(F.col("first_id").alias("_id")).distinct()
    some = docs.select("doc_id", "text").join(few(ids), F.col("doc_id").eqNullSafe(F.col("_id"))).select(text_or_empty().alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _texts(batches):
            made = [shingles(t, words).astype("<u8").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(s).digest()[:16] for s in made], pa.binary()), pa.array(made, pa.binary())], ["digest", "held"])

    # of rows that share an id, only those with the wanted digest stay; where copies share an id too, one stays
    made = written(some.mapInArrow(each, "digest binary, held binary").join(few(wanted.select("digest", "u")), "digest").select("u", "held"), "held")
    return written(made.dropDuplicates(["u"]), "held") if made.count() > wanted.count() else made


def verified(pairs: DataFrame, held: DataFrame, at_least: Fraction = SIMILARITY) -> DataFrame:
    """Pairs ``a, b`` of numbers of sets whose whole sets, as ``held(u, held)``, link."""
    items = held.select(F.col("u").alias("id"), F.lit(0).alias("n"), "held")
    return tiled(pairs, items, "held", lambda x, y: linked(x[1], y[1], at_least))


def jaccard_classes(docs: DataFrame, words: int = WORDS, at_least: Fraction = SIMILARITY) -> DataFrame:
    """Size of each document's set of shingles and the smallest document that links lead to.

    Shingles are told apart by 64-bit hashes. Sets that are equal link whatever their number; they are collapsed before anything else.

    :param docs: ``doc_id, text`` and any other columns, which are ignored. Null and empty texts and those of white space have empty
        sets and are linked with nothing: their component is their own id. Rows with a null ``doc_id`` get the component of their
        set; null if nothing else is in it. Repeated rows are all returned; an empty table gives none.
    :return: ``doc_id, n_shingles, component_id``.
    """
    return finished(docs.sparkSession, "classes", lambda: _jaccard_classes(docs, words, at_least))


def _jaccard_classes(docs: DataFrame, words: int, at_least: Fraction) -> DataFrame:
    shared = ordering(docs, words)
    rows = written(sets(docs, shared, words, at_least), "sets")
    some = rows.where("n > 0")
    # groups of sets with the same prefix and size, and the sets themselves; both are numbered
    groups = written(some.groupBy("grp", "n", "prefix").agg(F.count("*").alias("rows")).drop("rows").withColumn("g", F.monotonically_increasing_id()), "groups")
    distinct = some.groupBy("digest", "grp", "n", "sketch").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("u", F.monotonically_increasing_id()), "distinct")
    named = written(distinct.select("u", "grp", "n").join(groups.select("grp", "n", "g"), ["grp", "n"]).select("u", "n", "g"), "members")
    firsts = written(named.groupBy("g").agg(F.min("u").alias("first"), F.count("*").alias("members")), "firsts")
    member = named.join(firsts.where("members > 1").select("g"), "g").select(F.col("g").alias("key"), "n", F.col("u").alias("id"), F.lit(0).alias("at"))
    inside = written(neighbours(member, at_least), "inside")

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column("prefix")]
            size = np.array(list(map(len, raw)), np.int64)
            for k in range(0, len(raw), 256):
                s = size[k : k + 256]
                at = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(raw[k : k + 256])), pa.array(np.repeat(b.column("n").to_numpy()[k : k + 256], s)), pa.array(np.repeat(b.column("g").to_numpy()[k : k + 256], s)), pa.array(at.astype(np.int32))], ["key", "n", "id", "at"])

    filed = groups.select("n", "g", "prefix").mapInArrow(postings, "key long, n int, id long, at int")
    between = written(neighbours(filed, at_least), "between")
    of_sets, total_groups = distinct.select("u", "digest", "first_id"), groups.count()
    ordered = (F.least("u_a", "u_b").alias("a"), F.greatest("u_a", "u_b").alias("b"))
    held, known = None, None

    def chosen(of_groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of pairs of groups, those with more than two sets that may link; and the pairs of the first sets of these and of all other groups."""
        named_firsts = written(firsts.join(few(ends(of_groups, "g")), "g", "left_semi"), "met-firsts")
        of_first = lambda c: few(named_firsts.select(F.col("g").alias(c), F.col("first").alias(f"u_{c}"), F.col("members").alias(f"m_{c}")))
        both = written(of_groups.join(of_first("a"), "a").join(of_first("b"), "b"), "met")
        several = both.where("m_a > 1 or m_b > 1")
        if several.isEmpty():
            return several.select("a", "b"), both.select(*ordered)
        good = written(likely(several.select("a", "b"), groups, shared, at_least), "likely")
        return good, both.where("m_a = 1 and m_b = 1").select(*ordered).union(several.join(good, ["a", "b"]).select(*ordered))

    def links(pairs: DataFrame) -> DataFrame:
        """Those of the pairs of sets that link. Whole sets are made when a pair first needs them."""
        nonlocal held, known
        near = written(similar(pairs, distinct, at_least), "near-pairs")
        if near.isEmpty():
            return near
        ids = ends(near, "u")
        wanted = of_sets.join(few(ids), "u", "left_semi")
        wanted = written(wanted if known is None else wanted.join(few(known), "u", "left_anti"), "wanted")
        if not wanted.isEmpty():
            more, ids = held_sets(wanted, docs, words), wanted.select("u")
            held, known = (more, ids) if held is None else (held.union(more), known.union(ids))
        return written(verified(near, held, at_least), "edges")

    met_groups = once(between.where("a is not null"), "group-pairs")
    good, first = chosen(met_groups)
    found = links(once(inside.where("a is not null").select("a", "b").union(first), "pairs"))
    classed = named.select("u", "g", F.col("u").alias("root"))

    def joined(classed: DataFrame, found: DataFrame) -> DataFrame:
        """Classes after more links: only the classes that these link are put together."""
        some = written(classed.join(few(ends(found, "u")), "u", "left_semi"), "linked-classes")
        of = lambda c: few(some.select(F.col("u").alias(c), F.col("root").alias(f"root_{c}")))
        edges = written(found.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "class-links")
        roots = contracted_components(together(edges)).select("node", F.col("root").alias("_new"))
        return written(classed.join(few(roots), F.col("root") == F.col("node"), "left").select("u", "g", F.coalesce("_new", "root").alias("root")), "classed")

    def mixed(filed_rows: DataFrame, of: DataFrame) -> DataFrame:
        """Rows of keys that hold more than one class."""
        rows_of = filed_rows.where("key is not null").select("key", "n", "id", "at")
        if small(rows_of) and small(of):
            rows_of, of = rows_of.coalesce(1), of.coalesce(1)
        full = written(rows_of.join(of, "id"), "classed-rows")
        keys = together(full).groupBy("key").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).where("_low < _high").select("key")
        return full.join(few(written(keys, "mixed-keys")), "key", "left_semi")

    linked_now = 0
    for turn in range(1, ROUNDS + 1):
        # what may link and is in different classes still
        classed = joined(classed, found)
        spans = written(together(classed).groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")), "spans")
        own = classed.select(F.col("u").alias("id"), F.col("root").alias("low"), F.col("root").alias("high"))
        by_group = spans.select(F.col("g").alias("id"), "low", "high")
        inside, between = (written(mixed(rows_of, of), "mixed") for rows_of, of in ((inside, own), (between, by_group)))
        inside, between = (x.select(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "key", "id", "n", "at", "low", "high") for x in (inside, between))
        if turn == ROUNDS or turn > 1 and linked_now * FEW_LINKS <= total_groups or inside.isEmpty() and between.isEmpty():
            break
        strange = written(once(strangers(between, turn, at_least), "near-strangers").join(few(met_groups), ["a", "b"], "left_anti"), "strangers")
        passed, first = chosen(strange)
        met_groups, good = met_groups.union(strange), good.union(passed)
        found = links(once(first.union(strangers(inside, turn, at_least)), "pairs"))
        linked_now = found.count()

    # the last round: all pairs that are left
    more = across(inside, at_least)
    fresh = written(once(across(between, at_least), "unmet").join(few(met_groups), ["a", "b"], "left_anti"), "fresh")
    passed, first = chosen(fresh)
    # pairs of groups of which only the first members have been compared
    span = lambda c: spans.select(F.col("g").alias(c), F.col("low").alias(f"low_{c}"), F.col("high").alias(f"high_{c}"), F.col("members").alias(f"m_{c}"))
    old = good.join(span("a"), "a").join(span("b"), "b").where("(low_a <> low_b or high_a <> high_b or low_a <> high_a) and (m_a > 1 or m_b > 1)").select("a", "b")
    several = written(passed.union(old), "open-groups")
    of = lambda c: classed.select(F.col("g").alias(c), F.col("u").alias(f"u_{c}"), F.col("root").alias(f"root_{c}"))
    expanded = several.join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b").select(*ordered)
    rest = once(expanded.union(more).union(first), "open-pairs")
    if not rest.isEmpty():
        late = links(rest)
        if not late.isEmpty():
            classed = joined(classed, late)

    rooted = written(distinct.select("u", "digest", "first_id", "copies").join(classed.select("u", "root"), "u"), "rooted")
    total = rooted.count()
    classes = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("of"))
    by_digest = written(met(rooted, classes, "root", "of", max(1, total)).select("digest", "component_id", "copies"), "classes")
    slim = rows.where("n > 0").select("doc_id", "n", "digest")
    full = met(slim, by_digest, "digest", "copies", max(1, slim.count()))
    none = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    # all that looks at the order has been written
    shared.destroy()
    return full.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").union(none)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


#: By definition: sets of shingles, all pairs that share one, and the closure of the links.
SQL = r"""
with recursive word as (
  select row_number() over () as r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents
), held as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from word
), one as (select min(r) as u, any_value(len(s)) as n, any_value(s) as s, md5(array_to_string(list_sort(s), chr(10))) as k from held where len(s) > 0 group by k),
item as (select u, n, unnest(s) as x from one),
pair as (
  select a.u as u, b.u as v from item a join item b on a.x = b.x and a.u < b.u
  group by a.u, b.u, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edge as (select u, v from pair union all select v, u from pair),
reach(u, v) as (select u, u from one union select r.u, e.v from reach r join edge e on e.u = r.v),
least as (select u, min(v) as root from reach group by u),
named as (select h.r, h.doc_id, len(h.s) as n, l.root from held h left join one o on o.k = md5(array_to_string(list_sort(h.s), chr(10))) and len(h.s) > 0 left join least l on l.u = o.u),
comp as (select root, min(doc_id) as component_id from named where root is not null group by root)
select doc_id, n as n_shingles, case when n = 0 then doc_id else component_id end as component_id from named left join comp using (root)
"""

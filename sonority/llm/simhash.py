"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link at ``limit`` or fewer differing bits. The 64 bits are grouped into partitions, correlated bits
together; a dynamic programme gives each partition its own threshold, such that any two fingerprints that link lie
within the threshold of at least one partition, at the least estimated cost. Each fingerprint is filed under the keys
of its partitions' neighbourhoods, fingerprints that meet under a key are verified, and the links' connected
components are labelled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonority.llm.common import few, met, table, text_or_empty, written
from sonority.llm.components import components

SEED, WORDS, LIMIT = 42, 3, 3
#: Fingerprints under one key that are compared at once; larger groups are dealt into blocks of this size.
BLOCK = 2048
#: Keys that a task makes at once.
KEYS_AT_ONCE = 1 << 17
#: Estimated cost of one key row that is shuffled and sorted, in units of one verified pair.
KEY_COST = 150.0


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Set each bit that over half of the shingles' hashes have; shingles count as often as they occur."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit number. Null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(each, f"doc_id {kind}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of ones of each bit and the bits' correlation, over all of them."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for b in batches:
            x = _bits(b.column("fp").to_numpy()).astype(np.float32)
            n, both = n + len(x), both + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(np.full(64, n)), pa.array(both.tolist(), pa.list_(pa.float64()))], ["bit", "n", "both"])

    sums = [F.sum(F.col("both")[j]).alias(f"b{j}") for j in range(64)]
    got = distinct.select("fp").mapInArrow(part, "bit long, n long, both array<double>").groupBy("bit").agg(F.sum("n").alias("n"), *sums).orderBy("bit").collect()
    if not got or not got[0]["n"]:
        return 0, np.full(64, 0.5), np.eye(64)
    n = int(got[0]["n"])
    both = np.array([[r[f"b{j}"] for j in range(64)] for r in got]) / n
    ones = np.diag(both).copy()
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-9))
    return n, ones, (both - np.outer(ones, ones)) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of about equal width; each takes the free bit that correlates most with its own bits."""
    free, out = set(range(64)), []
    strength = np.abs(correlation)
    for k in range(m):
        width = len(free) // (m - k)
        first = max(sorted(free), key=lambda j: strength[j, sorted(free)].sum())
        own = [first]
        free.discard(first)
        while len(own) < width:
            best = max(sorted(free), key=lambda j: strength[j, own].sum())
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def _within(ones: np.ndarray, bits: list[int], radius: int) -> float:
    """Chance that two fingerprints differ in at most ``radius`` of the bits, taken as independent."""
    far = np.zeros(radius + 1)
    far[0] = 1
    for p in (2 * ones[j] * (1 - ones[j]) for j in bits):
        far = far * (1 - p) + np.concatenate([[0], far[:-1]]) * p
    return float(far.sum())


def allocate(n: int, ones: np.ndarray, parts: list[list[int]], limit: int = LIMIT) -> tuple[float, list[int]]:
    """Thresholds of the partitions, -1 for one that is not probed, by dynamic programming.

    If each partition differs in more than its threshold, the whole differs in at least the sum of (threshold + 1)
    bits; so thresholds with a sum of ``limit + 1 - len(parts)`` miss no link.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in parts:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, limit + 1 - used):
                keys = math.comb(len(bits), t) if t >= 0 else 0
                pairs = n * n / 2 * _within(ones, bits, t) * (t + 1) if t >= 0 else 0.0
                now = cost + KEY_COST * n * keys + pairs
                if used + t + 1 not in step or now < step[used + t + 1][0]:
                    step[used + t + 1] = (now, [*chosen, t])
        best = step
    return best[limit + 1]


def plan(n: int, ones: np.ndarray, correlation: np.ndarray, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """The partitions and thresholds of the least estimated cost, over two partitions to ``limit + 1``."""
    found = []
    for m in range(1, limit + 2):
        parts = group_bits(correlation, m)
        cost, thresholds = allocate(n, ones, parts, limit)
        found.append((cost, m, [(b, t) for b, t in zip(parts, thresholds) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def masks(chosen: list[tuple[list[int], int]]) -> np.ndarray:
    """One mask for each key of a fingerprint: a partition's bits without ``threshold`` of them.

    Two fingerprints that differ in at most ``threshold`` bits of a partition agree under one of its masks.
    """
    out = []
    for bits, t in chosen:
        for left_out in combinations(bits, t):
            out.append(sum(1 << b for b in bits if b not in left_out))
    return np.array(out, np.uint64)


def _links(fps: np.ndarray, limit: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Verified links as a spanning forest: at most one row for each fingerprint, whatever the group's size."""
    right = fps if other is None else other
    root = {int(x): int(x) for x in fps}
    root.update((int(x), int(x)) for x in right)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    u, v = fps.view(np.uint64), right.view(np.uint64)
    for i in range(0, len(u), 256):
        close = np.bitwise_count(u[i : i + 256, None] ^ v[None, :]) <= limit
        for x, y in zip(*np.nonzero(close)):
            p, q = int(fps[i + x]), int(right[y])
            if p != q and (p := top(p)) != (q := top(q)):
                root[max(p, q)] = min(p, q)
                a.append(int(fps[i + x]))
                b.append(int(right[y]))
    return np.array(a, np.int64), np.array(b, np.int64)


def finer(wanted: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each mask, masks of ``limit + 1`` parts of the bits that it leaves out, each with the mask's own bits.

    Fingerprints that agree under a mask and link agree under one of its finer masks, by the pigeonhole principle.
    """
    out = []
    for mask in wanted.tolist():
        rest = [b for b in range(64) if not mask >> b & 1]
        out.append([mask | sum(1 << b for b in rest[k :: limit + 1]) for k in range(limit + 1)])
    return np.array(out, np.uint64)


def link(distinct: DataFrame, chosen: list[tuple[list[int], int]], limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` of distinct fingerprints that hold all components: no more than one for each key and fingerprint.

    Fingerprints are sorted by key and streamed; a group of up to ``block`` is compared as it passes. A larger group is
    filed anew under finer keys. Where even those leave more than ``block``, the group leaves as numbered blocks, of which
    pairs are then compared, each in a group of its own.
    """
    wanted = masks(chosen)
    refined = finer(wanted, limit)
    step = max(1, KEYS_AT_ONCE // len(wanted))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy()
            for i in range(0, len(fps), step):
                x = fps[i : i + step]
                keys = (x.view(np.uint64)[:, None] & wanted[None, :]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(wanted), dtype=np.int32), len(x))), pa.array(keys.ravel()), pa.array(np.repeat(x, len(wanted)))], ["mask", "key", "fp"])

    def file_finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, of = b.column("a").to_numpy(), b.column("mask").to_numpy()
            keys = (fps.view(np.uint64)[:, None] & refined[of]).view(np.int64)
            mask = (of[:, None] * (limit + 1) + np.arange(limit + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(mask.ravel()), pa.array(keys.ravel()), pa.array(np.repeat(fps, limit + 1))], ["mask", "key", "fp"])

    names = ["a", "b", "mask", "key", "blk"]

    def rows(a, b, mask, key, blk) -> pa.RecordBatch:
        n = len(a)
        full = lambda x, t: pa.array(np.full(n, x, t)) if x is not None else pa.nulls(n, pa.from_numpy_dtype(t))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(n, pa.int64()), full(mask, np.int32), full(key, np.int64), full(blk, np.int32)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups are told by where key or mask change; the group at a batch's end waits for the next batch."""
        held, of, blk = np.zeros(0, np.int64), None, 0
        found_a, found_b = [], []
        for batch in batches:
            mask, key, fps = (batch.column(c).to_numpy() for c in ("mask", "key", "fp"))
            if not len(key):
                continue
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (mask[1:] != mask[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            last, first = len(starts) - 1, of is None or (mask[0], key[0]) != of
            wide = set(np.flatnonzero(ends - starts > 1).tolist()) | {0, last}
            for g in sorted(wide):
                s, e = starts[g], ends[g]
                if g or first:
                    if blk:
                        yield rows(held, None, of[0], of[1], blk)
                    elif len(held) > 1:
                        p, q = _links(held, limit)
                        found_a.append(p)
                        found_b.append(q)
                    held, of, blk = np.zeros(0, np.int64), (mask[s], key[s]), 0
                held = np.concatenate([held, fps[s:e]])
                while len(held) > block:
                    yield rows(held[:block], None, of[0], of[1], blk)
                    held, blk = held[block:], blk + 1
            if sum(map(len, found_a)) > 10_000:
                yield rows(np.concatenate(found_a), np.concatenate(found_b), None, None, None)
                found_a, found_b = [], []
        if blk:
            yield rows(held, None, of[0], of[1], blk)
        elif len(held) > 1:
            p, q = _links(held, limit)
            found_a.append(p)
            found_b.append(q)
        if found_a:
            yield rows(np.concatenate(found_a), np.concatenate(found_b), None, None, None)

    def meeting(filed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links within small groups, and the blocks of large ones."""
        ordered = filed.repartition(F.col("mask"), F.col("key")).sortWithinPartitions("mask", "key")
        found = written(ordered.mapInArrow(meet, "a long, b long, mask int, key long, blk int"), "links")
        return found.where("blk is null").select("a", "b"), found.where("blk is not null")

    small, large = meeting(distinct.select("fp").mapInArrow(file, "mask int, key long, fp long"))
    if large.isEmpty():
        return small
    more, large = meeting(large.select("a", "mask").mapInArrow(file_finer, "mask int, key long, fp long"))
    small = small.union(more)
    top = large.groupBy("mask", "key").agg(F.max("blk").alias("top"))
    # each block goes to the groups of all pairs of blocks that it is in
    paired = (
        large.join(top, ["mask", "key"])
        .select("mask", "key", "a", "blk", F.explode(F.sequence(F.lit(0), "top")).alias("with"))
        .select("mask", "key", "a", "blk", F.least("blk", "with").alias("i"), F.greatest("blk", "with").alias("j"))
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left = pdf.loc[pdf["blk"] == i, "a"].to_numpy(np.int64)
        a, b = _links(left, limit, None if i == j else pdf.loc[pdf["blk"] == j, "a"].to_numpy(np.int64))
        return pd.DataFrame({"a": a, "b": b})

    return small.union(paired.groupBy("mask", "key", "i", "j").applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Fingerprint and component of each document.

    :param docs: ``doc_id, text`` and any other columns, which are ignored. A null or empty text has fingerprint zero,
        linked like any other. Rows with a null ``doc_id`` get the component of their fingerprint; null if nothing
        else is in it. Repeated rows are all returned; an empty table gives none.
    :return: ``doc_id, fingerprint, component_id``.
    """
    rows = written(fingerprints(docs), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    n, ones, correlation = bit_statistics(distinct)
    edges = link(distinct, plan(n, ones, correlation, limit), limit)
    found = components(edges)
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("of"))
    by_fp = written(met(rooted.select("fp", "n", "root"), named, "root", "of", n).select("fp", "n", "component_id"), "classes")
    joined = met(rows, by_fp, "fp", "n", rows.count())
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the smallest ``doc_id``; of repeated rows of it, one.

    Rows without an id can't be named and stay. Only ids are shuffled, unless too many documents go for a broadcast.
    """
    found = written(near_duplicates(docs), "groups")
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    again = written(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "again")
    kept = docs.join(few(gone), "doc_id", "left_anti").select(docs.columns)
    if again.isEmpty():
        return kept
    once = kept.join(few(again), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.join(few(again), "doc_id", "left_anti").select(docs.columns).union(once)

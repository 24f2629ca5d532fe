"""Exact duplicates: static filters per snapshot screen a batch, exact buckets decide.

A *snapshot* is an immutable table of the distinct texts seen so far. It is dealt into buckets by digest and each
bucket has a static binary-fuse filter of 8-bit fingerprints. The digests of an incoming *batch* are first grouped
among themselves, then screened by the filter of their bucket; only positives join the exact bucket. Rows that would be
dropped are then compared with the row that stays, byte by byte, and a digest that two texts share is grouped anew by
the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonority.llm.common import few, met, table, text_or_empty, written

#: Digests in a bucket, about: bounds what one task holds.
BUCKET_ROWS = 4_000


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, so that each seed gives other positions."""
    h = keys ^ np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, segments: int, width: int) -> np.ndarray:
    """Three slots of each key, in three neighbouring segments."""
    first = ((h >> np.uint64(40)) * np.uint64(segments)) >> np.uint64(24)
    low = np.uint64(width - 1)
    return np.stack([(first + np.uint64(i)) * np.uint64(width) + ((h >> np.uint64(13 * i)) & low) for i in range(3)]).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    """The fingerprint, from bits of both halves."""
    return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A static filter over distinct 64-bit keys: seed, number of segments, their width, fingerprints.

    Keys are peeled in rounds: all keys that are alone in some slot go at once, and are then assigned in reverse.
    A seed that leaves a core is replaced by the next.
    """
    keys = np.unique(np.asarray(keys, np.uint64))
    n = max(len(keys), 1)
    width = int(min(8192, max(4, 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)))))
    factor = 1.125 if n < 2 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    segments = max(1, int(np.ceil(n * factor / width)) - 2)
    for seed in range(1, 1000):
        if seed % 20 == 0:
            segments += 1 + segments // 8
        h = _mix(keys, seed)
        at, slots = _places(h, segments, width), (segments + 2) * width
        alive, rounds = np.ones(len(keys), bool), []
        while alive.any():
            live = np.flatnonzero(alive)
            count = np.bincount(at[:, live].ravel(), minlength=slots)
            alone = count[at[:, live]] == 1
            free = alone.any(0)
            if not free.any():
                break
            rounds.append((live[free], alone[:, free].argmax(0)))
            alive[live[free]] = False
        if not alive.any():
            prints = _print(h)
            out = np.zeros(slots, np.uint8)
            for gone, which in reversed(rounds):
                own = at[which, gone]
                out[own] = 0
                out[own] = prints[gone] ^ out[at[0, gone]] ^ out[at[1, gone]] ^ out[at[2, gone]]
            return seed, segments, width, out.tobytes()
    raise RuntimeError("no seed peels the keys")


def may_hold(keys: np.ndarray, seed: int, segments: int, width: int, prints: bytes) -> np.ndarray:
    """True for each key that is in the filter, and for one in about 256 that is not."""
    h = _mix(np.asarray(keys, np.uint64), seed)
    at, got = _places(h, segments, width), np.frombuffer(prints, np.uint8)
    return _print(h) == got[at[0]] ^ got[at[1]] ^ got[at[2]]


def normalised(name: str = "text"):
    return F.regexp_replace(text_or_empty(name), "[\\x20\\x09-\\x0D]+", " ")


def sha256(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def digests(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``doc_id, sha, row``: digest of the normalised text in UTF-8, null text as empty, and a number that tells rows apart."""
    return docs.select("doc_id", digest(normalised()).alias("sha"), F.monotonically_increasing_id().alias("row"))


def _first():
    """Of some rows, the one with the smallest ``doc_id``; null ids stand last, and the row's number breaks ties."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row"))


def _key():
    return F.conv(F.substring("sha", 49, 16), 16, -10).cast("long").alias("key")


def snapshot(rows: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The exact buckets ``sha, keep, n, key, bucket`` of rows ``doc_id, sha, row``, and a filter for each bucket."""
    held = (
        rows.groupBy("sha").agg(_first().alias("keep"), F.count("*").alias("n"))
        .select("*", _key()).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    )
    held = written(held, "snapshot")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segments, width, prints = build_filter(pdf["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [seed], "segments": [segments], "width": [width], "prints": [prints]})

    filters = held.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket int, seed int, segments int, width int, prints binary")
    return held, written(filters, "filters")


def screen(groups: DataFrame, filters: DataFrame) -> DataFrame:
    """Add ``maybe`` to rows with ``sha, key, bucket``: false where the snapshot has no such key for certain."""

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left[["sha", "key"]]
        if right.empty:
            return left.assign(maybe=False)
        f = right.iloc[0]
        return left.assign(maybe=may_hold(left["key"].to_numpy(np.int64).view(np.uint64), int(f["seed"]), int(f["segments"]), int(f["width"]), f["prints"]))

    keys = groups.select("sha", "key", "bucket")
    looked = keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(look, "sha string, key long, maybe boolean")
    return groups.join(looked.select("sha", "maybe"), "sha")


def grouped(rows: DataFrame, cut: int, buckets: int) -> DataFrame:
    """``sha, keep, group_size`` of all rows ``doc_id, sha, row``: snapshot, screen, exact buckets."""
    old = F.coalesce(F.col("doc_id") < F.lit(cut), F.lit(False))
    held, filters = snapshot(rows.where(old), buckets)
    fresh = written(
        rows.where(~old).groupBy("sha").agg(_first().alias("new_keep"), F.count("*").alias("new_n"))
        .select("*", _key()).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int")), "fresh"
    )
    screened = screen(fresh, filters)
    exact = held.select("sha", F.col("keep").alias("old_keep"), F.col("n").alias("old_n"))
    positives = screened.where("maybe").join(exact, "sha", "left")
    none = screened.where("not maybe").withColumns({"old_keep": F.lit(None).cast(held.schema["keep"].dataType), "old_n": F.lit(None).cast("long")})
    batch = written(positives.unionByName(none), "batch")
    return batch.select(
        "sha", F.least("old_keep", "new_keep").alias("keep"), (F.col("new_n") + F.coalesce("old_n", F.lit(0))).alias("group_size")
    ).union(
        held.select("sha", "keep", F.col("n").alias("group_size")).join(batch.where("old_keep is not null").select("sha"), "sha", "left_anti")
    )


def clashing(docs: DataFrame, groups: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The byte check: digests ``sha`` of groups whose rows' normalised texts are not all the same bytes.

    A group's texts are the same if its least and its greatest are, which are found before anything is shuffled, whatever
    the group's size. Only texts of groups with more than one row take part, if their digests can be broadcast.
    """
    many = groups.where("group_size > 1").select("sha")
    held = docs.select(normalised().alias("body")).withColumn("sha", digest(F.col("body")))
    named = few(many)
    copies = held if named is many else held.join(named, "sha")
    return copies.groupBy("sha").agg(F.min("body").alias("least"), F.max("body").alias("most")).where("least <> most").select("sha")


def dedup(docs: DataFrame, cut: int | None = None, bucket_rows: int = BUCKET_ROWS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Find the row that stays for each document.

    :param docs: ``doc_id, text`` and any other columns, which are ignored. A null text is an empty one. Each row is a
        document of its own: rows of the same ``doc_id`` belong to the groups of their texts, and of rows that are the same in
        both, one is kept at most. Rows with a null ``doc_id`` stand last; a group of such rows alone keeps one of them.
    :param cut: documents below this ``doc_id`` are the snapshot, the rest are the batch; None: the middle of the range.
    :return: ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row; none for an empty table. Exactly one
        row of each text has ``kept``. ``text_sha256`` is the digest, if another one is given.
    """
    if cut is None:
        low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        cut = 0 if low is None else (low + high + 1) // 2
    rows = written(digests(docs, digest), "digests")
    total = rows.count()
    groups = written(grouped(rows, cut, max(1, -(-total // bucket_rows))), "groups")
    out = _placed(met(rows, groups, "sha", "group_size", total))
    wrong = written(clashing(docs, groups, digest), "clashing")
    if wrong.isEmpty():
        return out
    # two texts with one digest: such rows are grouped by their text
    bodies = docs.select("doc_id", normalised().alias("body"), F.monotonically_increasing_id().alias("row")).withColumn("sha", digest(F.col("body")))
    bodies = written(bodies.join(F.broadcast(wrong), "sha"), "bodies")
    by_body = bodies.groupBy("body").agg(_first().alias("keep"), F.count("*").alias("group_size"))
    apart = _placed(met(bodies, by_body, "body", "group_size", bodies.count()))
    return out.join(F.broadcast(wrong.withColumnRenamed("sha", "text_sha256")), "text_sha256", "left_anti").unionByName(apart)


def _placed(joined: DataFrame) -> DataFrame:
    return joined.select("doc_id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents),
g as (select body, min(doc_id) as keep_id, count(*) as group_size from t group by body)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id and row_number() over (partition by t.doc_id, t.body) = 1 as kept, sha256(t.body) as text_sha256
from t join g on t.body = g.body
"""

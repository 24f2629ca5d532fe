"""Benchmark decontamination: size-partitioned MinHash search for short items inside long documents.

Items are partitioned by their number of shingles into classes of powers of two. For each class a document is cut into
windows of two neighbouring blocks of the class's size, so a passage of up to that many shingles lies whole in one
window, and the window is at most four times as large as the item: the Jaccard similarity stays high enough for
MinHash however long the document is. An item whose minimum under any of the hash functions is the minimum of a window
is a candidate; candidates are verified by the exact share of the item's shingles that the whole document holds. Items of
so few shingles that a window would be much larger than they are found by the shingles themselves. Few items are broadcast,
many are joined to the documents' minima.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sonority.llm.common import HOT_KEYS, few, table, text_or_empty, written

WORDS, CONTAINMENT = 5, 0.8
#: Items of fewer shingles are looked up by each of them; the smallest class has items of up to eight.
FEW = 3
#: Hash functions. A window holds over 0.187 of the union with an item of three or more shingles that it contains to 0.8,
#: so fewer than one in 20,000 of such items has no minimum in common with it.
HASHES = 48
#: Bytes of item texts that are broadcast at most; more items are joined by their minima.
BLOCK_BYTES = 4_000_000
#: Bits, as a power of two, of the filter of all items' values (16 MB); tasks over which the rows of a hot key are dealt.
FILTER_BITS, SALTS = 27, 64
#: Words whose hash a worker remembers.
MEMORY = 500_000

_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(2**64 - 1)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: bytes) -> str:
    """A word without what is not a letter or digit at its ends."""
    return _EDGES.sub("", word.decode("utf-8", "replace"))


def words(text: str) -> list[str]:
    """Lower-case words between ASCII white space, bare at the ends; words with nothing left don't count."""
    return [w for w in map(bare, text.lower().encode("utf-8", "replace").split()) if w]


def shingles(found: list[str]) -> set[tuple[str, ...]]:
    """Distinct runs of five words; fewer words are one shingle, none have none."""
    if len(found) < WORDS:
        return {tuple(found)} if found else set()
    return set(zip(*(found[i:] for i in range(WORDS))))


class Hasher:
    """Hashes of a text's shingles, in order."""

    def __init__(self) -> None:
        self.memory: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        raw, memory = text.lower().encode("utf-8", "replace").split(), self.memory
        try:
            got = list(map(memory.__getitem__, raw))
        except KeyError:
            new = {w for w in raw if w not in memory}
            if len(memory) + len(new) > MEMORY:
                memory.clear()
                new = set(raw)
            for w in new:
                b = bare(w)
                memory[w] = (xxhash.xxh64_intdigest(b.encode(), 5) | 1) if b else 0
            got = list(map(memory.__getitem__, raw))
        h = np.array(got, np.uint64)
        h = h[h != 0]
        n = max(len(h) - WORDS + 1, min(len(h), 1))
        out = np.zeros(n, np.uint64)
        for i in range(min(WORDS, len(h))):
            out = out * _STEP + h[i : i + n]
        return out


def _minima(h: np.ndarray, block: int) -> np.ndarray:
    """Minimum under each hash function of each block of neighbouring shingles."""
    n = -(-len(h) // block)
    out = np.empty((HASHES, n), np.uint64)
    for s in range(0, n, 256):
        part = h[s * block : (s + 256) * block]
        mixed = part[None, :] * _MUL[:, None] + _ADD[:, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _STEP
        m = -(-len(part) // block)
        if m * block > len(part):
            mixed = np.concatenate([mixed, np.full((HASHES, m * block - len(part)), _TOP)], axis=1)
        out[:, s : s + m] = mixed.reshape(HASHES, m, block).min(2)
    return out


def _joined(m: np.ndarray) -> np.ndarray:
    """Pairs of neighbouring blocks as blocks of twice the size."""
    if m.shape[1] % 2:
        m = np.concatenate([m, np.full((HASHES, 1), _TOP)], axis=1)
    return np.minimum(m[:, ::2], m[:, 1::2])


class Items:
    """The signatures of a block of items, by size class."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in rows]
        self.shingles = [shingles(words(t)) for _, t in rows]
        self.values: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        hasher, by_class = Hasher(), {}
        for k, (_, t) in enumerate(rows):
            h = np.unique(hasher(t))
            if len(h):
                size, own = _class(h)
                by_class.setdefault(size, []).append((k, own))
        for size, own in sorted(by_class.items()):
            self.values[size] = self._index(own)

    @staticmethod
    def _index(own: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted values, the item of each, and which upper 20 bits they have."""
        value = np.concatenate([m for _, m in own])
        item = np.repeat([k for k, _ in own], [len(m) for _, m in own])
        order = np.argsort(value, kind="stable")
        seen = np.zeros(1 << 20, bool)
        seen[value >> np.uint64(44)] = True
        return value[order], item[order], seen

    @staticmethod
    def _look_up(index: tuple[np.ndarray, np.ndarray, np.ndarray], values: np.ndarray, out: set[int]) -> None:
        value, item, seen = index
        maybe = values[seen[values >> np.uint64(44)]]
        if len(maybe):
            left, right = np.searchsorted(value, maybe), np.searchsorted(value, maybe, "right")
            for a, b in zip(left.tolist(), right.tolist()):
                out.update(item[a:b].tolist())

    def candidates(self, h: np.ndarray) -> set[int]:
        """Items that share a minimum with a window of the document, or a shingle if they have few."""
        out: set[int] = set()
        for size, found in _searched(h, list(self.values)):
            self._look_up(self.values[size], found, out)
        return out


def _class(h: np.ndarray) -> tuple[int, np.ndarray]:
    """The size class of an item with these distinct hashes, 0 for few, and the values by which it is found."""
    if len(h) < FEW:
        return 0, h
    return max(3, int(np.ceil(np.log2(len(h))))), _minima(h, len(h))[:, 0]


def contained(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """Items that a document holds at least ``threshold`` of.

    Items of up to ``BLOCK_BYTES`` are broadcast; more of them meet the documents in a join of minima. Either way the
    candidates are the same, and the corpus's whole texts are read where they lie.

    :param docs: ``doc_id, text``; ``items``: ``item_id, text``; other columns are ignored. Null and empty texts hold
        nothing and are held by nothing. Repeated rows are searched each; rows with null ids take part. A text of fewer
        than five words is a single shingle, and so only matches a text of the same words.
    :return: ``doc_id, item_id, n_shared, n_item, containment``; none if either table is empty.
    """
    sized = items.select("item_id", text_or_empty().alias("text"))
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _broadcast(texts, sized, threshold) if total <= BLOCK_BYTES else _joined_by_minima(texts, sized, threshold)


def _broadcast(texts: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Containment in all documents of a bounded block of items, in one pass."""
    fields = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, n_shared long, n_item long, containment double"
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    shared = texts.sparkSession.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hasher = shared.value, Hasher()
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                h = hasher(text)
                found = items.candidates(h) if len(h) else ()
                if found:
                    held = shingles(words(text))
                    for k in sorted(found):
                        n, of = len(items.shingles[k] & held), len(items.shingles[k])
                        if n >= threshold * of:
                            rows.append((i, items.ids[k], n, of, n / of))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], b.column("doc_id").type), pa.array([r[1] for r in rows], item_type), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.float64())],
                ["doc_id", "item_id", "n_shared", "n_item", "containment"],
            )

    return texts.mapInArrow(each, fields)


def _item_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_item, size, value``: what each item is found by."""
    hasher = Hasher()
    for b in batches:
        ids, sizes, values = [], [], []
        for i, text in zip(b.column("_item").to_pylist(), b.column("text").to_pylist()):
            h = np.unique(hasher(text))
            if len(h):
                size, own = _class(h)
                ids += [i] * len(own)
                sizes += [size] * len(own)
                values.append(own)
        value = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(value)], ["_item", "size", "value"])


def _bit(value) -> Column:
    """Place of a value in the filter, from 1: its upper bits."""
    return F.shiftrightunsigned(value, 64 - FILTER_BITS) + 1


def _met(rows: DataFrame, other: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Inner join in which one key may hold any share of ``rows``.

    Rows of keys with at least one row in ``HOT_KEYS``, of which there are ``HOT_KEYS`` at most, are dealt over ``SALTS`` tasks by
    column ``by``, and the rows that ``other`` has of these keys are repeated for each.
    """
    counts = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")), "leak-keys")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("_n") >= max(2, total // HOT_KEYS)).select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = other.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def _joined_by_minima(texts: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Containment of any number of items: what the filter of all items' values lets through is joined to them.

    The filter has ``2 ** FILTER_BITS`` bits whatever the number of items; when it fills up, more values are joined. Texts are
    told apart by their SHA-256, so copies are searched and verified once; only texts with candidates are shuffled.
    """
    spark = texts.sparkSession
    items = written(items.withColumn("_item", F.monotonically_increasing_id()), "leak-items")
    values = written(items.mapInArrow(_item_values, "_item long, size int, value long"), "leak-values")
    sizes = sorted(r["size"] for r in values.select("size").distinct().collect())  # one for each power of two
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    blocks = values.groupBy(F.bitmap_bucket_number(_bit("value")).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_bit("value"))).alias("bits"))
    for r in blocks.collect():  # 4 KB each, as many as the filter has
        at = (r["k"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hasher = shared.value, Hasher()
        for b in batches:
            shas, out_sizes, out = [], [], []
            for sha, text in zip(b.column("sha").to_pylist(), b.column("text").to_pylist()):
                for size, found in _searched(hasher(text), sizes):
                    place = found >> np.uint64(64 - FILTER_BITS)
                    held = np.unique(found[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                    shas += [sha] * len(held)
                    out_sizes += [size] * len(held)
                    out.append(held)
            value = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shas, pa.string()), pa.array(out_sizes, pa.int32()), pa.array(value)], ["sha", "size", "value"])

    known = texts.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    hits = written(known.select("sha", "text").mapInArrow(each, "sha string, size int, value long").distinct(), "leak-hits")
    pairs = written(_met(hits, values, ["size", "value"], "sha").select("sha", "_item").distinct(), "leak-pairs")
    wanted = few(written(pairs.select("sha").distinct(), "leak-texts"))
    own = known.select("sha", "text").join(wanted, "sha", "left_semi").groupBy("sha").agg(F.first("text").alias("text"))
    asked = pairs.join(items.select("_item", F.col("text").alias("item")), "_item")
    verified = asked.join(own, "sha").sortWithinPartitions("sha").mapInArrow(_verifier(threshold), "sha string, _item long, n_shared long, n_item long, containment double")
    verified = written(verified, "leak-verified")
    held = written(known.select("doc_id", "sha").join(few(verified.select("sha").distinct()), "sha", "left_semi"), "leak-rows")
    return _met(held, verified, ["sha"], "doc_id").join(items.select("_item", "item_id"), "_item").select("doc_id", "item_id", "n_shared", "n_item", "containment")


def _searched(h: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size class, the values by which its items are found in a document with these hashes."""
    if not len(h):
        return
    at, m = None, None
    for size in sizes:
        if not size:
            yield 0, h
            continue
        if at is None:
            at, m = size, _minima(h, 1 << size)
        while at < size:
            at, m = at + 1, _joined(m)
        yield size, (np.minimum(m[:, :-1], m[:, 1:]) if m.shape[1] > 1 else m).ravel()


def _verifier(threshold: float):
    """Exact containment of ``item`` in ``text``; rows of the same text follow each other."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for b in batches:
            rows = []
            for sha, i, item, text in zip(*(b.column(c).to_pylist() for c in ("sha", "_item", "item", "text"))):
                if sha != last:
                    last, held = sha, shingles(words(text))
                own = shingles(words(item))
                n = len(own & held)
                if n >= threshold * len(own):
                    rows.append((sha, i, n, len(own), n / len(own)))
            columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["sha", "_item", "n_shared", "n_item", "containment"])

    return each


def query(spark, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; the ids of the others are written first, so that a few are broadcast."""
    found = written(contained(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


SQL = r"""
with texts as (
  select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark
), split as (
  select kind, id, list_filter(list_transform(
    regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'),
    lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '') as w
  from texts
), grams as (
  select distinct kind, id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) as g
  from split where len(w) > 0
), shared as (
  select d.id as doc_id, b.id as item_id, count(*) as n_shared
  from grams d join grams b on d.g = b.g where d.kind = 'd' and b.kind = 'b' group by all
)
select doc_id, item_id, n_shared, n as n_item, n_shared / n as containment
from shared join (select id, count(*) as n from grams where kind = 'b' group by id) i on i.id = item_id
where n_shared >= 0.8 * n
"""

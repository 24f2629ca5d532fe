"""Tokens of two tokenizers aligned at the byte offsets where both end.

Token ends of a text are two ascending lists. They are divided and conquered: a common end near the middle of an interval is
located by bisection, going outwards from the middle one until one is found, and both halves are divided further; an interval
without a common end inside is a leaf, a group. All intervals of all texts of a batch are divided at once. Tokens of a group
are linked, and how many documents link a pair of ids is counted over the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonority.llm.common import finished, portions, table, text_or_empty, written
from sonority.llm.token_store import MISSING, Encoder

#: Bits of the second tokenizer's id in a pair's key.
LOW = 16
#: Pairs, those of the most documents, that are looked up in a broadcast table; the others are joined.
HOT_PAIRS = 2_000_000
#: Text bytes aligned at once; pairs of a group that are listed one by one; keys counted at once; pieces that a worker remembers.
PORTION, LISTED, KEYS, PIECES = 1 << 20, 1 << 12, 1 << 21, 400_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Ids of two tokenizers and what bytes they stand for.

    Neither tokenizer has a token that goes on over a space after another character or over a line feed, so pieces between
    them are encoded on their own and remembered; other texts are encoded whole.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = Encoder(path_a)
        self.a.of.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        code, vocab = byte_alphabet(), self.a.of.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.bytes_b) > 1 << LOW:
            raise ValueError("the second vocabulary is too large for a pair's key")
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = (pa.array([str(i) for i in range(len(x))]) for x in (self.bytes_a, self.bytes_b))
        self.whole_only = any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.piece: dict[str, bytes] = {}

    def _learn_b(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces with a space before them, or of those from a line feed on, whose added space is taken off."""
        found = self.b.encode(new, num_threads=1)
        out = {p: np.array(ids[1:] if p[0] == "\n" else ids, "<u4").tobytes() for p, ids in zip(new, found)}
        if len(self.piece) < PIECES:
            self.piece.update(out)
        return out

    def many(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text by both; none where the text is empty or either's tokens don't add up to a space and the text."""
        held, new_a, new_b = [], set(), set()
        for text in texts:
            pieces = text.replace("\n", " \n").split(" ")
            if "" in pieces or "\0" in text or "▁" in text or self.whole_only:
                held.append(None)
                continue
            held.append(pieces)
            own = set(pieces)
            new_a |= own.difference(self.a.piece)
            new_b |= own.difference(self.piece)
        fresh_a, fresh_b = self.a._learn(new_a) if new_a else {}, self._learn_b(list(new_b)) if new_b else {}
        get_a, get_b, out = self.a.piece.get, self.piece.get, []
        for text, pieces in zip(texts, held):
            if not text:
                out.append((NONE, NONE))
                continue
            plain = (" " + text).encode("utf-8", "replace")
            a = [get_a(p, MISSING) for p in pieces] if pieces else [None]
            if MISSING in a:
                a = [fresh_a[p] if x is MISSING else x for p, x in zip(pieces, a)]
            a = self.a.whole(" " + text) if None in a else b"".join(a)
            if pieces:
                b = b"".join([fresh_b[p] if x is None else x for p, x in ((p, get_b(p)) for p in pieces)])
            else:
                b = np.array(self.b.encode(text, num_threads=1), "<u4").tobytes()
            a, b = np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)
            same = all(b"".join(map(of.__getitem__, ids.tolist())) == plain for of, ids in ((self.bytes_a, a), (self.bytes_b, b)))
            out.append((a, b) if same else (NONE, NONE))
        return out


NONE = np.zeros(0, np.int64)
_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    """The process's tokenizers: what they remember serves all tasks of a worker."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def common_ends(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of their common values, by division.

    :param a, b: ascending token ends, of texts one after another; ``a_ends``, ``b_ends``: where each text's tokens end in them.
        The last ends of a text are common by its nature.
    """
    found_a, found_b = [a_ends - 1], [b_ends - 1]
    a_lo, b_lo = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    # of an interval, the ends that may be common are all but its last
    a_hi, b_hi = a_ends - 1, b_ends - 1
    while True:
        inner = (a_hi > a_lo) & (b_hi > b_lo)
        a_lo, a_hi, b_lo, b_hi = a_lo[inner], a_hi[inner], b_lo[inner], b_hi[inner]
        if not len(a_lo):
            break
        at, other, step = (a_lo + a_hi - 1) // 2, np.full(len(a_lo), -1), 0
        middle, todo = at.copy(), np.arange(len(a_lo))
        while len(todo):
            for sign in (1, -1) if step else (1,):
                x = middle[todo] + sign * step
                within = (x >= a_lo[todo]) & (x < a_hi[todo])
                rows, x = todo[within], x[within]
                y = np.searchsorted(b, a[x])
                hit = b[np.minimum(y, len(b) - 1)] == a[x]
                at[rows[hit]], other[rows[hit]] = x[hit], y[hit]
                todo = todo[other[todo] < 0]
            step += 1
            todo = todo[(middle[todo] + step < a_hi[todo]) | (middle[todo] - step >= a_lo[todo])]
        cut = other >= 0
        at, other = at[cut], other[cut]
        found_a.append(at)
        found_b.append(other)
        a_lo, a_hi, b_lo, b_hi = (np.concatenate(x) for x in ((a_lo[cut], at + 1), (at, a_hi[cut]), (b_lo[cut], other + 1), (other, b_hi[cut])))
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def _spans(ends: np.ndarray) -> np.ndarray:
    return np.diff(ends, prepend=0)


def links(a: np.ndarray, b: np.ndarray, a_of: np.ndarray, b_of: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, key, times``: how often each document links each pair of ids, in order.

    :param a, b: ids; ``a_of``, ``b_of``: where each group's tokens end in them; ``doc_of``: each group's document.
    """
    n_a, n_b = _spans(a_of), _spans(b_of)
    start_a, start_b = a_of - n_a, b_of - n_b
    docs, keys, times = [], [], []
    small = np.flatnonzero(n_a * n_b <= LISTED)
    m = n_a[small] * n_b[small]
    if len(small):
        group = np.repeat(small, m)
        k = np.arange(len(group)) - np.repeat(np.cumsum(m) - m, m)
        keys.append(a[start_a[group] + k // n_b[group]] << LOW | b[start_b[group] + k % n_b[group]])
        docs.append(doc_of[group])
        times.append(np.ones(len(group), np.int64))
    for g in np.flatnonzero(n_a * n_b > LISTED).tolist():
        x, many = np.unique(a[start_a[g] : a_of[g]], return_counts=True)
        y, often = np.unique(b[start_b[g] : b_of[g]], return_counts=True)
        keys.append((x[:, None] << LOW | y[None, :]).ravel())
        docs.append(np.full(len(keys[-1]), doc_of[g]))
        times.append((many[:, None] * often[None, :]).ravel())
    if not keys:
        return NONE, NONE, NONE
    doc, key, n = (np.concatenate(x) for x in (docs, keys, times))
    full = doc << 32 | key
    order = np.argsort(full, kind="stable")
    full, n = full[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]]))
    return full[first] >> 32, full[first] & 0xFFFFFFFF, np.add.reduceat(n, first)


def group_texts(of: Pair, a: np.ndarray, b: np.ndarray, a_of: np.ndarray, b_of: np.ndarray, group_ends: np.ndarray) -> list[str]:
    """Each document's groups as text: ids joined by commas, sides by bars, groups by semicolons."""

    def joined(names: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), names.take(pa.array(ids))), ",")

    groups = pc.binary_join_element_wise(joined(of.name_a, a, a_of), joined(of.name_b, b, b_of), "|")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], group_ends]), pa.int32()), groups), ";").to_pylist()


#: What :func:`aligned` gives of each document.
ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"
_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"]


def _align(of: Pair, batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = of.many(batch.column("text").to_pylist())
    n = len(ids)
    count_a, count_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    full = np.flatnonzero(count_a)
    n_groups, n_links, told, keys, times = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n, [b""] * n, [b""] * n
    if len(full):
        a, b = np.concatenate([x for x, _ in ids]), np.concatenate([y for _, y in ids])
        # texts lie one after another, so their ends are apart
        doc_a, doc_b = np.cumsum(count_a[full]), np.cumsum(count_b[full])
        cut_a, cut_b = common_ends(np.cumsum(of.size_a[a]), np.cumsum(of.size_b[b]), doc_a, doc_b)
        a_of, b_of = cut_a + 1, cut_b + 1
        group_ends = np.searchsorted(a_of, doc_a, "right")
        n_groups[full] = _spans(group_ends)
        doc_of = np.repeat(full, _spans(group_ends))
        np.add.at(n_links, doc_of, _spans(a_of) * _spans(b_of))
        for i, t in zip(full.tolist(), group_texts(of, a, b, a_of, b_of, group_ends)):
            told[i] = hashlib.sha256(t.encode()).hexdigest()
        doc, key, many = links(a, b, a_of, b_of, doc_of)
        starts = np.searchsorted(doc, np.arange(n + 1))
        key, many = key.astype("<u4"), many.astype("<u8")
        for i in full.tolist():
            keys[i], times[i] = key[starts[i] : starts[i + 1]].tobytes(), many[starts[i] : starts[i + 1]].tobytes()
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count_a), pa.array(count_b), pa.array(n_groups), pa.array(n_links), pa.array(told), pa.array(keys, pa.binary()), pa.array(times, pa.binary())], _NAMES)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id``, the columns of ``ALIGNED`` and a number ``row``: ``keys`` holds the linked pairs, each once and in order, ``times`` how often."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pair(path_a, path_b)
        for batch in batches:
            for some in portions(batch, "text", PORTION):
                yield _align(of, some)

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(each, f"doc_id {kind}, {ALIGNED}")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``key, docs``: how many documents link each pair. Tasks add up before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "docs"])

        for b in batches:
            for raw in b.column("keys"):
                held.append(np.frombuffer(raw.as_buffer(), "<u4"))
                size += len(held[-1])
                if size >= KEYS:
                    yield told()
                    held, size = [], 0
        if size:
            yield told()

    return rows.select("keys").mapInArrow(count, "key long, docs long").groupBy("key").agg(F.sum("docs").alias("docs"))


def _hot_limit(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs are in as many documents."""
    by = {r["e"]: r["n"] for r in counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("e")).agg(F.count("*").alias("n")).collect()}
    run, limit = 0, max(by, default=0) + 1
    while limit and run + by.get(limit - 1, 0) <= most:
        limit -= 1
        run += by.get(limit, 0)
    return 1 << limit


def with_counts(rows: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``row, n_best, count_sum`` of :func:`aligned` rows.

    The pairs of the most documents, ``hot_pairs`` at most, are broadcast as two sorted arrays, and so is each first id's highest
    count, of which there are as many as ids. Links of rarer pairs are joined to their counts; none of those pairs has a large share of
    the links, so no key is hot.
    """
    spark = rows.sparkSession
    counts = written(pair_counts(rows), "pair-counts")
    limit = _hot_limit(counts, hot_pairs)
    hot = counts.where(F.col("docs") >= limit).toArrow().sort_by("key")
    best = counts.groupBy(F.shiftright("key", LOW).alias("a")).agg(F.max("docs").alias("best"))
    highest = best.toArrow()
    ids = highest.column("a").to_numpy().astype(np.int64)
    top = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    top[ids] = highest.column("best").to_numpy()
    shared = spark.sparkContext.broadcast((hot.column("key").to_numpy().astype(np.uint32), hot.column("docs").to_numpy(), top))

    def looked_up(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        known, docs, _ = shared.value
        raw = [np.frombuffer(x.as_buffer(), "<u4") for x in b.column("keys")]
        key = np.concatenate([*raw, np.zeros(0, np.uint32)])
        times = np.concatenate([*(np.frombuffer(x.as_buffer(), "<u8").astype(np.int64) for x in b.column("times")), NONE])
        at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        hit = known[at] == key if len(known) else np.zeros(len(key), bool)
        return np.repeat(np.arange(len(raw)), list(map(len, raw))), key, times, docs[at] * hit if len(known) else np.zeros(len(key), np.int64), hit

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highest = shared.value[2]
        for batch in batches:
            for b in portions(batch, "keys", PORTION):
                of, key, times, docs, hit = looked_up(b)
                n_best, count_sum = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                np.add.at(n_best, of, times * (hit & (docs == highest[key >> LOW])))
                np.add.at(count_sum, of, times * docs)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n_best), pa.array(count_sum)], ["row", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in portions(batch, "keys", PORTION):
                of, key, times, _, hit = looked_up(b)
                row = b.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(row[of[~hit]]), pa.array(key[~hit].astype(np.int64)), pa.array(times[~hit])], ["row", "key", "times"])

    slim = rows.select("row", "keys", "times")
    found = slim.mapInArrow(summed, "row long, n_best long, count_sum long")
    rare = counts.where(F.col("docs") < limit)
    if rare.isEmpty():
        return found
    met = slim.mapInArrow(others, "row long, key long, times long").join(rare, "key").join(F.broadcast(best), F.shiftright("key", LOW) == F.col("a"))
    more = met.groupBy("row").agg(F.sum(F.when(F.col("docs") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    return found.union(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def cross_alignment(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Groups and links of each document's tokens, and how usual its links are in the corpus.

    :param docs: ``doc_id, text`` and any other columns, which are ignored. Repeated rows are documents of their own, a null
        ``doc_id`` stays null, null and empty texts and those that either tokenizer changes have no tokens; an empty table gives no rows.
    :param path_a: a byte-level vocabulary of the tokenizers library; ``path_b``: a sentencepiece model that adds a space.
    :return: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.
    """
    return finished(docs.sparkSession, "alignment", lambda: _cross_alignment(docs, path_a, path_b, hot_pairs))


def _cross_alignment(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int) -> DataFrame:
    rows = aligned(docs, path_a, path_b)
    sums = with_counts(rows, hot_pairs)
    slim = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return slim.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return cross_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

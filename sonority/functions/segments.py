"""Words and their segments."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, and the first code point of the private range that encodes segments.
SPACE, FIRST = "[ \\t\\n\\x0B\\f\\r\\p{Zs}]+", 0xE000


def alternation(segments: tuple[str, ...]) -> str:
    """A pattern that takes the longest segment at each place; segments that start with an apostrophe never match."""
    usable = sorted({s for s in segments if s and not s.startswith("'")}, key=lambda s: (-len(s), s))
    return "(" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s) for s in usable) + ")"


def segmented(word: Column, segments: tuple[str, ...]) -> Column:
    """Greedy longest match from the left; an apostrophe breaks a digraph, and what is no segment is skipped."""
    return F.regexp_extract_all(word, F.lit(alternation(segments)), F.lit(1))


def joined(parts: Column, segments: tuple[str, ...]) -> Column:
    """Segments as text, with an apostrophe where two of them would read as the start of another segment."""
    table = F.array(*map(F.lit, segments))

    def merged(x: Column, y: Column) -> Column:
        return F.exists(table, lambda s: F.startswith(F.concat(x, y), s) & ~F.startswith(x, s))

    step = F.zip_with(F.concat(F.array(F.lit("")), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))), parts, lambda x, y: F.when(merged(x, y) & (x != ""), F.concat(F.lit("'"), y)).otherwise(y))
    return F.when(F.size(parts) == 0, "").otherwise(F.array_join(step, ""))


def references(parts: Column, segments: tuple[str, ...]) -> Column:
    """Segment ids; unknown segments are dropped."""
    ids = F.create_map(*[F.lit(x) for i, s in enumerate(segments) for x in (s, i + 1)])
    return F.filter(F.transform(parts, lambda s: ids[s]), lambda i: i.isNotNull())


def named(ids: Column, segments: tuple[str, ...]) -> Column:
    """Segments of ids; ids out of range are dropped."""
    table = F.array(*map(F.lit, segments))
    return F.filter(F.transform(ids, lambda i: F.try_element_at(table, i)), lambda s: s.isNotNull())


def encoded(ids: Column) -> Column:
    """A string with one code point for each segment id, for patterns to run over."""
    return F.array_join(F.transform(ids, lambda i: F.decode(F.unhex(F.concat(F.lit("EE"), F.hex((i / 64).cast("int") + 0x80), F.hex(i % 64 + 0x80))), "utf-8")), "")


def tokens(docs: DataFrame, *keys: str) -> DataFrame:
    """Lower-case words of ``text`` with their number, ``token, n``, for each combination of ``keys``.

    Words are counted before anything else is done with them, so all later work is on distinct words.
    """
    split = docs.select(*keys, F.explode(F.split(F.lower(F.col("text")), SPACE)).alias("token"))
    return split.where("token <> ''").groupBy(*keys, "token").agg(F.count("*").alias("n"))


def of_tokens(found: DataFrame, segments: tuple[str, ...], *keys: str, read: Callable[[Column], Column] | None = None) -> DataFrame:
    """``word`` (segment ids), ``freq`` of counted tokens; words without segments are dropped.

    ``read`` makes an array of segments of a token; None: :func:`segmented`.

    Tokens that are kept can be segmented anew when the table changes, without reading the text again. The last filter takes
    in the frequency, so that it stays above both counts and segmentation meets distinct words only.
    """
    parts = read(F.col("token")) if read else segmented(F.col("token"), segments)
    cut = found.select(*keys, references(parts, segments).alias("word"), "n")
    return cut.groupBy(*keys, "word").agg(F.sum("n").alias("freq")).where(F.size("word") * F.col("freq") > 0)


def lexicon(docs: DataFrame, segments: tuple[str, ...], *keys: str, read: Callable[[Column], Column] | None = None) -> DataFrame:
    """Collated text: ``word`` (segment ids), ``freq``; words without segments are dropped. ``read`` as in :func:`of_tokens`."""
    return of_tokens(tokens(docs, *keys), segments, *keys, read=read)


def word_list(lines: DataFrame, segments: tuple[str, ...], strict: bool = False, extra: list[str] = ()) -> DataFrame:
    """Lines ``value`` of a word list: ``segs, freq`` and the columns ``extra``, in no order.

    A line is a word and tab-separated fields; the fields must hold a single token that reads as a whole number, or
    the frequency is 1. With ``strict``, such lines are dropped. Lines without segments are dropped.
    """
    fields = F.split("value", "\t", -1)
    rest = F.filter(F.split(F.concat_ws(" ", F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(1)))), SPACE), lambda x: x != "")
    only = F.when(F.size(rest) == 1, rest[0])
    number = F.when(only.rlike("^-?[0-9]+$"), only.try_cast("int"))
    found = lines.select(segmented(fields[0], segments).alias("segs"), number.alias("freq"), (F.size(rest) > 0).alias("told"), *extra).where(F.size("segs") > 0)
    if strict:
        return found.where("freq is not null or not told").select("segs", F.coalesce("freq", F.lit(1)).alias("freq"), *extra)
    return found.select("segs", F.coalesce("freq", F.lit(1)).alias("freq"), *extra)


def serialised(rows: DataFrame, segments: tuple[str, ...], spaced: bool = False, write: Callable[[Column], Column] | None = None) -> DataFrame:
    """Lines ``value`` of ``segs, freq``: only positive frequencies, and a frequency of one is left out.

    ``write`` makes text of an array of segments; None: joined, or ``spaced``.
    """
    text = write(F.col("segs")) if write else F.array_join("segs", " ") if spaced else joined(F.col("segs"), segments)
    return rows.where("freq > 0").select(F.when(F.col("freq") == 1, text).otherwise(F.concat_ws("\t", text, F.col("freq").cast("string"))).alias("value"))


def length_frequencies(words: DataFrame) -> DataFrame:
    """``len, n`` for every length from 0 to the longest, zeros too; an empty lexicon has none."""
    seen = words.groupBy(F.size("word").alias("len")).agg(F.sum("freq").alias("n"))
    # one row with a number for each length, so that the corpus is read once
    row = seen.agg(F.max("len").alias("top"), F.map_from_entries(F.collect_list(F.struct("len", "n"))).alias("of")).where("top is not null")
    return row.select("of", F.explode(F.sequence(F.lit(0), "top")).alias("len")).select("len", F.coalesce(F.try_element_at("of", F.col("len")), F.lit(0)).alias("n"))


def ngrams(words: DataFrame, n: int, *keys: str) -> DataFrame:
    """Contiguous n-grams of segment ids with their weighted number: ``s1 .. sn, n``."""
    pieces = F.when(F.size("word") >= n, F.transform(F.sequence(F.lit(1), F.size("word") - n + 1), lambda i: F.slice("word", i, n)))
    found = words.select(*keys, "freq", F.explode(pieces).alias("g"))
    names = [F.col("g")[i].alias(f"s{i + 1}") for i in range(n)]
    return found.select(*keys, "freq", *names).groupBy(*keys, *[f"s{i + 1}" for i in range(n)]).agg(F.sum("freq").alias("n"))


def edge_ngrams(words: DataFrame, n: int, final: bool) -> DataFrame:
    """The first or last n segments of words with their weighted number."""
    fit = words.where(F.size("word") >= n)
    names = [(F.element_at("word", i - n) if final else F.element_at("word", i + 1)).alias(f"s{i + 1}") for i in range(n)]
    return fit.select("freq", *names).groupBy(*[f"s{i + 1}" for i in range(n)]).agg(F.sum("freq").alias("n"))


def subsequences(items: Column, k: int) -> Column:
    """All choices of k elements in order, by taking or leaving each."""
    start = F.array(F.slice(items, 1, 0))

    def grow(held: Column, x: Column) -> Column:
        return F.concat(held, F.transform(F.filter(held, lambda h: F.size(h) < k), lambda h: F.concat(h, F.array(x))))

    return F.array_sort(F.filter(F.aggregate(items, start, grow), lambda h: F.size(h) == k))


def triples(words: DataFrame) -> DataFrame:
    """Weighted number of all choices of three segments in order: ``s1, s2, s3, n``.

    Choices are not listed: at each middle place, the number of each segment before it is multiplied by the number of each
    segment after it, so a word costs its length times the square of its distinct segments.
    """

    def counted(side: Column) -> Column:
        return F.transform(F.array_distinct(side), lambda s: F.struct(s.alias("s"), F.size(F.filter(side, lambda x: x == s)).alias("k")))

    middle = words.where(F.size("word") > 2).select("word", "freq", F.explode(F.sequence(F.lit(2), F.size("word") - 1)).alias("i"))
    sides = middle.select("freq", F.element_at("word", F.col("i")).alias("s2"), counted(F.slice("word", F.lit(1), F.col("i") - 1)).alias("before"), counted(F.slice("word", F.col("i") + 1, F.size("word") - F.col("i"))).alias("after"))
    # tasks sum by three segments, whose combinations are bounded, before anything is shuffled
    left = sides.select("freq", "s2", "after", F.explode("before").alias("b")).select("freq", "s2", "after", F.col("b.s").alias("s1"), F.col("b.k").alias("k"))
    full = left.select("s1", "s2", (F.col("freq") * F.col("k")).alias("m"), F.explode("after").alias("a"))
    return full.groupBy("s1", "s2", F.col("a.s").alias("s3")).agg(F.sum(F.col("m") * F.col("a.k")).alias("n"))


def padded_sum(a: Column, b: Column) -> Column:
    """Position-wise sum; the shorter array counts as filled with zeros."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; what the longer array has beyond the shorter doesn't count."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

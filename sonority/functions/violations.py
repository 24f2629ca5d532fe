"""Violations of constraints in a corpus.

Globs of single parts depend on n-gram totals alone: the corpus is read once into n-gram counts, which the feature
table bounds, and all classes are summed over those. Other globs run over words: those of fixed length as patterns, those
with repetitions as automata, so words may have any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonority.functions.automata import counter
from sonority.functions.features import FeatureTable
from sonority.functions.globs import Glob, counting_pattern
from sonority.functions.segments import encoded


def of_bigrams(counts: DataFrame, member: DataFrame, pairs: DataFrame) -> DataFrame:
    """Observed violations of class pairs.

    :param counts: ``s1, s2, n``, segment bigrams; ``member``: ``class_id, seg_id``; ``pairs``: ``c1, c2`` and others.
    :return: ``pairs`` with ``violations``. The sum over the first class is made before the second is joined.
    """
    first = counts.join(F.broadcast(member), F.col("s1") == F.col("seg_id")).groupBy(F.col("class_id").alias("c1"), "s2").agg(F.sum("n").alias("n"))
    both = first.join(F.broadcast(member), F.col("s2") == F.col("seg_id")).groupBy("c1", F.col("class_id").alias("c2")).agg(F.sum("n").alias("violations"))
    return pairs.join(both, ["c1", "c2"], "left").withColumn("violations", F.coalesce("violations", F.lit(0)))


def of_singles(counts: DataFrame, member: DataFrame, classes: DataFrame) -> DataFrame:
    """``classes`` (``c1`` and others) with ``violations``, from segment counts ``s1, n``."""
    sums = counts.join(F.broadcast(member), F.col("s1") == F.col("seg_id")).groupBy(F.col("class_id").alias("c1")).agg(F.sum("n").alias("violations"))
    return classes.join(sums, "c1", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))


def glob_count(word: str, encoded_word: str, glob: Glob, table: FeatureTable) -> Column:
    """Places of a word where some match of the glob ends.

    :param word: column of segment ids; ``encoded_word``: column of the same word with one code point a segment.
    """
    sets = glob.sets(table)
    if not any(rep for rep, _ in sets):
        return F.regexp_count(encoded_word, F.lit(counting_pattern(glob.initial, glob.final, sets)))
    # the automaton depends on the glob and the table alone; its tables are literals
    n = len(table.segments)
    m = counter(glob.initial, glob.final, sets, n)
    to, out, end = (F.array(*[F.lit(int(x)) for x in t.ravel()]) for t in (m.to, m.out, m.end))
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("k"))

    def step(held: Column, s: Column) -> Column:
        at = held["q"] * n + s - 1
        return F.struct(F.get(to, at).alias("q"), (held["k"] + F.get(out, at)).alias("k"))

    return F.aggregate(word, start, step, lambda held: held["k"] + F.get(end, held["q"]))


def of_globs(words: DataFrame, globs: dict[str, Glob], table: FeatureTable, *keys: str) -> DataFrame:
    """``name, violations`` of each glob over a lexicon ``word, freq``, in a single pass."""
    word = words.select(*keys, "freq", "word", encoded(F.col("word")).alias("enc"))
    counts = word.select(*keys, "freq", *[glob_count("word", "enc", g, table).alias(f"_{name}") for name, g in globs.items()])
    sums = [F.sum(F.col("freq") * F.col(f"_{name}")).alias(name) for name in globs]
    row = counts.groupBy(*keys).agg(*sums) if keys else counts.agg(*sums)
    return row.unpivot(list(keys), list(globs), "name", "violations").withColumn("violations", F.coalesce("violations", F.lit(0)))


def reached(word: Column | str, between: int) -> Column:
    """``array<struct<reach, seg>>``: at each place of a word, the bits of the segments that stand before it with one or more segments of
    ``between``, and nothing else, in the gap; places where there are none are left out."""
    start = F.expr("named_struct('reach', 0L, 'p', 0, 'pp', 0, 'out', cast(array() as array<struct<reach:bigint,seg:int>>))")

    def bit(seg):
        return F.pow(F.lit(2.0), seg - 1).cast("long")

    def step(held, x):
        gap = (held["p"] > 0) & (held["pp"] > 0) & (F.lit(between).cast("long").bitwiseAND(bit(held["p"])) != 0)
        reach = F.when(gap, held["reach"].bitwiseOR(bit(held["pp"]))).otherwise(F.lit(0).cast("long"))
        out = F.when(reach != 0, F.concat(held["out"], F.array(F.struct(reach.alias("reach"), x.alias("seg"))))).otherwise(held["out"])
        return F.struct(reach.alias("reach"), x.alias("p"), held["p"].alias("pp"), out.alias("out"))
    return F.aggregate(word, start, step, lambda h: h["out"])


def reach_counts(words: DataFrame, between: int) -> DataFrame:
    """What long-distance globs with the set ``between`` depend on: ``reach, seg, n``.

    At each place of a word, ``reach`` has the bits of the segments that stand before it with one or more segments
    of ``between``, and nothing else, in the gap. A glob's count is the sum of ``n`` where its first class meets ``reach``
    and its last class has ``seg``.
    """
    found = words.select("freq", F.explode(reached("word", between)).alias("x"))
    return found.groupBy("x.reach", "x.seg").agg(F.sum("freq").alias("n"))


def family_totals(words: DataFrame, edges: bool, trigrams: bool, between: list[int]) -> DataFrame:
    """What all families of candidates depend on, from one pass over a lexicon: ``kind, s1, s2, s3, reach, n``.

    Kinds are ``1``, ``2`` and ``3`` for n-grams, with ``i`` or ``f`` after them for those at a word's start or end, and ``far`` for
    long-distance totals, where ``s2`` is the number of the set in ``between`` and ``s3`` the last segment. Places that a kind lacks are 0.
    """
    size, word = F.size("word"), F.col("word")
    no = F.lit(0)

    def at(i: Column) -> Column:
        return F.element_at(word, i)

    def row(kind: str, s1: Column = no, s2: Column = no, s3: Column = no, reach: Column | None = None) -> Column:
        held = F.lit(0).cast("long") if reach is None else reach
        return F.struct(F.lit(kind).alias("kind"), s1.cast("int").alias("s1"), s2.cast("int").alias("s2"), s3.cast("int").alias("s3"), held.alias("reach"))

    def grams(n: int) -> Column:
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: row(str(n), *[at(i + k) for k in range(n)])))

    pieces = [grams(n) for n in ((1, 2, 3) if trigrams else (1, 2))]
    if edges:
        pieces += [F.when(size >= n, F.array(row(f"{n}i", *[at(F.lit(k + 1)) for k in range(n)]), row(f"{n}f", *[at(F.lit(k - n)) for k in range(n)]))) for n in (1, 2)]

    def far(k: int, mask: int) -> Column:
        return F.transform(reached("word", mask), lambda x: row("far", no, F.lit(k), x["seg"], x["reach"]))

    pieces += [far(k, mask) for k, mask in enumerate(between)]
    empty = F.slice(F.array(row("1")), 1, 0)
    found = words.select("freq", F.explode(F.concat(*[F.coalesce(p, empty) for p in pieces])).alias("x"))
    return found.groupBy("x.kind", "x.s1", "x.s2", "x.s3", "x.reach").agg(F.sum("freq").alias("n"))


def class_sums(totals: DataFrame, member: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Sums of :func:`family_totals` over classes in place of segments: ``kind, c1, c2, c3, n``.

    One place after another is summed, so that nothing is listed for combinations of segments. A place that a kind lacks has
    class 0; the second place of ``far`` stays the number of its set.

    :param member: ``class_id, seg_id``; ``classes``: ``class_id, mask``, only where there are ``far`` totals.
    """
    zero = member.sparkSession.createDataFrame([(0, 0)], "class_id int, seg_id int").coalesce(1)
    full = F.broadcast(member.select(F.col("class_id").cast("int").alias("class_id"), F.col("seg_id").cast("int").alias("seg_id")).union(zero))
    near = totals.where("kind <> 'far'").select("kind", F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("s3").alias("c3"), "n")
    columns = ["c1", "c2", "c3"]
    for c in columns:
        others = [x for x in columns if x != c]
        near = near.join(full, near[c] == full["seg_id"]).groupBy("kind", *others, F.col("class_id").alias(c)).agg(F.sum("n").alias("n"))
    near = near.select("kind", *columns, "n")
    if classes is None:
        return near
    far = totals.where("kind = 'far'").join(F.broadcast(classes.select("class_id", "mask")), F.col("reach").bitwiseAND(F.col("mask")) != 0)
    far = far.groupBy(F.col("class_id").cast("int").alias("c1"), F.col("s2").alias("c2"), "s3").agg(F.sum("n").alias("n"))
    far = far.join(full, F.col("s3") == F.col("seg_id")).groupBy("c1", "c2", F.col("class_id").alias("c3")).agg(F.sum("n").alias("n"))
    return near.unionByName(far.select(F.lit("far").alias("kind"), "c1", "c2", "c3", "n"))

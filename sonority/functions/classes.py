"""Natural classes and the candidate families that are built from them."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonority.functions.features import FeatureTable
from sonority.functions.segments import union_all


def label(inverted: bool, literals: tuple[tuple[str, str], ...] | list[tuple[str, str]]) -> str:
    """A class in brackets: states before names, a true minus sign, and a sign for inversion."""
    return "[" + ("¬ " if inverted else "") + " ".join({"-": "−"}.get(s, s) + f for s, f in literals) + "]"


def members(table: FeatureTable, inverted: bool, literals: list[tuple[str, str]]) -> int:
    """Bits of a class: all its literals hold; those of unknown features don't count; then inverted if asked."""
    full, known = (1 << len(table.segments)) - 1, table.known()
    mask = full
    for state, feature in literals:
        if feature in known:
            mask &= table.mask(feature, state)
    return mask ^ full if inverted else mask


def by_generality(spark: SparkSession, table: FeatureTable, max_features: int = 3) -> DataFrame:
    """All different classes of up to ``max_features`` literals: ``class_id, mask, size, inverted, label``.

    Literals are joined to each other in ascending order, masks by bitwise and. Of equal sets the first label stays:
    not inverted before inverted, fewer literals before more, then the literals' order. Ids follow size, largest
    first, then the set itself. Sets are the bits of a long, so the table has at most 62 segments.
    """
    if len(table.segments) > 62:
        raise ValueError("classes are made over at most 62 segments")
    full = (1 << len(table.segments)) - 1
    rows = [(2 * f + (s == "-"), s, name, table.mask(name, s)) for name, f in table.known().items() for s in "+-"]
    literal = spark.createDataFrame(rows, "ord int, state string, feat string, m long").coalesce(1)
    text = F.concat(F.when(F.col("state") == "-", "−").otherwise(F.col("state")), "feat")
    one = F.broadcast(literal.select(F.col("ord").alias("o"), text.alias("t"), "m"))
    level = spark.range(1).coalesce(1).select(F.lit(full).cast("long").alias("mask"), F.array().cast("array<int>").alias("ords"), F.array().cast("array<string>").alias("parts"))
    levels = [level]
    for _ in range(max_features):
        grown = levels[-1].join(one, (F.size("ords") == 0) | (F.col("o") > F.element_at(F.concat(F.array(F.lit(-1)), "ords"), -1)))
        # a feature stands once in a class
        grown = grown.where((F.size("ords") == 0) | ((F.col("o") / 2).cast("int") > (F.element_at(F.concat(F.array(F.lit(-2)), "ords"), -1) / 2).cast("int")))
        levels.append(grown.select(F.col("mask").bitwiseAND(F.col("m")).alias("mask"), F.concat("ords", F.array("o")).alias("ords"), F.concat("parts", F.array("t")).alias("parts")))
    plain = union_all(levels)
    both = plain.withColumn("inverted", F.lit(False)).union(plain.select(F.col("mask").bitwiseXOR(F.lit(full)), "ords", "parts", F.lit(True)))
    first = both.where("mask <> 0").groupBy("mask").agg(F.min_by(F.struct("inverted", "parts"), F.struct("inverted", F.size("ords"), "ords")).alias("x"))
    named = first.select("mask", F.bit_count("mask").alias("size"), "x.inverted", F.concat(F.when(F.col("x.inverted"), "[¬ ").otherwise("["), F.array_join("x.parts", " "), F.lit("]")).alias("label"))
    return named.select(F.row_number().over(Window.orderBy(F.desc("size"), "mask")).alias("class_id"), "*")


def class_frame(spark: SparkSession, table: FeatureTable, max_features: int = 3) -> DataFrame:
    """The rows of :func:`by_generality` as a table of literals: the feature table bounds them, so nothing is joined for them again."""
    rows = [(i, m, m.bit_count(), inverted, name) for i, (m, inverted, name) in enumerate(class_list(table, max_features), 1)]
    return spark.createDataFrame(rows, "class_id int, mask long, size int, inverted boolean, label string").coalesce(1)


def core(table: FeatureTable, features: list[str]) -> list[tuple[str, int]]:
    """The full class, then each listed feature's plus, then their minuses; empty and repeated sets are left out."""
    out: dict[int, str] = {}
    for literals in [[], *([("+", f)] for f in features), *([("-", f)] for f in features)]:
        mask = members(table, False, literals)
        if mask:
            out.setdefault(mask, label(False, literals))
    return [(name, mask) for mask, name in out.items()]


def membership(classes: DataFrame, segments: int) -> DataFrame:
    """``class_id, seg_id``: a row for each segment of each class."""
    return classes.select("class_id", F.explode(F.filter(F.sequence(F.lit(1), F.lit(segments)), lambda i: F.getbit(F.col("mask"), (i - 1).cast("int")) == 1)).alias("seg_id"))


@dataclass(frozen=True)
class Settings:
    """Which families to build: edges, trigrams with these core features, long distance with these."""

    edges: bool = False
    trigrams: tuple[str, ...] | None = None
    broken: tuple[str, ...] | None = None


def singles(classes: DataFrame) -> DataFrame:
    """Classes by themselves: ``family, c1, weight``; inverted ones are left out."""
    return classes.where("not inverted").select(F.lit("single").alias("family"), F.col("class_id").alias("c1"), (-F.col("size")).alias("weight"))


def edge_singles(classes: DataFrame) -> DataFrame:
    """Each class word-finally, then word-initially."""
    return singles(classes).drop("family").withColumn("final", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("family", F.lit("edge"))


def _side(classes: DataFrame, k: int) -> DataFrame:
    return classes.select(F.col("class_id").alias(f"c{k}"), F.col("inverted").alias(f"i{k}"), F.col("size").alias(f"z{k}"), F.col("label").alias(f"l{k}"))


def bigrams(classes: DataFrame) -> DataFrame:
    """Ordered pairs of classes, not both inverted. The classes are bounded by the feature table, not by the data."""
    pairs = _side(classes, 1).join(F.broadcast(_side(classes, 2)), ~(F.col("i1") & F.col("i2")))
    return pairs.select(F.lit("bigram").alias("family"), "c1", "c2", (-F.col("z1") - F.col("z2")).alias("weight"))


def edge_bigrams(classes: DataFrame) -> DataFrame:
    return bigrams(classes).drop("family").withColumn("final", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("family", F.lit("edge_bigram"))


def trigrams(classes: DataFrame, cores: DataFrame) -> DataFrame:
    """Triples of classes with a core class among them; a core class's size is not in the weight.

    The first part that is a core class decides; where neither of the first two is, the third is taken from the core.
    At most one part is inverted. ``cores`` has ``label, mask``; classes are core by their label.
    """
    marked = classes.join(F.broadcast(cores.select("label").distinct().withColumn("core", F.lit(True))), "label", "left").withColumn("core", F.coalesce("core", F.lit(False)))

    def side(k: int) -> DataFrame:
        return marked.select(F.col("class_id").alias(f"c{k}"), F.col("inverted").cast("int").alias(f"i{k}"), F.col("size").alias(f"z{k}"), F.col("core").alias(f"k{k}"))

    pairs = side(1).join(F.broadcast(side(2)), F.col("i1") + F.col("i2") <= 1)
    all3 = pairs.join(F.broadcast(side(3)), (F.col("i1") + F.col("i2") + F.col("i3") <= 1) & (F.col("k1") | F.col("k2") | F.col("k3")))
    weight = -F.when(F.col("k1"), F.col("z2") + F.col("z3")).when(F.col("k2"), F.col("z1") + F.col("z3")).otherwise(F.col("z1") + F.col("z2"))
    return all3.select(F.lit("trigram").alias("family"), "c1", "c2", "c3", weight.alias("weight"))


def long_distance(classes: DataFrame, cores: DataFrame, guard: bool = False) -> DataFrame:
    """A class, one or more of a core class, and a class. ``guard`` leaves out pairs that are both inverted."""
    ends = _side(classes, 1).join(F.broadcast(_side(classes, 3)), ~(F.col("i1") & F.col("i3")) if guard else F.lit(True))
    between = cores.select(F.col("label").alias("l2"), F.col("mask").alias("m2"))
    return ends.crossJoin(F.broadcast(between)).select(F.lit("long_distance").alias("family"), "c1", "l2", "m2", "c3", (-F.col("z1") - F.col("z3")).alias("weight"))


def candidates(spark: SparkSession, table: FeatureTable, settings: Settings = Settings(), classes: DataFrame | None = None) -> DataFrame:
    """All families in the order in which they are tried: ``ordinal, family, c1, c2, l2, m2, c3, final, weight``.

    Ascending weight within a family, then the order in which the family is built. Candidates are numbered within runs of the
    same family, weight and first class; only the runs, which the classes bound, are summed in one place.

    :param classes: the classes to combine; None: all of the table.
    """
    classes = class_frame(spark, table) if classes is None else classes
    held = [singles(classes)]
    if settings.edges:
        held.append(edge_singles(classes))
    held.append(bigrams(classes))
    if settings.edges:
        held.append(edge_bigrams(classes))
    for kind, build in ((settings.trigrams, trigrams), (settings.broken, long_distance)):
        if kind is not None:
            cores = spark.createDataFrame(core(table, list(kind)), "label string, mask long").coalesce(1)
            held.append(build(classes, cores))
    order = {"single": 0, "edge": 1, "bigram": 2, "edge_bigram": 3, "trigram": 4, "long_distance": 5}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("family")]
    columns = {"c2": "int", "c3": "int", "l2": "string", "m2": "long", "final": "boolean"}
    full = [h.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in h.columns}) for h in held]
    every = union_all([f.select("family", "c1", "c2", "l2", "m2", "c3", "final", "weight") for f in full])
    run, names = [rank.alias("_rank"), "weight", "c1"], ["_rank", "weight", "c1"]
    runs = every.groupBy(*run).agg(F.count("*").alias("_n"))
    before = runs.select(*names, (F.sum("_n").over(Window.orderBy(*names)) - F.col("_n")).alias("_before"))
    # a long-distance candidate's core class stands before its last class
    between = [name for name, _ in core(table, list(settings.broken))] if settings.broken is not None else []
    place = F.array_position(F.array(*map(F.lit, between)), F.col("l2")) if between else F.lit(0)
    own = F.row_number().over(Window.partitionBy(*names).orderBy("c2", place, "c3", F.desc("final")))
    numbered = every.withColumn("_rank", rank).withColumn("_own", own).join(F.broadcast(before), names)
    return numbered.select("family", "c1", "c2", "l2", "m2", "c3", "final", "weight", (F.col("_before") + F.col("_own")).cast("int").alias("ordinal"))


def class_list(table: FeatureTable, max_features: int = 3) -> list[tuple[int, bool, str]]:
    """The classes of :func:`by_generality` for use on the driver: mask, whether inverted, label; in the same order."""
    full, out = (1 << len(table.segments)) - 1, {}
    literals = [(s, f) for f in table.known() for s in "+-"]
    masks = {x: table.mask(x[1], x[0]) for x in literals}
    for inverted in (False, True):
        for k in range(max_features + 1):
            for chosen in combinations(literals, k):
                if len({f for _, f in chosen}) < k:
                    continue
                mask = full
                for x in chosen:
                    mask &= masks[x]
                mask = mask ^ full if inverted else mask
                if mask:
                    out.setdefault(mask, (inverted, label(inverted, chosen)))
    return [(m, *out[m]) for m in sorted(out, key=lambda m: (-m.bit_count(), m))]


def matrix(masks: list[int], segments: int) -> np.ndarray:
    """Classes by segments, 0 and 1."""
    return np.array([[m >> i & 1 for i in range(segments)] for m in masks], np.int64).reshape(len(masks), segments)

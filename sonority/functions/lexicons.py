"""Lexicons as tables that are kept, changed, made anew and put in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonority.functions.features import FeatureTable
from sonority.functions.segments import joined, named, of_tokens, tokens, union_all, word_list, references
from sonority.sources.tables import written

#: Where a row of a kept source comes from: an edit by hand, a word list, or running text.
CUSTOM, LIST, TEXT = "custom", "list", "text"


def merged(base: DataFrame, changes: DataFrame, keys: list[str], sequence: str = "seq", op: str = "op") -> DataFrame:
    """A table after a log of changes to its rows.

    Of the changes of a key the last counts, whatever came before it: ``insert`` and ``update`` put the row as the change has it, ``delete``
    takes it away. Of equal sequence numbers the greatest change counts, deletions least. Changes with a null key, sequence or another
    ``op`` are none; so are null operations. The last change is found by a maximum that tasks take ahead of the shuffle, so a
    key may have any number of changes.

    :param base: one row for each key; ``changes``: the columns of ``base``, ``sequence`` and ``op``.
    """
    values = [c for c in base.columns if c not in keys]
    known = changes.where(F.col(op).isin("insert", "update", "delete") & F.col(sequence).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    change = F.struct(F.col(sequence).alias("_seq"), (F.col(op) != "delete").alias("_stays"), *values)
    last = known.groupBy(*keys).agg(F.max(change).alias("_last"))
    both = base.withColumn("_had", F.lit(True)).join(last, keys, "full")
    rows = both.select(*keys, *[F.when(F.col("_last").isNull(), F.col(c)).otherwise(F.col(f"_last.{c}")).alias(c) for c in values], F.col("_last._stays").alias("_stays"))
    return rows.where("_stays is null or _stays").select(base.columns)


def of_text(docs: DataFrame) -> DataFrame:
    """The source of a collated text: ``kind, value, n``, distinct words with their numbers."""
    return tokens(docs).select(F.lit(TEXT).alias("kind"), F.col("token").alias("value"), "n")


def of_list(lines: DataFrame) -> DataFrame:
    """The source of a word list: its lines, equal ones once with their number."""
    return lines.groupBy("value").agg(F.count("*").alias("n")).select(F.lit(LIST).alias("kind"), "value", "n")


def of_edits(rows: DataFrame, table: FeatureTable) -> DataFrame:
    """The source of words ``word, freq`` that were entered by hand: written out with the segments of ``table``, apostrophes where they
    would join, so that another table may read them."""
    return rows.select(F.lit(CUSTOM).alias("kind"), joined(named(F.col("word"), table.segments), table.segments).alias("value"), F.col("freq").cast("long").alias("n"))


def kept(*sources: DataFrame) -> DataFrame:
    """Sources as one written table, from which lexicons are made without going back to the texts and lists."""
    return written(union_all(list(sources)), "source")


def resegmented(source: DataFrame, table: FeatureTable) -> DataFrame:
    """``kind, word, freq`` of a kept source under a feature table; words without segments are dropped."""
    read = of_tokens(source.where(F.col("kind") != LIST).select("kind", F.col("value").alias("token"), "n"), table.segments, "kind")
    # a line's own frequency counts as often as the line stands in the list
    lines = source.where(F.col("kind") == LIST)
    listed = word_list(lines, table.segments, extra=["n"])
    cut = listed.select(F.lit(LIST).alias("kind"), references(F.col("segs"), table.segments).alias("word"), (F.col("freq") * F.col("n")).alias("freq"))
    return read.unionByName(cut.groupBy("kind", "word").agg(F.sum("freq").alias("freq")))


def placed(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``place``, from 1, in the order of ``by``, which should be a key.

    Rows are sorted over ranges, each by a task of its own; a row's place is its number in its range and the number of rows in the
    ranges before it. One number for each range is summed in one place.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges depend on a sample, so they are written before they are counted
    cut = rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    held = written(cut, "ranges")
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, run = [], 0
    for p in sorted(sizes):
        before.append((p, run))
        run += sizes[p]
    starts = rows.sparkSession.createDataFrame(before, "_part long, _before long").coalesce(1)
    return held.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_before") + own + 1).alias("place"))
